"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from nearpass.llm import (
    cap_filters,
    jaccard_join,
    language_id,
    license_scan,
    pattern_packing,
    positional_index,
    quality,
    sharding,
    suffix_dedup,
    token_rows,
)

LONG = " ".join(f"word{i % 997} of{i}" for i in range(60_000))
TEXTS = [
    (1, "One two three four five six seven."), (1, "One two three four five six seven."), (2, None), (3, ""), (4, "  \n "),
    (5, "one"), (None, "A text without a number of its own, that is all."), (6, LONG), (7, LONG + " end"), (8, "äöü ß 漢字"),
]
SCHEMA = "doc_id long, text string"
CLASHES = (
    "key node n lo hi core triple bytes id size hash bytes length number shard slot label score held_out place block term"
    " phrase start words host domain suffix declared language rejected page_id sig component vector filter before spans mark"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in dict.fromkeys(CLASHES)} | {"lang": F.lit("en"), "source": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string, source string")


def labels(spark):
    return spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (99, 1, "x"), (6, None, None)], "doc_id long, quality int, text string")


def bench(spark):
    rows = [("a", "three FOUR five", "x"), (None, "no such words here", "x"), ("c", None, "x"), ("d", "", "x"), ("a", "three FOUR five", "x")]
    return spark.createDataFrame(rows, "item_id string, text string, block string")


OPERATORS = {
    "languages": lambda s, d: language_id.identify(language_id.document_evidence(d), d),
    "licences": lambda s, d: license_scan.scan_licenses(d),
    "quality": lambda s, d: quality.quality_scores(d, labels(s)),
    "repeats": lambda s, d: suffix_dedup.remove_repeats(d),
    "contamination": lambda s, d: positional_index.contamination(d, bench(s)),
    "shards": lambda s, d: sharding.shard(d),
    "groups": lambda s, d: jaccard_join.jaccard_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, docs, empty, name):
    got = sorted(r.doc_id or 0 for r in OPERATORS[name](spark, docs).select("doc_id").collect())
    assert got == sorted(k or 0 for k, _ in TEXTS)
    assert OPERATORS[name](spark, empty).collect() == []


def test_languages(spark, docs):
    rows = OPERATORS["languages"](spark, docs).collect()
    assert {r.doc_id for r in rows if r.rejected} >= {2, 3, 4}
    assert not {r.doc_id for r in rows if r.rejected} & {6, 7}
    assert {r.language for r in rows if r.rejected} == {"und"}
    assert {r.language for r in rows if not r.rejected} == {"en"}


def test_contamination(spark, docs):
    rows = {r.doc_id: r for r in OPERATORS["contamination"](spark, docs).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (7, 3, 1, True)
    assert all(r.n_hit == 0 and not r.contaminated for k, r in rows.items() if k != 1)
    assert rows[2].n_words == rows[3].n_words == 0


def test_near_phrases(spark, docs):
    import numpy as np

    from nearpass.llm.work import Work

    work = Work(spark)
    every = np.ones(1 << positional_index.MAP_BITS, bool)
    index = positional_index.build_index(docs, every, "doc_id", "text", work)
    words = spark.createDataFrame([("q", "two five")], "item string, text string")
    phrase = words.mapInArrow(positional_index._windows(13), "item string, terms array<bigint>").withColumn("phrase", F.xxhash64("terms"))
    assert positional_index.phrases_in(index, phrase, work).count() == 0
    assert positional_index.near_in(index, phrase, 3).count() == 2
    assert positional_index.near_in(index, phrase, 2).count() == 0


def test_repeats(spark, docs):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert rows[6].n_removed == rows[6].n_bytes and rows[6].kept_text == ""
    assert rows[7].n_removed == len(LONG) and rows[7].kept_text == " end"
    assert all(rows[k].n_removed == 0 for k in (1, 2, 3, 4, 5, 8))


def test_groups(spark, docs):
    rows = {r.doc_id: r for r in OPERATORS["groups"](spark, docs).collect()}
    assert rows[7].component_id == 6 and rows[1].component_id == 1
    assert (rows[1].n_shingles, rows[2].n_shingles, rows[4].n_shingles, rows[5].n_shingles) == (4, 0, 0, 1)
    assert [rows[k].component_id for k in (2, 3, 4)] == [2, 3, 4]


def test_shards(spark, docs):
    rows = sharding.shard(docs, shards=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {8}


def test_best_capacity_against_all_partitions():
    import random
    from itertools import combinations_with_replacement

    random.seed(5)
    for _ in range(200):
        sizes = [random.randint(1, 40) for _ in range(random.randint(1, 9))]
        shards = random.randint(1, 4)
        ranges = sharding.Ranges([(k << 60, 64, n, 1) for k, n in enumerate(sizes)])
        cuts = combinations_with_replacement(range(len(sizes) + 1), shards - 1)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in cuts)
        assert ranges.smallest(shards) == best


def test_vectors(spark):
    near = [1.0, 0.0, 0.1]
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, near, 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, [None, 1.0, 0.0], 1), (9, [], 1),
        (10, [2.0, 0.0, 0.0], 1), (10, [2.0, 0.0, 0.0], 1), (11, [float("inf"), 0.0, 0.0], 1), (12, [1.0, 0.0], 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = sorted(tuple(r) for r in cap_filters.near_vectors(table).collect())
    linked = {(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False)}
    alone = {(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11, 12)}
    assert set(got) == linked | alone and len(got) == len(rows)
    assert cap_filters.near_vectors(table.limit(0)).collect() == []


def test_pieces_and_rows(spark, docs, empty):
    assert pattern_packing.pack(empty).collect() == []
    assert token_rows.token_rows(empty).collect() == []
    pieces = pattern_packing.pack(docs, size=64).collect()
    places = {}
    for r in pieces:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        edge = 0
        for offset, length in sorted(parts):
            assert offset == edge
            edge += length
        assert edge <= 64
    total = sum(r.length for r in pieces)
    assert len(places) <= 1.02 * total / 64 + 1
    rows = token_rows.token_rows(docs, width=64).collect()
    assert sum(r.cu_seqlens[-1] for r in rows) == total
    assert sorted(d or 0 for r in rows for d, s in zip(r.doc_ids, r.starts, strict=True) if s == 0) == sorted(k or 0 for k, _ in TEXTS)


def test_licences(spark):
    texts = ["x y.\nReleased under the MIT license!\nz", "Licensed under the Apache License, Version 2.0.", "the MIT of all", None]
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = [r.license for r in sorted(license_scan.scan_licenses(table).collect())]
    assert got == ["MIT", "Apache-2.0", None, None]


def test_licence_notices_of_documents(spark):
    """Every kind of notice that stands in the documents, against a plain search for its line."""
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "proprietary",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = {r.doc_id: {notices[x] for x in (r.text or "").split("\n") if x in notices} for r in docs.collect()}
    assert set().union(*plain.values()) == set(notices.values())
    for r in license_scan.scan_licenses(docs).collect():
        assert set(r.licenses) == plain[r.doc_id] and (r.license is not None) == bool(r.licenses)


def test_licences_inside_longer_units(spark):
    prose = "Some other words that fill the line and say nothing of any kind about terms of use at all. "
    full = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["BSD-3-Clause"][1]
    permission = license_scan.TEMPLATES["MIT"][2]
    texts = {
        prose + "Released under the MIT License. " + prose: ["MIT"],
        prose + permission + " " + prose: ["MIT"],
        prose * 5 + " ".join(full[0].split()) + prose * 5: ["GPL-3.0"],
        full[0]: ["GPL-3.0"],
        full[0].replace("software", "program", 20): ["GPL-3.0"],
        prose + full[1] + prose + "Licensed under CC BY-NC 4.0, " + prose: ["BSD-3-Clause", "CC-BY-NC-4.0"],
        prose + "This work is licensed under the GNU General Public License, version 2, " + prose: ["GPL-2.0"],
        prose + "All rights. Reserved seats under the license of the town.": ["proprietary"],
        prose * 3: [],
    }
    for licence, wordings in license_scan.TEMPLATES.items():
        texts |= {prose + wording + " " + prose: [licence] for wording in wordings}
    table = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    for k, (text, licences) in enumerate(texts.items()):
        assert got[k].licenses == licences, text[:200]
        assert got[k].n_matches == len(licences)


def test_passages_against_all_runs_of_words():
    import random
    from collections import Counter

    import numpy as np

    random.seed(3)
    for _ in range(300):
        template = Counter(random.choices("abcdef", k=random.randint(1, 9)))
        names = sorted(template)
        text = "".join(random.choices("abcdefxyz", k=random.randint(1, 40)))
        cut = random.randint(0, len(text))  # two texts, of which no passage holds parts of both
        at = np.array([i for i, c in enumerate(text) if c in template], int)
        stop = np.where(at < cut, cut, len(text))
        counts = np.array([template[c] for c in names])
        places = license_scan._Places(at, np.array([names.index(text[i]) for i in at], int), stop, counts, 0.8)
        got = [(int(at[a]), int(at[b]), v) for a, b, v in places.passages()]
        every = {}
        for a in range(len(text)):
            for b in range(a, cut if a < cut else len(text)):
                part = Counter(text[a : b + 1])
                every[a, b] = 2 * sum((part & template).values()) / (b - a + 1 + template.total())
        assert all(every[a, b] == v for a, b, v in got)
        assert all(x[1] < y[0] for x, y in zip(sorted(got), sorted(got)[1:], strict=False))
        for (a, b), v in every.items():
            assert v < 0.8 or any(a <= y and x <= b and w >= v for x, y, w in got)


def words_from(seed, n=60):
    import random

    return " ".join(random.Random(seed).choices([f"w{k}" for k in range(5000)], k=n))


def test_pipeline_tells_texts_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline

    copied, passage = words_from(1), words_from(2, 20)
    rows = [
        (1, copied), (2, words_from(3)), (2, copied + " end"), (2, words_from(4)), (2, words_from(4)), (3, words_from(5)),
        (3, words_from(6) + " " + passage), (4, copied + " more"), (5, words_from(7)), (5, words_from(7) + " end"), (6, None), (None, copied),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)).collect()
    assert {tuple(r) for r in got if r.doc_id != 5} == {x for x in rows if x not in ((2, copied + " end"), (4, copied + " more")) and x[0] != 5}
    assert sum(r.doc_id == 5 for r in got) == 1 and len(got) == 8
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert len(got) == len(rows) - 1 and {tuple(r) for r in got} == set(rows) - {rows[6]}


def test_languages_without_labels_are_kept(spark):
    import random

    draw = random.Random(9)
    latin = (
        "gallia est omnis divisa in partes tres quarum unam incolunt belgae aliam aquitani tertiam qui ipsorum lingua celtae nostra galli"
        " appellantur hi omnes lingua institutis legibus inter se differunt gallos ab aquitanis garumna flumen a belgis matrona et sequana"
        " dividit horum omnium fortissimi sunt belgae propterea quod a cultu atque humanitate provinciae longissime absunt"
    )
    greek = "".join(chr(0x391 + ord(c) % 26 + 24 * (c != " ")) if c != " " else c for c in latin)
    noise = " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(300))
    labelled = [(k, " ".join(draw.choices(["the", "and", "house", "river", "under", "green", "walks"], k=3000)), "en") for k in range(5)]
    rows = [*labelled, (10, greek, None), (11, noise, None), (12, "12 34 !", None), (13, greek[:90], None), (14, "x" * 4000, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string").withColumn("source", F.lit("s"))
    assert {r.doc_id for r in language_id.keep_identified(docs).collect()} == {0, 1, 2, 3, 4, 10, 13}
    judged = {r.doc_id: (r.language, r.rejected) for r in OPERATORS["languages"](spark, docs).collect()}
    assert judged[10] == judged[13] == ("und", False) and judged[11] == judged[14] == ("und", True) and judged[0] == ("en", False)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_identified(unlabelled).collect()} == {0, 1, 2, 3, 4, 10, 11, 13, 14}


def test_contaminated_row_without_id_goes(spark, tmp_path):
    import corpus_pipeline

    passage = words_from(8, 20)
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "so " + passage), (None, words_from(9)), (1, words_from(10)), (None, None)], SCHEMA)
    got = {tuple(r) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()}
    assert got == {(None, words_from(9)), (1, words_from(10)), (None, None)}
