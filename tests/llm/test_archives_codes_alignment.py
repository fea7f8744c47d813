"""Archives, vector codes and token alignment against brute force, round trips and odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpass.llm import token_alignment, vector_codes, warc

def clashes():
    return {c: F.lit("x") for c in "id url_ label_ digest first bytes payload pair row n place part whole at file block record code".split()}


# --- archives ------------------------------------------------------------------

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:77>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>" + "one page " * 40),
    (2, None, "<p>" + "one page " * 40),
    (3, "http://b/\r\nWARC-Type: evil", "short"),
    (4, "http://b/", "short"),
    (5, "http://c/", None),
    (6, "http://c/", ""),
    (7, "http://d/", RECORD * 30),  # whole records as payload
    (8, "http://d/", "x\r\n\r\n" + RECORD + "\r\n" * 7 + "WARC/1.1\r\nContent-Length: 9999999\r\n\r\n"),
    (9, "http://e/", "WARC/1.0\r\n" * 400),
    (10, "http://e/", "line\n" * 900 + "\r\n\r\n"),
    (11, "http://e/", "ä漢" * 3000),
    (12, "http://e/", RECORD * 30),
    (None, "http://f/", "<p>" + "one page " * 40),
    (13, "http://f/", "<p>" + "one page " * 40),
    (1, "http://a/", "<p>" + "one page " * 40),
    (14, "http://g/", "\r\n"), (15, "http://g/", "\n\r"), (16, "http://g/", "\r\nWARC/1.1"), (17, "", "y" * 99), (18, "", "y" * 99), (19, "", "y" * 100), (20, "", "y" * 100),
]


def expected_pages(pages):
    payload = [(k, (h or "").encode()) for k, _, h in pages]
    least = {}
    for k, p in payload:
        if len(p) >= 100 and k is not None:
            least[p] = min(least.get(p, k), k)
    rows = []
    for k, p in payload:
        again = p in least and least[p] != k
        rows.append((k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[p] if again else None))
    return sorted(rows, key=repr)


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, size)

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["1000", "128m"])
def test_archives_come_back_whole(spark, tmp_path, small_blocks, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).withColumns(clashes())
    warc.write_warc(pages, f"{tmp_path}/w")
    small_blocks(size)
    rows = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len(rows) == len(PAGES)
    assert sorted(r.payload for r in rows if r.type == "response") == sorted(
        (h or "").encode() for k, _, h in PAGES if not is_revisit(k, h)
    )
    assert all(r.digest == f"sha256:{r.sha256}" for r in rows if r.type == "response")
    assert "http://b/%0D%0AWARC-Type: evil" in {r.target for r in rows}


def is_revisit(key, html):
    p = (html or "").encode()
    same = [k for k, _, h in PAGES if k is not None and (h or "").encode() == p]
    return len(p) >= 100 and bool(same) and min(same) != key


@pytest.mark.parametrize("size", ["128m"])
def test_archived_pages(spark, tmp_path, small_blocks, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns(clashes())
    small_blocks(size)
    got = warc.archived(pages, f"{tmp_path}/w").collect()
    assert sorted(map(tuple, got), key=repr) == expected_pages(PAGES)


def test_archived_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id string, url string, html string")
    assert warc.archived(pages, f"{tmp_path}/w").collect() == []


def test_text_keys_and_compression(spark, tmp_path):
    rows = [("a b/ä", "u", "z" * 200), ("c>\r\n", "u", "z" * 200), ("", "u", "w")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_warc(pages, f"{tmp_path}/w", compression="gzip")
    got = warc.read_warc(spark, f"{tmp_path}/w").select(warc.named("name", "string").alias("k"), "type").collect()
    assert sorted(map(tuple, got)) == [("", "response"), ("a b/ä", "response"), ("c>\r\n", "revisit")]


def foreign(records):
    return b"".join(b"WARC/1.0\r\nContent-Length: %d\r\nWARC-Type: resource\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in records)


@pytest.mark.parametrize("size", ["400", "128m"])
def test_broken_and_cut_archives(spark, tmp_path, small_blocks, size):
    """What a broken header or the end of the file cuts off is no record; other files are not touched."""
    good = foreign([b"a" * 300, b"b\n" * 90, b"\xff\xfe" + RECORD.encode()])
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "whole.warc").write_bytes(good)
    (folder / "cut.warc").write_bytes(good + foreign([b"c" * 500])[:-200])
    (folder / "broken.warc").write_bytes(good + b"WARC/1.0\r\nno field\r\n\r\n" + good)
    (folder / "other.warc").write_bytes(b"plain text\n" * 40 + good)
    (folder / "empty.warc").write_bytes(b"")
    small_blocks(size)
    rows = warc.read_warc(spark, str(folder)).collect()
    found = Counter(r.file.rsplit("/", 1)[1] for r in rows)
    assert found == {"whole.warc": 3, "cut.warc": 3, "broken.warc": 3}
    assert {r.payload for r in rows} == {b"a" * 300, b"b\n" * 90, b"\xff\xfe" + RECORD.encode()}


@pytest.mark.parametrize("length", [1, 2, 3, 7, 64])
def test_chain_by_pointer_jumping(spark, length):
    """Blocks of one candidate each: a chain over all of them, and candidates beside it."""
    from nearpass.llm.work import Work

    rows = [("f", b, (b + 1) * 10, b * 10, (b + 1) * 10) for b in range(length)]
    rows += [("f", b, (b + 1) * 10, b * 10 + 3, b * 10 + 20) for b in range(length)]
    rows += [("g", 0, 10, 4, 10), ("h", 0, 20, 0, 7), ("h", 0, 20, 7, 15), ("h", 0, 20, 9, 20)]
    table = spark.createDataFrame(rows, "file string, block long, edge long, at long, next long")
    got = warc.chain(table, Work(spark)).collect()
    assert sorted(map(tuple, got)) == sorted([("f", b * 10) for b in range(length)] + [("h", 0), ("h", 7)])


# --- vector codes ----------------------------------------------------------------


def plain_codes(rows):
    """(id, label, vector) -> codes, errors and books by plain comparison, in Python's own integers."""
    kept = [(k, label, [int(np.floor(256 * float(x))) for x in v]) for k, label, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 16
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(16)] for _, _, v in kept]
    books = [[cut[i][p] for i in range(min(64, len(kept)))] for p in range(16)]

    def assign():
        return [
            [min((sum((x - y) ** 2 for x, y in zip(part, c, strict=True)), e) for e, c in enumerate(books[p])) for p, part in enumerate(parts)]
            for parts in cut
        ]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for e in range(len(books[p])):
                members = [cut[i][p] for i in range(len(kept)) if found[i][p][1] == e]
                if members:
                    books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(
        ((k, "".join(f"{e:02x}" for _, e in f), err, by_label[label], digest) for (k, label, _), f, err in zip(kept, found, errors, strict=True)),
        key=repr,
    )


def vectors(n, width, seed, kind=float):
    r = random.Random(seed)
    spots = [[r.gauss(0, 1) for _ in range(16 * width)] for _ in range(9)]
    return [(i * 3 + 1, r.choice([1, 2, None]), [kind(x + r.gauss(0, 0.2)) for x in r.choice(spots)]) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(5, 1), (300, 1), (700, 4), (130, 6), (90, 70)])
def test_codes_equal_plain_comparison(spark, n, width):
    rows = vectors(n, width, n)
    rows += [(k, label, v) for k, label, v in rows[:40]] + [(None, 1, rows[0][2])]  # repeated rows, a row without a key
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).withColumns(clashes())
    got = sorted(map(tuple, vector_codes.code_digests(table).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_of_small_segments(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "SEGMENT", 1)
    monkeypatch.setattr(vector_codes, "POINTS", 7)
    rows = vectors(400, 2, 5)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(2)
    assert sorted(map(tuple, vector_codes.code_digests(table).collect()), key=repr) == plain_codes(rows)


def test_ties_and_equal_vectors(spark):
    """Entries equal to each other: the first takes all parts, the others stay."""
    rows = [(i, 0, [float(i % 3)] * 16) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, vector_codes.code_digests(table).collect()), key=repr) == plain_codes(rows)


def test_vectors_left_out(spark):
    bad = [None, [], [1.0] * 15, [None] + [1.0] * 15, [float("nan")] + [0.0] * 15, [float("inf")] + [0.0] * 15, [1.0] * 32]
    rows = [(i + 10, 1, v) for i, v in enumerate(bad)] + [(1, 1, [1e30] + [0.0] * 15), (2, 1, [-1e30] + [0.5] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: r.error for r in vector_codes.code_digests(table).collect()}
    assert got == {1: 0, 2: 0}
    assert vector_codes.code_digests(table.filter("vec_id > 9 AND vec_id < 16")).collect() == []


def test_hilbert_curve_has_no_jumps():
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    path = grid[np.argsort(vector_codes.hilbert(grid))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- alignment ---------------------------------------------------------------------


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    import public_tokenizers as public

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    result, count = [], Counter()
    for key, text in texts:
        tokens, ids = [], [[], []]
        if text:
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            tokens = [
                [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
                [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
            ]
            if any(b"".join(t) != (" " + text).encode() for t in tokens):
                tokens, ids = [], [[], []]
        spans = [[], []]
        for side, t in enumerate(tokens):
            at = 0
            for x in t:
                spans[side].append((at, at + len(x)))
                at += len(x)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in common:
            sides = [",".join(str(k) for k, (s, e) in zip(ids[z], spans[z], strict=True) if low <= s and e <= c) for z in (0, 1)]
            groups.append("|".join(sides))
            low = c
        pairs = [(ids[0][i], ids[1][j]) for i, j in links]
        count.update(pairs)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if common else ""
        result.append((key, len(ids[0]), len(ids[1]), len(common), pairs, digest))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        ((k, x, y, g, len(p), sum(count[q] == most[q[1]] for q in p), sum(count[q] for q in p), d) for k, x, y, g, p, d in result), key=repr
    )


TEXTS = [
    (1, "Hello, wonderful tokenizers!"), (2, None), (3, ""), (4, " "), (5, "  \n\t two  spaces \r\n"), (6, "<|endoftext|> <s> a</s>"),
    (7, "äöü ß 漢字 🙂 é"), (8, "▁under ▁"), (9, "a\x00b"), (None, "Hello, wonderful tokenizers!"), (1, "Hello, wonderful tokenizers!"),
    (10, "0123456789" * 30 + " 3.14159e-10"), (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 9), (12, "﻿​ x　y"),
]


@pytest.mark.parametrize("heavy", [0, 20, 1 << 18])
def test_alignment_equals_plain(spark, heavy):
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 1500").limit(30).collect()]
    texts = TEXTS + [(100 + i, t) for i, t in enumerate(prose)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).withColumns(clashes())
    got = token_alignment.align_tokens(table, heavy=heavy).collect()
    assert sorted(map(tuple, got), key=repr) == plain_alignment(texts)


def test_alignment_of_nothing(spark):
    assert token_alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text(spark):
    text = " ".join(f"word{i % 997} of{i}" for i in range(60_000))
    row = token_alignment.align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_links == row.n_a + row.n_b - row.n_groups > 100_000


def test_align_any_ends():
    r = random.Random(3)
    for _ in range(400):
        size = r.randint(1, 60)
        a, b = (sorted({*r.sample(range(1, size + 1), r.randint(0, size)), size}) for _ in range(2))
        ends_a, ends_b, link_a, link_b = (x.tolist() for x in token_alignment.align(np.array(a), np.array(b)))
        assert [a[i - 1] for i in ends_a] == [b[j - 1] for j in ends_b] == sorted({*a} & {*b})
        pairs = {
            (i, j) for i in range(len(a)) for j in range(len(b))
            if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]
        }
        assert len(link_a) == len(pairs) and set(zip(link_a, link_b, strict=True)) == pairs
