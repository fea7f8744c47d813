"""The registered queries against brute force, exact round trips and held-out labels on a small folder of tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nearpass.llm import cap_filters, positional_index, suffix_dedup, tokens
from nearpass.llm.queries import QUERIES
from nearpass.llm.work import Work


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Groups(dict):
    def find(self, x):
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingle_groups(docs, words, percent):
    sets = {}
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[k] = {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    holders, groups = defaultdict(list), Groups({k: k for k in sets})
    for k in sorted(sets):
        common = Counter(j for s in sets[k] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[j]) + len(sets[k]) - n):
                groups.join(j, k)
        for s in sets[k]:
            holders[s].append(k)
    return sets, groups


def removed(rows, size):
    """(n_bytes, n_removed, n_spans, digest, kept bytes) of each text."""
    octets = {k: t.encode() for k, t in rows.items()}
    seen = Counter(b[i : i + size] for b in octets.values() for i in range(len(b) - size + 1))
    out = {}
    for k, b in octets.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        spans = int((gone[1:] < gone[:-1]).sum())
        out[k] = len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept
    return out


def contaminated(docs, items):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].add(str(i))
    out = {}
    for k, t in docs.items():
        w, hit, found = word(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[k] = len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)
    return out


def test_op9(spark, small, docs):
    sets, groups = shingle_groups(docs, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_jaccard_join"](spark, small).collect()}
    assert got == {k: (len(sets[k]), groups.find(k)) for k in docs}


def test_op4(spark, small, docs):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, small).collect()}
    assert got == {k: v[:4] for k, v in removed(docs, 200).items()}


def test_repeats_of_planted_passages(spark):
    random.seed(3)
    word = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(random.choice(word) for _ in range(n))
    passages, base = [make(60) for _ in range(5)], make(300).split()
    rows = {0: "", 1: "a" * 3000, 2: "ab" * 700}
    for i in range(3, 60):
        t = make(random.randint(5, 80))
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            cut = random.randint(0, len(p) // 2)
            t += p[cut : cut + random.randint(100, len(p))] + make(random.randint(0, 30))
        if i % 5 == 0:
            copy = list(base)
            copy[random.randrange(len(copy))] = "X"
            t = " ".join(copy)
        rows[i] = t
    rows[60] = make(90_000) + passages[0]
    rows[61] = rows[60][300_000:400_000] + "q"
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table).collect()}
    assert got == {k: v[:4] for k, v in removed(rows, 200).items()}


def test_op6(spark, small, docs):
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_decontamination"](spark, small).collect()}
    assert got == contaminated(docs, items)


def test_token_ids_equal_the_other_library():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tokens.encoder(None)
    random.seed(1)
    texts = ["", " ", "\n\n  x", "a <|endoftext|> b", " " * 3000 + "y", "x" * 5000, "it's 12345 ½ ² 　漢字🎉\r\n\t "]
    texts += ["".join(chr(random.choice([*range(32, 127), 9, 10, 0xE9, 0x3B1, 0x4E00, 0x1F600, 0xA0])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_op10(spark, small, docs):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op10_pattern_packing"](spark, small).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for k, t in docs.items():
        ids, edge = exact.encode(t, add_special_tokens=False).ids + [0], 0
        for n, r in enumerate(sorted(pieces[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, edge)
            part = ids[edge : edge + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r.length
            assert n == 0 or r.length == 2048
            edge += r.length
        assert edge == len(ids)
    for parts in places.values():
        edge = 0
        for offset, length in sorted(parts):
            assert offset == edge
            edge += length
        assert edge <= 2048
    total = sum(n for parts in places.values() for _, n in parts)
    assert len(places) <= 1.01 * total / 2048 + 1


def test_op7(spark, small, docs):
    rows = QUERIES["op7_token_rows"](spark, small).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.length for r in QUERIES["op10_pattern_packing"](spark, small).collect())
    assert all(r.cu_seqlens[0] == 0 and r.cu_seqlens == sorted(r.cu_seqlens) and r.n_tokens <= 2048 for r in rows)
    for r in rows:
        place = np.concatenate([np.arange(b - a) for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True)])
        assert r.positions_crc32 == zlib.crc32(place.astype("<u4").tobytes())


def test_op5_recall(spark):
    random_ = np.random.RandomState(4)
    centres = random_.randn(60, 64)
    vectors = np.concatenate([c + 0.17 * random_.randn(20, 64) for c in centres] + [random_.randn(800, 64)]).astype(np.float32)
    labels = np.arange(len(vectors)) // 20 % 3
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, labels, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in cap_filters.near_vectors(table).collect()}
    found = np.array([got[i] for i in range(len(vectors))])
    assert (found <= near.sum(axis=1)).all()
    assert near.sum() > 1000 and found.sum() >= 0.995 * near.sum()


def test_op3_held_out(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(held) >= 0.85 * len(held)


def test_op1(spark, small):
    rows = QUERIES["op1_language_id"](spark, small).collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    right = [r.language == known[r.doc_id] for r in rows if r.doc_id is not None]
    assert len(right) == len(known) and sum(right) >= 0.98 * len(right)
    pages = [r for r in rows if r.page_id is not None]
    assert sum(r.language == r.declared for r in pages) >= 0.95 * len(pages)


def test_pipeline(spark, small, docs):
    import corpus_pipeline

    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {k: t for k, t in docs.items() if re.search(r"[^\W\d_]", t)}
    table, columns = spark.read.parquet(f"{small}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        columns = table.columns
        table = Work(spark, passing=False).save(stage(spark, table, small))
        if name == "jaccard_join":
            _, groups = shingle_groups(left, 5, 80)
            left = {k: t for k, t in left.items() if groups.find(k) == k}
        elif name == "suffix_dedup":
            cut = removed(left, 200)
            left = {k: cut[k][4].decode(errors="ignore") if cut[k][1] else t for k, t in left.items()}
            left = {k: t for k, t in left.items() if t.strip(" ") or not cut[k][1]}
        elif name == "decontamination":
            judged = contaminated(left, items)
            left = {k: t for k, t in left.items() if not judged[k][4]}
        if name != "pattern_packing":
            assert table.columns == columns
            assert {r.doc_id: r.text for r in table.collect()} == left, name
    assert {r.doc_id for r in table.collect()} == set(left)
    assert positional_index.GAP > 13
