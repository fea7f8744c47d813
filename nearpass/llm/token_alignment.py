"""Alignment of the tokens that two public tokenizers cut the same text into.

Both token sequences are arrays of byte offsets at which tokens end.  The
alignment walks along the diagonal of the current index shift: exponential
probing compares growing stretches of the two arrays, and a stretch of tokens
that end together, one to one, is passed by as a whole.  Where ends differ, the
irregular group is resolved token by token up to the next common end, and the
shift is updated.

A link is a pair of token occurrences whose bytes overlap.  Links are counted
by pair of ids over the whole corpus.  The counts of the most frequent pairs, at
most HEAVY of them, go to all tasks as sorted arrays; documents send only their
other pairs through a shuffle, and none of those is frequent.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import slices
from nearpass.llm.work import Work

HEAVY = 1 << 18  # pairs whose counts every task holds
SHIFT = 32  # a pair is id of A << SHIFT | id of B
MOST_ID = 99_999
PROBE = 32  # bytes of the first probe, four for an end
FLUSH = 1 << 21  # pairs that a task counts before it passes them on


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of a text, and the bytes of all ids one after another, with their places and numbers."""

    ids: Callable[[str], np.ndarray]
    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def spells(self, ids: np.ndarray, ends: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens, which end at `ends`, give the text back."""
        if int(ends[-1]) != len(raw):
            return False
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - ends + sizes, sizes)
        at += np.arange(len(raw), dtype=np.int32)
        return bool((self.letters[at] == np.frombuffer(raw, np.uint8)).all())


def _side(ids: Callable[[str], np.ndarray], parts: list[bytes]) -> Side:
    sizes = np.array([len(x) for x in parts], np.int32)
    return Side(ids, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes, dtype=np.int32) - sizes, sizes)


@lru_cache(maxsize=2)
def tokenizers(folder: str | None) -> tuple[Side, Side]:
    """A, which tokenises a space and the text, and B, which tokenises the text.

    A's vocabulary is read through `tiktoken`, which gives the ids that
    `tokenizers` gives for it with special tokens as plain text, and several
    times as fast; what it cannot take goes through `tokenizers`.
    """
    import public_tokenizers as public
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    where = (lambda name: f"{folder}/{name}") if folder else public.path
    with open(where("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a_parts = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        a_parts[rank] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=where("piece_bpe_32k.model"))
    b_parts = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        b_parts.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    exact: list[Tokenizer] = []

    def a_ids(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(" " + text), np.int64)
        except BaseException as error:  # the library reports a failed pattern as a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if not exact:
            exact.append(Tokenizer.from_file(where("byte_bpe_50k.json")))
            exact[0].encode_special_tokens = True
        return np.array(exact[0].encode(" " + text, add_special_tokens=False).ids, np.int64)

    def b_ids(text: str) -> np.ndarray:
        return np.array(pieces.encode(text, num_threads=1), np.int64)

    return _side(a_ids, a_parts), _side(b_ids, b_parts)


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two ascending arrays of ends with the same last one.

    The first two arrays say how many tokens of each side end with each group;
    the other two name the tokens of each link, in no order.
    """
    n = len(a)
    # Stretches are compared as bytes, four for an end.
    flat_a, flat_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
    left, right = memoryview(flat_a).cast("I"), memoryview(flat_b).cast("I")
    number = int.from_bytes
    i = j = 0
    starts_a, starts_b, lengths = [], [], []  # of the stretches
    ends_a, ends_b, link_a, link_b = [], [], [], []  # of the other groups
    while i < n:
        # At the shift j - i: double the probe while it holds; where it fails, its lowest unequal bit tells the place.
        at_a, at_b, step = 4 * i, 4 * j, PROBE
        while True:
            u, v = flat_a[at_a : at_a + step], flat_b[at_b : at_b + step]
            if u != v or not u:
                break
            at_a += step
            at_b += step
            step += step
        at_a, at_b = min(at_a, 4 * n), min(at_b, len(flat_b))
        if u:
            size = min(len(u), len(v))
            odd = number(u[:size], "little") ^ number(v[:size], "little")
            at_a += 4 * (((odd & -odd).bit_length() - 1) >> 5) if odd else size
        length = (at_a >> 2) - i
        if length:
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(length)
            i += length
            j += length
            if i == n:
                break
        # A group that is not one to one, up to the next common end.
        x, y = left[i], right[j]
        while True:
            link_a.append(i)
            link_b.append(j)
            if x < y:
                i += 1
                x = left[i]
            elif y < x:
                j += 1
                y = right[j]
            else:
                break
        i += 1
        j += 1
        ends_a.append(i)
        ends_b.append(j)
    count = np.array(lengths, np.int64)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    run_a, run_b = (np.repeat(np.array(x, np.int64), count) + inside for x in (starts_a, starts_b))
    # Both sides' ends ascend from group to group, so sorting keeps them paired.
    groups = (np.sort(np.concatenate([run + 1, np.array(x, np.int64)])) for run, x in ((run_a, ends_a), (run_b, ends_b)))
    links = (np.concatenate([run, np.array(x, np.int64)]) for run, x in ((run_a, link_a), (run_b, link_b)))
    return *groups, *links


@lru_cache(maxsize=1)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers up to `most`, a place for what follows, and which of these places are in use."""
    digits = len(str(most))
    number = np.arange(most + 1)[:, None]
    powers = 10 ** np.arange(digits - 1, -1, -1)
    cells = np.zeros((most + 1, digits + 1), np.uint8)
    cells[:, :digits] = number // powers % 10 + ord("0")
    shown = np.ones((most + 1, digits + 1), bool)
    shown[:, : digits - 1] = number >= powers[:-1]
    return cells, shown


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: decimal ids of A and of B, group by group."""
    before_a, before_b = (np.concatenate([[0], x[:-1]]) for x in (ends_a, ends_b))
    at_a = np.arange(len(ids_a)) + np.repeat(before_b, ends_a - before_a)
    at_b = np.arange(len(ids_b)) + np.repeat(ends_a, ends_b - before_b)
    ids = np.empty(len(at_a) + len(at_b), np.int64)
    ids[at_a], ids[at_b] = ids_a, ids_b
    digits, shown = _decimals(MOST_ID)
    cells = digits[ids]
    cells[:, -1] = ord(",")
    cells[at_a[ends_a - 1], -1] = ord("|")
    cells[at_b[ends_b - 1], -1] = ord(";")
    return cells[shown[ids]][:-1].tobytes()


def _aligned(folder: str | None):
    """Each text's figures, the distinct pairs of its links and how often it has each."""
    schema = pa.schema(
        [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
         ("pairs", pa.binary()), ("times", pa.binary())]
    )

    def one(text: str, side_a: Side, side_b: Side) -> tuple:
        nothing = (0, 0, 0, 0, "", b"", b"")
        if not text:
            return nothing
        raw = (" " + text).encode()
        ids_a, ids_b = side_a.ids(text), side_b.ids(text)
        a, b = (np.cumsum(side.sizes[ids], dtype=np.int32) for side, ids in ((side_a, ids_a), (side_b, ids_b)))
        if not len(a) or not len(b) or not side_a.spells(ids_a, a, raw) or not side_b.spells(ids_b, b, raw):
            return nothing
        ends_a, ends_b, link_a, link_b = align(a, b)
        digest = hashlib.sha256(groups_text(ids_a, ids_b, ends_a, ends_b)).hexdigest()
        pairs, times = np.unique(ids_a[link_a] << SHIFT | ids_b[link_b], return_counts=True)
        figures = (len(ids_a), len(ids_b), len(ends_a), len(link_a), digest)
        return (*figures, pairs.astype("<i8").tobytes(), times.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokenizers(folder)
        for whole in batches:
            for begin, end, _, _ in slices(whole.column("text"), 2 << 20):
                batch = whole.slice(begin, end - begin)
                rows = [one(text, side_a, side_b) for text in batch.column("text").to_pylist()]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *schema.names])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and times of all rows of a batch, and the place of each one's row."""
    pairs = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("pairs")]
    times = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("times")]
    at = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    return np.concatenate(pairs), np.concatenate(times).astype(np.int64), at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a task's documents, added up as far as FLUSH distinct ones allow."""

    def added(held: list) -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate([t for _, t in held])).astype(np.int64)

    def batch_of(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            pairs, times, _ = _flat(batch.slice(start, 100))
            held.append((pairs, times))
            size += len(pairs)
            if size >= FLUSH:
                held = [added(held)]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
    if held:
        yield batch_of(*added(held))


def _weighed(heavy: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Sums over a document's frequent pairs, and the list of its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                pairs, times, row = _flat(batch)
                at = np.minimum(np.searchsorted(heavy, pairs), max(len(heavy) - 1, 0))
                known = heavy[at] == pairs if len(heavy) else np.zeros(len(pairs), bool)
                n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                np.add.at(n_best, row[known], times[known] * best[at[known]])
                np.add.at(total, row[known], times[known] * counts[at[known]])
                rest = np.bincount(row[~known], minlength=batch.num_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(n_best), pa.array(total), *lists], ["row", "n_best", "count_sum", "pair", "n"]
                )

    return run


def align_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str | None = None, heavy: int = HEAVY
) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary over a space and the text, B the one of
    pieces over the text; `tokenizers` is the folder of their files, by default
    the installed ones.  Groups end where a token of each side ends.  The count of
    a pair of ids is the number of links of all documents that hold it; n_best
    counts the links whose count is the highest of their B id, count_sum adds up
    the counts of all links.

    Null and empty texts, and texts that the joined tokens of one side do not
    give back, have no tokens: zeros, and an empty digest.  Repeated rows count
    each for itself.  A null key stays null.  Other columns are not read.  An
    empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    )
    aligned = rows.mapInArrow(_aligned(tokenizers), schema).withColumn("row", F.monotonically_increasing_id())
    aligned = work.save(aligned)
    counts = aligned.select("pairs", "times").mapInArrow(_counted, "pair bigint, n bigint")
    counts = work.save(counts.groupBy("pair").agg(F.sum("n").alias("n")))
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row per id of B
    judged = counts.withColumn("b", b_id).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    judged = work.save(judged)
    # The frequent pairs: those of the highest powers of two that hold at most `heavy` pairs together.
    sizes = judged.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()  # 64 rows
    least, held = 64, 0
    for r in sorted(sizes, reverse=True):
        held += r.pairs
        if held > heavy:
            break
        least = r.power
    frequent = F.floor(F.log2("n")) >= least
    top = judged.filter(frequent).orderBy("pair").toArrow() if least < 64 else judged.limit(0).toArrow()
    arrays = (top.column(c).to_numpy() for c in ("pair", "n", "best"))
    weighed = aligned.select("row", "pairs", "times").mapInArrow(
        _weighed(*(x.astype(np.int64) for x in arrays)), "row bigint, n_best bigint, count_sum bigint, pair array<bigint>, n array<bigint>"
    )
    weighed = work.save(weighed)
    others = weighed.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select("row", "x.pair", F.col("x.n").alias("times"))
    others = others.join(judged.filter(~frequent), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more")
    )
    sums = weighed.select("row", "n_best", "count_sum").join(others, "row", "left").select(
        "row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
    )
    result = aligned.select("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row")
    return result.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
