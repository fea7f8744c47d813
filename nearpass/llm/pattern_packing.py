"""Packing of token sequences by patterns of lengths and non-negative least squares.

The work on lengths is done on their histogram, which has as many bins as a
sequence has tokens.  Patterns of two and three lengths that fill a sequence
exactly are enumerated; their repeat counts are fitted to the histogram by
non-negative least squares (multiplicative updates), rounded down within what
the histogram has, and the residual counts are packed best-fit-decreasing, all
documents of one length and all sequences with one content at a time.  The plan
is a table of patterns and repeats whose size depends on the sequence length
alone; documents find their places by their number within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import slices
from nearpass.llm.tokens import encoder
from nearpass.llm.work import Work, salted_rank

THIRDS = 48  # lengths that may be the shortest of three
ROUNDS = 60
PART = 200_000  # documents of one length that one task numbers


def patterns(size: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to `size`."""
    pairs = np.arange(1, size // 2 + 1)
    rows = [np.stack([np.zeros_like(pairs), pairs, size - pairs], axis=1)]
    for a in sorted({max(1, round(size / 3 * (k + 1) / THIRDS)) for k in range(THIRDS)}):
        b = np.arange(a, (size - a) // 2 + 1)
        rows.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate(rows)


def fit(table: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that make the lengths used by the patterns come near the histogram."""
    weight = (table > 0).astype(float)
    target = histogram.astype(float)
    possible = np.where(table > 0, target[table], np.inf).min(axis=1) > 0
    x = possible.astype(float)
    wanted = (target[table] * weight).sum(axis=1)
    for _ in range(ROUNDS):
        used = np.zeros(len(target))
        for k in range(3):
            used += np.bincount(table[:, k], x * weight[:, k], len(target))
        x *= wanted / np.maximum((used[table] * weight).sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every length exactly as often as the histogram has it."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    result = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    table = patterns(size)
    x = np.floor(fit(table, left) + 1e-9).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if x[i] == 0:
            break
        lengths, times = np.unique(table[i][table[i] > 0], return_counts=True)
        n = int(min(x[i], (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            result.append((tuple(int(v) for v in table[i] if v), n))
    # Best fit decreasing, with all sequences of one content as one entry.
    rooms: list[int] = []  # sorted free places that occur
    open_: dict[int, list[list]] = {}

    def put(content: tuple[int, ...], room: int, n: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append([content, n])

    for length in range(size - 1, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fits = size // length
                if n >= fits:
                    put((length,) * fits, size - fits * length, n // fits)
                if n % fits:
                    put((length,) * (n % fits), size - n % fits * length, 1)
                break
            room = rooms[at]
            content, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fits = min(room // length, n)
            taken = min(count, n // fits)
            put(content + (length,) * fits, room - fits * length, taken)
            if count > taken:
                put(content, room, count - taken)
            n -= taken * fits
    result += [(content, n) for entries in open_.values() for content, n in entries]
    return result


def _pieces(size: int, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(folder)
        for whole in batches:
            for begin, end, _, _ in slices(whole.column("text"), 4 << 20):
                batch = whole.slice(begin, end - begin)
                rows, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(ids_of(text), np.uint32(0))
                    first = (len(ids) - 1) % size + 1
                    edges = [0, *range(first, len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
                columns = [batch.column("id").take(pa.array(rows)), batch.column("mark").take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                    ["id", "mark", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _place(starts: np.ndarray, edges: np.ndarray, sequences: np.ndarray, offsets: np.ndarray):
    """Sequence and offset from length and number; each length's ranges of numbers lie at edges[starts[length]:]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            at = np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                rows = length == one
                part = edges[starts[one] : starts[one + 1]]
                at[rows] = starts[one] + np.searchsorted(part, number[rows], side="right") - 1
            columns = [*batch.columns, pa.array(sequences[at] + number - edges[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048, tokenizers: str | None = None
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and a closing 0.  Those of more than `size` ids
    are cut into pieces of `size`; the first piece may be shorter.  The places of
    a sequence are taken without gaps from 0.  `tokenizers` is the folder of the
    vocabulary files; by default the installed ones.

    Null and empty texts are the closing id alone.  Repeated rows are packed
    each for itself; a null key stays null.  Other columns are not read.  An
    empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("id", "text"))
    schema = f"id {kind}, mark bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint"
    pieces = work.save(rows.mapInArrow(_pieces(size, tokenizers), schema))
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in counted:
        histogram[r.length] = r.n
    uses: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size + 2)]  # per length: repeats, sequence, offset
    base = 0
    for content, n in plan(histogram):
        offset = 0
        for length in content:
            uses[length].append((n, base, offset))
            offset += length
        base += n
    starts, edges, sequences, offsets = [], [], [], []
    for ranges in uses:
        starts.append(len(edges))
        number = 0
        for n, sequence, offset in ranges:
            edges.append(number)
            sequences.append(sequence)
            offsets.append(offset)
            number += n
    arrays = [np.array(x, np.int64) for x in (starts, edges, sequences, offsets)]
    salts = max(1, -(-int(histogram.max()) // PART))
    numbered = salted_rank(pieces, ["length"], ["mark", "piece"], F.pmod("mark", F.lit(salts)), "number")
    columns = "id", "piece", "start", "length", "ids_crc32"
    schema = f"id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, number bigint, sequence_id bigint, offset bigint"
    placed = numbered.select(*columns, F.col("number").cast("bigint")).mapInArrow(_place(*arrays), schema)
    return placed.select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
