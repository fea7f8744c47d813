"""Codes of vectors by one small codebook for each of their equal parts.

Components become integers, floor(SCALE * x), and all later steps are exact.
A task cuts its vectors into segments.  In a segment, and for each part
position, the parts are sorted along a Hilbert curve and cut into flat blocks;
a block stores its points, the corners of the box around them and the sums of
their components.  The blocks are written once, and every round reads them:

* The distances of a codebook's entries to a block's box, at least and at most,
  leave a shortlist of entries that can be the nearest to any of its points.
* With one entry on the shortlist, the stored sums are all the block has to
  add.  Otherwise its points are compared with the entries of the shortlist,
  in integers.

A round sends to the driver at most one row for each entry.  Segments are never
compared with each other, so nothing but those sums is shuffled before the
codes of the last round are put together by segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.work import Work

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
POINTS = 128  # of a block
SEGMENT = 4 << 20  # components of the vectors that one segment sorts, about
MOST = 1 << 24  # integers are kept in -MOST .. MOST, so that all sums of squares fit 64 bits


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place of each point along a Hilbert curve through the grid over all of them."""
    points = points[:, :62]
    n, width = points.shape
    bits = min(16, 62 // width)
    low = points.min(axis=0)
    span = int((points.max(axis=0) - low).max())
    x = ((points - low) >> max(span.bit_length() - bits, 0)).astype(np.int64).T.copy()
    # Undo excess work from the highest bit down, then Gray-encode: axes to transposed index.
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(width):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, width):
        x[i] ^= x[i - 1]
    last = np.zeros(n, np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        last ^= np.where((x[width - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= last
    place = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(width):
            place = place << 1 | (x[i] >> b & 1)
    return place


def _blocks(width: int):
    """Segments of a task: a row with the keys, and the rows of the blocks of all part positions."""
    names = ["place", "part", "low", "high", "sums", "points", "rows", "keys", "labels"]

    def cut(place: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        values = whole.column("whole").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = values.astype(np.int64).reshape(whole.num_rows, PARTS, width)
        keys, labels = ([whole.column(c).combine_chunks()] for c in ("id", "label"))
        yield _segment_row(place, keys[0], labels[0])
        for part in range(PARTS):
            points = values[:, part]
            order = np.argsort(hilbert(points), kind="stable")
            rows = []
            for start in range(0, len(order), POINTS):
                at = order[start : start + POINTS]
                block = points[at]
                rows.append(
                    (place, part, block.min(axis=0).tolist(), block.max(axis=0).tolist(), block.sum(axis=0).tolist(),
                     block.astype("<i4").tobytes(), at.astype("<i4").tobytes())
                )
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            nothing = [pa.nulls(len(rows), pa.list_(column[0].type)) for column in (keys, labels)]
            yield pa.RecordBatch.from_arrays([*arrays, *nothing], names)

    def _segment_row(place: int, keys: pa.Array, labels: pa.Array) -> pa.RecordBatch:
        kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 2
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (keys, labels)]
        return pa.RecordBatch.from_arrays(
            [pa.array([place], pa.int64()), pa.array([-1], pa.int32()), *(pa.nulls(1, k) for k in kinds), *lists], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows * PARTS * width
            if size >= SEGMENT:
                yield from cut(place, held)
                held, size, place = [], 0, place + 1
        if held:
            yield from cut(place, held)

    return run


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """For each box (row), which entries can be the nearest to a point in it, ties included."""
    below = np.maximum(low[:, None] - entries[None], 0)
    above = np.maximum(entries[None] - high[:, None], 0)
    least = (np.maximum(below, above) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(entries[None] - low[:, None]), np.abs(high[:, None] - entries[None])) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest entry and its squared distance; of equally near ones the first."""
    distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(points)), best]


def _boxes(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Block rows of a batch by part position: position, row numbers, low and high corners."""
    part = batch.column("part").to_numpy()
    sides = [batch.column(c).flatten().to_numpy().reshape(-1, width) for c in ("low", "high")]
    for position in np.unique(part).tolist():
        rows = np.flatnonzero(part == position)
        yield position, rows, sides[0][rows], sides[1][rows]


def _sums(books: np.ndarray):
    """What each entry gets in a round: number and component sums of its parts, one row per entry and task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            data, sums = batch.column("points"), batch.column("sums")
            for part, rows, low, high in _boxes(batch, width):
                for row, able in zip(rows.tolist(), shortlist(low, high, books[part]), strict=True):
                    listed = np.flatnonzero(able)
                    if len(listed) == 1:
                        number[part, listed[0]] += len(data[row].as_buffer()) // (4 * width)
                        total[part, listed[0]] += sums[row].values.to_numpy()
                        continue
                    points = np.frombuffer(data[row].as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                    best, _ = nearest(points, books[part][listed])
                    of = listed[best]
                    number[part] += np.bincount(of, minlength=entries)
                    np.add.at(total[part], of, points)
        part, entry = np.nonzero(number)
        if len(part):
            flat = pa.array(total[part, entry].reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)
            columns = [pa.array(part), pa.array(entry), pa.array(number[part, entry]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    return run


def _coded(books: np.ndarray):
    """Entry and error of every point, block by block."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("points")
            codes: list[bytes] = [b""] * batch.num_rows
            errors: list[bytes] = [b""] * batch.num_rows
            for part, rows, low, high in _boxes(batch, width):
                for row, able in zip(rows.tolist(), shortlist(low, high, books[part]), strict=True):
                    listed = np.flatnonzero(able)
                    points = np.frombuffer(data[row].as_buffer(), "<i4").reshape(-1, width).astype(np.int64)
                    best, distance = nearest(points, books[part][listed])
                    codes[row] = listed[best].astype(np.uint8).tobytes()
                    errors[row] = distance.astype("<i8").tobytes()
            columns = [batch.column("place"), batch.column("part"), batch.column("rows")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(codes, pa.binary()), pa.array(errors, pa.binary())],
                ["place", "part", "rows", "codes", "errors"],
            )

    return run


def _joined(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Keys, codes and errors of one segment."""
    keys, labels = (left.column(c).combine_chunks().flatten() for c in ("keys", "labels"))
    codes, errors = np.zeros((len(keys), PARTS), np.uint8), np.zeros(len(keys), np.int64)
    columns = (right.column(c).to_pylist() for c in ("part", "rows", "codes", "errors"))
    for part, rows, code, error in zip(*columns, strict=True):
        at = np.frombuffer(rows, "<i4")
        codes[at, part] = np.frombuffer(code, np.uint8)
        errors[at] += np.frombuffer(error, "<i8")
    text = codes.tobytes().hex()
    names = [text[i * 2 * PARTS : (i + 1) * 2 * PARTS] for i in range(len(keys))]
    return pa.table({"id": keys, "label": labels, "code": pa.array(names, pa.string()), "error": errors})


def integers(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, whole): components as integers; vectors that cannot be cut or hold null or non-finite components go."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0) & F.forall(
        values, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))
    )

    def whole(x):
        return F.greatest(F.least(F.floor(F.least(F.greatest(x, F.lit(-1e6)), F.lit(1e6)) * SCALE), F.lit(MOST)), F.lit(-MOST))

    return rows.filter(F.coalesce(usable, F.lit(False))).select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.transform(values, whole).alias("whole")
    )


def encode_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """Codes, and the final codebooks as integers of shape (PARTS, entries, width).

    The codes are one row per vector: key, code, error, label_error.  Codebooks
    start as the parts of the ENTRIES smallest keys (nulls last; rows of one key
    in the order of their components, each an entry of its own) and are updated
    ROUNDS times; of equally near entries the first counts, and an entry without
    parts stays.  `label_error` is the sum of `error` over equal labels, nulls
    together.

    Left out are vectors that are null, hold null or non-finite components,
    have a length of 0 or no multiple of PARTS, or another one than the vector
    of the smallest key among the rest.  Components beyond +-65,536 count as
    that; a `label_error` beyond 64 bits is null.  Repeated rows are coded each
    for itself.  Other columns are not read.  Without any vector left the table
    is empty, and so are the codebooks.
    """
    work = Work(rows.sparkSession)
    every = integers(rows, key, vector, label)
    start = every.orderBy(F.col("id").asc_nulls_last(), "whole").limit(ENTRIES)
    first = start.collect()  # ENTRIES vectors
    kinds = [f"`{n}` {every.schema[c].dataType.simpleString()}" for n, c in ((key, "id"), ("label", "label"))]
    if not first:
        schema = f"{kinds[0]}, code string, error bigint, label_error bigint"
        return rows.sparkSession.createDataFrame([], schema), np.zeros((PARTS, 0, 0), np.int64)
    length = len(first[0].whole)
    if any(len(r.whole) != length for r in first):
        first = every.filter(F.size("whole") == length).orderBy(F.col("id").asc_nulls_last(), "whole").limit(ENTRIES).collect()
    width = length // PARTS
    books = np.array([r.whole for r in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()

    id_kind, label_kind = (every.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = (
        "place bigint, part int, low array<bigint>, high array<bigint>, sums array<bigint>, points binary, rows binary,"
        f" keys array<{id_kind}>, labels array<{label_kind}>"
    )
    blocks = work.save(every.filter(F.size("whole") == length).mapInArrow(_blocks(width), schema))
    boxes = blocks.filter("part >= 0").select("place", "part", "low", "high", "sums", "points", "rows")
    for _ in range(ROUNDS):
        found = boxes.mapInArrow(_sums(books), "part bigint, entry bigint, n bigint, total array<bigint>")
        added = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row per entry
            books[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
    codes = boxes.mapInArrow(_coded(books), "place bigint, part int, rows binary, codes binary, errors binary")
    keys = blocks.filter("part = -1").select("place", "keys", "labels")
    joined = keys.groupBy("place").cogroup(codes.groupBy("place")).applyInArrow(
        _joined, f"id {id_kind}, label {label_kind}, code string, error bigint"
    )
    joined = work.save(joined)
    sums = joined.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    named = joined.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return named.select(F.col("id").alias(key), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_digests(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The codes with the digest of the final codebooks on every row."""
    codes, books = encode_vectors(rows, key, vector, label)
    return codes.withColumn("codebooks_sha256", F.lit(books_digest(books)))
