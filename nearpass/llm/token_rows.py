"""Token-id rows for training: best-fit-decreasing packing into matrices of fixed width.

Documents are tokenised and packed in groups of about GROUP_TOKENS ids, each by
one task without a shuffle.  Inside a group the pieces go, longest first, to
the row with the least free space that suffices; a segment tree over the
possible amounts of free space finds it.  A row is written as its ids, the
cumulative lengths of its segments, and for each id its position in its segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import slices
from nearpass.llm.tokens import encoder
from nearpass.llm.work import Work

GROUP_TOKENS = 1 << 20
PAD = 0


class FreeSpace:
    """Segment tree over amounts of free space: the least one, of at least so much, that some row has."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, amount: int, rows: int) -> None:
        at = amount + self.leaves
        while at:
            self.count[at] += rows
            at >>= 1

    def least(self, amount: int) -> int | None:
        at = amount + self.leaves
        if self.count[at]:
            return amount
        while at > 1:  # up to the first right-hand neighbour that is not empty, then down its left side
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: np.ndarray, width: int) -> list[list[int]]:
    """Pieces of each row, longest piece first; equal lengths in their order."""
    space, rows, at = FreeSpace(width), [], {}
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        free = space.least(length)
        if free is None:
            free, row = width, len(rows)
            rows.append([])
        else:
            row = at[free].pop()
            space.add(free, -1)
        rows[row].append(piece)
        at.setdefault(free - length, []).append(row)
        space.add(free - length, 1)
    return rows


def _pack_group(ids: list[np.ndarray], owners: list, width: int, group: int) -> pa.RecordBatch:
    pieces = [(i, a, x[a : a + width]) for i, x in enumerate(ids) for a in range(0, len(x), width)]
    rows = best_fit(np.array([len(x) for _, _, x in pieces]), width)
    out: dict[str, list] = {c: [] for c in ("group", "row", "doc_ids", "starts", "cu_seqlens", "ids", "positions")}
    for k, members in enumerate(rows):
        parts = [pieces[m] for m in members]
        flat = np.full(width, PAD, "<u4")
        place = np.zeros(width, "<u4")
        edge = 0
        edges = [0]
        for _, _, x in parts:
            flat[edge : edge + len(x)] = x
            place[edge : edge + len(x)] = np.arange(len(x))
            edge += len(x)
            edges.append(edge)
        out["group"].append(group)
        out["row"].append(k)
        out["doc_ids"].append([owners[i] for i, _, _ in parts])
        out["starts"].append([a for _, a, _ in parts])
        out["cu_seqlens"].append(edges)
        out["ids"].append(flat.tobytes())
        out["positions"].append(place.tobytes())
    return out


def _rows(width: int, folder: str | None, kind: pa.DataType):
    schema = pa.schema(
        [("group", pa.int64()), ("row", pa.int32()), ("doc_ids", pa.list_(kind)), ("starts", pa.list_(pa.int64())),
         ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, ids, owners, held, group = encoder(folder), [], [], 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            out = _pack_group(ids, owners, width, group)
            yield from pa.Table.from_pydict(out, schema=schema).to_batches(max_chunksize=256)

        for whole in batches:
            for begin, end, _, _ in slices(whole.column("text"), 1 << 20):
                keys = whole.column("id").slice(begin, end - begin).to_pylist()
                for key, text in zip(keys, whole.column("text").slice(begin, end - begin).to_pylist(), strict=True):
                    x = np.append(ids_of(text), np.uint32(0))
                    ids.append(x)
                    owners.append(key)
                    held += len(x)
                    if held >= GROUP_TOKENS:
                        yield from packed()
                        ids, owners, held, group = [], [], 0, group + 1
        if ids:
            yield from packed()

    return run


def token_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2048, tokenizers: str | None = None
) -> DataFrame:
    """Packed rows: group, row, doc_ids, starts, cu_seqlens, ids, positions.

    A document is its ids and a closing 0; longer ones than a row are split and
    nothing of them is lost: `starts` has each segment's place in its document.
    `ids` and `positions` are little-endian unsigned 32-bit vectors of `width`
    entries; behind the last of `cu_seqlens` they are filled with 0.  Positions
    start anew at 0 in every segment.  `group` and `row` number the rows of one
    task's part of the table.

    Null and empty texts are the closing id alone.  Repeated rows are packed
    each for itself; a null key stays null.  Other columns are not read.  An
    empty table gives no rows.
    """
    Work(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (
        f"group bigint, row int, doc_ids array<{kind.simpleString()}>, starts array<bigint>, cu_seqlens array<int>, "
        "ids binary, positions binary"
    )
    return rows.mapInArrow(_rows(width, tokenizers, to_arrow_type(kind)), schema)


def write_token_rows(docs: DataFrame, path: str, **options) -> None:
    """The packed rows as Parquet files; each file holds the matrix rows of one task."""
    token_rows(docs, **options).write.option("compression", "zstd").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """Written rows without their vectors: segments, tokens, and crc32 of ids and positions."""
    used = F.element_at("cu_seqlens", -1)
    return rows.select(
        "doc_ids", "starts", "cu_seqlens", used.cast("bigint").alias("n_tokens"),
        F.crc32(F.substring("ids", F.lit(1), used * 4)).alias("ids_crc32"),
        F.crc32(F.substring("positions", F.lit(1), used * 4)).alias("positions_crc32"),
    )
