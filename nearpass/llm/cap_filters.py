"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to every filter whose direction it
comes near enough to, so near vectors share filters.  Near enough is: within a
margin of the best direction of the code, which gives every vector a similar
number of filters.  The directions are a
structured random product code: after a random rotation the coordinates are cut
into blocks, each with its own random code words, and a direction is one word
from each block.  A vector is list-decoded to all such directions, block by
block: combinations that the best words of the remaining blocks cannot lift
near enough are not followed.  Blocks, words and margin follow the number of
components and of vectors (`code_for`).

Vectors of one filter are compared by their cosine in double precision.  A pair
that links is counted in the first filter both belong to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.components import components
from nearpass.llm.work import Work

MEMBERS = 2048  # vectors of one filter that one task compares with as many
FEW = 48  # members of a filter up to which its pairs are made along with those of other filters
PAIRS = 20_000  # pairs that are asked for earlier filters at a time
BUCKET = 20_000  # rows of filters that are worked on together, about
USUAL = 10_000  # vectors of a label from which on a code has more words


@dataclass(frozen=True)
class Code:
    """How many blocks, words of a block and independent codes there are, and how near to the best direction counts."""

    blocks: int
    words: int
    codes: int
    margin: float


def code_for(dimension: int, number: int) -> Code:
    """The code for vectors of that many components, of which `number` have one label.

    A block needs some coordinates, so short vectors have fewer blocks.  With
    more vectors, words grow so that the number of directions follows them (the
    fourth power of words), and the margin shrinks so that a vector keeps to a
    few hundred filters at most.
    """
    if dimension < 8:
        return Code(1, 256, 3, 0.1)
    if dimension < 16:
        return Code(2, 48, 4, 0.06)
    growth = max(1.0, number / USUAL) ** 0.25
    margin = 0.04 * min(1.0, 64 / dimension) ** 0.5
    return Code(4, min(256, round(32 * growth)), 3 if growth == 1 else 4, margin * growth**-0.4)


@lru_cache(maxsize=8)
def directions(dimension: int, blocks: int, words: int, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation to the next multiple of `blocks` coordinates, and the distinct code words of each block."""
    random = np.random.RandomState(1000 + number)
    width = -(-dimension // blocks)
    turn, _ = np.linalg.qr(random.randn(width * blocks, width * blocks))
    drawn = [random.randn(words, width) for _ in range(blocks)]
    drawn = [np.unique(np.round(w / np.linalg.norm(w, axis=1, keepdims=True), 12), axis=0) for w in drawn]
    return turn[:, :dimension], [w / np.sqrt(blocks) for w in drawn]


def decode(unit: np.ndarray, code: Code) -> list[np.ndarray]:
    """Numbers of the filters of each unit vector, ascending."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(unit))]
    for number in range(code.codes):
        turn, words = directions(unit.shape[1], code.blocks, code.words, number)
        rotated = unit @ turn.T
        width = rotated.shape[1] // code.blocks
        scores = [rotated[:, b * width : (b + 1) * width] @ words[b].T for b in range(code.blocks)]
        rest = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]  # best of this and later blocks
        limit = rest[0] - code.margin
        row = np.arange(len(unit))
        total, name = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for b in range(code.blocks):
            ahead = rest[b + 1] if b + 1 < code.blocks else np.zeros(len(unit))
            step = total[:, None] + scores[b][row]
            keep, word = np.nonzero(step + ahead[row][:, None] >= limit[row][:, None])
            total, name, row = step[keep, word], name[keep] * code.words + word, row[keep]
        name += number * code.words**code.blocks
        for r, names in zip(*_split(row, name), strict=True):
            found[r].append(names)
    return [np.sort(np.concatenate(x)) for x in found]


def _split(row: np.ndarray, value: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(row, kind="stable")
    row, value = row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return row[first].tolist(), np.split(value, first[1:]) if len(first) else []


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _filters(most: int):
    """The filters of each vector; `most`: vectors of one label at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            sizes = np.array([len(v) for v in whole.column("vector").to_pylist()])
            for dimension in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dimension)
                for start in range(0, len(rows), 1000):
                    batch = whole.take(pa.array(rows[start : start + 1000]))
                    vectors = _vectors(batch.column("vector"))
                    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    names = decode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), code_for(dimension, most))
                    at = pa.array(np.repeat(np.arange(len(names)), [len(x) for x in names]))
                    columns = [batch.column(c).take(at) for c in ("node", "label")]
                    number = pa.array(np.concatenate(names))
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(np.full(len(at), dimension, np.int32)), number], ["node", "label", "d", "filter"]
                    )

    return run


def _met_before(offsets: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows have a number in common; row k has the distinct numbers offsets[k] to offsets[k + 1]."""
    met = np.zeros(len(left), bool)
    most = int(values.max()) + 1 if len(values) else 1
    for start in range(0, len(left), PAIRS):
        keys = []
        for rows in (left[start : start + PAIRS], right[start : start + PAIRS]):
            size = offsets[rows + 1] - offsets[rows]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            keys.append(np.repeat(np.arange(len(rows)) * most, size) + values[np.repeat(offsets[rows], size) + inside])
        both = np.sort(np.concatenate(keys))
        met[start + both[1:][both[1:] == both[:-1]] // most] = True
    return met


def _crowd_met(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for many pairs among few rows (places in `rows`), by one bit for each number that several of them have."""
    size = offsets[rows + 1] - offsets[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    _, column, held = np.unique(values[np.repeat(offsets[rows], size) + inside], return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 1
    edge = np.searchsorted(owner, np.arange(len(rows) + 1))
    bits = np.zeros((len(rows), -(-width // 8)), np.uint8)
    for i in range(len(rows)):
        line = np.zeros(width, bool)
        line[column[edge[i] : edge[i + 1]]] = True
        bits[i] = np.packbits(line)
    met = np.zeros(len(left), bool)
    step = max(1, (1 << 24) // bits.shape[1])
    for start in range(0, len(left), step):
        part = slice(start, start + step)
        met[part] = (bits[left[part]] & bits[right[part]]).any(axis=1)
    return met


def _links(group: np.ndarray, side: np.ndarray, unit: np.ndarray, lists: pa.ListArray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that link and that no earlier filter has; groups are runs of equal numbers.

    The cosine comes first; only pairs that link are asked for an earlier filter.
    """
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = np.unique(lists.values.to_numpy(), return_inverse=True)[1].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    end = np.repeat(first + size, size)
    few = np.repeat(size <= FEW, size)
    two = np.repeat(np.maximum.reduceat(side, first) == 1, size)  # two blocks of a crowded filter: pairs across them
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, int(size[size <= FEW].max(initial=0))):
        a = np.flatnonzero(few & (np.arange(len(group)) + step < end))
        a = a[~two[a] | (side[a] != side[a + step])]
        a = a[np.einsum("ij,ij->i", unit[a], unit[a + step]) >= cosine]
        left.append(a)
        right.append(a + step)
    a, b = np.concatenate(left), np.concatenate(right)
    fresh = ~_met_before(offsets, values, a, b)
    left, right = [a[fresh]], [b[fresh]]
    for start, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        rows = slice(start, start + n)
        mine, its = unit[rows], side[rows]
        found = []
        for at in range(0, n, 512):
            near = mine[at : at + 512] @ mine.T >= cosine
            if two[start]:
                near &= its[at : at + 512, None] != its[None, :]
            i, j = np.nonzero(near)
            ahead = i + at < j
            found.append((i[ahead] + at, j[ahead]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        fresh = ~_crowd_met(offsets, values, some + start, place[: len(a)], place[len(a) :]) if len(a) else np.zeros(0, bool)
        left.append(a[fresh] + start)
        right.append(b[fresh] + start)
    return np.concatenate(left), np.concatenate(right)


def _linked(cosine: float):
    """Links inside the groups of a bucket: for each vector of a group how many others, and the one that names its component there."""

    def inside(table: pa.Table, dimension: int) -> pa.Table:
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((label, table.column("group").to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        name, label = table.column("group").to_numpy(), label[order]
        group = np.cumsum(np.concatenate([[0], (name[1:] != name[:-1]) | (label[1:] != label[:-1])]))
        node, n, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dimension)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        lists = table.column("before").combine_chunks()
        lists = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), lists.flatten())
        left, right = _links(group, side, unit, lists, cosine)
        links, least = np.zeros(len(node), np.int64), np.arange(len(node))
        np.add.at(links, left, n[right])
        np.add.at(links, right, n[left])
        while True:  # the first row each one reaches
            before = least.copy()
            np.minimum.at(least, left, before[right])
            np.minimum.at(least, right, before[left])
            least = least[least]
            if (least == before).all():
                break
        kept = links > 0
        return pa.table({"node": node[kept], "least": node[least][kept], "links": links[kept]})

    def run(_key: tuple, bucket: pa.Table) -> pa.Table:
        size = bucket.column("d").to_numpy()
        parts = [inside(bucket.filter(pa.array(size == d)), d) for d in np.unique(size).tolist()]
        return pa.concat_tables(parts)

    return run


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors of one label link when the cosine of their double-precision values
    is at least `cosine`; `component_id` is the smallest key reachable by links.

    Null labels, null, empty or zero vectors, and vectors with a null or a
    non-finite component link with nothing and are components of their own, as
    are vectors of different length to each other.  Repeated rows are different
    vectors and link.  A null key forms no component of its own name.  Other
    columns are not read.  An empty table gives no rows.

    Filters find a linked pair with a probability that `code_for` sets (tests ask
    for 0.99 at the least cosine); equal vectors are always found.
    """
    work = Work(rows.sparkSession)
    whole = F.transform(vector, lambda x: x.cast("double"))
    usable = (
        F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
        & F.forall(whole, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
        & F.exists(whole, lambda x: x != 0)
    )
    every = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), F.coalesce(usable, F.lit(False)).alias("usable"))
    every = every.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector")))
    nodes = every.filter("usable").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label")
    )
    nodes = work.save(nodes)
    kind = every.schema["label"].dataType.simpleString()
    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    placed = nodes.select("node", "label", "vector").mapInArrow(
        _filters(most), f"node bigint, label {kind}, d int, filter bigint"
    )
    placed = work.save(placed)
    size = placed.groupBy("label", "d", "filter").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = work.save(placed.join(size, ["label", "d", "filter"]))
    buckets = max(1, -(-met.count() // BUCKET))
    # Of the filters a pair shares, the first one counts it.  A vector has a few hundred filters.
    lists = met.groupBy("node").agg(F.array_sort(F.collect_list("filter")).alias("filters"))
    blocks = F.ceil(F.col("members") / MEMBERS).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.join(lists, "node").join(nodes.select("node", "n", "vector"), "node")
    met = met.select(
        "label", "filter", "d", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node", "n", "vector",
        F.filter("filters", lambda f: f < F.col("filter")).alias("before"),
    )
    # Most filters have few members, so many of them go to one call; a crowded one is a block of bounded size.
    met = met.withColumn("group", F.xxhash64("label", "filter", "d", "lo", "hi")).drop("filter", "lo", "hi")
    met = met.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    links = met.groupBy("bucket").applyInArrow(_linked(cosine), "node bigint, least bigint, links bigint")
    links = work.save(links)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    label_of = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")), work)
    named = nodes.select("node", "n", "least").join(counts, "node", "left").join(label_of, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").select(
        "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    result = every.select("id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "id")
    return result.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
