"""Exact n-gram Jaccard join by universe partition.

Two sets link when 100 * |intersection| >= percent * |union|.  Then their
symmetric difference has at most H = (100 - percent) * (|r| + |s|) / (100 + percent)
members.  Sets are taken in bands of sizes; a set signs for its own band and
for all those in which a larger partner may lie.  For a band, the universe
of shingles is cut by hash into m segments; a signature is the name of the part
of a set that falls into one segment.

* Plain segments: m = H + 1 + s + e.  Linked sets agree in at least s + e + 1
  segments.  Each set leaves out its s costliest signatures, those of the fewest
  shingles (with ties by name).  Cost is a property of the signature alone, so
  of the common ones the e + 1 cheapest are left out by neither set.  Empty
  segments, which unrelated sets share, thus make no candidates, and sets that
  share fewer than e + 1 signatures, as by a common passage, are no candidates
  either.
* One-deletion neighbourhoods: m = H // 2 + 1.  In some segment linked sets
  differ in one shingle at most, so the part of the one or one of its subsets
  with a shingle less is among those of the other.
* Allocation: for each band, the form with the lower cost is taken: number of
  signatures plus the number of pairs that would share one by chance, from the
  number and sizes of all its sets.

Equal sets are one node.  A signature that several nodes have makes candidates;
nothing is decided without comparing the sets.  First each node is compared
with the node most of whose signatures it shares as the least of their holders.
Then holders of one signature that are still in different components are
compared; pairs inside a component decide nothing.  Up to FEW holders, their
pairs are rows.  Of more holders no pairs are formed; only pairs that their
sketches allow come out, at first the closest few of each holder, in the last
round all that are left.  Crowded signatures that have holders in common form a
family; where that is less work, the holders of a family meet once, instead of
once for each of its signatures.  A sketch has a byte of the name and the size of a
set's part in each of up to SKETCH segments, from which follows a lower bound of
the difference of two sets.  No texts are compared of pairs beyond the bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm import shingles
from nearpass.llm.components import components
from nearpass.llm.scan import ODD, U, mix, signed
from nearpass.llm.work import Work, meets

BAND_RATIO = 1.4
FLUSH = 1 << 20  # signatures a task gathers before it hands them on
BUCKET = 400_000  # signatures expected in one bucket
FEW = 32  # holders of one signature whose pairs are rows
CLOSEST = (2, 32, None)  # partners of a holder in the successive rounds; None: all
SKETCH = 1024  # segments of a sketch at most
BLOCK = 4096  # holders that one task compares with as many
LOCAL = 64  # holders of one signature that one flush sends to its bucket


@dataclass(frozen=True)
class Band:
    least: int
    most: int
    segments: int  # 0: no two different sets of this band can link
    skip: int
    shared: int  # signatures that linked sets share at least
    deletions: bool


def band_edges(largest: int) -> list[int]:
    """Least sizes of the bands up to the one after the largest set's."""
    edges = [1]
    while edges[-1] <= largest * 2:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * BAND_RATIO)))
    return edges


def allocate(edges: list[int], counts: dict[int, tuple[int, int]], percent: int) -> list[Band]:
    """Segments and form of each band; counts: band -> (number of sets that sign for it, sum of their sizes)."""
    bands = []
    for k, least in enumerate(edges[:-1]):
        most = edges[k + 1] - 1
        differ = 2 * (100 - percent) * most // (100 + percent)
        if differ == 0:
            bands.append(Band(least, most, 0, 0, 1, False))
            continue
        n, total = counts.get(k, (0, 0))
        size = total / n if n else least
        skip, extra = 1 + differ // 5, differ // 8
        plain, deleting = differ + 1 + skip + extra, differ // 2 + 1
        # A pair is met by chance in segments with no shingle (or with one that is deleted).
        few = size / plain
        lone = plain * (n * max(few * math.exp(-few) / 50, 0)) ** 2 / 2
        few = size / deleting
        lone_deleting = deleting * (n * (1 + few) * math.exp(-few)) ** 2 / 2
        cost, cost_deleting = n * plain + lone, n * (deleting + size) + lone_deleting
        if cost_deleting < cost:
            bands.append(Band(least, most, deleting, 0, 1, True))
        else:
            bands.append(Band(least, most, plain, skip, 1 + extra, False))
    return bands


def reach(edges: np.ndarray, size: int, percent: int) -> int:
    """Band of the largest set that one of `size` can link with, as far as there are bands."""
    return int(np.searchsorted(edges, size * 100 // percent, side="right")) - 1


def sign(value: np.ndarray, band: int, rule: Band) -> np.ndarray:
    """Signatures of one set of sorted hashes."""
    m = rule.segments
    segment = (((value >> U(32)) * U(m)) >> U(32)).astype(np.int64)  # ascending, as the hashes are
    edge = np.searchsorted(segment, np.arange(m + 1))
    mixed = mix(value + U(ODD))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mixed)])
    part, size = sums[edge[1:]] - sums[edge[:-1]], np.diff(edge)
    place = (np.arange(m) + band * 1_000_003).astype(U)
    named = mix(part + mix(place * U(ODD) + size.astype(U)))
    if rule.skip:
        order = np.lexsort((named, size))
        return named[order[rule.skip :]]
    if rule.deletions:
        less = mix(part[segment] - mixed + mix(place[segment] * U(ODD) + (size[segment] - 1).astype(U)))
        return np.concatenate([named, less])
    return named


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for begin, bounds, value in shingles.sets(batch.column("text"), words):
                size[begin : begin + len(bounds) - 1] = np.diff(bounds)
                node[begin : begin + len(bounds) - 1] = signed(shingles.names(bounds, value))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(node), pa.array(size)], [*batch.schema.names[:-1], "node", "n"]
            )

    return run


def _pack(sig: np.ndarray, node: np.ndarray, band: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures as one row per bucket; holders beyond LOCAL of one signature in rows of their own.

    A signature keeps its bucket, 26 bits of its hash and its band.
    """
    bucket = (((sig >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    name = (bucket << 32) | (sig & U(0xFFFFFFC0)).astype(np.int64) | (band & 63)
    order = np.lexsort((node, name))
    name, node = name[order], node[order]
    keep = np.ones(len(name), bool)
    keep[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
    name, node = name[keep], node[keep]
    group = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    nth = np.arange(len(name)) - np.repeat(group, np.diff(np.append(group, len(name))))
    more = nth >= LOCAL
    parts, blobs, shared = [], [], []
    regular, holder = name[~more], node[~more]
    edge = np.searchsorted(regular >> 32, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[k], edge[k + 1]
        parts.append(k)
        shared.append(False)
        blobs.append((regular[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes() + holder[a:b].tobytes())
    for a in range(0, int(more.sum()), 50_000):
        parts.append(int(node[0] % buckets))
        shared.append(True)
        blobs.append(name[more][a : a + 50_000].tobytes() + node[more][a : a + 50_000].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(shared), pa.array(blobs, pa.binary())], ["part", "shared", "blob"]
    )


def _signatures(words: int, bands: list[Band], percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([b.least for b in bands])
        sigs, nodes, of, held, seen = [], [], [], 0, set()
        for batch in batches:
            for _, bounds, value in shingles.sets(batch.column("text"), words):
                name = signed(shingles.names(bounds, value))
                sizes = np.diff(bounds)
                own = np.searchsorted(edges, sizes, side="right") - 1
                for i in np.flatnonzero(sizes).tolist():
                    if name[i] in seen:
                        continue
                    seen.add(name[i])
                    members, k = value[bounds[i] : bounds[i + 1]], int(own[i])
                    for at in range(k, reach(edges, int(sizes[i]), percent) + 1):
                        if bands[at].segments:
                            sigs.append(sign(members, at, bands[at]))
                            nodes.append(np.full(len(sigs[-1]), name[i]))
                            of.append(np.full(len(sigs[-1]), at))
                            held += len(sigs[-1])
                if held >= FLUSH:
                    yield _pack(*map(np.concatenate, (sigs, nodes, of)), buckets)
                    sigs, nodes, of, held, seen = [], [], [], 0, set()
        if held:
            yield _pack(*map(np.concatenate, (sigs, nodes, of)), buckets)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures with several holders, and who holds them."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part, shared, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shared", "blob")), strict=True):
            if shared:
                half = len(blob) // 2
                yield _holders(np.frombuffer(blob[:half], np.int64), np.frombuffer(blob[half:], np.int64))
            else:
                n = len(blob) // 12
                kept.setdefault(part, []).append((np.frombuffer(blob, np.uint32, n), np.frombuffer(blob, np.uint8, offset=4 * n).view(np.int64) if 4 * n % 8 == 0 else np.frombuffer(blob[4 * n :], np.int64)))
    for part in list(kept):
        sig, node = (np.concatenate(x) for x in zip(*kept.pop(part), strict=True))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        several = np.zeros(len(sig), bool)
        several[1:] = sig[1:] == sig[:-1]
        several[:-1] |= several[1:].copy()
        yield _holders((np.int64(part) << 32) | sig[several].astype(np.int64), node[several])


def _holders(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node)], ["sig", "node"])


def _sketches(words: int, bands: list[Band], percent: int):
    """For each node and each band it signs for: names and sizes of its parts in the sketch's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([b.least for b in bands])
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                node, rows = batch.column("node").to_numpy(), []
                for begin, bounds, value in shingles.sets(batch.column("text"), words):
                    for i in range(len(bounds) - 1):
                        members = value[bounds[i] : bounds[i + 1]]
                        own = int(np.searchsorted(edges, len(members), side="right")) - 1
                        for band in range(own, reach(edges, len(members), percent) + 1):
                            m = min(SKETCH, 3 * (2 * (100 - percent) * bands[band].most // (100 + percent) + 1))
                            segment = (((members >> U(32)) * U(m)) >> U(32)).astype(np.int64)
                            edge = np.searchsorted(segment, np.arange(m + 1))
                            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(members))])
                            name = (mix(sums[edge[1:]] - sums[edge[:-1]]) >> U(56)).astype(np.uint8)
                            size = np.minimum(np.diff(edge), 255).astype(np.uint8)
                            rows.append((node[begin + i], band & 63, name.tobytes(), size.tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "band", "names", "sizes"])

    return run


def _closest(percent: int, most: int | None):
    """Pairs of holders of one signature, in different components, that may link by their sketches.

    A holder with more than `most` partners ahead of it keeps the closest, and
    comes out again, without a partner, for the next round.
    """

    def pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        part = group.column("component").to_numpy()
        order = np.argsort(part, kind="stable")
        part, node, n, side, again = part[order], *(
            group.column(c).to_numpy()[order] for c in ("node", "n", "side", "again")
        )
        blobs = [b"".join(group.column(c).to_pylist()) for c in ("names", "sizes")]
        name, size = (np.frombuffer(b, np.uint8).reshape(len(node), -1)[order] for b in blobs)
        size = size.astype(np.int16)
        ends = np.searchsorted(part, part, side="right")  # holders of other components are behind
        # Of the signatures a pair shares, the first one's group compares it.
        lists = group.column("before").combine_chunks().take(pa.array(order))
        owner = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        known, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        holds = np.zeros((len(node), len(known)), np.float32)
        holds[owner, column] = 1  # none for the holders of a family
        two_blocks = bool((side == 1).any())
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first_round = again.all()
        for i in np.flatnonzero(again).tolist():
            j0 = ends[i] if first_round else 0
            allowed = (100 - percent) * (n[j0:] + n[i]) // (100 + percent)
            near = part[j0:] != part[i]
            near &= holds[j0:] @ holds[i] == 0
            if two_blocks:
                near &= side[j0:] != side[i]
            js = np.flatnonzero(near)
            js = js[np.count_nonzero(name[j0:][js] != name[i], axis=1) <= allowed[js]]
            if not len(js):
                continue
            gap = np.abs(size[j0:][js] - size[i])
            bound = np.where((gap == 0) & (name[j0:][js] != name[i]), 2, gap).sum(axis=1)
            js, bound = js[bound <= allowed[js]], bound[bound <= allowed[js]]
            if most is not None and len(js) > most:
                js = js[np.argsort(bound, kind="stable")[:most]]
                out_a.append(node[i : i + 1])
                out_b.append(node[i : i + 1])
            out_a.append(np.full(len(js), node[i]))
            out_b.append(node[j0:][js])
        return np.concatenate(out_a), np.concatenate(out_b)

    def run(key: tuple, group: pa.Table) -> pa.Table:  # key: sig, band and blocks
        a, b = pairs(group)
        columns = [np.full(len(a), key[0].as_py()), np.minimum(a, b), np.maximum(a, b)]
        return pa.Table.from_arrays([pa.array(x) for x in columns], ["sig", "a", "b"])

    return run


def _allowed(percent: int):
    """Pairs whose sketches' names differ in no more segments than linked sets can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("names_a", "names_b"))
            most = (100 - percent) * (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) // (100 + percent)
            keep = [
                int(np.count_nonzero(np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8))) <= n
                for a, b, n in zip(left, right, most.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sift(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, band) that may link by their sizes and sketches."""
    for side in ("a", "b"):
        named = [F.col("node").alias(side), "band", F.col("n").alias(f"n_{side}"), F.col("names").alias(f"names_{side}")]
        pairs = pairs.join(sketches.select(*named), [side, "band"])
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return pairs.mapInArrow(_allowed(percent), "a bigint, b bigint")


def _compare(words: int, percent: int):
    """Pairs (a, b, text_a, text_b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                left, right = [], []
                for side, column in ((left, "text_a"), (right, "text_b")):
                    for _, bounds, value in shingles.sets(batch.column(column), words):
                        side += [value[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                keep = []
                for i, (r, s) in enumerate(zip(left, right, strict=True)):
                    both = np.concatenate([r, s])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if common and 100 * common >= percent * (len(r) + len(s) - common):
                        keep.append(i)
                if keep:
                    links = [batch.column(c).take(pa.array(keep)) for c in ("a", "b")]
                    yield pa.RecordBatch.from_arrays(links, ["a", "b"])

    return run


def _verify(pairs: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; known: (node, n, text)."""
    sized = pairs
    for side in ("a", "b"):
        named = [F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("text").alias(f"text_{side}")]
        sized = sized.join(known.select(*named), side)
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    texts = sized.filter(near).select("a", "b", "text_a", "text_b")
    return texts.mapInArrow(_compare(words, percent), "a bigint, b bigint")


def _open(held: DataFrame, label: DataFrame) -> DataFrame:
    """Holders, with their components, of the signatures whose holders are not all in one component."""
    placed = held.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    return placed.join(apart.filter("c0 <> c1").select("sig"), "sig")


def _families(open_: DataFrame, work: Work) -> DataFrame:
    """Groups whose holders are compared: (sig, node, band, holders, whole).

    `open_` has the holders (node, a: the least one, component) of crowded
    signatures.  Signatures of one band with a chain of common holders are a
    family.  Its holders meet once (`whole`; sig is then the family's name,
    below 0) if their pairs across components are no more than those of all its
    signatures one by one; otherwise each signature stays a group of its own.
    """
    member = F.xxhash64("node", "band")
    edges = open_.select(member.alias("a"), F.xxhash64("a", "band").alias("b"))
    family = components(edges, work).select(F.col("node").alias("member"), F.col("component").bitwiseOR(F.lit(-(1 << 63))).alias("family"))
    named = work.save(open_.withColumn("member", member).join(family, "member", "left"))
    # A signature whose holders are all one node's has no edge, and no pair either.
    named = named.filter("family IS NOT NULL")

    def pairs(groups: DataFrame, *by: str) -> DataFrame:
        parts = groups.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n"))
        return parts.groupBy(*by).agg(
            F.sum("n").alias("holders"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).cast("double").alias("pairs")
        )

    members = work.save(named.select("family", "band", "node", "component").distinct())
    whole = pairs(members, "family", "band")
    single = pairs(named, "family", "band", "sig").groupBy("family", "band").agg(F.sum("pairs").alias("single"))
    choice = work.save(whole.join(single, ["family", "band"]).withColumn("whole", F.col("pairs") <= F.col("single")))
    once = members.join(choice.filter("whole"), ["family", "band"]).select(
        F.col("family").alias("sig"), "node", "band", "holders", F.lit(True).alias("whole")
    )
    each = named.join(choice.filter("NOT whole").select("family", "band"), ["family", "band"]).select(
        "sig", "node", "band", "holders", F.lit(False).alias("whole")
    )
    return work.save(once.unionByName(each))


def jaccard_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """One row per document: key, n_shingles (size of its set), component_id (smallest key reachable by links).

    Two documents link when their sets of `words`-word shingles have a Jaccard
    similarity of at least `percent` / 100.  Words are runs of anything but
    white space (0x09-0x0D, 0x20), with A-Z in lower case.  Of fewer words than
    a shingle, the whole sequence is the one shingle.

    Null and empty texts, and those without words, have an empty set and link
    with nothing; each is its own component.  Repeated rows are equal sets and
    link.  A null key is the name of a component only if all keys in it are
    null.  Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Work(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    found = work.save(rows.select("_id", "key", "text").mapInArrow(_nodes(words), f"_id {kind}, key bigint, node bigint, n bigint"))
    nodes = work.save(found.filter("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("_id").alias("least"), F.first("n").alias("n")))

    largest = nodes.agg(F.max("n")).first()[0] or 1
    edges = band_edges(largest)
    band = sum((F.col("size") >= e).cast("int") for e in edges[1:])
    own = nodes.select("n", F.col("n").alias("size")).select("n", band.alias("band"))
    nxt = nodes.select("n", (F.col("n") * 100 / percent).cast("bigint").alias("size")).select("n", band.alias("band"))
    if 100 > percent * BAND_RATIO:  # bands between the own and the last one
        both = nodes.select("n", F.col("n").alias("own"), (F.col("n") * 100 / percent).cast("bigint").alias("size"))
        both = both.select("n", band.alias("high"), F.col("own").alias("size")).select("n", "high", band.alias("low"))
        between = F.when(F.col("high") > F.col("low") + 1, F.sequence(F.col("low") + 1, F.col("high") - 1))
        nxt = nxt.unionByName(both.select("n", F.explode(between).alias("band")))
    counts = own.unionByName(nxt).groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).collect()
    bands = allocate(edges, {r.band: (r.c, r.s) for r in counts}, percent)
    inside = [r for r in counts if r.band < len(bands)]  # larger sets there are none
    expected = sum(r.c * bands[r.band].segments + r.s * bands[r.band].deletions for r in inside) // 2
    buckets = max(16, math.ceil(expected / BUCKET))

    packed = rows.select("text").mapInArrow(
        _signatures(words, bands, percent, buckets), "part int, shared boolean, blob binary"
    )
    held = work.save(packed.repartition(buckets, "part").mapInArrow(_shared, "sig bigint, node bigint"))

    needed = held.select("node").distinct().join(nodes.select("node", "key", "n"), "node")
    known = meets(rows.select("key", "text"), needed, "key").join(needed, "key").select("node", "n", "text")
    known = work.save(known.dropDuplicates(["node"]))

    sketches = known.select("node", "text").mapInArrow(
        _sketches(words, bands, percent), "node bigint, band int, names binary, sizes binary"
    )
    sketches = work.save(sketches.join(nodes.select("node", "n"), "node"))
    band = F.expr("CAST(sig & 63L AS INT)")

    least = held.groupBy("sig").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("holders"))
    held = work.save(held.join(least, "sig"))
    stars = held.filter("a <> node").groupBy("a", F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.max(band).alias("band")
    )
    first = stars.groupBy("b").agg(F.max_by(F.struct("a", "band"), F.struct("c", "a")).alias("x")).select("x.*", "b")
    first = work.save(first)
    sifted = work.save(_sift(first, sketches, percent))
    linked = work.save(_verify(sifted, known, words, percent))
    label = work.save(components(linked, work))
    tested = first.select("a", "b")

    few = _open(held.filter(F.col("holders") <= FEW), label)
    a, b = (few.select("sig", F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    across = a.join(b, "sig").filter("a < b AND c_a <> c_b").groupBy("a", "b", band.alias("band")).count()
    # A pair with too few of these shares a signature of many holders, or does not link.
    enough = F.element_at(F.array(*[F.lit(x.shared) for x in bands]), F.col("band") + 1)
    across = across.filter(F.col("count") >= enough).groupBy("a", "b").agg(F.max("band").alias("band"))
    across = work.save(_sift(across.join(tested, ["a", "b"], "left_anti"), sketches, percent))
    linked = linked.unionByName(work.save(_verify(across, known, words, percent)))
    tested = tested.unionByName(across)
    crowded = _open(held.filter(F.col("holders") > FEW), label).withColumn("band", band)
    groups = _families(work.save(crowded.drop("c0", "c1")), work)

    again = None  # holders whose partners have not all come out
    for most in CLOSEST:
        open_ = work.save(_open(groups, label))
        # Of the signatures a pair shares, the first one's group compares it; a family has all pairs of its holders.
        lists = open_.filter("NOT whole").groupBy("node").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))
        if again is None:
            open_ = open_.withColumn("again", F.lit(True))
        else:
            open_ = open_.join(again.select("sig").distinct(), "sig", "left_semi")
            open_ = open_.join(again.withColumn("again", F.lit(True)), ["sig", "node"], "left").fillna(False, "again")
        blocks = F.ceil(F.col("holders") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        spread = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        spread = spread.select(
            "sig", "node", "component", "again", "whole", "band", F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        )
        spread = spread.join(sketches, ["node", "band"])
        earlier = F.when(F.col("whole"), F.array().cast("array<bigint>")).otherwise(F.filter("sigs", lambda s: s < F.col("sig")))
        spread = spread.join(lists, "node", "left").withColumn("before", earlier).drop("sigs", "whole")
        near = spread.groupBy("sig", "band", "lo", "hi").applyInArrow(_closest(percent, most), "sig bigint, a bigint, b bigint")
        near = work.save(near)
        again = near.filter("a = b").select("sig", F.col("a").alias("node")).distinct()
        fresh = near.filter("a <> b").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        fresh = work.save(fresh)
        linked = linked.unionByName(work.save(_verify(fresh, known, words, percent)))
        tested = tested.unionByName(fresh)
        label = work.save(components(linked, work))
        if again.isEmpty():
            break

    names = nodes.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = names.groupBy("component").agg(F.min("least").alias("component_id"))
    names = names.join(smallest, "component").select("node", "component_id")
    return found.join(names, "node", "left").select(
        F.col("_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
    )
