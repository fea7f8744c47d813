"""Minimax contiguous partition of ordered, atomic groups into shards.

Groups are the documents of equal texts, in the order of a hash of the text.
The smallest capacity for which a greedy cut needs no more than the given number
of shards is found by binary search.  Prefix sums of all groups are not needed
for it: sums over ranges of hashes decide, and only ranges in which a cut may
fall are taken apart, six more bits of the hash at a time.  The driver sees at
most a few thousand sums, whatever the number of documents.  All rows are
handled by built-in functions.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.work import Work, salted_rank

FIRST_BITS, MORE_BITS = 10, 6
PART = 200_000  # rows of one shard that one task numbers


class Ranges:
    """Sums of consecutive ranges of hashes: (prefix of the hash, its bits, bytes, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows, key=lambda r: r[0] << (64 - r[1]))
        self.ends = list(accumulate(r[2] for r in self.rows))
        self.total = self.ends[-1] if rows else 0

    def cuts(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """Where greedy shards end.  A range of several groups is taken whole or, if `divisible`, cut anywhere."""
        place, found = 0, []
        for _ in range(shards):
            at = bisect_right(self.ends, place + capacity)
            if at == len(self.rows):
                place = self.total
            elif divisible and self.rows[at][3] > 1:
                place += capacity
            else:
                place = max(place, self.ends[at - 1] if at else 0)
            found.append(place)
        return found

    def smallest(self, shards: int) -> int:
        """Least capacity with which whole ranges fit into the shards."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, False)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self, shards: int) -> list[tuple[int, int]]:
        """Ranges of several groups in which a cut of the best partition may fall."""
        enough = self.smallest(shards)
        least = self.cuts(-(-self.total // shards), shards, False)
        most = self.cuts(enough, shards, True)
        open_, starts = set(), [0, *self.ends[:-1]]
        for a, b in zip(least, most, strict=True):
            k = max(bisect_right(self.ends, a) - 1, 0)
            while k < len(self.rows) and starts[k] <= b:
                if self.rows[k][3] > 1:
                    open_.add(k)
                k += 1
        return [self.rows[k][:2] for k in sorted(open_)]


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """Least hash of each shard but the first; groups: (hash, bytes)."""

    def sums(rows: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftright("hash", 64 - bits).alias("prefix")
        found = rows.groupBy(prefix).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        return [(r.prefix, bits, r.b, r.n) for r in found]

    ranges = Ranges(sums(groups, FIRST_BITS))
    while open_ := ranges.undecided(shards):
        by_bits: dict[int, list[int]] = {}
        for prefix, bits in open_:
            by_bits.setdefault(bits, []).append(prefix)
        rows = [r for r in ranges.rows if r[:2] not in set(open_)]
        for bits, prefixes in by_bits.items():
            inside = groups.filter(F.shiftright("hash", 64 - bits).isin(prefixes))
            rows += sums(inside, min(bits + MORE_BITS, 64))
        ranges = Ranges(rows)
    if not ranges.rows:
        return []
    ends = ranges.cuts(ranges.smallest(shards), shards, False)
    first = [bisect_right(ranges.ends, end) for end in ends[:-1]]
    # A single group need not stand at the beginning of its range; cutting there moves no group.
    return [ranges.rows[k][0] << (64 - ranges.rows[k][1]) for k in first if k < len(ranges.rows)]


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """One row per document: key, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the UTF-8 bytes of the text plus 8.  Equal texts share a shard.  A
    group larger than an equal share of what is left gets a shard of its own;
    the others are cut such that the largest shard is as small as it can be.
    Slots count from 0 without gaps inside a shard.

    A null text counts as empty.  Repeated rows are equal texts; a null key is a
    key like others.  Other columns are not read.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    octets = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = work.save(
        docs.select(
            F.col(key).alias("id"), (F.octet_length(octets) + 8).cast("bigint").alias("size"),
            F.crc32(octets).alias("text_crc32"), F.xxhash64(octets).alias("hash"),
        )
    )
    groups = work.save(rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    every = groups.agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).first()
    left, alone = every.b or 0, []
    for r in groups.orderBy(F.desc("bytes"), "hash").limit(shards).collect():
        if r.bytes * (shards - len(alone)) <= left or len(alone) == shards - 1:
            break
        alone.append(r.hash)
        left -= r.bytes
    edges = boundaries(groups.filter(~F.col("hash").isin(alone)), shards - len(alone))
    place = reduce(lambda n, edge: n + (F.col("hash") >= edge).cast("int"), edges, F.lit(len(alone)))
    for k, h in enumerate(alone):
        place = F.when(F.col("hash") == h, k).otherwise(place)
    salts = max(1, -(-(every.n or 0) // PART))
    placed = rows.withColumn("shard", place.cast("int"))
    salt = F.pmod(F.xxhash64("id", "hash"), F.lit(salts))
    placed = salted_rank(placed, ["shard"], ["hash", "id"], salt, "slot")
    return placed.select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
