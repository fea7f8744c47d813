"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.work import Work

PART = 200_000  # links that one task joins by itself


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links (u, v) as (node, smallest node that these links reach), roots left out."""
    sides = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not sides:
        return
    u, v = (np.concatenate(x) for x in zip(*sides, strict=True))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(node)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a < b:
            root[b] = a
        else:
            root[a] = b
    found = np.array(root)
    while (found != found[found]).any():
        found = found[found]
    leaf = found != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[leaf]), pa.array(node[found[leaf]])], ["u", "v"])


def components(links: DataFrame, work: Work) -> DataFrame:
    """(node, component) for every node of `links` (a, b); a component's name is its smallest node.

    Each task joins its own part of the links, up to about PART, and passes on
    one link for each node.  As long as there are several parts, alternating
    stars follow: every node hangs its larger neighbours, then its smaller ones,
    on the smallest it knows.  A minimum is aggregated before the shuffle and
    the join on the node may be split, so a node with very many neighbours
    stays cheap.  Each round is a written table.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = work.save(edges)
    while True:
        parts = -(-edges.count() // PART)
        edges = work.save(edges.coalesce(max(parts, 1)).mapInArrow(_forest, "u bigint, v bigint"))
        if parts <= 1:
            break
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.save(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.save(large.filter("u <> v").distinct())
        low = work.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = work.save(small.union(low.select("u", "m")).distinct())
        hung = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        roots = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
        if hung.isEmpty() and roots.isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
