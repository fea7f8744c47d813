"""Benchmark decontamination with a positional inverted index.

The index is stored by blocks of documents: for each block and term the
ascending positions of the term in the block's word sequence.  Two documents
are GAP places apart, so no phrase runs over their border.  Of the corpus, the
terms that the benchmark may ask for are stored; a bitmap of fixed size decides.

A phrase is looked up from its rarest term: the positions of that term, moved
back by its offset in the phrase, are the possible starts; they are intersected
with those of the next rarest term of the same block, and what is left is looked
up in the lists of all others by binary search, one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearpass.llm.scan import Hashes, runs, signed, slices
from nearpass.llm.work import Work

BLOCK_BYTES = 4 << 20
GAP = 64  # more than any window has words
MAP_BITS = 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)  # after lower-casing: 0-9, a-z and every byte of a character beyond ASCII
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end of every word."""
    lower = LOWER[data]
    first, last = runs(WORD[lower], bounds)
    return Hashes(lower).words(first, last), np.searchsorted(bounds, first, side="right") - 1, first, last


def _windows(size: int):
    """Windows of `size` consecutive words of each item; an item of fewer words is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, terms = [], []
            for begin, end, data, bounds in slices(batch.column("text"), 1 << 18):
                term, row, _, _ = words(data, bounds)
                term = signed(term)
                edge = np.searchsorted(row, np.arange(end - begin + 1))
                for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    for k in range(a, max(b - size, a) + 1 if b > a else a):
                        items.append(begin + i)
                        terms.append(term[k : min(k + size, b)])
            ids = batch.column("item").take(pa.array(items, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    return run


def _index(wanted: np.ndarray):
    """Per block: one row with its documents, then a row for each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in slices(batch.column("text"), BLOCK_BYTES):
                term, row, at = [], [], 0
                for a, b, part, edge in slices(batch.column("text").slice(begin, end - begin), 1 << 18):
                    t, r, _, _ = words(part, edge)
                    term.append(t)
                    row.append(r + a)
                term, row = np.concatenate(term), np.concatenate(row)
                count = np.bincount(row, minlength=end - begin)
                starts = np.concatenate([[0], np.cumsum(count + GAP)[:-1]])
                place = np.arange(len(term)) + row * GAP
                keep = wanted[(term >> np.uint64(64 - MAP_BITS)).astype(np.int64)]
                term, place = term[keep], place[keep].astype(np.int32)
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                edge = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
                block = int(np.random.SeedSequence().generate_state(1, np.uint64)[0] >> 1)
                ids = batch.column("id").slice(begin, end - begin)
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(term)).astype(np.int32)), pa.array(place))
                n = len(edge)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, block)),
                        pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(signed(term[edge]))]),
                        pa.concat_arrays([pa.nulls(1, lists.type), lists]),
                        pa.ListArray.from_arrays(pa.array([0, *[end - begin] * (n + 1)], pa.int32()), ids),
                        pa.ListArray.from_arrays(pa.array([0, *[end - begin] * (n + 1)], pa.int32()), pa.array(starts.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array([0, *[end - begin] * (n + 1)], pa.int32()), pa.array(count.astype(np.int32))),
                    ],
                    ["block", "term", "places", "ids", "starts", "counts"],
                )

    return run


def build_index(docs: DataFrame, wanted: np.ndarray, key: str, text: str, work: Work) -> DataFrame:
    """The stored index of whole texts: (block, term, places); rows without a term list a block's documents."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"block bigint, term bigint, places array<int>, ids array<{kind}>, starts array<int>, counts array<int>"
    return work.save(rows.mapInArrow(_index(wanted), schema))


def phrases_in(index: DataFrame, phrases: DataFrame, work: Work) -> DataFrame:
    """(block, phrase, start) of every exact occurrence; phrases: (phrase, terms)."""
    postings = index.filter("term IS NOT NULL").select("block", "term", "places")
    often = postings.groupBy("term").agg(F.sum(F.size("places")).alias("often"))
    each = phrases.select("phrase", F.size("terms").alias("words"), F.posexplode("terms").alias("k", "term"))
    each = each.join(often, "term")  # a phrase with a term the corpus lacks is left with fewer rows than words
    order = Window.partitionBy("phrase").orderBy("often", "k")
    each = each.withColumn("nth", F.row_number().over(order))
    each = each.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("phrase"))).filter("known = words")
    each = work.save(each.select("phrase", "k", "term", "nth"))

    moved = F.transform("places", lambda p: p - F.col("k"))
    found = each.filter("nth = 1").join(postings, "term").select("phrase", "block", moved.alias("found"))
    second = each.filter("nth = 2").join(postings, "term").select("phrase", "block", moved.alias("more"))
    further = F.when(F.col("nth") > 2, F.struct("nth", "k", "term"))
    rest = each.groupBy("phrase").agg(F.max("nth").alias("words"), F.array_sort(F.collect_list(further)).alias("rest"))
    met = found.join(second, ["phrase", "block"], "left").join(rest, "phrase")
    left = F.when(F.col("words") == 1, F.col("found")).otherwise(F.array_intersect("found", "more"))
    left = work.save(met.select("phrase", "block", left.alias("found"), "rest").filter("size(found) > 0"))
    # Only the blocks and phrases whose two rarest terms stand rightly come together with all lists of the block.
    open_ = postings.join(left.select("block").distinct(), "block", "left_semi")
    pairs = open_.groupBy("block").cogroup(left.groupBy("block"))
    return pairs.applyInArrow(_starts, "block bigint, phrase bigint, start int")


def _starts(key: tuple, postings: pa.Table, phrases: pa.Table) -> pa.Table:
    """Starts of the phrases in one block: the candidates, looked up in the list of each further term, rarest first."""
    term = postings.column("term").to_numpy()
    lists = postings.column("places").combine_chunks()
    edge = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    places = lists.flatten().to_numpy()
    of = {t: i for i, t in enumerate(term.tolist())}
    names, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for row in phrases.select(["phrase", "found", "rest"]).to_pylist():
        start = np.array(row["found"], np.int32)
        for more in row["rest"]:
            if more["term"] not in of or not len(start):
                start = start[:0]
                break
            at = of[more["term"]]
            here = places[edge[at] : edge[at + 1]]
            sought = start + more["k"]
            near = np.minimum(np.searchsorted(here, sought), len(here) - 1)
            start = start[here[near] == sought]
        names.append(np.full(len(start), row["phrase"], np.int64))
        starts.append(start)
    phrase, start = np.concatenate(names), np.concatenate(starts)
    block = np.full(len(phrase), key[0].as_py(), np.int64)
    return pa.table({"block": block, "phrase": phrase, "start": start.astype(np.int32)})


def near_in(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(block, phrase, place): places of the phrase's rarest term with each other term at most `within` words away."""
    postings = index.filter("term IS NOT NULL").select("block", "term", "places")
    often = postings.groupBy("term").agg(F.sum(F.size("places")).alias("often"))
    each = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term")).join(often, "term", "left")
    order = Window.partitionBy("phrase").orderBy(F.col("often").asc_nulls_first(), "term")
    each = each.withColumn("nth", F.row_number().over(order))
    wanted = each.groupBy("phrase").agg(F.count(F.lit(1)).alias("words"))
    rare = each.filter("nth = 1").join(postings, "term").select("phrase", "block", F.explode("places").alias("place"))
    other = each.filter("nth > 1").join(postings, "term").select("phrase", "block", "places")
    met = rare.join(other, ["phrase", "block"]).filter(
        F.exists("places", lambda p: F.abs(p - F.col("place")) <= within)
    )
    met = met.groupBy("phrase", "block", "place").agg((F.count(F.lit(1)) + 1).alias("n"))
    alone = rare.join(wanted.filter("words = 1"), "phrase").select("phrase", "block", "place")
    return met.join(wanted.filter("words > 1"), "phrase").filter("n = words").select("phrase", "block", "place").unionByName(alone)


def _cover(key: tuple, blocks: pa.Table, hits: pa.Table) -> pa.Table:
    """Documents of one block, each with the number of words its hits cover and the phrases found."""
    names = ["id", "n_words", "n_hit", "phrases"]
    if not blocks.num_rows:
        return pa.Table.from_arrays([pa.array([], blocks.schema.field("ids").type.value_type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64()))], names)
    ids = blocks.column("ids").combine_chunks().flatten()
    starts = np.array(blocks.column("starts")[0].as_py(), np.int64)
    counts = np.array(blocks.column("counts")[0].as_py(), np.int64)
    start, words, phrase = (hits.column(c).to_numpy() for c in ("start", "words", "phrase"))
    row = np.searchsorted(starts, start, side="right") - 1
    size = int(starts[-1] + counts[-1] + GAP)
    step = np.zeros(size + GAP, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + words, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:size]) > 0)])
    n_hit = covered[starts + counts] - covered[starts]
    found = [[] for _ in range(len(starts))]
    for r, p in sorted(set(zip(row.tolist(), phrase.tolist(), strict=True))):
        found[r].append(p)
    columns = [ids, pa.array(counts), pa.array(n_hit.astype(np.int64)), pa.array(found, pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, names)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 13, share: int = 20,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a window: `window`
    consecutive words of an item, or all words of a shorter one.  A document is
    contaminated when its hit words are at least one in `share`.

    Null and empty texts and those without words have no words and are never
    contaminated; an item without words has no window.  Repeated documents are
    judged one by one; a repeated item counts once.  A null item id counts as an
    item of its own name, the empty string.  Other columns are not read.
    """
    work = Work(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    windows = work.save(items.mapInArrow(_windows(window), "item string, terms array<bigint>").withColumn("phrase", F.xxhash64("terms")))
    slots = windows.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", 64 - MAP_BITS).alias("s")).distinct()
    wanted = np.zeros(1 << MAP_BITS, bool)
    wanted[[r.s for r in slots.collect()]] = True  # at most 2**MAP_BITS slots, whatever the benchmark's size
    index = build_index(docs, wanted, key, text, work)
    phrases = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    hits = phrases_in(index, phrases, work).join(phrases.select("phrase", F.size("terms").alias("words")), "phrase")
    blocks = index.filter("term IS NULL").select("block", "ids", "starts", "counts")
    kind = docs.schema[key].dataType.simpleString()
    judged = blocks.groupBy("block").cogroup(hits.select("block", "start", "words", "phrase").groupBy("block"))
    judged = work.save(judged.applyInArrow(_cover, f"id {kind}, n_words bigint, n_hit bigint, phrases array<bigint>").withColumn("row", F.monotonically_increasing_id()))
    found = judged.select("row", F.explode("phrases").alias("phrase")).join(windows.select("phrase", "item").distinct(), "phrase")
    found = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return judged.join(found, "row", "left").select(
        F.col("id").alias(key), "n_words", "n_hit", F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
