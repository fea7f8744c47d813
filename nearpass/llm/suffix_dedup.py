"""Removal of byte strings that occur more than once, by sampled suffix names.

The difference-cover method sorts a sample of the suffixes, chosen such that
any two equal strings meet at sampled places with the same shift, names the
sampled ones by triples, recurses where the names do not decide yet, and
derives the remaining suffixes from the sample.  A fixed cover (places modulo
3) keeps two thirds of all positions, about 16 bytes for every byte of text.
Here the cover is chosen by content (a synchronising sample): a place is
sampled when its 64-byte gram has the smallest hash, leftmost first, of all
grams of some 200-byte string.  Equal strings then have the same sampled place
at the same shift, as a difference cover guarantees, and one place in about 60
is kept.

Each sampled place stands for the strings that it decides; they start at
consecutive positions lo..hi, up to the place itself.  Its triple is (left,
core, right): the core is what all these strings share, at first the gram;
left and right complete the outermost strings.

1. Name the cores and the triples, and compare those with one core: a core
   that occurs once decides that none of the strings occurs again, a core
   whose triples are all equal that each of them does.
2. Cores with different triples are the undecided rest.  Recurse: one copy of
   each triple is split into blocks of shifts (16, then 4, then 1), whose
   longer cores are named and compared in the same way.
3. The strings that occur again cover the bytes to remove.

Names are 64-bit hashes; two triples count as equal only if their cores do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import ODD, Hashes, flat, mix, signed, slices
from nearpass.llm.work import Work, meets, misses

GRAM = 64
SLICE_BYTES = 1 << 18
NAMES = ["key", "place", "lo", "hi"]
BLOCKS = (16, 4, 1)


def _smallest(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, at the run's first place."""
    least, done = a.copy(), 1
    while done * 2 <= width:
        least[:-done] = np.minimum(least[:-done], least[done:])
        done *= 2
    if rest := width - done:
        least[:-rest] = np.minimum(least[:-rest], least[rest:])
    return least


def sample(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Sampled place, first and last start of the strings it decides, names of core and triple."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    names = hashes.grams(min(GRAM, size))
    grams = (names >> np.uint64(32)).astype(np.uint32)
    width = size - min(GRAM, size) + 1
    least = _smallest(grams, width)
    lengths = np.diff(bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(np.arange(len(data)) + size <= bounds[1:][row])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    # The next start has another sampled place if the place is left behind or a smaller gram comes in.
    before, after = starts[:-1], starts[1:]
    same = (after == before + 1) & (row[after] == row[before])
    same &= (least[after] == least[before]) & (grams[before] != least[before])
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])
    lo, hi = starts[first], starts[np.concatenate([first[1:] - 1, [len(starts) - 1]])]
    place = hi.copy()
    ahead = np.flatnonzero(grams[hi] != least[hi])
    near = np.minimum(hi[ahead, None] + np.arange(width), len(grams) - 1)
    place[ahead] += (grams[near] == least[hi[ahead], None]).argmax(axis=1)
    return place, lo, hi, mix(names[place]), _triple(hashes, place, lo, hi, size)


def _triple(hashes: Hashes, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """Name of all bytes of the strings that start at lo..hi, and of where the place is in them."""
    shifts = ((place - lo) * 4096 + place - hi).astype(np.uint64)
    return hashes.of(lo, hi + size) ^ mix(shifts * np.uint64(ODD))


def _sampled(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row of the batch, place, lo, hi, core and triple; long rows in overlapping parts cut between sampled places."""
    for begin, end, data, bounds in slices(column, SLICE_BYTES):
        if len(data) <= 2 * SLICE_BYTES:
            place, lo, hi, core, triple = sample(data, bounds, size)
            at = np.searchsorted(bounds, lo, side="right") - 1
            yield begin + at, place - bounds[at], lo - bounds[at], hi - bounds[at], core, triple
            continue
        left = 0
        while True:
            part = data[left : left + SLICE_BYTES + size]
            place, lo, hi, core, triple = sample(part, np.array([0, len(part)]), size)
            last = left + len(part) >= len(data)
            keep = slice(None) if last else slice(0, -1)  # the last place may decide strings of the next part too
            rows = np.full(len(lo[keep]), begin)
            yield rows, place[keep] + left, lo[keep] + left, hi[keep] + left, core[keep], triple[keep]
            if last:
                break
            left += int(lo[-1])


def _sample_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for row, place, lo, hi, core, triple in _sampled(batch.column("text"), size):
                if len(row):
                    places = [x.astype(np.int32) for x in (place, lo, hi)]
                    columns = [keys[row], *places, signed(core), signed(triple)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], [*NAMES, "core", "triple"])

    return run


def _split_batches(size: int, block: int):
    """Items split where their shifts pass a multiple of `block`, with names and bytes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                data, bounds = flat(batch.column("bytes"))
                key, place, lo, hi, n = (
                    batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*NAMES, "n")
                )
                far, near = (place - lo) // block, (place - hi) // block
                count = far - near + 1
                item = np.repeat(np.arange(len(lo)), count)
                nth = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
                edge = (near[item] + nth) * block  # least shift of the block
                high = np.minimum(place[item] - edge, hi[item])
                low = np.maximum(place[item] - edge - block + 1, lo[item])
                at = (bounds[:-1] - lo)[item]  # from places in the text to places in `data`
                hashes = Hashes(data)
                core_begin = place[item] - edge + at
                core = hashes.of(core_begin, core_begin - block + 1 + size) ^ mix(edge.astype(np.uint64))
                triple = _triple(hashes, place[item] + at, low + at, high + at, size)
                bits = [data[a:b].tobytes() for a, b in zip(low + at, high + at + size, strict=True)]
                places = [x.astype(np.int32) for x in (place[item], low, high)]
                columns = [key[item], *places, n[item], signed(core), signed(triple)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(bits, pa.binary())], [*NAMES, "n", "core", "triple", "bytes"]
                )

    return run


def _judge(items: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """Ranges of starts that all occur again, and one copy of each undecided triple.

    Items with one core are compared by their least and greatest triple, which
    is aggregated before the shuffle, so a core that very many items have costs
    one row per task.
    """
    cores = items.groupBy("core").agg(
        F.sum("n").alias("n_core"), F.min("triple").alias("t0"), F.max("triple").alias("t1")
    )
    # Written, so that the join below has two plain shuffles and may split a core that very many items have.
    cores = work.save(cores.filter("n_core > 1").select("core", (F.col("t0") != F.col("t1")).alias("mixed")))
    met = work.save(items.join(cores, "core"))
    mixed = met.filter("mixed")
    one = F.min(F.struct(*[c for c in met.columns if c not in ("core", "triple", "n", "mixed")])).alias("one")
    named = work.save(mixed.groupBy("core", "triple").agg(F.sum("n").alias("n"), one))
    again = mixed.join(named.filter("n > 1").select("core", "triple"), ["core", "triple"], "left_semi")
    return met.filter("NOT mixed").select("key", "lo", "hi").unionByName(again.select("key", "lo", "hi")), named


def repeated_spans(docs: DataFrame, work: Work, size: int = 200) -> DataFrame:
    """Ranges of starts (key, lo, hi) of the strings of `size` bytes that start anywhere else too.

    `docs` has columns key (long) and text.  Rows with one key must have one
    text.  Ranges of one text may touch or be given twice.
    """
    schema = "key bigint, place int, lo int, hi int, core bigint, triple bigint"
    found = work.save(docs.mapInArrow(_sample_batches(size), schema))
    spans, named = _judge(found.withColumn("n", F.lit(1).cast("bigint")), work)
    work.drop(found)
    length = F.col("hi") - F.col("lo") + size
    bits = F.substring(F.col("text").cast("binary"), F.col("lo") + 1, length).alias("bytes")
    rest = named.select("one.*", "n")
    rest = meets(docs, rest, "key").join(rest, "key").select(*NAMES, "n", bits).dropDuplicates([*NAMES])
    for block in BLOCKS:
        columns = "key bigint, place int, lo int, hi int, n bigint, core bigint, triple bigint, bytes binary"
        items = work.save(rest.mapInArrow(_split_batches(size, block), columns))
        more, named = _judge(items, work)
        spans = spans.unionByName(more)
        rest = named.select("one.*", "n")
    return spans


def _cut_batches(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist()
            n_bytes, n_removed, n_spans, digest, kept_text = [], [], [], [], []
            for text, ranges in zip(texts, spans, strict=True):
                octets = text.encode()
                kept, place, removed, count, reach = [], 0, 0, 0, -1
                for r in ranges or ():
                    begin, end = r["lo"], r["hi"] + size
                    if begin > reach:
                        count += 1
                        kept.append(octets[place:begin])
                        removed += end - begin
                        place = reach = end
                    elif end > reach:
                        removed += end - reach
                        place = reach = end
                kept.append(octets[place:])
                rest = b"".join(kept)
                n_bytes.append(len(octets))
                n_removed.append(removed)
                n_spans.append(count)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept_text.append(rest.decode(errors="ignore") if removed else text)
            columns = [batch.column(c) for c in batch.schema.names if c not in ("text", "spans")]
            names = [c for c in batch.schema.names if c not in ("text", "spans")]
            columns += [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            names += ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, with_text: bool = False, carry: tuple = ()
) -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Every byte covered by a string of `size` bytes that starts anywhere else
    too is removed; strings are judged on the input.  `kept_text` leaves out
    the parts of a character that a cut has split.  The columns in `carry` come
    through unchanged.

    Null and empty texts and those below `size` bytes keep all bytes.  Repeated
    rows (same key, same text) are each other's copies.  Rows of one key with
    different texts, and a null key, are told apart by their texts.  Other
    columns are not read.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    carried = [F.col(c).alias(f"_carried_{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    rows = rows.withColumn("key", F.xxhash64("_id", "text"))
    spans = work.save(repeated_spans(rows.select("key", "text"), work, size))
    # Rows equal in key and text have the same spans, which count once.
    once = spans.select("key", "lo", "hi").distinct()
    listed = once.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    # Texts without a span need no join.
    found = meets(rows, spans, "key").join(listed, "key", "left")
    clean = misses(rows, spans, "key").withColumn("spans", F.lit(None).cast(listed.schema["spans"].dataType))
    columns = ["_id", *(f"_carried_{k}" for k in range(len(carry)))]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    both = found.unionByName(clean).select(*columns, "text", "spans")
    cut = both.mapInArrow(_cut_batches(size, with_text), schema)
    for k, c in enumerate(carry):
        cut = cut.withColumnRenamed(f"_carried_{k}", c)
    return cut.withColumnRenamed("_id", key)
