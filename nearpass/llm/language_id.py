"""Language identification by Bayesian fusion of several kinds of evidence.

log P(language | row) = a * log P(text | language) + log P(declared | language)
                      + log P(suffix | language) + log P(language | host) + constant

* Text: hashed byte trigrams of the whole lower-cased text with counts from all
  labelled texts; `a` flattens the likelihood of long texts, whose trigrams are
  not independent.  One more class has uniform trigrams: noise.  A text that
  is nearer to noise than to any labelled language may be in a language without
  labels; it is noise unless its own trigrams recur as those of a language do, which
  texts of some fifty letters and more can show.
* Declared markup language and address suffix: how often each value stands on
  rows of each language, judged by text alone, over all rows.
* Host: counts of the same judgements, smoothed towards those of its domain,
  these towards those of the suffix, and these towards those of all rows.

All counts are grouped aggregates over all rows.  What is sent to the tasks is
the text model: TABLE numbers for each language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import slices
from nearpass.llm.work import Work, columns_of, fresh, without

TABLE = 1 << 15
SLICE_BYTES = 1 << 19
EFFECTIVE = 60.0  # trigrams that count in full; more add less and less
STRENGTH = 20.0  # rows a parent level counts as in the smoothing of a host
PSEUDO = 1.0
NOISE = -25.0  # log prior of noise: a short text with unusual words is not rejected
# Chance that two trigrams of a text are equal: of random letters less than 1 / 6000, of a language more than 1 / 1000,
# and more than 1 / 20 where little but one string is repeated.  Fewer than LEAST equal pairs show nothing.
REPEATS = 1 / 2000, 1 / 20
LEAST = 3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot of every trigram with a letter in the middle, and the bounds of each row's trigrams.

    Everything but letters counts as a space, so marks and digits tell nothing.
    """
    lower = LOWER[data]
    letter = LETTER[lower]
    plain = np.where(letter, lower, 32).astype(np.uint32)
    before, after = np.empty_like(plain), np.empty_like(plain)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    if len(plain):
        first, last = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
        before[first], after[last] = 32, 32
    slot = (before * np.uint32(0x9E3779B1) ^ plain * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D))
    slot = ((slot ^ (slot >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    ends = np.concatenate([[0], np.cumsum(letter)])
    return slot[letter], ends[bounds]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of this task's rows for each language."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), object)
        for begin, end, data, bounds in slices(batch.column("text"), SLICE_BYTES):
            slot, edge = trigrams(data, bounds)
            owner = np.repeat(np.arange(end - begin), np.diff(edge))
            for language in set(languages[begin:end]):
                here = np.flatnonzero(languages[begin:end] == language)
                chosen = np.zeros(end - begin, bool)
                chosen[here] = True
                counts = np.bincount(slot[chosen[owner]], minlength=TABLE)
                totals[language] = totals.get(language, 0) + counts
    for language, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "slot", "n"]
        )


def text_model(labelled: DataFrame, lang: str, text: str) -> tuple[list[str], np.ndarray]:
    """Languages, and log P(trigram | language) with a row of uniform noise at the end.

    The number of languages is that of distinct labels; null labels teach nothing.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    vectors = counts.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("bins"))  # at most TABLE bins each
    found = {r.lang: r.bins for r in vectors.collect()}
    languages = sorted(found)
    model = np.full((len(languages) + 1, TABLE), 0.5)
    for k, language in enumerate(languages):
        for slot, n in found[language]:
            model[k, slot] += n
    model[-1] = 1
    model = np.log(model / model.sum(axis=1, keepdims=True))
    return languages, model.astype(np.float32)


def _random(slot: np.ndarray) -> bool:
    """Whether the trigrams of a text do not recur as in a language, or are too few to show it."""
    times = np.bincount(slot)
    equal, pairs = int((times * (times - 1)).sum()) // 2, len(slot) * (len(slot) - 1) // 2
    return equal < LEAST or not REPEATS[0] <= equal / pairs <= REPEATS[1]


def _score(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((batch.num_rows, len(model)))
            n = np.zeros(batch.num_rows, np.int64)
            noise = np.zeros(batch.num_rows, bool)
            for begin, end, data, bounds in slices(batch.column("text"), SLICE_BYTES):
                slot, edge = trigrams(data, bounds)
                n[begin:end] = np.diff(edge)
                for k in range(len(model)):
                    sums = np.concatenate([[0.0], np.cumsum(model[k][slot], dtype=np.float64)])
                    total[begin:end, k] = sums[edge[1:]] - sums[edge[:-1]]
                if len(model) > 1:
                    flat = total[begin:end] * (EFFECTIVE / (EFFECTIVE + n[begin:end]))[:, None]
                    for k in np.flatnonzero(flat[:, :-1].max(axis=1) <= flat[:, -1] + NOISE + 1e-6).tolist():
                        noise[begin + k] = _random(slot[edge[k] : edge[k + 1]])
            names = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in names]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), len(model)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(n), pa.array(noise)], [*names, "text_log", "n_trigrams", "_noise"])

    return run


def host_parts(url: str) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (the last) of an address."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    return host, F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host), F.element_at(labels, -1)


def identify(evidence: DataFrame, labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows of `evidence` without their text, with language, probability, rejected and n_trigrams.

    `evidence` has the columns text, declared, host, domain, suffix (each may be
    null: no such evidence) and any others.  Rejected are rows whose text has no
    letter, or whose best class is noise and whose own trigrams do not show a language.
    Other rows nearer to noise than to any label, as in a language that is not
    labelled, and all rows if nothing is, are not rejected.  The language of both
    kinds is 'und'.  Ties take the first language by name.
    """
    work = Work(evidence.sparkSession)
    languages, model = text_model(labelled, lang, text)
    kept = [c for c in evidence.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in evidence.select(*kept).schema)
    rows = evidence.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    scored = work.save(rows.mapInArrow(_score(model), f"{schema}, text_log array<double>, n_trigrams bigint, _noise boolean"))
    flat = F.lit(EFFECTIVE) / (F.lit(EFFECTIVE) + F.col("n_trigrams"))
    log = [F.element_at("text_log", k + 1) * flat for k in range(len(languages) + 1)]
    if not languages:
        plain = scored.withColumns({"language": F.lit("und"), "probability": F.lit(0.0), "rejected": F.col("n_trigrams") == 0})
        return plain.select(*kept, "language", "probability", "rejected", "n_trigrams")

    top = F.greatest(*log[:-1]) if len(languages) > 1 else log[0]
    judged = F.lit(None).cast("int")
    for k in reversed(range(len(languages))):
        judged = F.when(log[k] == top, k).otherwise(judged)
    usable = (F.col("n_trigrams") > 0) & (top > log[-1] + NOISE)
    scored = scored.withColumn("_judged", F.when(usable, judged))

    def table(by: list[str], name: str) -> DataFrame:
        each = [F.sum((F.col("_judged") == k).cast("bigint")).alias(f"{name}_{k}") for k in range(len(languages))]
        return scored.filter("_judged IS NOT NULL").groupBy(*by).agg(*each)

    every = table([], "all").first()
    totals = [int(every[k] or 0) for k in range(len(languages))]
    whole = [(n + PSEUDO) / (sum(totals) + PSEUDO * len(languages)) for n in totals]

    def smoothed(counts: DataFrame, name: str, parent: str | None) -> list[Column]:
        n = reduce(lambda a, b: a + b, [F.col(f"{name}_{k}") for k in range(len(languages))])
        above = [F.col(f"{parent}_p{k}") if parent else F.lit(whole[k]) for k in range(len(languages))]
        share = [(F.col(f"{name}_{k}") + STRENGTH * above[k]) / (n + STRENGTH) for k in range(len(languages))]
        return [c.alias(f"{name}_p{k}") for k, c in enumerate(share)]

    # Levels from the top down; a host knows its domain and suffix, whose shares it is drawn to.
    suffix = table(["suffix"], "suffix").filter("suffix IS NOT NULL")
    suffix = suffix.select("suffix", *smoothed(suffix, "suffix", None))
    domain = table(["domain", "suffix"], "domain").filter("domain IS NOT NULL").join(suffix, "suffix", "left")
    domain = domain.fillna({f"suffix_p{k}": whole[k] for k in range(len(languages))})
    domain = domain.select("domain", "suffix", *smoothed(domain, "domain", "suffix"))
    host = table(["host", "domain"], "host").filter("host IS NOT NULL")
    host = host.join(domain.dropDuplicates(["domain"]).drop("suffix"), "domain", "left")
    host = host.fillna({f"domain_p{k}": whole[k] for k in range(len(languages))})
    host = host.groupBy("host").agg(
        *[F.sum(f"host_{k}").alias(f"host_{k}") for k in range(len(languages))],
        *[F.avg(f"domain_p{k}").alias(f"domain_p{k}") for k in range(len(languages))],
    )
    host = host.select("host", *smoothed(host, "host", "domain"))

    def given(column: str) -> DataFrame:
        """log P(value | language) with one pseudo-row for an unseen value."""
        counts = table([column], column).filter(F.col(column).isNotNull())
        logs = [F.log((F.col(f"{column}_{k}") + PSEUDO) / (totals[k] + 2 * PSEUDO)).alias(f"{column}_l{k}") for k in range(len(languages))]
        return counts.select(column, *logs)

    joined = scored.join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left").join(host, "host", "left")
    prior = [F.coalesce(F.log(f"host_p{k}"), F.lit(math.log(whole[k]))) for k in range(len(languages))]
    sums = [
        log[k] + F.coalesce(f"declared_l{k}", F.lit(0.0)) + F.coalesce(f"suffix_l{k}", F.lit(0.0)) + prior[k]
        for k in range(len(languages))
    ]
    joined = joined.withColumn("_sums", F.array(*sums))
    best = F.array_max("_sums")
    place = F.array_position("_sums", best)
    named = F.element_at(F.array(*map(F.lit, languages)), place.cast("int"))
    weight = F.aggregate("_sums", F.lit(0.0), lambda total, x: total + F.exp(x - best))
    unknown = F.col("_judged").isNull()
    return joined.select(
        *kept,
        F.when(unknown, F.lit("und")).otherwise(named).alias("language"),
        F.when(unknown, F.lit(0.0)).otherwise(F.round(1 / weight, 9)).alias("probability"),
        (unknown & ((F.col("n_trigrams") == 0) | F.col("_noise"))).alias("rejected"),
        "n_trigrams",
    )


def page_evidence(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Evidence of web pages: readable text, declared markup language, host, domain and suffix of the address."""
    host, domain, suffix = host_parts(url)
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,10};", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.col(key).alias("page_id"), body.alias("text"), empty(declared).alias("declared"), empty(host).alias("host"),
        empty(domain).alias("domain"), empty(suffix).alias("suffix"),
    )


def document_evidence(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Evidence of documents: text, the language they declare, and their source as host; they have no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lower(lang).alias("declared"),
        F.col(source).alias("host"), F.col(source).alias("domain"), none.alias("suffix"),
    )


def languages_of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page and per document: page_id or doc_id, declared, host, language, probability, rejected.

    The text model learns from the documents' labels.  Null and empty texts are
    rejected ('und'; texts in a language without labels are 'und' and kept); null addresses and declarations are no evidence; repeated
    rows are judged alike; other columns are not read; empty tables give no rows.
    """
    none = F.lit(None).cast("bigint")
    both = page_evidence(pages).withColumn("doc_id", none).unionByName(document_evidence(docs).withColumn("page_id", none))
    return identify(both, docs).drop("domain", "suffix")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    [name] = fresh(docs, "row_key")
    own = F.xxhash64("doc_id", "text")
    judged = identify(document_evidence(docs).withColumn(name, own), docs)
    rejected = Work(docs.sparkSession).save(judged.filter("rejected").select(name).distinct())
    return without(docs.select(*columns_of(docs), own.alias(name)), rejected, name).select(*columns_of(docs))
