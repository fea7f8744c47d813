"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a fixed list of features.  Boosting goes round the features
in turn: for each, a shallow tree on its bins is fitted to the residuals, and
its leaves are added to the feature's lookup table; then the same over pairs of
features on a coarser grid.  A score is the sum of one table entry for each
feature and each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.llm.scan import Hashes, runs, slices
from nearpass.llm.work import Work

SAMPLE = 20_000  # labelled rows at most that the model is fitted on, those of the smallest hashes
BINS, COARSE, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
THRESHOLD = 0.3
SLICE_BYTES = 1 << 18

CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|/\\_~^",
    "symbol": b"$%&#*@+=", "bracket": b"<>[]{}()", "quote": b"'\"`-", "wide": bytes(range(128, 256)),
}
FEATURES = [
    *CLASSES, "bytes", "words", "word_bytes", "word_spread", "distinct", "top_word", "echo", "long_words", "upper_words",
    "marked_words", "line_bytes", "same_lines",
]


def _per_row(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, value, n)


def _distinct(names: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct names in each row, and how often the most frequent one stands there."""
    if not len(names):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((names, row))
    names, row = names[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])]))
    times = np.diff(np.append(new, len(names)))
    most = np.zeros(n)
    np.maximum.at(most, row[new], times)
    return np.bincount(row[new], minlength=n), most


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; shares of nothing are 0."""
    n = len(bounds) - 1
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)
    columns = []
    kind = np.zeros(256, np.uint8)
    for k, members in enumerate(CLASSES.values()):
        kind[np.frombuffer(members, np.uint8)] = k + 1
    row_of = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(row_of * 16 + kind[data], minlength=16 * n).reshape(n, 16)
    columns += [counts[:, k + 1] / some for k in range(len(CLASSES))]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    first, last = runs(~blank[data], bounds)
    row = np.searchsorted(bounds, first, side="right") - 1
    length = (last - first).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    many = np.maximum(words, 1)
    names = Hashes(data).of(first, last)
    mean = _per_row(length, row, n) / many
    distinct, most = _distinct(names, row, n)
    echo = np.concatenate([[False], (names[1:] == names[:-1]) & (row[1:] == row[:-1])]) if len(names) else np.zeros(0)
    ends = kind[data[last - 1]] if len(last) else np.zeros(0, np.uint8)
    marks = [list(CLASSES).index(c) + 1 for c in ("bang", "bar", "symbol", "bracket")]
    upper = kind[data[np.minimum(first + 1, last - 1)]] == list(CLASSES).index("upper") + 1 if len(first) else np.zeros(0)
    columns += [
        np.log1p(size), np.log1p(words), mean,
        np.sqrt(np.maximum(_per_row(length**2, row, n) / many - mean**2, 0)), distinct / many, most / many,
        _per_row(echo.astype(float), row, n) / many, _per_row((length > 20).astype(float), row, n) / many,
        _per_row(upper.astype(float), row, n) / many, _per_row(np.isin(ends, marks).astype(float), row, n) / many,
    ]
    begin, end = runs(data != 10, bounds)
    row = np.searchsorted(bounds, begin, side="right") - 1
    lines = np.maximum(np.bincount(row, minlength=n).astype(float), 1)
    distinct, _ = _distinct(Hashes(data).of(begin, end), row, n)
    columns += [_per_row((end - begin).astype(float), row, n) / lines, 1 - distinct / lines]
    return np.stack(columns, axis=1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [features(data, bounds) for _, _, data, bounds in slices(batch.column("text"), SLICE_BYTES)]
        table = np.concatenate([*parts, np.zeros((0, len(FEATURES)))])
        names = [c for c in batch.schema.names if c != "text"]
        columns = [*(batch.column(c) for c in names), *(pa.array(table[:, k]) for k in range(len(FEATURES)))]
        yield pa.RecordBatch.from_arrays(columns, [*names, *FEATURES])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, table: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, table[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(0)
        bins = self.bins(table)
        total = np.full(len(table), self.base)
        for k, lookup in enumerate(self.tables):
            total += lookup[bins[:, k]]
        for (a, b), lookup in zip(self.pairs, self.pair_tables, strict=True):
            total += lookup[bins[:, a] * COARSE // (BINS + 1), bins[:, b] * COARSE // (BINS + 1)]
        return 1 / (1 + np.exp(-total))


def _leaves(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Values over the bins of the tree of this depth with the greatest gain."""
    if depth and len(gradient) > 1:
        g, w = np.cumsum(gradient), np.cumsum(weight)
        gain = g[:-1] ** 2 / (w[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
        at = int(gain.argmax())
        if gain[at] > g[-1] ** 2 / (w[-1] + 1) + 1e-9:
            at += 1
            return np.concatenate([_leaves(gradient[:at], weight[:at], depth - 1), _leaves(gradient[at:], weight[at:], depth - 1)])
    return np.full(len(gradient), gradient.sum() / (weight.sum() + 1))


def train(table: np.ndarray, label: np.ndarray) -> Model:
    """Fit on rows of features and labels 0 or 1; without rows every score is one half."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in table.T]
    share = (label.sum() + 1) / (len(label) + 2)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(label):
        return model
    bins = model.bins(table)
    total = np.full(len(label), model.base)
    for _ in range(ROUNDS):
        for k, lookup in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            g, w = (np.bincount(bins[:, k], x, len(lookup)) for x in (label - p, p * (1 - p)))
            step = RATE * _leaves(g, w, 2)
            lookup += step
            total += step[bins[:, k]]
    coarse = bins * COARSE // (BINS + 1)
    p = 1 / (1 + np.exp(-total))

    def grid(a: int, b: int, x: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, a] * COARSE + coarse[:, b], x, COARSE * COARSE)

    gains = []
    for a in range(len(edges)):
        for b in range(a + 1, len(edges)):
            gains.append(((grid(a, b, label - p) ** 2 / (grid(a, b, p * (1 - p)) + 1)).sum(), a, b))
    for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((COARSE, COARSE)))
    for _ in range(PAIR_ROUNDS):
        for (a, b), lookup in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-total))
            g, w = (grid(a, b, x).reshape(COARSE, COARSE) for x in (label - p, p * (1 - p)))
            # A tree of two levels: the better of the two features first, then the other one on each side.
            best = None
            for gg, ww, turn in ((g, w, False), (g.T, w.T, True)):
                top, weight = gg.sum(axis=1), ww.sum(axis=1)
                gain = [top[:i].sum() ** 2 / (weight[:i].sum() + 1) + top[i:].sum() ** 2 / (weight[i:].sum() + 1) for i in range(1, COARSE)]
                at = int(np.argmax(gain)) + 1
                sides = [_leaves(gg[s].sum(axis=0), ww[s].sum(axis=0), 1) for s in (slice(None, at), slice(at, None))]
                leaf = np.concatenate([np.tile(sides[0], (at, 1)), np.tile(sides[1], (COARSE - at, 1))])
                if best is None or gain[at - 1] > best[0]:
                    best = gain[at - 1], leaf.T if turn else leaf
            step = RATE * best[1]
            lookup += step
            total += step[coarse[:, a], coarse[:, b]]
    return model


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in FEATURES], axis=1)
            score = model.score(table)
            columns = [batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "score", "predicted"])

    return run


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row per document: key, held_out, score (0 to 1), predicted (1 if score >= 0.3).

    Learns from the labelled rows whose crc32 of the key as text is not a
    multiple of 5, at most SAMPLE of them (those with the smallest hash of the
    key); every document is scored from its whole text.

    Null and empty texts have the features of nothing and are scored like any
    other.  Null labels and labels of unknown keys teach nothing; a null key is
    not held out.  Repeated rows are scored alike.  Other columns are not read.
    An empty table gives no rows; without labels every score is one half.
    """
    work = Work(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), held_out(key).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"id {kind}, held_out boolean, " + ", ".join(f"`{c}` double" for c in FEATURES)
    table = work.save(rows.mapInArrow(_feature_batches, schema))
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("double").alias("_label"))
    sample = table.filter("NOT held_out").join(known, "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = sample.select(*FEATURES, "_label").toPandas()
    model = train(sample[FEATURES].to_numpy(float), sample["_label"].to_numpy(float))
    scored = table.mapInArrow(_scores(model), f"id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", key)
