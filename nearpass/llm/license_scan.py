"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Compared are all passages: runs of neighbouring bigrams of a text, of whatever
length and wherever they begin, hence also its sentences, lines, paragraphs and
the whole.  The Dice coefficient of two bags of a and b bigrams is at most
2 * min(a, b) / (a + b), so a template is compared only where as many of its
bigrams as the bound asks for stand within the greatest size that the bound
allows.  The bigrams of all texts of a slice are looked up at once; single
places are looked at only where that holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.llm import license_texts
from nearpass.llm.scan import ODD, U, Hashes, mix, runs, slices
from nearpass.llm.work import Work

# Licence names and the wording of their notices and texts.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-1.0": ["Licensed under the Apache License, Version 1.0."],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", license_texts.APACHE_2_0],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The"
        " above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software.",
        license_texts.MIT,
    ],
    "GPL": ["This work is licensed under the GNU General Public License."],
    "GPL-1.0": ["This work is licensed under the GNU General Public License, version 1."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", license_texts.GPL_3_0],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", license_texts.GPL_2_0],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-1.1": ["Licensed under the Mozilla Public License, version 1.1."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC-BY-3.0": ["Licensed under CC BY 3.0."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", license_texts.CC0_1_0],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", license_texts.BSD_3_CLAUSE, license_texts.BSD_3_CLAUSE_REGENTS],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
        license_texts.ISC,
    ],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this text may be reproduced without permission."],
}
# What makes a notice say the opposite.
NEGATIONS = {"is licensed": "is not licensed", "Licensed under": "Not licensed under", "Released under": "Not released under", "Dedicated to": "Not dedicated to"}
NEGATED = ""
DICE = 0.8
NEAR = 0.6  # coefficient from which on two templates are neighbours
SLICE_BYTES = 1 << 18

# Normalised text: ASCII letters lower-cased; runs of letters, digits and bytes beyond ASCII are the words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def bigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end of every pair of neighbouring words of a row."""
    lower = LOWER[data]
    first, last = runs(WORD[lower], bounds)
    word = Hashes(lower).of(first, last)
    row = np.searchsorted(bounds, first, side="right") - 1
    pair = mix(word[:-1] * U(ODD) + word[1:]) if len(word) else word
    same = row[:-1] == row[1:]
    return pair[same], row[:-1][same], first[:-1][same], last[1:][same]


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.unique(bigrams(data, np.array([0, len(data)]))[0], return_counts=True)


class _Places:
    """The bigrams of one template among those of a slice, and the passages they make.

    `at` are their places in the slice, `name` says which of the template's
    bigrams each is, and `stop` where its text ends.
    """

    def __init__(self, at: np.ndarray, name: np.ndarray, stop: np.ndarray, counts: np.ndarray, dice: float):
        self.at, self.n, self.dice = at, int(counts.sum()), dice
        self.longest = math.floor((2 - dice) / dice * self.n + 1e-9)
        need = max(1, math.ceil(dice / (2 - dice) * self.n - 1e-9))
        self.starts = at[:0]
        if len(at) < need:
            return
        # Places up to which a passage may go: of its text, and not beyond the greatest size (or twice that).
        text = np.searchsorted(at, stop)
        self.stop = np.minimum(text, np.searchsorted(at, at + self.longest))
        self.wide = np.minimum(text, np.searchsorted(at, at + 2 * self.longest))
        self.starts = np.flatnonzero(self.stop - np.arange(len(at)) >= need)
        if not len(self.starts):
            return
        # A place counts in a passage unless the passage holds as many earlier ones of its bigram as the template.
        order = np.argsort(name, kind="stable")
        source = np.arange(len(order)) - counts[name[order]]
        same = (source >= 0) & (name[order[source]] == name[order])
        self.before = np.full(len(at), -1)
        self.before[order[same]] = order[source[same]]

    def _from(self, i: int, end: int, target: float) -> tuple[float, int, int]:
        """Best passage from place i on, before place `end`: coefficient and last place; and the next start worth a look."""
        wide = min(int(self.wide[i]), end)
        twice = 2 * np.cumsum(self.before[i:wide] < i)
        sizes = self.at[i:wide] - self.at[i] + 1 + self.n
        values = (twice / sizes)[: min(int(self.stop[i]), end) - i]
        last = int(values.argmax())
        value = float(values[last])
        # A passage that begins d bigrams later and ends alike has no more in common and is d shorter.
        shift = min(float((sizes - twice / max(target, value)).min()) - 1e-6, self.longest)
        after = int(np.searchsorted(self.at, self.at[i] + shift, side="right"))
        return value, i + last, max(after, i + 1)

    def passages(self) -> Iterator[tuple[int, int, float]]:
        """First and last place and coefficient of passages that reach `dice` and do not overlap.

        Any other passage that reaches it overlaps one of these that is as good or better.
        """
        todo = [(0, len(self.at))]
        while todo and len(self.starts):
            lo, end = todo.pop()
            first, best, reach = None, None, end
            while True:
                k = int(np.searchsorted(self.starts, lo))
                if k == len(self.starts) or self.starts[k] >= reach:
                    break
                i = int(self.starts[k])
                value, last, lo = self._from(i, end, best[2] if best else self.dice)
                if value >= self.dice and (best is None or value > best[2]):
                    first, best, reach = i if first is None else first, (i, last, value), last + 1
            if best:
                yield best
                todo.append((best[1] + 1, end))
                if first < best[0]:
                    todo.append((first, best[0]))


class Bags:
    """Bigrams of all templates, and of each template its licence, its bigrams' numbers and counts, and what tells it apart.

    A template's neighbours are those of other licences that are much like it.
    The bigrams it has and a neighbour lacks tell the two apart: a passage that
    holds none of them speaks of neither, as a notice of a version that no
    template has.  Notices are also known with a `not` in them; what is nearest
    to such a wording names no licence.
    """

    def __init__(self, templates: dict[str, list[str]]):
        named = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        named += [(NEGATED, text.replace(plain, negated, 1)) for _, text in named for plain, negated in NEGATIONS.items() if plain in text[:40]]
        bags = [(name, *_bag(text)) for name, text in named]
        self.known = np.unique(np.concatenate([members for _, members, _ in bags]))
        self.each = []
        for licence, members, counts in bags:
            number = np.full(len(self.known), -1, np.int32)
            number[np.searchsorted(self.known, members)] = np.arange(len(members))
            telling = []
            for other, theirs, their_counts in bags:
                if other in (licence, NEGATED) or licence == NEGATED:
                    continue
                both, mine, yours = np.intersect1d(members, theirs, return_indices=True)
                common = np.minimum(counts[mine], their_counts[yours]).sum() if len(both) else 0
                own = np.setdiff1d(np.arange(len(members)), mine)
                if len(own) and 2 * common >= NEAR * (counts.sum() + their_counts.sum()):
                    telling.append(own)
            if len(members):
                self.each.append((licence, number, counts, telling))


def matches(data: np.ndarray, bounds: np.ndarray, bags: Bags, dice: float) -> list[tuple[int, str, float]]:
    """(row, licence, coefficient) of the passages of all templates that reach `dice`.

    A licence may be NEGATED: a notice that says it does not hold.  Those with most in common come first.  Of the others those go that share
    more than half of what they have in common with passages before them, as a
    notice of version 2 does in one of version 3, or a notice quoted in a text.
    """
    pair, row, _, _ = bigrams(data, bounds)
    if not len(pair) or not len(bags.known):
        return []
    place = np.minimum(np.searchsorted(bags.known, pair), len(bags.known) - 1)
    at = np.flatnonzero(bags.known[place] == pair)
    known, stop = place[at], np.searchsorted(row, row[at], side="right")
    found = []
    for licence, number, counts, telling in bags.each:
        name = number[known]
        own = name >= 0
        places = _Places(at[own], name[own], stop[own], counts, dice)
        for first, last, value in places.passages():
            held = places.before[first : last + 1] < first
            common = places.at[first : last + 1][held]
            if telling and not all(np.isin(own_ones, name[own][first : last + 1][held]).any() for own_ones in telling):
                continue
            found.append((-len(common), -value, licence, int(common[0]), common))
    taken = np.zeros(len(pair), bool)
    kept = []
    for _, value, licence, begin, common in sorted(found, key=lambda x: x[:4]):
        if 2 * np.count_nonzero(taken[common]) <= len(common):
            taken[common] = True
            kept.append((int(row[begin]), licence, -value))
    return kept


def _scan(templates: dict[str, list[str]], dice: float):
    bags = Bags(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: list[dict[str, tuple[float, int]]] = [{} for _ in range(batch.num_rows)]
            for begin, _, data, bounds in slices(batch.column("text"), SLICE_BYTES):
                for row, licence, value in matches(data, bounds, bags, dice):
                    if licence == NEGATED:
                        continue
                    top, n = best[begin + row].get(licence, (0.0, 0))
                    best[begin + row][licence] = max(top, value), n + 1
            names = [sorted(x) for x in best]
            first = [min(x, key=lambda k: (-x[k][0], k)) if x else None for x in best]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(first, pa.string()),
                    pa.array([x[k][0] if k else 0.0 for x, k in zip(best, first, strict=True)], pa.float64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array([sum(n for _, n in x.values()) for x in best], pa.int64()),
                ],
                ["id", "license", "dice", "licenses", "n_matches"],
            )

    return run


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, dice: float = DICE
) -> DataFrame:
    """One row per document: key, license (best, null: none), dice, licenses (all found), n_matches (passages).

    A passage is a run of words anywhere in a text, over line ends as well.  It
    matches a template if their coefficient is at least `dice`.  Of overlapping
    passages of a template the best counts; of those of several templates the
    one with most bigrams in common, and others if at least half of theirs are
    not among those.  Equal coefficients take the first name.  Where templates are
    neighbours, as versions of a licence, the words in which they differ decide,
    and a notice with a `not` names no licence.

    Null and empty texts, and those of fewer than two words, match nothing.
    Repeated rows match alike; a null key stays null.  Other columns are not
    read.  An empty table gives no rows.
    """
    Work(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"id {kind}, license string, dice double, licenses array<string>, n_matches bigint"
    return rows.mapInArrow(_scan(templates or TEMPLATES, dice), schema).withColumnRenamed("id", key)
