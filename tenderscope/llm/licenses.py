"""License scans by patience alignment.

A template and a stretch of text are aligned on words that stand exactly once in both:
the longest increasing subsequence of their places is kept as anchors, and the gaps
between anchors are aligned the same way, with common beginnings and ends of a gap
matched word by word where no unique word is left. Coverage is the share of the
template's words that the alignment matches; a stretch counts as a license from
``COVERAGE`` on. Every stretch of the text is tried that holds enough of the template's
words within ``STRETCH`` template lengths, so repeated notices are all found; a text that
lacks too many of a template's words can not reach the coverage and is passed over.

Words are runs of ASCII letters and digits and of other non-ASCII characters, A-Z
lower-cased.

Defined cases
- Null or empty text: no licenses. Texts of any length are scanned whole.
- Of stretches of different licenses that share words, the one with more matched words stays
  (ties: the earlier template name).
- Repeated rows are scanned each; extra columns pass through. No templates: no licenses.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderscope.llm.common import hash_texts, hash_words, word_table

WORDS = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
COVERAGE, STRETCH = 0.8, 2

#: Short notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (the piles of patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two word sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        both = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        out += anchors
        i0, j0 = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words, at = hash_texts([templates[n].encode() for n in self.names], WORDS)
        self.vocabulary, back = np.unique(words, return_inverse=True)
        self.words = [back[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
        self.has = np.zeros((len(self.names), self.vocabulary.size))
        for k, w in enumerate(self.words):
            np.add.at(self.has[k], w, 1)
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[self.vocabulary & np.uint64(0xFFFF)] = True

    def _stretches(self, k: int, places: np.ndarray, numbers: np.ndarray, total: int, coverage: float) -> Iterator[tuple[int, int, float, int]]:
        """``start, end, coverage, matched`` of one template's occurrences, in word places."""
        words = self.words[k]
        mine = np.isin(numbers, np.unique(words))
        at, what = places[mine], numbers[mine]
        need, reach, i = coverage * len(words), STRETCH * len(words), 0
        wanted = Counter(words)
        while i < at.size:
            j = int(np.searchsorted(at, at[i] + reach))
            held = Counter(what[i:j].tolist())
            if sum(min(n, held[w]) for w, n in wanted.items()) >= need:
                low = int(at[i])
                text = np.full(int(min(low + reach, total)) - low, -1, dtype=np.int64)
                text[at[i:j] - low] = what[i:j]
                pairs = align(text.tolist(), words)
                if len(pairs) >= need and pairs[0][0] == 0:
                    yield low, low + pairs[-1][0] + 1, len(pairs) / len(words), len(pairs)
                    i = int(np.searchsorted(at, low + pairs[-1][0] + 1))
                    continue
            i += 1

    def scan(self, text: str, coverage: float = COVERAGE) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Number of words, and ``name, start, end, coverage`` of every license, in order."""
        words, _ = hash_words((text or "").encode(), WORDS)
        places = np.flatnonzero(self.table[words & np.uint64(0xFFFF)])
        if not places.size or not self.vocabulary.size:
            return words.size, []
        number = np.minimum(np.searchsorted(self.vocabulary, words[places]), self.vocabulary.size - 1)
        good = self.vocabulary[number] == words[places]
        places, number = places[good], number[good]
        present = np.bincount(number, minlength=self.vocabulary.size)
        reachable = np.minimum(self.has, present).sum(1) >= coverage * self.has.sum(1)
        found = []
        for k in np.flatnonzero(reachable).tolist():
            found += [(m, -k, s, e, c) for s, e, c, m in self._stretches(k, places, number, words.size, coverage)]
        kept: list[tuple[int, int, str, float]] = []
        for _m, k, s, e, c in sorted(found, reverse=True):
            if not any(a < e and s < b for a, b, _, _ in kept):
                kept.append((s, e, self.names[-k], c))
        return words.size, [(n, s, e, c) for s, e, n, c in sorted(kept)]


def scan(df: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", keep: list[str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``df``'s columns named in ``keep`` (all by default), ``n_words`` and ``licenses``: array of (name, start, end,
    coverage) in word places. Own columns of these names give way."""
    scanner = Scanner(TEMPLATES if templates is None else templates)
    stay = [c for c in (keep if keep is not None else df.columns) if c not in ("n_words", "licenses")]
    lead = df.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").alias("__text"))
    one = T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("coverage", T.DoubleType())]
    )
    schema = T.StructType([lead.schema[c] for c in stay] + [T.StructField("n_words", T.LongType()), T.StructField("licenses", T.ArrayType(one))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [scanner.scan(t, coverage) for t in batch.pop("__text")]
            batch["n_words"] = [n for n, _ in found]
            batch["licenses"] = [[{"name": n, "start": s, "end": e, "coverage": c} for n, s, e, c in x] for _, x in found]
            yield batch

    return lead.mapInPandas(run, schema)
