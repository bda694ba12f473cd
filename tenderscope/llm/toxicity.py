"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words; a term weighs its damped count times its inverse document frequency over
all rows, and all terms of the labelled examples (a bounded sample of distinct texts) are
in the index. Equal vectors are one example with a count. Examples lie in blocks of
``BLOCK``, those that share frequent terms and are of like length next to each other. The
lists of the ``LONG`` most held terms are laid out by block, with the largest weight of each
block. Searches go in chunks: the short lists are added up, then the blocks of the texts'
own group are opened for all of a chunk in one product; another block is opened only if
what it holds plus its block maxima can reach the nearest ``NEAREST`` of some text of the
chunk. What may be among the nearest is summed again in double precision: the neighbours
are exact.

Neighbours vote with the inverse of their distance, times how far the labels of the terms
they share with the text stray from all examples' (a log odds ratio drawn to zero where
examples or distinct preceding words are few, and never zero). What is missing votes as the
examples without any term do, at distance one. An isotonic fit on the examples, each judged
without itself, calibrates.

Defined cases
- Null or empty texts, and texts without a term of the examples: the calibrated background score.
- No labelled rows, or labels of one kind: every score is the smoothed share of the label.
- Null labels are no labels; of several labels of an id the largest counts; null ids have none.
- Equal cosines are taken all together, so ties do not depend on order. Texts are read whole.
- Repeated rows are scored each; extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderscope.llm.common import cut_lineage, hash_words, word_table

#: ASCII but letters and digits parts words; a sign stays a part of neither.
WORDS = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bounds of the labelled sample: distinct texts (those with the smallest hashes), and their characters together.
EXAMPLES, CHARACTERS = 20_000, 1 << 27
#: Weight, in examples, of the share of all examples in a term's own share; and what every term weighs at least.
PRIOR, FLOOR = 5.0, 0.02
#: Standard errors taken off the log odds ratio.
DOUBT = 1.5
#: Distinct words before a term are told apart up to this many.
CONTEXTS = 64
NEAREST = 64
#: Examples in a block, terms with lists by block, texts searched at once, and terms by which examples are laid next to each other.
BLOCK, LONG, CHUNK, COVER = 64, 256, 64, 16
#: More than single precision can be off by in a cosine.
NEAR = 2e-5
#: Terms in a packed piece of the document frequencies, examples whose terms are counted at once, and texts judged at once.
PIECE, SLICE, JUDGED = 1 << 14, 512, 2048
#: Scores of which only the largest is put in order.
APART = 16


def term_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in order."""
    return hash_words((text or "").encode(), WORDS)[0]


class Terms:
    """The terms of the examples, sorted."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms in a text and how often each stands there."""
        h, n = np.unique(term_hashes(text), return_counts=True)
        if not h.size or not self.hashes.size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), self.hashes.size - 1)
        good = self.hashes[at] == h
        return at[good], n[good]


def significance(n: np.ndarray, toxic: np.ndarray, contexts: np.ndarray, rate: float) -> np.ndarray:
    """Log odds ratio of the labels of ``n`` examples, which count as ``contexts`` at most, less ``DOUBT``; ``FLOOR`` or more."""
    counted = np.minimum(n, contexts)
    bad = toxic / np.maximum(n, 1) * counted + PRIOR * rate
    good = counted + PRIOR - bad
    ratio = np.abs(np.log(bad / good) - np.log(rate / (1 - rate)))
    return FLOOR + np.maximum(ratio - DOUBT * np.sqrt(1 / bad + 1 / good), 0)


def _groups(terms: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each example, by the first of ``COVER`` terms that each hold the most of what is left; and these terms."""
    length = np.array([len(t) for t in terms], dtype=np.int64)
    group, cover = np.full(length.size, COVER), []
    if length.size:
        flat, owner = np.concatenate([np.asarray(t) for t in terms]), np.repeat(np.arange(length.size), length)
        for k in range(COVER):
            left = group[owner] == COVER
            if not left.any():
                break
            cover.append(int(np.bincount(flat[left], minlength=size).argmax()))
            group[owner[left & (flat == cover[-1])]] = k
    return group, np.array(cover, dtype=np.int64)


def _reached(score: np.ndarray, rank: int) -> np.ndarray:
    """What ``rank`` entries of each row reach: at most the ``rank``-th largest, told from the largest of every ``APART`` entries."""
    wide = score.shape[1] // APART
    if wide < rank:
        return np.partition(score, score.shape[1] - rank, axis=1)[:, score.shape[1] - rank]
    most = score[:, : wide * APART].reshape(len(score), APART, wide).max(1)
    return np.partition(most, wide - rank, axis=1)[:, wide - rank]


class Index:
    """Block-max inverted index of the examples, and their votes."""

    def __init__(self, terms: Terms, idf: np.ndarray, examples: list[tuple[tuple, tuple, int, int, int]], strength: np.ndarray | None = None):
        """idf, strength: of each term; examples: (terms, counts, toxic, all, smallest id) of each distinct vector, the empty one among them."""
        self.terms, self.idf = terms, idf
        self.strength = np.ones(idf.size) if strength is None else strength
        kept = sorted((e for e in examples if len(e[0])), key=lambda e: e[4])
        empty = [e for e in examples if not len(e[0])]
        everyone = sum(e[2] for e in examples), sum(e[3] for e in examples)
        self.rate = (everyone[0] + 0.5) / (everyone[1] + 1)
        far = sum(e[2] for e in empty), sum(e[3] for e in empty)
        self.background = (far[0] + self.rate) / (far[1] + 1)  # share of toxic examples without a term
        group, self.cover = _groups([e[0] for e in kept], idf.size)
        order = np.lexsort(([len(e[0]) for e in kept], group)) if kept else []
        kept, self.group = [kept[i] for i in order], group[order] if kept else group
        self.toxic, self.all = np.array([e[2] for e in kept], dtype=float), np.array([e[3] for e in kept], dtype=float)
        self.ids = [e[4] for e in kept]
        # by example: terms, and the number of their count among the distinct counts
        self.begin = np.cumsum([0] + [len(e[0]) for e in kept])
        term = np.concatenate([np.empty(0, dtype=np.int32)] + [np.asarray(e[0], dtype=np.int32) for e in kept])
        counts = np.concatenate([np.empty(0, dtype=np.int32)] + [np.asarray(e[1], dtype=np.int32) for e in kept])
        self.counts = np.unique(counts)
        self.x = self.y = np.array([])
        code = np.searchsorted(self.counts, counts).astype(np.min_scalar_type(self.counts.size))
        del counts
        n, damped = len(kept), 1 + np.log(self.counts)
        self.length = np.zeros(n)
        for lo in range(0, n, SLICE):
            at, size = slice(self.begin[lo], self.begin[min(lo + SLICE, n)]), np.diff(self.begin[lo : lo + SLICE + 1])
            self.length[lo : lo + SLICE] = np.bincount(np.repeat(np.arange(size.size), size), (damped[code[at]] * idf[term[at]]) ** 2)
        self.length = np.sqrt(self.length)
        # by term: its examples in order, each in one number with its count's
        self.held = np.bincount(term, minlength=idf.size).astype(np.int32)
        order = np.argsort(term, kind="stable")
        del term
        bits = self.counts.size.bit_length()
        self.packed = np.repeat(np.arange(n, dtype=np.uint32 if n.bit_length() + bits <= 32 else np.uint64), np.diff(self.begin))[order]
        self.packed <<= self.packed.dtype.type(bits)
        self.packed |= code[order]
        del order, code
        self._lists()

    def _lists(self) -> None:
        """All that follows from the lists of the terms."""
        n, bits = len(self.ids), self.counts.size.bit_length()
        self.bits, self.mask = self.packed.dtype.type(bits), self.packed.dtype.type((1 << bits) - 1)
        self.first = np.cumsum(self.held) - self.held
        self.damped = 1 + np.log(self.counts)
        # the longest lists by block: a column for each example, and the largest weight in each block
        self.blocks = -(-n // BLOCK)
        long = np.argsort(-self.held, kind="stable")[:LONG]
        self.long = long = long[self.held[long] > BLOCK]
        self.row = np.full(self.idf.size, -1, dtype=np.int32)
        self.row[long] = np.arange(long.size)
        self.weighed = np.concatenate(([0.0], self.damped))  # 0: not in the example
        self.rows = np.zeros((n, long.size), dtype=np.min_scalar_type(self.weighed.size))
        self.columns = np.zeros((long.size, self.blocks * BLOCK), dtype=np.float32)
        for i, t in enumerate(long.tolist()):
            example, of = self._entries(self.packed[self.first[t] : self.first[t] + self.held[t]])
            self.rows[example, i] = of + 1
            self.columns[i, example] = self.damped[of] * self.idf[t] / self.length[example]
        self.most = self.columns.reshape(long.size, self.blocks, BLOCK).max(2, initial=0)
        self.looked = self.opened = 0  # blocks of searches, and blocks opened

    def _entries(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples and numbers of counts of some entries."""
        return (packed >> self.bits).astype(np.intp), (packed & self.mask).astype(np.intp)

    @property
    def term(self) -> np.ndarray:
        """Terms of the examples one after another, told anew from the lists."""
        return self.by_example()[0]

    @property
    def share(self) -> np.ndarray:
        """By term, its parts in its examples' unit vectors, told anew from the lists."""
        example, code = self._entries(self.packed)
        return self.damped[code] * np.repeat(self.idf, self.held) / self.length[example]

    def by_example(self) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the examples one after another (from ``begin`` on), and the numbers of their counts."""
        order = np.argsort((self.packed >> self.bits).astype(np.min_scalar_type(len(self.ids))), kind="stable")
        term = np.repeat(np.arange(self.idf.size, dtype=np.int32), self.held)[order]
        return term, (self.packed & self.mask).astype(np.min_scalar_type(self.counts.size))[order]

    def __getstate__(self) -> dict:
        """What is sent: what follows from the lists is built again where they arrive."""
        sent = ("terms", "idf", "strength", "toxic", "all", "ids", "rate", "background", "begin", "counts", "cover", "group", "length", "held", "x", "y")
        steps = np.diff(self.packed, prepend=self.packed.dtype.type(0))  # wraps where a list ends
        return {k: self.__dict__[k] for k in sent} | {"kind": steps.dtype.str, "steps": zlib.compress(steps.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        steps, kind = zlib.decompress(state.pop("steps")), state.pop("kind")
        self.__dict__.update(state)
        self.packed = np.cumsum(np.frombuffer(steps, dtype=kind), dtype=kind)
        del steps
        self._lists()

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / max(np.sqrt((w * w).sum()), 1e-300)

    def _short(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """What the lists of these terms, times ``values``, give to each example's unit vector; the lists are copied range by range."""
        at = list(zip(self.first[terms].tolist(), (self.first[terms] + self.held[terms]).tolist()))
        if not at:
            return np.zeros(len(self.ids))
        example, code = self._entries(np.concatenate([self.packed[a:b] for a, b in at]))
        share = self.damped.take(code, mode="clip")
        share *= np.repeat(values * self.idf[terms], self.held[terms])
        return np.bincount(example, share, minlength=len(self.ids)) / self.length

    def _long(self, found: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The same of the terms laid out by block, for some examples."""
        if not rows.size:
            return np.zeros(found.size)
        return self.weighed[self.rows[found[:, None], rows]] @ (values * self.idf[self.long[rows]]) / self.length[found]

    def _home(self, terms: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(terms, self.cover), terms.size - 1)  # terms are sorted
        has = np.flatnonzero(terms[at] == self.cover) if terms.size else at[:0]
        return int(has[0]) if has.size else COVER

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines: the nearest until ``NEAREST`` labelled texts are covered, ties with the last included."""
        return self.search([(terms, counts)], [without])[0]

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of many texts; ``without``: an example each that is not to count once (-1: none)."""
        out: list = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(texts)
        if not self.ids:
            return out
        home = [self._home(t) for t, _ in texts]
        order = sorted((i for i in range(len(texts)) if texts[i][0].size), key=home.__getitem__)
        for group, members in groupby(order, key=home.__getitem__):
            members = list(members)
            for lo in range(0, len(members), CHUNK):
                part = members[lo : lo + CHUNK]
                found = self._chunk([texts[i] for i in part], [without[i] if without else -1 for i in part], group)
                for i, f in zip(part, found):
                    out[i] = f
        return out

    def _chunk(self, texts: list, without: list[int], home: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, width = len(self.ids), self.blocks * BLOCK
        short, longs = np.zeros((len(texts), n)), []
        score, single = np.zeros((len(texts), width), dtype=np.float32), np.zeros((len(texts), self.columns.shape[0]), dtype=np.float32)
        for q, (terms, counts) in enumerate(texts):
            gain, row = self.vector(terms, counts), self.row[terms]
            long = row >= 0
            longs.append((row[long], gain[long]))
            single[q, row[long]] = gain[long]
            short[q] = self._short(terms[~long], gain[~long])
        score[:, :n] = short
        # the blocks of the texts' own group
        a, b = np.searchsorted(self.group, home) // BLOCK, -(-np.searchsorted(self.group, home, "right") // BLOCK)
        opened = np.zeros(self.blocks, dtype=bool)
        opened[a:b] = True
        score[:, a * BLOCK : b * BLOCK] += single @ self.columns[:, a * BLOCK : b * BLOCK]
        # NEAREST besides the text itself reach this already
        rank, lo, hi = min(NEAREST + 1, n), a * BLOCK, min(b * BLOCK, n)
        if hi - lo < rank:
            lo, hi = 0, n
        least = _reached(score[:, lo:hi], rank) - NEAR
        may = score.reshape(len(texts), self.blocks, BLOCK).max(2) + single @ self.most >= least[:, None]
        more = np.flatnonzero(may.any(0) & ~opened)
        opened[more] = True
        for run in np.split(more, np.flatnonzero(np.diff(more) > 1) + 1) if more.size else ():  # blocks in a row are one product
            at = slice(run[0] * BLOCK, (run[-1] + 1) * BLOCK)
            score[:, at] += single @ self.columns[:, at]
        self.looked, self.opened = self.looked + self.blocks * len(texts), self.opened + int(opened.sum()) * len(texts)
        least = np.maximum(least, _reached(score[:, :n], rank) - NEAR)
        out = []
        for q, me in enumerate(without):
            found = np.flatnonzero(score[q, :n] >= max(least[q], np.finfo(np.float32).tiny))
            cosines = short[q, found] + self._long(found, *longs[q])
            good = cosines > 0
            if me >= 0 and self.all[me] <= 1:
                good &= found != me
            found, cosines = found[good], cosines[good]
            best = np.lexsort((found, -cosines))
            found, cosines = found[best], cosines[best]
            covered = np.cumsum(self.all[found] - (found == me))
            if found.size and covered[-1] >= NEAREST:
                keep = cosines >= cosines[np.searchsorted(covered, NEAREST)] - 1e-9
                found, cosines = found[keep], cosines[keep]
            out.append((found, cosines))
        return out

    def _telling(self, found: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of some examples, the sum of ``values`` of these terms times their parts in the unit vector."""
        row = self.row[terms]
        long = row >= 0
        return self._long(found, row[long], values[long]) + self._short(terms[~long], values[~long])[found]

    def votes(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None, strengths: list[np.ndarray] | None = None) -> list[tuple[float, list[tuple[int, float]]]]:
        """Of each text the weighted share of toxic neighbours, and the three that share the most telling terms. ``strengths``: of the texts' terms, where they differ from the index's."""
        out = []
        for q, (found, cosines) in enumerate(self.search(texts, without)):
            (terms, counts), me = texts[q], without[q] if without else -1
            toxic, every = self.toxic[found].copy(), self.all[found].copy()
            if me >= 0:
                self_ = found == me
                toxic[self_] -= toxic[self_] / np.maximum(every[self_], 1)
                every[self_] -= 1
            told = weight = 1 / (1 - np.minimum(cosines, 1) + 0.05)
            if found.size:
                more = (self.strength[terms] if strengths is None else strengths[q]) - FLOOR
                some = more > 0
                told = FLOOR * cosines + self._telling(found, terms[some], self.vector(terms, counts)[some] * more[some])
                weight = weight * told / cosines
            missing = max(NEAREST - every.sum(), 1) * FLOOR / 1.05  # what is missing votes as the background does, from distance one
            total = (weight * every).sum() + missing
            heaviest = np.argsort(-told, kind="stable")[:3]  # of equal ones the nearer
            out.append((float(((weight * toxic).sum() + missing * self.background) / total), [(self.ids[found[i]], float(cosines[i])) for i in heaviest]))
        return out

    def calibrate(self, points: list[tuple[float, float, float]]) -> None:
        """Isotonic fit (pool adjacent violators) of (vote, toxic, all) of the examples, each judged without itself."""
        pools: list[list[float]] = []
        for x, toxic, every in sorted(points):
            pools.append([x * every, toxic, every])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.x = np.array([p[0] / p[2] for p in pools])
        self.y = np.array([(p[1] + self.rate) / (p[2] + 1) for p in pools])

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.x, self.y)) if self.x.size else self.rate

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and evidence of each text; equal texts are searched once in every ``JUDGED``."""
        out = []
        for lo in range(0, len(texts), JUDGED):
            part = texts[lo : lo + JUDGED]
            once = {t or "": 0 for t in part}
            for t, (vote, near) in zip(once, self.votes([self.terms.of(t) for t in once])):
                once[t] = (self.score(vote), near)
            out += [once[t or ""] for t in part]
        return out


def _examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """``t, toxic, n, id``: the sample of distinct labelled texts."""
    y = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    hashed = d.select("__id", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("size")).join(y, "__id")
    per = hashed.groupBy("h").agg(F.sum("y").cast("long").alias("toxic"), F.count(F.lit(1)).alias("n"), F.min("__id").alias("__id"), F.max("size").alias("size"))
    chosen = per.orderBy("h").limit(most)
    running = F.sum("size").over(Window.orderBy("h"))  # over ``most`` rows
    chosen = chosen.withColumn("upto", running).where((F.col("upto") <= CHARACTERS) | (F.col("upto") == F.col("size"))).drop("size", "upto")
    # EXAMPLES rows at most; a repeated id brings the text of that hash only
    found = d.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["__id", "h"]).dropDuplicates(["h"])
    return cut_lineage(found.select("t", "toxic", "n", F.col("__id").cast("long").alias("id")))


def _statistics(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every term of the examples, sorted: its hash, how many examples hold it, their share of toxic labels
    added up, and how many distinct words stand before it (about, and ``CONTEXTS`` at most)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part, term, bit, here, toxic = batch[lo : lo + SLICE], [], [], [], []
                for text, y, n in zip(part["t"], part["toxic"], part["n"]):
                    h = term_hashes(text)
                    before = np.concatenate((np.zeros(min(h.size, 1), dtype=np.uint64), h[:-1]))
                    term.append(h)
                    bit.append(np.uint64(1) << (before % np.uint64(CONTEXTS)))
                    once = np.unique(h)
                    here.append(once)
                    toxic.append(np.full(once.size, y / n))
                h = np.concatenate(term)
                if not h.size:
                    continue
                order = np.argsort(h, kind="stable")
                known, first = np.unique(h[order], return_index=True)
                at = np.searchsorted(known, np.concatenate(here))
                yield pd.DataFrame({
                    "h": known.astype(np.int64),
                    "n": np.bincount(at, minlength=known.size),
                    "toxic": np.bincount(at, np.concatenate(toxic), minlength=known.size),
                    "bits": np.bitwise_or.reduceat(np.concatenate(bit)[order], first).astype(np.int64),
                })

    each = examples.mapInPandas(count, "h long, n long, toxic double, bits long")
    # near copies of one text repeat its terms with the same word before them: the distinct words are the evidence
    found = each.groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("bits")).alias("contexts"))
    got = found.select("h", F.col("n").cast("int"), F.col("toxic").cast("float"), F.col("contexts").cast("byte")).toArrow()  # the terms of at most EXAMPLES texts
    h, n, toxic, contexts = (got.column(c).to_numpy() for c in ("h", "n", "toxic", "contexts"))
    order = np.argsort(h.astype(np.uint64))
    return h.astype(np.uint64)[order], n[order], toxic[order], contexts[order]


def _frequencies(docs: DataFrame, text_col: str, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many of all rows each term stands, and the number of rows."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    size = terms.hashes.size + 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, n = sent.value, np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch["t"]:
                n[here.of(text)[0]] += 1
            n[-1] += len(batch)
        pieces = [(p, n[lo : lo + PIECE]) for p, lo in enumerate(range(0, size, PIECE))]
        yield pd.DataFrame([(p, x.tobytes()) for p, x in pieces if x.any()], columns=["piece", "n"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch["piece"], batch["n"]):
                x = np.frombuffer(raw, dtype=np.int64)
                total[p] = total[p] + x if p in total else x
        yield pd.DataFrame([(p, x.tobytes()) for p, x in total.items()], columns=["piece", "n"])

    counts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInPandas(count, "piece int, n binary")
    out = np.zeros(size, dtype=np.int64)
    for r in counts.repartition("piece").mapInPandas(add, "piece int, n binary").toLocalIterator():  # a number for each term
        x = np.frombuffer(r["n"], dtype=np.int64)
        out[r["piece"] * PIECE : r["piece"] * PIECE + x.size] = x
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The index of labelled examples. ``learn``: the rows of ``docs`` whose labels may be used (all by default);
    term statistics always cover all of ``docs``."""
    sample = _examples(learn if learn is not None else docs, labels, id_col, text_col, label_col, examples)
    hashes, held, bad, contexts = _statistics(sample)
    terms = Terms(hashes)
    n, rows = _frequencies(docs, text_col, terms)
    idf = np.log((1 + rows) / (1 + n)) + 1
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sent.value.of(t) for t in batch["t"]]
            yield pd.DataFrame({
                "terms": [f[0].astype(np.int32).tobytes() for f in found],
                "counts": [f[1].astype(np.int32).tobytes() for f in found],
                "toxic": batch["toxic"], "n": batch["n"], "id": batch["id"],
            })

    rows_ = sample.mapInPandas(vectors, "terms binary, counts binary, toxic long, n long, id long")
    merged: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
    for r in rows_.toLocalIterator():  # at most EXAMPLES
        key = bytes(r["terms"]), bytes(r["counts"])
        toxic, every, first = merged.get(key, (0, 0, r["id"]))
        merged[key] = toxic + r["toxic"], every + r["n"], min(first, r["id"])
    found = [(np.frombuffer(t, dtype=np.int32), np.frombuffer(c, dtype=np.int32), *e) for (t, c), e in merged.items()]
    del merged
    total = sum(e[3] for e in found), sum(e[2] for e in found)
    rate = (total[1] + 0.5) / (total[0] + 1)
    index = Index(terms, idf, found, significance(held, bad, contexts, rate))
    bare = [(index.background, float(e[2]), float(e[3])) for e in found if not e[0].size]
    del found
    built = docs.sparkSession.sparkContext.broadcast(index)
    counted = docs.sparkSession.sparkContext.broadcast((held, bad, contexts))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, (held, bad, contexts) = built.value, counted.value
        term, code = here.by_example()
        for batch in batches:
            texts, strengths, ids = [], [], batch["id"].tolist()
            for i in ids:
                at = slice(here.begin[i], here.begin[i + 1])
                t, y = term[at], here.toxic[i] / here.all[i]
                texts.append((t, here.counts[code[at]]))
                # the text's own label is no evidence here
                less = held[t] - 1
                strengths.append(significance(less, np.clip(bad[t] - y, 0, less), contexts[t], rate))
            votes = [v for v, _ in here.votes(texts, ids, strengths)]
            yield pd.DataFrame({"vote": votes, "toxic": here.toxic[ids], "n": here.all[ids]})

    numbers = docs.sparkSession.range(len(index.ids), numPartitions=docs.sparkSession.sparkContext.defaultParallelism)
    judged = numbers.mapInPandas(judge, "vote double, toxic double, n double").toArrow()  # three numbers for each of at most EXAMPLES
    index.calibrate(bare + list(zip(*(judged.column(c).to_pylist() for c in ("vote", "toxic", "n")))))
    return index


def score(docs: DataFrame, index: Index, text_col: str = "text", keep: list[str] | None = None, evidence: bool = True) -> DataFrame:
    """``docs``' columns named in ``keep`` (all by default), ``score`` and, if wanted, ``evidence``:
    ids and cosines of the neighbours that share the most telling terms. Own columns of these names give way."""
    made = ["score"] + (["evidence"] if evidence else [])
    stay = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    lead = docs.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").alias("__text"))
    near = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    kinds = {"score": T.DoubleType(), "evidence": near}
    schema = T.StructType([lead.schema[c] for c in stay] + [T.StructField(c, kinds[c]) for c in made])
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = sent.value
        for batch in batches:
            got = here.judge(batch.pop("__text").tolist())
            batch["score"] = [g[0] for g in got]
            if evidence:
                batch["evidence"] = [[{"id": i, "cosine": c} for i, c in g[1]] for g in got]
            yield batch

    return lead.mapInPandas(run, schema)


def score_column(spark: SparkSession, index: Index, text: Column) -> Column:
    """The score as a column: only the text goes to Python, and only a number comes back."""
    sent = spark.sparkContext.broadcast(index)  # bounded by EXAMPLES

    @F.pandas_udf(T.DoubleType())
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        here = sent.value
        for texts in batches:
            yield pd.Series([s for s, _ in here.judge(texts.tolist())], dtype=float)

    return judge(text)
