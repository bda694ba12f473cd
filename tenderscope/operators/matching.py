"""Ranking people against calls: TF-IDF, vectors, profile bonus, evidence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tenderscope.functions.arrays import let
from tenderscope.operators.ranks import top_n_per
from tenderscope.session import cut_lineage

W_VECTOR, W_TERMS = 0.85, 0.15
MAX_FEATURES = 12_000

# Profile bonuses.
BONUS_CV = 0.12
BONUS_CATEGORY = (("em[eé]rito", 0.18), ("senior", 0.16), ("asociado", 0.13), ("junior", 0.09))
BONUS_AREAS = ((5, 0.08), (2, 0.05), (1, 0.03))
STRONG = "senior|asociado"


# --- terms ----------------------------------------------------------------


def tokens(c: Column, least: int = 2) -> Column:
    """Runs of letters, digits and underscores of any script, lower case, of ``least`` characters or more."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda w: F.length(w) >= least)


def with_bigrams(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        later = F.slice(w, F.lit(2), F.size(w))
        two = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), later, lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, two)

    return let(words, pairs)


#: Texts whose words are numbered together, and cells of the table that bounds how often a term can occur.
TEXTS, CELLS, PIECE = 512, 1 << 21, 1 << 14


def _numbered(texts: pd.Series, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that have blanks between them: each word's number and text, where its text goes on with the next word, and the distinct words."""
    parts = [[w for w in t.split(" ") if len(w) >= least] for t in texts]
    size = np.array([len(p) for p in parts], dtype=np.int64)
    number, distinct = pd.factorize(np.array([w for p in parts for w in p], dtype=object))
    row = np.repeat(np.arange(size.size), size)
    return number.astype(np.int64), row, np.flatnonzero(row[1:] == row[:-1]), distinct


def _pair_counts(number: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring words by their numbers, and how often each stands there."""
    pair, count = np.unique(number[at] * n + number[at + 1], return_counts=True)
    return pair // max(n, 1), pair % max(n, 1), count


def _cells(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (hashes[a] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[b]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(43)).astype(np.int64)  # CELLS of them


def _spaced(docs: DataFrame, text: str, *also: Column) -> DataFrame:
    """Lower-case words of every text with one blank between them, as ``tokens`` parts them."""
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return docs.select(*also, words.alias("t"))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), TEXTS):
            yield batch.iloc[lo : lo + TEXTS]


def fit_vocabulary(docs: DataFrame, text: str, max_features: int = MAX_FEATURES) -> list[str]:
    """The most frequent words and pairs of neighbouring words of the corpus (ties by term), exactly.

    Words are counted first; what the last of the ``max_features`` most frequent ones reaches,
    every chosen pair reaches too. Pairs are added up in a table of ``CELLS`` hashed cells, which
    can only overstate them, and only pairs of cells that reach that count are counted one by
    one: rare pairs, nearly all of a corpus, are never shuffled.
    """
    spaced = _spaced(docs, text)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for part in _slices(batches):
            number, _row, at, distinct = _numbered(part["t"])
            if not len(distinct):
                continue
            a, b, count = _pair_counts(number, at, len(distinct))
            np.add.at(cells, _cells(pd.util.hash_array(distinct, categorize=False), a, b), count)
            yield pd.DataFrame({"term": distinct, "n": np.bincount(number), "piece": -1, "cells": None})
        pieces = [(None, 0, p, cells[lo : lo + PIECE].tobytes()) for p, lo in enumerate(range(0, CELLS, PIECE)) if cells[lo : lo + PIECE].any()]
        if pieces:
            yield pd.DataFrame(pieces, columns=["term", "n", "piece", "cells"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch["piece"], batch["cells"]):
                x = np.frombuffer(raw, dtype=np.int64)
                total[p] = total[p] + x if p in total else x
        yield pd.DataFrame([(p, x.tobytes()) for p, x in total.items()], columns=["piece", "cells"])

    seen = cut_lineage(spaced.mapInPandas(first, "term string, n long, piece int, cells binary"))
    order = [F.desc("n"), F.asc("term")]
    words = seen.where("piece < 0").groupBy("term").agg(F.sum("n").alias("n")).orderBy(*order).limit(max_features)
    words = [(r["term"], r["n"]) for r in words.collect()]  # max_features rows
    if not words:
        return []
    least = words[-1][1] if len(words) == max_features else 1
    open_ = np.zeros(CELLS, dtype=bool)
    added = seen.where("piece >= 0").select("piece", "cells").repartition("piece").mapInPandas(add, "piece int, cells binary")
    for r in added.toLocalIterator():  # CELLS numbers
        open_[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["cells"], dtype=np.int64) >= least
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(open_))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may = np.unpackbits(sent.value).astype(bool)
        for part in _slices(batches):
            number, _row, at, distinct = _numbered(part["t"])
            a, b, count = _pair_counts(number, at, len(distinct))
            if count.size:
                good = np.flatnonzero(may[_cells(pd.util.hash_array(distinct, categorize=False), a, b)])
                yield pd.DataFrame({"term": distinct[a[good]] + " " + distinct[b[good]], "n": count[good]})

    pairs = spaced.mapInPandas(second, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    both = pairs.unionByName(docs.sparkSession.createDataFrame(words, "term string, n long"))
    return [r["term"] for r in both.orderBy(*order).limit(max_features).select("term").collect()]


def count_known(docs: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """``key, codes, tf``: numbers of the vocabulary's terms in each row that holds any, and how often each stands there.

    A row stays where it is; rows of one key (null is one, too) are added up, which moves only those.
    """
    spark = docs.sparkSession
    single = sorted({w for t in vocabulary for w in t.split(" ")})
    place = {w: i for i, w in enumerate(single)}
    coded = np.full(len(single), -1, dtype=np.int64)
    pairs = []
    for code, term in enumerate(vocabulary):
        ends = [place[w] for w in term.split(" ")]
        if len(ends) == 1:
            coded[ends[0]] = code
        else:
            pairs.append((ends[0] * len(single) + ends[1], code))
    pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    sent = spark.sparkContext.broadcast((single, coded, pairs))
    schema = T.StructType([docs.select(key).schema[0], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, coded, pairs = sent.value
        index, size, width = pd.Index(single, dtype=object), len(coded), len(coded) + len(pairs)
        for part in (batch.slice(lo, TEXTS) for batch in batches for lo in range(0, batch.num_rows, TEXTS)):
            number, row, at, distinct = _numbered(part.column("t").to_pandas())
            if not len(distinct) or not size:
                continue
            word = index.get_indexer(distinct)[number]
            known = np.flatnonzero(word >= 0)
            rows, codes = [row[known]], [coded[word[known]]]
            at = at[(word[at] >= 0) & (word[at + 1] >= 0)]
            if len(pairs) and at.size:
                pair = word[at] * size + word[at + 1]
                found = np.minimum(np.searchsorted(pairs[:, 0], pair), len(pairs) - 1)
                hit = pairs[found, 0] == pair
                rows.append(row[at[hit]])
                codes.append(pairs[found[hit], 1])
            rows, codes = np.concatenate(rows), np.concatenate(codes)
            both, tf = np.unique((rows * width + codes)[codes >= 0], return_counts=True)
            held, begin = np.unique(both // width, return_index=True)
            ends = pa.array(np.append(begin, both.size), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (both % width, tf)]
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(held)), *lists], names=[key, "codes", "tf"])

    counts = cut_lineage(_spaced(docs, text, F.col(key)).mapInArrow(count, schema))
    again = cut_lineage(counts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_again")))
    if again.isEmpty():
        return counts
    same = F.col(key).eqNullSafe(F.col("_again"))
    each = counts.join(again, same, "left_semi").select(key, F.explode(F.arrays_zip("codes", "tf")).alias("x"))
    added = each.groupBy(key, F.col("x.codes").alias("code")).agg(F.sum("x.tf").cast("int").alias("tf"))
    packed = added.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("code", "tf"))).alias("p"))  # <= max_features entries
    return counts.join(again, same, "left_anti").unionByName(packed.select(key, F.col("p.code").alias("codes"), F.col("p.tf").alias("tf")))


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary of at most ``max_features`` terms; a term's number is its place."""

    vocabulary: list[str]
    idf: np.ndarray

    def weights(self, counts: DataFrame, key: str) -> DataFrame:
        """``key, terms, weights``: L2-normalised weights of each row of ``count_known``; terms by number."""
        idf = counts.sparkSession.sparkContext.broadcast(self.idf)

        @F.pandas_udf("array<double>")
        def weigh(codes: pd.Series, tf: pd.Series) -> pd.Series:
            return pd.Series([_weights(idf.value[c], n) for c, n in zip(codes, tf)], dtype=object)

        return counts.select(key, F.col("codes").alias("terms"), weigh("codes", "tf").alias("weights"))

    def rows(self, counts: DataFrame, key: str) -> DataFrame:
        """``key, term, weight``: the same, a row for each term."""
        sent = counts.sparkSession.sparkContext.broadcast((pa.array(self.vocabulary, pa.string()), self.idf))
        kind = T.StructType([counts.schema[key], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, idf = sent.value
            for batch in batches:
                for lo in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(lo, TEXTS)
                    codes, tf = part.column("codes"), part.column("tf")
                    size, flat, n = codes.value_lengths().to_numpy(), codes.flatten(), tf.flatten().to_numpy()
                    row = np.repeat(np.arange(len(size)), size)
                    w = (1.0 + np.log(n)) * idf[flat.to_numpy()]
                    w /= np.sqrt(np.bincount(row, w * w, minlength=len(size)))[row]
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), names.take(flat), pa.array(w)], names=[key, "term", "weight"])

        return counts.select(key, "codes", "tf").mapInArrow(tell, kind)


def _weights(idf: np.ndarray, tf: np.ndarray) -> np.ndarray:
    w = (1.0 + np.log(tf)) * idf
    return w / np.sqrt((w * w).sum())


def fit_tfidf(docs: DataFrame, key: str, text: str, max_features: int = MAX_FEATURES) -> tuple[DataFrame, Tfidf]:
    """``count_known`` of the documents, and smooth inverse document frequencies. The counts are
    written once to the shared folder: both read them."""
    vocabulary = fit_vocabulary(docs, text, max_features)
    counts = count_known(docs, key, text, vocabulary)
    df = np.zeros(len(vocabulary))
    for r in counts.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect():  # max_features rows
        df[r["code"]] = r["n"]
    return counts, Tfidf(vocabulary, np.log((1.0 + docs.count()) / (1.0 + df)) + 1.0)


# --- vectors --------------------------------------------------------------


def l2_normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""

    def scale(a: Column) -> Column:
        norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
        return let(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(a, lambda x: x / n))

    return let(F.transform(v, lambda x: x.cast("double")), scale)


# --- bonus ----------------------------------------------------------------


def category_bonus(category: Column) -> Column:
    c = F.lower(F.coalesce(category, F.lit("")))
    out = F.when(F.lit(False), 0.0)
    for pattern, value in BONUS_CATEGORY:
        out = out.when(c.rlike(pattern), F.lit(value))
    return out.otherwise(F.lit(0.0))


def areas_bonus(n: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for least, value in BONUS_AREAS:
        out = out.when(n >= least, F.lit(value))
    return out.otherwise(F.lit(0.0))


def profile_bonus(has_cv: Column, category: Column, n_areas: Column) -> Column:
    cv = F.when(F.coalesce(has_cv, F.lit(False)), BONUS_CV).otherwise(0.0)
    return cv + category_bonus(category) + areas_bonus(F.coalesce(n_areas, F.lit(0)))


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def base_affinity(emb: Column, tfidf: Column, has_vectors: Column, w_emb: float = W_VECTOR, w_tfidf: float = W_TERMS) -> Column:
    """Weighted similarity in [0, 1]; the terms alone without vectors."""
    return clip01(F.when(has_vectors, w_emb * emb + w_tfidf * tfidf).otherwise(tfidf))


# --- grid -----------------------------------------------------------------


#: Queries of a block that are scored in one product.
SCORED_AT_ONCE = 256

SCORED = "q bigint, id bigint, score_emb double, score_tfidf double, score_raw double, boost double, score_final double"


#: Queries and vectors of one product in single precision, and its columns of which only the largest is looked at first.
PRODUCT, GROUP = (128, 4096), 32


def _nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, skip_same: bool, weight: float) -> tuple[np.ndarray, ...]:
    """Of each query, the ``k`` best vectors by product (six digits, then id): rows of ``q``, rows of ``vectors``, products.

    Products in single precision tell what cannot be among them, by more than their error; the rest is
    multiplied again in double. The k-th of the largest of groups of columns is a bound of the k-th product.
    """
    rows, width = PRODUCT
    size = np.linalg.norm(q, axis=1) * max(np.linalg.norm(vectors, axis=1).max(), 1e-300)
    slack = 2 * (q.shape[1] + 4) * 2.0**-23 * size + 1.01e-6 / weight
    order = np.argsort(ids, kind="stable")
    own = [np.searchsorted(ids[order], qid, side) for side in ("left", "right")] if skip_same else [np.zeros(len(qid), dtype=int)] * 2
    single, padded = q.astype(np.float32), -(-len(ids) // GROUP) * GROUP
    columns = np.zeros((q.shape[1], padded), dtype=np.float32)
    columns[:, : len(ids)] = vectors.T
    out: list[tuple] = []
    for lo in range(0, len(q), rows):
        part, held = single[lo : lo + rows], []
        same = [(j - lo, c) for j in range(lo, lo + len(part)) for c in order[own[0][j] : own[1][j]]]
        least = np.full(len(part), -np.inf)
        top = np.full((len(part), k), -np.inf, dtype=np.float32)
        for at in range(0, padded, width):
            score = part @ columns[:, at : at + width]
            if at + width > len(ids):
                score[:, len(ids) - at :] = -np.inf
            for j, c in same:
                if at <= c < at + width:
                    score[j, c - at] = -np.inf
            groups = score.reshape(len(part), GROUP, -1)  # a group's columns lie apart, which is the quicker way
            most, apart = groups.max(axis=1), groups.shape[2]
            top = np.concatenate([top, most], axis=1)
            top = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
            least = top[:, 0] - slack[lo : lo + rows]
            j, g = np.nonzero(most >= least[:, None])
            few = groups[j, :, g]
            found, c = np.nonzero((few >= least[j, None]) & (few > -np.inf))
            held.append((j[found], at + c * apart + g[found], few[found, c]))
        j, c, about = (np.concatenate(x) for x in zip(*held))
        good = about >= least[j]
        j, c = j[good], c[good]
        exact = np.concatenate([np.einsum("ij,ij->i", q[lo + j[i : i + 8192]], vectors[c[i : i + 8192]]) for i in range(0, j.size, 8192)] or [np.zeros(0)])
        ranked = np.lexsort((ids[c], -np.round(weight * exact, 6), j))
        j, c, exact = j[ranked], c[ranked], exact[ranked]
        first = np.arange(j.size) - np.searchsorted(j, j) < k
        out.append((lo + j[first], c[first], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cell_scorer(k: int, w_vector: float, w_terms: float, clip: bool, need_overlap: bool, skip_same: bool):
    """Scores one cell, a block of queries against a shard of the pool; the ``k`` best rows of each query."""
    plain = not clip and not need_overlap and w_vector > 0

    def stack(vectors: pd.Series, dim: int) -> np.ndarray:
        out = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            if v is not None:
                out[i] = v
        return out

    def cell(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return empty.copy()
        dim = max([len(v) for side in (q["q_vector"], p["vector"]) for v in side if v is not None] or [1])  # a block may hold no vector
        vectors = stack(p["vector"], dim)
        if plain and not any(x is not None and len(x) for x in (*q["q_terms"], *p["terms"])) and not p["bonus"].any() and q["q_vector"].notna().all():
            q_vectors = stack(q["q_vector"], dim)
            if max(np.abs(vectors).max(), np.abs(q_vectors).max()) < 1e9:  # neither NaN nor beyond single precision
                of, best, emb = _nearest(q["q"].to_numpy(), q_vectors, p["id"].to_numpy(), vectors, k, skip_same, w_vector)
                final = w_vector * emb
                return pd.DataFrame({"q": q["q"].to_numpy()[of], "id": p["id"].to_numpy()[best], "score_emb": emb, "score_tfidf": 0.0, "score_raw": final, "boost": 0.0, "score_final": final})
        return pd.concat([score(q.iloc[lo : lo + SCORED_AT_ONCE], p, vectors) for lo in range(0, len(q), SCORED_AT_ONCE)], ignore_index=True)

    def score(q: pd.DataFrame, p: pd.DataFrame, vectors: np.ndarray) -> pd.DataFrame:
        dim = vectors.shape[1]
        lengths = np.array([0 if t is None else len(t) for t in q["q_terms"]])
        q_terms = np.concatenate([t for t in q["q_terms"] if t is not None] or [np.array([], dtype=object)])
        index = pd.Index(pd.unique(pd.Series(q_terms, dtype=q_terms.dtype)))
        q_matrix = np.zeros((len(index), len(q)))
        if len(q_terms):
            q_matrix[index.get_indexer(q_terms), np.repeat(np.arange(len(q)), lengths)] = np.concatenate(
                [w for w in q["q_weights"] if w is not None]
            )
        has_vector = np.array([v is not None for v in q["q_vector"]])
        q_vectors = stack(q["q_vector"], dim)
        ids, bonus = p["id"].to_numpy(), p["bonus"].to_numpy(dtype=float)
        emb = vectors @ q_vectors.T
        terms = np.zeros((len(p), len(q)))
        if len(index):
            for start in range(0, len(p), 512):
                part = p.iloc[start : start + 512]
                sizes = [0 if t is None else len(t) for t in part["terms"]]
                if sum(sizes):
                    at = index.get_indexer(np.concatenate([t for t in part["terms"] if t is not None]))
                    values = np.concatenate([w for w in part["weights"] if w is not None])
                    # a row's own terms only, of which there are few
                    for i, (lo, hi) in enumerate(zip(np.cumsum([0] + sizes), np.cumsum(sizes))):
                        seen = at[lo:hi] >= 0
                        terms[start + i] = values[lo:hi][seen] @ q_matrix[at[lo:hi][seen]]
        raw = np.where(has_vector[None, :], w_vector * emb + w_terms * terms, terms)
        final = raw + bonus[:, None]
        if clip:
            raw = np.clip(raw, 0, 1)
            final = np.clip(raw + bonus[:, None], 0, 1)
        ranked = np.ascontiguousarray(np.round(final, 6).T)
        ranked[np.isnan(ranked)] = np.finfo(float).min
        if need_overlap:
            ranked[terms.T <= 0] = -np.inf
        if skip_same:
            ranked[q["q"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        # only what reaches a query's k-th score is put in order
        first = max(len(p) - k, 0)
        least = np.partition(ranked, first, axis=1)[:, first]
        of, best = [], []
        for j in range(len(q)):
            at = np.flatnonzero((ranked[j] >= least[j]) & (ranked[j] > -np.inf))
            best.append(at[np.lexsort((ids[at], -ranked[j, at]))[:k]])
            of.append(np.full(best[-1].size, j))
        of, best = np.concatenate(of), np.concatenate(best)
        return pd.DataFrame(
            {"q": q["q"].to_numpy()[of], "id": ids[best], "score_emb": emb[best, of], "score_tfidf": terms[best, of],
             "score_raw": raw[best, of], "boost": bonus[best], "score_final": final[best, of]}
        )

    empty = pd.DataFrame(columns=[part.split()[0] for part in SCORED.split(", ")])
    return cell


#: Copies of the pool that are moved at most, and rows of a side of a cell where nothing is copied.
COPIES, CROSSED = 4, 1 << 15


def _packed(side: DataFrame, by: Sequence[str], rows: int, tells: str | None = None) -> DataFrame:
    """``data``: each partition's rows as one value (more if it holds more than twice ``CROSSED``), dealt by hash of ``by``;
    ``told``: the distinct numbers in column ``tells``, or in its lists."""
    spread = math.ceil(math.sqrt(3 * side.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, math.ceil(rows / CROSSED), min(spread, math.ceil(rows / 256)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sent() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            told: list[int] = []
            if tells is not None:
                numbers = pa.chunked_array([b.column(tells) for b in held])
                flat = pa.concat_arrays([c.flatten() for c in numbers.chunks]) if pa.types.is_list(numbers.type) else numbers
                told = flat.unique().to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([told], pa.list_(pa.int32())), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["told", "data"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 2 * CROSSED:
                yield sent()
                held = []
        if sum(b.num_rows for b in held):
            yield sent()

    return side.repartition(parts, *by).mapInArrow(pack, "told array<int>, data binary")


def _crossed(asked: DataFrame, pool: DataFrame, cell) -> DataFrame:
    """Scores of every packed part of ``asked`` with every packed part of ``pool`` that tell of a common number (or of none).

    Each pair of partitions is a task, which reads both where they were dealt once: no row is copied for another side's sake.
    """
    left = asked.select(F.col("told").alias("_wanted"), F.col("data").alias("_asked")).hint("shuffle_replicate_nl")
    right = pool.select(F.col("told").alias("_held"), F.col("data").alias("_pool"))
    met = left.crossJoin(right).where((F.size("_wanted") == 0) | F.arrays_overlap("_wanted", "_held"))

    def read(data: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(data).read_all().to_pandas()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, other in zip(batch["_asked"], batch["_pool"]):
                q, p = read(one), read(other)
                if "_open" not in q:
                    yield cell(q, p)
                    continue
                lists = q["_open"].map(len).to_numpy()
                row, number = np.repeat(np.arange(len(q)), lists), np.concatenate(list(q["_open"]))
                for pivot, members in p.groupby("_pivot", dropna=False):
                    yield cell(q.iloc[row[number == pivot]], members)

    return met.select("_asked", "_pool").mapInPandas(score, SCORED)


def grid_top_k(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    w_vector: float = W_VECTOR,
    w_terms: float = W_TERMS,
    clip: bool = True,
    need_overlap: bool = False,
    skip_same: bool = False,
    block_rows: int = 2048,
    shard_rows: int = 8192,
) -> DataFrame:
    """Exact top ``k`` of the pool per query without forming pairs.

    ``queries(q, terms, weights, vector)`` are cut into blocks and
    ``pool(id, terms, weights, vector, bonus)`` into shards by hash; each
    (block, shard) cell is scored with a matrix product and emits at most ``k``
    rows per query. Cells are bounded by the two sizes whatever the tables hold,
    and the final rank sees only k rows per query and shard. Where there are more
    blocks than ``COPIES``, rows are packed and met in place (``_crossed``) instead
    of being copied for every cell.
    """
    n_queries, n_pool = queries.count(), pool.count()
    spread = pool.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n_queries / block_rows))
    shards = max(1, math.ceil(n_pool / shard_rows), min(spread, math.ceil(n_pool / 256)))
    cell = _cell_scorer(k, w_vector, w_terms, clip, need_overlap, skip_same)
    order = [F.round("score_final", 6).desc(), F.asc("id")]
    # fresh column names: both sides may come from one table
    asked = queries.select("q", *[F.col(c).alias(f"q_{c}") for c in ("terms", "weights", "vector")])
    if blocks > COPIES:
        return top_n_per(_crossed(_packed(asked, ["q"], n_queries), _packed(pool, ["id"], n_pool), cell), ["q"], order, k)
    left = asked.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(blocks))).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    right = pool.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    found = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(cell, SCORED)
    return top_n_per(found, ["q"], order, k)


#: Pivots at most, whatever the size of the pool.
MOST_PIVOTS = 1024


def _reach(pool: DataFrame, pivots: np.ndarray, shard_rows: int) -> tuple[DataFrame, pd.DataFrame]:
    """The pool with its nearest pivot and shard, and what a pivot's members can reach at most."""

    @F.pandas_udf("pivot int, cosine double, size double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(vectors), 3))
        out[:, 0] = -1
        at = [i for i, v in enumerate(vectors) if v is not None]
        if at and len(pivots):
            x = np.stack([vectors.iloc[i] for i in at])
            size = np.linalg.norm(x, axis=1)
            cosine = (x / np.maximum(size, 1e-300)[:, None]) @ pivots.T
            best = cosine.argmax(axis=1)
            out[at] = np.column_stack([best, cosine[np.arange(len(at)), best], size])
        return pd.DataFrame({"pivot": out[:, 0].astype(np.int32), "cosine": out[:, 1], "size": out[:, 2]})

    weight = F.sqrt(F.aggregate(F.coalesce("weights", F.array().cast("array<double>")), F.lit(0.0), lambda s, w: s + w * w))
    placed = cut_lineage(pool.withColumn("_p", place("vector")).withColumn("_w", weight))
    stats = placed.groupBy("_p.pivot").agg(
        F.count(F.lit(1)).alias("n"), F.min("_p.cosine").alias("low"), F.max("_p.size").alias("size"), F.max("_w").alias("terms"), F.max("bonus").alias("bonus")
    ).orderBy("pivot").toArrow().to_pandas()  # MOST_PIVOTS rows and one
    parts = {int(p): max(1, math.ceil(n / shard_rows)) for p, n in zip(stats["pivot"], stats["n"])}
    pieces = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("_p.pivot")) if parts else F.lit(1)
    shard = F.pmod(F.xxhash64("id"), pieces).cast("int")
    return placed.select(*pool.columns, F.col("_p.pivot").alias("_pivot"), shard.alias("_s")), stats


def pruned_top_k(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    w_vector: float = W_VECTOR,
    w_terms: float = W_TERMS,
    clip: bool = True,
    need_overlap: bool = False,
    skip_same: bool = False,
    pivots: int = 64,
    block_rows: int = 256,
    shard_rows: int = 8192,
) -> tuple[DataFrame, dict[str, int]]:
    """The same result as ``grid_top_k``, and how many cells there are, were tried first, and were opened at all.

    The pool is dealt by the nearest of some of its own vectors. By the triangle inequality
    of angles no member of a pivot can be nearer to a query than their angle less the widest
    of the pivot's own; with the largest norms and bonus this bounds the score of all members.
    A query first opens the pivots of the highest bounds that hold ``k`` rows; its k-th score
    then shuts every pivot whose bound stays below. Queries and pool are dealt once and met in
    place (``_crossed``); a pivot is scored only with the queries that opened it. It pays where vectors have directions in common; the bound of
    scattered ones shuts little, and ``grid_top_k`` is the plainer way.
    """
    wanted = min(pivots, MOST_PIVOTS)
    some = pool.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow().column(0).to_pylist()
    some = [np.asarray(v, dtype=float) for v in some]
    centre = np.stack([v / (np.linalg.norm(v) or 1.0) for v in some]) if some else np.zeros((0, 1))
    dealt, stats = _reach(pool, centre, shard_rows)
    number, rows = stats["pivot"].to_numpy(), stats["n"].to_numpy()
    widest = np.arccos(np.clip(stats["low"].to_numpy(), -1, 1))
    n_queries, n_pool = queries.count(), int(rows.sum())
    blocks = max(1, math.ceil(n_queries / block_rows))

    def bounds(vector, weights) -> np.ndarray:
        """What a row of each pivot can score at most."""
        terms = (np.linalg.norm(weights) if weights is not None and len(weights) else 0.0) * stats["terms"].to_numpy()
        if vector is None:
            top = terms
        else:
            size = np.linalg.norm(vector)
            cosine = np.zeros(len(number))
            known = number >= 0
            angle = np.arccos(np.clip(centre[number[known]] @ (np.asarray(vector) / (size or 1.0)), -1, 1))
            cosine[known] = np.cos(np.maximum(angle - widest[known], 0))
            top = w_vector * np.maximum(cosine, 0) * size * stats["size"].to_numpy() + w_terms * terms
        if clip:
            return np.clip(np.clip(top, 0, 1) + stats["bonus"].to_numpy(), 0, 1)
        return top + stats["bonus"].to_numpy()

    @F.pandas_udf("array<int>")
    def first(vectors: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(vectors, weights):
            order = np.argsort(-bounds(v, w), kind="stable")
            need = int(np.searchsorted(np.cumsum(rows[order]), k + int(skip_same))) + 1
            out.append(number[order[:need]].tolist())
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def open_ones(vectors: pd.Series, weights: pd.Series, least: pd.Series, tried: pd.Series) -> pd.Series:
        out = []
        for v, w, t, seen in zip(vectors, weights, least, tried):
            may = number[bounds(v, w) >= (-np.inf if pd.isna(t) else t - 2e-6)]  # scores are ranked to six digits
            out.append(may[~np.isin(may, seen)].tolist())
        return pd.Series(out)

    asked = queries.select("q", *[F.col(c).alias(f"q_{c}") for c in ("terms", "weights", "vector")]).withColumn("_first", first("q_vector", "q_weights"))
    # like queries share a block
    asked = cut_lineage(asked.withColumn("_b", F.pmod(F.coalesce(F.get("_first", F.lit(0)), F.lit(0)) * 31 + F.pmod(F.xxhash64("q"), F.lit(max(1, blocks // max(len(number), 1)))), F.lit(blocks)).cast("int")))
    pieces = cut_lineage(dealt.select("_pivot", "_s").distinct())
    cell = _cell_scorer(k, w_vector, w_terms, clip, need_overlap, skip_same)
    order = [F.round("score_final", 6).desc(), F.asc("id")]

    held = _packed(dealt, ["_pivot", "_s"], n_pool, "_pivot")

    def opened(which: DataFrame) -> tuple[DataFrame, DataFrame]:
        which = which.select("q", "q_terms", "q_weights", "q_vector", "_b", "_open").where(F.size("_open") > 0)
        cells = cut_lineage(which.select("_b", F.explode("_open").alias("_pivot")).distinct().join(pieces, "_pivot"))
        return _crossed(_packed(which, ["_b"], n_queries, "_open"), held, cell), cells

    found, cells = opened(asked.withColumn("_open", F.col("_first")))
    found = cut_lineage(top_n_per(found, ["q"], order, k))
    kth = found.where(F.col("rank") == k).select("q", F.round("score_final", 6).alias("_least"))
    later = cut_lineage(asked.join(kth, "q", "left").withColumn("_open", open_ones("q_vector", "q_weights", "_least", "_first")))
    more, others = opened(later)
    tried = cells.count()
    counts = {"cells": blocks * pieces.count(), "first": tried, "opened": tried + others.join(cells, ["_b", "_pivot", "_s"], "left_anti").count()}
    return top_n_per(found.drop("rank").unionByName(more), ["q"], order, k), counts


def hybrid_vectors(calls: DataFrame, people: DataFrame, vectors: DataFrame | None, max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Vector rows for ``calls(q, text)`` and ``people(id, text, bonus)``.

    The vocabulary and idf are fitted on people only; terms go by their numbers. ``vectors(id, q, vector)``
    may lack rows: a call without one falls back to terms. Both results are
    written to the checkpoint folder once; the grid reads them twice.
    """
    counts, fitted = fit_tfidf(people, "id", "text", max_features)
    pool = people.select("id", "bonus").join(fitted.weights(counts, "id"), "id", "left")
    known = count_known(calls, "q", "text", fitted.vocabulary)
    asked = calls.select("q").join(fitted.weights(known, "q"), "q", "left")
    none = F.lit(None).cast("array<double>")
    if vectors is None:
        return cut_lineage(asked.withColumn("vector", none)), cut_lineage(pool.withColumn("vector", none))
    unit = vectors.select("key", l2_normalise(F.col("vector")).alias("vector"))
    return (
        cut_lineage(asked.join(unit.withColumnRenamed("key", "q"), "q", "left")),
        cut_lineage(pool.join(unit.withColumnRenamed("key", "id"), "id", "left")),
    )


# --- over stored rankings -------------------------------------------------


def rescore(ranking: DataFrame, w_emb: float = W_VECTOR, w_tfidf: float = W_TERMS) -> DataFrame:
    """Recompute stored top-k rows with the current weights and re-rank them.

    It can re-order the stored rows, never bring in others.
    """
    call = Window.partitionBy("q")  # a stored ranking holds k rows per call
    has = F.max(F.coalesce("score_emb", F.lit(0.0))).over(call) > 1e-6
    emb, terms = F.coalesce("score_emb", F.lit(0.0)), F.coalesce("score_tfidf", F.lit(0.0))
    out = ranking.withColumn("score_raw", base_affinity(emb, terms, has, w_emb, w_tfidf)).withColumn(
        "boost", profile_bonus(F.col("has_cv"), F.col("category"), F.col("n_areas"))
    )
    out = out.withColumn("score_final", F.round(clip01(F.col("score_raw") + F.col("boost")), 6))
    return out.withColumn("rank", F.row_number().over(call.orderBy(F.desc("score_final"), "id")))


def score_breakdown(ranking: DataFrame, w_emb: float = W_VECTOR, w_tfidf: float = W_TERMS) -> DataFrame:
    """What each signal adds to a score, largest first."""
    cat, areas = category_bonus(F.col("category")), areas_bonus(F.col("n_areas"))
    emb, terms = F.coalesce("score_emb", F.lit(0.0)), F.coalesce("score_tfidf", F.lit(0.0))

    def item(name: str, kind: str, value: Column, show: Column) -> Column:
        return F.when(show, F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("kind"), F.round(value, 4).alias("contribution")))

    items = F.array(
        item("emb", "score", w_emb * emb, F.lit(True)),
        item("tfidf", "score", w_tfidf * terms, F.lit(True)),
        item("cvlac", "boost", F.lit(BONUS_CV), F.coalesce("has_cv", F.lit(False))),
        item("categoria", "boost", cat, cat > 0),
        item("areas", "boost", areas, areas > 0),
        item("facultad", "contexto", F.lit(0.0), F.coalesce(F.trim("faculty"), F.lit("")) != ""),
    )
    rows = ranking.select("q", "id", F.inline(F.filter(items, lambda x: x.isNotNull())))
    w = Window.partitionBy("q", "id").orderBy(F.desc("contribution"), F.when(F.col("kind") == "score", 0).otherwise(1), "feature")
    return rows.withColumn("pos", F.row_number().over(w))  # six rows per pair


def rank_overlap(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Ids shared by the first ``k`` of two rankings, per call."""
    top_b = b.where(F.col("rank") <= k).select("q", "id", F.lit(1).alias("_hit"))
    return a.where(F.col("rank") <= k).join(top_b, ["q", "id"], "left").groupBy("q").agg(F.count("_hit").alias("n_shared"))


# --- evidence -------------------------------------------------------------

# Words that are not evidence on their own.
EVIDENCE_STOP = (
    "de", "la", "el", "en", "y", "a", "los", "del", "las", "un", "una", "para",
    "con", "por", "al", "se", "su", "que", "o", "como", "más", "mas", "es",
    "the", "and", "of", "to", "in", "for", "on", "or", "an", "is", "are",
)
_ONLY_HERE = math.log(1.5) + 1.0  # idf of a term found in one of two texts; a shared term has 1


def evidence_tokens(c: Column) -> Column:
    """Whole words of at least three plain or Spanish letters, lower case."""
    return F.filter(tokens(c, 1), lambda w: w.rlike("^[a-záéíóúñ]{3,}$"))


def term_evidence(pairs: DataFrame, n: int = 7) -> DataFrame:
    """Strongest shared terms of each pair ``(q, id, call_text, person_text)``.

    TF-IDF is fitted on the two texts of a pair alone, so a term is either shared
    (idf 1) or not (one constant); the norms follow from sums over each text and
    over the shared terms. Joins are keyed by (pair, term), never by a term alone.
    Pairs without any term fall back to ``overlap_evidence``.
    """

    q_terms = _pair_terms(pairs, "call_text")
    d_terms = _pair_terms(pairs, "person_text")
    totals_q = q_terms.groupBy("q", "id").agg(F.sum(F.col("w") * F.col("w")).alias("_sq"))
    totals_d = d_terms.groupBy("q", "id").agg(F.sum(F.col("w") * F.col("w")).alias("_sd"))
    shared = q_terms.withColumnRenamed("w", "_wq").join(d_terms.withColumnRenamed("w", "_wd"), ["q", "id", "term"])
    both = shared.groupBy("q", "id").agg(
        F.sum(F.col("_wq") * F.col("_wq")).alias("_cq"), F.sum(F.col("_wd") * F.col("_wd")).alias("_cd")
    )
    norms = totals_q.join(totals_d, ["q", "id"]).join(both, ["q", "id"]).select(
        "q",
        "id",
        F.sqrt(F.col("_cq") + _ONLY_HERE**2 * (F.col("_sq") - F.col("_cq"))).alias("_nq"),
        F.sqrt(F.col("_cd") + _ONLY_HERE**2 * (F.col("_sd") - F.col("_cd"))).alias("_nd"),
    )
    stop = F.array(*[F.lit(w) for w in EVIDENCE_STOP])
    told = shared.where(F.size(F.array_except(F.split("term", " "), stop)) > 0).join(norms, ["q", "id"])
    scored = told.select(
        "q",
        "id",
        "term",
        F.round(F.col("_wq") / F.col("_nq") * (F.col("_wd") / F.col("_nd")), 5).alias("weight"),
        F.round(F.col("_wq") / F.col("_nq"), 5).alias("call_weight"),
        F.round(F.col("_wd") / F.col("_nd"), 5).alias("person_weight"),
    )
    told_ = top_n_per(scored, ["q", "id"], [F.desc("weight"), F.asc("term")], n)
    return told_.unionByName(overlap_evidence(pairs, n))


def overlap_evidence(pairs: DataFrame, n: int = 7) -> DataFrame:
    """Shared runs of four letters or more, by how often the call holds them (then by place), for the
    pairs whose two texts hold no term at all."""
    runs = r"[a-záéíóúñ]{4,}"

    def found(c: str) -> Column:
        return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(runs), F.lit(0))

    bare = pairs.where((F.size(evidence_tokens(F.col("call_text"))) == 0) & (F.size(evidence_tokens(F.col("person_text"))) == 0))
    stop = F.array(*[F.lit(w) for w in EVIDENCE_STOP])
    both = bare.select("q", "id", F.posexplode(found("call_text")).alias("pos", "term"), found("person_text").alias("_p"))
    kept = both.where(F.array_contains("_p", F.col("term")) & ~F.array_contains(stop, F.col("term")))
    counts = kept.groupBy("q", "id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("pos").alias("_pos"))
    ranked = top_n_per(counts, ["q", "id"], [F.desc("weight"), F.asc("_pos")], n)
    return ranked.select("q", "id", "term", "weight", F.col("weight").alias("call_weight"), F.col("weight").alias("person_weight"), "rank")


def _pair_terms(pairs: DataFrame, text: str) -> DataFrame:
    words = pairs.select("q", "id", F.explode(with_bigrams(evidence_tokens(F.col(text)))).alias("term"))
    return words.groupBy("q", "id", "term").agg((1.0 + F.log(F.count(F.lit(1)))).alias("w"))


def match_graph_links(ranking: DataFrame, evidence: DataFrame, breakdown: DataFrame) -> DataFrame:
    """Links of the star graph: call-person, call-term, person-term and person-bonus."""
    distance = F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.0 - F.col("score_final"))), 4)
    call, person = F.concat(F.lit("call::"), F.col("q")), F.col("id").cast("string")
    term = F.concat(F.lit("term::"), F.substring(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", "_"), 1, 40))
    matches = ranking.select(
        "q", call.alias("source"), person.alias("target"), F.lit("match").alias("kind"), F.round("score_final", 6).alias("score"),
        F.round(40 + distance * 160, 1).alias("length"),
    )
    of_call = evidence.groupBy("q", call.alias("source"), term.alias("target")).agg(F.max("weight").alias("score")).select(
        "q", "source", "target", F.lit("termino_conv").alias("kind"), "score",
        F.round(55 + F.greatest(F.lit(0.0), 0.4 - F.col("score")) * 80, 1).alias("length"),
    )
    of_person = evidence.groupBy("q", person.alias("source"), term.alias("target")).agg(F.max("weight").alias("score")).select(
        "q", "source", "target", F.lit("termino_doc").alias("kind"), "score",
        F.round(35 + F.greatest(F.lit(0.0), 0.3 - F.col("score")) * 70, 1).alias("length"),
    )
    bonus = breakdown.where((F.col("kind") == "boost") & (F.col("contribution") > 0)).select(
        "q", person.alias("source"), F.concat(person, F.lit("::"), F.col("feature")).alias("target"), F.lit("aporte").alias("kind"),
        F.col("contribution").alias("score"), F.lit(48.0).alias("length"),
    )
    return matches.unionByName(of_call).unionByName(of_person).unionByName(bonus)


def coverage_verdict(shortlist: DataFrame, category: str = "category") -> DataFrame:
    strong = F.coalesce(F.lower(F.col(category)).rlike(STRONG), F.lit(False))
    return shortlist.groupBy("q").agg(F.count(F.lit(1)).alias("n_top"), F.bool_or(strong).alias("has_strong")).withColumn(
        "verdict", F.when(F.col("has_strong"), "parcial").otherwise("insuficiente")
    )


def cache_split(texts: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Texts whose vector is already stored, and those still to compute."""
    known = cache.select(key).distinct().withColumn("_k", F.lit(True))
    return texts.join(known, key, "left").withColumn("cached", F.coalesce("_k", F.lit(False))).drop("_k")


def category_of(code: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code.cast("int"))

