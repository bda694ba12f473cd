"""Exact top-k by inner product: branch and bound over a vertical (dimension-major) layout.

Candidates are dealt into tiles and queries into blocks; a cell is one block
against one tile. In a cell the scores grow dimension block by dimension block.
After each block the part still missing is bounded by Cauchy-Schwarz on the
remaining dimensions (the remaining mass of both vectors); a candidate whose
upper bound stays below the k-th best lower bound is dropped and the columns
that survive are compacted before the next block. Every cell emits at most k
rows for a query, so what is ranked at the end is bounded by queries x tiles x k.

Defined cases
- A vector that is null, or holds a null, NaN or infinite component, takes no part.
- Vectors of unequal length: missing components count as zero. An empty vector scores 0.
- Repeated rows of an id: the smallest vector (as arrays compare) stands for it. Null ids take no part.
- Ties go to the smaller id. Fewer than k candidates: all of them.
- Scores beyond 64 bits are held at the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderscope.llm.common import block_count, block_of

#: Doubles hold every integer up to here.
EXACT = float(2**53)


def grid_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``id, v``: each component as floor(scale * x), for the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
    cells = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e).cast("double"))
    return kept.select(F.col(id_col).cast("long").alias("id"), cells.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def search_cell(qid, q, cid, c, k: int, block_dims: int, chunk: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``query id, candidate ids, scores`` of one cell, exactly the k best of each query."""
    dims = c.shape[1]
    mass = (q * q).sum(0) + (c * c).sum(0)
    order = np.argsort(-mass, kind="stable")  # the heaviest dimensions first leave the least to bound
    q, c = q[:, order], np.ascontiguousarray(c[:, order].T)  # c: one row for each dimension
    cuts = list(range(0, dims, block_dims)) + [dims]
    # remaining mass after each block, of queries and of candidates
    q_rest = np.stack([np.sqrt((q[:, s:] ** 2).sum(1)) for s in cuts[1:]] or [np.zeros(len(q))])
    c_rest = np.stack([np.sqrt((c[s:] ** 2).sum(0)) for s in cuts[1:]] or [np.zeros(c.shape[1])])
    place = {int(x): i for i, x in enumerate(cid)}
    for lo in range(0, len(q), chunk):
        part = q[lo : lo + chunk, : cuts[1]] @ c[: cuts[1]] if dims else np.zeros((len(q[lo : lo + chunk]), c.shape[1]))
        for i in range(part.shape[0]):
            me = lo + i
            live, score = np.arange(c.shape[1]), part[i]
            own = place.get(int(qid[me]))
            if own is not None:
                live, score = np.delete(live, own), np.delete(score, own)
            for b in range(1, len(cuts)):
                if b > 1:
                    score = score + q[me, cuts[b - 1] : cuts[b]] @ c[cuts[b - 1] : cuts[b], live]
                if live.size > k:
                    slack = q_rest[b - 1, me] * c_rest[b - 1][live]
                    floor_ = np.partition(score - slack, live.size - k)[live.size - k]
                    keep = score + slack + 1 >= floor_ - 1  # scores are integers: 1 is more than rounding can be
                    if not keep.all():
                        live, score = live[keep], score[keep]
            if live.size:
                best = np.lexsort((cid[live], -score))[:k]
                yield int(qid[me]), cid[live[best]], score[best]


def _exact_cell(qid, q, cid, c, k: int):
    """The same for components so large that doubles would round: Python integers."""
    for i, row in enumerate(q):
        a = [int(x) for x in row]
        score = (sum(x * int(y) for x, y in zip(a, other)) for other in c)
        found = sorted((-max(min(s, 2**63 - 1), -(2**63)), int(o)) for s, o in zip(score, cid) if o != qid[i])[:k]
        if found:
            yield int(qid[i]), np.array([o for _, o in found]), np.array([-s for s, _ in found], dtype=object)


def exact_top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, block_dims: int = 16, tile_rows: int = 8192, query_rows: int = 8192
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for two tables ``id, v`` of integral components (as ``grid_vectors`` makes)."""
    tiles, blocks = block_count(candidates, tile_rows), block_count(queries, query_rows)
    left = queries.select(
        "id", "v", block_of(F.col("id"), blocks).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_t")
    )
    right = candidates.select(
        "id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), block_of(F.col("id"), tiles).alias("_t")
    )

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            width = max(map(len, [*a["v"], *b["v"]]))
            qid, cid = a["id"].to_numpy(), b["id"].to_numpy()
            q, c = _matrix(a["v"], width), _matrix(b["v"], width)
            small = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1)) < EXACT
            found = search_cell(qid, q, cid, c, k, block_dims) if small else _exact_cell(qid, q, cid, c, k)
            for query_id, ids, scores in found:
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    found = left.groupBy("_b", "_t").cogroup(right.groupBy("_b", "_t")).applyInPandas(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
