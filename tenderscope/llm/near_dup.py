"""Near duplicates by a chosen-path set similarity join.

Every document becomes the set of its word shingles and a sketch of minwise
values. Equal sets are merged first. Independent trees then branch the documents:
at a node one coordinate of the sketch is selected, and the documents that share its
minwise token go on together. A node small enough is compared exhaustively, a larger
one branches again on further coordinates. A pair of similarity s stays together at
a branch with probability s, so a tree that stops at once misses it with 1 - s;
``TREES`` = 10 trees leave about 0.25 ** 10 at the threshold itself.

In a small node sketches are compared first: what looks similar enough (a bound far
below the threshold) forms clusters. Clusters are joined over all trees, and each
document travels once to the group in which full sets are compared by shingle
postings; only a spanning forest of the confirmed links leaves it. Groups beyond the
memory bound are compared node by node instead, so no task ever holds more than
``MOST_DOCS`` documents or about ``MOST_SHINGLES`` shingles (or one document).

Defined cases
- Null or empty texts (or texts of blanks): an empty set, linked with nothing, of its own class.
- Texts with fewer words than a shingle: the whole sequence is the one element.
- Very long texts are shingled whole. Repeated rows of an id are one document: all their texts are linked.
- A null id takes no part: null component, kept.
- Empty tables give empty results; extra columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage, free_name, hash_texts, hash_windows, mix64, slices, word_table
from tenderscope.operators.network import components

#: Words are what ASCII white space parts; A-Z lower-cased.
WORDS = word_table(b"")
SHINGLE, THRESHOLD = 5, 75  # words; per cent
SKETCH, TREES, DEPTH = 64, 10, 8
#: Agreeing coordinates from which full sets are compared: 4.8 standard deviations below the threshold.
AGREE = 31
MOST_DOCS, MOST_SHINGLES = 2048, 4 << 20

_FACTORS = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = hash_texts(texts, WORDS)
    for a, b in zip(at[:-1], at[1:]):
        w = words[a:b]
        yield np.unique(hash_windows(w, min(size, w.size))) if w.size else w


def sketch_of(shingles: np.ndarray) -> bytes:
    return np.array([(shingles * f).min() >> np.uint64(32) for f in _FACTORS], dtype=np.uint32).tobytes()


def _path(parent: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The number of a node: its parent, the coordinate selected there, and the token."""
    x = mix64(parent.astype(np.uint64) ^ mix64(coordinate.astype(np.uint64) + np.uint64(0x51ED27)))
    return mix64(x + value.astype(np.uint64)).astype(np.int64)


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(-1, SKETCH)


def _sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, n, sig, sketch`` for every row with an id (no signature for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch["t"]]
            ids = batch["id"].to_numpy()
            for lo, hi in slices(texts, 4 << 20):
                n, sig, sketch = [], [], []
                for s in shingle_sets(texts[lo:hi], size):
                    n.append(s.size)
                    # two independent sums of the set: equal only for equal sets
                    sig.append(mix64(s).sum().tobytes() + mix64(s ^ _FACTORS[1]).sum().tobytes() if s.size else None)
                    sketch.append(sketch_of(s) if s.size else None)
                yield pd.DataFrame({"id": ids[lo:hi], "n": n, "sig": sig, "sketch": sketch})

    lead = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.col("id").isNotNull())
    return lead.mapInPandas(run, "id long, n long, sig binary, sketch binary")


def _branch(rows: DataFrame, ways: int, roots: bool) -> DataFrame:
    """``node, rep, n, root`` of the children of ``node, rep, n, sketch, root``: ``ways`` coordinates each, chosen by the node.
    The first nodes are the roots of their trees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sketch, rep, n = _matrix(batch["sketch"]), batch["rep"].to_numpy(), batch["n"].to_numpy()
            node, line = batch["node"].to_numpy(), np.arange(len(batch))
            for k in range(ways):
                c = np.full(len(batch), k) if roots else (mix64(node.astype(np.uint64) + np.uint64(k)) % np.uint64(SKETCH)).astype(np.int64)
                child = _path(node, c, sketch[line, c])
                yield pd.DataFrame({"node": child, "rep": rep, "n": n, "root": child if roots else batch["root"].to_numpy()})

    return rows.mapInPandas(run, "node long, rep long, n long, root long")


def _nodes(members: DataFrame) -> DataFrame:
    """Members of nodes that hold two documents or more, with whether the node is small."""
    size = members.groupBy("node").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("held")).where(F.col("docs") > 1)
    small = (F.col("docs") <= MOST_DOCS) & ((F.col("held") <= MOST_SHINGLES) | (F.col("docs") == 2))
    return members.join(size.select("node", "docs", "held", small.alias("small")), "node")


def tree_nodes(reps: DataFrame) -> DataFrame:
    """``node, rep``: the small nodes of all trees.

    What ``DEPTH`` branchings leave in large nodes is gathered by tree (by its first node), dealt
    into parts, and every two parts make a node: no two of them stay apart, and no node grows.
    """
    zero = F.lit(0).cast("long")
    level = cut_lineage(_nodes(_branch(reps.withColumns({"node": zero, "root": zero}), TREES, True)))
    done = level.where("small").select("node", "rep")
    for depth in range(DEPTH):
        large = level.where(~F.col("small"))
        if large.isEmpty():
            return done
        if depth == DEPTH - 1:
            break
        rows = large.select("node", "rep", "root").join(reps, "rep").select("node", "rep", "n", "sketch", "root")
        level = cut_lineage(_nodes(_branch(rows, 2, False)))
        done = done.unionByName(level.where("small").select("node", "rep"))
    left = cut_lineage(large.select(F.col("root").alias("node"), "rep", "n").distinct())
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / (MOST_DOCS // 2)), F.ceil(F.sum("n") / (MOST_SHINGLES // 2))).cast("int")
    dealt = left.join(left.groupBy("node").agg(parts.alias("parts")), "node").withColumn("part", F.pmod(F.xxhash64("rep", "node"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: (p != F.col("part")) | (F.col("parts") == 1))
    every = dealt.select("node", "rep", "part", F.explode(others).alias("other"))
    return done.unionByName(every.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "rep"))


class _Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _similar(sketch: np.ndarray) -> list[list[int]]:
    """Clusters (two members or more) of sketches that agree in ``AGREE`` coordinates, directly or in steps."""
    m = len(sketch)
    u = _Union(m)
    if m == 2:
        return [[0, 1]] if (sketch[0] == sketch[1]).sum() >= AGREE else []
    for i in range(m - 1):
        near = np.flatnonzero((sketch[i + 1 :] == sketch[i]).sum(1) >= AGREE)
        for j in near.tolist():
            u.join(i, i + 1 + j)
    held: dict[int, list[int]] = {}
    for i in range(m):
        held.setdefault(u.find(i), []).append(i)
    return [c for c in held.values() if len(c) > 1]


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    return np.split(order, cut) if keys.size else []


def _clusters(rows: DataFrame, buckets: int) -> DataFrame:
    """``node, root, rep``: members of the clusters within each small node; a task takes a bucket of whole nodes."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sketch, rep, node = _matrix(batch["sketch"]), batch["rep"].to_numpy(), batch["node"].to_numpy()
        out = []
        for at in _groups(node):
            for members in _similar(sketch[at]):
                ids = np.sort(rep[at[members]])
                out.append(pd.DataFrame({"node": node[at[0]], "root": ids[0], "rep": ids}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "rep": []}, dtype=np.int64)

    bucket = F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket")
    return rows.groupBy(bucket).applyInPandas(run, "node long, root long, rep long")


def confirmed(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= threshold * union, by counting shared shingles."""
    m = len(sets)
    size = np.array([s.size for s in sets])
    u, out = _Union(m), []
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return [(0, 1)] if 100 * both >= threshold * (size.sum() - both) and both else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    value, doc = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    end = np.concatenate((begin[1:], [value.size]))
    term = np.empty(flat.size, dtype=np.int64)
    term[order] = np.repeat(np.arange(begin.size), end - begin)
    place = np.concatenate(([0], np.cumsum(size)))
    for i in range(m):
        mine = term[place[i] : place[i + 1]]
        mine = mine[end[mine] - begin[mine] > 1]
        if not mine.size:
            continue
        length = end[mine] - begin[mine]
        first = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(first - begin[mine], length)
        shared = np.bincount(doc[at], minlength=m)
        linked = np.flatnonzero(100 * shared >= threshold * (size + size[i] - shared))
        for j in linked[linked > i].tolist():
            if u.join(i, j):
                out.append((i, j))
    return out


def _confirm(rows: DataFrame, buckets: int, size: int, threshold: int) -> DataFrame:
    """``source, target``: confirmed links that span each group of ``key, rep, t``; a task takes a bucket of whole groups."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        rep, key, texts = batch["rep"].to_numpy(), batch["key"].to_numpy(), batch["t"].to_numpy()
        out = []
        for at in _groups(key):
            at = at[np.argsort(rep[at], kind="stable")]
            sets = list(shingle_sets([texts[i].encode() for i in at], size))
            out += [(int(rep[at[i]]), int(rep[at[j]])) for i, j in confirmed(sets, threshold)]
        return pd.DataFrame(out, columns=["source", "target"], dtype=np.int64)

    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    return rows.groupBy(bucket).applyInPandas(run, "source long, target long")


def _buckets(df: DataFrame, rows: int) -> int:
    """Enough buckets that each holds about ``rows`` rows."""
    return max(1, -(-df.count() // rows))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``id, n_shingles, component_id`` for every distinct id: the smallest id reachable over links."""
    seen = cut_lineage(_sketch(docs, id_col, text_col, shingle))
    full = seen.where(F.col("sig").isNotNull())
    reps = full.groupBy("sig").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    reps = cut_lineage(reps)
    nodes = tree_nodes(reps.select("rep", "n", "sketch"))
    rows = nodes.join(reps.select("rep", "sketch"), "rep")
    found = cut_lineage(_clusters(rows, _buckets(nodes, 20_000)))
    grouped = components(found.select(F.col("root").alias("source"), F.col("rep").alias("target")))
    weight = grouped.join(reps.select(F.col("rep").alias("id"), "n"), "id").groupBy("component").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("held")
    )
    small = (F.col("docs") <= MOST_DOCS) & ((F.col("held") <= MOST_SHINGLES) | (F.col("docs") == 2))
    sized = cut_lineage(grouped.join(weight.where(F.col("docs") > 1).select("component", small.alias("small")), "component"))
    together = sized.where("small").select(F.col("component").alias("key"), F.col("id").alias("rep"))
    apart = found.join(sized.where(~F.col("small")).select(F.col("id").alias("rep")), "rep", "left_semi")
    groups = together.unionByName(apart.select(F.xxhash64("node", "root").alias("key"), "rep"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull())
    carried = groups.join(texts, "rep")  # all texts of a repeated id, which are linked anyway
    links = _confirm(carried, _buckets(sized, 400), shingle, threshold)
    of = full.join(reps.select("sig", "rep"), "sig").select("id", "rep", "n")
    twice = of.groupBy("id").agg(F.min("rep").alias("source"), F.max("rep").alias("target")).where(F.col("source") < F.col("target"))
    same = of.join(twice.select("id"), "id", "left_semi").select(F.col("id").alias("source"), F.col("rep").alias("target"))
    final = components(links.unionByName(same))
    one = of.groupBy("id").agg(F.min("rep").alias("rep"), F.max("n").alias("n"))
    joined = one.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    empty = seen.select("id").distinct().join(one.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    return joined.unionByName(empty).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each class: that of the smallest id (if it is repeated, its row of the smallest text), and rows without an id."""
    found = classes(docs, id_col, text_col, shingle, threshold)
    stay, nth = free_name(docs.columns, "stay__"), free_name(docs.columns, "nth__")
    key = F.col(f"`{id_col}`")
    kept = docs.join(found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(stay)), key.cast("long") == F.col(stay), "left_semi")
    # tasks keep one row of an id before the shuffle
    first = kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.col(f"`{text_col}`").asc_nulls_last()))).where(F.col(nth) == 1).drop(nth)
    return first.unionByName(docs.where(key.isNull()))
