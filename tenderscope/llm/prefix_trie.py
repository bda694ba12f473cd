"""The trie of conversation prefixes, by peeling truncations.

Every conversation is a sequence of turns. Equal conversations are merged first;
then the deepest are cut by their last turn, meet the conversations that end one
turn earlier, and are grouped again, and so on down to the root. Every grouping
yields the nodes of one depth with what they add up: each node is met once, when
all of its children are known.

How it is spread out
- A turn is 16 bytes of SHA-256 over role and text; a prefix is a chained 16-byte
  hash, so the texts are read once and never shuffled (but for the first characters
  that order tied turns).
- Below depth ``S`` no prefix leads more than ``GROUP_TURNS`` turns of different
  conversations: whole groups are peeled inside a task, many levels at a time. The
  tops lose their turn and are merged, with map-side combination, into their parents,
  which are far fewer; these are peeled in the same way from the next ``S``. So a
  prefix that a third of all conversations share never meets in one task.
- The ids that end at a node are packed in ranges and run through SHA-256 in order,
  one range in memory at a time.
- A conversation is a row of 20 bytes a turn.

Defined cases
- Rows without a conversation id take no part. Null role or text is the empty string.
- Order: turn (null first), then role, the text's first 64 characters, and its hash;
  repeated rows are repeated turns.
- Empty table: no node. Conversations without turns end at the root.
- Columns besides the four given are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage

#: Turns of different conversations from which a prefix is too large for one task.
GROUP_TURNS = 1024
#: Turns that a task peels at a time.
CHUNK_TURNS = 65536
#: Copies of a parent for its children to look up.
SALTS = 16
#: Bytes of a hash.
WIDTH = 16
#: Words, as the saving counts them.
WORD = r"[^\x20\x09-\x0D]+"

ENTRY = "depth int, path binary, words binary, n long, low long, kids long, leaves long, saved long, ends string"
_PEELED = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, path binary, words binary"
#: SHA-256 of no members.
NOBODY = hashlib.sha256(b"").hexdigest()


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, turn_hash, words``: every row with an id, numbered from 1 in order."""
    said, who = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        who.alias("role"),
        F.substring(said, 1, 64).alias("head"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)), 1, WIDTH).alias("turn_hash"),
        F.regexp_count(said, F.lit(WORD)).cast("int").alias("words"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "turn_hash")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "turn_hash", "words")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to one row for each conversation: the hashes of all its prefixes, and the words of each last turn."""
    conv, last, path, words = None, b"", bytearray(), []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict(
            {
                "conv": pa.array([r[0] for r in out], pa.int64()),
                "key": pa.array([r[1] for r in out], pa.binary()),
                "path": pa.array([r[2] for r in out], pa.binary()),
                "words": pa.array([r[3] for r in out], pa.binary()),
            }
        )
        out.clear()
        return made

    for b in batches:
        for c, h, w in zip(b["conv"].to_pylist(), b["turn_hash"].to_pylist(), b["words"].to_pylist()):
            if c != conv:
                if conv is not None:
                    out.append((conv, last, bytes(path), np.array(words, "<i4").tobytes()))
                conv, last, words = c, bytes(WIDTH), [0]
                path = bytearray(last)
            if h is not None:  # null: the conversation's own row, which stands for no turn
                last = hashlib.blake2b(last + h, digest_size=WIDTH).digest()
                path += last
                words.append(w)
        if len(out) >= 1024:
            yield batch()
    if conv is not None:
        out.append((conv, last, bytes(path), np.array(words, "<i4").tobytes()))
    if out:
        yield batch()


def _rows(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in names], [n for n, _ in names])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of ids, sorted by node and range, to one row for each node at which conversations end."""
    names = [part.split()[0] for part in ENTRY.split(", ")]
    out: list[tuple] = []
    key, n, low, digest, path, words = None, 0, 0, None, b"", b""

    def close() -> None:
        if key is not None:
            out.append((len(path) // WIDTH - 1, path, words, n, low, 0, 0, 0, digest.hexdigest()))

    for b in batches:
        for k, ids, p, w in zip(b["key"].to_pylist(), b["ids"], b["path"].to_pylist(), b["words"].to_pylist()):
            ids = ids.values.to_numpy()
            text = ",".join(map(str, ids.tolist())).encode()
            if k != key:
                close()
                key, n, low, digest, path, words = k, 0, int(ids[0]), hashlib.sha256(), p, w
            else:
                digest.update(b",")
            digest.update(text)
            n += ids.size
        if len(out) >= 1024:
            yield _rows(ENTRY, dict(zip(names, zip(*out))))
            out.clear()
    close()
    if out:
        yield _rows(ENTRY, dict(zip(names, zip(*out))))


def entries(turns: DataFrame) -> DataFrame:
    """Distinct conversations: how many, the smallest id, and the digest of all ids.

    ``turns`` holds ``conv, part, pos, turn_hash, words``: the turns in the order of
    ``(part, pos)``, and for each conversation one first row with a null hash.
    """
    sequences = turns.repartition("conv").sortWithinPartitions("conv", "part", "pos").select("conv", "turn_hash", "words")
    sequences = sequences.mapInArrow(_chain, "conv long, key binary, path binary, words binary")
    ranges = sequences.groupBy("key", F.shiftright("conv", 12).alias("range")).agg(
        F.sort_array(F.collect_list("conv")).alias("ids"), F.any_value("path").alias("path"), F.any_value("words").alias("words")
    )
    return ranges.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_ended, ENTRY)


def _groups(starts: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, starts) for c in columns]


def peel(cols: dict[str, list], stop: int) -> dict[str, list]:
    """Entries in whole groups, from the greatest depth to ``stop``: their nodes, as columns.

    Nodes at ``stop`` have no parent yet; they carry the path to it.
    """
    depth, paths, words = np.array(cols["depth"]), cols["path"], cols["words"]
    n, low, kids, leaves, saved = (np.array(cols[c], dtype=np.int64) for c in ("n", "low", "kids", "leaves", "saved"))
    flat = b"".join(p[WIDTH * stop :] for p in paths)
    hashes = pa.Array.from_buffers(pa.binary(WIDTH), len(flat) // WIDTH, [None, pa.py_buffer(flat)]).dictionary_encode()
    code = hashes.indices.to_numpy()
    count = np.frombuffer(b"".join(w[4 * stop :] for w in words), "<i4").astype(np.int64)
    base = np.concatenate(([0], np.cumsum(depth - stop + 1)[:-1])) - stop  # base + depth: place in ``code`` and ``count``
    by_depth = np.argsort(-depth, kind="stable")
    bounds = np.searchsorted(-depth[by_depth], -np.arange(depth.max(), stop - 2, -1))  # where each depth begins
    out: dict[str, list] = {part.split()[0]: [] for part in _PEELED.split(", ")}
    none = np.empty(0, dtype=np.int64)
    up: dict[str, np.ndarray] | None = None  # the nodes of the depth below, cut by a turn

    def give(nodes: dict[str, np.ndarray], d: int, parents: list) -> None:
        out["conv_id"] += nodes["low"].tolist()
        out["depth"] += [d] * nodes["low"].size
        out["parent_conv_id"] += parents
        out["n_convs"] += nodes["n"].tolist()
        out["n_children"] += nodes["kids"].tolist()
        out["n_leaves"] += nodes["leaves"].tolist()
        out["saved_tokens"] += nodes["saved"].tolist()
        out["ends"] += [cols["ends"][i] if i >= 0 else NOBODY for i in nodes["own"].tolist()]
        top = d == stop and stop > 0
        out["path"] += [paths[i][: WIDTH * stop] if top else None for i in nodes["rep"].tolist()]
        out["words"] += [words[i][: 4 * stop] if top else None for i in nodes["rep"].tolist()]

    for step, d in enumerate(range(int(depth.max()), stop - 1, -1)):
        new = by_depth[bounds[step] : bounds[step + 1]]
        own = np.array([i if cols["ends"][i] is not None else -1 for i in new], dtype=np.int64)
        many = up["rep"].size if up else 0

        def both(name: str, mine: np.ndarray, of=None) -> np.ndarray:
            return np.concatenate(((of if of is not None else up[name]) if up else none, mine))

        rep = both("rep", new)
        parts = [both("n", n[new]), both("kids", kids[new], np.ones(many, np.int64)), both("leaves", leaves[new]), both("saved", saved[new])]
        lows, owns = both("low", low[new]), both("own", own, np.full(many, -1))
        where = code[base[rep] + d]
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(where[order]) != 0)))
        g_n, g_kids, g_leaves, g_saved = _groups(first, *[p[order] for p in parts])
        g_low, g_own = np.minimum.reduceat(lows[order], first), np.maximum.reduceat(owns[order], first)
        g_rep = rep[order][first]
        nodes = {
            "rep": g_rep, "n": g_n, "low": g_low, "kids": g_kids, "own": g_own,
            "leaves": np.where(g_kids == 0, 1, g_leaves), "saved": g_saved + (g_n - 1) * count[base[g_rep] + d],
        }
        if up:
            group = np.empty(rep.size, dtype=np.int64)
            group[order] = np.repeat(np.arange(first.size), np.diff(np.append(first, rep.size)))
            give(up, d + 1, g_low[group[:many]].tolist())
        up = nodes
    give(up, stop, [None] * up["rep"].size)
    return out


def _peeler(stop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        turns, group = 0, None
        for b in batches:
            cols = b.to_pydict()
            groups = cols.pop("g")
            start = 0
            for i, g in enumerate(groups):
                if g != group and turns >= CHUNK_TURNS:
                    for name, values in cols.items():
                        held.setdefault(name, []).extend(values[start:i])
                    yield _rows(_PEELED, peel(held, stop))
                    held, turns, start = {}, 0, i
                group = g
                turns += cols["depth"][i] + 1 - stop
            for name, values in cols.items():
                held.setdefault(name, []).extend(values[start:])
        if held and held["depth"]:
            yield _rows(_PEELED, peel(held, stop))

    return run


def _key(at: int) -> F.Column:
    return F.substring("path", WIDTH * at + 1, WIDTH)


def safe_depth(rows: DataFrame, group_turns: int) -> int:
    """The least depth from which no prefix of several entries leads more than ``group_turns`` turns."""
    size = (F.col("depth") + 1).cast("long")
    keys = F.transform(F.sequence(F.lit(0), F.col("depth")), lambda i: F.substring(F.col("path"), i * WIDTH + 1, F.lit(WIDTH)))
    seen = rows.select(size.alias("size"), F.posexplode(keys).alias("at", "key")).groupBy("at", "key")
    wide = seen.agg(F.sum("size").alias("turns"), F.count(F.lit(1)).alias("n")).where(F.col("turns") > group_turns).where("n > 1")
    deepest = wide.agg(F.max("at")).first()[0]
    return 0 if deepest is None else deepest + 1


def trie(turns: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """All nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends``."""
    rows = cut_lineage(entries(turns))
    names = [part.split()[0] for part in _PEELED.split(", ")][:8]
    found: list[DataFrame] = []
    stop = -1
    while stop != 0:
        stop = safe_depth(rows, group_turns)
        deep = rows.where(F.col("depth") >= stop).withColumn("g", _key(stop))
        done = cut_lineage(deep.repartition("g").sortWithinPartitions("g").mapInArrow(_peeler(stop), _PEELED))
        if stop == 0:
            found.append(done.select(names))
            break
        found.append(done.where(F.col("depth") > stop).select(names))
        tops, above = done.where(F.col("depth") == stop), stop - 1
        cut = tops.select(
            F.lit(above).alias("depth"), "path", "words", F.col("n_convs").alias("n"), F.col("conv_id").alias("low"),
            F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"),
        )
        meet = cut.unionByName(rows.where(F.col("depth") == above))
        sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
        merged = meet.groupBy(_key(above).alias("k")).agg(
            F.any_value("path").alias("path"), F.any_value("words").alias("words"), *sums, F.min("low").alias("low"), F.max("ends").alias("ends")
        )
        merged = merged.withColumn("depth", F.lit(above)).select([part.split()[0] for part in ENTRY.split(", ")])
        rows = cut_lineage(merged.unionByName(rows.where(F.col("depth") < above)))
        parents = rows.where(F.col("depth") == above).select(
            _key(above).alias("k"), F.col("low").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        own = tops.withColumn("k", _key(above)).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
        found.append(own.drop("parent_conv_id").join(parents, ["k", "salt"]).withColumn("parent_conv_id", F.col("p")).select(names))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
