"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every token of every text: rows are blocks
of documents, each with its sorted terms and, term by term, the places where the
term stands. It is written to the shared folder and needs no shuffle, so any number
of benchmarks can be searched in it. A search sends the test items to the blocks in
slices of bounded size (another pass for each further slice). In a block, a window
of test words is dropped at once if any of its terms is absent; else the places of
its rarest term, shifted by the term's offset, are intersected with those of the
other terms from the rarest up. What is left are exact occurrences of the phrase.
Proximity: all different words of an item, in any order, within a stretch of words.

Words are runs of ASCII letters and digits and of any other non-ASCII characters,
A-Z lower-cased. Terms are 64-bit hashes of words.

Defined cases
- Null or empty texts have no words and no hits. Items without words or without an id match nothing.
- An item shorter than the window is one window; longer ones give every run of ``window`` words.
- Texts of any length are indexed whole; a long one is a block of its own. Blocks end at document bounds,
  and no occurrence crosses from one document to the next.
- Repeated rows are each searched and returned; repeated items count once for each id.
- Extra columns play no part: the result is keyed by the id column, one row for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage, free_name, hash_texts, slices, word_table

#: ASCII but letters and digits parts words.
WORDS = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Words of test items sent to the blocks at once (8 bytes each).
SLICE_WORDS = 1 << 20


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks ``block, ids, starts, terms, ends, places`` of the postings of all texts, written to the shared folder."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = [(t or "").encode() for t in batch["t"]]
            ids = batch["id"].tolist()
            for lo, hi in slices(texts, block_bytes):
                words, starts = hash_texts(texts[lo:hi], WORDS)
                order = np.argsort(words, kind="stable")
                ranked = words[order]
                last = np.flatnonzero(np.concatenate((ranked[1:] != ranked[:-1], [True]))) if words.size else np.empty(0, dtype=np.int64)
                yield pd.DataFrame(
                    {
                        "block": [f"{part}-{number}"],
                        "ids": [ids[lo:hi]],
                        "starts": [np.array(starts, dtype=np.int64).tobytes()],
                        "terms": [ranked[last].tobytes()],
                        "ends": [(last + 1).astype(np.uint32).tobytes()],
                        "places": [order.astype(np.uint32).tobytes()],
                    }
                )
                number += 1

    lead = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return cut_lineage(
        lead.mapInPandas(make, "block string, ids array<string>, starts binary, terms binary, ends binary, places binary")
    )


class Items:
    """Test items as hashed words: every window with the items that hold it."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in rows]
        words, starts = hash_texts([t.encode() for _, t in rows], WORDS)
        self.words = [words[a:b] for a, b in zip(starts[:-1], starts[1:])]
        self.window = window

    def windows(self) -> dict[bytes, set[int]]:
        out: dict[bytes, set[int]] = {}
        for i, w in enumerate(self.words):
            size = min(self.window, w.size)
            for k in range(w.size - size + 1 if size else 0):
                out.setdefault(w[k : k + size].tobytes(), set()).add(i)
        return out

    def __len__(self) -> int:
        return sum(w.size for w in self.words)


class Block:
    """The postings of one block of documents."""

    def __init__(self, starts: bytes, terms: bytes, ends: bytes, places: bytes):
        self.starts = np.frombuffer(starts, dtype=np.int64)
        self.terms = np.frombuffer(terms, dtype=np.uint64)
        ends_ = np.frombuffer(ends, dtype=np.uint32).astype(np.int64)
        self.begin, self.end = np.concatenate(([0], ends_[:-1])), ends_
        self.places = np.frombuffer(places, dtype=np.uint32)

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Number of each term in this block; -1 if absent."""
        if not self.terms.size:
            return np.full(words.size, -1)
        at = np.minimum(np.searchsorted(self.terms, words), self.terms.size - 1)
        return np.where(self.terms[at] == words, at, -1)

    def postings(self, rank: int) -> np.ndarray:
        return self.places[self.begin[rank] : self.end[rank]].astype(np.int64)

    def count(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, 0, self.end[rank] - self.begin[rank]) if self.terms.size else np.zeros_like(rank)

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def phrase(self, rank: np.ndarray) -> np.ndarray:
        """Places where the terms stand one after another within a document."""
        order = np.argsort(self.count(rank), kind="stable")
        found = self.postings(rank[order[0]]) - order[0]
        found = found[found >= 0]
        for j in order[1:]:
            if not found.size:
                return found
            other = self.postings(rank[j])
            at = np.minimum(np.searchsorted(other, found + j), other.size - 1)
            found = found[other[at] == found + j]
        return found[self.doc_of(found) == self.doc_of(found + rank.size - 1)] if found.size else found

    def near(self, rank: np.ndarray, span: int) -> np.ndarray:
        """Documents in which all the terms stand within ``span`` consecutive words."""
        lists = sorted((self.postings(r) for r in rank), key=len)
        anchor = lists[0]
        # left ends: places of any term from which an anchor is in reach
        left = np.unique(np.concatenate(lists))
        at = np.searchsorted(anchor, left)
        reach = np.where(at < anchor.size, anchor[np.minimum(at, anchor.size - 1)], np.iinfo(np.int64).max)
        left = left[reach - left < span]
        right = left.copy()
        for places in lists:
            if not left.size:
                return left
            at = np.searchsorted(places, left)
            ok = at < places.size
            left, right, at = left[ok], right[ok], at[ok]
            right = np.maximum(right, places[at])
            ok = right - left < span
            left, right = left[ok], right[ok]
        return np.unique(self.doc_of(left)[self.doc_of(left) == self.doc_of(right)])


def search_block(block: Block, items: Items, windows: dict[bytes, set[int]], proximity: float | None):
    """Hit places as (start, end), and of each document the items found as phrases and in proximity."""
    keys = list(windows)
    spans: list[tuple[np.ndarray, int]] = []
    phrases: dict[int, set[int]] = {}
    if keys:
        flat = np.frombuffer(b"".join(keys), dtype=np.uint64)
        size = np.array([len(k) // 8 for k in keys])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        rank = block.ranks(flat)
        for w in np.flatnonzero(np.minimum.reduceat(rank, first) >= 0):
            at = block.phrase(rank[first[w] : first[w] + size[w]])
            if at.size:
                spans.append((at, int(size[w])))
                for doc in np.unique(block.doc_of(at)).tolist():
                    phrases.setdefault(doc, set()).update(windows[keys[w]])
    close: dict[int, set[int]] = {}
    if proximity is not None:
        for i, w in enumerate(items.words):
            rank = np.unique(block.ranks(w)) if w.size else np.array([-1])
            if rank[0] >= 0:
                for doc in block.near(rank, int(np.ceil(proximity * w.size))).tolist():
                    close.setdefault(doc, set()).add(i)
    return spans, phrases, close


RESULT = "block string, doc int, id string, n_words long, hits binary, items array<string>, near_items array<string>"


def _search(index: DataFrame, items: Items, proximity: float | None) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(items)  # at most SLICE_WORDS words and one item

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = sent.value
        windows = here.windows()
        for batch in batches:
            for row in batch.itertuples(index=False):
                block = Block(row.starts, row.terms, row.ends, row.places)
                spans, phrases, close = search_block(block, here, windows, proximity)
                total = int(block.starts[-1])
                step = np.zeros(total + 1, dtype=np.int32)
                for at, size in spans:
                    np.add.at(step, at, 1)
                    np.add.at(step, at + size, -1)
                hit = np.cumsum(step[:total]) > 0
                docs = len(row.ids)
                yield pd.DataFrame(
                    {
                        "block": row.block,
                        "doc": np.arange(docs, dtype=np.int32),
                        "id": list(row.ids),
                        "n_words": np.diff(block.starts),
                        "hits": [np.flatnonzero(hit[a:b]).tobytes() for a, b in zip(block.starts[:-1], block.starts[1:])],
                        "items": [sorted({here.ids[i] for i in phrases.get(d, ())}) for d in range(docs)],
                        "near_items": [sorted({here.ids[i] for i in close.get(d, ())}) for d in range(docs)],
                    }
                )

    return index.mapInPandas(run, RESULT)


def _read_items(items: DataFrame, item_id: str, item_text: str, window: int, slice_words: int) -> Iterator[Items]:
    """Slices of the test items; the driver holds one at a time."""
    rows, held = [], 0
    wanted = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna().distinct()
    for r in wanted.toLocalIterator():
        rows.append((r["i"], r["t"]))
        held += len(r["t"]) // 2 + 1  # no more words than that
        if held >= slice_words:
            yield Items(rows, window)
            rows, held = [], 0
    yield Items(rows, window)


def find(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    proximity: float | None = None,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """``id, n_words, n_hit, items, near_items`` for every indexed document.

    ``items``: ids of items of which some window occurs; ``n_hit``: words inside an
    occurrence; ``near_items``: ids of items whose words all stand within
    ``proximity`` times the item's length (none if it is not given).
    """
    found = [_search(index, part, proximity) for part in _read_items(items, item_id, item_text, window, slice_words)]
    if len(found) == 1:
        return found[0].select("id", "n_words", F.expr("length(hits) div 8").alias("n_hit"), "items", "near_items")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        hits = np.unique(np.concatenate([np.frombuffer(h, dtype=np.int64) for h in rows["hits"]]))
        named = [sorted(set().union(*rows[c])) for c in ("items", "near_items")]
        return pd.DataFrame({"id": [rows["id"].iloc[0]], "n_words": [rows["n_words"].iloc[0]], "n_hit": [hits.size], "items": [named[0]], "near_items": [named[1]]})

    return every.groupBy("block", "doc").applyInPandas(merge, "id string, n_words long, n_hit long, items array<string>, near_items array<string>")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; rows are told apart by id, those without one by their text."""
    key, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    name = F.coalesce(key, F.concat(F.lit("\0"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    found = find(build_index(docs.select(name.alias("name"), text.alias("text")), "name", "text"), items, window=window)
    free = free_name(docs.columns, "hit__")
    # written first, so that the planner knows their size: where they are few, the texts are not shuffled
    hit = cut_lineage(found.where(F.col("n_hit") > 0).select(F.col("id").alias(free)).distinct())
    return docs.join(hit, name == F.col(free), "left_anti")
