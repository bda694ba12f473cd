"""BPE encoding and decoding with forced boundaries.

A merge can only ever build a vocabulary token. So where two neighbouring bytes
stand side by side inside no token at all, no merge crosses them: such a pair
marks a certain cut. Words are cut at all of them, each fragment is encoded on
its own (and remembered, since fragments repeat far more than words do), and the
ids are concatenated. The file gives vocabulary, merges, special tokens and the
word-end mark; nothing is trained.

Defined cases
- Null or empty text: no ids, decoded to the empty string.
- The strings of special tokens are found in the raw text first, longest first, as their ids.
- A symbol that is no token (a file without some byte): left out, as without an unknown token.
- Very long texts are encoded whole; memories are bounded by ``CACHE`` entries, refilled when full, and end with a task:
  a Python worker is used again, by whatever comes next, which then has that memory to itself.
- Repeated rows and extra columns pass through: one row out for each row in.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each memory of a Python worker, and the longest chunk or fragment that it keeps.
CACHE, KEEP = 500_000, 256
#: Symbols from which a fragment is merged with a heap.
LONG = 48
#: Unicode white space, as the file's \s means it.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD_BLANKS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(f"[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level files write for each byte: itself, or the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class _Memory(dict):
    """Computes what is missing; starts anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEEP:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Bpe:
    """A word-end BPE file as plain tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.name_bytes = [s.encode() for s in self.names]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.start_id = [vocab.get(letters[b], -1) for b in range(256)]
        self.end_id = [vocab.get(letters[b] + self.end, -1) for b in range(256)]
        byte_of = {c: b for b, c in letters.items()}
        inside = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            if token in self.special:
                continue
            raw = [byte_of[c] for c in (token[: -len(self.end)] if self.end and token.endswith(self.end) else token)]
            inside[raw[:-1], raw[1:]] = True
        #: joined[a][b]: some token holds the bytes a, b side by side.
        self.joined = [bytes(row.astype(np.uint8)) for row in inside]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.fragments = _Memory(self._fragment)
        self.chunks = _Memory(self._chunk)

    def forget(self) -> None:
        """Give the memories back; the tables stay."""
        self.fragments.clear()
        self.chunks.clear()

    def cut(self, raw: bytes) -> list[tuple[bytes, bool]]:
        """The fragments of a word between certain cuts, and whether each ends the word."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(raw)):
            if not joined[raw[i - 1]][raw[i]]:
                out.append((raw[start:i], False))
                start = i
        out.append((raw[start:], True))
        return out

    def _fragment(self, key: tuple[bytes, bool]) -> tuple[int, ...]:
        raw, ends = key
        ids = [self.start_id[b] for b in raw]
        if ends:
            ids[-1] = self.end_id[raw[-1]]
        ids = [i for i in ids if i >= 0]
        if len(ids) > LONG:
            return self._long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                found = merges.get(pair)
                if found is not None and (best is None or found < best):
                    best, at = found, pair
            if best is None:
                break
            out, i, new = [], 0, best[1]
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == at:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return tuple(ids)

    def _long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges for a long fragment: a heap of pairs by rank and place over linked symbols."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(rank, i, new, pair) for rank, new, i, pair in heap]
        heapify(heap)
        while heap:
            _rank, i, new, pair = heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a], ids[b]) in merges:
                    rank, made = merges[ids[a], ids[b]]
                    heappush(heap, (rank, a, made, (ids[a], ids[b])))
        return tuple(i for i in ids if i >= 0)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            for fragment in self.cut(word.encode()):
                ids += self.fragments[fragment] if len(fragment[0]) <= KEEP else self._fragment(fragment)
        return np.array(ids, dtype="<u4").tobytes()

    def normal(self, text: str) -> str:
        """Composed and lower-cased character by character (a final sigma stays a plain one)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _plain(self, text: str) -> bytes:
        text = self.normal(text)
        chunks = _SPACES.split(text) if _ODD_BLANKS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.marks is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m.group()]], dtype="<u4").tobytes()]
            at = m.end()
        out.append(self._plain(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, a space between them (the file names no decoder)."""
        return b" ".join(map(self.name_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode_decode(
    df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """``df``'s columns named in ``keep`` (all by default), ``n_tokens, ids_sha256, decoded_sha256`` and ``outputs``.

    ``ids`` is binary, as ``Bpe.encode`` gives them; ``decoded`` is text. A row's own
    columns of these names give way to the new ones.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *outputs]
    stay = [c for c in (keep if keep is not None else df.columns) if c not in made]
    lead = df.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").alias("__text"))
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType()}
    schema = T.StructType([lead.schema[c] for c in stay] + [T.StructField(c, kinds.get(c, T.StringType())) for c in made])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        try:
            for batch in batches:
                rows = []
                for text in batch.pop("__text"):
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids)
                    shas = {"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}
                    rows.append(shas | ({"ids": ids} if "ids" in outputs else {}) | ({"decoded": decoded.decode()} if "decoded" in outputs else {}))
                for c in made:
                    batch[c] = [r[c] for r in rows]
                yield batch
        finally:
            bpe.forget()

    return lead.mapInPandas(run, schema)
