"""What several of these operators share: tables, blocks of rows, byte-level words and hashes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.session import cut_lineage

__all__ = ["block_count", "block_of", "cut_lineage", "free_name", "hash_texts", "hash_windows", "hash_words", "mix64", "read_table", "slices", "word_table"]

#: Words hashed at a time.
BATCH = 1 << 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column's (case does not count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def block_count(df: DataFrame, rows: int, least: int = 1) -> int:
    """Blocks of about ``rows`` rows for a table (counting reads only file footers)."""
    return max(least, math.ceil(df.count() / rows))


def block_of(key: Column, blocks: int) -> Column:
    """An even block number, whatever the key's values; null keys share one block."""
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def word_table(delimiters: bytes) -> bytes:
    """A byte translation that lower-cases A-Z and turns ``delimiters`` into spaces."""
    table = bytearray(bytes(range(256)).lower())
    for b in delimiters:
        table[b] = 0x20
    return bytes(table)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random odd number for each byte value, and an odd base for places in a word.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    filled, base = 1, _BASE
    while filled < n:  # doubling: powers of the second half are those of the first times base ** filled
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_POWER = _powers(1 << 12)


def hash_words(raw: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of ``raw`` in order, and the byte where each starts.

    Words are what ``table`` leaves between spaces (and the other ASCII blanks).
    """
    b = np.frombuffer(raw.translate(table), dtype=np.uint8)
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if not b.size:
        return none
    inside = (b > 0x20) | (b < 9) | ((b > 13) & (b < 0x20))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [b.size]))
    if not edge.size:
        return none
    start, end = edge[0::2], edge[1::2]
    length = end - start
    powers = _POWER if length.max() <= _POWER.size else _powers(int(length.max()))
    out = np.empty(start.size, dtype=np.uint64)
    for lo in range(0, start.size, BATCH):  # what is held for each byte stays small
        hi = min(lo + BATCH, start.size)
        size = length[lo:hi]
        keep = np.flatnonzero(inside[start[lo] : end[hi - 1]])
        value = _BYTE[b[start[lo] : end[hi - 1]][keep]] * powers[keep - np.repeat(start[lo:hi] - start[lo], size)]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        out[lo:hi] = np.add.reduceat(value, first)
    return mix64(out ^ length.astype(np.uint64)), start


def slices(texts: list[bytes], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    out, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > most:
            out.append((lo, i))
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        out.append((lo, len(texts)))
    return out


def hash_texts(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and where each text begins (and the last ends)."""
    words, start = hash_words(b"\n".join(texts), table)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(start, begin[:-1]).tolist() + [words.size]


def hash_windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words."""
    n = words.size - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k : k + n]
    return mix64(out)
