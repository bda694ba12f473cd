"""Secret scanning: fixed rules, and character Markov models compared by log-likelihood ratio.

Two first-order character chains are trained: one on the strings that the fixed
rules find (labelled random), one on every other run of key characters in the
corpus (labelled ordinary). Transition counts come from all rows and are added
up in Spark, so what reaches the driver is one table of characters by characters.
Runs are cut at the fixed rules' spans; in what is left, whatever its length, every part
between separators (or ends) whose log-likelihood ratio exceeds the prior odds against a
secret is reported as ``random``, as the best-scoring part that holds it. Where the ratio
falls by the prior odds, a part ends and another may begin.

Defined cases
- Null or empty text: no spans. Texts of any length are scanned whole.
- No rows or no labelled strings: both chains are uniform, nothing is added.
- Repeated rows are scanned each; extra columns pass through.
- Spans of a document are ordered by start, then by kind as in ``KINDS``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
#: Words before an assigned secret, prefix and lengths of the rules.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Prior odds against a run being a secret.
ODDS = 1e6
#: Weight, in transitions, of a character's own frequency in its transition probabilities.
BACK = 1000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Codes from this on are separators, at which a part of a run may begin or end.
SEPARATOR = ALPHABET.index("+")
SIZE = len(ALPHABET) + 1  # and the state before the first character
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
START = len(ALPHABET)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``start, end, kind, start of the secret itself`` of the fixed rules."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    return out


def _codes(text: str) -> np.ndarray:
    """A code for each code point; -1 outside the alphabet."""
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], code >= 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def _pairs(code: np.ndarray) -> np.ndarray:
    """Transition numbers at each character of ``code``: from the one before, or from the start of a run."""
    before = np.concatenate(([START], code[:-1]))
    before[before < 0] = START
    return before * SIZE + code


def transition_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Transition numbers of labelled random and of ordinary strings in a text."""
    code = _codes(text)
    random = []
    for _start, end, _kind, at in base_spans(text):
        if code[at:end].size and (code[at:end] >= 0).all():
            random.append(_pairs(code[at:end]))
        code[at:end] = -1
    number = _pairs(code) if code.size else code
    return (np.concatenate(random) if random else np.empty(0, dtype=np.int64)), number[code >= 0]


def fit(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios (random against ordinary) of each transition, from all rows: within a string, and
    where a random string begins after an ordinary character."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            for text in batch["t"]:
                for label, numbers in enumerate(transition_counts(text)):
                    if numbers.size:
                        total[label] += np.bincount(numbers, minlength=SIZE * SIZE)
        label, cell = np.nonzero(total)
        yield pd.DataFrame({"label": label, "cell": cell, "n": total[label, cell]})

    texts = df.select(F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull())
    counts = texts.mapInPandas(count, "label long, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((2, SIZE, SIZE))
    for r in counts.collect():  # at most 2 x SIZE x SIZE rows
        table[r["label"], r["cell"] // SIZE, r["cell"] % SIZE] = r["n"]
    table = table[:, :, : SIZE - 1]
    # a transition that is rare in training falls back to how common its character is
    single = (table.sum(1) + 1) / (table.sum((1, 2)) + SIZE - 1)[:, None]
    logs = np.log((table + BACK * single[:, None, :]) / (table.sum(2, keepdims=True) + BACK))
    out = np.zeros((2, SIZE, SIZE))
    out[0, :, : SIZE - 1] = logs[0] - logs[1]
    out[1, :, : SIZE - 1] = logs[0, START] - logs[1]
    return out.reshape(2, -1)


def _parts(code: np.ndarray, ratio: np.ndarray, odds: float) -> Iterator[tuple[int, int]]:
    """The best-scoring parts of a run with a log-likelihood ratio above ``odds``, from left to right."""
    total = np.concatenate(([0.0], np.cumsum(ratio[0, _pairs(code)])))
    alone = ratio[1, _pairs(code)]
    apart = code >= SEPARATOR
    cuts = [0, *(np.flatnonzero(apart[1:] | apart[:-1]) + 1).tolist(), code.size]
    best, begin, end, now = 0.0, 0, 0, -np.inf
    for a, b in zip(cuts[:-1], cuts[1:]):
        fresh, longer = alone[a] + total[b] - total[a + 1], now + total[b] - total[a]
        if fresh >= longer or best - longer > odds:
            if best > odds:
                yield begin, end
            best, begin, end, now = fresh, a, b, fresh
        else:
            now = longer
            if now > best:
                best, end = now, b
    if best > odds:
        yield begin, end


def find_spans(text: str, ratio: np.ndarray) -> list[Span]:
    """All spans of a text, in order."""
    base = base_spans(text)
    spans = [(s, e, k) for s, e, k, _ in base]
    code = _codes(text)
    for s, e, _ in spans:
        code[s:e] = -1
    start, end = _runs(code)
    if not start.size or not ratio.any():
        return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    odds = float(np.log(ODDS))
    # no part of a run can score more than its characters at their best
    most = np.maximum(ratio[:, _pairs(code)].max(0), 0)
    most[code < 0] = 0
    most = np.concatenate(([0.0], np.cumsum(most)))
    may = most[end] - most[start] > odds - 1e-6
    for s, e in zip(start[may].tolist(), end[may].tolist()):
        spans += [(s + a, s + b, "random") for a, b in _parts(code[s:e], ratio, odds)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(df: DataFrame, ratio: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns named in ``keep`` (all by default) and ``found``: array of (start, end, kind).

    A row's own column of that name gives way to the new one.
    """
    stay = [c for c in (keep if keep is not None else df.columns) if c != "found"]
    lead = df.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").alias("__text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([lead.schema[c] for c in stay] + [T.StructField("found", T.ArrayType(span))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("__text")
            batch["found"] = [[{"start": s, "end": e, "kind": k} for s, e, k in find_spans(t or "", ratio)] for t in texts]
            yield batch

    return lead.mapInPandas(run, schema)


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    listed = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)
    return hashlib.sha256(listed.encode()).hexdigest()
