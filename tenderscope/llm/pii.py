"""Personal data: fixed rules, high-recall candidates, and boosted trees that choose among them.

The fixed rules give the base spans, which always stay. Loose generators propose further,
overlapping candidates: any run that looks like a number with separators, an address in
dots or colons, an e-mail address written around. Boosted trees score a candidate by its
format (length, digits, groups, separators) and its context (neighbouring characters and
words), never by what the fixed rules themselves test (checksums, the leading plus, ranges),
so they carry the rules' decisions over to forms the rules do not know. They are trained on a
bounded sample of candidates labelled by the fixed rules; a logistic fit on a quarter that
the trees have not seen calibrates them, and only candidates whose calibrated probability
reaches ``CHOOSE`` and that touch no base span are added, the most probable first.

Defined cases
- Null or empty text: no spans. Texts of any length are searched whole.
- No candidates, or labels of one kind only: nothing is added.
- Base matches of one kind do not overlap; matches that fail a test are dropped, without another try.
- Spans are ordered by start, then by kind as in ``KINDS``; positions count code points, the end is exclusive.
- Repeated rows are searched each; extra columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderscope.llm.common import mix64

KINDS = ("email", "ip", "card", "phone", "model")
#: The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Candidate generators.
NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9][0-9\x20()./-]{5,}[0-9](?![A-Za-z0-9])")
GROUP = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:[.:/-][0-9]+){2,}(?![A-Za-z0-9])")
COLONS = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])")
AROUND = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]+)+", re.I
)
AROUND_SIGNS = ("(at)", "[at]", " dot ", "(dot)", "[dot]")

#: Bound of the training sample, in candidates (those with the smallest hashes).
SAMPLE = 20_000
TREES, LEVELS, RATE, BINS = 60, 3, 0.2, 32
#: Draws leaves to zero, so that a few oddly labelled candidates move little.
DRAW = 10
CHOOSE = 0.95

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(*s, "email") for s in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be personal data."""
    found: set[tuple[int, int]] = set()
    if DIGIT.search(text):
        for pattern in (NUMBER, GROUP):
            found.update(m.span() for m in pattern.finditer(text))
        if ":" in text:
            found.update(m.span() for m in COLONS.finditer(text))
    low = text.lower() if "(" in text or "[" in text or " dot " in text else ""
    if "@" in text or any(s in low for s in AROUND_SIGNS):
        found.update(m.span() for m in AROUND.finditer(text))
    return sorted(found)


FEATURES = 16


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    cue = before.lower()
    return [
        len(s),
        digits,
        letters,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        s.count("."),
        s.count("-"),
        s.count(" "),
        s.count("(") + s.count(")"),
        s.count(":"),
        s.count("@") + ("at" in s.lower() and letters > 0),
        float(before[-1:].isspace() or not before),
        float(after[:1].isspace() or not after),
        float(any(w in cue for w in ("tel", "phone", "call", "mail", "card", "ip", "contact", "fax"))),
        sum(c.isdigit() for c in before + after),
    ]


@dataclass
class Boosted:
    """Boosted regression trees on binned features, and a logistic calibration of their sum."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin and value of each node, as a heap
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bins(x), np.full(len(x), self.bias)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.margin(x) + self.scale[1])))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Fit by gradient and curvature of the log loss, splits by gain over feature bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    rate = (y.sum() + 1) / (y.size + 2)
    model = Boosted(edges, [], float(np.log(rate / (1 - rate))))
    b, f = model._bins(x), np.full(y.size, model.bias)
    nodes = 2 ** (LEVELS + 1) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS, dtype=np.int64), np.zeros(nodes)
        at = np.zeros(y.size, dtype=np.int64)
        for level in range(LEVELS):
            first, many = 2**level - 1, 2**level
            best = np.zeros(many)
            for j in range(x.shape[1]):
                key = (at - first) * (BINS + 1) + b[:, j]
                gs = np.bincount(key, g, minlength=many * (BINS + 1)).reshape(many, -1).cumsum(1)
                hs = np.bincount(key, h, minlength=many * (BINS + 1)).reshape(many, -1).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + DRAW) + (total_g - gs) ** 2 / (total_h - hs + DRAW) - total_g**2 / (total_h + DRAW)
                k = gain.argmax(1)
                better = gain[np.arange(many), k] > best + 1e-9
                best = np.where(better, gain[np.arange(many), k], best)
                feature[first : first + many][better] = j
                cut[first : first + many][better] = k[better]
            at = 2 * at + 1 + (b[np.arange(y.size), feature[at]] > cut[at])
        first = 2**LEVELS - 1
        gs, hs = (np.bincount(at - first, v, minlength=nodes - first) for v in (g, h))
        value[first:] = RATE * gs / (hs + DRAW)
        model.trees.append((feature, cut, value))
        f += value[at]
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Logistic fit of the margin by Newton steps, slightly drawn to the identity."""
    m, a, c = model.margin(x), 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * m + c)))
        w = p * (1 - p)
        grad = np.array([((y - p) * m).sum() - (a - 1), (y - p).sum() - c])
        curve = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        step = np.linalg.solve(curve, grad)
        a, c = a + step[0], c + step[1]
    model.scale = float(a), float(c)


def fit(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Boosted | None:
    """Trees trained on a sample of the candidates of all rows; None if there is nothing to tell apart."""

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y, h = [], [], []
            for text in batch["t"]:
                found = candidates(text)
                if found:
                    good = {s[:2] for s in base_spans(text)}
                    for s in found:
                        x.append(features(text, *s))
                        y.append(int(s in good))
                        h.append(hash_of(text, *s))
            if h:
                yield pd.DataFrame({"h": h, "y": y, "x": x})

    lead = df.select(F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull())
    chosen = lead.mapInPandas(propose, "h long, y int, x array<double>").orderBy("h").limit(sample).toArrow()
    y = chosen.column("y").to_numpy().astype(float)
    if not y.size or y.min() == y.max():
        return None
    x = np.array(chosen.column("x").to_pylist())
    kept_back = np.arange(y.size) % 4 == 3  # hashes are in order, so this is a random quarter
    model = boost(x[~kept_back], y[~kept_back])
    if kept_back.any():
        calibrate(model, x[kept_back], y[kept_back])
    return model


def hash_of(text: str, start: int, end: int) -> int:
    """A number of a candidate in its surroundings, the same on every machine."""
    raw = text[max(0, start - 24) : end + 24].encode()[:256].ljust(256, b"\0")
    v = np.frombuffer(raw, dtype=np.uint64)
    return int(mix64(v * np.uint64(0x9E3779B97F4A7C15) + np.arange(v.size, dtype=np.uint64)).sum().astype(np.int64))


def find_spans(text: str, model: Boosted | None, choose: float = CHOOSE) -> list[Span]:
    base = base_spans(text)
    if model is None:
        return base
    # spans by start, and how far those up to each reach: what begins before an end and reaches beyond a start overlaps
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))
    open_ = [(s, e) for s, e in candidates(text) if not (at := bisect_left(starts, e)) or reach[at - 1] <= s]
    if not open_:
        return base
    p = model.probability(np.array([features(text, *s) for s in open_]))
    added: list[Span] = []
    for i in np.lexsort(([s[0] for s in open_], -p)):
        if p[i] < choose:
            break
        s, e = open_[i]
        at = bisect_left(added, (s,))  # spans taken so far, in order; they do not overlap
        if (at == len(added) or e <= added[at][0]) and (not at or added[at - 1][1] <= s):
            added.insert(at, (s, e, "model"))
    return sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (or what overlapping spans cover) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def search(df: DataFrame, model: Boosted | None, text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("found", "redacted")) -> DataFrame:
    """``df``'s columns named in ``keep`` (all by default) and ``outputs``: ``found``, an array of (start, end,
    kind), and ``redacted``, the text without them (null stays null). Own columns of these names give way."""
    stay = [c for c in (keep if keep is not None else df.columns) if c not in outputs]
    lead = df.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").alias("__text"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    kinds = {"found": T.ArrayType(span), "redacted": T.StringType()}
    schema = T.StructType([lead.schema[c] for c in stay] + [T.StructField(c, kinds[c]) for c in outputs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("__text")
            found = [find_spans(t or "", model) for t in texts]
            if "found" in outputs:
                batch["found"] = [[{"start": s, "end": e, "kind": k} for s, e, k in one] for one in found]
            if "redacted" in outputs:
                batch["redacted"] = [t if t is None else redacted(t, one) for t, one in zip(texts, found)]
            yield batch

    return lead.mapInPandas(run, schema)


def redacted_column(model: Boosted | None, text: Column) -> Column:
    """The redacted text as a column: only texts go to Python and back."""

    @F.pandas_udf(T.StringType())
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([t if t is None else redacted(t, find_spans(t, model)) for t in texts], dtype=object)

    return hide(text)
