"""Language of texts: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a word boundary, and every run
of one to four characters that crosses no word is hashed into a table of embeddings.
Their average goes through a linear layer and a softmax. Both layers are trained by
stochastic gradient descent in numpy, in one task, on a bounded sample of labelled
texts: whole ones, and short stretches of each, so that single words can be told too.

A fifth of the sample is kept from training. It sets the temperature of the softmax
(least log loss) and the rejection: a text counts as accepted if its score is at least
what all but ``REJECT`` of these texts give to their own language.

How it is spread out
- Sampling: counts of each language, then a hash of the row picks about as many rows
  as are wanted, and tasks cut these to the bound before any shuffle. Only counts of
  buckets are shuffled, never texts.
- Since the layers are linear, a trained model is one number for each bucket and
  language; it is broadcast (``BUCKETS`` x languages x 4 bytes) and every text is
  scored where it lies, whole, in slices of bounded size.

Defined cases
- Null texts and texts without a letter: ``und``, score 0, not accepted.
- Nothing to learn from (empty table, no language): every text is ``und``.
- Rows with a null id, text or language, or whose text has no letter, are not learned from.
- Ties go to the smaller language name. Repeated rows are rows of their own.
- The ``MOST_LANGS`` most frequent languages are learned (names break ties).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bound of the training sample, in texts, and what every language gets of it at least.
SAMPLE, LEAST = 4096, 32
MOST_LANGS = 1024
#: Bits of a bucket number, longest run of characters, width of an embedding.
BITS, LONGEST, DIM = 14, 4, 16
BUCKETS = 1 << BITS
#: Words of the stretches that are learned beside each whole text.
STRETCHES = ((1, 3), (4, 10), (11, 40))
#: Characters featurised at a time.
SLICE = 1 << 18
#: Steps of descent, however large the sample; examples of a step; rate at the first.
STEPS, BATCH, RATE = 1200, 64, 40.0
#: Share of the texts of a learned language that may be rejected.
REJECT = 0.01
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[codes]


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points; one 0 before, between and after words. Empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter(codes)
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.where(letter, codes, 0)[keep].astype(np.uint64)
    if out[0]:
        out = np.concatenate(([0], out))
    if out[-1]:
        out = np.append(out, 0)
    return out.astype(np.uint64)


def bucket_counts(codes: np.ndarray) -> np.ndarray:
    """How many runs of characters fall in each bucket."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for lo in range(0, codes.size, SLICE):
        part = codes[lo : lo + SLICE + LONGEST - 1]
        starts = min(SLICE, codes.size - lo)
        value = np.zeros(part.size, dtype=np.uint64)
        whole = np.ones(part.size, dtype=bool)  # no boundary inside the run that starts here
        for n in range(1, LONGEST + 1):
            size = part.size - n + 1
            if size <= 0:
                break
            value = value[:size] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            if n > 2:
                whole = whole[:size] & (part[n - 2 : n - 2 + size] != 0)
            kept = (part != 0) if n == 1 else whole[:size]
            mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            picked = mixed[:starts][kept[:starts]] >> np.uint64(64 - BITS)
            total += np.bincount(picked.astype(np.int64), minlength=BUCKETS)
    return total


def _stretches(codes: np.ndarray, seed: int) -> list[np.ndarray]:
    edge = np.flatnonzero(codes == 0)
    words = edge.size - 1
    r = np.random.default_rng(seed)
    out = []
    for low, high in STRETCHES:
        size = min(int(r.integers(low, high + 1)), words)
        at = int(r.integers(0, words - size + 1))
        out.append(codes[edge[at] : edge[at + size] + 1])
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket numbers and counts of each sampled text and of its stretches."""
    for b in batches:
        langs, hashes, kinds, at, n = [], [], [], [], []
        for lang, h, text in zip(b["lang"].to_pylist(), b["h"].to_pylist(), b["text"].to_pylist()):
            codes = letters_of(text)
            if not codes.size:
                continue
            for kind, part in enumerate([codes, *_stretches(codes, h & 0xFFFFFFFF)]):
                counts = bucket_counts(part)
                used = np.flatnonzero(counts)
                langs.append(lang)
                hashes.append(h)
                kinds.append(kind)
                at.append(used.astype("<u2").tobytes())
                n.append(counts[used].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())],
            ["lang", "h", "kind", "at", "n"],
        )


def _rows(examples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(examples), BUCKETS), dtype=np.float32)
    for i, (at, n) in enumerate(examples):
        out[i, at] = n / n.sum()
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def descend(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: int, seed: int = 11) -> np.ndarray:
    """One number for each bucket and language (the product of both trained layers)."""
    r = np.random.default_rng(seed)
    embed = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = r.normal(0, DIM**-0.5, (DIM, langs)).astype(np.float32)
    shares = [(n / n.sum()).astype(np.float32) for _, n in examples]
    seen, place = np.zeros(BUCKETS, dtype=bool), np.zeros(BUCKETS, dtype=np.int64)
    order = np.empty(0, dtype=np.int64)
    for step in range(STEPS):
        while order.size < BATCH:  # passes over the sample, each in a new order
            order = np.concatenate([order, r.permutation(len(y))])
        some, order = order[:BATCH], order[BATCH:]
        at = np.concatenate([examples[i][0] for i in some])
        seen[at] = True
        used = np.flatnonzero(seen)
        seen[used], place[used] = False, np.arange(used.size)
        x = np.zeros((BATCH, used.size), dtype=np.float32)
        x[np.repeat(np.arange(BATCH), [examples[i][0].size for i in some]), place[at]] = np.concatenate([shares[i] for i in some])
        hidden = x @ embed[used]
        gap = _softmax(hidden @ layer)
        gap[np.arange(BATCH), y[some]] -= 1
        gap /= BATCH
        rate = RATE * (1 - step / STEPS)
        back = gap @ layer.T
        layer -= 0.05 * rate * (hidden.T @ gap)
        embed[used] -= rate * (x.T @ back)
    return embed @ layer


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(y.size), y], 1e-12)).mean())

    low, high = -4.0, 3.0
    for _ in range(60):  # narrowing thirds
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray
    temperature: float
    threshold: float

    def score(self, text: str | None) -> tuple[str, float, bool]:
        codes = letters_of(text) if text and self.langs else None
        if codes is None or not codes.size:
            return UNKNOWN, 0.0, False
        counts = bucket_counts(codes)
        p = _softmax(((counts / counts.sum()) @ self.weights / self.temperature)[None])[0]
        best = int(np.argmax(p))
        return self.langs[best], float(p[best]), bool(p[best] >= self.threshold)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], apart: np.ndarray) -> Model:
    """``apart`` marks the examples that only calibrate."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    learn = np.flatnonzero(~apart) if (~apart).any() else np.arange(y.size)
    weights = descend([examples[i] for i in learn], y[learn], len(langs))
    held = np.flatnonzero(apart) if apart.any() else learn
    logits = np.vstack([_rows([examples[i] for i in held[lo : lo + BATCH]]) @ weights for lo in range(0, held.size, BATCH)])
    temperature = _temperature(logits, y[held])
    own = np.sort(_softmax(logits / temperature)[np.arange(held.size), y[held]])
    return Model(langs, weights, temperature, float(own[int(REJECT * own.size)]))


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples, labels, apart = [], [], []
    for b in batches:
        for row in b.to_pylist():
            examples.append((np.frombuffer(row["at"], "<u2"), np.frombuffer(row["n"], "<f4")))
            labels.append(row["lang"])
            apart.append((row["h"] >> 8) % 5 == 0)
    if not labels:
        return
    m = train(examples, labels, np.array(apart))
    held = io.BytesIO()
    np.save(held, m.weights)
    yield pa.RecordBatch.from_arrays(
        [pa.array([m.langs]), pa.array([held.getvalue()], pa.binary()), pa.array([m.temperature]), pa.array([m.threshold])],
        ["langs", "weights", "temperature", "threshold"],
    )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of ``docs`` that have an id, a text and a language."""
    lang = F.col(f"`{lang_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang")).dropna()
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS)
    sizes = {r["lang"]: r["count"] for r in counts.collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), 1.0, 1.0)
    most = max(LEAST, SAMPLE // len(sizes))
    # so many rows are picked by their hash that a few more than wanted are found, whatever chance does
    shares = rows.sparkSession.createDataFrame([(k, min(1.0, (most + 8 * most**0.5) / n)) for k, n in sizes.items()], "lang string, share double")
    h = F.xxhash64("id", "text")
    picked = (
        rows.join(F.broadcast(shares), "lang")  # MOST_LANGS rows at most
        .withColumn("h", h).where(F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    )
    examples = picked.select("lang", "h", "text").mapInArrow(_examples, "lang string, h long, kind int, at binary, n binary")
    nth = F.row_number().over(Window.partitionBy("lang", "kind").orderBy("h"))
    bounded = examples.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    found = bounded.repartition(1).sortWithinPartitions("lang", "kind", "h").mapInArrow(
        _trainer, "langs array<string>, weights binary, temperature double, threshold double"
    ).collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), 1.0, 1.0)
    r = found[0]
    return Model(list(r["langs"]), np.load(io.BytesIO(bytes(r["weights"]))), r["temperature"], r["threshold"])


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """``lang, score, accepted`` of each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.score(t) for t in texts], columns=["lang", "score", "accepted"])

    return scored(text)
