"""Hidden Markov language model over words: Baum-Welch over all partitions, exact forward scoring.

Words are emitted in two steps: a latent state gives a word class, the class gives the
word. Frequent words are classes of their own (a share of all tokens bounds their
number); the others share classes by length, first byte and ending, which tell languages
and forms apart. Within a shared class a word has its share of the class's training
tokens. Unseen words are one event, as in the unigram base; its probability is the
share of tokens that stand once in training.

Corpus counts: blocks of documents send each distinct word once, as packed arrays,
to the bucket of its hash; buckets add them up and answer every block with totals. No
word, however frequent, makes more than one entry for each block. Documents are then
encoded as class numbers and written once. Baum-Welch reads them each round: tasks
compute expected counts with scaled forward and backward passes over all training
tokens (in runs of at most ``RUN`` words), Spark adds the counts up, and the driver,
which holds states x classes only, takes the next step. Scoring is the scaled forward
recursion over each whole text.

Defined cases
- Null or empty text: one token, the end.
- No training rows: N and V are 0, every word is unseen, states are alike.
- Texts of any length are scored whole; a very long one is a block of its own.
- A null or missing training flag counts as training. Repeated rows are counted and scored each.
- Extra columns play no part; the result is keyed by the id column, one row for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage, hash_words, mix64, slices, word_table

WORDS = word_table(b"")
STATES, ROUNDS, RUN = 8, 5, 512
#: A word with more than this share of the training tokens is a class of its own (so fewer than 4096 words are).
SHARE = 1 / 4096
#: Classes of the other words.
FORMS = 1024
UNSEEN = FORMS  # class numbers: forms, unseen, then the frequent words
#: Bytes of text in a block; distinct words of all blocks that meet in a bucket.
BLOCK_BYTES, BUCKET_WORDS = 4 << 20, 1 << 20
END = np.uint64(0x5E7D0CE7D0CE7D0C)  # the end token
#: Pseudo-counts of an emission and a transition.
SMOOTH = 0.5


def _zip(a: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(a.tobytes(), asbytes=True)


def _unzip(b: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(b, n * np.dtype(dtype).itemsize, asbytes=True), dtype=dtype) if n else np.empty(0, dtype)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, each one's form, the tokens as numbers of distinct ones (an end after each text), text bounds."""
    raw = b"\n".join(texts)
    words, start = hash_words(raw, WORDS)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(start, begin)
    tokens = np.insert(words, at[1:], END)
    distinct, back = np.unique(tokens, return_inverse=True)
    form = np.zeros(distinct.size, dtype=np.uint16)
    if words.size:
        known, first = np.unique(words, return_index=True)
        pad = b"\n\n\n" + raw.translate(WORDS) + b"\n"
        b = np.frombuffer(pad, dtype=np.uint8)
        blank = np.flatnonzero((b == 0x20) | ((b >= 9) & (b <= 13)))
        lo = start[first] + 3
        hi = blank[np.searchsorted(blank, lo)]
        shape = np.minimum(hi - lo, 24).astype(np.uint64) // np.uint64(4)
        shape = shape * np.uint64(256) + b[lo]
        for k in (1, 2, 3):
            shape = shape * np.uint64(256) + np.where(hi - k >= lo, b[hi - k], 0).astype(np.uint64)
        form[np.searchsorted(distinct, known)] = mix64(shape) % np.uint64(FORMS)
    return distinct, form, back.astype(np.uint32), at + np.arange(at.size)


def _blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column | None) -> DataFrame:
    """Blocks of documents as numbers of their distinct words, written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = [(t or "").encode() for t in batch["t"]]
            ids, learned = batch["id"].tolist(), batch["learn"].to_numpy(dtype=bool)
            for lo, hi in slices(texts, BLOCK_BYTES):
                distinct, form, token, at = tokens_of(texts[lo:hi])
                trained = np.repeat(learned[lo:hi], np.diff(at))
                count = np.bincount(token[trained], minlength=distinct.size).astype(np.uint32)
                order = np.argsort(-np.bincount(token, minlength=distinct.size), kind="stable")  # small numbers for frequent words
                new = np.empty(order.size, dtype=np.uint32)
                new[order] = np.arange(order.size, dtype=np.uint32)
                yield pd.DataFrame(
                    {
                        "block": [f"{part}-{number}"],
                        "ids": [ids[lo:hi]],
                        "learn": [learned[lo:hi].tolist()],
                        "at": [at.astype(np.int64).tobytes()],
                        "tokens": [_zip(new[token])],
                        "hashes": [distinct[order].tobytes()],
                        "forms": [form[order].tobytes()],
                        "counts": [_zip(count[order])],
                        "n_train": [int(trained.sum())],
                        "n_distinct": [distinct.size],
                    }
                )
                number += 1

    lead = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.col(f"`{text_col}`").alias("t"),
        F.coalesce(learn if learn is not None else F.lit(True), F.lit(True)).alias("learn"),
    )
    return cut_lineage(
        lead.mapInPandas(
            run,
            "block string, ids array<string>, learn array<boolean>, at binary, tokens binary, hashes binary, forms binary, counts binary, n_train long, n_distinct long",
        )
    )


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(hashes ^ END) % np.uint64(buckets)).astype(np.int64)


def _deal(blocks: DataFrame, buckets: int) -> DataFrame:
    """``bucket, block, hashes, forms, counts``: distinct words of each block, dealt by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                hashes, forms = np.frombuffer(row.hashes, dtype=np.uint64), np.frombuffer(row.forms, dtype=np.uint16)
                counts = _unzip(row.counts, hashes.size, np.uint32)
                to = _bucket(hashes, buckets)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                parts = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame(
                    {
                        "bucket": np.arange(buckets, dtype=np.int32),
                        "block": row.block,
                        "hashes": [hashes[p].tobytes() for p in parts],
                        "forms": [forms[p].tobytes() for p in parts],
                        "counts": [counts[p].tobytes() for p in parts],
                    }
                )

    return blocks.select("block", "hashes", "forms", "counts").mapInPandas(run, "bucket int, block string, hashes binary, forms binary, counts binary")


#: Keys of the statistics beside forms (0 to FORMS - 1) and frequent words (their hashes, in another column).
DISTINCT, SINGLE = -1, -2


def _add_up(dealt: DataFrame, tokens: int) -> DataFrame:
    """Answers ``block, bucket, totals``, and for block null the statistics ``kind, keys, values`` of a bucket."""
    least = tokens * SHARE

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(h) // 8 for h in batch["hashes"]]
        hashes = np.frombuffer(b"".join(batch["hashes"]), dtype=np.uint64)
        counts = np.frombuffer(b"".join(batch["counts"]), dtype=np.uint32).astype(np.float64)
        forms = np.frombuffer(b"".join(batch["forms"]), dtype=np.uint16)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(back, counts, minlength=distinct.size)
        often = (total > least) | ((distinct == END) & (total > 0))
        per_form = np.bincount(forms[first][~often], total[~often], minlength=FORMS)
        values = np.concatenate((per_form, [np.count_nonzero(total), np.count_nonzero(total == 1)]))
        keys = np.concatenate((np.arange(FORMS), [DISTINCT, SINGLE]))
        used = values > 0
        bounds = np.cumsum([0] + sizes)
        answers = total[back].astype(np.uint64)
        return pd.DataFrame(
            {
                "block": [*batch["block"], None, None],
                "bucket": [int(batch["bucket"].iloc[0])] * (len(batch) + 2),
                "totals": [*(answers[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])), None, None],
                "kind": [*[None] * len(batch), "form", "word"],
                "keys": [*[None] * len(batch), keys[used], distinct[often].astype(np.int64)],
                "values": [*[None] * len(batch), values[used], total[often]],
            }
        )

    return cut_lineage(
        dealt.groupBy("bucket").applyInPandas(run, "block string, bucket int, totals binary, kind string, keys array<long>, values array<double>")
    )


@dataclass
class Corpus:
    """Encoded documents and what was counted over the training tokens."""

    coded: DataFrame
    tokens: int
    distinct: int
    single: int
    often: np.ndarray  # hashes of the frequent words, sorted
    form_tokens: np.ndarray

    @property
    def classes(self) -> int:
        return FORMS + 1 + self.often.size


def encode(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Count all training tokens and write every document as class numbers with its word-level log10 probabilities."""
    blocks = _blocks(docs, id_col, text_col, learn)
    tokens, words = (int(x or 0) for x in blocks.agg(F.sum("n_train"), F.sum("n_distinct")).first())
    buckets = max(1, -(-words // BUCKET_WORDS))
    answers = _add_up(_deal(blocks, buckets), tokens)
    pairs = answers.where(F.col("block").isNull()).select("kind", F.explode(F.arrays_zip("keys", "values")).alias("x"))
    stats = pairs.groupBy("kind", F.col("x.keys").alias("key")).agg(F.sum("x.values").alias("n"))
    form_tokens, often, distinct, single = np.zeros(FORMS), [], 0, 0
    for r in stats.collect():  # forms, two sums, and fewer than 1 / SHARE + 1 frequent words
        if r["kind"] == "word":
            often.append(r["key"])
        elif r["key"] == DISTINCT:
            distinct = int(r["n"])
        elif r["key"] == SINGLE:
            single = int(r["n"])
        else:
            form_tokens[r["key"]] = r["n"]
    often = np.sort(np.array(often, dtype=np.int64).astype(np.uint64))
    size = tokens + 0.5 * (distinct + 1)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            hashes = np.frombuffer(row.hashes, dtype=np.uint64)
            forms = np.frombuffer(row.forms, dtype=np.uint16).astype(np.int64)
            to = _bucket(hashes, buckets)
            answered = right.sort_values("bucket")["totals"]
            total = np.empty(hashes.size)
            total[np.argsort(to, kind="stable")] = np.frombuffer(b"".join(answered), dtype=np.uint64)
            place = np.minimum(np.searchsorted(often, hashes), max(often.size - 1, 0))
            own = often[place] == hashes if often.size else np.zeros(hashes.size, dtype=bool)
            cls = np.where(own, FORMS + 1 + place, np.where(total > 0, forms, UNSEEN)).astype(np.uint16)
            inner = np.zeros(hashes.size)
            shared = ~own & (total > 0)
            inner[shared] = np.log10(total[shared] / form_tokens[forms[shared]])
            base = np.log10((total + 0.5) / size)
            at = np.frombuffer(row.at, dtype=np.int64)
            token = _unzip(row.tokens, int(at[-1]), np.uint32)
            first = at[:-1]  # every text has its end, so no run is empty
            out.append(
                {
                    "ids": row.ids,
                    "learn": row.learn,
                    "at": row.at,
                    "classes": _zip(cls[token]),
                    "known": np.add.reduceat((total > 0).astype(np.int64)[token], first),
                    "base": np.add.reduceat(base[token], first),
                    "inner": np.add.reduceat(inner[token], first),
                }
            )
        return pd.DataFrame(out, columns=["ids", "learn", "at", "classes", "known", "base", "inner"])

    asked = blocks.select("block", "ids", "learn", "at", "tokens", "hashes", "forms")
    replies = answers.where(F.col("block").isNotNull()).select("block", "bucket", "totals")
    coded = asked.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        run, "ids array<string>, learn array<boolean>, at binary, classes binary, known array<long>, base array<double>, inner array<double>"
    )
    return Corpus(cut_lineage(coded), tokens, distinct, single, often, form_tokens)


@dataclass
class Model:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(classes: int, states: int) -> Model:
    """States that stay, and emissions that differ a little by a fixed rule so that training can tell states apart."""
    noise = (mix64(np.arange(classes * states, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(float) / 2**53
    emit = 0.5 + noise.reshape(classes, states)
    step = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _padded(cls: np.ndarray, begin: np.ndarray, length: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of sequences, the longest first: which, their lengths, and class numbers by time and sequence."""
    order = np.argsort(-length, kind="stable")
    i = 0
    while i < order.size:
        take = order[i : i + max(1, cells // max(int(length[order[i]]), 1))]
        t = np.arange(int(length[take[0]]))[:, None]
        inside = t < length[take]
        yield take, length[take], cls[np.where(inside, begin[take] + t, 0)]
        i += take.size


def expected_counts(model: Model, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, transitions and emissions of sequences, and their log likelihood (scaled forward and backward)."""
    states = model.start.size
    step, emit = model.step.astype(np.float32), model.emit.astype(np.float32)
    starts, steps, emits, loglik = np.zeros(states), np.zeros((states, states)), np.zeros(model.emit.shape), 0.0
    for _take, lengths, c in _padded(cls, begin, length, 1 << 19):
        span, many = c.shape
        e = emit[c]  # time x sequence x state
        active = np.searchsorted(-lengths, -np.arange(span), side="left")  # sequences longer than t stand first
        alpha, scale = np.zeros_like(e), np.ones((span, many), dtype=np.float32)
        a = model.start.astype(np.float32) * e[0]
        for t in range(span):
            n = active[t]
            if t:
                a = (alpha[t - 1, :n] @ step) * e[t, :n]
            s = np.maximum(a.sum(1), 1e-30)
            alpha[t, :n] = a / s[:, None]
            scale[t, :n] = s
        beta = np.zeros_like(e)
        beta[lengths - 1, np.arange(many)] = 1
        flow = np.zeros_like(e)  # emission x beta / scale
        for t in range(span - 1, 0, -1):
            n = active[t]
            flow[t, :n] = e[t, :n] * beta[t, :n] / scale[t, :n, None]
            beta[t - 1, :n] = flow[t, :n] @ step.T
        gamma = alpha * beta
        starts += gamma[0].sum(0)
        steps += alpha[:-1].reshape(-1, states).T @ flow[1:].reshape(-1, states)
        flat = c.ravel()
        for k in range(states):
            emits[:, k] += np.bincount(flat, gamma[:, :, k].ravel(), minlength=len(emits))
        loglik += float(np.log(scale.astype(float)).sum())
    return starts, steps * model.step, emits, loglik


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over all training tokens; also the log likelihood (base e, of classes) before each step."""
    model, trail = first_model(corpus.classes, states), []
    unseen = min((corpus.single + 0.5) / (corpus.tokens + 1), 0.5)
    context = corpus.coded.sparkSession.sparkContext
    for _ in range(rounds if corpus.tokens else 0):
        sent = context.broadcast(model)  # states x classes

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here = sent.value
            total = np.zeros(1 + states + states * states + here.emit.size)
            for batch in batches:
                for row in batch.itertuples(index=False):
                    at = np.frombuffer(row.at, dtype=np.int64)
                    cls = _unzip(row.classes, int(at[-1]), np.uint16)
                    learned = np.array(row.learn, dtype=bool)
                    lo, n = at[:-1][learned], np.diff(at)[learned]
                    runs = -(-n // RUN)
                    k = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                    begin = np.repeat(lo, runs) + k * RUN
                    length = np.minimum(np.repeat(lo + n, runs) - begin, RUN)
                    if length.size:
                        a, b, c, d = expected_counts(here, cls, begin, length)
                        total += np.concatenate(([d], a, b.ravel(), c.ravel()))
            cell = np.flatnonzero(total)
            yield pd.DataFrame({"cell": cell, "n": total[cell]})

        added = corpus.coded.select("at", "classes", "learn").mapInPandas(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        total = np.zeros(1 + states + states * states + model.emit.size)
        got = added.toArrow()  # 1 + states x (1 + states + classes) rows at most
        total[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        trail.append(float(total[0]))
        start = total[1 : 1 + states] + SMOOTH
        step = total[1 + states : 1 + states + states * states].reshape(states, states) + SMOOTH
        emit = total[1 + states + states * states :].reshape(model.emit.shape) + SMOOTH / corpus.classes
        emit[UNSEEN] = 0
        emit = emit / emit.sum(0) * (1 - unseen)
        emit[UNSEEN] = unseen
        model = Model(start / start.sum(), step / step.sum(1, keepdims=True), emit)
        sent.unpersist()
    return model, trail


def log10_forward(model: Model, cls: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """log10 probability of each whole class sequence."""
    out = np.zeros(length.size)
    for take, lengths, c in _padded(cls, begin, length, 1 << 20):
        a, total = model.start * model.emit[c[0]], np.zeros(take.size)
        active = np.searchsorted(-lengths, -np.arange(len(c)), side="left")
        for t in range(len(c)):
            n = active[t]
            if t:
                a = (a[:n] @ model.step) * model.emit[c[t, :n]]
            s = a.sum(1)
            a = a / s[:, None]
            total[:n] += np.log10(s)
        out[take] = total
    return out


def score(corpus: Corpus, model: Model) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    sent = corpus.coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                at = np.frombuffer(row.at, dtype=np.int64)
                cls = _unzip(row.classes, int(at[-1]), np.uint16)
                yield pd.DataFrame(
                    {
                        "id": list(row.ids),
                        "n_tokens": np.diff(at),
                        "n_known": row.known,
                        "base_score": row.base,
                        "score": log10_forward(sent.value, cls, at[:-1], np.diff(at)) + row.inner,
                    }
                )

    found = corpus.coded.mapInPandas(run, "id string, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(corpus.tokens).cast("long"))
