"""Whitening of embeddings on their leading principal components, by block Jacobi-Davidson.

The covariance is never formed. All that touches the rows is the product
``C'(C v) / n`` with the centred vectors ``C``: tasks add it up over their blocks of
rows, Spark adds up the tasks, and the driver receives as many numbers as the
block of directions ``v`` holds. On the driver stays what depends on the dimension alone:

1. Rayleigh-Ritz on the search space gives the wanted pairs and their residuals.
2. Pairs whose residual has reached double precision are locked, largest first; the
   search goes on at right angles to them.
3. For all others at once the projected correction equation
   ``(I - QQ')(A - theta I)(I - QQ') t = -r`` is solved by a few steps of MINRES (a
   product for each step serves all pairs), and the solutions widen the space.

Entries become integers ``floor(64 c) + 1000000``; sums and the deviation are exact,
and rows are centred by ``(n x - S) / n`` before anything is multiplied.

Defined cases
- Vectors that are null, or hold a null, NaN or infinite entry, are dropped.
- Shorter vectors: missing entries count as 0. Repeated rows and ids, null ids: each is a row.
- ``64 c`` beyond 2^53 either way is held there. A deviation beyond 64 bits is held at the largest long.
- Components whose eigenvalue is zero to rounding cannot be scaled and are left out; so
  equal vectors, a single one, or an empty table give no rows.
- Columns besides the two given are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderscope.llm.common import cut_lineage

SCALE, SHIFT = 64, 1_000_000
#: Rows of a block.
BLOCK_ROWS = 4096
#: Largest part of an entry that doubles hold as an integer.
LARGEST = 2.0**53
LONGEST = 2**63 - 1
#: Steps of MINRES for each widening of the search space, and where they may stop (of the residual).
STEPS, SLACK = 8, 0.05
#: Search directions for each wanted component before the space is narrowed to the best.
SPACE = 4
#: Rounds after which residuals that no longer fall are given out as they are.
ROUNDS = 60
EPS = float(np.finfo(float).eps)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        vectors = b["v"]
        size = np.diff(vectors.offsets.to_numpy())
        at = np.concatenate(([0], np.cumsum(size)))
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        given = vectors.is_valid().to_numpy(zero_copy_only=False)
        # rows that are null hold no entries once flattened
        size = np.where(given, size, 0)
        at = np.concatenate(([0], np.cumsum(size)))
        wrong = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        keep = np.flatnonzero(given & (wrong[at[1:]] == wrong[at[:-1]]))
        for lo in range(0, keep.size, BLOCK_ROWS):
            rows = keep[lo : lo + BLOCK_ROWS]
            width = int(size[rows].max())
            inside = np.arange(width) < size[rows][:, None]
            c = np.zeros((rows.size, width))
            c[inside] = flat[(at[rows][:, None] + np.arange(width))[inside]]
            with np.errstate(over="ignore"):  # beyond the largest double counts as beyond LARGEST
                x = np.floor(np.clip(SCALE * c, -LARGEST, LARGEST)).astype("<i8") + SHIFT
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, rows.size], b["id"].take(pa.array(rows))), pa.array([width], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                ["ids", "width", "x"],
            )


def integer_blocks(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``ids, width, x``: the vectors that take part, as blocks of 64-bit integers; no shuffle."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return cut_lineage(rows.mapInArrow(_blocks, "ids array<long>, width int, x binary"))


@dataclass(frozen=True)
class Centre:
    """Number of rows and, for each dimension, the sum ``S = n * base + rest`` with ``0 <= rest < n``."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    @property
    def dims(self) -> int:
        return self.base.size

    def scaled(self, raw: bytes, width: int) -> np.ndarray:
        """``n x - S`` of a block, exactly: 64-bit integers, or Python's where these are too short."""
        y = np.full((len(raw) // 8 // width if width else 0, self.dims), SHIFT, dtype=np.int64)
        y[:, :width] = np.frombuffer(raw, "<i8").reshape(-1, width) if width else 0
        y -= self.base
        if self.n * (int(np.abs(y).max(initial=0)) + 1) >= 2**62:
            return self.n * y.astype(object) - self.rest.astype(object)
        return self.n * y - self.rest

    def rows(self, row: dict) -> np.ndarray:
        if not row["width"]:
            return np.tile(self.n * (SHIFT - self.base.astype(object)) - self.rest.astype(object), (len(row["ids"]), 1))
        return self.scaled(row["x"], row["width"])

    def centred(self, row: dict) -> np.ndarray:
        scaled = self.rows(row)
        return (scaled / self.n).astype(np.float64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    rows: dict[int, int] = {}
    n = 0
    for b in batches:
        for row in b.to_pylist():
            n += len(row["ids"])
            if not row["width"]:
                continue
            x = np.frombuffer(row["x"], "<i8").reshape(-1, row["width"])
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            for d in range(row["width"]):
                total[d] = total.get(d, 0) + (int(high[d]) << 32) + int(low[d])
                rows[d] = rows.get(d, 0) + len(x)
    at = [-1, *total]
    yield pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), pa.array([0, *total.values()], pa.decimal128(38, 0)), pa.array([n, *rows.values()], pa.int64())], ["at", "s", "n"]
    )


def centre_of(blocks: DataFrame) -> Centre | None:
    """Exact sums of all dimensions; None where no row or no dimension takes part."""
    found = blocks.mapInArrow(_sums, "at int, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sums = {r["at"]: (int(r["s"]), r["n"]) for r in found.collect()}
    n = sums.pop(-1, (0, 0))[1]
    if not n or not sums:
        return None
    whole = [s + (n - rows) * SHIFT for s, rows in (sums[d] for d in range(max(sums) + 1))]
    return Centre(n, np.array([s // n for s in whole], dtype=np.int64), np.array([s % n for s in whole], dtype=np.int64))


def _added(blocks: DataFrame, size: int, part: Callable[[dict], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part``'s ``size`` numbers; tasks add up their blocks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for row in b.to_pylist():
                total += part(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "s"])

    found = blocks.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["s"]
    return out


def covariance_product(blocks: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """``v -> V v`` for the covariance V of the rows, for any number of directions at once."""

    def product(v: np.ndarray) -> np.ndarray:
        def part(row: dict) -> np.ndarray:
            c = centre.centred(row)
            return (c.T @ (c @ v)).ravel()

        return _added(blocks, v.size, part).reshape(v.shape) / centre.n

    return product


def _right_angled(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``t`` outside of ``bases`` (which are orthonormal); none for what they span already."""
    size = np.linalg.norm(t, axis=0)
    t = t[:, size > 0] / size[size > 0]
    for _ in range(3):
        for q in bases:
            t = t - q @ (q.T @ t)
        if not t.shape[1]:
            return t
        u, s, _ = np.linalg.svd(t, full_matrices=False)
        t = u[:, s > 1e-10]
    return t


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, slack: float) -> np.ndarray:
    """Smallest residual of symmetric systems in their Krylov spaces; every column is a system of its own."""
    beta = np.linalg.norm(b, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, v_old = b / start, np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta = beta.copy()
    cos_old, cos, sin_old, sin = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        a = apply(v)
        alpha = (v * a).sum(0)
        v_new = a - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        rho1 = np.hypot(delta, beta_new)
        rho2, rho3 = sin * alpha + cos_old * cos * beta, sin_old * beta
        live = rho1 > 0
        rho1 = np.where(live, rho1, 1.0)
        cos_old, cos = cos, np.where(live, delta / rho1, 1.0)
        sin_old, sin = sin, np.where(live, beta_new / rho1, 0.0)
        w, w_old = (v - rho3 * w_old - rho2 * w) / rho1, w
        x += np.where(live, cos * eta, 0.0) * w
        eta = -sin * eta
        v_old, v = v, v_new / np.where(beta_new > 0, beta_new, 1.0)
        beta = beta_new
        if (np.abs(eta) <= slack * start).all():
            break
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dims: int, want: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues, falling, their unit vectors (columns) and the residuals they were locked at."""
    want = min(want, dims)
    space = _right_angled(np.random.default_rng(seed).standard_normal((dims, want)))
    image = product(space)
    locked, values, left = np.empty((dims, 0)), [], []
    least, still = np.inf, 0
    for turn in range(ROUNDS):
        theta, s = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        order = np.argsort(-theta)
        theta, s = theta[order], s[:, order]
        space, image = space @ s, image @ s  # Ritz vectors, the best first
        need = min(want - len(values), space.shape[1])
        rest = image - space * theta
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        top = max(values[0] if values else 0.0, float(theta[0]), 0.0)
        done = size[:need] <= 64 * EPS * np.sqrt(dims) * top
        whole = space.shape[1] + len(values) == dims
        worst = float(size[:need].max())
        still = still + 1 if worst > 0.5 * least else 0
        least = min(least, worst)
        # nothing is left to search, or rounding lets residuals fall no further
        last = whole and still >= 1 or still >= 8 or turn == ROUNDS - 1
        count = need if last or done.all() else int(np.argmin(done))
        if count:
            locked = np.hstack([locked, space[:, :count]])
            values += theta[:count].tolist()
            left += size[:count].tolist()
            space, image, theta, rest = space[:, count:], image[:, count:], theta[count:], rest[:, count:]
            need -= count
        if len(values) >= want or not need:
            break
        if space.shape[1] > SPACE * want - need:  # narrow to the best
            space, image, theta, rest = (a[..., : 2 * need] for a in (space, image, theta, rest))
        pairs, shift = space[:, :need], theta[:need]

        def project(x: np.ndarray) -> np.ndarray:
            x = x - locked @ (locked.T @ x)
            return x - pairs * (pairs * x).sum(0)

        def corrected(x: np.ndarray) -> np.ndarray:
            return project(product(x) - x * shift)

        if whole:  # the space holds all: measure its images afresh
            image = product(space)
            continue
        wide = _right_angled(project(minres(corrected, project(-rest[:, :need]), STEPS, SLACK)), locked, space)
        if not wide.shape[1]:
            wide = _right_angled(np.random.default_rng(seed + turn + 1).standard_normal((dims, need)), locked, space)
        wide = wide[:, : dims - space.shape[1] - locked.shape[1]]
        space, image = np.hstack([space, wide]), np.hstack([image, product(wide)])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(left)[order]


@dataclass(frozen=True)
class Whitening:
    """What the fit yields: ``axes`` are unit vectors (columns), ``values`` their variances, ``trace`` that of the covariance."""

    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float

    def project(self, row: dict) -> np.ndarray:
        return self.centre.centred(row) @ (self.axes / np.sqrt(self.values))


def fit(blocks: DataFrame, components: int = 32) -> Whitening | None:
    """None where no component has a variance."""
    centre = centre_of(blocks)
    if centre is None:
        return None
    values, axes, left = leading_pairs(covariance_product(blocks, centre), centre.dims, components)
    trace = float(_added(blocks, 1, lambda row: np.array([np.square(centre.centred(row)).sum()]))[0]) / centre.n
    keep = values > 64 * EPS * centre.dims * max(float(values[0]), 0.0)
    if not keep.any():
        return None
    found = Whitening(centre, axes[:, keep], values[keep], trace, left[keep], 0.0)
    k = int(keep.sum())

    def part(row: dict) -> np.ndarray:
        z = found.project(row)
        return np.concatenate([(z.T @ z).ravel(), z.sum(0)])

    sums = _added(blocks, k * k + k, part) / centre.n
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])
    return Whitening(centre, found.axes, found.values, trace, found.residuals, float(np.abs(covariance - np.eye(k)).max()))


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(blocks: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each vector and component; ``deviation`` is the sum of ``(n x - S)^2`` over all dimensions."""
    if model is None:
        return blocks.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.values.size
        for b in batches:
            for row in b.to_pylist():
                scaled = model.centre.rows(row)
                if int(np.abs(scaled).max()) ** 2 * model.centre.dims > LONGEST:
                    exact = scaled.astype(object)
                    deviation = np.array([min(int(x), LONGEST) for x in (exact * exact).sum(1)], dtype=np.int64)
                else:
                    deviation = np.square(scaled).sum(1).astype(np.int64)
                z = model.project(row)
                size = len(z) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i in row["ids"] for _ in range(k)], pa.int64()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))),
                        pa.array(np.full(size, model.centre.n, dtype=np.int64)),
                        pa.array(np.repeat(deviation, k)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(model.values / model.trace, len(z))),
                        pa.array(np.full(size, model.identity_error)),
                    ],
                    [part.split()[0] for part in SCHEMA.split(", ")],
                )

    return blocks.mapInArrow(run, SCHEMA)
