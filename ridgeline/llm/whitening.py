"""Whitening directions from a QR of blocks and a bidiagonal qd solver.

The centred rows are never multiplied into a covariance. Tasks reduce their
rows to a triangle (Householder QR), triangles are stacked and reduced again in
groups until one is left, and only that d x d triangle R meets the driver. There
R is brought to upper bidiagonal form B by Householder reflections; dqds finds
the singular values of B to high relative accuracy, small ones included; and
twisted factorisations of B'B - e give each right singular vector from the two
qd transforms that meet at its largest entry. Vectors of values that nearly
coincide are made orthogonal to each other. With n rows fitted, an eigenvalue
of the covariance is a squared singular value over n.

Cases: null vectors and vectors with a null or non-finite entry drop out, and so
do empty ones; of vectors of unlike length the most frequent length stays (of
equally frequent ones the longest); repeated vectors are fitted once and answered
row by row, null ids included; components of no variance (one distinct vector,
copied dimensions, n below d) have no direction and are not returned; ties in
eigenvalue come in either order; an empty table gives no rows; further columns
play no part. Entries whose whole numbers do not fit the exact sums are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.registry import query

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows that a task stacks before it reduces them, and triangles that one group reduces.
QR_ROWS, FAN_IN = 4096, 32
#: Singular values below this share of the largest are no variance.
NO_VARIANCE = 1e-13
#: Eigenvalues closer than this, relatively, share one orthogonal basis.
CLOSE = 1e-3
EPS = np.finfo(np.float64).eps
LONG = (1 << 63) - 1


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right rotation V of ``r = U B V'``."""
    a, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        w, scale = x.copy(), np.abs(x).max(initial=0.0)
        if len(x) < 2 or not np.any(x[1:]):
            return None
        w /= scale
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := mirror(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k + 2 < d and (w := mirror(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform with shift: new q, e and the least intermediate."""
    n, d = len(q), q[0] - shift
    new_q, new_e, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i] if new_q[i] != 0.0 else np.inf
        new_e[i] = e[i] * t
        d = d * t - shift
        least = min(least, d) if d == d else -np.inf
    new_q[-1] = d
    return new_q, new_e, least


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal, falling, by dqds.

    Positive quantities are only added, multiplied and divided, so small values
    come out as accurately as large ones. A shift that would overshoot the least
    eigenvalue shows as a negative intermediate and is tried again smaller.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (above / scale) ** 2], 0.0)]
    while todo:
        q, e, moved = todo.pop()
        tries, best = 0, 0.25
        while len(q) > 1:
            if e[-1] <= EPS * EPS * (q[-1] + moved):
                found.append(max(q.pop(), 0.0) + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (min(q[i], q[i + 1]) + moved)), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if tries % 64 == 63 and q[0] < q[-1]:  # small values on top converge slowly: turn the matrix round
                q, e = q[::-1], e[::-1]
            tail, prior = q[-1], q[-2] + e[-2] if len(e) > 1 else q[-2]
            half, off = (tail + e[-1] - prior) / 2.0, e[-1] * q[-2]
            guess = tail + e[-1] - half - np.sqrt(half * half + off) if tries else 0.0
            shift = max(0.0, min(guess, min(q))) * (1.0 - 4.0 * EPS)
            while True:
                new_q, new_e, least = _dqds(q, e, shift)
                if least >= 0.0 or shift == 0.0:
                    break
                shift = max(0.0, shift + least) if shift + least < shift * (1 - best) and np.isfinite(least) else shift * best
                if shift < EPS * EPS * (q[-1] + moved):
                    shift = 0.0
            q, e, moved, tries = [max(x, 0.0) for x in new_q], new_e, moved + shift, tries + 1
            if tries > 400 * len(q) + 4000:
                raise ArithmeticError("the qd iteration does not settle")
        found.append(max(q[0], 0.0) + moved)
    return np.sort(np.array(found))[::-1] * scale * scale


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B'B = L D L' for an eigenvalue, from the twist where the residual is least.

    The stationary qd transform factors L D L' - value downwards, the progressive
    one upwards; the row where their remainders meet with the least sum is the
    twist, and the vector follows from there by products alone.
    """
    n = len(diagonal)
    tiny = EPS * EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    diagonal = np.where(np.abs(diagonal) < tiny, tiny, diagonal)
    d, low = diagonal * diagonal, above / diagonal[:-1]
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n - 1), np.empty(n - 1)
    s[0], p[-1] = -value, d[-1] - value

    def safe(x: float) -> float:
        return x if abs(x) > tiny * tiny else -tiny * tiny

    for i in range(n - 1):
        down[i] = low[i] * d[i] / safe(s[i] + d[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] * low[i] + p[i + 1])
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.nan_to_num(np.abs(s + p + value), nan=np.inf)
    k = int(np.argmin(gamma))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and unit right singular vectors (columns) of the first.

    Values of one cluster may give the same twisted vector; what is left of it
    after the earlier ones are taken out, or a fresh start where nothing is left,
    is then brought into the cluster's space by inverse iteration.
    """
    diagonal, above, v = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    keep = min(wanted, int((values > values[0] * NO_VARIANCE ** 2).sum())) if len(values) and values[0] > 0 else 0
    z = np.zeros((len(values), keep))
    b = np.diag(diagonal) + np.diag(above, 1)
    square = b.T @ b
    rng = np.random.default_rng(0)

    def apart(x: np.ndarray, from_: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - from_ @ (from_.T @ x)
        return x

    for j in range(keep):
        near = z[:, [i for i in range(j) if values[i] - values[j] <= CLOSE * values[i]]]
        x = apart(twisted_vector(diagonal, above, values[j]), near)
        for _ in range(6 if near.shape[1] else 0):
            if np.linalg.norm(x) > 0.1:
                x /= np.linalg.norm(x)
                if np.linalg.norm(square @ x - values[j] * x) <= 16 * EPS * values[0] * len(values):
                    break
            else:
                x = apart(rng.standard_normal(len(values)), near)
            shifted = square - values[j] * (1.0 + 8 * EPS) * np.eye(len(values))
            x = np.linalg.solve(shifted + np.diag(np.full(len(values), EPS * EPS * values[0])), x)
            x = apart(x / np.linalg.norm(x), near)
        z[:, j] = x / np.linalg.norm(x)
    return values, v @ z


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: n, sums S, eigenvalues, directions (columns) and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S/n as a whole part and a rest, so that x - S/n keeps its digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.centre
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values[:self.vectors.shape[1]])

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n*x - S)^2 by row, exact."""
        whole, _ = self.centre
        rest = np.array([s % self.n for s in self.sums], object)
        gap = x - whole
        bound = self.n * (int(np.abs(gap).max(initial=0)) + 1)
        if bound * bound * max(1, x.shape[1]) <= LONG:
            return ((gap * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        out = [int(v) for v in ((gap.astype(object) * self.n - rest) ** 2).sum(axis=1)]
        if max(out, default=0) > LONG:
            raise OverflowError("a deviation does not fit a long")
        return out


def scaled(rows: DataFrame) -> DataFrame:
    """(id, vector) to (id, x): whole vectors of finite rows, of the most frequent length."""
    v = F.col("vector")
    fit = rows.where(v.isNotNull() & (F.size(v) > 0)).select("id", v.cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = fit.where(~odd)
    lengths = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    most = lengths.first()
    fit = fit.where(F.size("v") == (most.d if most else 0))
    return fit.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))


def triangles(fit: DataFrame, centre: Fit, width: int, at: str) -> np.ndarray:
    """R of the centred rows: one triangle a task, then groups of triangles, until one is left."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            x = _stack(b.column(0), width)
            for i in range(0, len(x), QR_ROWS):
                r = np.linalg.qr(np.vstack([r, centre.centred(x[i:i + QR_ROWS])]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            for row in b.column(0):
                r = np.linalg.qr(np.vstack([r, np.array(row.as_py()).reshape(-1, width)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    rs, turn = stored(fit.select("x").mapInArrow(reduced, "r array<double>"), at, "triangles-0"), 0
    while (left := rs.count()) > 1:
        turn += 1
        rs = stored(rs.repartition(-(-left // FAN_IN)).mapInArrow(again, "r array<double>"), at, f"triangles-{turn}")
    r = np.array(rs.first().r).reshape(-1, width)
    return np.vstack([r, np.zeros((max(0, width - len(r)), width))])


def whole_sums(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Rows and exact sums by dimension; high and low halves are added apart."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for b in batches:
            x = _stack(b.column(0), width)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(high), pa.array(low)],
                                         ["i", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(halves, "i int, n bigint, high bigint, low bigint")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return rows[0].n, tuple((r.high << 32) + r.low for r in rows)


def fit_whitening(rows: DataFrame, at: str, wanted: int = COMPONENTS) -> Fit | None:
    """Fit on each distinct ``x`` once; None where there is no row."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    width = first.d
    fit = stored(rows.select("x").distinct(), at, "fit_list")
    n, s = whole_sums(fit, width)
    centre = Fit(n, s, np.zeros(0), np.zeros((width, 0)), 0.0)
    squares, vectors = directions(triangles(fit, centre, width, at), wanted)
    values = squares / n
    return Fit(n, s, values, vectors, float(values.sum()))


def identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest entry, without sign, of the fit list's whitened covariance less the identity."""
    k, width = fit.vectors.shape[1], len(fit.sums)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for b in batches:
            w = fit.whitened(_stack(b.column(0), width))
            total += np.column_stack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x").mapInArrow(gram, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (k + 1))
    for c in cells:
        total[c.cell] = c.v
    total = total.reshape(k, k + 1) / fit.n
    mean = total[:, k]
    return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(rows: DataFrame, at: str, wanted: int = COMPONENTS) -> DataFrame:
    """(id, vector) to (id, component, n, deviation, whitened, explained, identity_error).

    ``at`` is a folder that all executors share. The driver holds d sums, one
    d x d triangle and the directions, whatever the number of rows.
    """
    schema = "id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    whole = stored(scaled(rows), at, "scaled")
    fit = fit_whitening(whole, at, wanted)
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    k, width = fit.vectors.shape[1], len(fit.sums)
    error = identity_error(rows.sparkSession.read.parquet(f"{at}/fit_list"), fit)
    explained = fit.values[:k] / fit.trace if k else np.zeros(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column(1), width)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, fit.n), pa.int64()), pa.array(fit.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(fit.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.select(F.col("id").cast("bigint").alias("id"), "x").mapInArrow(project, schema)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first sixteen whitening directions."""
    rows = only(documents(spark, sf_dir, "embeddings"), id="vec_id", vector="embedding")
    return whiten(rows, shared_folder(spark)).withColumnRenamed("id", "vec_id")
