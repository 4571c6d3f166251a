"""Whitening of embeddings by incremental eigendecomposition.

Vectors are made whole numbers, ``floor(scale * c) + shift``. The mean is exact (sums are whole numbers). Then

1. every task keeps the eigenvalues and eigenvectors of what it has seen. A vector, less the mean, is a rank-one update
   D + z z' in these axes; components without weight and equal eigenvalues are deflated, the new eigenvalues are
   the roots of the secular equation 1 + sum z_j^2 / (d_j - t) = 0 between the old ones, and the eigenvectors come from
   weights computed back from the roots, so that they stay orthogonal. Equal vectors are counted
   first and are one update with a weight, so a third of all rows being one vector is one update;
2. the spectra of tasks are combined in a tree: each eigenpair of one is a rank-one update of the other. A spectrum has
   dimension^2 numbers, whatever it has seen;
3. a Rayleigh-Ritz step in the subspace of the leading vectors, with sums over all rows (dimension x subspace numbers a
   task). Its residual tells how far vectors are from being eigenvectors; while that is above rounding, the subspace is
   widened by the residuals and the step is done again.

Only one spectrum and the sums come to the driver. A vector that is null or holds null or non-finite entries takes no part.
Shorter vectors count as filled up with 0, entries beyond 2**40 in size (after scaling) as 2**40. A component without
variance can't be whitened: there are as many components as have a variance above rounding, none if all vectors are equal or
there is one. vec_id may be null or repeated; every row that takes part has its own result. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.session import write_stage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Vectors of the subspace beyond the components asked for.
SPARE = 8
#: Spectra that one task combines.
FAN_IN = 16
#: Size of an entry at most; larger ones count as this.
LARGEST = 1 << 40
#: Residual, relative to the largest eigenvalue, at which vectors count as eigenvectors.
CLOSE = 1e-12
_EPS = np.finfo(float).eps


# ---- rank-one updates -------------------------------------------------------------------


@np.errstate(all="ignore")
def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for rising d and no zero in z, and the matrix d_j - root_i without cancellation.

    Root i lies between d_i and d_i+1 (the last one below d_k + |z|^2). It is held as a pole and the distance to it; each turn
    fits a function with the two poles around the root, and halves the bracket where that leaves it."""
    k = len(d)
    weight = z * z
    total = weight.sum()
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    from_left = d[None, :] - d[:, None]
    near_left = 1 + (1 / (from_left - gap[:, None] / 2)) @ weight >= 0
    near_left[-1] = True
    origin = np.where(near_left, d, upper)
    delta = d[None, :] - origin[:, None]
    low = np.where(near_left, 0.0, -gap / 2)
    high = np.where(near_left, gap / 2, 0.0)
    high[-1] = gap[-1]
    tau = (low + high) / 2
    roots = np.empty(k)
    # of the roots still looked for: place, poles from the origin, which of them are below, the next ones on both sides
    open_, poles, below, left, right, t = np.arange(k), delta, np.tri(k), d - origin, upper - origin, tau
    for _ in range(100):
        inverse = 1 / (poles - t[:, None])
        f = 1 + inverse @ weight
        more = (np.abs(f) > _EPS * k * (1 + np.abs(inverse) @ weight)) & (high - low > 2 * _EPS * np.abs(t))
        if not more.all():
            roots[open_] = t
            if not more.any():
                break
            open_, poles, below, inverse = open_[more], poles[more], below[more], inverse[more]
            left, right, low, high, t, f = left[more], right[more], low[more], high[more], t[more], f[more]
        negative = f < 0
        low, high = np.where(negative, t, low), np.where(negative, high, t)
        inverse *= inverse
        both = inverse @ weight
        psi = (inverse * below) @ weight
        x, y = left - t, right - t
        c = f - x * psi - y * (both - psi)
        a = (x + y) * f - x * y * both
        b = x * y * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        new = t + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        # a step that isn't a number is outside too
        t = np.where((new > low) & (new < high), new, (low + high) / 2)
    else:
        roots[open_] = t
    return origin + roots, delta - roots[:, None]


def rank_one(values: np.ndarray, axes: np.ndarray, vector: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) after weight * vector vector' was added."""
    z = (axes.T @ vector) * np.sqrt(weight)
    total = float(z @ z)
    if not total > 0:
        return values, axes
    small = 8 * _EPS * max(float(values[-1]), total)
    active = np.flatnonzero(np.abs(z) * np.sqrt(total) > small)
    if not len(active):
        return values, axes
    d = values[active]
    w = z[active]
    apart = np.diff(d)
    if len(active) > 1 and (np.abs(apart * w[1:] * w[:-1]) <= small * (w[1:] ** 2 + w[:-1] ** 2)).any():
        axes = axes.copy()
        kept = [int(active[0])]
        z = z.copy()
        for j in active[1:].tolist():
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((values[j] - values[i]) * c * s) <= small:
                # the plane of both is turned so that one of them has no weight
                z[i], z[j] = 0.0, r
                first, second = axes[:, i].copy(), axes[:, j].copy()
                axes[:, i], axes[:, j] = c * first - s * second, s * first + c * second
                kept[-1] = j
            else:
                kept.append(j)
        active = np.array(kept)
        d, w = values[active], z[active]
    roots, apart = secular_roots(d, w)
    k = len(d)
    # weights that have these roots exactly
    if k > 1:
        poles = d[:, None] - d[None, :]  # of root i (row) and weight j (column)
        ratio = -apart  # root_i - d_j
        above = np.append(d[1:], np.inf)[:, None] - d[None, :]
        before = np.tri(k, k=-1, dtype=bool).T  # i < j
        bottom = np.where(before, poles, above)
        bottom[-1] = 1.0
        exact = np.sqrt(np.abs(np.prod(ratio / bottom, axis=0))) * np.sign(w)
    else:
        exact = w
    vectors = exact[None, :] / apart
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    new_values, new_axes = values.copy(), axes.copy()
    new_values[active] = roots
    new_axes[:, active] = axes[:, active] @ vectors.T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_axes[:, order]


def combine(spectra: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the sum: the eigenpairs of the others are rank-one updates of the first."""
    values, axes = spectra[0]
    for others, vectors in spectra[1:]:
        for value, vector in zip(others.tolist(), vectors.T, strict=True):
            if value > 0:
                values, axes = rank_one(values, axes, vector, value)
    return values, axes


# ---- whole numbers ----------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector, of rows without null or non-finite entries."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("c"))


def _whole(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * c) of each entry; shorter vectors are filled up."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


@dataclass(frozen=True)
class Fit:
    """Rows, and per dimension the sum of the whole numbers (without the shift, which no result depends on)."""

    n: int
    sums: tuple[int, ...]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return len(self.sums)

    def _base(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums as n * base + rest."""
        base = [s // self.n for s in self.sums]
        return np.array(base, dtype=np.int64), np.array([(s - self.n * b) for s, b in zip(self.sums, base, strict=True)], dtype=object)

    def centred(self, column: pa.Array) -> np.ndarray:
        base, rest = self._base()
        return (_whole(column, self.width, self.scale) - base).astype(np.float64) - np.array([r / self.n for r in rest])

    def deviations(self, column: pa.Array) -> list[int]:
        """Sum of (n * x - S)^2 in whole numbers of any size."""
        base, rest = self._base()
        y = _whole(column, self.width, self.scale) - base
        if len(y) and (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, self.width) < 1 << 63:
            return ((self.n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * y.astype(object) - rest) ** 2).sum(axis=1).tolist() if self.width else [0] * len(y)


def exact_sums(rows: DataFrame, scale: int = SCALE) -> Fit:
    """Number of rows and exact sums; one row per dimension comes to the driver."""
    width = rows.agg(F.max(F.size("c"))).first()[0] or 0
    schema = "place int, n long, total decimal(38,0)"
    arrow = pa.schema([("place", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def add(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = _whole(batch.column(0), width, scale)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        if n:
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    found = rows.select("c").mapInArrow(add, schema).groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    told = sorted(found.collect())
    return Fit(int(told[0]["n"]) if told else 0, tuple(int(r["total"]) for r in told), scale)


# ---- spectra ----------------------------------------------------------------------------

_SPECTRUM = "node long, d binary, q binary"


def _spectrum(row: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["d"]), np.frombuffer(row["q"]).reshape(width, width)


def task_spectra(rows: DataFrame, fit: Fit) -> DataFrame:
    """One spectrum per task, of distinct vectors with their number."""
    arrow = pa.schema([("node", pa.int64()), ("d", pa.binary()), ("q", pa.binary())])
    width = fit.width

    def update(batches):
        values, axes, seen = np.zeros(width), np.eye(width), False
        for batch in batches:
            for vector, times in zip(fit.centred(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                values, axes = rank_one(values, axes, vector, float(times))
                seen = True
        if seen:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.int64()), pa.array([values.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(axes).tobytes()], pa.binary())],
                schema=arrow,
            )

    whole = F.transform("c", lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(F.lit(float(fit.scale)) * x).cast("double"))) / F.lit(float(fit.scale)))
    distinct = rows.groupBy(whole.alias("c")).agg(F.count(F.lit(1)).alias("times"))
    return distinct.mapInArrow(update, _SPECTRUM)


def whole_spectrum(rows: DataFrame, fit: Fit, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance (rising) and eigenvectors, combined from all tasks in a tree."""
    width = fit.width

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        d, q = combine([_spectrum(row, width) for _, row in group.iterrows()])
        return pd.DataFrame({"node": [int(group["node"].iloc[0]) // fan_in], "d": [d.tobytes()], "q": [np.ascontiguousarray(q).tobytes()]})

    spectra = write_stage(task_spectra(rows, fit), "spectra")
    while (spectra.agg(F.max("node")).first()[0] or 0) > 0:
        spectra = write_stage(spectra.groupBy(F.floor(F.col("node") / fan_in)).applyInPandas(merged, _SPECTRUM), "spectra")
    d, q = _spectrum(spectra.first(), width)
    return d / fit.n, q.copy()


def _summed(rows: DataFrame, width: int, columns: int, part) -> np.ndarray:
    """Sum over all rows of ``part(batch)``, a matrix; one matrix per task is shuffled, by cells."""
    arrow = pa.schema([("row", pa.int32()), ("cells", pa.list_(pa.float64()))])

    def run(batches):
        total = np.zeros((width, columns))
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=arrow)

    partial = rows.mapInArrow(run, "row int, cells array<double>")
    cells = partial.select("row", F.posexplode("cells").alias("place", "value"))
    summed = cells.groupBy("row", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((width, columns))
    for row, place, value in summed.collect():
        out[row, place] = value
    return out


@dataclass(frozen=True)
class Whitening:
    fit: Fit
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # columns
    trace: float

    def whitened(self, column: pa.Array) -> np.ndarray:
        return (self.fit.centred(column) @ self.axes) / np.sqrt(self.values)


def rayleigh_ritz(rows: DataFrame, fit: Fit, start: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the covariance, from a subspace that is near."""
    width, best = fit.width, np.inf
    basis = start
    while True:
        basis, _ = np.linalg.qr(basis)

        def part(batch, basis=basis):
            y = fit.centred(batch.column(0))
            return y.T @ (y @ basis)

        image = _summed(rows.select("c"), width, basis.shape[1], part) / fit.n
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes, residual = basis @ turn, image @ turn - (basis @ turn) * values
        k = min(components, len(values))
        error = float(np.abs(residual[:, :k]).max(initial=0)) / max(float(values[0]), 1e-300)
        if error <= CLOSE or error > best / 2 or basis.shape[1] == width:
            return values[:k], axes[:, :k]
        best = error
        basis = np.hstack([axes, residual[:, : width - basis.shape[1]]])


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """None without rows or variance."""
    rows = usable(vectors)
    fit = exact_sums(rows, scale)
    if not fit.n or not fit.width:
        return None
    values, axes = whole_spectrum(rows, fit)
    trace = float(values.sum())
    if not trace > 0:
        return None
    wanted = min(fit.width, components + SPARE)
    found, axes = rayleigh_ritz(rows, fit, axes[:, ::-1][:, :wanted], components)
    # without variance: what rounding of vectors of this size leaves
    there = found > 64 * _EPS * fit.width * found[0]
    return Whitening(fit, found[there], axes[:, there], trace)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows less the identity."""
    k = len(model.values)

    def part(batch):
        w = model.whitened(batch.column(0))
        return np.vstack([w.T @ w, w.sum(axis=0)[None, :]])

    sums = _summed(usable(vectors).select("c"), k + 1, k, part) / model.fit.n
    covariance = sums[:k] - np.outer(sums[k], sums[k])
    return float(np.abs(covariance - np.eye(k)).max())


_RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector and component (from 1, by falling eigenvalue)."""
    model = fit_whitening(vectors, components, scale)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    error = identity_error(vectors, model)
    k = len(model.values)
    explained = model.values / model.trace
    arrow = pa.schema(
        [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
         ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
    )

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            place = pa.array(np.repeat(np.arange(rows), k))
            total = pa.array([Decimal(d) if d < 10**38 else None for d in model.fit.deviations(batch.column(1))], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(place), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.fit.n)), total.take(place), pa.array(model.whitened(batch.column(1)).ravel()),
                    pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ],
                schema=arrow,
            )

    return usable(vectors).mapInArrow(run, _RESULT)


def whitening_report(vectors: DataFrame) -> DataFrame:
    """As ``whiten``, with the deviation as long (null where it is too large for one)."""
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
