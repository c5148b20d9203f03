"""Embedding whitening by incremental eigendecomposition.

Every partition folds its vectors one by one into a spectrum (count, mean, eigenvalues and eigenvectors of the scatter
matrix): a vector is a centred rank-one update, whose eigenvalues are the roots of a secular equation and whose
eigenvectors follow from them; zero components and equal eigenvalues are deflated first.  Spectra meet in a tree of Spark
groups, where one is applied to the other as successive rank-one updates.  A last distributed Rayleigh-Ritz step projects
all centred rows on the basis so found and turns it into the eigenvectors of the exact covariance, to double precision.

A spectrum has dimension squared numbers and nothing else leaves a task, so memory and what reaches the driver (one
spectrum, one projected matrix) depend on the dimension only.

Cases: rows whose vector is null, or holds a null, NaN, infinite entry, take no part; nor do rows of another length than
the most frequent one (of equally frequent ones the longest).  Repeated rows count as often as they occur.  Equal
eigenvalues give any orthonormal basis of their space, the same one for all rows.  A component without variance (under
1e-13 of the trace) whitens to 0.  An empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.llm.common import fresh, q, read
from pagelake.session import materialize

EPS = np.finfo(float).eps
FAN_IN = 16
NO_VARIANCE = 1e-13
SPECTRUM = "part long, n long, mean binary, eigenvalues binary, vectors binary, sums binary"


# ---- rank-one updates of a symmetric eigendecomposition

def _roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)) for rising, distinct ``d`` and ``z`` without zeros: the roots, and
    the matrix d_j - x_i (row j, column i), accurate to rounding since each root is measured from its nearer pole."""
    k = len(d)
    w = rho * z * z
    top = d[-1] + w.sum()
    right = np.append(d[1:], top)
    half = (right - d) / 2
    at_half = 1 + (w[:, None] / (d[:, None] - (d + half)[None, :])).sum(0)
    near_left = at_half >= 0
    near_left[-1] = True
    pole = np.where(near_left, d, right)
    low = np.where(near_left, 0.0, -half)
    high = np.where(near_left, half, 0.0)
    if at_half[-1] < 0:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    gap = d[:, None] - pole[None, :]
    lower = np.tri(k, k).T.astype(bool)  # poles j <= i
    next_gap = np.append(d[1:], top + (top - d[-1]) + 1.0) - pole
    own_gap = d - pole
    x = (low + high) / 2
    open_ = np.ones(k, bool)
    for _ in range(60):
        delta = gap - x
        part = w[:, None] / delta
        value = 1 + part.sum(0)
        size = 1 + np.abs(part).sum(0)
        low = np.where(value < 0, x, low)
        high = np.where(value > 0, x, high)
        open_ &= (np.abs(value) > 4 * EPS * size) & (high - low > 2 * EPS * np.abs(x))
        if not open_.any():
            break
        slope = part / delta
        below = np.where(lower, slope, 0.0).sum(0)
        above = slope.sum(0) - below
        d0, d1 = own_gap - x, next_gap - x
        c = value - d0 * below - d1 * above
        a = (d0 + d1) * value - d0 * d1 * (below + above)
        b = d0 * d1 * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = (new > low) & (new < high)
        x = np.where(open_, np.where(inside, new, (low + high) / 2), x)
    return pole + x, gap - x


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(values) vectors^T + rho x x^T`` for rho >= 0."""
    z = x @ vectors
    norm2 = float(z @ z)
    if not rho * norm2 > 0:
        return values, vectors
    scale = max(float(np.abs(values).max()), rho * norm2)
    tolerance = 8 * EPS * scale
    # Equal eigenvalues: turn their eigenvectors so that only one of them meets x.
    cut = np.flatnonzero(np.diff(values) > tolerance) + 1
    if len(cut) + 1 < len(values):
        vectors = vectors.copy()
        for at in np.split(np.arange(len(values)), cut):
            if len(at) < 2:
                continue
            v = z[at].copy()
            length = np.sqrt(v @ v)
            v[0] += np.copysign(length, v[0])
            if (s := v @ v) > 0:
                block = vectors[:, at]
                vectors[:, at] = block - np.outer(block @ v, v) * (2 / s)
                z[at[0]], z[at[1:]] = -np.copysign(length, z[at[0]]), 0.0
    active = rho * np.sqrt(norm2) * np.abs(z) > tolerance
    if not active.any():
        return values, vectors
    d, w = values[active], z[active]
    roots, delta = _roots(d, w, rho)
    # The vector whose update has exactly these roots: its eigenvectors are orthogonal to rounding.
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    exact = np.copysign(np.sqrt(np.maximum(np.prod(-delta / apart, axis=1) / rho, 0)), w)
    turned = exact[:, None] / delta
    turned /= np.sqrt((turned * turned).sum(0))
    merged = np.concatenate([values[~active], roots])
    basis = np.concatenate([vectors[:, ~active], vectors[:, active] @ turned], axis=1)
    order = np.argsort(merged, kind="stable")
    return merged[order], basis[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of the vectors seen so far."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        away = x - self.mean
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def merge(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        """Apply another spectrum: one rank-one update for each of its eigenpairs and one for the distance of means."""
        if not self.n:
            self.n, self.mean, self.values, self.vectors = n, mean, values, vectors
            return
        for value, vector in zip(values, vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        away, total = mean - self.mean, self.n + n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * n / total)
        self.mean, self.n = self.mean + away * (n / total), total


# ---- distributed steps

def matrix(array) -> np.ndarray:
    """The rows of a list column without nulls as a matrix of doubles."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def _row(part: int, s: Spectrum, sums: np.ndarray) -> dict:
    return {"part": part, "n": s.n, "mean": s.mean.tobytes(), "eigenvalues": s.values.tobytes(),
            "vectors": np.ascontiguousarray(s.vectors).tobytes(), "sums": sums.tobytes()}


def _spectra(df: DataFrame, column: str, prepare) -> DataFrame:
    """One spectrum for each partition with rows, and the sums of its (whole-number) entries as longs."""
    def scan(batches):
        state, sums = None, None
        for batch in batches:
            rows = prepare(matrix(batch.column(0)))
            if not len(rows):
                continue
            if state is None:
                state, sums = Spectrum(rows.shape[1]), np.zeros(rows.shape[1], np.int64)
            sums += np.floor(rows).astype(np.int64).sum(0)
            for x in rows:
                state.add(x)
        if state is not None:
            yield pa.RecordBatch.from_pylist([_row(TaskContext.get().partitionId(), state, sums)], schema=_ARROW)

    return df.select(q(column)).mapInArrow(scan, SPECTRUM)


_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in (
    "mean", "eigenvalues", "vectors", "sums")]])


def tree(parts: DataFrame, merge, name: str) -> DataFrame:
    """Fold the rows of ``parts`` (with a ``part`` number) by ``merge(rows) -> row`` in groups of ``FAN_IN`` until one
    row is left; each level is written to the shared folder."""
    schema = parts.schema
    parts = materialize(parts, name)
    while parts.limit(2).count() > 1:
        def fold(key, table):
            return pa.Table.from_pylist([merge(table.to_pylist()) | {"part": key[0].as_py()}], schema=table.schema)

        level = parts.withColumn("part", F.expr(f"part div {FAN_IN}"))
        parts = materialize(level.groupBy("part").applyInArrow(fold, schema), name)
    return parts


def _merge_spectra(rows: list[dict]) -> dict:
    state, sums = None, 0
    for r in sorted(rows, key=lambda r: -r["n"]):
        mean = np.frombuffer(r["mean"])
        if state is None:
            state = Spectrum(len(mean))
        state.merge(r["n"], mean, np.frombuffer(r["eigenvalues"]), np.frombuffer(r["vectors"]).reshape(len(mean), -1))
        sums = sums + np.frombuffer(r["sums"], np.int64)
    return _row(0, state, sums)


def _moments(df: DataFrame, column: str, project, name: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred scatter matrix of ``project(rows)`` over all rows."""
    def scan(batches):
        held = None
        for batch in batches:
            y = project(matrix(batch.column(0)))
            if len(y):
                held = _add_moments(held, (len(y), y.mean(0), (c := y - y.mean(0)).T @ c))
        if held is not None:
            row = {"part": TaskContext.get().partitionId(), "n": held[0], "mean": held[1].tobytes(), "scatter": held[2].tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())]))

    def merge(rows):
        held = None
        for r in rows:
            mean = np.frombuffer(r["mean"])
            held = _add_moments(held, (r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1)))
        return {"part": 0, "n": held[0], "mean": held[1].tobytes(), "scatter": held[2].tobytes()}

    parts = df.select(q(column)).mapInArrow(scan, "part long, n long, mean binary, scatter binary")
    r = tree(parts, merge, name).first()
    mean = np.frombuffer(r["mean"])
    return r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1)


def _add_moments(a, b):
    if a is None:
        return b
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


@dataclass
class Whitening:
    """``components``: unit eigenvectors (columns) by falling variance ``variances``; ``sums``: of the entries' floors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    def scales(self) -> np.ndarray:
        """One over the deviation of each component, 0 for those without variance."""
        floor = NO_VARIANCE * max(float(self.variances.sum()), np.finfo(float).tiny)
        return np.where(self.variances > floor, 1 / np.sqrt(np.maximum(self.variances, floor)), 0.0)

    def explained(self) -> np.ndarray:
        total = float(self.variances.sum())
        return self.variances / total if total > 0 else np.zeros(len(self.variances))


def usable(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is complete and has the length that most complete ones have."""
    v = q(column)
    finite = df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = finite.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return finite.where(F.size(v) == size["size"]) if size and size["size"] else finite.where("1 = 0")


def _same(rows: np.ndarray) -> np.ndarray:
    return rows


def fit(df: DataFrame, column: str, prepare=_same) -> Whitening | None:
    """The whitening of all vectors of ``column`` (see ``usable``); ``prepare`` maps a matrix of rows to the vectors
    meant.  None for an empty table."""
    found = tree(_spectra(df, column, prepare), _merge_spectra, "spectra").first()
    if found is None:
        return None
    mean = np.frombuffer(found["mean"])
    basis, _ = np.linalg.qr(np.frombuffer(found["vectors"]).reshape(len(mean), -1)[:, ::-1])
    # Rayleigh-Ritz: the covariance in that basis, centred on the mean, is diagonal but for rounding.
    n, off, scatter = _moments(df, column, lambda rows: (prepare(rows) - mean) @ basis, "ritz")
    values, turn = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    components = basis @ turn[:, ::-1]
    components *= np.sign(components[np.abs(components).argmax(0), np.arange(components.shape[1])])
    return Whitening(n, np.frombuffer(found["sums"], np.int64), mean + basis @ off, components, np.maximum(values[::-1], 0))


def project(rows: np.ndarray, model: Whitening, components: int, mean: np.ndarray | None = None) -> np.ndarray:
    k = min(components, len(model.variances))
    return ((rows - (model.mean if mean is None else mean)) @ model.components[:, :k]) * model.scales()[:k]


def whiten(df: DataFrame, column: str, model: Whitening, components: int, prepare=_same) -> DataFrame:
    """``df`` with ``whitened``: the first ``components`` whitened coordinates of each usable row."""
    kept = usable(df, column)
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    at = kept.columns.index(column)
    schema = T.StructType([*plain.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def scan(batches):
        for batch in batches:
            y = project(prepare(matrix(batch.column(at))), model, components) if batch.num_rows else np.zeros((0, components))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], names=schema.fieldNames())

    return plain.mapInArrow(scan, schema).toDF(*kept.columns, *fresh(kept, "whitened"))


def identity_error(df: DataFrame, column: str, model: Whitening, components: int, prepare=_same) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    n, _, scatter = _moments(df, column, lambda rows: project(prepare(rows), model, components), "identity")
    live = model.scales()[:scatter.shape[0]] > 0
    off = np.abs(scatter / n - np.eye(len(scatter)))[live][:, live]
    return float(off.max()) if off.size else 0.0


# ---- the registered query

COMPONENTS = 8
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def grid(rows: np.ndarray) -> np.ndarray:
    """The whole numbers floor(1024 c) + 100000 of float entries, as doubles."""
    return np.floor(1024 * rows) + 100000


def _deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 as whole numbers; null where it is no long."""
    rough = np.square(n * (rows - sums / n)).sum(1)
    if rough.size and rough.max() > 2.0 ** 62:
        exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(r, sums, strict=True)) for r in rows]
        return pa.array([v if v < 2 ** 63 else None for v in exact], pa.int64())
    off = n * rows.astype(np.int64) - sums
    return pa.array((off * off).sum(1))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings`` on the first 8 whitened components of all of them.  Entries of 2^30 or more
    count as non-finite (their grid numbers would leave the range of exact sums); a deviation beyond a long is null."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = rows.where(~F.exists("embedding", lambda x: F.abs(x) >= float(1 << 30)))
    rows = usable(rows, "embedding")
    model = fit(rows, "embedding", grid)
    if model is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(rows, "embedding", model, COMPONENTS, grid)
    n, sums = model.n, model.sums
    model.mean = sums / n

    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = grid(matrix(batch.column(1)))
            y = project(x, model, COMPONENTS)
            k = y.shape[1]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(m, n)), _deviations(x, n, sums).take(each), pa.array(y.ravel()),
                 pa.array(np.tile(model.explained()[:k], len(x))), pa.array(np.full(m, error))],
                names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(scan, OUT)
