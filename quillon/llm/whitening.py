"""Embedding whitening: streaming co-moments, merged over partitions, and a symmetric QR eigen-solve.

Each task updates a mean and a matrix of co-moments row by row (Welford); the
states meet in a tree of pairwise merges by the parallel update formula. The
matrix is reduced to a tridiagonal one by reflections and diagonalised by
shifted QR steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .vectors import by_size, finite, matrix, packed

#: States that one task merges.
FAN_IN = 16
_FAR = 1 << 62
_STATE = "part int, size int, n long, mean binary, moments binary"


class Moments:
    """Mean and co-moments of the rows so far."""

    def __init__(self, n: int, mean: np.ndarray, moments: np.ndarray) -> None:
        self.n, self.mean, self.moments = n, mean, moments

    @classmethod
    def of(cls, size: int) -> Moments:
        return cls(0, np.zeros(size), np.zeros((size, size)))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, row after row: the k-th row adds (k-1)/k of the square of its distance from the mean before it."""
        k = self.n + np.arange(1, len(rows) + 1)
        after = self.mean + np.cumsum(rows - self.mean, axis=0) / k[:, None]
        before = np.vstack([self.mean[None, :], after[:-1]])
        away = rows - before
        self.moments += (away * ((k - 1) / k)[:, None]).T @ away  # the sum of these rank-one updates
        self.n, self.mean = int(k[-1]), after[-1]

    def merge(self, other: Moments) -> None:
        if other.n:
            n, away = self.n + other.n, other.mean - self.mean
            self.moments += other.moments + np.outer(away, away) * (self.n * (other.n / n))
            self.mean, self.n = self.mean + away * (other.n / n), n

    def covariance(self) -> np.ndarray:
        return (self.moments + self.moments.T) / (2 * self.n)


def symmetric_qr(matrix_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; an eigenvector's largest entry is positive."""
    a, n = np.array(matrix_, float), len(matrix_)
    q = np.eye(n)  # rows become the eigenvectors
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not (length := math.copysign(float(np.linalg.norm(v)), v[0])):
            continue
        v[0] += length
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    hi, eps = n - 1, float(np.finfo(float).eps)
    while hi > 0:
        lo = hi
        while lo > 0 and abs(e[lo - 1]) > eps * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        if lo == hi:
            hi -= 1
            continue
        # a shift near the eigenvalue that the last two rows approach
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, w, u = d[k], e[k], d[k + 1]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * w + s * s * u, s * s * p - 2 * c * s * w + c * c * u, c * s * (u - p) + (c * c - s * s) * w
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    values = np.array(d)
    order = np.argsort(-values, kind="stable")
    vectors = q[order]
    vectors *= np.sign(vectors[np.arange(n), np.abs(vectors).argmax(axis=1)])[:, None] if n else 1
    return values[order], vectors


def _whole(scale: float, shift: int):
    """Finite vectors as whole numbers, held within 2^62 of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, flat = finite(batch.column("v"))
            with np.errstate(invalid="ignore", over="ignore"):
                floor = np.floor(scale * np.nan_to_num(flat))
            far = np.clip(floor, -float(_FAR), float(_FAR)).astype(np.int64)
            x = np.clip(far, -_FAR - min(shift, 0), _FAR - max(shift, 0)) + np.int64(shift)
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), packed(x, sizes)], names=["id", "size", "x"])
            yield out.filter(pa.array(keep))

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task's rows."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, part in by_size(batch):
            x = matrix(part.column("x"), size, np.int64)
            small = not x.size or int(np.abs(x).max()) * len(x) < _FAR
            sums = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
            n, before = found.get(size, (0, 0))
            found[size] = (n + len(x), before + sums)
    sums = [[Decimal(int(s)) for s in x] for _, x in found.values()]
    columns = [pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array(sums, pa.list_(pa.decimal128(38, 0)))]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "size", "n", "sums"])


def _states(rows_of: Callable[[int, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for size, part in by_size(batch):
                rows = rows_of(size, matrix(part.column("x"), size, np.int64))
                if len(rows):
                    found.setdefault(size, Moments.of(rows.shape[1])).add(rows)
        yield _told(TaskContext.get().partitionId(), found)

    return run


def _told(part: int, found: dict[int, Moments]) -> pa.RecordBatch:
    columns = [pa.array([part] * len(found), pa.int32()), pa.array(list(found), pa.int32()), pa.array([m.n for m in found.values()], pa.int64()), *[pa.array([getattr(m, name).tobytes() for m in found.values()], pa.binary()) for name in ("mean", "moments")]]
    return pa.RecordBatch.from_arrays(columns, names=["part", "size", "n", "mean", "moments"])


def _state(row) -> Moments:
    mean = np.frombuffer(bytes(row["mean"]))
    return Moments(row["n"], mean, np.frombuffer(bytes(row["moments"])).reshape(len(mean), len(mean)).copy())


def _merged(table: pa.Table) -> pa.Table:
    rows = table.sort_by("part").to_pylist()  # at most FAN_IN states
    first = _state(rows[0])
    for row in rows[1:]:
        first.merge(_state(row))
    return pa.Table.from_batches([_told(rows[0]["part"] // FAN_IN, {rows[0]["size"]: first})])


def _gathered(states: DataFrame, parts: int) -> dict[int, Moments]:
    """The state of each vector length, merged in a tree: what one task holds depends on the length alone."""
    while parts > 1:
        states = states.groupBy("size", (F.col("part") / FAN_IN).cast("int").alias("_group")).applyInArrow(_merged, _STATE)
        parts = -(-parts // FAN_IN)
    return {r["size"]: _state(r) for r in states.collect()}


def _exact_away(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where they hold it, whole numbers of any size elsewhere."""
    reach = n * max(int(np.abs(x).max()), 1) if x.size else 1
    if reach + max(map(abs, sums), default=0) < _FAR:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _deviation(away: np.ndarray) -> list[int | None]:
    if away.dtype != object and (not away.size or int(np.abs(away).max()) ** 2 * away.shape[1] < 1 << 63):
        return (away * away).sum(axis=1).tolist()
    whole = [sum(int(v) ** 2 for v in row) for row in away]
    return [v if v < 1 << 63 else None for v in whole]


_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(fit: dict[int, dict]):
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in by_size(batch):
                if not size:
                    continue
                f = fit[size]
                away = _exact_away(matrix(part.column("x"), size, np.int64), f["n"], f["sums"])
                white = _whitened(away, f)
                rows, m = white.shape
                per_row = lambda v, kind: pa.array(v, kind).take(pa.array(np.repeat(np.arange(rows), m)))
                every = lambda v: pa.array(np.full(rows * m, v, float), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [per_row(part.column("id"), pa.int64()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, f["n"])), per_row(_deviation(away), pa.int64()), pa.array(white.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(f["explained"], rows), pa.float64(), from_pandas=True), every(f["error"])],
                    names=names,
                )

    return run


def _whitened(away: np.ndarray, f: dict) -> np.ndarray:
    """Projections over the deviations; NaN for a component without spread."""
    centred = (away / f["n"]).astype(float)
    return np.where(f["flat"], np.nan, centred @ f["vectors"].T / np.where(f["flat"], 1.0, np.sqrt(np.abs(f["values"]))))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Whitened rows: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A component c counts as the long floor(``scale`` * c) + ``shift``, held
    within 2^62 of zero. The fit list has each distinct vector once; a row is
    projected on the eigenvectors of its covariance, by falling eigenvalue, up
    to ``components`` or the vector's length. Rows with a null vector or a null
    or non-finite component take no part; a null id or a repeated row is a row
    like any other. Vectors of each length are a space of their own, with a fit
    of their own; empty vectors have no component and so no row. A component
    without spread (all components, if n is 1) has a null ``whitened`` and
    counts not in ``identity_error``, which is null if no component has
    spread, as ``explained`` is if the trace is 0. A ``deviation`` beyond a long
    is null. An empty table gives an empty result; other columns are ignored.

    What is gathered: sums and a matrix of co-moments for each vector length.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(raw.mapInArrow(_whole(scale, shift), "id long, size int, x binary"), "whole")
    distinct = materialize(rows.select("size", "x").distinct(), "fit")
    totals = distinct.mapInArrow(_totals, "part int, size int, n long, sums array<decimal(38,0)>")
    sums = totals.select("part", "size", "n", F.posexplode("sums").alias("at", "s")).groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("part").alias("part")).collect()  # a row per dimension
    fit: dict[int, dict] = {}
    for r in sorted(sums, key=lambda r: (r["size"], r["at"])):
        f = fit.setdefault(r["size"], {"n": r["n"], "sums": []})
        f["sums"].append(int(r["s"]))
    if not fit:
        return spark.createDataFrame([], _ROW)
    parts = 1 + max(r["part"] for r in sums)
    # centred before multiplying: by the whole number nearest to the mean, which loses nothing
    centres = {size: [(2 * s + f["n"]) // (2 * f["n"]) for s in f["sums"]] for size, f in fit.items()}

    def near(size: int, x: np.ndarray) -> np.ndarray:
        return _exact_away(x, 1, centres[size]).astype(float) if size else x[:0].astype(float)

    found = _gathered(distinct.mapInArrow(_states(near), _STATE), parts)
    for size, f in fit.items():
        covariance = found[size].covariance()
        values, axes = symmetric_qr(covariance)
        trace, top = float(np.trace(covariance)), min(components, size)
        f |= {"values": values[:top], "vectors": axes[:top], "flat": values[:top] <= size * np.finfo(float).eps * trace}
        f["explained"] = np.maximum(values[:top], 0) / trace if trace > 0 else np.full(top, np.nan)
    open_ = {size: f for size, f in fit.items() if not f["flat"].all()}

    def white(size: int, x: np.ndarray) -> np.ndarray:
        f = open_.get(size)
        return _whitened(_exact_away(x, f["n"], f["sums"]), f)[:, ~f["flat"]] if f else np.zeros((0, 0))

    again = _gathered(distinct.mapInArrow(_states(white), _STATE), parts)
    for size, f in fit.items():
        f["error"] = float(np.abs(again[size].covariance() - np.eye(again[size].mean.size)).max()) if size in again else math.nan
    return rows.mapInArrow(_projected(fit), _ROW)
