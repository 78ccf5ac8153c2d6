"""Whitening of embeddings along the leading principal components.

Method: entries become integers, and each distinct vector counts once (the fit list). Two passes
over the fit list give the exact sums and the covariance of the centred vectors. Its eigenvectors
come from spectral divide and conquer: the QDWH iteration (QR-based, dynamically weighted) gives
the polar factor U of the shifted covariance V - s I, (U + I) / 2 projects on the eigenvectors
above s, and orthonormal bases of that projector and of its complement split V into two smaller
blocks, until every block is one component. Means, components and scales are then shipped to
all tasks, which whiten every row in one pass. A third pass over the fit list measures how far
the covariance of the whitened vectors is from the identity.

Tasks send home one covariance row for each dimension; a matrix is assembled from these sums in
one task for each vector length, so what meets there is bounded by the length, not by the rows.
What is shipped is six numbers for each entry of each length.

Defined results
- Vectors null, empty or holding null or non-finite entries give no rows.
- Entries beyond the range of a long after scaling are held at its ends.
- Vectors of different lengths are fitted apart, each length as a table of its own.
- Components without spread (eigenvalue 0 up to rounding) cannot be whitened and are left out;
  if all vectors are equal, no rows. Components of equal eigenvalue are any orthonormal pair.
- Repeated rows and rows sharing a vec_id each keep their rows; null vec_id is kept.
- ``deviation`` is exact; null where it exceeds a long (beyond some 10**7 distinct vectors).
- An empty table gives no rows. Further columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.session import Workspace

EPS = float(np.finfo(np.float64).eps)
CHUNK = 1 << 12
LONG = 2**63
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double,"
    " identity_error double"
)


# --- spectral divide and conquer ------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH iterations."""
    size = len(a)
    bound = min(np.linalg.norm(a), np.sqrt(np.linalg.norm(a, 1) * np.linalg.norm(a, np.inf)))
    x = a / bound
    # A lower bound of the smallest singular value; one too low only costs an iteration.
    low = np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / np.sqrt(size)
    low = min(max(low, EPS / 4), 1.0)
    identity = np.eye(size)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        weight_a = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0))
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(weight_c) * x, identity]))
        step = (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * (q[:size] @ q[size:].T)
        new = weight_b / weight_c * x + step
        new = (new + new.T) / 2
        low = min(low * (weight_a + weight_b * square) / (1 + weight_c * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) and abs(low - 1) <= 10 * EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal basis of the range of a projector."""
    q = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))[0]
    for _ in range(2):
        q = np.linalg.qr(projector @ q)[0]
    return q


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to cut the spectrum at: the middle first, then around the mean."""
    diagonal = np.sort(np.diag(a))
    yield float(np.median(diagonal))
    mean, spread = float(diagonal.mean()), float(np.linalg.norm(a - diagonal.mean() * np.eye(len(a))))
    # The mean lies between the least and the greatest eigenvalue, unless all are equal.
    for part in (0, 1, -1, 2, -2, 3, -3, 5, -5):
        yield mean + part * spread / (7 * len(a))
    yield from (diagonal[1:] + diagonal[:-1]) / 2


def eigenvectors(a: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors of a symmetric matrix, as columns in no given order."""
    rng = np.random.default_rng(11)
    scale = max(float(np.linalg.norm(a)), np.finfo(np.float64).tiny)

    def split(block: np.ndarray) -> np.ndarray:
        size = len(block)
        middle = np.trace(block) / size * np.eye(size)
        if size == 1 or np.linalg.norm(block - middle) <= 4 * EPS * scale:
            return np.eye(size)
        best = None
        for shift in _shifts(block):
            shifted = block - shift * np.eye(size)
            if not shifted.any():
                continue
            projector = (polar_factor(shifted) + np.eye(size)) / 2
            rank = int(round(float(np.trace(projector))))
            if not 0 < rank < size:
                continue
            upper = _basis(projector, rank, rng)
            rest = np.eye(size) - projector
            rest -= upper @ (upper.T @ rest)
            lower = _basis(rest, size - rank, rng)
            error = float(np.linalg.norm(lower.T @ block @ upper))
            if best is None or error < best[0]:
                best = (error, upper, lower)
            if error <= 8 * size * EPS * np.linalg.norm(block):
                break
        if best is None:
            raise ArithmeticError("no shift splits the spectrum")
        _, upper, lower = best
        parts = []
        for basis in (upper, lower):
            inner = basis.T @ block @ basis
            parts.append(basis @ split((inner + inner.T) / 2))
        return np.concatenate(parts, axis=1)

    return split(a)


def leading(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues with spread, falling, and their eigenvectors as columns."""
    covariance = (covariance + covariance.T) / 2
    vectors = eigenvectors(covariance)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    some = values > 16 * len(values) * EPS * max(values[0], 0)
    values, vectors = values[some][:most], vectors[:, some][:, :most]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * sign


# --- passes over the vectors ----------------------------------------------------------


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, x: vectors with usable entries, as floor(scale * entry)."""
    bad = "exists(embedding, c -> c IS NULL OR isnan(c) OR abs(CAST(c AS DOUBLE)) = double('Infinity'))"
    return rows.where(f"size(embedding) > 0 AND NOT {bad}").select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"),
    )


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of longs) of a list column, some rows of one length at a time."""
    sizes = np.asarray(column.value_lengths())
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.asarray(column.flatten(), np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for low in range(0, len(rows), CHUNK):
            part = rows[low : low + CHUNK]
            yield part, flat[starts[part][:, None] + np.arange(size)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for rows, x in _by_length(batch.column("x")):
            total = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            total[0] += len(rows)
            # Halves of 32 bits, so that no partial sum leaves a long.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total[1] += high.astype(object) * 2**32 + low.astype(object)
    if found:
        yield pa.RecordBatch.from_pydict(
            {
                "dims": pa.array(list(found), pa.int32()),
                "n": pa.array([n for n, _ in found.values()], pa.int64()),
                "sums": pa.array([[str(s) for s in total] for _, total in found.values()], pa.list_(pa.string())),
            }
        )


def length_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, exact sums)} of the fit list."""
    parts = fit.select("x").mapInArrow(_sums, "dims int, n long, sums array<string>")
    entries = parts.select("dims", "n", F.posexplode("sums"))
    rows = (
        entries.groupBy("dims", "pos")
        .agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        .groupBy("dims")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("sums"))
        .collect()
    )
    return {r["dims"]: (r["n"], [int(s["total"]) for s in r["sums"]]) for r in rows}


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    # The whole part of the mean leaves in integers, so large offsets cost no digits.
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x.astype(np.float64) - whole) - rest if np.abs(x).max() > 2**52 else (x - whole) - rest


def _scatter(moments: dict[int, tuple[int, list[int]]]):
    """Rows of the sum of outer products of centred vectors, one set for each task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                y = _centred(x, *moments[x.shape[1]])
                found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        for size, total in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size, size, np.int32)),
                    pa.array(np.arange(size, dtype=np.int32)),
                    pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), size).cast(pa.list_(pa.float64())),
                ],
                names=["dims", "i", "row"],
            )

    return run


def _add_rows(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(rows["row"].to_list()), axis=0)
    return pd.DataFrame({"dims": rows["dims"].iloc[:1], "i": rows["i"].iloc[:1], "row": [total]})


def _fit(most: int, counts: dict[int, int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["dims"].iloc[0])
        covariance = np.stack(rows.sort_values("i")["row"].to_list()) / counts[size]
        values, vectors = leading(covariance, most)
        return pd.DataFrame(
            {
                "dims": np.full(len(values), size, np.int32),
                "component": np.arange(1, len(values) + 1, dtype=np.int32),
                "value": values,
                "explained": values / np.trace(covariance),
                "axis": pd.Series(list(vectors.T), dtype=object),
            }
        )

    return run


class Model:
    """Mean, leading components and scales of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], components: list):
        self.n, self.sums = n, sums
        size = len(sums)
        self.axes = np.array([c["axis"] for c in components], np.float64).reshape(-1, size).T
        self.scale = np.sqrt(np.array([c["value"] for c in components]))
        self.explained = np.array([c["explained"] for c in components])
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums) @ self.axes / self.scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 of each row."""
        most = max(int(x.max()), -int(x.min())) * self.n + max(map(abs, self.sums))
        kind = np.int64 if most * most * x.shape[1] < LONG else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        found = (y * y).sum(axis=1)
        return [int(v) if v < LONG else None for v in found.tolist()]


def _whitened_moments(models: dict[int, Model]):
    """Count, mean and centred scatter of the whitened vectors of each task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for _, x in _by_length(batch.column("x")):
                w = models[x.shape[1]].whiten(x)
                mean = w.mean(axis=0)
                new = (len(w), mean, (w - mean).T @ (w - mean))
                found[x.shape[1]] = _merge(found[x.shape[1]], new) if x.shape[1] in found else new
        for size, (n, mean, scatter) in found.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "dims": pa.array([size], pa.int32()),
                    "n": pa.array([n], pa.int64()),
                    "mean": pa.array([mean.tolist()], pa.list_(pa.float64())),
                    "scatter": pa.array([scatter.ravel().tolist()], pa.list_(pa.float64())),
                }
            )

    return run


def _merge(a: tuple, b: tuple) -> tuple:
    """Moments of two sets of rows from theirs, without leaving the centred form."""
    n, away = a[0] + b[0], b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


def _identity_error(rows: pd.DataFrame) -> pd.DataFrame:
    size = len(rows["mean"].iloc[0])
    total = None
    for n, mean, scatter in zip(rows["n"], rows["mean"], rows["scatter"]):
        part = (int(n), np.asarray(mean), np.asarray(scatter).reshape(size, size))
        total = _merge(total, part) if total else part
    error = np.abs(total[2] / total[0] - np.eye(size)).max() if size else 0.0
    return pd.DataFrame({"dims": rows["dims"].iloc[:1], "error": [float(error)]})


def fit_models(fit: DataFrame, work: Workspace, most: int) -> dict[int, Model]:
    """{length: model} of the fit list (settled, column x)."""
    moments = length_sums(fit)
    if not moments:
        return {}
    fit = fit.select("x")
    rows = fit.mapInArrow(_scatter(moments), "dims int, i int, row array<double>")
    rows = rows.groupBy("dims", "i").applyInPandas(_add_rows, "dims int, i int, row array<double>")
    schema = "dims int, component int, value double, explained double, axis array<double>"
    counts = {size: n for size, (n, _) in moments.items()}
    # Settled: a task that runs again must not return other signs or sums.
    found = work.settle(rows.groupBy("dims").applyInPandas(_fit(most, counts), schema), "components")
    axes: dict[int, list] = {size: [] for size in moments}
    for row in found.orderBy("dims", "component").collect():
        axes[row["dims"]].append(row)
    models = {size: Model(*moments[size], axes[size]) for size in moments}
    errors = (
        fit.mapInArrow(
            _whitened_moments(models), "dims int, n long, mean array<double>, scatter array<double>"
        )
        .groupBy("dims")
        .applyInPandas(_identity_error, "dims int, error double")
    )
    for row in errors.collect():
        models[row["dims"]].identity_error = row["error"]
    return models


def _apply(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_length(batch.column("x")):
                model = models[x.shape[1]]
                each = len(model.scale)
                if not each:
                    continue
                deviation = pa.array(model.deviation(x), pa.int64())
                own = np.repeat(np.arange(len(rows)), each)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows[own])),
                        pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(own), model.n, np.int64)),
                        deviation.take(pa.array(own)),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(model.explained, len(rows))),
                        pa.array(np.full(len(own), model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    work = Workspace(rows.sparkSession, "whitening")
    vectors = integer_vectors(rows, scale)
    fit = work.settle(vectors.select("x").distinct(), "fit")
    models = fit_models(fit, work, most)
    work.close()
    return vectors.mapInArrow(_apply(models), OUT)
