"""Whitening of embeddings: projections on the principal components, scaled to unit variance.

Two passes make the covariance. The first sums whole numbers, so that the mean is exact: x = floor(1024 c) + SHIFT. The
second centres each vector before it multiplies, ``(n x - S) / n`` with a whole numerator, and sums outer products as one
matrix product for each batch. Each task gives one matrix, which ``treeAggregate`` merges; width squared doubles reach the
driver, however many vectors there are. LAPACK's symmetric solver takes the components, numbered by falling eigenvalue, the
greatest entry of each positive. A third pass measures how far the whitened vectors' covariance is from the identity, with
means and centred products of batches merged pairwise; the last projects, the components being part of the task.

Null, non-finite and unequal vectors: see ``embeddings``. Components whose eigenvalue is nothing beside the greatest (or if
there is one vector only) have a null ``whitened`` and don't count in ``identity_error``, which is null if none is left.
``deviation`` is null where it doesn't fit a long. Repeated rows and ids are vectors of their own; an empty table has no
rows. Other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget, stored
from .embeddings import integers, kept, packed, unpacked, width_of

SHIFT, COMPONENTS = 100_000, 8
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _merged(rows: DataFrame, of_task: Callable[[Iterator[np.ndarray]], tuple | None], add: Callable[[tuple, tuple], tuple]) -> tuple | None:
    """What ``of_task`` makes of each task's vectors (x binary), added up over a tree of tasks; None of none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = of_task(unpacked(b["x"], np.int64).reshape(b.num_rows, -1) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    either = lambda a, b: b if a is None else a if b is None else add(a, b)
    return rows.select("x").mapInArrow(each, "made binary").rdd.map(lambda r: pickle.loads(r["made"])).treeAggregate(None, either, either)


def _sums(blocks: Iterator[np.ndarray]) -> tuple | None:
    n, s = 0, None
    for x in blocks:
        n, s = n + len(x), x.sum(0).astype(object) if s is None else s + x.sum(0)
    return (n, s) if n else None


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n, by a whole numerator."""
    return (n * x - s) / n


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    d = n * x - s
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(1).tolist()
    return [v if v < 2**63 else None for v in ((d.astype(object)) ** 2).sum(1).tolist()]


def _moments(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = y.mean(0)
    return len(y), mean, (y - mean).T @ (y - mean)


def _joined(a: tuple, b: tuple) -> tuple:
    """Moments (n, mean, centred products) of two sets together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector of (vec_id, embedding) and
    each of the first ``components``."""
    vectors = kept(rows)
    spark, width = rows.sparkSession, width_of(vectors)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["vec_id"], packed(integers(b["vector"], width) + SHIFT)], ["vec_id", "x"])

    table, path = stored(vectors.mapInArrow(whole, "vec_id long, x binary"), "integers")
    sums = _merged(table, _sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    if sums is None:
        forget(spark, path)
        return spark.createDataFrame([], OUT)
    n, s = sums[0], sums[1].astype(np.int64)

    def products(blocks: Iterator[np.ndarray]) -> tuple | None:
        total = None
        for x in blocks:
            y = centred(x, n, s)
            total = y.T @ y if total is None else total + y.T @ y
        return None if total is None else (total,)

    covariance = _merged(table, products, lambda a, b: (a[0] + b[0],))[0] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    e, axes, trace = values[order], axes[:, order], float(np.trace(covariance))
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(e))] < 0, -1, 1)
    sure = e > max(values.max(), 0) * width * np.finfo(float).eps
    scaled = axes[:, sure] / np.sqrt(e[sure])

    def spread(blocks: Iterator[np.ndarray]) -> tuple | None:
        found = None
        for x in blocks:
            m = _moments(centred(x, n, s) @ scaled)
            found = m if found is None else _joined(found, m)
        return found

    error = float(np.abs(_merged(table, spread, _joined)[2] / n - np.eye(sure.sum())).max()) if sure.any() else None
    explained = [max(float(v), 0.0) / trace if trace > 0 else 0.0 for v in e]
    k = len(e)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b["x"], np.int64, width)
            y = np.full((len(x), k), np.nan)
            y[:, sure] = centred(x, n, s) @ scaled
            each = lambda values: np.repeat(values, k)
            ids, far = b["vec_id"].take(pa.array(each(np.arange(len(x))))), pa.array([d for d in deviations(x, n, s) for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(each([n] * len(x)), pa.int64()), far, pa.array(y.ravel(), pa.float64(), from_pandas=True), pa.array(np.tile(explained, len(x)), pa.float64()), pa.array([error] * len(x) * k, pa.float64())], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.mapInArrow(project, OUT)
