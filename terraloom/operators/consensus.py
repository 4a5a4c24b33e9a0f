"""Models by random sample consensus: hypotheses drawn by hash, all scored in one pass, the best refitted on its inliers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.reports import plane

#: Rows from which hypotheses are drawn: those of the smallest hash.
POOL_ROWS = 4_096
#: Errors that a task holds at a time: rows x hypotheses.
HELD_ERRORS = 1 << 21


class Plane:
    """normal . p = offset in x, y, z; the error is the distance. Parameters: the unit normal (upward) and the offset."""

    columns, size = ("x", "y", "z"), 3

    @staticmethod
    def through(samples: np.ndarray) -> np.ndarray:
        normal = np.cross(samples[:, 1] - samples[:, 0], samples[:, 2] - samples[:, 0])
        length = np.linalg.norm(normal, axis=1)
        fine = length > 1e-9 * np.abs(samples).max(axis=(1, 2), initial=1.0)  # three points on a line give none
        normal = normal[fine] / length[fine, None]
        normal *= np.where(normal[:, 2] < 0, -1.0, 1.0)[:, None]
        return np.concatenate([normal, np.einsum("ij,ij->i", normal, samples[fine, 0])[:, None]], axis=1)

    @staticmethod
    def errors(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.abs(rows @ models[:, :3].T - models[:, 3])

    @staticmethod
    def error(model: np.ndarray) -> Column:
        return F.abs(sum((F.col(c) * float(v) for c, v in zip("xyz", model[:3], strict=True)), F.lit(-float(model[3]))))

    @staticmethod
    def fit(rows: DataFrame) -> np.ndarray:
        normal, offset = plane(rows)
        return np.array([*normal, offset])


class Affine:
    """u = a x + b y + c, v = d x + e y + f; the error is the distance in the plane of u and v. Parameters: a to f."""

    columns, size = ("x", "y", "u", "v"), 3

    @staticmethod
    def through(samples: np.ndarray) -> np.ndarray:
        left = np.concatenate([samples[:, :, :2], np.ones((*samples.shape[:2], 1))], axis=2)
        fine = np.abs(np.linalg.det(left)) > 1e-9 * np.abs(left).max(axis=(1, 2)) ** 2
        solved = np.linalg.solve(left[fine], samples[fine, :, 2:])
        return solved.transpose(0, 2, 1).reshape(-1, 6)

    @staticmethod
    def errors(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        at = np.concatenate([rows[:, :2], np.ones((len(rows), 1))], axis=1)
        return np.hypot(at @ models[:, :3].T - rows[:, 2:3], at @ models[:, 3:].T - rows[:, 3:4])

    @staticmethod
    def error(model: np.ndarray) -> Column:
        m = [float(v) for v in model]
        off = [F.col("x") * m[i] + F.col("y") * m[i + 1] + m[i + 2] - F.col(c) for i, c in ((0, "u"), (3, "v"))]
        return F.sqrt(off[0] * off[0] + off[1] * off[1])

    @staticmethod
    def fit(rows: DataFrame) -> np.ndarray:
        """From one row of sums around the means."""
        sums = [F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")]
        r = rows.agg(*sums, *(F.avg(c).alias(c) for c in "xyuv")).first()
        ab = np.linalg.solve(np.array([[r["xx"], r["xy"]], [r["xy"], r["yy"]]]), np.array([[r["xu"], r["xv"]], [r["yu"], r["yv"]]])).T
        c = np.array([r["u"], r["v"]]) - ab @ np.array([r["x"], r["y"]])
        return np.concatenate([ab, c[:, None]], axis=1).ravel()


def draw(rows: DataFrame, model, key: str, hypotheses: int, seed: int) -> np.ndarray:
    """Models through random samples of the POOL_ROWS rows of the smallest hash of their key: the same in every run and partitioning."""
    pool = rows.orderBy(F.xxhash64(F.lit(seed), key), *model.columns).limit(POOL_ROWS).select(*model.columns).collect()
    if len(pool) < model.size:
        raise ValueError(f"a {model.__name__.lower()} needs {model.size} rows")
    pool = np.array([tuple(r) for r in pool], float)
    rng = np.random.default_rng(seed)
    chosen = np.stack([rng.choice(len(pool), model.size, replace=False) for _ in range(hypotheses)])
    return model.through(pool[chosen])


def score(rows: DataFrame, model, models: np.ndarray, threshold: float) -> np.ndarray:
    """How many rows each model explains, counted in one pass over the rows; one row a model comes back from each task."""
    step, n = max(1, HELD_ERRORS // max(1, len(models))), len(models)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inliers = np.zeros(n, np.int64)
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for at in range(0, len(table), step):
                inliers += (model.errors(models, table[at : at + step]) <= threshold).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(inliers)], names=["model", "n"])

    out = np.zeros(n, np.int64)
    for r in rows.select(*model.columns).mapInArrow(count, "model long, n long").groupBy("model").agg(F.sum("n").alias("n")).collect():
        out[r["model"]] = r["n"]
    return out


def consensus(rows: DataFrame, model, key: str, threshold: float, hypotheses: int = 500, seed: int = 7, refits: int = 10) -> tuple[np.ndarray, int]:
    """(parameters, inliers) of the model (Plane or Affine) that explains most rows within the threshold.

    The best hypothesis (ties: the first drawn) is fitted by least squares to its inliers again and again while their number
    grows. Rows with nulls take no part. Raises where there are too few rows or all samples are degenerate. Inliers are
    rows.filter(model.error(parameters) <= threshold).
    """
    rows = rows.select(key, *(F.col(c).cast("double").alias(c) for c in model.columns)).dropna(subset=list(model.columns))
    models = draw(rows, model, key, hypotheses, seed)
    if not len(models):
        raise ValueError("all samples are degenerate")
    counts = score(rows, model, models, threshold)
    best, found = models[counts.argmax()], int(counts.max())
    for _ in range(refits):
        fitted = model.fit(rows.filter(model.error(best) <= threshold))
        n = rows.filter(model.error(fitted) <= threshold).count()
        if n < found:
            break
        grown, best, found = n > found, fitted, n
        if not grown:
            break
    return best, found
