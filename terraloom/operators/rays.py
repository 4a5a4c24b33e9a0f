"""Points from any number of rays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rays whose normal equations have a determinant below this, relative to the number of rays cubed, count as parallel.
LEAST_DETERMINANT = 1e-12


def _determinant(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def triangulate(rays: DataFrame, key: str) -> DataFrame:
    """rays(key, cx, cy, cz, dx, dy, dz) -> key, x, y, z, error, n: the point of least squared distance to all rays of a key, and the mean distance.

    Each ray adds a 3 x 3 matrix and a vector; keys are reduced to these sums, around their first centre so that large
    coordinates keep their digits, and solved in columns. Keys of a single ray or of parallel ones have nulls; rays with nulls
    or without a direction take no part.
    """
    axes = "xyz"
    length = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in axes), F.lit(0.0)))
    rays = rays.select(key, *(F.col(f"c{c}").cast("double").alias(f"c{c}") for c in axes), *(F.try_divide(F.col(f"d{c}"), length).alias(f"d{c}") for c in axes)).dropna()
    origin = rays.groupBy(key).agg(F.min(F.struct(*(F.col(f"c{c}") for c in axes))).alias("o"))
    near = rays.join(origin, key)
    near = near.withColumns({f"r{c}": F.col(f"c{c}") - F.col(f"o.c{c}") for c in axes})
    part = lambda a, b: (F.lit(1.0) if a == b else F.lit(0.0)) - F.col(f"d{a}") * F.col(f"d{b}")
    sums = [F.sum(part(a, b)).alias(f"m{a}{b}") for a in axes for b in axes if a <= b]
    sums += [F.sum(sum((part(a, b) * F.col(f"r{b}") for b in axes), F.lit(0.0))).alias(f"v{a}") for a in axes]
    solved = near.groupBy(key).agg(F.count("*").alias("n"), F.first("o").alias("o"), *sums)
    m = [[F.col(f"m{min(a, b)}{max(a, b)}") for b in axes] for a in axes]
    whole = _determinant(m)
    known = (F.col("n") > 1) & (whole > LEAST_DETERMINANT * F.col("n") * F.col("n") * F.col("n"))
    at = {}
    for i, a in enumerate(axes):
        swapped = [[F.col(f"v{axes[r]}") if c == i else m[r][c] for c in range(3)] for r in range(3)]
        at[a] = F.when(known, F.try_divide(_determinant(swapped), whole))
    solved = solved.select(key, "n", "o", *(v.alias(f"p{a}") for a, v in at.items()))
    off = [F.col(f"p{a}") - F.col(f"r{a}") for a in axes]
    along = sum((o * F.col(f"d{a}") for o, a in zip(off, axes, strict=True)), F.lit(0.0))
    across = F.sqrt(sum(((o - along * F.col(f"d{a}")) * (o - along * F.col(f"d{a}")) for o, a in zip(off, axes, strict=True)), F.lit(0.0)))
    error = near.join(solved.drop("n", "o"), key).groupBy(key).agg(F.avg(across).alias("error"))
    return solved.join(error, key).select(key, *((F.col(f"p{a}") + F.col(f"o.c{a}")).alias(a) for a in axes), "error", "n")
