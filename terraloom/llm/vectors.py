"""What both vector searches share: which rows take part, and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and embedding of the rows whose vectors are neither null nor hold null, NaN or infinite components.

    With nonzero, all-zero vectors go too. Rows that repeat both columns count once; other columns are left out.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    if nonzero:
        rows = rows.filter(F.exists("embedding", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "embedding"])
