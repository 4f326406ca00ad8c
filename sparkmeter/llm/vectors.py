"""Which vectors take part in a search or a comparison, and their classes of exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(rows: DataFrame) -> DataFrame:
    """(vec_id, v, ok) of each row; v in doubles; ok if there is an id and the vector is not null, not zero and finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & finite & some, F.lit(False))
    return rows.select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), ok.alias("ok"))
