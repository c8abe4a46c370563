"""Ranks over a whole table without sorting it in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_percent_rank(rows: DataFrame, key: str, columns: list[str], suffix: str = "_rank") -> DataFrame:
    """key and the percent rank of each integer column: rows below / (rows - 1), 0 for one row.

    key must be unique and without nulls; a null value ranks below all others. The columns are turned into
    (metric, value) rows and counted by value; a running sum over the distinct values of a metric says how many
    rows lie below. So one task holds the distinct values of a metric, never its rows, and `rows` is planned
    twice, however many columns there are. Where many rows share a value, AQE splits the join.
    """
    long = rows.select(key, F.posexplode(F.array(*[F.col(c).cast("long") for c in columns])).alias("_metric", "_value"))
    long = long.withColumn("_value", F.coalesce("_value", F.lit(-(1 << 63))))
    ordered = Window.partitionBy("_metric").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = long.groupBy("_metric", "_value").agg(F.count("*").alias("_n")).select(
        "_metric", "_value", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_below"), F.sum("_n").over(Window.partitionBy("_metric")).alias("_rows")
    )
    share = F.coalesce(F.try_divide("_below", F.col("_rows") - 1), F.lit(0.0))
    each = long.join(ranked, ["_metric", "_value"]).select(key, "_metric", share.alias("_share"))
    return each.groupBy(key).agg(*[F.max(F.when(F.col("_metric") == k, F.col("_share"))).alias(c + suffix) for k, c in enumerate(columns)])
