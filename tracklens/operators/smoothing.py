"""Smoothing of estimates along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW, HIGH = 0.05, 25.0


def clipped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), value)))


def rolling_median(df: DataFrame, width: int, causal: bool, value: str = "ttc") -> DataFrame:
    """Median of the non-null values of ``width`` rows, centred or up to the row itself, clipped."""
    frame = (-(width - 1), 0) if causal else (-(width // 2), width // 2)
    w = Window.partitionBy("seq").orderBy("start").rowsBetween(*frame)
    return df.withColumn("smooth", clipped(F.percentile(value, F.lit(0.5)).over(w)))
