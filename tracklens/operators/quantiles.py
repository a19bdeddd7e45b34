"""Exact quantiles of few groups with many rows, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: How far from a wanted share the values are taken that are gathered for it.
NEAR = 0.001


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", small: bool = True) -> DataFrame:
    """left joined with right on by, where nulls are equal; right's columns of these names go."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in by})
    met = F.lit(True)
    for c in by:
        met = met & left[c].eqNullSafe(named[f"__{c}"])
    return left.join(F.broadcast(named) if small else named, met, how).drop(*[f"__{c}" for c in by])


def exact_quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name, the interpolated quantile (column, share) of a group's values; null where there are none.

    Two approximate quantiles split a group's values in three; counts tell in which part the wanted ranks lie,
    and only this part is put in order.  Approximations that miss make it larger, never wrong.
    """
    rows = written(rows.select(*by, *[F.col(c).cast("double").alias(n) for n, (c, _) in wanted.items()]), "quantiles")
    cuts = rows.groupBy(*by).agg(*[F.percentile_approx(n, [max(s - NEAR, 0.0), min(s + NEAR, 1.0)], 10_000).alias(f"__cut_{n}") for n, (_, s) in wanted.items()])
    cuts = written(cuts, "quantile-cuts")

    def side(n: str) -> Column:
        return F.when(F.col(n) < F.col(f"__cut_{n}")[0], 0).when(F.col(n) <= F.col(f"__cut_{n}")[1], 1).otherwise(2)

    each = F.array(*[F.struct(F.lit(n).alias("__name"), F.lit(s).alias("__share"), F.col(n).alias("__x"), side(n).alias("__side")) for n, (_, s) in wanted.items()])
    long = _same(rows, cuts, by).select(*by, F.inline(each)).where("__x IS NOT NULL")
    whole = Window.partitionBy(*by, "__name")
    counts = long.groupBy(*by, "__name", "__share", "__side").agg(F.count("*").alias("__n"))  # three rows a group and name
    upto = F.sum("__n").over(whole.orderBy("__side"))
    counts = counts.withColumns({"__upto": upto, "__at": (F.sum("__n").over(whole) - 1) * F.col("__share")}).withColumn("__before", F.col("__upto") - F.col("__n"))
    holds = lambda k, first, after: (k >= first) & (k < after)
    low, high = F.floor("__at"), F.ceil("__at")
    asked = counts.where(holds(low, F.col("__before"), F.col("__upto")) | holds(high, F.col("__before"), F.col("__upto")))
    asked = written(asked.select(*by, "__name", "__side", "__before", "__at"), "quantile-parts")
    cells = _same(long, asked, [*by, "__name", "__side"]).groupBy(*by, "__name", "__side", "__before", "__at", "__x").agg(F.count("*").alias("__c"))
    cells = cells.withColumn("__last", F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__name", "__side").orderBy("__x")))
    value = lambda k: F.max(F.when(holds(k, F.col("__last") - F.col("__c"), F.col("__last")), F.col("__x")))
    told = cells.groupBy(*by, "__name").agg(value(low).alias("__low"), value(high).alias("__high"), F.first("__at").alias("__at"))
    told = told.withColumn("__q", F.col("__low") + (F.col("__at") - F.floor("__at")) * (F.col("__high") - F.col("__low")))
    found = told.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in wanted])
    return _same(cuts.select(*by), found, by, "left") if by else found


def with_quantiles(summary: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A summary with one row a group plus its quantiles."""
    return _same(summary, exact_quantiles(rows, by, wanted), by, "left")
