"""Joins on ranges and times, as equi-joins that Spark can partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(samples: DataFrame, rows: DataFrame, back: int, on: str = "seq", label: str = "label_id") -> DataFrame:
    """Each sample (on, start) with the rows whose label lies in [start - back, start].

    Both sides are dealt by (on, label block), a sample to the one or two blocks
    that its band meets, so that one long sequence spreads over many tasks.
    """
    width = back + 1
    low = F.floor((F.col("start") - back) / width)
    left = samples.withColumn("__block", F.explode(F.sequence(low, F.floor(F.col("start") / width))))
    right = rows.withColumn("__block", F.floor(F.col(label) / width))
    return left.join(right, [on, "__block"]).where(F.col(label).between(F.col("start") - back, F.col("start"))).drop("__block")


def interval_join(points: DataFrame, spans: DataFrame, width: int, on: str = "seq", time: str = "t_us") -> DataFrame:
    """points inside spans [lo, hi): an equi-join on (on, time slot of ``width``)."""
    left = points.withColumn("__slot", F.floor(F.col(time) / width))
    right = spans.withColumn("__slot", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    return left.join(right, [on, "__slot"]).where((F.col(time) >= F.col("lo")) & (F.col(time) < F.col("hi"))).drop("__slot")


def asof_interpolate(queries: DataFrame, series: DataFrame, at: str, slot: float, on: str = "seq") -> DataFrame:
    """queries plus ``v`` and ``v_status``: their series (on, t, v) interpolated at ``at``.

    Outside a series' range, or without one, v is null and the status OUT_OF_RANGE.  A query on
    the first point takes its value, as do queries between equal times.  Segments
    of the series are joined by time slots of width ``slot``; points are put in
    order per series and group of slots, each group with the last point before it,
    so that one long series spreads over many tasks.
    """
    group = F.floor(F.col("t") / (1024 * slot))
    points = series.select(on, "t", "v", group.alias("__group"))
    ends = points.groupBy(on, "__group").agg(F.max_by(F.struct("t", "v"), "t").alias("last"))
    of_series = Window.partitionBy(on).orderBy("__group")  # one row a group of 1024 slots
    ends = ends.select(on, "__group", F.lag("last").over(of_series).alias("before"))
    order = Window.partitionBy(on, "__group").orderBy("t")
    segments = points.withColumns({"t0": F.lag("t").over(order), "v0": F.lag("v").over(order)}).join(ends, [on, "__group"])
    segments = segments.withColumns({"t0": F.coalesce("t0", "before.t"), "v0": F.coalesce("v0", "before.v")})
    segments = segments.select(F.col(on).alias("__on"), "t", "v", F.coalesce("t0", "t").alias("t0"), F.coalesce("v0", "v").alias("v0"), F.col("t0").isNull().alias("first"))
    segments = segments.withColumn("__slot", F.explode(F.sequence(F.floor(F.col("t0") / slot), F.floor(F.col("t") / slot))))
    left = queries.withColumn("__slot", F.floor(F.col(at) / slot)).withColumnRenamed(at, "__at")
    inside = (left[on] == segments["__on"]) & (left["__slot"] == segments["__slot"]) & (F.col("__at") <= F.col("t")) & ((F.col("__at") > F.col("t0")) | (F.col("first") & (F.col("__at") == F.col("t"))))
    share = (F.col("__at") - F.col("t0")) / F.nullif(F.col("t") - F.col("t0"), F.lit(0.0))
    value = F.when(F.abs(F.col("t") - F.col("t0")) < 1e-12, F.col("v0")).otherwise(F.col("v0") + share * (F.col("v") - F.col("v0")))
    joined = left.join(segments, inside, "left")
    keep = [F.col("__at").alias(at) if c == at else left[c] for c in queries.columns]
    return joined.select(*keep, value.alias("v"), F.when(F.col("t").isNull(), "OUT_OF_RANGE").otherwise("OK").alias("v_status"))


def unfinished(work: DataFrame, done: DataFrame, on: str | list[str]) -> DataFrame:
    """The work that has no result yet."""
    return work.join(done, on, "left_anti")


def loso_totals(rows: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """For each group, sums over all other groups: totals less its own, no fold join."""
    own = rows.groupBy(group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return less_own(own, list(sums))


def less_own(own: DataFrame, sums: list[str]) -> DataFrame:
    """own with each of the sums replaced by the total over all rows less the row's own;
    the totals are one row, joined with all."""
    whole = own.agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    columns = [c for c in own.columns if c not in sums]
    joined = own.withColumn("__one", F.lit(1)).join(F.broadcast(whole.withColumn("__one", F.lit(1))), "__one")
    return joined.select(*columns, *[(F.col(f"__{c}") - F.col(c)).alias(c) for c in sums])
