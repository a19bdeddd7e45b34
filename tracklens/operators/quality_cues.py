"""Expansion cues with a quality score, and the selector between cues and fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .surface import _cell


@dataclass(frozen=True)
class CueLimits:
    """What a cell's cue must meet, and the targets at which a score is full. Times are in the caller's unit."""

    pixels: int = 8
    surface: float = 0.15
    radius: float = 2.0
    radius_span: float = 3.0
    time_span: float = 0.001
    slope: float = 1.0
    low_ttc: float = 0.05
    high_ttc: float = 20.0
    full_radius_span: float = 10.0
    full_time_span: float = 0.02
    full_residual: float = 2.5
    centre_from: float = 0.10
    centre_full: float = 0.35


@dataclass(frozen=True)
class SelectorLimits:
    """When cues stand alone, when the fallback does, and its share in between."""

    least_cues: int = 1
    quality: float = 0.90
    dispersion: float = 0.40
    score: float = 0.78
    alone_cues: int = 3
    alone_ratio: float = 0.60
    low_ratio: float = 0.55
    low_quality: float = 0.80
    low_score: float = 0.60
    high_dispersion: float = 0.75
    few_cues: int = 1
    least_share: float = 0.30
    most_share: float = 0.60


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def weighted_mean(value: str, weight: str, over) -> Column:
    return F.sum(F.col(value) * F.col(weight)).over(over) / F.sum(weight).over(over)


def quality_cues(surface: DataFrame, cells: DataFrame, unit_us: float, limits: CueLimits = CueLimits(), k: int = 3) -> DataFrame:
    """Per selected cell: a weighted fit of the pixels' distance from their own
    weighted centroid on their age, its residual, spans, quality, status and ttc.

    Pixels below ``limits.surface`` are left out.  Centroid, means, fit and sums are
    windows and one aggregate over the cell, so pixels are shuffled once by cell;
    a cell holds at most its area in pixels.
    """
    size = {"row": _cell(F.col("y") - F.col("ry0"), F.col("ry1") - F.col("ry0"), k), "col": _cell(F.col("x") - F.col("rx0"), F.col("rx1") - F.col("rx0"), k)}
    keys = ["seq", "idx", "row", "col"]
    rows = surface.withColumns(size).join(cells.select(*keys, "conf"), keys)
    w, cell = F.when(F.col("surface") >= limits.surface, F.col("surface")), Window.partitionBy(*keys)
    rows = rows.withColumns({"w": w, "age": F.when(w.isNotNull(), (F.col("last_us") - F.col("hi")) / F.lit(unit_us))})
    rows = rows.withColumns({"cx": weighted_mean("x", "w", cell), "cy": weighted_mean("y", "w", cell)})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = rows.withColumn("r", F.when(F.col("w").isNotNull(), F.sqrt(dx * dx + dy * dy)))
    rows = rows.withColumns({"mean_age": weighted_mean("age", "w", cell), "mean_r": weighted_mean("r", "w", cell)})
    da, dr = F.col("age") - F.col("mean_age"), F.col("r") - F.col("mean_r")
    box = ["x1", "y1", "x2", "y2"]
    sums = rows.groupBy(*keys, "conf", *box).agg(
        F.count("w").alias("points"), *[F.first(c, ignorenulls=True).alias(c) for c in ("cx", "cy", "mean_age", "mean_r")], (F.max("r") - F.min("r")).alias("radius_span"), (F.max("age") - F.min("age")).alias("time_span"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * da * da).alias("saa"), F.sum(F.col("w") * da * dr).alias("sar"), F.sum(F.col("w") * dr * dr).alias("srr"),
    )
    slope = F.when(F.abs("saa") >= 1e-12, F.col("sar") / F.col("saa"))
    fits = sums.withColumn("slope", slope).withColumn("radius", F.col("mean_r") - F.col("slope") * F.col("mean_age"))
    ttc = F.col("radius") / F.col("slope")
    status = (
        F.when(F.col("points") < limits.pixels, "TOO_FEW_ACTIVE_PIXELS").when((F.col("mean_r") <= limits.radius) | (F.col("radius_span") < limits.radius_span), "RADIUS_SUPPORT_TOO_SMALL")
        .when(F.col("time_span") < limits.time_span, "TIME_SUPPORT_TOO_SMALL").when(F.col("slope").isNull(), "FIT_FAIL").when(F.col("radius") <= limits.radius, "RADIUS_TOO_SMALL")
        .when(F.col("slope") <= limits.slope, "NON_POSITIVE_EXPANSION").when(~ttc.between(limits.low_ttc, limits.high_ttc), "TTC_OUT_OF_RANGE").otherwise("OK")
    )
    # Sum of squared residuals of a fit through the means; it cannot be below zero.
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("srr") - F.col("slope") * F.col("sar")) / F.col("sw"))
    width, height = F.greatest(F.lit(1e-6), F.col("x2") - F.col("x1")), F.greatest(F.lit(1e-6), F.col("y2") - F.col("y1"))
    diagonal = F.sqrt(width * width + height * height)
    ox, oy = F.col("cx") - (F.col("x1") + F.col("x2")) / 2, F.col("cy") - (F.col("y1") + F.col("y2")) / 2
    off = (F.sqrt(ox * ox + oy * oy) - limits.centre_from * diagonal) / F.greatest(F.lit(1e-6), (limits.centre_full - limits.centre_from) * diagonal)
    parts = [F.col("conf"), unit(1 - F.col("residual") / limits.full_residual), unit(F.col("radius_span") / limits.full_radius_span), unit(F.col("time_span") / limits.full_time_span), unit(off)]
    scored = F.col("status").isin("OK", "TTC_OUT_OF_RANGE")
    out = fits.withColumns({"status": status, "residual": residual}).withColumns({"quality": F.when(scored, sum(parts[1:], parts[0]) / 5), "ttc": F.when(F.col("status") == "OK", ttc)})
    return out.select(*keys, "conf", "points", "cx", "cy", "radius", "slope", "residual", "time_span", "radius_span", "quality", "status", "ttc")


def cue_statistics(cues: DataFrame) -> DataFrame:
    """Per interval with a good cue: their number, weighted median (``pick``), median, quartile range, range
    and quality.  Windows and aggregate share one shuffle; a grid's cells bound a group."""
    inside = Window.partitionBy("seq", "idx")
    weight = F.greatest(F.lit(1.0), F.col("points")) * F.greatest(F.lit(1e-6), F.col("conf")) * F.greatest(F.lit(1e-6), F.col("quality"))
    good = cues.where("status = 'OK'").withColumn("weight", weight)
    good = good.withColumns({"upto": F.sum("weight").over(inside.orderBy("ttc").rangeBetween(Window.unboundedPreceding, 0)), "total": F.sum("weight").over(inside)})
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = good.groupBy("seq", "idx").agg(
        F.count("*").alias("cues"), F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("ttc"))).alias("pick"), q("ttc", 0.5).alias("median"), (q("ttc", 0.75) - q("ttc", 0.25)).alias("iqr"), F.min("ttc").alias("low"), F.max("ttc").alias("high"),
        (F.sum(F.col("quality") * F.col("weight")) / F.sum("weight")).alias("weighted_quality"), F.avg("quality").alias("quality"), (q("quality", 0.75) - q("quality", 0.25)).alias("quality_iqr"), F.min("quality").alias("quality_low"), F.max("quality").alias("quality_high"),
    )
    return out.withColumn("dispersion", F.col("iqr") / F.greatest(F.abs("median"), F.lit(1e-6)))


def select_by_quality(stats: DataFrame, fallback: DataFrame, limits: SelectorLimits = SelectorLimits()) -> DataFrame:
    """seq, idx, ttc, status, cues and fallback of every interval: its cues alone where they are many,
    good and agree; the fallback alone where they are poor and far below it; else a blend by their score."""
    df = fallback.join(stats, ["seq", "idx"], "left").withColumn("cues", F.coalesce("cues", F.lit(0)))
    have, base = F.col("cues") >= limits.least_cues, F.col("fallback")
    quality, dispersion, cues = F.col("weighted_quality"), F.col("dispersion"), F.col("cues")
    support = unit((cues - limits.few_cues) / max(1, limits.alone_cues - limits.few_cues))
    score = (quality + unit(1 - dispersion / limits.dispersion) + support) / 3
    ratio = F.col("pick") / F.greatest(base, F.lit(1e-6))
    alone = (cues >= limits.alone_cues) & (quality >= limits.quality) & (score >= limits.score) & (dispersion <= limits.dispersion) & (ratio >= limits.alone_ratio)
    poor = (ratio < limits.low_ratio) & ((quality < limits.low_quality) | (score < limits.low_score) | (dispersion > limits.high_dispersion) | (cues <= limits.few_cues))
    share = F.greatest(F.lit(limits.least_share), F.least(F.lit(limits.most_share), limits.most_share - (limits.most_share - limits.least_share) * unit(score)))
    status = F.when(have & base.isNull() | have & alone, "OK_CUE_ONLY").when(have & ~poor, "OK_BLEND").when(base.isNotNull(), "OK_FALLBACK").otherwise("NO_VALID_FEATURE")
    ttc = F.when(F.col("status") == "OK_CUE_ONLY", F.col("pick")).when(F.col("status") == "OK_BLEND", (1 - share) * F.col("pick") + share * base).otherwise(base)
    return df.withColumn("status", status).withColumn("ttc", ttc).select("seq", "idx", "ttc", "status", "cues", "fallback")
