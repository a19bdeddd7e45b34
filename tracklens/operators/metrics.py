"""Errors, summaries, failure taxonomies and feature statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .quantiles import with_quantiles

#: Substrings of a status and their family, in order of precedence.
FAMILIES = (("LOWFIT", "LOWFIT"), ("LOWCAND", "LOWCAND"), ("DISP", "DISP"), ("PHASEEARLY", "PHASEEARLY"), ("PHASEGROWTH", "PHASEGROWTH"), ("PHASESTABLE", "PHASESTABLE"), ("PHASELATE", "PHASELATE"), ("CURGUARD", "CURGUARD"), ("HISTGUARD", "HISTGUARD"))
HIGH_ERROR, SEVERE_ERROR = 50.0, 100.0


def error_pct(pred: Column, truth: Column) -> Column:
    return F.when(truth > 0, F.abs(pred - truth) / truth * 100)


def status_family(status: Column, truth: Column) -> Column:
    out = F.when(truth.isNull(), "GT_INVALID").when(~status.startswith("OK"), "NO_PRED")
    for part, name in FAMILIES:
        out = out.when(status.contains(part), name)
    return out.when(status == "OK_BBOX_MULTI_Q25", "HIGH_CONF_Q25").otherwise("OK_OTHER")


def truth_bucket(truth: Column) -> Column:
    return F.when(truth.isNull(), "GT_INVALID").when(truth <= 1, "<=1").when(truth <= 2, "1-2").when(truth <= 3.5, "2-3.5").when(truth <= 6, "3.5-6").otherwise(">6")


def failure_type(pred: Column, truth: Column, status: Column) -> Column:
    """Primary failure type: no truth, no estimate, over or under by a high or severe error, or low error."""
    error = error_pct(pred, truth)
    side = F.when(pred / truth >= 1, "OVER").otherwise("UNDER")
    return (
        F.when(truth.isNull(), "GT_INVALID").when(pred.isNull(), "NO_PREDICTION").when(error >= SEVERE_ERROR, F.concat(F.lit("SEVERE_"), side)).when(error >= HIGH_ERROR, F.concat(F.lit("HIGH_"), side))
        .when(status.contains("GUARD"), "LOW_ERROR_GUARDED").otherwise("LOW_ERROR")
    )


#: Parts of a status and the class of a high error, in order of precedence; an area ratio below which a box has collapsed.
CLASSES = (
    ("LOWFIT", "LOWFIT"), ("LOWCAND", "LOWCAND"), ("DISP", "HIGH_DISPERSION"), ("PHASEEARLY", "PHASEEARLY_RESIDUAL"), ("PHASEGROWTH", "PHASEGROWTH_RESIDUAL"), ("PHASESTABLE", "PHASESTABLE_RESIDUAL"),
    ("PHASELATE", "PHASELATE_RESIDUAL"), ("CURGUARD", "CURRENT_BBOX_GUARD_RESIDUAL"), ("HISTGUARD", "HISTORY_BBOX_GUARD_RESIDUAL"),
)
COLLAPSED_AREA = 0.20


def failure_class(status: Column, truth: Column, error: Column, over: Column, collapses: Column, area: Column, high: float = HIGH_ERROR) -> Column:
    """What made an error: its class by the status' first part of CLASSES, else by unguarded collapses, else by family, with
    the side on which it lies (``over``: estimate over truth, unknown being under); errors up to ``high`` by whether a guard repaired them."""
    low = F.when(status.contains("CURGUARD") | status.contains("HISTGUARD"), "REPAIRED_LOW_ERROR_GUARD_SAMPLE").otherwise("LOW_ERROR_ACCEPTED")
    kind = F
    for part, name in CLASSES:
        kind = kind.when(status.contains(part), name)
    family = status_family(status, truth)
    kind = kind.when(area < COLLAPSED_AREA, "UNGUARDED_CURRENT_BBOX_COLLAPSE").when(collapses > 0, "UNGUARDED_HISTORY_BBOX_COLLAPSE").when(family == "HIGH_CONF_Q25", "APPARENT_HIGH_CONF_GEOMETRY").otherwise(F.concat(F.lit("OTHER_"), family))
    side = F.when(over >= 1, "OVER").otherwise("UNDER")
    return F.when(error.isNull(), "NO_VALID_PREDICTION").when(error <= high, low).otherwise(F.concat_ws("_", kind, side))


def failure_flags(over: Column, collapses: Column, area: Column) -> Column:
    """The signs that hold, joined by |."""
    return F.concat_ws("|", F.when(area < COLLAPSED_AREA, "current_bbox_collapse_signal"), F.when(collapses > 0, "history_bbox_collapse_signal"), F.when(over >= 1, "overestimate").when(over.isNotNull(), "underestimate"))


def run_summary(metrics: DataFrame) -> DataFrame:
    """Per sequence and, in the row of null seq, over all: one pass by rollup."""
    ok = F.col("status").startswith("OK") & F.col("pred").isNotNull()
    both = ok & F.col("truth").isNotNull()
    error = F.when(both, F.abs(F.col("pred") - F.col("truth")))
    return metrics.rollup("seq").agg(
        F.count("truth").alias("gt_valid"), F.count_if(both).alias("est_valid"), F.count_if(~F.col("status").startswith("OK")).alias("failures"),
        F.round(F.avg(error), 5).alias("mae"), F.round(F.avg(F.when(both, error_pct(F.col("pred"), F.col("truth")))), 4).alias("e_ttc"),
    )


def diagnostic_group(failure: Column, error: Column) -> Column:
    """The side of a high or severe failure by how its type begins; other high errors; the rest."""
    side = lambda name: failure.startswith(f"SEVERE_{name}") | failure.startswith(f"HIGH_{name}")
    return F.when(side("OVER"), "HIGH_OVER").when(side("UNDER"), "HIGH_UNDER").when(error >= HIGH_ERROR, "OTHER_HIGH_ERROR").otherwise("LOW_ERROR_OR_MODERATE")


def method_summary(rows: DataFrame, by: str) -> DataFrame:
    """Per method: rows with truth, with an estimate besides, failures, mean absolute and relative error."""
    both = F.col("pred").isNotNull() & F.col("truth").isNotNull()
    return rows.groupBy(by).agg(
        F.count("truth").alias("gt_valid"), F.count_if(both).alias("est_valid"), F.count_if(~F.col("status").startswith("OK")).alias("failures"),
        F.round(F.avg(F.when(both, F.abs(F.col("pred") - F.col("truth")))), 5).alias("mae"), F.round(F.avg("error"), 4).alias("e_ttc"),
    )


def error_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, median, 90th percentile and shares over 50 and 100 of ``error``."""
    rows = written(rows.where(F.col("error").isNotNull()).select(*by, "error"), "errors")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("error"), 4).alias("mean"), F.count_if(F.col("error") > 50).alias("over50"), F.count_if(F.col("error") > 100).alias("over100"))
    return _with_middle(out, rows, by)


def _with_middle(out: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """A summary (of groups without bound in size) plus median and p90 of error, before over50."""
    out = with_quantiles(out, rows, by, {"median": ("error", 0.5), "p90": ("error", 0.9)})
    first = [c for c in out.columns if c not in ("median", "p90", "over50", "over100")]
    return out.select(*first, F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "over50", "over100")


def worst_examples(rows: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Per group the ids of its k greatest errors, joined by ';'."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("error"), "seq", "start"))
    top = rows.where(F.col("error").isNotNull()).withColumn("place", place).where(F.col("place") <= k)
    named = F.concat_ws(":", "seq", "start")
    return top.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", named.alias("id")))), lambda x: x["id"]), ";").alias("examples"))


def zscores(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is below floor); nulls stay."""
    df = written(df, "zscores")
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    scale = lambda c: 1.0 if stats[c]["s"] is None or stats[c]["s"] < floor else stats[c]["s"]
    return df.withColumns({c: (F.col(c) - F.lit(stats[c]["m"])) / F.lit(scale(c)) for c in columns})


def metric_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count of all rows, and mean, median, 90th percentile and counts over 50 and 100 of the errors there are."""
    rows = written(rows.select(*by, "pred", "truth", "error"), "errors")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("truth"))), 5).alias("mae"), F.round(F.avg("error"), 4).alias("mean"),
        F.count_if(F.col("error") > 50).alias("over50"), F.count_if(F.col("error") > 100).alias("over100"),
    )
    return _with_middle(out, rows, by)


def seeded_split(rows: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """rows plus held: in each group of two or more, the first share by a seeded hash of group and key, at least one, never all."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), group, key)), key)
    n = F.count("*").over(Window.partitionBy(group))
    wanted = F.least(n - 1, F.greatest(F.lit(1), F.rint(n * F.lit(share)).cast("bigint"))) if share > 0 else F.lit(0)
    return rows.withColumn("held", (n >= 2) & (F.row_number().over(order) <= wanted))
