"""Queries that join estimates with event features, compare them with probes, and diagnose sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fn
from ..operators import learning, metrics, surface
from ..sources.shared import written
from .evaluation import _FAILURE, _M, _sql, evaluated, evaluated_each
from .events import _ROI, _regions, _surface
from .features import _RATED, _SIGNS, rated, signs
from .registry import ORACLES, query
from .summaries import expansion_candidates

_PLACED = f"{_ROI}, e AS (SELECT r.seq, r.idx, coalesce(sum(n), 0)::BIGINT AS events, count(s.n) / max((r.rx1 - r.rx0) * (r.ry1 - r.ry0))::DOUBLE AS occupancy, coalesce(avg(surface), 0) AS freshness FROM regions r LEFT JOIN surf s ON s.seq = r.seq AND s.idx = r.idx GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY seq ORDER BY idx) - 1 AS start FROM e"


def with_event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated estimates that have an interval (its sequence's start-th), with its events, occupancy and mean surface."""
    stats = surface.region_stats(_surface(spark, sf_dir), _regions(spark, sf_dir)).select("seq", "idx", F.col("n").alias("events"), "occupancy", F.col("mean").alias("freshness"))
    place = (F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1).cast("bigint")
    return rated(spark, sf_dir).join(stats.withColumn("start", place), ["seq", "start"])


@query("event_feature_join", f"WITH f AS ({_RATED} SELECT * FROM rated), p AS ({_PLACED}) SELECT f.seq, f.start, idx, round(pred, 5) AS pred, events, round(occupancy, 9) AS occupancy, round(freshness, 8) AS freshness FROM f JOIN p ON p.seq = f.seq AND p.start = f.start")
def event_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_features(spark, sf_dir).select("seq", "start", "idx", F.round("pred", 5).alias("pred"), "events", F.round("occupancy", 9).alias("occupancy"), F.round("freshness", 8).alias("freshness"))


@query("event_ridge")
def event_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln truth from the estimate and event features, nulls at training medians, each sequence held out; tests compare with numpy."""
    features = ["base", "events", "occupancy", "freshness"]
    rows = with_event_features(spark, sf_dir).where("pred > 0 AND truth > 0").withColumns({"base": F.log("pred"), "freshness": F.when(F.col("events") > 0, F.col("freshness")), "y": F.log(F.greatest(F.lit(fn.LOW_TTC), F.least(F.lit(fn.HIGH_TTC), F.col("truth"))))})
    rows = written(rows.select("seq", "start", "fold", "truth", "y", *features), "event-ridge")
    out = learning.predicted(rows, learning.ridge_loso(rows, features, "y", 10.0, median=True), features)
    guess = fn.clipped_exp(F.col("fitted"))
    return out.select("seq", "start", F.round(guess, 4).alias("guess"), F.round(metrics.error_pct(guess, F.col("truth")), 3).alias("error"))


#: The interval whose estimate a probe is compared with.
COMPARED = 40

_SHOWN = "coalesce(printf('%.3f', {0}), '')"


@query(
    "probe_compare",
    f"""WITH c AS ({ORACLES["expansion_candidates"]}), p AS (SELECT seq, count(*) AS n, min(ttc) AS low, quantile_cont(ttc, 0.5) AS ttc, max(ttc) AS high FROM c GROUP BY 1), o AS ({_sql(13)} SELECT seq, pred, error, status FROM m WHERE start = {COMPARED})
    SELECT p.seq, n, round(low, 6) AS low, round(ttc, 6) AS ttc, round(high, 6) AS high, {_SHOWN.format("pred")} AS compared, {_SHOWN.format("error")} AS compared_error, coalesce(status, '') AS compared_status FROM p LEFT JOIN o ON o.seq = p.seq""",
)
def probe_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates' median of each probed sequence beside its estimate; blanks where there is none."""
    probes = expansion_candidates(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("n"), F.min("ttc").alias("low"), F.percentile("ttc", F.lit(0.5)).alias("ttc"), F.max("ttc").alias("high"))
    other = evaluated(spark, sf_dir, 13).where(F.col("start") == COMPARED).select("seq", fn.format_number(F.col("pred"), 3).alias("compared"), fn.format_number(F.col("error"), 3).alias("compared_error"), F.col("status").alias("compared_status"))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("compared", "compared_error", "compared_status")]
    return probes.join(other, "seq", "left").select("seq", "n", *[F.round(c, 6).alias(c) for c in ("low", "ttc", "high")], *blank)


@query("interval_diagnostics", f"{_RATED} SELECT seq, start, status, family, {_FAILURE} AS failure, coalesce(error >= 50, false) AS high, n AS candidates, max_fit, round(iqr, 5) AS iqr, collapses, round(ratio, 5) AS ratio, round(pred / truth, 5) AS over FROM (SELECT *, {_SIGNS} FROM rated)")
def interval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an estimate was made from, beside how it failed."""
    failure = metrics.failure_type(F.col("pred"), F.col("truth"), F.col("status"))
    rows = signs(spark, sf_dir)
    return rows.select("seq", "start", "status", "family", failure.alias("failure"), F.coalesce(F.col("error") >= metrics.HIGH_ERROR, F.lit(False)).alias("high"), F.col("n").alias("candidates"), "max_fit", F.round("iqr", 5).alias("iqr"), "collapses", F.round("ratio", 5).alias("ratio"), F.round(F.col("pred") / F.col("truth"), 5).alias("over"))


@query(
    "sequence_diagnostics",
    f"""WITH a AS ({_sql(13)} SELECT seq, count(*) AS intervals FROM m GROUP BY 1), r AS ({_RATED} SELECT *, {_SIGNS} FROM rated WHERE error IS NOT NULL)
    SELECT a.seq, any_value(intervals) AS intervals, count(error) AS valid, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.9), 4) AS p90, count(*) FILTER (error > 50) AS over50,
      round(avg(n), 4) AS candidates, round(avg(max_fit), 4) AS fit_points, round(avg(iqr), 5) AS iqr FROM a LEFT JOIN r ON r.seq = a.seq GROUP BY a.seq""",
)
def sequence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sequence its intervals, errors, and means of what its estimates were made from."""
    every = evaluated(spark, sf_dir, 13).groupBy("seq").agg(F.count("*").alias("intervals"))
    q = lambda p: F.round(F.percentile("error", F.lit(p)), 4)
    told = signs(spark, sf_dir).where("error IS NOT NULL").groupBy("seq").agg(
        F.count("error").alias("valid"), F.round(F.avg("error"), 4).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), F.count_if(F.col("error") > 50).alias("over50"),
        F.round(F.avg("n"), 4).alias("candidates"), F.round(F.avg("max_fit"), 4).alias("fit_points"), F.round(F.avg("iqr"), 5).alias("iqr"),
    )
    return every.join(told, "seq", "left").fillna(0, ["valid", "over50"])


_GROUP = "CASE WHEN starts_with(failure, 'SEVERE_OVER') OR starts_with(failure, 'HIGH_OVER') THEN 'HIGH_OVER' WHEN starts_with(failure, 'SEVERE_UNDER') OR starts_with(failure, 'HIGH_UNDER') THEN 'HIGH_UNDER' WHEN error >= 50 THEN 'OTHER_HIGH_ERROR' ELSE 'LOW_ERROR_OR_MODERATE' END"


@query("diagnostic_groups", f"{_M}, t AS (SELECT *, {_FAILURE} AS failure FROM m) SELECT {_GROUP} AS part, count(*) AS n, count(DISTINCT seq) AS sequences, round(avg(error), 4) AS mean FROM t GROUP BY 1")
def diagnostic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by the beginning of their failure type."""
    failure = metrics.failure_type(F.col("pred"), F.col("truth"), F.col("status"))
    rows = evaluated(spark, sf_dir).withColumn("part", metrics.diagnostic_group(failure, F.col("error")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("sequences"), F.round(F.avg("error"), 4).alias("mean"))


_EACH = " UNION ALL ".join(f"SELECT 'v{n}' AS method, * FROM ({_sql(n)} SELECT seq, status, pred, truth, error FROM m)" for n in (4, 6, 13))


@query("method_summaries", f"WITH a AS ({_EACH}) SELECT method, count(truth) AS gt_valid, count(*) FILTER (pred IS NOT NULL AND truth IS NOT NULL) AS est_valid, count(*) FILTER (NOT starts_with(status, 'OK')) AS failures, round(avg(CASE WHEN truth IS NOT NULL THEN abs(pred - truth) END), 5) AS mae, round(avg(error), 4) AS e_ttc FROM a GROUP BY 1")
def method_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of several methods summed up side by side, in one pass over all."""
    rows = evaluated_each(spark, sf_dir, (4, 6, 13))
    each = rows.select("truth", F.inline(F.array(*[F.struct(F.lit(f"v{n}").alias("method"), f"v{n}.*") for n in (4, 6, 13)])))
    return metrics.method_summary(each, "method")
