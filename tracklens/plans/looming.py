"""Queries on the looming estimator and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import looming as ops
from ..operators.joins import band_join
from ..sources.driver import TRACKS_SQL, tracks
from . import looming_sql as sql
from .registry import ORACLES, QUERIES, query


def _variant(number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.estimate(tracks(spark, sf_dir), number).withColumn("ttc", F.round("ttc", 5))

    return run


for _n, _v in ops.VARIANTS.items():
    QUERIES[f"looming_v{_n}"] = _variant(_n)
    ORACLES[f"looming_v{_n}"] = sql.estimate(_v)


@query("tracks", f"WITH {TRACKS_SQL} SELECT seq, label_id, round(ts, 6) AS ts, round(w, 6) AS w, round(h, 6) AS h, round(area, 5) AS area FROM tracks")
def tracks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("seq", "label_id", *[F.round(c, 6).alias(c) for c in ("ts", "w", "h")], F.round("area", 5).alias("area"))


@query(
    "band_join_history",
    f"WITH {TRACKS_SQL} SELECT s.seq, s.label_id AS start, count(*) AS n, min(t.label_id) AS low, round(sum(t.w), 6) AS sum_w FROM tracks s JOIN tracks t ON t.seq = s.seq AND t.label_id BETWEEN s.label_id - 12 AND s.label_id GROUP BY 1, 2",
)
def band_join_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    rows = band_join(t.select("seq", F.col("label_id").alias("start")), t.select("seq", "label_id", "w"), 12)
    return rows.groupBy("seq", "start").agg(F.count("*").alias("n"), F.min("label_id").alias("low"), F.round(F.sum("w"), 6).alias("sum_w"))


_V4 = ops.VARIANTS[4]
_CANDIDATES = f"WITH {sql.histories(12, False)}, {sql.candidates(_V4, (0,))}"


@query("multiwindow_candidates", f"{_CANDIDATES} SELECT seq, start, back, ord AS cue, fit_points, round(slope, 7) AS slope, round(ttc, 5) AS ttc FROM cands")
def multiwindow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.candidates(ops.histories(tracks(spark, sf_dir), _V4), _V4)
    return found.select("seq", "start", F.col("back").cast("bigint").alias("back"), F.col("ord").alias("cue"), "fit_points", F.round("slope", 7).alias("slope"), F.round("ttc", 5).alias("ttc"))


@query("candidate_quantiles", f"{_CANDIDATES}, {sql.STATS} SELECT seq, start, n, max_fit, round(low, 5) AS low, round(q10, 5) AS q10, round(q25, 5) AS q25, round(q50, 5) AS q50, round(q75, 5) AS q75, round(q90, 5) AS q90, round(iqr, 5) AS iqr FROM stats")
def candidate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ops.with_stats(ops.with_candidates(ops.histories(tracks(spark, sf_dir), _V4), _V4)).where("n IS NOT NULL")
    return stats.select("seq", "start", "n", "max_fit", *[F.round(c, 5).alias(c) for c in ("low", "q10", "q25", "q50", "q75", "q90", "iqr")])


@query("collapse_guard_current", f"WITH {TRACKS_SQL}, {sql.COLLAPSED} SELECT seq, start, cur FROM collapsed")
def collapse_guard_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.current_collapse(tracks(spark, sf_dir)).withColumnRenamed("collapsed", "cur")


@query(
    "collapse_guard_history",
    f"WITH {sql.histories(12, True)} SELECT seq, start, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(CASE WHEN dropped THEN label_id::VARCHAR END, ';' ORDER BY label_id), '') AS labels FROM hist GROUP BY 1, 2",
)
def collapse_guard_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.histories(tracks(spark, sf_dir), ops.VARIANTS[8]).where("size(hist) > 0")
    gone = F.filter("hist", lambda b: b["dropped"])
    return rows.select("seq", "start", F.size(gone).cast("bigint").alias("n_dropped"), F.array_join(F.transform(gone, lambda b: b["label_id"].cast("string")), ";").alias("labels"))


@query(
    "area_ratios",
    f"""WITH {TRACKS_SQL} SELECT seq, label_id, round(area / quantile_cont(area, 0.5) OVER (PARTITION BY seq ORDER BY label_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS ratio_med5,
    round(area / lag(area) OVER (PARTITION BY seq ORDER BY label_id), 6) AS ratio_prev, CASE WHEN lead(label_id) OVER (PARTITION BY seq ORDER BY label_id) = label_id + 1 THEN round(lead(area) OVER (PARTITION BY seq ORDER BY label_id) / area, 6) END AS ratio_next FROM tracks""",
)
def area_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("label_id")
    following = F.when(F.lead("label_id").over(w) == F.col("label_id") + 1, F.round(F.lead("area").over(w) / F.col("area"), 6))
    median = F.percentile("area", F.lit(0.5)).over(w.rowsBetween(-5, -1))
    return tracks(spark, sf_dir).select("seq", "label_id", F.round(F.col("area") / median, 6).alias("ratio_med5"), F.round(F.col("area") / F.lag("area").over(w), 6).alias("ratio_prev"), following.alias("ratio_next"))


@query("phase_fraction", f"WITH {TRACKS_SQL}, {sql.SAMPLES} SELECT seq, start, round(frac, 9) AS frac FROM samples")
def phase_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sample_frame(tracks(spark, sf_dir)).select("seq", "start", F.round("frac", 9).alias("frac"))
