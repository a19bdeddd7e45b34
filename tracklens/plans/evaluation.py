"""Queries on estimates against ground truth: metrics, taxonomies, smoothing, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clips, gates, looming, metrics, smoothing
from ..operators.joins import asof_interpolate, unfinished
from ..sources.driver import GROUND_TRUTH_SQL, observed, tracks
from ..sources.shared import written
from . import looming_sql
from .registry import ORACLES, query

NUMBER = 7


def evaluated(spark: SparkSession, sf_dir: str, number: int = NUMBER) -> DataFrame:
    """seq, start, status, pred, truth, error and fold (each sequence is one)."""
    boxes, series = observed(spark, sf_dir)
    rows = looming.estimated(boxes, looming.VARIANTS[number]).select("seq", "start", "query_t", "status", F.col("ttc").alias("pred"))
    return compared(with_truth(rows, series))


def with_truth(rows: DataFrame, series: DataFrame) -> DataFrame:
    """rows (seq, query_t and others) plus truth, null where the series doesn't reach."""
    return asof_interpolate(rows, series, "query_t", 0.1).withColumnRenamed("v", "truth").drop("query_t", "v_status")


def compared(rows: DataFrame) -> DataFrame:
    """rows (seq, pred, truth and others) plus error and fold."""
    return rows.withColumns({"error": metrics.error_pct(F.col("pred"), F.col("truth")), "fold": F.col("seq")})


def evaluated_each(spark: SparkSession, sf_dir: str, numbers: tuple[int, ...]) -> DataFrame:
    """seq, start, truth and, for each variant, v<number> (status, pred, error), fitted and compared once."""
    boxes, series = observed(spark, sf_dir)
    rows = with_truth(looming.estimates(boxes, numbers), series)
    each = {f"v{n}": F.struct(F.col(f"v{n}.status").alias("status"), F.col(f"v{n}.ttc").alias("pred"), metrics.error_pct(F.col(f"v{n}.ttc"), F.col("truth")).alias("error")) for n in numbers}
    return rows.withColumns(each)


def _sql(number: int = NUMBER) -> str:
    return f"""WITH est AS ({looming_sql.estimate(looming.VARIANTS[number]).replace("round(CASE pick", "(CASE pick").replace("ELSE q75 END, 5)", "ELSE q75 END)")}),
{GROUND_TRUTH_SQL},
m AS (SELECT e.seq, e.start, e.status, e.ttc AS pred, g.truth, CASE WHEN truth > 0 THEN abs(e.ttc - truth) / truth * 100 END AS error, e.seq AS fold FROM est e JOIN (
  SELECT q.seq, start, CASE WHEN p IS NULL THEN v ELSE pv + (ts - p) / (t - p) * (v - pv) END AS truth FROM (SELECT DISTINCT seq, start, start * 0.1::DOUBLE AS ts FROM est) q LEFT JOIN seg ON seg.seq = q.seq AND ts <= t AND (ts > p OR p IS NULL AND ts = t)) g
  ON g.seq = e.seq AND g.start = e.start)"""


_M = _sql()
_FAMILY = "CASE WHEN truth IS NULL THEN 'GT_INVALID' WHEN NOT starts_with(status, 'OK') THEN 'NO_PRED' " + " ".join(f"WHEN contains(status, '{a}') THEN '{b}'" for a, b in metrics.FAMILIES) + " WHEN status = 'OK_BBOX_MULTI_Q25' THEN 'HIGH_CONF_Q25' ELSE 'OK_OTHER' END"
_BUCKET = "CASE WHEN truth IS NULL THEN 'GT_INVALID' WHEN truth <= 1 THEN '<=1' WHEN truth <= 2 THEN '1-2' WHEN truth <= 3.5 THEN '2-3.5' WHEN truth <= 6 THEN '3.5-6' ELSE '>6' END"
_FAILURE = """CASE WHEN truth IS NULL THEN 'GT_INVALID' WHEN pred IS NULL THEN 'NO_PREDICTION' WHEN error >= 100 THEN 'SEVERE_' || CASE WHEN pred / truth >= 1 THEN 'OVER' ELSE 'UNDER' END
  WHEN error >= 50 THEN 'HIGH_' || CASE WHEN pred / truth >= 1 THEN 'OVER' ELSE 'UNDER' END WHEN contains(status, 'GUARD') THEN 'LOW_ERROR_GUARDED' ELSE 'LOW_ERROR' END"""
_SUMMARY = "count(*) AS n, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.9), 4) AS p90, count(*) FILTER (error > 50) AS over50, count(*) FILTER (error > 100) AS over100"


@query("interval_metrics", f"{_M} SELECT seq, start, status, round(pred, 5) AS pred, round(truth, 5) AS truth, round(error, 4) AS error FROM m")
def interval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("seq", "start", "status", F.round("pred", 5).alias("pred"), F.round("truth", 5).alias("truth"), F.round("error", 4).alias("error"))


@query(
    "run_summary_rollup",
    f"""{_M} SELECT coalesce(seq::VARCHAR, 'ALL') AS seq, count(truth) AS gt_valid, count(*) FILTER (pred IS NOT NULL AND truth IS NOT NULL) AS est_valid, count(*) FILTER (NOT starts_with(status, 'OK')) AS failures,
    round(avg(CASE WHEN pred IS NOT NULL AND truth IS NOT NULL THEN abs(pred - truth) END), 5) AS mae, round(avg(error), 4) AS e_ttc FROM m GROUP BY ROLLUP (m.seq)""",
)
def run_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(evaluated(spark, sf_dir)).withColumn("seq", F.coalesce(F.col("seq").cast("string"), F.lit("ALL")))


@query("error_summary_by_family", f"{_M} SELECT {_FAMILY} AS family, {_SUMMARY} FROM m WHERE error IS NOT NULL GROUP BY 1")
def error_summary_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluated(spark, sf_dir)
    return metrics.error_summary(df.withColumn("family", metrics.status_family(F.col("status"), F.col("truth"))), ["family"])


@query("error_summary_by_bucket", f"{_M} SELECT {_BUCKET} AS bucket, {_SUMMARY} FROM m WHERE error IS NOT NULL GROUP BY 1")
def error_summary_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluated(spark, sf_dir)
    return metrics.error_summary(df.withColumn("bucket", metrics.truth_bucket(F.col("truth"))), ["bucket"])


@query("failure_types", f"{_M} SELECT seq, start, {_FAILURE} AS failure, {_BUCKET} AS bucket FROM m")
def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    failure = metrics.failure_type(F.col("pred"), F.col("truth"), F.col("status"))
    return evaluated(spark, sf_dir).select("seq", "start", failure.alias("failure"), metrics.truth_bucket(F.col("truth")).alias("bucket"))


@query(
    "failure_summary",
    f"""{_M}, t AS (SELECT *, {_FAILURE} AS failure FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY failure ORDER BY error DESC NULLS LAST, seq, start) AS place FROM t)
    SELECT failure, count(*) AS n, count(*) FILTER (error >= 50) AS high, count(*) FILTER (error >= 100) AS severe, round(avg(error), 4) AS mean,
    string_agg(CASE WHEN place <= 5 AND error IS NOT NULL THEN seq || ':' || start END, ';' ORDER BY place) AS examples FROM r GROUP BY 1""",
)
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluated(spark, sf_dir).withColumn("failure", metrics.failure_type(F.col("pred"), F.col("truth"), F.col("status")))
    counts = df.groupBy("failure").agg(F.count("*").alias("n"), F.count_if(F.col("error") >= 50).alias("high"), F.count_if(F.col("error") >= 100).alias("severe"), F.round(F.avg("error"), 4).alias("mean"))
    return counts.join(metrics.worst_examples(df, "failure"), "failure", "left")


@query(
    "topk_regressions",
    f"""WITH a AS ({_M} SELECT seq, start, error FROM m), b AS ({_sql(4)} SELECT seq, start, error FROM m)
    SELECT seq, start, round(a.error - b.error, 4) AS delta FROM a JOIN b USING (seq, start) WHERE a.error IS NOT NULL AND b.error IS NOT NULL ORDER BY round(a.error - b.error, 4) DESC, seq, start LIMIT 20""",
)
def topk_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.round(F.col(f"v{NUMBER}.error") - F.col("v4.error"), 4)
    return evaluated_each(spark, sf_dir, (NUMBER, 4)).select("seq", "start", delta.alias("delta")).where("delta IS NOT NULL").orderBy(F.desc("delta"), "seq", "start").limit(20)


@query(
    "rejection_scenarios",
    f"""{_M}, s AS (SELECT *, unnest(['ALL', 'NO_LOWCAND', 'NO_LOWFIT', 'NO_DISP', 'HIGH_CONF_ONLY']) AS scenario, {_FAMILY} AS family FROM m WHERE error IS NOT NULL)
    SELECT scenario, {_SUMMARY} FROM s WHERE scenario = 'ALL' OR (scenario = 'HIGH_CONF_ONLY' AND family = 'HIGH_CONF_Q25') OR (starts_with(scenario, 'NO_') AND family <> substr(scenario, 4)) GROUP BY 1""",
)
def rejection_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("ALL", "NO_LOWCAND", "NO_LOWFIT", "NO_DISP", "HIGH_CONF_ONLY")])
    df = evaluated(spark, sf_dir).withColumns({"family": metrics.status_family(F.col("status"), F.col("truth")), "scenario": F.explode(names)})
    s, family = F.col("scenario"), F.col("family")
    kept = (s == "ALL") | ((s == "HIGH_CONF_ONLY") & (family == "HIGH_CONF_Q25")) | (s.startswith("NO_") & (family != F.substring(s, 4, 40)))
    return metrics.error_summary(df.where(kept), ["scenario"])


def _median_sql(frame: str) -> str:
    return f"""{_M} SELECT seq, start, round(CASE WHEN median IS NOT NULL THEN greatest(0.05, least(25, median)) END, 5) AS smooth FROM (
    SELECT seq, start, quantile_cont(pred, 0.5) OVER (PARTITION BY seq ORDER BY start ROWS BETWEEN {frame}) AS median FROM m)"""


@query("rolling_median_center", _median_sql("5 PRECEDING AND 5 FOLLOWING"))
def rolling_median_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.rolling_median(evaluated(spark, sf_dir), 11, causal=False, value="pred").select("seq", "start", F.round("smooth", 5).alias("smooth"))


@query("rolling_median_causal", _median_sql("4 PRECEDING AND CURRENT ROW"))
def rolling_median_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.rolling_median(evaluated(spark, sf_dir), 5, causal=True, value="pred").select("seq", "start", F.round("smooth", 5).alias("smooth"))


def _clip_sql(low: str, high: str) -> str:
    return f"""{_M.replace("WITH est", "WITH RECURSIVE est", 1)}, r AS (SELECT seq, start, pred, row_number() OVER (PARTITION BY seq ORDER BY start) AS k FROM m),
    c(seq, k, start, pred, smooth) AS (SELECT seq, k, start, pred, pred FROM r WHERE k = 1 UNION ALL SELECT r.seq, r.k, r.start, r.pred,
      CASE WHEN r.pred IS NULL OR c.smooth IS NULL THEN r.pred ELSE greatest({low}, least({high}, r.pred)) END FROM c JOIN r ON r.seq = c.seq AND r.k = c.k + 1)
    SELECT seq, start, round(smooth, 5) AS smooth FROM c"""


@query("delta_clip", _clip_sql("c.smooth - 1", "c.smooth + 1"))
def delta_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.recursive_clip(evaluated(spark, sf_dir), 1.0, value="pred").select("seq", "start", F.round("smooth", 5).alias("smooth"))


@query("ratio_clip", _clip_sql("c.smooth / 1.5::DOUBLE", "c.smooth * 1.5::DOUBLE"))
def ratio_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.recursive_clip(evaluated(spark, sf_dir), 1.5, ratio=True, value="pred").select("seq", "start", F.round("smooth", 5).alias("smooth"))


def _clips_sql(ratio: bool, sizes: tuple[float, ...]) -> str:
    low, high = ("c.smooth / {}::DOUBLE", "c.smooth * {}::DOUBLE") if ratio else ("c.smooth - {}::DOUBLE", "c.smooth + {}::DOUBLE")
    each = [f"SELECT {x}::DOUBLE AS size, * FROM ({_clip_sql(low.format(x), high.format(x))})" for x in sizes]
    return " UNION ALL ".join(each)


def _clips(spark: SparkSession, sf_dir: str, sizes: tuple[float, ...], ratio: bool) -> DataFrame:
    each = written(evaluated(spark, sf_dir).select("seq", "start", "pred"), "clip-rows")
    found = [clips.recursive_clip(each, x, ratio, "pred").select(F.lit(x).alias("size"), "seq", "start", F.round("smooth", 5).alias("smooth")) for x in sizes]
    return reduce(DataFrame.unionByName, found)


@query("delta_clips", _clips_sql(False, (0.5, 2.0)))
def delta_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir, (0.5, 2.0), False)


@query("ratio_clips", _clips_sql(True, (1.25, 2.0)))
def ratio_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir, (1.25, 2.0), True)


#: Gate thresholds: these quantiles of the training rows.
SHARES = [k / 20 for k in range(1, 21)]


@query(
    "gate_1f_loso",
    f"""{_M}, u AS (SELECT fold, pred, error FROM m WHERE error IS NOT NULL), f AS (SELECT DISTINCT fold FROM u),
    th AS (SELECT f.fold, unnest(list_distinct(quantile_cont(pred, {SHARES}))) AS threshold FROM f JOIN u ON u.fold <> f.fold GROUP BY f.fold),
    t AS (SELECT th.fold, threshold, count(*) AS train_n, avg(error) AS mean FROM th JOIN u ON u.fold <> th.fold AND u.pred <= th.threshold GROUP BY 1, 2),
    best AS (SELECT * FROM t WHERE train_n >= 100 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(mean, 9) <= 50 DESC, CASE WHEN round(mean, 9) <= 50 THEN -train_n END, CASE WHEN round(mean, 9) > 50 THEN round(mean, 9) END, threshold) = 1)
    SELECT b.fold, round(threshold, 4) AS threshold, train_n, round(mean, 4) AS mean, (SELECT count(*) FROM u WHERE u.fold = b.fold AND u.pred <= b.threshold) AS kept FROM best b""",
)
def gate_1f_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.threshold_gate(evaluated(spark, sf_dir), "pred", SHARES, 50.0, 100)
    return found.select("fold", F.round("threshold", 4).alias("threshold"), "train_n", F.round("mean", 4).alias("mean"), "kept")


@query("gate_1f_rows", ORACLES["gate_1f_loso"].replace("SELECT b.fold, round(threshold", "SELECT u.seq, u.start FROM best b JOIN (SELECT seq, start, fold, pred FROM m WHERE error IS NOT NULL) u ON u.fold = b.fold AND u.pred <= b.threshold --").split("--")[0])
def gate_1f_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each held-out sequence's gate keeps."""
    rows = written(evaluated(spark, sf_dir).where("error IS NOT NULL").select("seq", "start", "fold", "pred", "error"), "gate-rows")
    found = gates.threshold_gate(rows, "pred", SHARES, 50.0, 100)
    return gates.gated(rows, found, {"pred": "threshold"}).select("seq", "start")


@query(
    "log_affine_loso",
    f"""{_M}, f AS (SELECT DISTINCT fold FROM m WHERE pred > 0 AND truth > 0) SELECT f.fold, count(*) AS n, round(regr_intercept(ln(truth), ln(pred)), 6) AS a, round(regr_slope(ln(truth), ln(pred)), 6) AS b
    FROM f JOIN m ON m.fold <> f.fold WHERE pred > 0 AND truth > 0 GROUP BY 1""",
)
def log_affine_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.log_affine(evaluated(spark, sf_dir)).select("fold", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("zscore_features", f"{_M}, s AS (SELECT avg(pred) AS mp, stddev_pop(pred) AS sp, avg(error) AS me, stddev_pop(error) AS se FROM m) SELECT seq, start, round((pred - mp) / sp, 5) AS pred, round((error - me) / se, 5) AS error FROM m, s")
def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.zscores(evaluated(spark, sf_dir), ["pred", "error"]).select("seq", "start", F.round("pred", 5).alias("pred"), F.round("error", 5).alias("error"))


@query("skip_completed_anti", f"{_M} SELECT a.seq, a.start FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.seq = a.seq AND b.start = a.start AND starts_with(b.status, 'OK'))")
def skip_completed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluated(spark, sf_dir)
    done = df.where(F.col("status").startswith("OK")).select("seq", "start")
    return unfinished(df.select("seq", "start"), done, ["seq", "start"])


@query("sequence_coverage", f"{_M} SELECT fold, count(*) AS n, count(pred) AS with_estimate, round(count(pred) / count(*)::DOUBLE, 6) AS coverage, count(DISTINCT CASE WHEN pred IS NOT NULL THEN seq END) AS sequences FROM m GROUP BY 1")
def sequence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).groupBy("fold").agg(
        F.count("*").alias("n"), F.count("pred").alias("with_estimate"), F.round(F.count("pred") / F.count("*"), 6).alias("coverage"), F.count_distinct(F.when(F.col("pred").isNotNull(), F.col("seq"))).alias("sequences")
    )


@query("log_disagreement", f"""WITH a AS ({_sql(4)} SELECT seq, start, pred FROM m), b AS ({_sql(6)} SELECT seq, start, pred FROM m), c AS ({_M} SELECT seq, start, pred FROM m),
    u AS (FROM a UNION ALL FROM b UNION ALL FROM c) SELECT seq, start, count(pred) AS models, round(CASE WHEN count(pred) >= 2 THEN stddev_pop(ln(pred)) END, 5) AS spread FROM u GROUP BY 1, 2""")
def log_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = F.array_compact(F.array(*[F.log(f"v{n}.ttc") for n in (4, 6, NUMBER)]))
    rows = looming.estimates(tracks(spark, sf_dir), (4, 6, NUMBER)).select("seq", "start", logs.alias("logs"))
    n = F.size("logs")
    mean = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(F.transform("logs", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / n)
    return rows.select("seq", "start", n.cast("bigint").alias("models"), F.round(F.when(n >= 2, spread), 5).alias("spread"))
