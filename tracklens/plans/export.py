"""Queries on training samples, on slices of the event table, and on run summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import export, records, surface
from ..operators.joins import asof_interpolate
from ..sources import files
from ..sources.driver import DAY_US, EVENTS_SQL, GROUND_TRUTH_SQL, events, ground_truth, intervals
from ..sources.shared import shared_folder
from .evaluation import _M, evaluated
from .events import _ROI, TAU_US
from .registry import query

#: Size of the images, and what is taken from the series for a truth, so that some are not positive.
HEIGHT, WIDTH, SHIFT = 16, 12, 3.6

_TARGETS = f"""{_ROI}, {GROUND_TRUTH_SQL}, placed AS (SELECT *, (row_number() OVER (PARTITION BY seq ORDER BY idx) - 1) * 0.1::DOUBLE AS ts FROM regions),
targets AS (SELECT r.*, CASE WHEN p IS NULL THEN v ELSE pv + (ts - p) / (t - p) * (v - pv) END - {SHIFT}::DOUBLE AS truth, CASE WHEN t IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END AS truth_status
  FROM placed r LEFT JOIN (SELECT seq AS s, t, v, p, pv FROM seg) ON s = r.seq AND ts <= t AND (ts > p OR p IS NULL AND ts = t)),
judged AS (SELECT *, CASE WHEN truth IS NULL THEN 'INVALID_GT' WHEN truth <= 0 THEN 'EXPORT_FAIL' END AS reason, CASE WHEN truth IS NULL THEN truth_status WHEN truth <= 0 THEN 'truth is not positive' END AS detail FROM targets)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with region and truth (its sequence's series at the interval's place in order, less SHIFT), judged."""
    place = F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1
    regions = surface.roi(intervals(spark, sf_dir)).withColumn("ts", place * 0.1)
    truth = asof_interpolate(regions.select("seq", "idx", "ts"), ground_truth(spark, sf_dir), "ts", 0.1).select("seq", "idx", (F.col("v") - SHIFT).alias("truth"), F.col("v_status").alias("truth_status"))
    return export.judged(regions.join(truth, ["seq", "idx"]))


def _samples(spark: SparkSession, sf_dir: str, **kw: object) -> DataFrame:
    inside = surface.in_roi(events(spark, sf_dir), intervals(spark, sf_dir), DAY_US)
    return export.samples(targets(spark, sf_dir), inside, TAU_US, HEIGHT, WIDTH, **kw)


def _place(i: str, n: str, size: int) -> str:
    return f"CASE WHEN {i} = {size - 1} THEN {n} - 1 ELSE floor({i} * (({n} - 1) / {size - 1}::DOUBLE))::BIGINT END"


_CHANNELS = ("surface", "ln(1 + n)", "1")


@query(
    "sample_images",
    f"""{_TARGETS}, dense AS (SELECT j.seq, j.idx, j.truth, i * {WIDTH} + k + 1 AS place, s.n, s.surface FROM judged j, range({HEIGHT}) a(i), range({WIDTH}) b(k)
      LEFT JOIN surf s ON s.seq = j.seq AND s.idx = j.idx AND s.y = j.ry0 + {_place("i", "(j.ry1 - j.ry0)", HEIGHT)} AND s.x = j.rx0 + {_place("k", "(j.rx1 - j.rx0)", WIDTH)} WHERE j.reason IS NULL)
    SELECT seq, idx, {", ".join(f"round(coalesce(sum({c}) FILTER (n IS NOT NULL), 0), 6)::DOUBLE AS sum{k}, round(coalesce(sum(({c}) * place) FILTER (n IS NOT NULL), 0), 4)::DOUBLE AS moment{k}" for k, c in enumerate(_CHANNELS))}, round(any_value(truth), 6) AS gt_ttc, round(ln(any_value(truth)), 6) AS gt_log, {3 * HEIGHT * WIDTH} AS n_values, 27 AS n_stats, 6 AS n_metadata FROM dense GROUP BY 1, 2""",
)
def sample_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's image, told by the sums and first moments of its three channels, with its targets and sizes."""
    out, n = [], HEIGHT * WIDTH
    for k in range(len(_CHANNELS)):
        channel = F.slice("image", k * n + 1, n)
        out.append(F.round(F.aggregate(channel, F.lit(0.0), lambda a, v: a + v), 6).alias(f"sum{k}"))
        weighed = F.transform(channel, lambda v, place: v * (place + 1))
        out.append(F.round(F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v), 4).alias(f"moment{k}"))
    sizes = [F.size(c).alias(f"n_{name}") for c, name in (("image", "values"), ("stats", "stats"), ("metadata", "metadata"))]
    return _samples(spark, sf_dir).select("seq", "idx", *out, F.round("gt_ttc", 6).alias("gt_ttc"), F.round("gt_log", 6).alias("gt_log"), *sizes)


@query("sample_skips", f"{_TARGETS} SELECT seq, idx, reason, detail FROM judged WHERE reason IS NOT NULL")
def sample_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.skips(targets(spark, sf_dir))


@query("export_summary", f"{_TARGETS} SELECT coalesce(seq::VARCHAR, 'ALL') AS seq, count(*) FILTER (reason IS NULL) AS samples, count(reason) AS skipped, count(*) FILTER (reason = 'INVALID_GT') AS invalid_gt, count(*) FILTER (reason = 'EXPORT_FAIL') AS export_fail FROM judged GROUP BY ROLLUP (judged.seq)")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.summary(targets(spark, sf_dir)).withColumn("seq", F.coalesce(F.col("seq").cast("string"), F.lit("ALL")))


#: A slice of the event table.
SLICE = (7, 2, 60)


@query("event_range_scan", f"WITH {EVENTS_SQL} SELECT * FROM (SELECT seq, event_id, t_us, x, y, p, row_number() OVER (PARTITION BY seq ORDER BY t_us, event_id) - 1 AS event_idx FROM ev) WHERE seq = {SLICE[0]} AND event_idx >= {SLICE[1]} AND event_idx < {SLICE[2]}")
def event_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of one sequence's events, read from the sorted layout of all of them."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    files.write_events(files.numbered(events(spark, sf_dir), 30 * DAY_US), path)
    return files.event_slice(spark, path, *SLICE).select("seq", "event_id", "t_us", "x", "y", "p", "event_idx")


#: Runs of the frontier, one for each remainder of the sequence by RUNS; the last wanted one doesn't exist.
RUNS, LIMITS = 5, {"upto_1": 1.0, "upto_2": 2.0, "upto_4": 4.0, records.BASE_POLICY: 1e9}

_RUN = f"""{_M}, r AS (SELECT 'run-' || seq % {RUNS} AS run, pred, truth, error FROM m), t AS (SELECT run, count(truth) AS with_truth, count(error) AS valid FROM r GROUP BY 1),
p AS (SELECT unnest({[k for k in LIMITS]}) AS policy, unnest({[v for v in LIMITS.values()]}) AS upto),
s AS (SELECT r.run, 7.0::DOUBLE AS target, p.policy, count(*) AS est_valid, avg(abs(pred - truth)) AS mae_s, avg(error) AS e_ttc, count(*) / any_value(valid)::DOUBLE AS of_valid, count(*) / any_value(with_truth)::DOUBLE AS of_truth, count(*) FILTER (error > 50) AS over50, count(*) FILTER (error > 100) AS over100
  FROM r JOIN t USING (run) JOIN p ON pred <= upto WHERE error IS NOT NULL GROUP BY ALL)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run and value: a JSON summary of each run's policies, as runs write them."""
    rows = evaluated(spark, sf_dir).withColumn("run", F.concat(F.lit("run-"), (F.col("seq") % RUNS).cast("string")))
    whole = rows.groupBy("run").agg(F.count("truth").alias("with_truth"), F.count("error").alias("valid"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.lit(v).alias("upto")) for k, v in LIMITS.items()]))
    kept = rows.where("error IS NOT NULL").select("run", "pred", "truth", "error", each.alias("p")).where("pred <= p.upto")
    told = kept.groupBy("run", F.col("p.policy").alias("policy")).agg(F.count("*").alias("count"), F.avg(F.abs(F.col("pred") - F.col("truth"))).alias("mae_s"), F.avg("error").alias("e_ttc_pct"), F.count_if(F.col("error") > 50).alias("over50"), F.count_if(F.col("error") > 100).alias("over100")).join(whole, "run")
    summary = F.struct("count", "mae_s", "e_ttc_pct", (F.col("count") / F.col("valid")).alias("coverage_of_v13_valid"), (F.col("count") / F.col("with_truth")).alias("coverage_of_gt_valid"), "over50", "over100")
    policies = F.map_from_entries(F.collect_list(F.struct("policy", summary)))  # one entry a policy
    return told.groupBy("run").agg(F.to_json(F.struct(F.struct(F.lit(7.0).alias("target_e_ttc_pct")).alias("args"), policies.alias("policy_summaries"))).alias("value"))


@query(
    "coverage_frontier",
    f"""{_RUN}, k AS (SELECT * FROM s WHERE policy <> '{records.BASE_POLICY}')
    SELECT run, target, policy, est_valid, round(mae_s, 5) AS mae_s, round(e_ttc, 4) AS e_ttc, round(of_valid, 6) AS of_valid, round(of_truth, 6) AS of_truth, over50, over100, 'ok' AS status, e_ttc < 7 AS success,
      NOT EXISTS (SELECT 1 FROM k o WHERE o.run = k.run AND (o.of_truth >= k.of_truth AND o.e_ttc < k.e_ttc OR o.of_truth > k.of_truth AND o.e_ttc <= k.e_ttc)) AS best FROM k
    UNION ALL SELECT 'run-{RUNS}', NULL, 'missing', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing', NULL, false""",
)
def coverage_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(f"run-{k}",) for k in range(RUNS + 1)], "run string")
    rows = records.frontier(records.coverage_rows(summaries(spark, sf_dir), wanted))
    shown = {"mae_s": 5, "e_ttc": 4, "of_valid": 6, "of_truth": 6}
    return rows.select("run", "target", "policy", "est_valid", *[F.round(c, k).alias(c) for c, k in shown.items()], "over50", "over100", "status", "success", "best")


@query("metric_records", f"""{_RUN} SELECT run AS file, '$.policy_summaries.' || policy AS path, est_valid AS count, round(e_ttc, 4) AS e_ttc FROM s""")
def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with a metric in the runs' summaries, found wherever it stands."""
    found = records.metric_records(summaries(spark, sf_dir).withColumnRenamed("run", "file"))
    return found.select("file", "path", F.get_json_object("record", "$.count").cast("bigint").alias("count"), F.round(F.get_json_object("record", "$.e_ttc_pct").cast("double"), 4).alias("e_ttc"))
