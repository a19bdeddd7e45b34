"""Queries on the second event predictor, its comparison with the first, and the estimator with fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fn
from ..operators import looming, metrics
from ..operators import quality_cues as ops
from ..operators import surface as surf
from ..operators.joins import asof_interpolate
from ..sources.driver import DAY_US, GROUND_TRUTH_SQL, events, ground_truth, intervals, observed, tracks
from .cues import _CUES, _FALL, PIXELS, UNIT_US, _cues, _fallback
from .evaluation import _sql
from .events import _CONF, _confidence, _regions, _spans, _surface
from .registry import query

#: Spans of a month, so that cells hold several pixels; ages are in such spans.
DAYS = 30
LIMITS = ops.CueLimits(pixels=PIXELS, radius_span=0.5)

_CUES2 = f"""{_CUES}, {_FALL}, px2 AS (SELECT c.seq, c.idx, c."row", c.col, round(s.conf, 10) AS conf, CASE WHEN surface >= 0.15 THEN surface END AS w, CASE WHEN surface >= 0.15 THEN (last_us - hi) / {UNIT_US}::DOUBLE END AS age, x::DOUBLE AS x, y::DOUBLE AS y, x1, y1, x2, y2
  FROM celled c JOIN sel s ON s.seq = c.seq AND s.idx = c.idx AND s."row" = c."row" AND s.col = c.col),
centred AS (SELECT *, sum(w * x) OVER cell / sum(w) OVER cell AS cx, sum(w * y) OVER cell / sum(w) OVER cell AS cy FROM px2 WINDOW cell AS (PARTITION BY seq, idx, "row", col)),
radii AS (SELECT *, CASE WHEN w IS NOT NULL THEN sqrt((x - cx) ** 2 + (y - cy) ** 2) END AS r FROM centred),
means AS (SELECT *, sum(w * age) OVER cell / sum(w) OVER cell AS ma, sum(w * r) OVER cell / sum(w) OVER cell AS mr FROM radii WINDOW cell AS (PARTITION BY seq, idx, "row", col)),
sums2 AS (SELECT seq, idx, "row", col, conf, x1, y1, x2, y2, count(w) AS points, any_value(cx) AS cx, any_value(cy) AS cy, any_value(ma) AS ma, any_value(mr) AS mr, max(r) - min(r) AS radius_span, max(age) - min(age) AS time_span,
  sum(w) AS sw, sum(w * (age - ma) ** 2) AS saa, sum(w * (age - ma) * (r - mr)) AS sar, sum(w * (r - mr) ** 2) AS srr FROM means GROUP BY seq, idx, "row", col, conf, x1, y1, x2, y2),
fit3 AS (SELECT *, mr - slope * ma AS radius, sqrt(greatest(0, srr - slope * sar) / sw) AS residual FROM (SELECT *, CASE WHEN abs(saa) >= 1e-12 THEN sar / saa END AS slope FROM sums2)),
told AS (SELECT *, CASE WHEN points < {LIMITS.pixels} THEN 'TOO_FEW_ACTIVE_PIXELS' WHEN mr <= {LIMITS.radius} OR radius_span < {LIMITS.radius_span} THEN 'RADIUS_SUPPORT_TOO_SMALL' WHEN time_span < {LIMITS.time_span} THEN 'TIME_SUPPORT_TOO_SMALL' WHEN slope IS NULL THEN 'FIT_FAIL'
  WHEN radius <= {LIMITS.radius} THEN 'RADIUS_TOO_SMALL' WHEN slope <= {LIMITS.slope} THEN 'NON_POSITIVE_EXPANSION' WHEN NOT radius / slope BETWEEN {LIMITS.low_ttc} AND {LIMITS.high_ttc} THEN 'TTC_OUT_OF_RANGE' ELSE 'OK' END AS status, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS diagonal FROM fit3),
cue2 AS (SELECT seq, idx, "row", col, conf, points, cx, cy, radius, slope, residual, time_span, radius_span, status, CASE WHEN status = 'OK' THEN radius / slope END AS ttc,
  CASE WHEN status IN ('OK', 'TTC_OUT_OF_RANGE') THEN (conf + greatest(0, least(1, 1 - residual / 2.5::DOUBLE)) + greatest(0, least(1, radius_span / 10)) + greatest(0, least(1, time_span / 0.02::DOUBLE))
    + greatest(0, least(1, (sqrt((cx - (x1 + x2) / 2) ** 2 + (cy - (y1 + y2) / 2) ** 2) - 0.1::DOUBLE * diagonal) / ((0.35::DOUBLE - 0.1::DOUBLE) * diagonal)))) / 5 END AS quality FROM told)"""
_STATS2 = f"""{_CUES2}, weighed AS (SELECT *, greatest(1, points) * greatest(1e-6, conf) * greatest(1e-6, quality) AS wt FROM cue2 WHERE status = 'OK'),
heaped AS (SELECT *, sum(wt) OVER (PARTITION BY seq, idx ORDER BY ttc) AS upto, sum(wt) OVER (PARTITION BY seq, idx) AS total FROM weighed),
stats2 AS (SELECT *, iqr / greatest(abs(median), 1e-6) AS dispersion FROM (SELECT seq, idx, count(*) AS cues, min(ttc) FILTER (upto >= 0.5 * total) AS pick, quantile_cont(ttc, 0.5) AS median, quantile_cont(ttc, 0.75) - quantile_cont(ttc, 0.25) AS iqr, min(ttc) AS low, max(ttc) AS high,
  sum(quality * wt) / sum(wt) AS wq, avg(quality) AS quality, quantile_cont(quality, 0.75) - quantile_cont(quality, 0.25) AS quality_iqr, min(quality) AS quality_low, max(quality) AS quality_high FROM heaped GROUP BY 1, 2))"""
_V2 = f"""{_STATS2}, sc AS (SELECT f.seq, f.idx, fallback, coalesce(cues, 0) AS cues, pick, wq, dispersion, pick / greatest(fallback, 1e-6) AS ratio, (wq + greatest(0, least(1, 1 - dispersion / 0.4::DOUBLE)) + greatest(0, least(1, (cues - 1) / 2::DOUBLE))) / 3 AS score FROM fall f LEFT JOIN stats2 t ON t.seq = f.seq AND t.idx = f.idx),
v2s AS (SELECT *, CASE WHEN cues = 0 THEN 'OK_FALLBACK' WHEN cues >= 3 AND wq >= 0.9 AND score >= 0.78 AND dispersion <= 0.4 AND ratio >= 0.6 THEN 'OK_CUE_ONLY' WHEN ratio < 0.55 AND (wq < 0.8 OR score < 0.6 OR dispersion > 0.75 OR cues <= 1) THEN 'OK_FALLBACK' ELSE 'OK_BLEND' END AS status FROM sc),
v2 AS (SELECT seq, idx, status, cues, fallback, CASE status WHEN 'OK_CUE_ONLY' THEN pick WHEN 'OK_BLEND' THEN (1 - share) * pick + share * fallback ELSE fallback END AS ttc FROM (SELECT *, greatest(0.3, least(0.6, 0.6 - 0.3 * greatest(0, least(1, score))))::DOUBLE AS share FROM v2s))"""
_V1 = """g1 AS (SELECT seq, idx, icept / slope AS ttc, conf * greatest(points, 1) AS wt FROM cue WHERE status = 'OK'), c1 AS (SELECT *, sum(wt) OVER (PARTITION BY seq, idx ORDER BY ttc) AS upto, sum(wt) OVER (PARTITION BY seq, idx) AS total FROM g1),
md1 AS (SELECT seq, idx, count(*) AS cues, min(ttc) FILTER (upto >= 0.5 * total) AS median FROM c1 GROUP BY 1, 2),
v1 AS (SELECT f.seq, f.idx, coalesce(0.65 * median + 0.35 * fallback, fallback) AS ttc, CASE WHEN median IS NOT NULL THEN 'OK' ELSE 'OK_FALLBACK' END AS status, coalesce(cues, 0) AS cues FROM fall f LEFT JOIN md1 m ON m.seq = f.seq AND m.idx = f.idx)"""
_PAIRS = f"""{_V2}, {_V1}, {GROUND_TRUTH_SQL}, placed AS (SELECT seq, idx, (row_number() OVER (PARTITION BY seq ORDER BY idx) - 1) * 0.1::DOUBLE AS ts FROM regions),
pairs AS (SELECT p.seq, p.idx, v1.status AS v1, v2.status AS v2, v1.ttc AS ttc1, v2.ttc AS ttc2, v1.ttc / v2.fallback AS cue, v1.cues <= 1 AND v2.cues <= 1 AS few, CASE WHEN p_t IS NULL THEN v ELSE pv + (ts - p_t) / (t - p_t) * (v - pv) END AS truth
  FROM placed p JOIN v1 ON v1.seq = p.seq AND v1.idx = p.idx JOIN v2 ON v2.seq = p.seq AND v2.idx = p.idx LEFT JOIN (SELECT seq, t, v, p AS p_t, pv FROM seg) s ON s.seq = p.seq AND ts <= t AND (ts > p_t OR p_t IS NULL AND ts = t))"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = _confidence(spark, sf_dir, DAYS).withColumn("conf", F.round("conf", 10))
    return ops.quality_cues(_surface(spark, sf_dir, days=DAYS), surf.selected_cells(conf), DAYS * UNIT_US, LIMITS)


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.select_by_quality(ops.cue_statistics(_quality(spark, sf_dir)), _fallback(spark, sf_dir, DAYS))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both predictors' results for each interval, with the truth at its place in its sequence's series."""
    place = F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1
    placed = _regions(spark, sf_dir, DAYS).select("seq", "idx", (place * 0.1).alias("ts"))
    truth = asof_interpolate(placed, ground_truth(spark, sf_dir), "ts", 0.1).select("seq", "idx", F.col("v").alias("truth"))
    cues = _cues(spark, sf_dir, DAYS)
    first = surf.predict_from_cues(cues, _fallback(spark, sf_dir, DAYS)).select("seq", "idx", F.col("ttc").alias("ttc1"), F.col("status").alias("v1"))
    n = cues.groupBy("seq", "idx").agg(F.count_if(F.col("status") == "OK").alias("cues1"))
    second = _second(spark, sf_dir).select("seq", "idx", F.col("ttc").alias("ttc2"), F.col("status").alias("v2"), "cues", "fallback")
    both = truth.join(first, ["seq", "idx"]).join(second, ["seq", "idx"]).join(n, ["seq", "idx"], "left")
    few = (F.coalesce("cues1", F.lit(0)) <= 1) & (F.col("cues") <= 1)
    return both.select("seq", "idx", "v1", "v2", "ttc1", "ttc2", "truth", (F.col("ttc1") / F.col("fallback")).alias("cue"), few.alias("few"))


@query("quality_cues", f'{_spans(_CUES2, DAYS)} SELECT seq, idx, "row", col, points, status, round(cx, 4) AS cx, round(cy, 4) AS cy, round(quality, 5) AS quality, round(ttc, 4) AS ttc FROM cue2')
def quality_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir).select("seq", "idx", "row", "col", "points", "status", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("quality", 5).alias("quality"), F.round("ttc", 4).alias("ttc"))


_SHOWN = ("pick", "median", "iqr", "dispersion", "low", "high", "quality", "quality_iqr", "quality_low", "quality_high")


@query("cue_diagnostics", f"{_spans(_STATS2, DAYS)} SELECT seq, idx, cues, {', '.join(f'round({c}, 4) AS {c}' for c in _SHOWN)} FROM stats2")
def cue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cue_statistics(_quality(spark, sf_dir)).select("seq", "idx", "cues", *[F.round(c, 4).alias(c) for c in _SHOWN])


@query("event_predictor_v2", f"{_spans(_V2, DAYS)} SELECT seq, idx, status, cues, round(fallback, 4) AS fallback, round(ttc, 4) AS ttc FROM v2")
def event_predictor_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _second(spark, sf_dir).select("seq", "idx", "status", "cues", F.round("fallback", 4).alias("fallback"), F.round("ttc", 4).alias("ttc"))


@query(
    "compare_summary",
    f"""{_spans(_PAIRS, DAYS)} SELECT coalesce(seq::VARCHAR, 'ALL') AS seq, count(truth) AS gt_valid, count(ttc2) AS est_valid, count(*) FILTER (NOT starts_with(v2, 'OK')) AS failures, count(*) FILTER (v2 = 'OK_FALLBACK') AS fallbacks, count(*) FILTER (v2 = 'OK_BLEND') AS blends, count(*) FILTER (v2 = 'OK_CUE_ONLY') AS cue_only,
    round(avg(abs(ttc2 - truth)), 4) AS mae, round(avg(CASE WHEN truth > 0 THEN abs(ttc2 - truth) / truth * 100 END), 3) AS e_ttc FROM pairs GROUP BY ROLLUP (pairs.seq)""",
)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pairs(spark, sf_dir).rollup("seq").agg(
        F.count("truth").alias("gt_valid"), F.count("ttc2").alias("est_valid"), F.count_if(~F.col("v2").startswith("OK")).alias("failures"), *[F.count_if(F.col("v2") == s).alias(n) for s, n in (("OK_FALLBACK", "fallbacks"), ("OK_BLEND", "blends"), ("OK_CUE_ONLY", "cue_only"))],
        F.round(F.avg(F.abs(F.col("ttc2") - F.col("truth"))), 4).alias("mae"), F.round(F.avg(metrics.error_pct(F.col("ttc2"), F.col("truth"))), 3).alias("e_ttc"),
    )
    return out.withColumn("seq", F.coalesce(F.col("seq").cast("string"), F.lit("ALL")))


@query(
    "compare_buckets",
    f"""{_spans(_PAIRS, DAYS)}, f AS (SELECT *, CASE WHEN truth > 0 THEN round((abs(ttc2 - truth) - abs(ttc1 - truth)) / truth * 100, 6) END AS delta FROM pairs),
    k AS (SELECT CASE WHEN v1 = 'OK' AND v2 = 'OK_FALLBACK' AND delta >= 15 THEN 'GUARD_FALSE_REJECT' WHEN v2 = 'OK_FALLBACK' AND delta <= -15 THEN 'FALLBACK_WIN_BIG' WHEN cue < 0.55 THEN 'CUE_UNDERESTIMATE' WHEN few THEN 'LOW_SUPPORT' WHEN v1 = 'OK_FALLBACK' AND v2 = 'OK_FALLBACK' AND abs(delta) <= 5 THEN 'STABLE_FALLBACK' ELSE 'OTHER' END AS bucket,
      concat_ws('|', CASE WHEN v1 = 'OK' AND v2 = 'OK_FALLBACK' THEN 'GUARD_SWITCH' END, CASE WHEN delta <= -15 THEN 'BIG_IMPROVEMENT' END, CASE WHEN delta >= 15 THEN 'BIG_REGRESSION' END, CASE WHEN cue < 0.55 THEN 'CUE_UNDERESTIMATE' END, CASE WHEN few THEN 'LOW_SUPPORT' END) AS flags FROM f)
    SELECT bucket, flags, count(*) AS n FROM k GROUP BY 1, 2""",
)
def compare_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the second predictor's error differs from the first's, counted."""
    delta = F.when(F.col("truth") > 0, F.round((F.abs(F.col("ttc2") - F.col("truth")) - F.abs(F.col("ttc1") - F.col("truth"))) / F.col("truth") * 100, 6))
    args = (F.col("v1"), F.col("v2"), delta, F.col("cue"), F.col("few"))
    return _pairs(spark, sf_dir).groupBy(fn.compare_bucket(*args).alias("bucket"), fn.compare_flags(*args).alias("flags")).agg(F.count("*").alias("n"))


@query(
    "looming_with_fallback",
    f"""WITH m AS ({_sql(13)} SELECT seq, start, status, pred, truth FROM m), e AS ({_CUES}, {_FALL}, {_V1} SELECT r.seq, row_number() OVER (PARTITION BY r.seq ORDER BY r.idx) - 1 AS start, v1.ttc, v1.status FROM regions r JOIN v1 ON v1.seq = r.seq AND v1.idx = r.idx),
    j AS (SELECT m.seq, m.start, m.status, pred, truth, e.ttc, e.status AS fell FROM m LEFT JOIN e ON e.seq = m.seq AND e.start = m.start)
    SELECT seq, start, CASE WHEN truth IS NULL THEN 'GT_INVALID' WHEN pred IS NOT NULL THEN status WHEN ttc IS NOT NULL AND starts_with(fell, 'OK') THEN 'OK_LTS_FALLBACK' ELSE coalesce(fell, status) END AS status, round(CASE WHEN truth IS NOT NULL THEN coalesce(pred, ttc) END, 4) AS ttc, round(CASE WHEN truth > 0 THEN abs(coalesce(pred, ttc) - truth) / truth * 100 END, 3) AS error FROM j""",
)
def looming_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box estimator; where it has no estimate, the event predictor of the interval at the same place in the sequence."""
    place = (F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1).cast("bigint")
    fell = surf.predict_from_cues(_cues(spark, sf_dir), _fallback(spark, sf_dir)).select("seq", place.alias("start"), F.col("ttc").alias("fallback"), F.col("status").alias("fell"))
    boxes, series = observed(spark, sf_dir)
    rows = looming.estimated(boxes, looming.VARIANTS[13]).select("seq", "start", "query_t", "status", "ttc")
    rows = asof_interpolate(rows, series, "query_t", 0.1).withColumnRenamed("v", "truth").drop("query_t", "v_status").join(fell, ["seq", "start"], "left")
    return looming.with_fallback(rows).select("seq", "start", "status", F.round("ttc", 4).alias("ttc"), F.round(metrics.error_pct(F.col("ttc"), F.col("truth")), 3).alias("error"))


@query(
    "feature_vector",
    f"""{_CONF}, g AS (SELECT seq, idx, "row" * 3 + col AS cell, events, ratio, mean FROM cells), v AS (SELECT seq, idx, cell AS k, ln(1 + events) AS value FROM g UNION ALL SELECT seq, idx, 9 + cell, ratio FROM g UNION ALL SELECT seq, idx, 18 + cell, mean FROM g),
    s AS (SELECT r.seq, r.idx, any_value(r.ry1 - r.ry0) AS h, any_value(r.rx1 - r.rx0) AS w, coalesce(sum(n), 0) AS n, count(s.n) AS active, coalesce(avg(surface), 0) AS mean FROM regions r LEFT JOIN surf s ON s.seq = r.seq AND s.idx = r.idx GROUP BY 1, 2),
    t AS (SELECT seq, idx, unnest(range(27, 33)) AS k, unnest([h::DOUBLE, w::DOUBLE, (h * w)::DOUBLE, n::DOUBLE, active / (h * w)::DOUBLE, mean]) AS value FROM s) SELECT seq, idx, k::INTEGER AS k, round(value, 7) AS value FROM (FROM v UNION ALL FROM t)""",
)
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of ``surface.feature_vector``, one row per place in it."""
    regions, surface = _regions(spark, sf_dir), _surface(spark, sf_dir)
    rows = surf.feature_vector(surf.grid_stats(surface, regions), surf.region_stats(surface, regions))
    return rows.select("seq", "idx", F.posexplode("vector").alias("k", "value")).withColumn("value", F.round("value", 7))


@query(
    "last_roi_events",
    f"""{_CONF}, l AS (SELECT e.seq, i.idx, e.event_id FROM ev e JOIN iv i ON e.seq = i.seq AND e.t_us >= i.lo AND e.t_us < i.hi AND x >= greatest(0, floor(x1) - 2) AND y >= greatest(0, floor(y1) - 2) AND x <= least(99, ceil(x2) + 2) AND y <= least(99, ceil(y2) + 2)
    QUALIFY row_number() OVER (PARTITION BY e.seq, i.idx ORDER BY t_us DESC, event_id DESC) <= 5) SELECT * FROM l""",
)
def last_roi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each interval inside its padded closed region."""
    return surf.last_events(surf.in_closed_region(events(spark, sf_dir), intervals(spark, sf_dir), DAY_US, pad=2), 5).select("seq", "idx", "event_id")
