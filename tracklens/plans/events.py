"""Queries on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import surface as ops
from ..operators.joins import asof_interpolate, interval_join
from ..sources.driver import DAY_US, EVENTS_SQL, GROUND_TRUTH_SQL, INTERVALS_SQL, TRACKS_SQL, events, ground_truth, intervals, tracks
from .registry import query

TAU_US = 20_000_000_000

_BASE = f"WITH {EVENTS_SQL}, {INTERVALS_SQL}"
_ROI = f"""{_BASE}, roi AS (SELECT *, greatest(0, floor(x1))::BIGINT AS rx0, greatest(0, floor(y1))::BIGINT AS ry0, least(100, ceil(x2))::BIGINT AS rx1, least(100, ceil(y2))::BIGINT AS ry1 FROM iv),
inside AS (SELECT e.*, r.idx, r.hi, rx0, ry0, rx1, ry1, x1, y1, x2, y2 FROM ev e JOIN roi r ON e.seq = r.seq AND e.t_us >= r.lo AND e.t_us < r.hi AND e.x >= rx0 AND e.x < rx1 AND e.y >= ry0 AND e.y < ry1 WHERE rx1 > rx0 AND ry1 > ry0),
surf AS (SELECT seq, idx, x, y, hi, rx0, ry0, rx1, ry1, x1, y1, x2, y2, count(*) AS n, max(t_us) AS last_us, exp(-(hi - max(t_us)) / {TAU_US}::DOUBLE) AS surface FROM inside GROUP BY seq, idx, x, y, hi, rx0, ry0, rx1, ry1, x1, y1, x2, y2),
regions AS (SELECT * FROM roi WHERE rx1 > rx0 AND ry1 > ry0)"""
_GRID = f"""{_ROI}, celled AS (SELECT *, CASE WHEN y - ry0 >= (ry1 - ry0) // 3 THEN 1 ELSE 0 END + CASE WHEN y - ry0 >= 2 * (ry1 - ry0) // 3 THEN 1 ELSE 0 END AS "row",
    CASE WHEN x - rx0 >= (rx1 - rx0) // 3 THEN 1 ELSE 0 END + CASE WHEN x - rx0 >= 2 * (rx1 - rx0) // 3 THEN 1 ELSE 0 END AS col FROM surf),
have AS (SELECT seq, idx, "row", col, sum(n) AS events, count(*) AS active, avg(surface) AS mean, max(surface) AS top, min(surface) AS low FROM celled GROUP BY seq, idx, "row", col),
cells AS (SELECT b.seq, b.idx, r."row", c.col, coalesce(h.events, 0)::BIGINT AS events, coalesce(h.active, 0) AS active,
    coalesce(h.active, 0) / greatest(1, ((r."row" + 1) * (ry1 - ry0) // 3 - r."row" * (ry1 - ry0) // 3) * ((c.col + 1) * (rx1 - rx0) // 3 - c.col * (rx1 - rx0) // 3))::DOUBLE AS ratio,
    coalesce(h.mean, 0) AS mean, coalesce(h.top, 0) AS top, coalesce(h.low, 0) AS low
  FROM regions b CROSS JOIN (SELECT unnest(range(3)) AS "row") r CROSS JOIN (SELECT unnest(range(3)) AS col) c
  LEFT JOIN have h ON h.seq = b.seq AND h.idx = b.idx AND h."row" = r."row" AND h.col = c.col)"""
_CONF = f"""{_GRID}, conf AS (SELECT *, CASE WHEN active > 0 THEN 0.35 * greatest(0, least(1, ln(1 + events) / ln(9::DOUBLE))) + 0.30 * greatest(0, least(1, ratio / 0.05)) + 0.35 * greatest(0, least(1, (mean - 0.05) / 0.6)) ELSE 0 END AS conf FROM cells)"""


def _spans(sql: str, days: int) -> str:
    """The SQL with intervals, decay and unit of age of so many days."""
    return sql.replace(str(DAY_US), str(days * DAY_US)).replace(str(TAU_US), str(days * TAU_US))


def _surface(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (), days: int = 1) -> DataFrame:
    return ops.time_surface(ops.in_roi(events(spark, sf_dir), intervals(spark, sf_dir, days), days * DAY_US), days * TAU_US, extra)


def _regions(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    return ops.roi(intervals(spark, sf_dir, days))


def _grid(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    return ops.grid_stats(_surface(spark, sf_dir, days=days), _regions(spark, sf_dir, days))


def _confidence(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    return ops.local_confidence(_grid(spark, sf_dir, days))


@query("event_interval_join", f"{_BASE} SELECT i.seq, i.idx, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM ev e JOIN iv i ON e.seq = i.seq AND e.t_us >= i.lo AND e.t_us < i.hi GROUP BY 1, 2")
def event_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interval_join(events(spark, sf_dir), intervals(spark, sf_dir), DAY_US)
    return rows.groupBy("seq", "idx").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(
    "tumbling_event_windows",
    f"""WITH {EVENTS_SQL}, span AS (SELECT seq, min(t_us) AS t0, max(t_us) AS t1 FROM ev GROUP BY 1), wins AS (SELECT seq, t0, unnest(range(0, greatest(1, (t1 - t0 + {DAY_US} - 1) // {DAY_US}))) AS win FROM span)
    SELECT w.seq, w.win, count(e.event_id) AS n FROM wins w LEFT JOIN ev e ON e.seq = w.seq AND (e.t_us - w.t0) // {DAY_US} = w.win GROUP BY 1, 2""",
)
def tumbling_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    span = ev.groupBy("seq").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    last = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / DAY_US))
    wins = span.withColumn("win", F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)))
    counts = ev.join(span, "seq").groupBy("seq", F.floor((F.col("t_us") - F.col("t0")) / DAY_US).alias("win")).agg(F.count("*").alias("n"))
    return wins.join(counts, ["seq", "win"], "left").select("seq", "win", F.coalesce("n", F.lit(0)).alias("n"))


@query("time_surface_pixels", f"{_ROI} SELECT seq, idx, x, y, n, last_us, round(surface, 9) AS surface FROM surf")
def time_surface_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir).select("seq", "idx", "x", "y", "n", "last_us", F.round("surface", 9).alias("surface"))


@query("time_surface_polarity", f"{_ROI} SELECT seq, idx, p, x, y, count(*) AS n, round(exp(-(hi - max(t_us)) / {TAU_US}::DOUBLE), 9) AS surface FROM inside GROUP BY seq, idx, p, x, y, hi")
def time_surface_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir, ("p",)).select("seq", "idx", "p", "x", "y", "n", F.round("surface", 9).alias("surface"))


@query("time_surface_multitau", f"{_ROI} SELECT seq, idx, tau, count(*) AS pixels, round(sum(exp(-(hi - last_us) / (tau * 1e9))), 6) AS total FROM surf, (SELECT unnest([5, 20, 60]) AS tau) GROUP BY 1, 2, 3")
def time_surface_multitau(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _surface(spark, sf_dir).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in (5, 20, 60)])))
    decay = F.exp(-(F.col("hi") - F.col("last_us")) / (F.col("tau") * 1e9))
    return rows.groupBy("seq", "idx", "tau").agg(F.count("*").alias("pixels"), F.round(F.sum(decay), 6).alias("total"))


@query(
    "roi_summary",
    f"{_ROI} SELECT r.seq, r.idx, coalesce(sum(n), 0)::BIGINT AS n, count(s.n) AS active, round(count(s.n) / max((r.rx1 - r.rx0) * (r.ry1 - r.ry0))::DOUBLE, 9) AS occupancy, round(coalesce(avg(surface), 0), 8) AS mean FROM regions r LEFT JOIN surf s ON s.seq = r.seq AND s.idx = r.idx GROUP BY 1, 2",
)
def roi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.region_stats(_surface(spark, sf_dir), _regions(spark, sf_dir)).select("seq", "idx", "n", "active", F.round("occupancy", 9).alias("occupancy"), F.round("mean", 8).alias("mean"))


@query("grid_stats_3x3", f'{_GRID} SELECT seq, idx, "row", col, events, active, round(ratio, 9) AS ratio, round(mean, 8) AS mean, round(top, 8) AS top, round(low, 8) AS low FROM cells')
def grid_stats_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("seq", "idx", "row", "col", "events", "active", F.round("ratio", 9).alias("ratio"), *[F.round(c, 8).alias(c) for c in ("mean", "top", "low")])


@query("local_confidence", f'{_CONF} SELECT seq, idx, "row", col, round(conf, 8) AS conf FROM conf')
def local_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confidence(spark, sf_dir).select("seq", "idx", "row", "col", F.round("conf", 8).alias("conf"))


@query("global_confidence", f"{_CONF} SELECT seq, idx, round(coalesce(sum(conf * greatest(events, 1) * active) / nullif(sum(greatest(events, 1) * active), 0), 0), 8) AS confidence FROM conf GROUP BY 1, 2")
def global_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.global_confidence(_confidence(spark, sf_dir)).select("seq", "idx", F.round("confidence", 8).alias("confidence"))


@query(
    "selected_cells",
    f"""{_CONF} SELECT seq, idx, "row", col FROM (SELECT *, active > 0 AND conf >= 0.55 AS good, count(*) FILTER (active > 0 AND conf >= 0.55) OVER (PARTITION BY seq, idx) AS n_good,
    row_number() OVER (PARTITION BY seq, idx ORDER BY active > 0 DESC, round(conf, 10) DESC, "row", col) AS place FROM conf) WHERE CASE WHEN n_good >= 1 THEN good ELSE active > 0 AND place <= 1 END""",
)
def selected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = _confidence(spark, sf_dir).withColumn("conf", F.round("conf", 10))
    return ops.selected_cells(conf).select("seq", "idx", "row", "col")


@query(
    "weighted_median_pixels",
    f"""{_ROI}, w AS (SELECT seq, idx, x AS v, sum(n) AS w FROM surf GROUP BY 1, 2, 3), c AS (SELECT *, sum(w) OVER (PARTITION BY seq, idx ORDER BY v) AS upto, sum(w) OVER (PARTITION BY seq, idx) AS total FROM w)
    SELECT seq, idx, min(v) AS median FROM c WHERE upto >= 0.5 * total GROUP BY 1, 2""",
)
def weighted_median_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.weighted_median(_surface(spark, sf_dir), ["seq", "idx"], "x", "n")


@query(
    "weighted_fit_cells",
    f"""{_ROI}, r AS (SELECT seq, x::DOUBLE AS x, y::DOUBLE AS y, n::DOUBLE AS w FROM surf), s AS (SELECT seq, count(*) AS points, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM r GROUP BY 1),
    f AS (SELECT *, CASE WHEN points >= 2 AND abs(sxx - sx * sx / sw) >= 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END AS slope FROM s) SELECT seq, points, round(slope, 6) AS slope, round((sy - slope * sx) / sw, 5) AS icept FROM f""",
)
def weighted_fit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _surface(spark, sf_dir)
    fits = ops.weighted_fit(rows, ["seq"], F.col("x").cast("double"), F.col("y").cast("double"), F.col("n").cast("double"))
    return fits.select("seq", "points", F.round("slope", 6).alias("slope"), F.round("icept", 5).alias("icept"))


@query(
    "gt_asof_interp",
    f"""WITH {TRACKS_SQL}, {GROUND_TRUTH_SQL}
    SELECT tracks.seq, label_id, CASE WHEN t IS NULL THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status, round(CASE WHEN p IS NULL THEN v ELSE pv + (ts - p) / (t - p) * (v - pv) END, 6) AS truth
    FROM tracks LEFT JOIN seg ON seg.seq = tracks.seq AND ts <= t AND (ts > p OR p IS NULL AND ts = t)""",
)
def gt_asof_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof_interpolate(tracks(spark, sf_dir), ground_truth(spark, sf_dir), "ts", 0.1)
    return out.select("seq", "label_id", F.col("v_status").alias("status"), F.round("v", 6).alias("truth"))


@query(
    "mean_pool_4x4",
    f"{_ROI} SELECT seq, x // 25 AS px, y // 25 AS py, round(sum(n) / 625.0::DOUBLE, 9) AS pooled FROM surf GROUP BY 1, 2, 3",
)
def mean_pool_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 25)
    return _surface(spark, sf_dir).groupBy("seq", cell("x").alias("px"), cell("y").alias("py")).agg(F.round(F.sum("n") / 625, 9).alias("pooled"))


@query(
    "resize_nearest_64",
    f"""{_ROI}, dst AS (SELECT unnest(range(64)) AS i), m AS (SELECT i, CASE WHEN i = 63 THEN 99 ELSE CAST(trunc(i * (99::DOUBLE / 63)) AS BIGINT) END AS src FROM dst)
    SELECT s.seq, s.idx, a.i AS row64, b.i AS col64, s.n FROM surf s JOIN m a ON a.src = s.y JOIN m b ON b.src = s.x""",
)
def resize_nearest_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = spark.range(64).select(F.col("id").alias("i"), F.when(F.col("id") == 63, 99).otherwise((F.col("id") * F.lit(99 / 63)).cast("int")).alias("src"))
    rows, cols = index.select(F.col("i").alias("row64"), F.col("src").alias("y")), index.select(F.col("i").alias("col64"), F.col("src").alias("x"))
    return _surface(spark, sf_dir).join(F.broadcast(rows), "y").join(F.broadcast(cols), "x").select("seq", "idx", "row64", "col64", "n")


@query(
    "event_expansion",
    f"""WITH {EVENTS_SQL}, b AS (SELECT seq, t_us // (7 * {DAY_US}) AS bin, count(*) AS n, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS wide, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS high, quantile_cont(t_us / 1e12, 0.5) AS t FROM ev GROUP BY 1, 2 HAVING count(*) >= 12)
    SELECT seq, count(*) AS bins, round(regr_slope(wide, t), 3) AS slope_x, round(regr_slope(high, t), 3) AS slope_y FROM b GROUP BY 1 HAVING count(*) >= 3""",
)
def event_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda c, p: F.percentile(c, F.lit(p))
    bins = events(spark, sf_dir).withColumn("t", F.col("t_us") / 1e12).groupBy("seq", F.floor(F.col("t_us") / (7 * DAY_US)).alias("bin")).agg(
        F.count("*").alias("n"), (q("x", 0.95) - q("x", 0.05)).alias("wide"), (q("y", 0.95) - q("y", 0.05)).alias("high"), q("t", 0.5).alias("t")
    )
    out = bins.where("n >= 12").groupBy("seq").agg(F.count("*").alias("bins"), F.round(F.regr_slope("wide", "t"), 3).alias("slope_x"), F.round(F.regr_slope("high", "t"), 3).alias("slope_y"))
    return out.where("bins >= 3")


@query("frame_delta_stats", f"WITH {TRACKS_SQL}, d AS (SELECT seq, ts - lag(ts) OVER (PARTITION BY seq ORDER BY label_id) AS d FROM tracks) SELECT seq, round(avg(d), 8) AS mean, round(min(d), 8) AS low, round(max(d), 8) AS high FROM d GROUP BY 1")
def frame_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("seq").orderBy("label_id")
    rows = tracks(spark, sf_dir).withColumn("d", F.col("ts") - F.lag("ts").over(w))
    return rows.groupBy("seq").agg(*[F.round(f("d"), 8).alias(n) for f, n in ((F.avg, "mean"), (F.min, "low"), (F.max, "high"))])
