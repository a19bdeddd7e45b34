"""Queries that sum up sequences and runs, split samples, and pick candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fn
from ..operators import looming, metrics, surface
from ..operators.quantiles import exact_quantiles
from ..sources.driver import DAY_US, EVENTS_SQL, GROUND_TRUTH_SQL, TRACKS_SQL, events, ground_truth, tracks
from ..sources.shared import written
from .evaluation import _FAMILY, _M, evaluated
from .features import _RATED, _SIGNS, rated
from .looming import _CANDIDATES, _V4
from .registry import query


@query(
    "boundary_summary",
    f"""{_M} SELECT {_FAMILY} AS family, count(*) AS n, round(avg(abs(pred - truth)), 5) AS mae, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.9), 4) AS p90,
    count(*) FILTER (error > 50) AS over50, count(*) FILTER (error > 100) AS over100 FROM m GROUP BY 1""",
)
def boundary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per status family all rows counted, errors over those that have one."""
    rows = evaluated(spark, sf_dir).withColumn("family", metrics.status_family(F.col("status"), F.col("truth")))
    return metrics.metric_summary(rows, ["family"])


@query(
    "reader_summary",
    f"""WITH {EVENTS_SQL}, {TRACKS_SQL}, {GROUND_TRUTH_SQL}, e AS (SELECT seq, count(DISTINCT t_us // {DAY_US}) AS intervals, count(*) AS events FROM ev GROUP BY 1), b AS (SELECT seq, count(*) AS labels FROM tracks GROUP BY 1), g AS (SELECT seq, count(*) AS truths FROM gt GROUP BY 1)
    SELECT seq, coalesce(intervals, 0) AS intervals, coalesce(events, 0) AS events, coalesce(labels, 0) AS labels, coalesce(truths, 0) AS truths FROM e FULL JOIN b USING (seq) FULL JOIN g USING (seq)""",
)
def reader_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each sequence over its tables, each aggregated before they meet."""
    ev = events(spark, sf_dir).groupBy("seq").agg(F.count_distinct(F.floor(F.col("t_us") / DAY_US)).alias("intervals"), F.count("*").alias("events"))
    boxes = tracks(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("labels"))
    truths = ground_truth(spark, sf_dir).groupBy("seq").agg(F.count("*").alias("truths"))
    return ev.join(boxes, "seq", "full").join(truths, "seq", "full").fillna(0, ["intervals", "events", "labels", "truths"])


SHARE, SEED = 0.2, 7


@query(
    "seeded_split",
    f"""WITH {TRACKS_SQL}, r AS (SELECT seq, label_id, row_number() OVER (PARTITION BY seq ORDER BY md5('{SEED}:' || seq || ':' || label_id), label_id) AS place, count(*) OVER (PARTITION BY seq) AS n FROM tracks)
    SELECT seq, label_id, n >= 2 AND place <= least(n - 1, greatest(1, round_even(n * {SHARE}::DOUBLE, 0))) AS held FROM r""",
)
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of each sequence's samples held back, chosen by a seeded hash."""
    return metrics.seeded_split(tracks(spark, sf_dir), "seq", "label_id", SHARE, SEED).select("seq", "label_id", "held")


@query(
    "nearest_candidate",
    f"""{_CANDIDATES}, q AS (SELECT seq, start, quantile_cont(ttc, 0.25) AS q25 FROM cands GROUP BY 1, 2)
    SELECT c.seq, c.start, back, ord AS cue, round(ttc, 5) AS ttc FROM cands c JOIN q ON q.seq = c.seq AND q.start = c.start QUALIFY row_number() OVER (PARTITION BY c.seq, c.start ORDER BY round(abs(ttc - q25), 9), back, ord) = 1""",
)
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate nearest to a sample's lower quartile; of equals the shortest window's, then the first cue's."""
    found = looming.with_stats(looming.with_candidates(looming.histories(tracks(spark, sf_dir), _V4), _V4)).where("n IS NOT NULL")
    best = F.array_min(F.transform("cands", lambda c: F.struct(F.round(F.abs(c["ttc"] - F.col("q25")), 9).alias("gap"), c["back"].alias("back"), c["ord"].alias("cue"), c["ttc"].alias("ttc"))))
    return found.select("seq", "start", best.alias("b")).select("seq", "start", F.col("b.back").cast("bigint").alias("back"), "b.cue", F.round("b.ttc", 5).alias("ttc"))


_GUARDS = {"smooth": "smooth >= s75", "sparse_fit": "max_fit <= f25", "events": "n <= n20", "collapse": "collapses > 0"}
_GUARDS["combined"] = " OR ".join(_GUARDS.values())


@query(
    "guard_policies",
    f"""{_RATED}, f AS (SELECT *, {_SIGNS}, starts_with(name, 'CPNA') AS low FROM rated), lim AS (SELECT quantile_cont(smooth, 0.75) AS s75, quantile_cont(max_fit, 0.25) AS f25, quantile_cont(n, 0.2) AS n20 FROM f WHERE low),
    u AS ({" UNION ALL ".join(f"SELECT '{g}' AS policy, low, error FROM f, lim WHERE kept AND NOT (low AND ({c}))" for g, c in _GUARDS.items())})
    SELECT policy, count(*) AS kept, round(avg(error), 4) AS mean, count(*) FILTER (low) AS low_kept, round(avg(error) FILTER (low), 4) AS low_mean FROM u GROUP BY 1""",
)
def guard_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows less those of low families that a guard rejects; limits are quantiles of the low families' rows, in a one-row table."""
    rows = rated(spark, sf_dir).select("n", "max_fit", "collapses", "error", F.col("name").startswith("CPNA").alias("low"), (F.col("pred") <= 3).alias("kept"), fn.abs_log_ratio(F.col("q75"), F.col("pred")).alias("smooth"))
    rows = written(rows, "guards")
    at = exact_quantiles(rows.where("low"), [], {"s75": ("smooth", 0.75), "f25": ("max_fit", 0.25), "n20": ("n", 0.2)}).withColumn("__one", F.lit(1))
    known = rows.where("kept").withColumn("__one", F.lit(1)).join(F.broadcast(at), "__one")
    each = F.array(*[F.struct(F.lit(g).alias("policy"), F.coalesce(F.expr(f"NOT (low AND ({c}))"), F.lit(False)).alias("stays")) for g, c in _GUARDS.items()])
    kept = known.select("low", "error", F.inline(each)).where("stays")
    return kept.groupBy("policy").agg(F.count("*").alias("kept"), F.round(F.avg("error"), 4).alias("mean"), F.count_if("low").alias("low_kept"), F.round(F.avg(F.when(F.col("low"), F.col("error"))), 4).alias("low_mean"))


#: Bins of a sequence's events, least events of one, and the unit of time.
BINS, LEAST, UNIT_US = 6, 3, 7 * DAY_US

_CUE_SQL = ", ".join(f"{{'cue': '{c}', 'slope': regr_slope({c}, age), 'size': regr_intercept({c}, age)}}" for c in ("r70", "r80", "r90", "w90", "h90"))


@query(
    "expansion_candidates",
    f"""WITH {EVENTS_SQL}, span AS (SELECT seq, min(t_us) AS lo, max(t_us) AS hi, seq % 20 + 0.5::DOUBLE AS x1, seq * 3 % 15 + 0.5::DOUBLE AS y1, seq % 20 + 75.2::DOUBLE AS x2, seq * 3 % 15 + 80.7::DOUBLE AS y2 FROM ev GROUP BY seq),
    i AS (SELECT e.seq, x, y, least({BINS - 1}, (t_us - lo) * {BINS} // greatest(1, hi - lo)) AS bin, sqrt((x - (x1 + x2) / 2) ** 2 + (y - (y1 + y2) / 2) ** 2) AS r, (t_us - hi) / {float(UNIT_US)}::DOUBLE AS age FROM ev e JOIN span s ON s.seq = e.seq WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2),
    b AS (SELECT seq, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY seq) AS all_n, quantile_cont(age, 0.5) AS age, quantile_cont(r, 0.7) AS r70, quantile_cont(r, 0.8) AS r80, quantile_cont(r, 0.9) AS r90, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS w90, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS h90 FROM i GROUP BY 1, 2),
    f AS (SELECT seq, count(*) AS bins, unnest([{_CUE_SQL}]) AS c FROM b WHERE all_n >= {BINS * LEAST} AND n >= {LEAST} GROUP BY 1 HAVING count(*) >= 3)
    SELECT seq, bins, c.cue AS cue, round(c.slope, 5) AS slope, round(c.size, 5) AS size, round(c.size / c.slope, 5) AS ttc FROM f WHERE c.slope > 1 AND c.size > 3 AND c.size / c.slope BETWEEN 0.05 AND 16""",
)
def expansion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, s = events(spark, sf_dir), F.col("seq")
    x1, y1 = s % 20, s * 3 % 15
    span = ev.groupBy("seq").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).withColumns({"x1": x1 + 0.5, "y1": y1 + 0.5, "x2": x1 + 75.2, "y2": y1 + 80.7})
    out = surface.expansion_candidates(ev.join(span, "seq"), BINS, LEAST, float(UNIT_US))
    return out.select("seq", "bins", "cue", *[F.round(c, 5).alias(c) for c in ("slope", "size", "ttc")])
