"""Queries on features, class ladders, policies and learned models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fn
from ..operators import gates, learning, looming, metrics, selector
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..sources import files
from ..sources.driver import TRACKS_SQL, observed, table, tracks
from ..sources.shared import written
from . import looming_sql as lsql
from .evaluation import _BUCKET, _FAMILY, _M, _sql, compared, evaluated, with_truth
from .looming import _CANDIDATES, _V4
from .registry import query

NAMES = ("CPNAO-low-50%", "CPNA-side-medium", "CPLA-high-100%", "CCRm-1", "CCRs-12-low", "other-0%", "CPNA-high")
_NAME = f"({list(NAMES)})[seq % {len(NAMES)} + 1]"
_PREFIX = "CASE " + " ".join(f"WHEN starts_with(name, '{p}') THEN '{p}'" for p in fn.PREFIXES) + " ELSE 'other' END"


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("seq") % len(NAMES) + 1).cast("int")))


@query(
    "sequence_metadata",
    f"""WITH n AS (SELECT s_suppkey AS seq, {_NAME.replace("seq", "s_suppkey")} AS name FROM supplier) SELECT seq, name, {_PREFIX} AS family, contains(name, 'side') AS has_side,
    CASE WHEN contains(name, 'low') THEN 0 WHEN contains(name, 'medium') THEN 1 WHEN contains(name, 'high') THEN 2 ELSE -1 END AS speed, coalesce(try_cast(regexp_extract(name, '(0|50|100)%', 1) AS DOUBLE) / 100, -1) AS visibility,
    coalesce(try_cast(regexp_extract(name, 'CCRs-(\\d+)', 1) AS DOUBLE), 0) AS repeat FROM n""",
)
def sequence_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    rows = named(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq")))
    return rows.select("seq", "name", fn.sequence_family(name).alias("family"), name.contains("side").alias("has_side"), fn.speed_level(name).alias("speed"), fn.visibility(name).alias("visibility"), fn.repeat_index(name).alias("repeat"))


@query(
    "debug_fit_points",
    f"WITH {TRACKS_SQL} SELECT seq, label_id, CASE WHEN label_id % 5 = 0 THEN NULL ELSE label_id END AS fit_points FROM tracks",
)
def debug_fit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    debug = F.concat(F.when(F.col("label_id") % 5 == 0, "points=").otherwise("fit_points="), "label_id", F.lit(";slope_px_per_s="), fn.format_number(F.col("w")))
    return tracks(spark, sf_dir).select("seq", "label_id", fn.fit_points(debug).cast("bigint").alias("fit_points"))


@query(
    "safe_casts",
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN ' 12.75 ' WHEN 3 THEN 'NaN' ELSE (o_orderkey / 4.0::DOUBLE)::VARCHAR END AS s FROM orders),
    v AS (SELECT id, CASE WHEN isfinite(try_cast(trim(s) AS DOUBLE)) THEN try_cast(trim(s) AS DOUBLE) END AS x FROM t)
    SELECT id, x AS number, trunc(x)::BIGINT AS whole, coalesce(printf('%.3f', x), '') AS shown FROM v""",
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "abc").when(k == 1, "").when(k == 2, " 12.75 ").when(k == 3, "NaN").otherwise((F.col("o_orderkey") / F.lit(4.0)).cast("string"))
    number = fn.as_number(text)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), number.alias("number"), fn.as_int(text).alias("whole"), fn.format_number(number, 3).alias("shown"))


@query("log_features", f"{_M} SELECT seq, start, round(CASE WHEN pred > 0 THEN ln(pred) END, 6) AS pred, (pred IS NULL)::INT AS pred_missing, round(CASE WHEN truth > 0 THEN ln(truth) END, 6) AS truth, (truth IS NULL)::INT AS truth_missing FROM m")
def log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for n in ("pred", "truth") for c in (F.round(fn.positive_log(F.col(n)), 6).alias(n), F.col(n).isNull().cast("int").alias(f"{n}_missing"))]
    return evaluated(spark, sf_dir).select("seq", "start", *columns)


_FAMILIES = ("HIGH_CONF_Q25", "LOWCAND", "LOWFIT", "DISP")


@query("status_interactions", f"{_M}, f AS (SELECT *, {_FAMILY} AS family FROM m) SELECT seq, start, " + ", ".join(f"CASE WHEN family = '{x}' THEN round(coalesce({c}, 0), 5) ELSE 0 END AS {x.lower()}_{c}" for x in _FAMILIES for c in ("pred", "truth")) + " FROM f")
def status_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluated(spark, sf_dir).withColumn("family", metrics.status_family(F.col("status"), F.col("truth")))
    return df.select("seq", "start", *[F.when(F.col("family") == x, F.round(F.coalesce(c, F.lit(0.0)), 5)).otherwise(0.0).alias(f"{x.lower()}_{c}") for x in _FAMILIES for c in ("pred", "truth")])


QUANTILES = (5, 10, 15, 25, 35, 50, 65, 75)
_Q = "q AS (SELECT seq, start, count(*) AS n, max(fit_points) AS max_fit, " + ", ".join(f"quantile_cont(ttc, {k / 100}) AS q{k}" for k in QUANTILES) + f" FROM ({_CANDIDATES} SELECT * FROM cands) GROUP BY 1, 2)"
_SEEN = ("n_rows", "n_kept", "ratio", "spread AS pred_spread", "iqr AS pred_iqr")
_RATED = f"""{_sql(13)}, {_Q}, seen AS (SELECT seq, start, (n_rows - n_kept)::BIGINT AS collapses, ratio, pred_spread, area / before AS ratio_prev FROM ({lsql.estimate(looming.VARIANTS[13], _SEEN)}) e
  JOIN (WITH {TRACKS_SQL} SELECT seq, label_id AS start, area, lag(area) OVER (PARTITION BY seq ORDER BY label_id) AS before FROM tracks) USING (seq, start)),
rated AS (SELECT m.seq, m.start, m.status, m.pred, m.truth, m.error, m.fold, q.* EXCLUDE (seq, start), collapses, ratio, pred_spread, ratio_prev, {_FAMILY} AS family, {_NAME.replace('seq', 'm.seq')} AS name FROM m JOIN q ON q.seq = m.seq AND q.start = m.start JOIN seen ON seen.seq = m.seq AND seen.start = m.start WHERE pred IS NOT NULL AND truth IS NOT NULL)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of the last variant that have truth, with candidate quantiles, family,
    name, and what the ladders read: collapses (boxes the history guard drops), ratio
    (area over the median of five before), ratio_prev (over the one before), pred_spread."""
    rows = _with_candidates(spark, sf_dir, "pred IS NOT NULL AND n IS NOT NULL").where("truth IS NOT NULL")
    return named(rows.withColumn("family", metrics.status_family(F.col("status"), F.col("truth"))))


def _with_candidates(spark: SparkSession, sf_dir: str, wanted: str = "true") -> DataFrame:
    """All wanted estimates of the last variant beside truth, where it is known."""
    boxes, series = observed(spark, sf_dir)
    v = looming.VARIANTS[13]
    # Both variants' lines run through the same boxes, the guards' aside; an estimate has two boxes at least, so the one before is among them.
    rows = looming.judged(looming.fitted(boxes, [v], more={f"q{k}": k / 100 for k in QUANTILES}), v)
    plain = [F.col(f"a_{c}").alias(c) for c in ("n", "max_fit", *[f"q{k}" for k in QUANTILES])]
    rows = rows.select("seq", "start", "query_t", "status", F.col("ttc").alias("pred"), *plain, (F.col("n_rows") - F.col("n_kept")).cast("bigint").alias("collapses"), "ratio", F.col("spread").alias("pred_spread"), "ratio_prev")
    return compared(with_truth(rows.where(wanted), series))


@query("quantile_relatives", f"{_RATED} SELECT seq, start, round(ln(q10 / pred), 5) AS rel10, round(ln(q50 / pred), 5) AS rel50, round(ln(q50), 5) AS log50, round(ln(q25 / q10), 5) AS spread10_25, round(abs(ln(greatest(q75, 1e-9)) - ln(greatest(pred, 1e-9))), 5) AS gap75 FROM rated")
def quantile_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = {"rel10": F.log(F.col("q10") / F.col("pred")), "rel50": F.log(F.col("q50") / F.col("pred")), "log50": F.log("q50"), "spread10_25": F.log(F.col("q25") / F.col("q10")), "gap75": fn.abs_log_ratio(F.col("q75"), F.col("pred"))}
    return rated(spark, sf_dir).select("seq", "start", *[F.round(c, 5).alias(n) for n, c in show.items()])


@query("best_quantile_labels", f"{_RATED}, e AS (SELECT seq, start, unnest({list(QUANTILES)}) AS k, unnest([round(abs(q{' - truth), 9), round(abs(q'.join(map(str, QUANTILES))} - truth), 9)]) AS gap FROM rated) SELECT k AS quantile, count(*) AS n FROM (SELECT seq, start, k FROM e QUALIFY row_number() OVER (PARTITION BY seq, start ORDER BY gap, k) = 1) GROUP BY 1")
def best_quantile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = F.array(*[F.round(F.abs(F.col(f"q{k}") - F.col("truth")), 9) for k in QUANTILES])
    best = F.get(F.array(*[F.lit(k) for k in QUANTILES]), (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))
    return rated(spark, sf_dir).groupBy(best.alias("quantile")).agg(F.count("*").alias("n"))


def _policy_sql(name: str) -> str:
    picks, rest = fn.POLICIES[name]
    return "CASE family " + " ".join(f"WHEN '{f}' THEN q{q}" for f, q in picks.items()) + f" ELSE q{rest} END"


_LONG = f"{_RATED}, long AS (" + " UNION ALL ".join(f"SELECT seq, start, truth, '{p}' AS policy, {_policy_sql(p)} AS raw FROM rated" for p in fn.POLICIES) + "), judged AS (SELECT *, greatest(0.05, least(25, raw)) AS guess, abs(greatest(0.05, least(25, raw)) - truth) / truth * 100 AS error FROM long WHERE raw > 0 AND truth > 0)"


def long_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row and policy, read once: policies as an exploded array."""
    q = {k: F.col(f"q{k}") for k in QUANTILES}
    each = F.array(*[F.struct(F.lit(p).alias("policy"), fn.policy(p, F.col("family"), q).alias("raw")) for p in fn.POLICIES])
    rows = rated(spark, sf_dir).withColumn("p", F.explode(each)).select("seq", "start", "truth", "p.policy", "p.raw").where("raw > 0 AND truth > 0")
    rows = rows.withColumn("guess", F.greatest(F.lit(fn.LOW_TTC), F.least(F.lit(fn.HIGH_TTC), F.col("raw"))))
    return rows.withColumn("error", metrics.error_pct(F.col("guess"), F.col("truth")))


@query("policy_summary", f"{_LONG} SELECT policy, count(*) AS n, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.9), 4) AS p90, count(*) FILTER (error > 50) AS over50, count(*) FILTER (error > 100) AS over100 FROM judged GROUP BY 1")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_summary(long_policies(spark, sf_dir), ["policy"])


@query("best_policy", f"{_LONG}, s AS (SELECT policy, round(avg(error), 4) AS mean FROM judged GROUP BY 1) SELECT policy, mean FROM s ORDER BY mean, policy LIMIT 1")
def best_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_policies(spark, sf_dir).groupBy("policy").agg(F.round(F.avg("error"), 4).alias("mean")).orderBy("mean", "policy").limit(1)


_EARLY = "CASE WHEN frac <= 0.33 THEN q{0} WHEN frac >= 0.67 THEN q10 ELSE q25 END"
_GROWS = "CASE WHEN frac <= 0.35 AND growth >= 1.35 THEN q{0} WHEN frac >= 0.60 AND growth BETWEEN 0.80 AND 1.30 THEN q10 ELSE q25 END"
_RULES = {"all_q10": "q10", "all_q25": "q25", "all_q50": "q50", **{f"phase_early_q{k}_late_q10": _EARLY.format(k) for k in (50, 65)}, **{f"area_phase_q{k}_q10": _GROWS.format(k) for k in (50, 65)}}


@query(
    "hand_rules",
    f"""{_RATED}, tracks2 AS (WITH {TRACKS_SQL}, {lsql.SAMPLES} SELECT s.seq, s.start, s.frac, a.growth FROM samples s JOIN (SELECT seq, label_id, round(area / quantile_cont(area, 0.5) OVER (PARTITION BY seq ORDER BY label_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS growth FROM tracks) a ON a.seq = s.seq AND a.label_id = s.start),
    r AS (SELECT rated.*, frac, growth FROM rated JOIN tracks2 USING (seq, start)), u AS ({" UNION ALL ".join(f"SELECT '{n}' AS rule, {e} AS guess, truth FROM r" for n, e in _RULES.items())})
    SELECT rule, count(*) AS n, round(avg(abs(guess - truth) / truth * 100), 4) AS mean, count(*) FILTER (abs(guess - truth) / truth * 100 >= 50) AS high FROM u WHERE truth > 0 GROUP BY 1""",
)
def hand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = tracks(spark, sf_dir)
    w = Window.partitionBy("seq").orderBy("label_id").rowsBetween(-5, -1)
    growth = boxes.select("seq", F.col("label_id").alias("start"), F.round(F.col("area") / F.percentile("area", F.lit(0.5)).over(w), 6).alias("growth"))
    rows = rated(spark, sf_dir).join(looming.sample_frame(boxes).select("seq", "start", "frac"), ["seq", "start"]).join(growth, ["seq", "start"]).where("truth > 0")
    rules = fn.phase_rules(F.col("frac"), F.col("growth"), {k: F.col(f"q{k}") for k in QUANTILES})
    rows = rows.withColumn("r", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("guess")) for n, c in rules.items()]))).select("r.*", "truth")
    error = metrics.error_pct(F.col("guess"), F.col("truth"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.round(F.avg(error), 4).alias("mean"), F.count_if(error >= 50).alias("high"))


_SIGNS = "abs(ln(q75) - ln(pred)) AS smooth, abs(ln(q50) - ln(pred)) AS models, (q75 - q25) / greatest(abs(q50), 1e-6) AS iqr, pred <= 3 AS kept"
_AT = {"events": ("n", 0.2), "iqr": ("iqr", 0.8), "models": ("models", 0.8), "smooth": ("smooth", 0.8), "points": ("max_fit", 0.2)}


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated rows, written, with what the class ladders read."""
    return written(rated(spark, sf_dir), "rated").withColumns({
        "smooth": fn.abs_log_ratio(F.col("q75"), F.col("pred")), "models": fn.abs_log_ratio(F.col("q50"), F.col("pred")), "iqr": (F.col("q75") - F.col("q25")) / F.greatest(F.abs("q50"), F.lit(1e-6)),
        "kept": F.col("pred") <= 3,
    })


@query(
    "observability_taxonomy",
    f"""{_RATED}, f AS (SELECT *, {_SIGNS}, starts_with(name, 'CPNA') AS low FROM rated), lim AS (SELECT {", ".join(f"quantile_cont({c}, {q}) AS at_{n}" for n, (c, q) in _AT.items())} FROM f),
    k AS (SELECT {_PREFIX} AS family, error, kept, CASE WHEN NOT kept THEN CASE WHEN low AND n <= at_events THEN 'rejected_low_event_observability' WHEN collapses > 0 THEN 'rejected_bbox_collapse_history' WHEN iqr >= at_iqr THEN 'rejected_candidate_disagreement' WHEN models >= at_models THEN 'rejected_model_disagreement' WHEN smooth >= at_smooth THEN 'rejected_smoothing_disagreement' WHEN low THEN 'rejected_low_observability_family' ELSE 'rejected_general_confidence' END
      WHEN error >= 15 THEN CASE WHEN low AND max_fit <= at_points THEN 'kept_high_error_sparse_fit' WHEN smooth >= at_smooth THEN 'kept_high_error_smoothing_bias' WHEN low THEN 'kept_high_error_low_observability_family' ELSE 'kept_high_error_model_residual' END
      WHEN error >= 7 THEN CASE WHEN low THEN 'kept_moderate_error_low_observability_family' ELSE 'kept_moderate_error' END ELSE 'kept_good' END AS taxonomy FROM f, lim)
    SELECT family, taxonomy, count(*) AS n, round(avg(CASE WHEN kept THEN error END), 4) AS kept_error FROM k GROUP BY 1, 2""",
)
def observability_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signs(spark, sf_dir)
    at = exact_quantiles(df, [], _AT).first().asDict()
    df = df.withColumn("prefix", fn.sequence_family(F.col("name")))
    c = fn.observability_class(F.col("kept"), F.col("prefix").isin(*fn.LOW_OBSERVABILITY), *[F.col(x) for x in ("error", "iqr", "models", "smooth", "n", "max_fit", "collapses")], {n: F.lit(v) for n, v in at.items()})
    return df.groupBy(F.col("prefix").alias("family"), c.alias("taxonomy")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("kept"), F.col("error"))), 4).alias("kept_error"))


@query(
    "boundary_taxonomy",
    f"""{_RATED}, f AS (SELECT *, {_SIGNS} FROM rated), lim AS (SELECT quantile_cont(n, 0.25) AS few, quantile_cont(models, 0.8) AS wide FROM f),
    k AS (SELECT seq, error, kept, CASE WHEN family IN ('CURGUARD', 'HISTGUARD') OR collapses > 0 OR ratio_prev < 0.25 THEN 'bbox_collapse_or_guard' WHEN n < 8 OR max_fit < 3 THEN 'low_candidate_support' WHEN iqr >= 0.55 OR pred_spread >= 1.20 THEN 'candidate_disagreement' WHEN models >= wide THEN 'model_disagreement' WHEN n <= few THEN 'low_event_observability'
      WHEN family = 'PHASESTABLE' OR ratio <= 1.05 THEN 'stable_low_growth' WHEN family IN ('PHASEEARLY', 'PHASEGROWTH', 'PHASELATE') THEN 'phase_specific_geometry' ELSE 'other_geometry_residual' END AS taxonomy FROM f, lim)
    SELECT kept, taxonomy, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY kept))::DOUBLE, 6) AS share, count(DISTINCT seq) AS sequences, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.5), 4) AS median FROM k GROUP BY 1, 2""",
)
def boundary_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signs(spark, sf_dir)
    at = exact_quantiles(df, [], {"few": ("n", 0.25), "wide": ("models", 0.8)}).first()
    c = fn.boundary_class(F.col("family"), F.col("n"), F.col("max_fit"), F.col("iqr"), F.col("pred_spread"), F.col("n"), F.col("collapses"), F.col("ratio_prev"), F.col("ratio"), F.col("models"), F.lit(at["few"]), F.lit(at["wide"]))
    out = df.groupBy("kept", c.alias("taxonomy")).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("sequences"), F.round(F.avg("error"), 4).alias("mean"))
    out = with_quantiles(out, df.select("kept", c.alias("taxonomy"), "error"), ["kept", "taxonomy"], {"median": ("error", 0.5)}).withColumn("median", F.round("median", 4))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kept")), 6))


@query("flag_counts", f"{_M}, x AS (SELECT fold, unnest(string_split({_FAMILY} || '|' || {_BUCKET}, '|')) AS flag FROM m) SELECT coalesce(fold::VARCHAR, 'ALL') AS fold, flag, count(*) AS n FROM x GROUP BY GROUPING SETS ((fold, flag), (flag))")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.concat_ws("|", metrics.status_family(F.col("status"), F.col("truth")), metrics.truth_bucket(F.col("truth")))
    rows = evaluated(spark, sf_dir).select(F.array(F.lit("ALL"), F.col("fold").cast("string")).alias("folds"), F.explode(F.split(flags, r"\|")).alias("flag"))
    return rows.groupBy("folds", "flag").agg(F.count("*").alias("n")).select(F.explode("folds").alias("fold"), "flag", "n").groupBy("fold", "flag").agg(F.sum("n").alias("n"))


@query("global_median_impute", f"{_RATED}, u AS (SELECT unnest([q10, q25, q50, CASE WHEN n >= 40 THEN q75 END]) AS v FROM rated), g AS (SELECT median(v) AS v FROM u) SELECT seq, start, round(coalesce(CASE WHEN n >= 40 THEN q75 END, g.v), 5) AS q75 FROM rated, g")
def global_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = written(rated(spark, sf_dir).select("seq", "start", "q10", "q25", "q50", F.when(F.col("n") >= 40, F.col("q75")).alias("q75")), "impute")
    middle = exact_quantiles(df.select(F.explode(F.array("q10", "q25", "q50", "q75")).alias("v")), [], {"v": ("v", 0.5)}).first()["v"]
    return df.select("seq", "start", F.round(F.coalesce("q75", F.lit(middle)), 5).alias("q75"))


@query("coverage_metrics", f"{_RATED}, v AS (SELECT (SELECT count(*) FROM m WHERE truth IS NOT NULL) AS with_truth, (SELECT count(*) FROM rated) AS valid) SELECT name, count(*) FILTER (pred <= 3) AS kept, round(count(*) FILTER (pred <= 3) / any_value(valid)::DOUBLE, 6) AS of_valid, round(count(*) FILTER (pred <= 3) / any_value(with_truth)::DOUBLE, 6) AS of_truth FROM rated, v GROUP BY 1")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("pred").isNotNull() & F.col("n").isNotNull()
    rows = named(_with_candidates(spark, sf_dir)).where("truth IS NOT NULL")
    out = rows.groupBy("name").agg(F.count_if(known & (F.col("pred") <= 3)).alias("kept"), F.count_if(known).alias("n"), F.count("*").alias("with_truth"))
    of = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  one row a name
    out = out.select("name", "kept", "n", F.round(F.col("kept") / of("n"), 6).alias("of_valid"), F.round(F.col("kept") / of("with_truth"), 6).alias("of_truth"))
    return out.where("n > 0").drop("n")


@query(
    "ridge_loso",
    f"""{_M}, d AS (SELECT fold, ln(pred) AS x, ln(truth) AS y FROM m WHERE pred > 0 AND truth > 0), f AS (SELECT DISTINCT fold FROM d),
    s AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS cxy, stddev_pop(x) AS sd FROM f JOIN d ON d.fold <> f.fold GROUP BY 1)
    SELECT fold, n, round(my - n * cxy / sd / (n + 10) / sd * mx, 6) AS intercept, round(n * cxy / sd / (n + 10) / sd, 6) AS slope FROM s""",
)
def ridge_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).where("pred > 0 AND truth > 0").select("fold", F.log("pred").alias("x"), F.log("truth").alias("y"))
    found = learning.ridge_loso(rows, ["x"], "y", 10.0)
    return found.select("fold", "n", F.round("intercept", 6).alias("intercept"), F.round(F.get("coefficients", F.lit(0)), 6).alias("slope"))


@query("ridge_predictions")
def ridge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of ln truth from three features; no SQL inverts the matrix, tests compare with numpy."""
    rows = rated(spark, sf_dir).where("pred > 0 AND truth > 0").withColumns({"x0": F.log("pred"), "x1": F.log("q50"), "x2": F.col("n"), "y": F.log("truth")})
    rows = written(rows.select("seq", "start", "fold", "x0", "x1", "x2", "y", "truth"), "ridge")
    out = learning.predicted(rows, learning.ridge_loso(rows, ["x0", "x1", "x2"], "y", 10.0), ["x0", "x1", "x2"])
    guess = fn.clipped_exp(F.col("fitted"))
    return out.select("seq", "start", F.round(guess, 4).alias("guess"), F.round(metrics.error_pct(guess, F.col("truth")), 3).alias("error"))


#: The last bounds exclude nothing.
PAIR = ([1.0137 + k for k in range(12)] + [1e9], [0.1037 + 0.15 * k for k in range(12)] + [1e9])


@query(
    "gate_2f_loso",
    f"""{_RATED}, f AS (SELECT *, {_SIGNS} FROM rated), a AS (SELECT unnest({PAIR[0]}) AS a), b AS (SELECT unnest({PAIR[1]}) AS b),
    k AS (SELECT fold, a, b, count(*) AS n, sum(error) AS e FROM f JOIN a ON pred <= a JOIN b ON iqr <= b WHERE error IS NOT NULL GROUP BY 1, 2, 3),
    d AS (SELECT g.fold, a.a, b.b, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM (SELECT DISTINCT fold FROM f) g CROSS JOIN a CROSS JOIN b LEFT JOIN k ON k.fold = g.fold AND k.a = a.a AND k.b = b.b),
    t AS (SELECT *, (sum(n) OVER (PARTITION BY a, b) - n)::BIGINT AS train_n, sum(e) OVER (PARTITION BY a, b) - e AS train_e FROM d)
    SELECT fold, round(a, 4) AS pred, round(b, 4) AS iqr, train_n, round(train_e / train_n, 4) AS mean, n AS kept FROM t WHERE train_n >= 100
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train_e / train_n <= 90 DESC, CASE WHEN train_e / train_n <= 90 THEN -train_n END, CASE WHEN train_e / train_n > 90 THEN train_e / train_n END, a, b) = 1""",
)
def gate_2f_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = signs(spark, sf_dir)
    found = learning.pair_gate(df, "pred", "iqr", *PAIR, 90.0, 100)
    return found.select("fold", F.round("pred", 4).alias("pred"), F.round("iqr", 4).alias("iqr"), "train_n", F.round("mean", 4).alias("mean"), "kept")


#: Thresholds of the gates on several features: these quantiles of the training rows.
PAIR_SHARES, TRIPLE_SHARES = [j / 12 for j in range(1, 13)], [j / 8 for j in range(1, 9)]


def _gate_sql(features: list[str], shares: list[float], target: float) -> str:
    d, k = range(len(features)), len(shares)
    places = ", ".join(f"c{i}" for i in d)
    order = ", ".join(f"p.c{i}" for i in ([2, 0, 1] if len(features) > 2 else d))
    return f"""{_RATED}, u AS (SELECT fold, error, {", ".join(f"{f} AS x{i}" for i, f in enumerate(features))} FROM (SELECT *, {_SIGNS} FROM rated) WHERE error IS NOT NULL AND {" AND ".join(f"{f} IS NOT NULL" for f in features)}),
    th AS (SELECT f.fold, {", ".join(f"quantile_cont(x{i}, {shares}) AS t{i}" for i in d)} FROM (SELECT DISTINCT fold FROM u) f JOIN u ON u.fold <> f.fold GROUP BY f.fold),
    b AS (SELECT th.fold, u.fold = th.fold AS own, error, {", ".join(f"len(list_filter(t{i}, lambda t: t < x{i})) AS c{i}" for i in d)} FROM th, u),
    c AS (SELECT fold, {places}, count(*) FILTER (NOT own) AS n, coalesce(sum(error) FILTER (NOT own), 0) AS e, count(*) FILTER (own) AS o FROM b WHERE {" AND ".join(f"c{i} < {k}" for i in d)} GROUP BY ALL),
    p AS (SELECT * FROM {", ".join(f"range({k}) r{i}(c{i})" for i in d)}),
    s AS (SELECT c.fold, {", ".join(f"p.c{i}" for i in d)}, sum(n)::BIGINT AS train_n, sum(e) / sum(n) AS mean, sum(o)::BIGINT AS kept FROM c JOIN p ON {" AND ".join(f"c.c{i} <= p.c{i}" for i in d)} GROUP BY ALL),
    best AS (SELECT * FROM s p WHERE train_n >= 100 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(mean, 9) <= {target} DESC, CASE WHEN round(mean, 9) <= {target} THEN -train_n END, CASE WHEN round(mean, 9) > {target} THEN round(mean, 9) END, {order}) = 1)
    SELECT fold, {", ".join(f"round(t{i}[c{i} + 1], 4) AS {f}" for i, f in enumerate(features))}, train_n, round(mean, 4) AS mean, kept FROM best JOIN th USING (fold)"""


def _gate(spark: SparkSession, sf_dir: str, features: list[str], shares: list[float], target: float) -> DataFrame:
    found = gates.feature_gate(signs(spark, sf_dir), features, shares, target, 100)
    return found.select("fold", *[F.round(f, 4).alias(f) for f in features], "train_n", F.round("mean", 4).alias("mean"), "kept")


@query("gate_2f_quantiles", _gate_sql(["iqr", "models"], PAIR_SHARES, 60.0))
def gate_2f_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir, ["iqr", "models"], PAIR_SHARES, 60.0)


@query("gate_3f_loso", _gate_sql(["iqr", "models", "smooth"], TRIPLE_SHARES, 60.0))
def gate_3f_loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on candidate spread, model and smoothing disagreement, each sequence's from the others' quantiles."""
    return _gate(spark, sf_dir, ["iqr", "models", "smooth"], TRIPLE_SHARES, 60.0)


@query("softmax_selector")
def softmax_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each held-out sequence's candidate quantile, chosen by softmax regression on the others; no SQL descends gradients, tests compare with numpy."""
    gaps = F.array(*[F.round(F.abs(F.col(f"q{k}") - F.col("truth")), 9) for k in QUANTILES])
    rows = rated(spark, sf_dir).where("pred > 0 AND truth > 0").withColumns({"x0": F.log("pred"), "x1": F.log(F.col("q50") / F.col("pred")), "x2": F.log1p("n"), "x3": F.log(F.col("q75") / F.col("q10")), "label": (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"), "picks": F.array(*[F.col(f"q{k}") for k in QUANTILES])})
    rows = written(rows.select("seq", "start", "fold", "truth", "label", "picks", "x0", "x1", "x2", "x3"), "softmax-rows")
    features = ["x0", "x1", "x2", "x3"]
    model = selector.softmax_fit(rows, features, "label", len(QUANTILES), 15, 0.5, 1e-3)
    pick = F.get("picks", F.col("chosen"))
    return selector.softmax_predict(rows, model).select("seq", "start", F.get(F.array(*[F.lit(k) for k in QUANTILES]), F.col("chosen")).alias("quantile"), F.round(pick, 5).alias("guess"), F.round(metrics.error_pct(pick, F.col("truth")), 3).alias("error"))


@query("boosted_predictions")
def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of ln truth by boosted trees under the huber loss, each family of sequences held out; tests compare with plain growing."""
    rows = rated(spark, sf_dir).where("pred > 0 AND truth > 0").withColumns({"held": fn.sequence_family(F.col("name")), "x0": F.log("pred"), "x1": F.log("q10"), "x2": F.log("q50"), "x3": F.log("q75"), "x4": F.col("n").cast("double"), "x5": F.col("ratio"), "y": F.log("truth")})
    features = [f"x{k}" for k in range(6)]
    rows = written(rows.select("seq", "start", "held", "truth", "y", *features), "boosted-rows")
    model = selector.boosted_fit(rows, features, "y", "huber", 8, 3, 0.3, group="held")
    guess = fn.clipped_exp(F.col("fitted"))
    return selector.boosted_predict(rows, model).select("seq", "start", "held", F.round(guess, 4).alias("guess"), F.round(metrics.error_pct(guess, F.col("truth")), 3).alias("error"))


@query("mask_algebra", f"{_RATED} SELECT seq, start FROM rated WHERE (NOT (n < 30) AND NOT starts_with(name, 'CPNA')) OR (starts_with(name, 'CPNA') AND pred <= 3)")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base and not reject, outside the low families) or (low and kept): row sets as boolean columns."""
    low, reject = F.col("name").startswith("CPNA"), F.col("n") < 30
    union = reduce(lambda a, b: a | b, [~reject & ~low, low & (F.col("pred") <= 3)])
    return rated(spark, sf_dir).where(union).select("seq", "start")


@query("worst_intervals", f"{_M} SELECT seq, start, round(error, 4) AS error FROM m WHERE error IS NOT NULL ORDER BY round(error, 4) DESC, seq, start LIMIT 80")
def worst_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluated(spark, sf_dir).where("error IS NOT NULL").select("seq", "start", F.round("error", 4).alias("error"))
    return rows.orderBy(F.desc("error"), "seq", "start").limit(80)


@query("sample_iteration", f"WITH {TRACKS_SQL} SELECT seq, label_id FROM tracks WHERE label_id >= 10 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY label_id) <= 5")
def sample_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.samples(tracks(spark, sf_dir), 10, 5, idx="label_id").select("seq", "label_id")


@query("keyed_last", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def keyed_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.keyed_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@query("manifest_match", f"{_M}, s AS (SELECT fold, count(error) AS n, avg(error) AS mean FROM m GROUP BY 1), w AS (SELECT fold AS row, n, round(mean, 2) AS mean FROM s) SELECT w.row, min(s.fold) AS found FROM w LEFT JOIN s ON s.n = w.n AND abs(s.mean - w.mean) <= 0.01 GROUP BY 1")
def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published rows with the first record of equal count whose mean lies within the tolerance."""
    s = evaluated(spark, sf_dir).groupBy("fold").agg(F.count("error").alias("n"), F.avg("error").alias("mean"))
    w = s.select(F.col("fold").alias("row"), F.col("n").alias("rows"), F.round("mean", 2).alias("published"))
    return w.join(s, (F.col("rows") == F.col("n")) & (F.abs(F.col("mean") - F.col("published")) <= 0.01), "left").groupBy("row").agg(F.min("fold").alias("found"))


@query("next_label", f"WITH {TRACKS_SQL} SELECT a.seq, a.label_id, round(b.area / a.area, 6) AS growth FROM tracks a LEFT JOIN tracks b ON b.seq = a.seq AND b.label_id = a.label_id + 1")
def next_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    following = t.select("seq", (F.col("label_id") - 1).alias("label_id"), F.col("area").alias("after"))
    return t.join(following, ["seq", "label_id"], "left").select("seq", "label_id", F.round(F.col("after") / F.col("area"), 6).alias("growth"))
