"""Queries on run records, cue selectors, family gates, previews and nested summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fn
from ..operators import gates, looming, metrics
from ..operators import surface as ops
from ..operators.joins import asof_interpolate, interval_join
from ..sources.driver import DAY_US, GROUND_TRUTH_SQL, events, intervals, observed, tracks
from ..sources.shared import written
from . import looming_sql as sql
from .cues import _CUES, _FALL, predicted
from .evaluation import _FAMILY, _M, _sql, evaluated, with_truth
from .events import _BASE, TAU_US, _confidence, _regions, _surface
from .features import _RATED, _SIGNS, QUANTILES, TRIPLE_SHARES, rated, signs
from .quality import _V1
from .registry import query

_V2 = looming.VARIANTS[2]
_SELECTED = "SELECT seq, start, status, round(ttc, 5) AS ttc, fit_points, round(ln(ref), 6) AS log_ref, round(residual, 7) AS residual, round(rel_slope, 6) AS rel_slope FROM selected"


def _selected(spark: SparkSession, sf_dir: str, selector: str) -> DataFrame:
    rows = looming.with_selected(looming.with_candidates(looming.histories(tracks(spark, sf_dir), _V2), _V2), selector)
    return rows.select("seq", "start", "status", F.round("ttc", 5).alias("ttc"), "fit_points", F.round(F.log("ref"), 6).alias("log_ref"), F.round("residual", 7).alias("residual"), F.round("rel_slope", 6).alias("rel_slope"))


@query("cue_lowest_residual", f"{sql.selected(_V2, 'lowest_residual')} {_SELECTED}")
def cue_lowest_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue whose line fits best, over its size."""
    return _selected(spark, sf_dir, "lowest_residual")


@query("cue_residual_score", f"{sql.selected(_V2, 'score_rel_slope_over_resid')} {_SELECTED}")
def cue_residual_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue that grows most for what its line misses."""
    return _selected(spark, sf_dir, "score_rel_slope_over_resid")


@query("cue_width", f"{sql.selected(_V2, 'width')} {_SELECTED}")
def cue_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width's line, told apart from there being no line at all."""
    return _selected(spark, sf_dir, "width")


_V13 = looming.VARIANTS[13]
_RECORDS = f"""WITH o AS ({sql.nearest(_V13)}), g AS (WITH {GROUND_TRUTH_SQL} SELECT q.seq, start, CASE WHEN p IS NULL THEN v ELSE pv + (ts - p) / (t - p) * (v - pv) END AS truth FROM (SELECT seq, start, start * 0.1::DOUBLE AS ts FROM o) q LEFT JOIN seg ON seg.seq = q.seq AND ts <= t AND (ts > p OR p IS NULL AND ts = t)),
e AS ({_CUES}, {_FALL}, {_V1}, gc AS (SELECT seq, idx, coalesce(sum(conf * greatest(events, 1) * active) / nullif(sum(greatest(events, 1) * active), 0), 0) AS confidence FROM conf GROUP BY 1, 2)
  SELECT r.seq, r.idx, row_number() OVER (PARTITION BY r.seq ORDER BY r.idx) - 1 AS start, v1.ttc AS fallback, v1.status AS fell, confidence AS sure FROM regions r JOIN v1 ON v1.seq = r.seq AND v1.idx = r.idx JOIN gc ON gc.seq = r.seq AND gc.idx = r.idx),
rec AS (SELECT o.seq, o.start, CASE WHEN truth IS NULL THEN 'GT_INVALID' WHEN ttc IS NOT NULL THEN status WHEN fallback IS NOT NULL AND starts_with(fell, 'OK') THEN 'OK_LTS_FALLBACK' ELSE coalesce(fell, status) END AS status, CASE WHEN truth IS NOT NULL THEN coalesce(ttc, fallback) END AS ttc, truth,
  CASE WHEN truth IS NULL THEN NULL WHEN ttc IS NOT NULL THEN least(1, fit_points / 13.0::DOUBLE) ELSE sure END AS confidence, CASE WHEN truth IS NOT NULL AND ttc IS NULL THEN fallback END AS fallback_ttc,
  CASE WHEN truth IS NULL THEN '' WHEN ttc IS NOT NULL THEN 'fit_points=' || fit_points WHEN fell IS NOT NULL THEN 'bbox_status=' || status || ';fallback_status=' || fell ELSE 'fit_points=' || n_rows END AS debug, CASE WHEN truth IS NOT NULL THEN slope END AS slope, CASE WHEN truth IS NOT NULL THEN ref END AS ref
  FROM o JOIN g ON g.seq = o.seq AND g.start = o.start LEFT JOIN e ON e.seq = o.seq AND e.start = o.start)"""


def _place() -> Column:
    return (F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1).cast("bigint")


def records(spark: SparkSession, sf_dir: str, spans: DataFrame) -> DataFrame:
    """The last variant's records, the event predictor of the interval (of ``spans``) at the same place in the sequence behind it.

    Each part is written before the next is planned, so that the driver holds one part's plan at a time.
    """
    fell = predicted(spark, sf_dir, spans).select("seq", _place().alias("start"), F.col("ttc").alias("fallback"), F.col("status").alias("fell"), F.col("confidence").alias("fell_confidence"))
    fell = written(fell, "fell")
    boxes, series = observed(spark, sf_dir)
    rows = looming.estimated(boxes, _V13, chosen=True).select("seq", "start", "query_t", "status", "ttc", "n_rows", "fit_points", "slope", "ref")
    return looming.records(with_truth(rows, series).join(fell, ["seq", "start"], "left"), _V13.back)


@query(
    "looming_records",
    f"{_RECORDS} SELECT seq, start, status, round(ttc, 4) AS ttc, round(CASE WHEN truth > 0 THEN abs(ttc - truth) / truth * 100 END, 3) AS error_pct, round(confidence, 6) AS confidence, round(fallback_ttc, 4) AS fallback_ttc, debug, round(ref / slope, 4) AS fit_ttc, round(ln(ref), 6) AS log_ref FROM rec",
)
def looming_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run writes of each sample; of debug_ref the part before the fit's decimals, which stand beside it."""
    known = F.col("truth").isNotNull()
    shown = F.when(F.col("debug_ref").startswith("fit_points="), F.substring_index("debug_ref", ";", 1)).otherwise(F.col("debug_ref"))
    return records(spark, sf_dir, written(intervals(spark, sf_dir), "intervals")).select(
        "seq", "start", "status", F.round("ttc", 4).alias("ttc"), F.round("error_pct", 3).alias("error_pct"), F.round("confidence", 6).alias("confidence"), F.round("fallback_ttc", 4).alias("fallback_ttc"),
        shown.alias("debug"), F.when(known, F.round(F.col("ref") / F.col("slope"), 4)).alias("fit_ttc"), F.when(known, F.round(F.log("ref"), 6)).alias("log_ref"),
    )


@query(
    "box_aux_features",
    f"""{_RECORDS}, spots AS ({_BASE} SELECT seq, idx, row_number() OVER (PARTITION BY seq ORDER BY idx) - 1 AS start FROM iv), j AS (SELECT s.seq, s.idx, ttc, confidence, starts_with(status, 'OK') AND ttc > 0 AS valid FROM spots s LEFT JOIN rec ON rec.seq = s.seq AND rec.start = s.start)
    SELECT seq, idx, CASE WHEN valid THEN round(ln(ttc), 6) ELSE 0 END AS log_ttc, CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END AS valid, CASE WHEN valid THEN round(coalesce(confidence, 0), 6) ELSE 0 END AS confidence FROM j""",
)
def box_aux_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event interval the box estimate at its place as features of a learner; zeros where there is none."""
    spans = written(intervals(spark, sf_dir), "intervals")
    at = spans.select("seq", "idx", _place().alias("start"))
    found = at.join(records(spark, sf_dir, spans).select("seq", "start", "status", "ttc", "confidence"), ["seq", "start"], "left")
    return found.select("seq", "idx", *[F.round(c, 6).alias(n) for n, c in fn.box_aux(F.col("status"), F.col("ttc"), F.col("confidence")).items()])


#: Training rows of a family below which a family's gate is trained on all families.
FAMILY_LEAST = 100


def _family_sql(features: list[str], shares: list[float], target: float, member: str, least: int) -> str:
    d, k = range(len(features)), len(shares)
    places = ", ".join(f"c{i}" for i in d)
    order = ", ".join(f"p.c{i}" for i in ([2, 0, 1] if len(features) > 2 else d))
    return f"""{_RATED}, u AS (SELECT fold, error, {member} AS member, {", ".join(f"{f} AS x{i}" for i, f in enumerate(features))} FROM (SELECT *, {_SIGNS} FROM rated) WHERE error IS NOT NULL AND {" AND ".join(f"{f} IS NOT NULL" for f in features)}),
    asked AS (SELECT fold, tested, total - tested < {least} AS widened FROM (SELECT fold, tested, sum(tested) OVER () AS total FROM (SELECT fold, count(*) FILTER (member) AS tested FROM u GROUP BY 1)) WHERE tested > 0),
    th AS (SELECT f.fold, any_value(widened) AS widened, any_value(tested) AS tested, {", ".join(f"quantile_cont(x{i}, {shares}) AS t{i}" for i in d)} FROM asked f JOIN u ON u.fold <> f.fold AND (f.widened OR u.member) GROUP BY f.fold),
    b AS (SELECT th.fold, u.fold = th.fold AS own, error, {", ".join(f"len(list_filter(t{i}, lambda t: t < x{i})) AS c{i}" for i in d)} FROM th, u WHERE member OR widened AND u.fold <> th.fold),
    c AS (SELECT fold, {places}, count(*) FILTER (NOT own) AS n, coalesce(sum(error) FILTER (NOT own), 0) AS e, count(*) FILTER (own) AS o FROM b WHERE {" AND ".join(f"c{i} < {k}" for i in d)} GROUP BY ALL),
    p AS (SELECT * FROM {", ".join(f"range({k}) r{i}(c{i})" for i in d)}),
    s AS (SELECT c.fold, {", ".join(f"p.c{i}" for i in d)}, sum(n)::BIGINT AS train_n, sum(e) / sum(n) AS mean, sum(o)::BIGINT AS kept FROM c JOIN p ON {" AND ".join(f"c.c{i} <= p.c{i}" for i in d)} GROUP BY ALL),
    best AS (SELECT * FROM s p WHERE train_n >= {least} QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(mean, 9) <= {target} DESC, CASE WHEN round(mean, 9) <= {target} THEN -train_n END, CASE WHEN round(mean, 9) > {target} THEN round(mean, 9) END, {order}) = 1)
    SELECT fold, {", ".join(f"round(t{i}[c{i} + 1], 4) AS {f}" for i, f in enumerate(features))}, widened, tested, train_n, round(mean, 4) AS mean, kept FROM best JOIN th USING (fold)"""


def _family_gate(spark: SparkSession, sf_dir: str, member: Column, features: list[str], least: int) -> DataFrame:
    found = gates.family_gate(signs(spark, sf_dir), member, features, TRIPLE_SHARES, 60.0, least)
    return found.select("fold", *[F.round(f, 4).alias(f) for f in features], "widened", "tested", "train_n", F.round("mean", 4).alias("mean"), "kept")


@query("gate_family", _family_sql(["iqr", "models", "smooth"], TRIPLE_SHARES, 60.0, "starts_with(name, 'CPNA')", FAMILY_LEAST))
def gate_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate of the families of few events alone."""
    return _family_gate(spark, sf_dir, fn.sequence_family(F.col("name")).isin(*fn.LOW_OBSERVABILITY), ["iqr", "models", "smooth"], FAMILY_LEAST)


@query("gate_family_rare", _family_sql(["iqr", "models"], TRIPLE_SHARES, 60.0, "family = 'PHASELATE'", FAMILY_LEAST))
def gate_family_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate of one status family, which may be too rare to be trained on alone."""
    return _family_gate(spark, sf_dir, F.col("family") == "PHASELATE", ["iqr", "models"], FAMILY_LEAST)


@query("gate_decisions", f"{_M} SELECT seq, start, status, CASE WHEN start % 3 = 0 THEN false ELSE coalesce(pred <= 3, false) END AS kept FROM m")
def gate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with what a policy decided on two labels in three; those without a decision are not kept."""
    rows = evaluated(spark, sf_dir)
    decisions = rows.where("start % 3 <> 0").select("seq", "start", (F.col("pred") <= 3).alias("kept"))
    return gates.decided(rows, decisions, ["seq", "start"]).select("seq", "start", "status", "kept")


def _frames_sql(x: str, y: str, above: int, log: bool) -> str:
    share = "ln(1 + n)::FLOAT::DOUBLE / ln(1 + top) * 255::DOUBLE" if log else "(n / top::DOUBLE)::FLOAT * 255::FLOAT"
    return f"""{_BASE}, c AS (SELECT e.seq, idx, {x} AS x, {y} AS y, count(*) AS n FROM ev e JOIN iv i ON e.seq = i.seq AND e.t_us >= i.lo AND e.t_us < i.hi WHERE x BETWEEN 0 AND 99 AND y BETWEEN 0 AND 99 GROUP BY 1, 2, 3, 4),
    d AS (SELECT seq, idx, x, y, CASE WHEN n > {above} THEN n ELSE 0 END AS n FROM c), t AS (SELECT *, max(n) OVER (PARTITION BY seq, idx) AS top FROM d)
    SELECT seq, idx, x, y, n, CASE WHEN top = 0 THEN 0 ELSE floor({share})::INTEGER END AS brightness FROM t"""


#: Spans of a month, so that pixels meet several events.
FRAME_DAYS = 30


def _frames(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = interval_join(events(spark, sf_dir), intervals(spark, sf_dir, FRAME_DAYS), FRAME_DAYS * DAY_US)
    return ops.count_frames(rows.select("seq", "idx", "x", "y"), **options)


@query("preview_frames_log", _frames_sql("99 - x", "y", 0, True).replace(str(DAY_US), str(FRAME_DAYS * DAY_US)))
def preview_frames_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored count images, bright by logs."""
    return _frames(spark, sf_dir, flip_x=True, log=True)


@query("preview_frames_above", _frames_sql("x", "99 - y", 1, False).replace(str(DAY_US), str(FRAME_DAYS * DAY_US)))
def preview_frames_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count images upside down, single events dark."""
    return _frames(spark, sf_dir, flip_y=True, above=1)


_MICRO = "to_json(list(list_transform(line, lambda v: round(v * 1e6)::BIGINT) ORDER BY \"row\"))"
_SCORES = {"event": "greatest(0, least(1, ln(1 + events) / ln(9::DOUBLE)))", "occupancy": "greatest(0, least(1, ratio / 0.05))", "freshness": "greatest(0, least(1, (mean - 0.05) / 0.6))"}
_GRIDS = {"occupancy_ratio": "ratio", "mean_surface": "mean", "confidence": "round(conf, 10)", **{f"{n}_score": s for n, s in _SCORES.items()}}


@query(
    "surface_payload",
    f"""{_CUES}, lines AS (SELECT seq, idx, "row", list(events ORDER BY col) AS counts, {", ".join(f"list({s} ORDER BY col) AS {n}" for n, s in _GRIDS.items())} FROM conf GROUP BY 1, 2, 3),
    grids AS (SELECT seq, idx, to_json(list(counts ORDER BY "row")) AS event_count, {", ".join(_MICRO.replace("line", n) + f" AS {n}" for n in _GRIDS)} FROM lines GROUP BY 1, 2),
    gc AS (SELECT seq, idx, coalesce(sum(conf * greatest(events, 1) * active) / nullif(sum(greatest(events, 1) * active), 0), 0) AS whole FROM conf GROUP BY 1, 2),
    chosen AS (SELECT seq, idx, to_json(list(["row", col] ORDER BY "row", col)) AS cells FROM sel GROUP BY 1, 2),
    s AS (SELECT r.seq, r.idx, any_value(to_json([r.rx0, r.ry0, r.rx1, r.ry1])) AS roi, coalesce(sum(n), 0)::BIGINT AS events, count(s.n) AS active FROM regions r LEFT JOIN surf s ON s.seq = r.seq AND s.idx = r.idx GROUP BY 1, 2)
    SELECT s.seq, s.idx, roi::VARCHAR AS roi, events, active, round(whole, 6) AS whole, coalesce(cells::VARCHAR, '[]') AS cells, event_count::VARCHAR AS event_count, {", ".join(f"{n}::VARCHAR AS {n}" for n in _GRIDS)}
    FROM s JOIN grids g ON g.seq = s.seq AND g.idx = s.idx JOIN gc ON gc.seq = s.seq AND gc.idx = s.idx LEFT JOIN chosen c ON c.seq = s.seq AND c.idx = s.idx""",
)
def surface_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested summaries, as JSON; decimals in millionths."""
    conf = _confidence(spark, sf_dir).withColumn("conf", F.round("conf", 10))
    rows = ops.payload(ops.region_stats(_surface(spark, sf_dir), _regions(spark, sf_dir)), conf, ops.selected_cells(conf), TAU_US)
    micro = lambda grid: F.to_json(F.transform(grid, lambda line: F.transform(line, lambda v: F.round(v * 1e6).cast("bigint"))))
    p = F.col("payload")
    grids = {n: p["local_stats"][f"{n}_grid"] if n in ("occupancy_ratio", "mean_surface") else p["confidence"][f"{n}_grid"] for n in _GRIDS}
    return rows.select(
        "seq", "idx", F.to_json(p["roi_xyxy"]).alias("roi"), p["roi_event_count"].alias("events"), p["active_pixel_count"].alias("active"), F.round(p["confidence"]["global_confidence"], 6).alias("whole"),
        F.to_json(p["confidence"]["selected_cell_indices"]).alias("cells"), F.to_json(p["local_stats"]["event_count_grid"]).alias("event_count"), *[micro(g).alias(n) for n, g in grids.items()],
    )


_CLASS = f"""CASE WHEN error IS NULL THEN 'NO_VALID_PREDICTION' WHEN error <= 50 THEN CASE WHEN contains(status, 'CURGUARD') OR contains(status, 'HISTGUARD') THEN 'REPAIRED_LOW_ERROR_GUARD_SAMPLE' ELSE 'LOW_ERROR_ACCEPTED' END
  ELSE CASE {" ".join(f"WHEN contains(status, '{a}') THEN '{b}'" for a, b in metrics.CLASSES)} WHEN ratio < 0.2::DOUBLE THEN 'UNGUARDED_CURRENT_BBOX_COLLAPSE' WHEN collapses > 0 THEN 'UNGUARDED_HISTORY_BBOX_COLLAPSE' WHEN {_FAMILY} = 'HIGH_CONF_Q25' THEN 'APPARENT_HIGH_CONF_GEOMETRY'
  ELSE 'OTHER_' || {_FAMILY} END || CASE WHEN pred / truth >= 1 THEN '_OVER' ELSE '_UNDER' END END"""
_FLAGS = "concat_ws('|', CASE WHEN ratio < 0.2::DOUBLE THEN 'current_bbox_collapse_signal' END, CASE WHEN collapses > 0 THEN 'history_bbox_collapse_signal' END, CASE WHEN truth > 0 AND pred / truth >= 1 THEN 'overestimate' WHEN truth > 0 AND pred IS NOT NULL THEN 'underestimate' END)"


def _classes_sql(number: int) -> str:
    return f"""{_sql(number)}, seen AS ({sql.estimate(looming.VARIANTS[number], ("n_rows - n_kept AS collapses", "ratio"))}), j AS (SELECT m.*, collapses, ratio FROM m JOIN seen ON seen.seq = m.seq AND seen.start = m.start) SELECT seq, start, {_CLASS} AS class, {_FLAGS} AS flags FROM j"""


def _classes(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    (boxes, series), v = observed(spark, sf_dir), looming.VARIANTS[number]
    truth = asof_interpolate(boxes.select("seq", F.col("label_id").alias("start"), "ts"), series, "ts", 0.1).select("seq", "start", F.col("v").alias("truth"))
    rows = looming.estimated(boxes, v).join(truth, ["seq", "start"])
    error, over = metrics.error_pct(F.col("ttc"), F.col("truth")), F.when(F.col("truth") > 0, F.col("ttc") / F.col("truth"))
    collapses = F.col("n_rows") - F.col("n_kept")
    return rows.select("seq", "start", metrics.failure_class(F.col("status"), F.col("truth"), error, over, collapses, F.col("ratio")).alias("class"), metrics.failure_flags(over, collapses, F.col("ratio")).alias("flags"))


@query("failure_classes", _classes_sql(13))
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each of the last variant's estimates is as wrong as it is, with the signs that hold."""
    return _classes(spark, sf_dir, 13)


@query("failure_classes_unguarded", _classes_sql(4))
def failure_classes_unguarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the variant without gates or guards, whose collapses nothing repairs."""
    return _classes(spark, sf_dir, 4)


_ALLOWED = ("seq", "start", "status", "pred", "fold", "n", "max_fit", *[f"q{k}" for k in QUANTILES], "collapses", "ratio", "pred_spread", "ratio_prev", "family", "name")


@query("allowed_features", f"{_RATED} SELECT unnest({list(_ALLOWED)}) AS feature, unnest([{', '.join(f'count({c})' for c in _ALLOWED)}]) AS n FROM rated")
def allowed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a learner may read of the rated estimates, and in how many rows it is known."""
    rows = rated(spark, sf_dir)
    columns = fn.without_truth(rows.columns)
    counts = rows.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in columns])))
