"""Queries on the event predictor: expansion cues per cell, fallback and their blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fn
from ..operators import surface as ops
from ..sources.driver import DAY_US, events
from ..sources.shared import written
from .events import _CONF, TAU_US, _confidence, _regions, _surface
from .registry import query

#: Ages in days, so that slopes pass their gate; cells here are sparse.
UNIT_US, PIXELS = 86_400_000_000.0, 2

_CUES = f"""{_CONF}, sel AS (SELECT * FROM (SELECT *, active > 0 AND round(conf, 10) >= 0.55 AS good, count(*) FILTER (active > 0 AND round(conf, 10) >= 0.55) OVER (PARTITION BY seq, idx) AS n_good,
    row_number() OVER (PARTITION BY seq, idx ORDER BY active > 0 DESC, round(conf, 10) DESC, "row", col) AS place FROM conf) WHERE CASE WHEN n_good >= 1 THEN good ELSE active > 0 AND place <= 1 END),
px AS (SELECT c.seq, c.idx, c."row", c.col, round(s.conf, 10) AS conf, surface AS w, (last_us - hi) / {UNIT_US}::DOUBLE AS age, sqrt((x - (x1 + x2) / 2.0::DOUBLE) ** 2 + (y - (y1 + y2) / 2.0::DOUBLE) ** 2) AS r FROM celled c JOIN sel s ON s.seq = c.seq AND s.idx = c.idx AND s."row" = c."row" AND s.col = c.col),
sums AS (SELECT seq, idx, "row", col, conf, count(*) AS points, sum(w) AS sw, sum(w * age) AS sx, sum(w * r) AS sy, sum(w * age * age) AS sxx, sum(w * age * r) AS sxy FROM px GROUP BY ALL),
fit AS (SELECT *, CASE WHEN points >= 2 AND sw > 0 AND abs(sxx - sx * sx / sw) >= 1e-12 THEN (sxy - sx * sy / sw) / (sxx - sx * sx / sw) END AS slope FROM sums), fit2 AS (SELECT *, (sy - slope * sx) / sw AS icept FROM fit),
cue AS (SELECT *, CASE WHEN points < {PIXELS} THEN 'TOO_FEW_PIXELS' WHEN slope IS NULL THEN 'FIT_FAIL' WHEN icept <= 3 THEN 'RADIUS_TOO_SMALL' WHEN slope <= 1 THEN 'NON_POSITIVE_EXPANSION' WHEN NOT icept / slope BETWEEN 0.05 AND 20 THEN 'TTC_OUT_OF_RANGE' ELSE 'OK' END AS status FROM fit2)"""
_FALL = """fall AS (SELECT r.seq, r.idx, greatest(0.05, least(20, 0.117 * sqrt((any_value(r.x2) - any_value(r.x1)) ** 2 + (any_value(r.y2) - any_value(r.y1)) ** 2) / (ln(1 + greatest(1, coalesce(sum(n), 0))) * greatest(0.05, coalesce(avg(surface), 0))))) AS fallback
FROM regions r LEFT JOIN surf s ON s.seq = r.seq AND s.idx = r.idx GROUP BY 1, 2)"""


def _cues(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    conf = _confidence(spark, sf_dir, days).withColumn("conf", F.round("conf", 10))
    return ops.expansion_cues(_surface(spark, sf_dir, days=days), ops.selected_cells(conf), days * UNIT_US, pixels=PIXELS)


def _fallback(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    return ops.region_stats(_surface(spark, sf_dir, days=days), _regions(spark, sf_dir, days)).select("seq", "idx", _density())


def _density() -> Column:
    diagonal = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    return fn.fallback_ttc(diagonal, F.col("n"), F.col("mean")).alias("fallback")


def predicted(spark: SparkSession, sf_dir: str, spans: DataFrame) -> DataFrame:
    """seq, idx, confidence, ttc and status of the event predictor over ``intervals``: the events are read and their pixels grouped once."""
    surface = ops.time_surface(ops.in_roi(events(spark, sf_dir), spans, DAY_US), TAU_US)
    conf = ops.local_confidence(written(ops.active_cells(surface, UNIT_US), "cells"))
    cues = ops.cell_cues(ops.selected_cells(conf.withColumn("conf", F.round("conf", 10))), PIXELS)
    return ops.predict_from_cues(cues, ops.cell_regions(conf, ops.roi(spans)).select("seq", "idx", "confidence", _density()))


@query("fallback_ttc", f"{_CUES}, {_FALL} SELECT seq, idx, round(fallback, 6) AS fallback FROM fall")
def fallback_ttc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fallback(spark, sf_dir).select("seq", "idx", F.round("fallback", 6).alias("fallback"))


@query("expansion_cues", f'{_CUES} SELECT seq, idx, "row", col, points, status, CASE WHEN status = \'OK\' THEN round(icept / slope, 4) END AS ttc FROM cue')
def expansion_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("seq", "idx", "row", "col", "points", "status", F.round("ttc", 4).alias("ttc"))


@query(
    "event_predictor",
    f"""{_CUES}, {_FALL}, g AS (SELECT seq, idx, icept / slope AS ttc, conf * greatest(points, 1) AS wt FROM cue WHERE status = 'OK'), c AS (SELECT *, sum(wt) OVER (PARTITION BY seq, idx ORDER BY ttc) AS upto, sum(wt) OVER (PARTITION BY seq, idx) AS total FROM g),
    md AS (SELECT seq, idx, min(ttc) AS median FROM c WHERE upto >= 0.5 * total GROUP BY 1, 2) SELECT f.seq, f.idx, round(coalesce(0.65 * median + 0.35 * fallback, fallback), 4) AS ttc, CASE WHEN median IS NOT NULL THEN 'OK' ELSE 'OK_FALLBACK' END AS status FROM fall f LEFT JOIN md ON md.seq = f.seq AND md.idx = f.idx""",
)
def event_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.predict_from_cues(_cues(spark, sf_dir), _fallback(spark, sf_dir)).select("seq", "idx", F.round("ttc", 4).alias("ttc"), "status")
