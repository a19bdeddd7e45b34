"""The selector between cues and fallback, and cue quality, on crafted rows."""

import math

import pytest
from pyspark.sql import functions as F

from tracklens.operators import looming, metrics, quality_cues


def test_selector_reaches_each_of_its_results(spark):
    rows = [
        (1, 3, 2.0, 2.0, 0.95, 0.0),  # many, good, in agreement
        (2, 1, 0.5, 0.5, 0.95, 0.0),  # one cue far below the fallback
        (3, 2, 2.0, 2.0, 0.90, 0.2),  # blend
    ]
    stats = spark.createDataFrame(rows, "seq int, cues bigint, pick double, median double, weighted_quality double, dispersion double").withColumn("idx", F.lit(0))
    fallback = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 3.0), (4, 3.0), (5, None)], "seq int, fallback double").withColumn("idx", F.lit(0))
    got = {r["seq"]: (r["status"], r["ttc"]) for r in quality_cues.select_by_quality(stats, fallback).collect()}
    score = (0.90 + (1 - 0.2 / 0.4) + (2 - 1) / 2) / 3
    share = 0.6 - 0.3 * score
    assert got[1] == ("OK_CUE_ONLY", 2.0) and got[2] == ("OK_FALLBACK", 3.0) and got[4] == ("OK_FALLBACK", 3.0) and got[5] == ("NO_VALID_FEATURE", None)
    assert got[3][0] == "OK_BLEND" and got[3][1] == pytest.approx((1 - share) * 2.0 + share * 3.0)


def test_quality_cue_against_plain_sums(spark):
    points = [(10, 10, -30), (14, 10, -20), (10, 16, -10), (13, 19, -5), (20, 11, -1)]
    rows = [(1, 0, x, y, 0, t, math.exp(t / 40), 0, 0, 90, 90, 0.0, 0.0, 90.0, 90.0) for x, y, t in points]
    pixels = spark.createDataFrame(rows, "seq int, idx int, x int, y int, hi int, last_us int, surface double, rx0 int, ry0 int, rx1 int, ry1 int, x1 double, y1 double, x2 double, y2 double")
    cells = spark.createDataFrame([(1, 0, 0, 0, 0.7)], "seq int, idx int, row int, col int, conf double")
    (r,) = quality_cues.quality_cues(pixels, cells, 10.0, quality_cues.CueLimits(pixels=3, slope=0.1)).collect()
    w = [math.exp(t / 40) for *_, t in points]
    mean = lambda v: sum(a * b for a, b in zip(w, v, strict=True)) / sum(w)
    cx, cy = mean([p[0] for p in points]), mean([p[1] for p in points])
    radius, age = [math.hypot(x - cx, y - cy) for x, y, _ in points], [t / 10 for *_, t in points]
    ma, mr = mean(age), mean(radius)
    slope = mean([(a - ma) * (b - mr) for a, b in zip(age, radius, strict=True)]) / mean([(a - ma) ** 2 for a in age])
    residual = math.sqrt(mean([(b - slope * a - (mr - slope * ma)) ** 2 for a, b in zip(age, radius, strict=True)]))
    assert (r["points"], r["status"]) == (5, "RADIUS_SUPPORT_TOO_SMALL" if max(radius) - min(radius) < 3 else r["status"])
    assert r["slope"] == pytest.approx(slope) and r["residual"] == pytest.approx(residual) and r["cx"] == pytest.approx(cx)


def test_fallback_of_the_box_estimator(spark):
    rows = [(1, "OK_X", 1.0, 2.0, 9.0, "OK"), (2, "BBOX_FIT_FAIL", None, 2.0, 9.0, "OK_FALLBACK"), (3, "BBOX_FIT_FAIL", None, 2.0, None, None), (4, "OK_X", 1.0, None, 9.0, "OK")]
    df = spark.createDataFrame(rows, "id int, status string, ttc double, truth double, fallback double, fell string")
    got = {r["id"]: (r["status"], r["ttc"]) for r in looming.with_fallback(df).collect()}
    assert got == {1: ("OK_X", 1.0), 2: ("OK_LTS_FALLBACK", 9.0), 3: ("BBOX_FIT_FAIL", None), 4: ("GT_INVALID", None)}


def test_split_holds_at_least_one_and_never_all(spark):
    df = spark.createDataFrame([(1, 0)] + [(2, k) for k in range(2)] + [(3, k) for k in range(20)], "g int, k int")
    held = {r["g"]: r["n"] for r in metrics.seeded_split(df, "g", "k", 0.2, 1).groupBy("g").agg(F.count_if("held").alias("n")).collect()}
    assert held == {1: 0, 2: 1, 3: 4}
