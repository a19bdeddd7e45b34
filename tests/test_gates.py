"""Gates against plain numpy, and over many rows and partitions with adaptive execution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import gates


def plain(rows, d, shares, target, least):
    """For each fold the choice by trying all thresholds over its training rows."""
    x, e = np.array([r[1 : 1 + d] for r in rows], float), np.array([r[-1] for r in rows], float)
    fold = np.array([r[0] for r in rows])
    out = {}
    for f in sorted(set(fold)):
        train = fold != f
        at = [np.quantile(x[train, i], shares) for i in range(d)]
        best = None
        for place in np.ndindex(*[len(shares)] * d):
            below = np.all([x[:, i] <= at[i][p] for i, p in enumerate(place)], axis=0)
            n = int((below & train).sum())
            if n < least:
                continue
            mean = round(float(e[below & train].mean()), 9)
            order = place if d < 3 else (place[2], place[0], place[1])
            key = (0, -n, order) if mean <= target else (1, mean, order)
            if best is None or key < best[0]:
                best = key, (*[float(at[i][p]) for i, p in enumerate(place)], n, mean, int((below & ~train).sum()))
        if best:
            out[int(f)] = best[1]
    return out


@pytest.mark.parametrize("d, target", [(2, 10.0), (3, 10.0), (3, -1.0)])
def test_feature_gate_against_trying_all(spark, d, target):
    """Uneven folds (one with half of the rows), ties, nulls and a fold whose values all lie above the others'."""
    rng = np.random.default_rng(d)
    folds = [0] * 200 + [1] * 90 + [2] * 60 + [3] * 40 + [4] * 10
    rows = [(f, *(float(v) + (99 if f == 4 else 0) for v in np.round(rng.gamma(2, 2, 3), 0 if k % 3 else 2)), float(rng.integers(0, 40))) for k, f in enumerate(folds)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 5.0), (1, 1.0, 1.0, 1.0, None), (None, 1.0, 1.0, 1.0, 1.0)], "fold bigint, a double, b double, c double, error double")
    shares = [0.1, 0.25, 0.5, 0.8, 1.0]
    used = [(r[0], *r[1 : 1 + d], r[-1]) for r in rows]
    if d == 2:
        df = df.where("a IS NOT NULL")
    want = plain(used, d, shares, target, 30)
    got = {r["fold"]: tuple(r)[1:-1] for r in gates.feature_gate(df, ["a", "b", "c"][:d], shares, target, 30).collect()}
    assert got.keys() == want.keys()
    for f, w in want.items():
        assert got[f] == pytest.approx(w), f


def test_quantiles_of_the_others(spark):
    rng = np.random.default_rng(1)
    rows = [(int(f), float(v)) for f, v in zip(rng.integers(0, 7, 500), rng.integers(0, 60, 500), strict=True)] + [(9, 5.0)]
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {}
    for r in gates.training_quantiles(spark.createDataFrame(rows, "fold int, x double"), "x", shares).collect():
        got[r["fold"], r["share"]] = r["threshold"]
    for f in {r[0] for r in rows}:
        for s in shares:
            assert got[f, s] == pytest.approx(np.quantile([v for g, v in rows if g != f], s)), (f, s)


def test_gates_over_many_rows_with_adaptive_execution(spark):
    """Partitions of differing size are put together differently by adaptive execution; the joins must not mind."""
    rows = spark.range(80_000).select((F.col("id") % 97).alias("fold"), (F.xxhash64("id") % 10_007 / 100).alias("a"), (F.xxhash64("id", F.lit(1)) % 1009 / 10).alias("b"), (F.col("id") % 211 / 2).alias("c"), (F.abs(F.xxhash64("id", F.lit(2))) % 100).cast("double").alias("error"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        found = gates.threshold_gate(rows, "a", [k / 20 for k in range(1, 21)], 50.0, 100)
        assert found.count() == 97
        assert gates.gated(rows, found, {"a": "threshold"}).count() > 0
        assert gates.feature_gate(rows, ["a", "b", "c"], [0.25, 0.5, 1.0], 50.0, 100).count() == 97
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [[], [(1, 1.0, 2.0, 3.0), (1, 2.0, 1.0, 3.0)]])
def test_no_rows_or_no_other_fold_gives_no_gate(spark, rows):
    df = spark.createDataFrame(rows, "fold bigint, a double, b double, error double")
    assert gates.threshold_gate(df, "a", [0.5, 1.0], 5.0, 1).count() == 0
    assert gates.feature_gate(df, ["a", "b"], [0.5, 1.0], 5.0, 1).count() == 0


def test_small_and_great_groups_agree_with_trying_all(spark, monkeypatch):
    """small groups look near the common thresholds, and no row is joined with groups; the others as before, and all where there are many ties."""
    rng = np.random.default_rng(4)
    folds = rng.choice([0, 1, 2, 3, 4, 5], 700, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02]).tolist()
    rows = [(f, round(float(rng.gamma(2, 2)), 1), 0.0 if k % 3 else float(rng.integers(0, 9)), float(rng.integers(0, 40))) for k, f in enumerate(folds)]
    df = spark.createDataFrame(rows, "fold bigint, a double, b double, error double")
    shares = [0.1, 0.25, 0.5, 0.8, 1.0]
    want = plain(rows, 2, shares, 14.0, 30)
    for small, sums in ((2048, 1 << 20), (100, 1 << 20), (2048, 3), (5, 1 << 20)):
        monkeypatch.setattr(gates, "SMALL", small)
        monkeypatch.setattr(gates, "NEAR_SUMS", sums)
        if small == 2048 and sums > 3:
            monkeypatch.setattr(gates, "_common_gate", None)  # not needed
        got = {r["fold"]: tuple(r)[1:-1] for r in gates.feature_gate(df, ["a", "b"], shares, 14.0, 30).collect()}
        assert got.keys() == want.keys()
        for f, w in want.items():
            assert got[f] == pytest.approx(w), (small, sums, f)
        told = {(r["fold"], r["share"]): r["threshold"] for r in gates.training_quantiles(df, "a", shares).collect()}
        for f in set(folds):
            for s in shares:
                assert told[f, s] == pytest.approx(np.quantile([r[1] for r in rows if r[0] != f], s)), (small, f, s)
        monkeypatch.undo()
