"""Nested records, the coverage frontier, and slices of the sorted event table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracklens.operators import records
from tracklens.sources import files


def plain(value, path="$"):
    out = []
    if isinstance(value, dict):
        if any(k in value for k in records.METRIC_KEYS):
            out.append((path, value))
        for k, v in value.items():
            out += plain(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += plain(v, f"{path}[{i}]")
    return out


def test_records_wherever_they_stand(spark):
    docs = {
        "a": {"x": {"mae_s": 1.5, "e_ttc_pct": None, "deep": [{"failure": {"est_valid": 3}}, 4, [[{"mae_s": None}]]]}, "y": [1, "mae_s", {}]},
        "b": {"e_ttc_pct": 2, "s": "text", "n": None}, "c": [], "d": 7, "e": [{"failure_count": 0}, {"other": 1}],
    }
    texts = spark.createDataFrame([*[(k, json.dumps(v)) for k, v in docs.items()], ("bad", "{oops"), ("none", None)], "file string, value string")
    got = sorted((r["file"], r["path"], json.dumps(json.loads(r["record"]), sort_keys=True)) for r in records.metric_records(texts).collect())
    want = sorted((k, path, json.dumps(v, sort_keys=True)) for k, doc in docs.items() for path, v in plain(doc))
    assert got == want and len(got) == 6
    assert records.metric_records(texts.limit(0)).count() == 0


def test_coverage_of_wanted_runs(spark):
    run = {"args": {"target_e_ttc_pct": 7}, "policy_summaries": {records.BASE_POLICY: {"count": 9}, "p": {"count": 5, "mae_s": 0.5, "e_ttc_pct": 6.5, "coverage_of_gt_valid": 0.5}, "q": {"count": 1}}}
    texts = spark.createDataFrame([("one", json.dumps(run)), ("bad", "{"), ("bare", "{}"), ("unasked", json.dumps(run))], "run string, value string")
    wanted = spark.createDataFrame([("one",), ("bad",), ("bare",), ("gone",)], "run string")
    got = {(r["run"], r["policy"]): (r["status"], r["target"], r["est_valid"], r["e_ttc"], r["success"]) for r in records.coverage_rows(texts, wanted).collect()}
    assert {k: v for k, v in got.items() if k[1] is not None} == {("one", "p"): ("ok", 7.0, 5, 6.5, True), ("one", "q"): ("ok", 7.0, 1, None, False), ("bad", "unreadable"): ("unreadable", None, None, None, None), ("gone", "missing"): ("missing", None, None, None, None)}


def test_frontier_against_comparing_all(spark):
    rng = random.Random(4)
    rows = [(k % 3, rng.choice([None, 0.1, 0.2, 0.5, 0.5, 0.9]), rng.choice([None, 1.0, 2.0, 2.0, 5.0])) for k in range(60)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, run int, of_truth double, e_ttc double")
    got = {r["id"]: r["best"] for r in records.frontier(df).collect()}
    for i, (run, cover, error) in enumerate(rows):
        others = [(c, e) for r, c, e in rows if r == run and c is not None and e is not None]
        want = cover is not None and error is not None and not any(c >= cover and e < error or c > cover and e <= error for c, e in others)
        assert got[i] == want, (i, rows[i])


def test_slices_read_few_row_groups(spark, tmp_path):
    events = spark.range(60_000).select((F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(7)).alias("seq"), F.col("id").alias("event_id"), ((F.col("id") * 7919) % 60_000).alias("t_us"), (F.col("id") % 100).cast("int").alias("x"))
    numbered = files.numbered(events, 5000)
    path = str(tmp_path / "events")
    files.write_events(numbered, path, group_bytes=32 << 10)
    hot = sorted((r["t_us"], r["event_id"]) for r in events.where("seq = 7").collect())
    df = files.event_slice(spark, path, 7, 1000, 1050)
    assert sorted((r["t_us"], r["event_id"]) for r in df.collect()) == hot[1000:1050]
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = files.event_slice(spark, path, 7, 1000, 1050)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    assert "GreaterThanOrEqual(event_idx,1000)" in plan and "LessThan(event_idx,1050)" in plan and "EqualTo(seq,7)" in plan
    read = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 50 <= read < len(hot) // 4, read
    assert files.event_slice(spark, path, 7, 5, 5).count() == 0
    with pytest.raises(ValueError):
        files.event_slice(spark, path, 7, 2, 1)
