"""Exact quantiles of groups against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import quantiles
from tracklens.plans import QUERIES


@pytest.mark.parametrize("near", [0.001, 0.0])
def test_exact_quantiles(spark, monkeypatch, near):
    monkeypatch.setattr(quantiles, "NEAR", near)
    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("a", 3001), ("b", 1), (None, 7), ("c", 400)) for x in (rng.normal(size=n) if g != "c" else rng.integers(0, 3, n))] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"low": ("x", 0.2), "mid": ("x", 0.5), "top": ("x", 1.0)}
    got = {r["g"]: (r["low"], r["mid"], r["top"]) for r in quantiles.exact_quantiles(df, ["g"], wanted).collect()}
    assert got.pop("d") == (None, None, None) and set(got) == {"a", "b", "c", None}
    for g, found in got.items():
        assert found == pytest.approx([np.quantile([x for k, x in rows if k == g and x is not None], s) for _, s in wanted.values()], rel=1e-12)
    whole = quantiles.exact_quantiles(df, [], {"mid": ("x", 0.5)}).collect()
    assert [r["mid"] for r in whole] == [pytest.approx(np.median([x for _, x in rows if x is not None]))]
    assert quantiles.with_quantiles(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], wanted).count() == 5


def test_no_group_is_held_in_one_task(spark, sf):
    for name in ("policy_summary", "error_summary_by_family", "boundary_summary", "guard_policies"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan.replace("percentile_approx(", "")
