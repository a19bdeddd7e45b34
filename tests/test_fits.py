"""Lines fitted once for several variants, in batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklens.operators import fits, looming
from tracklens.plans import QUERIES, features


def tracks(spark):
    rng = np.random.default_rng(5)
    rows = [(s, m, m / 10, float(20 + m * 0.5 + rng.normal()) * (0.3 if (s * 7 + m) % 11 == 0 else 1.0), float(18 + m * 0.4 + rng.normal())) for s in range(12) for m in range(40) if (s + m) % 9]
    return spark.createDataFrame(rows, "seq bigint, label_id bigint, ts double, w double, h double").withColumn("area", F.col("w") * F.col("h"))


def test_variants_together_are_those_alone(spark):
    boxes = tracks(spark)
    numbers = (4, 6, 13, 9, 7)
    both = {(r["seq"], r["start"]): r for r in looming.estimates(boxes, numbers).collect()}
    for n in numbers:
        alone = {(r["seq"], r["start"]): (r["status"], r["ttc"]) for r in looming.estimate(boxes, n).collect()}
        assert alone == {k: tuple(r[f"v{n}"]) for k, r in both.items()}
        assert len({status for status, _ in alone.values()}) > 2
    with pytest.raises(ValueError):
        looming.estimates(boxes, (3, 4))


def test_statistics_are_those_of_the_candidates(spark):
    v = looming.VARIANTS[4]
    boxes = tracks(spark)
    found = looming.with_candidates(looming.histories(boxes, v), v)
    want = {(r["seq"], r["start"]): (sorted(c["ttc"] for c in r["cands"]), max((c["fit_points"] for c in r["cands"]), default=None)) for r in found.collect()}
    for r in looming.judged(looming.fitted(boxes, [v]), v).collect():
        times, most = want[r["seq"], r["start"]]
        assert (r["n"] or 0, r["max_fit"]) == (len(times), most)
        assert times and r["q25"] == pytest.approx(np.quantile(times, 0.25), rel=1e-12) or r["q25"] is None


def test_empty_and_unknown_boxes():
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("label_id", "ts", "w", "h", "area")]))
    box = lambda k, area: {"label_id": float(k), "ts": k / 10, "w": 1.0, "h": 1.0, "area": area}
    boxes, there = fits._dealt(pa.array([None, [], [box(0, 4.0), box(1, None), box(2, 4.0)]], kind).slice(1))
    assert there.sum(axis=1).tolist() == [0, 3] and boxes["label_id"][1].tolist() == [2, 1, 0] and np.isnan(boxes["area"][1, 1])
    assert not fits._dropped(boxes["area"], there, 0.2).any()


def gathered(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("collect_list(")


def test_histories_are_gathered_once(spark, sf):
    assert gathered(features.rated(spark, sf)) == 1
    for name in ("method_summaries", "topk_regressions", "log_disagreement"):
        assert gathered(QUERIES[name](spark, sf)) == 1


@pytest.mark.parametrize("number", [4, 9, 13])
def test_nearest_candidate_without_fitting_twice(spark, number):
    """before, the chosen line was found by a second plan over the boxes, joined with the first."""
    v, low = looming.VARIANTS[number], (F.col("seq") * 7 + F.col("label_id")) % 11 == 0
    boxes = tracks(spark).withColumn("h", F.when(low, F.col("h") * 0.3).otherwise(F.col("h"))).withColumn("area", F.col("w") * F.col("h"))
    rows = looming.histories(boxes, v)
    rows = looming.with_candidates(looming.with_candidates(rows, v), v, kept_only=True, into="kept")
    cands = {(r["seq"], r["start"]): r for r in rows.select("seq", "start", "cands", "kept").collect()}
    chosen = looming.estimated(boxes, v, chosen=True)
    assert chosen._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    got, guarded = chosen.collect(), 0
    assert len(got) == len(cands)
    for r in got:
        if r["ttc"] is None:
            assert (r["fit_points"], r["slope"], r["ref"]) == (None, None, None)
            continue
        guarded += r["hist_guard"]
        of = cands[r["seq"], r["start"]]["kept" if r["hist_guard"] else "cands"]
        want = min(of, key=lambda c: (np.floor(abs(c["ttc"] - r["ttc"]) * 1e9 + 0.5), c["back"], c["ord"]))
        assert (r["fit_points"], r["slope"], r["ref"]) == (want["fit_points"], want["slope"], want["ref"])
    assert {r["ttc"] is None for r in got} == {True, False} and (guarded or not v.history_guard)
