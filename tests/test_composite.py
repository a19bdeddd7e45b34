"""Family gates, cue selectors, records, previews and nested summaries against plain versions on small rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions import features as fn
from tracklens.operators import gates, looming, metrics, surface
from tests.test_gates import plain


@pytest.mark.parametrize("least, widened", [(20, {0: False, 1: False, 2: False}), (60, {0: True, 1: False, 2: False})])
def test_family_gate_against_trying_all(spark, least, widened):
    """The family's rows lie in three of four folds, most in fold 0, whose gate is then trained on all rows."""
    rng = np.random.default_rng(7)
    rows = [(f, bool(m), *(float(v) for v in np.round(rng.gamma(2, 2, 2), 1)), float(rng.integers(0, 40))) for f, own, others in ((0, 60, 40), (1, 30, 50), (2, 20, 30), (3, 0, 70)) for m in [1] * own + [0] * others]
    odd = [(None, True, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 3.0), (1, True, None, 1.0, 1.0), (2, True, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "fold bigint, member boolean, a double, b double, error double")
    shares = [0.1, 0.3, 0.6, 1.0]
    got = {r["fold"]: r for r in gates.family_gate(df, F.col("member"), ["a", "b"], shares, 12.0, least).collect()}
    assert {f: r["widened"] for f, r in got.items()} == widened
    every = [*rows, (1, False, 1.0, 1.0, 3.0)]
    for f, r in got.items():
        train = [x for x in every if x[0] != f and (x[1] or widened[f])]
        mine = [x for x in every if x[0] == f and x[1]]
        want = plain([(x[0], *x[2:]) for x in train + mine], 2, shares, 12.0, least)[f]
        assert tuple(r[c] for c in ("a", "b", "train_n", "mean", "kept")) == pytest.approx(want) and r["tested"] == len(mine)
        assert r["kept_error"] == pytest.approx(sum(x[4] for x in mine if x[2] <= want[0] and x[3] <= want[1]))


def test_family_gate_without_rows(spark):
    df = spark.createDataFrame([], "fold bigint, member boolean, a double, b double, error double")
    assert gates.family_gate(df, F.col("member"), ["a", "b"], [0.5, 1.0], 5.0, 1).count() == 0
    lone = spark.createDataFrame([(1, True, 1.0, 1.0, 2.0)], df.schema)
    assert gates.family_gate(lone, F.col("member"), ["a", "b"], [0.5, 1.0], 5.0, 1).count() == 0


def test_decisions_that_lack_keep_nothing(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, None), (2, 2, None)], "seq int, start int, kept boolean")
    told = spark.createDataFrame([(1, 1, True), (1, 1, False), (2, 1, False), (2, 2, None)], "seq int, start int, kept boolean")
    got = {(r["seq"], r["start"]): r["kept"] for r in gates.decided(rows, told, ["seq", "start"]).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): False, (2, 2): False}


def boxes():
    """Sequences that grow in both sides, in height only, not at all, and with one box; a repeated size."""
    out = []
    for m in range(9):
        out += [(1, m, 20 + 3 * m + (m % 2), 30 + 2.5 * m), (2, m, 40 - m * 0.5, 20 + 4.0 * m + (m % 3)), (3, m, 30.0, 30.0), (5, m, 10 + 2 * m, 10 + 2 * m)]
    return [(s, m, m * 0.1, float(w), float(h), float(w) * float(h)) for s, m, w, h in [*out, (4, 0, 20.0, 20.0)]]


def chosen(rows, seq, start, selector, back=7):
    """The selected cue by plain Python: name, ttc, residual, or a status."""
    hist = [(t, w, h) for s, m, t, w, h, _ in rows if s == seq and start - back <= m <= start]
    if len(hist) < 2:
        return "BBOX_HISTORY_TOO_SHORT"
    t = np.array([x[0] for x in hist])
    fits = []
    for name, of in (("WIDTH", lambda w, h: w), ("HEIGHT", lambda w, h: h), ("DIAG", math.hypot), ("SQRT_AREA", lambda w, h: math.sqrt(w * h))):
        y = np.array([of(w, h) for _, w, h in hist])
        slope, icept = np.polyfit(t, y, 1)
        ref = slope * start * 0.1 + icept
        if slope > 1 and ref > 3 and 0.05 <= ref / slope <= 20:
            fits.append((name, ref / slope, float(np.sqrt(np.mean((y - slope * t - icept) ** 2)) / ref), slope / ref))
    if not fits:
        return "BBOX_FIT_FAIL"
    if selector == "width":
        return next((f for f in fits if f[0] == "WIDTH"), "BBOX_WIDTH_UNAVAILABLE")
    key = {"lowest_residual": lambda f: round(f[2], 9), "highest_rel_slope": lambda f: round(-f[3], 9), "score_rel_slope_over_resid": lambda f: round(-f[3] / max(f[2], 1e-4), 6)}.get(selector)
    return min(fits, key=key) if key else f"BBOX_UNKNOWN_CUE_MODE:{selector}"


@pytest.mark.parametrize("selector", [*looming.SELECTORS, "tallest"])
def test_selected_cues(spark, selector):
    rows = boxes()
    df = spark.createDataFrame(rows, "seq bigint, label_id bigint, ts double, w double, h double, area double")
    v = looming.VARIANTS[2]
    got = looming.with_selected(looming.with_candidates(looming.histories(df, v), v), selector).collect()
    assert len(got) == len(rows)
    for r in got:
        want = chosen(rows, r["seq"], r["start"], selector)
        if isinstance(want, str):
            assert (r["status"], r["ttc"], r["residual"]) == (want, None, None), (r["seq"], r["start"])
        else:
            assert r["status"] == f"OK_BBOX_{want[0]}", (r["seq"], r["start"], want)
            assert (r["ttc"], r["rel_slope"]) == pytest.approx((want[1], want[3])) and r["residual"] == pytest.approx(want[2], abs=1e-9)
    assert {"BBOX_HISTORY_TOO_SHORT", "BBOX_FIT_FAIL"} <= {r["status"] for r in got}
    if selector == "width":
        assert "BBOX_WIDTH_UNAVAILABLE" in {r["status"] for r in got}


def test_records_of_each_kind(spark):
    kind = "seq int, status string, ttc double, n_rows int, fit_points bigint, slope double, ref double, truth double, fallback double, fell string, fell_confidence double"
    rows = [
        (1, "OK_BBOX_MULTI_Q25", 2.0, 13, 6, 3.0, 6.0, 4.0, 9.0, "OK", 0.5), (2, "BBOX_FIT_FAIL", None, 5, None, None, None, 4.0, 3.0, "OK_FALLBACK", 0.25), (3, "BBOX_FIT_FAIL", None, 5, None, None, None, 4.0, None, "NO_VALID_FEATURE", None),
        (4, "BBOX_HISTORY_TOO_SHORT", None, 1, None, None, None, 4.0, None, None, None), (5, "OK_BBOX_MULTI_Q25", 2.0, 13, 6, 3.0, 6.0, None, 9.0, "OK", 0.5), (6, "OK_BBOX_MULTI_Q10", 2.0, 40, 40, 3.0, 6.0, 0.0, None, None, None),
    ]
    got = {r["seq"]: r for r in looming.records(spark.createDataFrame(rows, kind), 12).collect()}
    shown = {s: (r["status"], r["ttc"], r["error_pct"], r["confidence"], r["fallback_ttc"], r["debug_ref"]) for s, r in got.items()}
    assert shown == {
        1: ("OK_BBOX_MULTI_Q25", 2.0, 50.0, 6 / 13, None, "fit_points=6;slope_px_per_s=3.000000;width_ref_px=6.000000"), 2: ("OK_LTS_FALLBACK", 3.0, 25.0, 0.25, 3.0, "bbox_status=BBOX_FIT_FAIL;fallback_status=OK_FALLBACK"),
        3: ("NO_VALID_FEATURE", None, None, None, None, "bbox_status=BBOX_FIT_FAIL;fallback_status=NO_VALID_FEATURE"), 4: ("BBOX_HISTORY_TOO_SHORT", None, None, None, None, "fit_points=1"),
        5: ("GT_INVALID", None, None, None, None, ""), 6: ("OK_BBOX_MULTI_Q10", 2.0, None, 1.0, None, "fit_points=40;slope_px_per_s=3.000000;width_ref_px=6.000000"),
    }


def test_box_aux_features(spark):
    rows = [("OK_A", 2.0, 0.5), ("OK_A", float("nan"), 0.5), ("OK_A", -1.0, 0.5), ("OK_A", 3.0, None), ("BBOX_FIT_FAIL", 2.0, 0.5), (None, None, None), ("OK", float("inf"), 1.0)]
    out = spark.createDataFrame(rows, "status string, ttc double, confidence double").select(*[c.alias(n) for n, c in fn.box_aux(F.col("status"), F.col("ttc"), F.col("confidence")).items()]).collect()
    want = [(math.log(2), 1.0, 0.5), (0, 0, 0), (0, 0, 0), (math.log(3), 1.0, 0.0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert [tuple(r) for r in out] == [pytest.approx(w) for w in want]


@pytest.mark.parametrize("log, above", [(False, 0), (True, 0), (False, 2), (True, 9)])
def test_count_frames_against_numpy(spark, log, above):
    rng = np.random.default_rng(3)
    rows = [(1, k % 2, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(-1, 7, (400, 2)))] + [(2, 0, None, 1)]
    got = {(r["idx"], r["x"], r["y"]): (r["n"], r["brightness"]) for r in surface.count_frames(spark.createDataFrame(rows, "seq int, idx int, x int, y int"), 6, 5, flip_x=True, above=above, log=log).collect()}
    for idx in (0, 1):
        count = np.zeros((5, 6), np.uint32)
        there = [(5 - x, y) for s, i, x, y in rows if s == 1 and i == idx and 0 <= x < 6 and 0 <= y < 5]
        for x, y in there:
            count[y, x] += 1
        count[count <= above] = 0
        top = float(count.max())
        frame = np.zeros((5, 6)) if top == 0 else np.log1p(count.astype(np.float32)) / np.log1p(top) * 255.0 if log else count.astype(np.float32) / np.float32(top) * np.float32(255.0)
        for x, y in set(there):
            assert got[idx, x, y][0] == count[y, x] and abs(got[idx, x, y][1] - int(frame[y, x])) <= (1 if log else 0)
        assert {k for k in got if k[0] == idx} == {(idx, x, y) for x, y in there}
    with pytest.raises(ValueError, match="negative"):
        surface.count_frames(spark.createDataFrame(rows, "seq int, idx int, x int, y int"), above=-1)


def test_payload_nests_grids_in_row_order(spark):
    region = spark.createDataFrame([(1, 7, 2, 3, 12, 13, 60, 5, 4, 0.04, 0.5)], "seq int, idx int, rx0 int, ry0 int, rx1 int, ry1 int, hi bigint, n bigint, active bigint, occupancy double, mean double")
    cells = spark.createDataFrame([(1, 7, r, c, r * 3 + c, int(r == c), 0.01 * (r + c), 0.1 * r) for c in (2, 0, 1) for r in (1, 2, 0)], "seq int, idx int, row int, col int, events bigint, active bigint, ratio double, mean double")
    conf = surface.local_confidence(cells)
    none = conf.where("false")
    for selected, want in ((conf.where("row = col AND row > 0"), [[1, 1], [2, 2]]), (none, [])):
        p = json.loads(surface.payload(region, conf, selected, 9).select(F.to_json("payload").alias("p")).first()["p"])
        assert p["local_stats"]["event_count_grid"] == [[0, 1, 2], [3, 4, 5], [6, 7, 8]] and p["local_stats"]["grid_shape"] == [3, 3]
        assert p["roi_xyxy"] == [2, 3, 12, 13] and p["roi_shape_hw"] == [10, 10] and p["roi_area"] == 100 and p["tau_us"] == 9 and p["reference_t_us"] == 60
        assert p["confidence"]["active_mask"] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
        assert p["confidence"]["selected_cell_indices"] == want and p["confidence"]["selected_cell_count"] == len(want)
    assert "active_mask" not in surface.payload(region, conf, none, 9, components=False).schema["payload"].dataType["confidence"].dataType.names


def test_failure_classes_and_flags(spark):
    rows = [
        ("OK_BBOX_MULTI_Q25_LOWFIT", 1.0, 80.0, 1.8, 2, 0.1, "LOWFIT_OVER", "current_bbox_collapse_signal|history_bbox_collapse_signal|overestimate"), ("OK_BBOX_MULTI_Q25_DISPSHORT_HISTGUARD", 1.0, 60.0, 0.4, 0, None, "HIGH_DISPERSION_UNDER", "underestimate"),
        ("OK_BBOX_MULTI_Q25_CURGUARD", 1.0, 50.0, 1.5, 0, 0.9, "REPAIRED_LOW_ERROR_GUARD_SAMPLE", "overestimate"), ("OK_BBOX_MULTI_Q25", 1.0, 50.0, 1.0, 0, 0.9, "LOW_ERROR_ACCEPTED", "overestimate"),
        ("OK_BBOX_MULTI_Q25", 1.0, 70.0, 0.3, 1, 0.2, "UNGUARDED_HISTORY_BBOX_COLLAPSE_UNDER", "history_bbox_collapse_signal|underestimate"), ("OK_BBOX_MULTI_Q25", 1.0, 70.0, 1.7, 1, 0.19, "UNGUARDED_CURRENT_BBOX_COLLAPSE_OVER", "current_bbox_collapse_signal|history_bbox_collapse_signal|overestimate"),
        ("OK_BBOX_MULTI_Q25", 1.0, 70.0, 1.7, 0, None, "APPARENT_HIGH_CONF_GEOMETRY_OVER", "overestimate"), ("OK_BBOX_WIDTH", 1.0, 70.0, None, None, None, "OTHER_OK_OTHER_UNDER", ""), ("BBOX_FIT_FAIL", 1.0, None, None, 0, None, "NO_VALID_PREDICTION", ""),
    ]
    df = spark.createDataFrame(rows, "status string, truth double, error double, over double, collapses int, area double, class string, flags string")
    got = df.select("class", "flags", metrics.failure_class(*[F.col(c) for c in ("status", "truth", "error", "over", "collapses", "area")]).alias("c"), metrics.failure_flags(F.col("over"), F.col("collapses"), F.col("area")).alias("f")).collect()
    assert [(r["c"], r["f"]) for r in got] == [(r["class"], r["flags"]) for r in got]


def test_variant_labels_and_columns_from_the_truth():
    assert fn.variant_label("cnn", "image_only") == "TinyCnnImageOnlyV1"
    with pytest.raises(ValueError, match=r"takes the modes \['pooled_image_stats_metadata', 'stats_metadata'\]"):
        fn.variant_label("ridge", "image_only")
    with pytest.raises(ValueError, match="no model"):
        fn.variant_label("forest", "image_only")
    assert fn.without_truth(["q10", "truth", "e_ttc_pct", "pred", "flags"]) == ["q10", "pred"]
