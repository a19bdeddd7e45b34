"""Row features, class ladders and prediction policies as column expressions.

In ladders the first condition that holds wins; comparisons with null don't hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of sequence names, the longer of two first, and the families of few events.
PREFIXES = ("CPNAO", "CPNA", "CPLA", "CCRm", "CCRs")
LOW_OBSERVABILITY = ("CPNA", "CPNAO")
SPEEDS = (("low", 0), ("medium", 1), ("high", 2))
#: The quantile (per cent) that a policy takes by status family; the rest take the last.
POLICIES = {
    "v13_like": ({"PHASESTABLE": 10, "PHASELATE": 10, "PHASEEARLY": 50, "PHASEGROWTH": 50}, 25),
    "conservative": ({"PHASESTABLE": 5, "PHASELATE": 5, "PHASEEARLY": 35, "PHASEGROWTH": 35}, 15),
    "median_guarded": ({"CURGUARD": 15, "HISTGUARD": 15, "PHASELATE": 10, "PHASESTABLE": 15, "PHASEEARLY": 50, "PHASEGROWTH": 50}, 25),
}
LOW_TTC, HIGH_TTC = 0.05, 25.0


def ladder(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    first, name = rules[0]
    out = F.when(first, name)
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def sequence_family(name: Column) -> Column:
    return ladder([(name.startswith(p), p) for p in PREFIXES], "other")


def speed_level(name: Column) -> Column:
    out = F
    for word, level in SPEEDS:
        out = out.when(name.contains(word), level)
    return out.otherwise(-1)


def visibility(name: Column) -> Column:
    """Share in the name (0%, 50% or 100%), else -1."""
    return F.coalesce(F.regexp_extract(name, "(0|50|100)%", 1).try_cast("double") / 100, F.lit(-1.0))


def repeat_index(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"CCRs-(\d+)", 1).try_cast("double"), F.lit(0.0))


def fit_points(debug: Column) -> Column:
    """The fit_points of a string of k=v pairs set apart by semicolons."""
    return F.try_element_at(F.str_to_map(debug, F.lit(";"), F.lit("=")), F.lit("fit_points")).try_cast("int")


def as_number(text: Column) -> Column:
    """A finite number, or null for what isn't one."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def as_int(text: Column) -> Column:
    """A number without its fraction, as int(float(text))."""
    return as_number(text).try_cast("bigint")


def format_number(value: Column, digits: int = 6) -> Column:
    """Fixed digits; blank for null, NaN and infinities."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.format_string(f"%.{digits}f", value)).otherwise("")


def positive_log(value: Column) -> Column:
    return F.when(value > 0, F.log(value))


def abs_log_ratio(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return F.abs(F.log(F.greatest(a, F.lit(floor))) - F.log(F.greatest(b, F.lit(floor))))


def clipped_exp(log_ttc: Column, low: float = LOW_TTC, high: float = HIGH_TTC) -> Column:
    """exp of a log prediction, clamped first so that it cannot overflow."""
    return F.when(log_ttc.isNotNull(), F.exp(F.greatest(F.log(F.lit(low)), F.least(F.log(F.lit(high)), log_ttc))))


def fallback_ttc(diagonal: Column, n_events: Column, mean_surface: Column, scale: float = 0.117) -> Column:
    """Time to contact from the box's size and the events' density, within [0.05, 20]."""
    density = F.log1p(F.greatest(F.lit(1), n_events)) * F.greatest(F.lit(0.05), mean_surface)
    return F.greatest(F.lit(0.05), F.least(F.lit(20.0), scale * diagonal / density))


def policy(name: str, family: Column, quantile: dict[int, Column]) -> Column:
    """A policy's pick among candidate quantiles."""
    picks, rest = POLICIES[name]
    out = F
    for f, q in picks.items():
        out = out.when(family == f, quantile[q])
    return out.otherwise(quantile[rest])


def phase_rules(fraction: Column, area_ratio: Column, q: dict[int, Column]) -> dict[str, Column]:
    """Hand rules: quantiles by place in the sequence, and by growth of the box."""
    early, late = fraction <= 0.33, fraction >= 0.67
    grows, steady = (fraction <= 0.35) & (area_ratio >= 1.35), (fraction >= 0.60) & area_ratio.between(0.80, 1.30)
    out = {f"all_q{k}": q[k] for k in (10, 25, 50)}
    for k in (50, 65):
        out[f"phase_early_q{k}_late_q10"] = F.when(early, q[k]).when(late, q[10]).otherwise(q[25])
        out[f"area_phase_q{k}_q10"] = F.when(grows, q[k]).when(steady, q[10]).otherwise(q[25])
    return out


def compare_bucket(before: Column, after: Column, delta: Column, cue_ratio: Column, low_support: Column, points: float = 15.0, ratio: float = 0.55, stable: float = 5.0) -> Column:
    """Why a second estimator's error differs from the first's by ``delta`` points."""
    fell_back = after == "OK_FALLBACK"
    return ladder(
        [
            ((before == "OK") & fell_back & (delta >= points), "GUARD_FALSE_REJECT"), (fell_back & (delta <= -points), "FALLBACK_WIN_BIG"), (cue_ratio < ratio, "CUE_UNDERESTIMATE"), (low_support, "LOW_SUPPORT"),
            ((before == "OK_FALLBACK") & fell_back & (F.abs(delta) <= stable), "STABLE_FALLBACK"),
        ],
        "OTHER",
    )


def compare_flags(before: Column, after: Column, delta: Column, cue_ratio: Column, low_support: Column, points: float = 15.0, ratio: float = 0.55) -> Column:
    """All signs that hold, joined by '|'."""
    signs = [((before == "OK") & (after == "OK_FALLBACK"), "GUARD_SWITCH"), (delta <= -points, "BIG_IMPROVEMENT"), (delta >= points, "BIG_REGRESSION"), (cue_ratio < ratio, "CUE_UNDERESTIMATE"), (low_support, "LOW_SUPPORT")]
    return F.concat_ws("|", *[F.when(c, n) for c, n in signs])


def boundary_class(family: Column, n: Column, max_fit: Column, iqr: Column, spread: Column, events: Column, collapses: Column, ratio_prev: Column, ratio_med5: Column, disagreement: Column, few_events: Column, wide_models: Column) -> Column:
    """What kind of case lies at a gate's boundary."""
    return ladder(
        [
            (family.isin("CURGUARD", "HISTGUARD") | (collapses > 0) | (ratio_prev < 0.25), "bbox_collapse_or_guard"), ((n < 8) | (max_fit < 3), "low_candidate_support"), ((iqr >= 0.55) | (spread >= 1.20), "candidate_disagreement"),
            (disagreement >= wide_models, "model_disagreement"), (events <= few_events, "low_event_observability"), ((family == "PHASESTABLE") | (ratio_med5 <= 1.05), "stable_low_growth"),
            (family.isin("PHASEEARLY", "PHASEGROWTH", "PHASELATE"), "phase_specific_geometry"),
        ],
        "other_geometry_residual",
    )


def observability_class(kept: Column, low: Column, error: Column, iqr: Column, models: Column, smooth: Column, events: Column, points: Column, collapses: Column, at: dict[str, Column]) -> Column:
    """Why a row was rejected, or how well a kept one did."""
    out, bad, fair = ~kept, kept & (error >= 15), kept & (error >= 7)
    return ladder(
        [
            (out & low & (events <= at["events"]), "rejected_low_event_observability"), (out & (collapses > 0), "rejected_bbox_collapse_history"), (out & (iqr >= at["iqr"]), "rejected_candidate_disagreement"),
            (out & (models >= at["models"]), "rejected_model_disagreement"), (out & (smooth >= at["smooth"]), "rejected_smoothing_disagreement"), (out & low, "rejected_low_observability_family"), (out, "rejected_general_confidence"),
            (bad & low & (points <= at["points"]), "kept_high_error_sparse_fit"), (bad & (smooth >= at["smooth"]), "kept_high_error_smoothing_bias"), (bad & low, "kept_high_error_low_observability_family"),
            (bad, "kept_high_error_model_residual"), (fair & low, "kept_moderate_error_low_observability_family"), (fair, "kept_moderate_error"),
        ],
        "kept_good",
    )


def box_aux(status: Column, ttc: Column, confidence: Column) -> dict[str, Column]:
    """log_ttc, valid (1 or 0) and confidence of a box estimate; zeros where it is no good one."""
    valid = F.coalesce(status.startswith("OK") & ~F.isnan(ttc) & (ttc > 0) & (ttc < float("inf")), F.lit(False))
    return {"log_ttc": F.when(valid, F.log(F.greatest(ttc, F.lit(1e-6)))).otherwise(0.0), "valid": F.when(valid, 1.0).otherwise(0.0), "confidence": F.when(valid, F.coalesce(confidence, F.lit(0.0))).otherwise(0.0)}


#: Columns derived from the truth, which no learner may read.
FROM_TRUTH = (
    "gt_ttc_s", "e_ttc_pct", "pred_over_gt", "is_high_error", "is_severe_error", "primary_failure_type", "diagnostic_group", "gt_bucket", "best_quantile_key", "best_quantile_e_ttc_pct",
    "candidate_q05_e_ttc_pct", "candidate_q10_e_ttc_pct", "candidate_q15_e_ttc_pct", "candidate_q25_e_ttc_pct", "candidate_q35_e_ttc_pct", "candidate_q50_e_ttc_pct", "candidate_q65_e_ttc_pct", "candidate_q75_e_ttc_pct",
    "candidate_q90_e_ttc_pct", "v11_e_ttc_pct", "v11_pred_over_gt", "flags",
)
#: The same by this engine's own names.
OWN_FROM_TRUTH = ("truth", "error", "error_pct", "over", "failure", "bucket", "kept_error")


def without_truth(columns: Sequence[str]) -> list[str]:
    """The columns that a learner may read, in order."""
    return [c for c in columns if c not in FROM_TRUTH and c not in OWN_FROM_TRUTH]


#: What a model of a kind on features of a mode is called.
VARIANT_LABELS = {
    ("ridge", "stats_metadata"): "RidgeStatsMetaV1", ("ridge", "pooled_image_stats_metadata"): "RidgePooledV1", ("mlp", "stats_metadata"): "TinyMlpStatsMetaV1", ("mlp", "pooled_image_stats_metadata"): "TinyMlpPooledV1",
    ("cnn", "image_only"): "TinyCnnImageOnlyV1", ("cnn", "image_stats_metadata"): "TinyCnnStatsMetaV1", ("cnn", "image_late_fusion_stats_metadata"): "TinyCnnLateFusionV1", ("cnn", "image_residual_stats_metadata"): "TinyCnnResidualFusionV1",
}


def variant_label(model: str, mode: str) -> str:
    """The label of a model's variant; an error names the modes that the model takes, or that there is no such model."""
    if (model, mode) in VARIANT_LABELS:
        return VARIANT_LABELS[model, mode]
    modes = sorted(m for k, m in VARIANT_LABELS if k == model)
    raise ValueError(f"{model!r} takes the modes {modes}, not {mode!r}" if modes else f"no model {model!r}")
