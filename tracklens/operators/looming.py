"""Time to contact from trailing linear trends of box sizes, in thirteen variants.

Every sample carries the boxes it looks back on, thirteen at most, in one array: one
window gathers it.  Sub-windows, lines and quantiles come from batches of such rows (``fits``), the
rest are expressions in the row.  Sequences are dealt by blocks of labels, so a long one spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fits

#: The cues as statuses name them, in order.
CUES = ("width", "height", "diag", "sqrt_area", "bottom_offset")
#: Thresholds of the quality gate and the guards.
MIN_REF, MIN_SLOPE, MIN_TTC = 3.0, 1.0, 0.05
MIN_CANDIDATES, MIN_FIT, MAX_DISPERSION, COLLAPSE = 30, 6, 0.7, 0.2


@dataclass(frozen=True)
class Variant:
    back: int = 12
    max_ttc: float = 16.0
    mode: str = "multi"  # width, rel_slope or multi
    bottom: bool = True
    gate: str = ""  # "", reject, adaptive or adaptive_v2
    current_guard: bool = False
    history_guard: str = ""  # "", always or low_conf
    reject: bool = False
    phases: int = 0  # 0 none, 1 early and late, 2 growth and stable too


#: The variants.
VARIANTS = {
    1: Variant(7, 20.0, "width", False),
    2: Variant(7, 20.0, "rel_slope", False),
    3: Variant(12, 15.0, "multi", False),
    4: Variant(),
    5: Variant(gate="reject"),
    6: Variant(gate="adaptive"),
    7: Variant(gate="adaptive_v2"),
    8: Variant(gate="adaptive_v2", current_guard=True),
    9: Variant(gate="adaptive_v2", current_guard=True, history_guard="always"),
    10: Variant(gate="adaptive_v2", current_guard=True, history_guard="low_conf"),
    11: Variant(gate="adaptive_v2", current_guard=True, history_guard="low_conf", reject=True),
    12: Variant(gate="adaptive_v2", current_guard=True, history_guard="low_conf", reject=True, phases=1),
    13: Variant(gate="adaptive_v2", current_guard=True, history_guard="low_conf", reject=True, phases=2),
}


#: Labels of a sequence that one task takes at a time.
BLOCK = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _median(values: Column) -> Column:
    """Of a small array."""
    at = lambda o, k: F.get(o, F.floor((F.size(o) - k) / 2).cast("int"))
    return _let(F.sort_array(values), lambda o: F.when(F.size(o) > 0, (at(o, 1) + at(o, 0)) / 2))


def _quantile(ordered: Column, q: float) -> Column:
    """Of a sorted array, interpolated."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (at - F.floor(at)) * (high - low)


def with_history(tracks: DataFrame, back: int) -> DataFrame:
    """One sample per box: seq, start, query_t, frac (place in the sequence) and hist,
    the boxes (label_id, ts, w, h, area) of labels in [start - back, start] in order.

    Boxes are dealt by (seq, block of labels), those at a block's end to the next
    block, too; a block's first place comes from the counts of the blocks before.
    """
    if back >= BLOCK:
        raise ValueError(f"a history of at most {BLOCK - 1} labels is needed")
    block = F.floor(F.col("label_id") / BLOCK)
    sizes = tracks.groupBy("seq", block.alias("block")).agg(F.count("*").alias("c"))
    of_seq = Window.partitionBy("seq")  # one row a block
    before = F.sum("c").over(of_seq.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("seq", "block", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(of_seq).alias("n_seq"))
    near_end = F.pmod(F.col("label_id"), F.lit(BLOCK)) >= BLOCK - back
    dealt = tracks.select("seq", "label_id", "ts", "w", "h", "area", F.explode(F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    # By number, as the work on a row is large beside its bytes.
    dealt = dealt.repartition(int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq", "block")
    order = Window.partitionBy("seq", "block").orderBy("label_id")
    hist = F.collect_list(F.struct("label_id", "ts", "w", "h", "area")).over(order.rangeBetween(-back, 0))
    own = F.col("block") == block
    place = F.sum(own.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = dealt.select("seq", "block", F.col("label_id").alias("start"), F.col("ts").alias("query_t"), hist.alias("hist"), place.alias("place"), own.alias("own")).where("own")
    frac = F.when(F.col("n_seq") > 1, (F.col("before") + F.col("place")) / (F.col("n_seq") - 1))
    return rows.join(sizes, ["seq", "block"]).select("seq", "start", "query_t", frac.alias("frac"), "hist")


def _collapsed() -> Column:
    """The sample's own area falls below COLLAPSE of the median over the labels in
    [start - 5, start - 1], of which there are three at least."""
    recent = F.transform(F.filter("hist", lambda b: b["label_id"].between(F.col("start") - 5, F.col("start") - 1)), lambda b: b["area"])
    return _let(recent, lambda r: (F.size(r) >= 3) & F.coalesce(F.element_at("hist", -1)["area"] / _median(r) < COLLAPSE, F.lit(False)))


def current_collapse(tracks: DataFrame) -> DataFrame:
    """seq, start and collapsed of every box."""
    return with_history(tracks, 5).select("seq", "start", _collapsed().alias("collapsed"))


def sample_frame(tracks: DataFrame) -> DataFrame:
    """One sample per box: seq, start, query_t, frac."""
    return with_history(tracks, 0).drop("hist")


def histories(tracks: DataFrame, variant: Variant) -> DataFrame:
    """with_history with cur_guard (the current box collapsed and is left out) and
    dropped in each box: the history guard says so."""
    df = with_history(tracks, variant.back).withColumn("cur_guard", _collapsed() if variant.current_guard else F.lit(False))
    guarded = F.when(F.col("cur_guard"), F.slice("hist", F.lit(1), F.size("hist") - 1)).otherwise(F.col("hist"))

    def marked(b: Column, i: Column, areas: Column) -> Column:
        sides = F.struct(F.slice(areas, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))).alias("left"), F.slice(areas, i + 2, F.lit(2)).alias("right"))
        low = lambda s: (F.size(s["left"]) > 0) & (F.size(s["right"]) > 0) & F.coalesce(b["area"] / _median(F.concat(s["left"], s["right"])) < COLLAPSE, F.lit(False))
        return F.struct(*[b[c].alias(c) for c in ("label_id", "ts", "w", "h", "area")], _let(sides, low).alias("dropped"))

    areas = lambda h: F.transform(h, lambda b: b["area"])
    return df.withColumn("hist", _let(guarded, lambda h: _let(areas(h), lambda a: F.transform(h, lambda b, i: marked(b, i, a)))))


def _cues(b: Column) -> list[Column]:
    return [b["w"], b["h"], F.sqrt(b["w"] * b["w"] + b["h"] * b["h"]), F.sqrt(F.greatest(b["area"], F.lit(1e-6))), b["h"] / 2]


def _lines(variant: Variant) -> tuple[list[int], int, tuple[float, float, float, float]]:
    """A variant's windows, its number of cues, and the limits of candidates."""
    return list(range(2 if variant.mode == "multi" else variant.back, variant.back + 1)), 5 if variant.bottom else 4, (MIN_SLOPE, MIN_REF, MIN_TTC, variant.max_ttc)


def with_candidates(rows: DataFrame, variant: Variant, kept_only: bool = False, into: str = "cands") -> DataFrame:
    """rows plus the candidates from each history, or from what the history guard keeps of it."""
    return fits.with_candidates(rows, into, kept_only, *_lines(variant))


def candidates(rows: DataFrame, variant: Variant) -> DataFrame:
    """(seq, start, back, ord, fit_points, slope, ref, ttc), one row per candidate."""
    return with_candidates(rows, variant).select("seq", "start", F.explode("cands").alias("c")).select("seq", "start", "c.*")


QUANTILES = {"q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90}


def with_stats(rows: DataFrame, cands: str = "cands", prefix: str = "", quantiles: dict[str, float] | None = None) -> DataFrame:
    """rows plus counts and exact quantiles of the candidates; n is null where there is none.

    The statistics come out of a generator of one row, so that filters on what is
    derived from them read these columns and don't repeat the fits.
    """
    def stats(ordered: Column) -> Column:
        some = F.when(F.size(ordered) > 0, F.size(ordered).cast("bigint"))
        fits = F.array_max(F.transform(cands, lambda c: c["fit_points"]))
        return F.struct(some.alias("n"), fits.alias("max_fit"), F.get(ordered, F.lit(0)).alias("low"), *[_quantile(ordered, q).alias(k) for k, q in (quantiles or QUANTILES).items()])

    names = ["n", "max_fit", "low", *(quantiles or QUANTILES)]
    ordered = F.sort_array(F.transform(cands, lambda c: c["ttc"]))
    df = rows.select("*", F.inline(F.transform(F.array(ordered), stats)).alias(*[f"{prefix}{x}" for x in names]))
    if quantiles is not None:
        return df
    middle = F.greatest(F.abs(f"{prefix}q50"), F.lit(1e-6))
    of = lambda k: F.col(f"{prefix}{k}")
    return df.withColumns({f"{prefix}iqr": (of("q75") - of("q25")) / middle, f"{prefix}spread": (of("q90") - of("q10")) / middle})


def _gates(version: str) -> Column:
    """The gate that a sample's candidates trip, as struct(name, suffix, q), or null."""
    near = F.col("q25") / F.col("low")
    gate = lambda name, suffix, q: F.struct(F.lit(name).alias("name"), F.lit(suffix).alias("suffix"), F.lit(q).alias("pick"))
    few, flat, wide = F.col("n") < MIN_CANDIDATES, F.col("max_fit") < MIN_FIT, F.col("iqr") > MAX_DISPERSION
    if version == "adaptive_v2":
        spike, short = (F.col("low") <= 0.5) & (near <= 3), (F.col("low") <= 0.4) & (near >= 5)
        return F.when(few & spike, gate("CANDIDATES", "_LOWCANDSPIKE", 75)).when(few, gate("CANDIDATES", "_LOWCAND", 25)).when(flat, gate("FIT_POINTS", "_LOWFIT", 50)).when(wide & short, gate("DISPERSION", "_DISPSHORT", 25)).when(wide, gate("DISPERSION", "_DISP", 50))
    return F.when(few, gate("CANDIDATES", "_LOWCAND", 25)).when(flat, gate("FIT_POINTS", "_LOWFIT", 50)).when(wide, gate("DISPERSION", "_DISP", 50))


def _phase(level: int) -> Column:
    """Suffix and quantile by the phase of the sequence, as struct, or null."""
    frac, ratio, iqr = F.col("frac"), F.col("ratio"), F.col("iqr")
    phase = lambda suffix, q: F.struct(F.lit(suffix).alias("suffix"), F.lit(q).alias("pick"))
    out = F.when((frac <= 0.35) & (iqr >= 0.40) & (F.col("spread") >= 0.80), phase("_PHASEEARLY", 50))
    if level > 1:
        out = out.when((frac <= 0.50) & (ratio >= 1.10) & (iqr >= 0.30), phase("_PHASEGROWTH", 50)).when((frac >= 0.20) & (ratio <= 1.05) & (iqr <= 0.55), phase("_PHASESTABLE", 10))
    return out.when((frac >= 0.50) & ratio.isNotNull() & (iqr <= 0.35), phase("_PHASELATE", 10))


#: Ways to select one cue's fit: of these, all but the first compare the fits, the first cue of equals winning.
SELECTORS = ("width", "lowest_residual", "score_rel_slope_over_resid", "highest_rel_slope")


def with_selected(rows: DataFrame, selector: str) -> DataFrame:
    """rows (histories with candidates of one window) plus status, ttc and the fit that ``selector`` takes:
    fit_points, slope, ref, residual (root mean square about the line, over the size) and rel_slope (slope over size).

    Without a candidate the status is BBOX_FIT_FAIL, without the width's BBOX_WIDTH_UNAVAILABLE where that is asked for,
    and BBOX_UNKNOWN_CUE_MODE with the name where no such selector is; then there is no time.
    """
    def judged(c: Column) -> Column:
        away = F.transform("hist", lambda b: F.pow(F.get(F.array(*_cues(b)), c["ord"]) - c["ref"] - c["slope"] * (b["ts"] - F.col("query_t")), F.lit(2)))
        residual = F.sqrt(F.aggregate(away, F.lit(0.0), lambda a, x: a + x) / F.size("hist"))
        size = F.greatest(F.abs(c["ref"]), F.lit(1e-6))
        return F.struct(c["ord"].alias("ord"), c["ttc"].alias("ttc"), c["fit_points"].alias("fit_points"), c["slope"].alias("slope"), c["ref"].alias("ref"), (residual / size).alias("residual"), (c["slope"] / size).alias("rel_slope"))

    # Compared to twelve places (scores, up to thousands, to six), so that equal fits are equal.
    rank = {
        "width": lambda c: F.lit(0.0), "lowest_residual": lambda c: F.round(c["residual"], 12), "highest_rel_slope": lambda c: F.round(-c["rel_slope"], 12),
        "score_rel_slope_over_resid": lambda c: F.round(-c["rel_slope"] / F.greatest(c["residual"], F.lit(1e-4)), 6),
    }.get(selector, lambda c: F.lit(0.0))
    fits = F.transform("cands", judged)
    asked = F.filter(fits, lambda c: c["ord"] == 0) if selector == "width" else F.filter(fits, lambda c: F.lit(selector in SELECTORS))
    best = F.array_min(F.transform(asked, lambda c: F.struct(rank(c).alias("rank"), c["ord"].alias("ord"), c.alias("fit"))))["fit"]
    df = rows.select("*", F.inline(F.array(F.struct(best.alias("best")))))
    named = F.concat(F.lit("OK_BBOX_"), F.upper(F.get(F.array(*map(F.lit, CUES)), F.col("best.ord"))))
    none = F.lit("BBOX_WIDTH_UNAVAILABLE") if selector == "width" else F.lit(f"BBOX_UNKNOWN_CUE_MODE:{selector}") if selector not in SELECTORS else F.lit("BBOX_FIT_FAIL")
    status = F.when(F.size("hist") < 2, "BBOX_HISTORY_TOO_SHORT").when(F.size("cands") == 0, "BBOX_FIT_FAIL").when(F.col("best").isNull(), none).otherwise(named)
    long_enough = lambda c: F.when(F.size("hist") >= 2, F.col(f"best.{c}")).alias(c)
    return df.select(*rows.columns, status.alias("status"), *[long_enough(c) for c in ("ttc", "fit_points", "slope", "ref", "residual", "rel_slope")])


def estimate(tracks: DataFrame, number: int) -> DataFrame:
    """seq, start, status and ttc of every sample, by variant ``number``."""
    return estimated(tracks, VARIANTS[number]).select("seq", "start", "status", "ttc")


def estimates(tracks: DataFrame, numbers: tuple[int, ...]) -> DataFrame:
    """seq, start, query_t and, for each variant, v<number>: its status and ttc.  The variants differ in gates and guards alone, so that lines are fitted once for all."""
    vs = [VARIANTS[n] for n in numbers]
    if len({(v.mode, *map(str, _lines(v))) for v in vs}) > 1 or vs[0].mode != "multi":
        raise ValueError("these variants have candidates of their own")
    df = fitted(tracks, vs)
    for n, v in zip(numbers, vs, strict=True):
        df = judged(df, v).select(*df.columns, F.struct("status", "ttc").alias(f"v{n}"))
    return df.select("seq", "start", "query_t", *[f"v{n}" for n in numbers])


def fitted(tracks: DataFrame, variants: list[Variant], more: dict[str, float] | None = None, keep: bool = False) -> DataFrame:
    """One sample per box with the statistics that the variants (of many windows, alike in their lines) read, see ``fits.with_statistics``;
    with ``more`` also those quantiles of the candidates from all boxes, with ``keep`` also hist."""
    sets: dict[tuple[bool, bool], dict[str, float]] = {}
    if more:
        sets[False, False] = dict(more)
    for v in variants:
        for kept in (False, True) if v.history_guard else (False,):
            sets[v.current_guard, kept] = sets.get((v.current_guard, kept), {}) | QUANTILES
    v = variants[0]
    sets = {s: sets[s] for s in sorted(sets)}
    return fits.with_statistics(with_history(tracks, v.back), sets, *_lines(v), COLLAPSE, keep)


def estimated(tracks: DataFrame, v: Variant, chosen: bool = False) -> DataFrame:
    """Every sample with status and ttc and, in the variants of many windows, the candidates' statistics.

    With ``chosen``, of those seq, start, query_t, status, ttc, n_rows and the guards alone, and fit_points, slope and ref of the candidate
    nearest to ttc (of equals that of the shortest window, then of the first cue)."""
    if v.mode != "multi":
        df = with_candidates(histories(tracks, v), v).withColumns({"n_rows": F.size("hist"), "n_kept": F.size(F.filter("hist", lambda b: ~b["dropped"]))})
        return with_selected(df, "width" if v.mode == "width" else "highest_rel_slope")
    df = judged(fitted(tracks, [v], keep=chosen), v)
    if chosen:
        df = fits.with_nearest(df.select("seq", "start", "query_t", "status", "ttc", "n_rows", "cur_guard", "hist_guard", "hist"), *_lines(v), COLLAPSE)
    return df


def judged(rows: DataFrame, v: Variant) -> DataFrame:
    """Samples with the statistics of ``fitted`` plus a variant's status and ttc, and what they come from: n_rows, n_kept, ratio,
    cur_guard, hist_guard, and n, max_fit, low, quantiles, iqr and spread of the boxes that it uses."""
    def stats(p: str) -> dict[str, Column]:
        out = {c: F.col(f"{p}{c}") for c in ("n", "max_fit", "low", *QUANTILES)}
        middle = F.greatest(F.abs(out["q50"]), F.lit(1e-6))
        return out | {"iqr": (out["q75"] - out["q25"]) / middle, "spread": (out["q90"] - out["q10"]) / middle}

    def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """df with columns that come out of a generator of one row, so that what reads or filters them doesn't repeat them."""
        return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))))

    p = fits.prefix(v.current_guard, False)
    df = rows.withColumns({"cur_guard": F.col("collapsed") if v.current_guard else F.lit(False), "n_rows": F.col(f"{p}n_rows"), "n_kept": F.col(f"{p}n_kept"), "ratio": F.col(f"{p}ratio")})
    own, used = stats(p), F.lit(False)
    if v.history_guard:
        kept = stats(fits.prefix(v.current_guard, True))
        used = F.col("n_kept") < F.col("n_rows")
        if v.history_guard != "always":
            poor = (own["n"] < MIN_CANDIDATES) | (own["max_fit"] < MIN_FIT) | (own["iqr"] > MAX_DISPERSION)
            used = F.coalesce(poor & used & kept["n"].isNotNull(), F.lit(False))
        df = once(df, {"hist_guard": used})
        own = {c: F.when(F.col("hist_guard"), kept[c]).otherwise(x) for c, x in own.items()}
    else:
        df = df.withColumn("hist_guard", used)
    df = once(df, own)
    df = once(df, {"gate": _gates(v.gate) if v.gate else F.lit(None).cast("struct<name:string,suffix:string,pick:int>")})
    calm = F.col("gate").isNull() & ~F.col("cur_guard") & ~F.col("hist_guard")
    df = once(df, {"phase": F.when(calm, _phase(v.phases)) if v.phases else F.lit(None).cast("struct<suffix:string,pick:int>")})
    guard = F.concat(F.when(F.col("cur_guard"), "_CURGUARD").otherwise(""), F.when(F.col("hist_guard"), "_HISTGUARD").otherwise(""))
    pick = F.coalesce("gate.pick", "phase.pick", F.lit(25))
    suffix = F.concat(F.coalesce("gate.suffix", "phase.suffix", F.lit("")), guard)
    ok = F.concat(F.lit("OK_BBOX_MULTI_Q"), pick.cast("string"), suffix)
    short = F.when(F.col("cur_guard"), "BBOX_CURRENT_COLLAPSE_GUARD_NO_HISTORY").otherwise("BBOX_HISTORY_TOO_SHORT")
    status = F.when(F.col("n_rows") < 2, short)
    if v.history_guard == "always":
        status = status.when(F.col("n_kept") < 2, "BBOX_HISTORY_COLLAPSE_GUARD_NO_HISTORY")
    status = status.when(F.col("n").isNull(), "BBOX_FIT_FAIL")
    if v.gate == "reject" or v.reject:
        tail = "_REJECTED" if v.reject else ""
        status = status.when(F.col("gate").isNotNull(), F.concat(F.lit("BBOX_LOW_QUALITY_"), F.col("gate.name"), F.lit(tail)))
    status = status.otherwise(ok)
    value = F.when(pick == 10, F.col("q10")).when(pick == 25, F.col("q25")).when(pick == 50, F.col("q50")).otherwise(F.col("q75"))
    df = once(df, {"status": status, "value": value})
    return once(df, {"ttc": F.when(F.col("status").startswith("OK"), F.col("value"))}).drop("value")


def with_fallback(rows: DataFrame) -> DataFrame:
    """Estimates (status, ttc, truth) beside another predictor's (fallback, fell): the own estimate, else the
    other's as OK_LTS_FALLBACK, else the other's status or, without one, the own; nothing where there is no truth."""
    own, other = F.col("ttc").isNotNull(), F.col("fallback").isNotNull() & F.col("fell").startswith("OK")
    status = F.when(F.col("truth").isNull(), "GT_INVALID").when(own, F.col("status")).when(other, "OK_LTS_FALLBACK").otherwise(F.coalesce("fell", "status"))
    return rows.withColumns({"status": status, "ttc": F.when(F.col("truth").isNotNull(), F.coalesce("ttc", "fallback"))})


def records(rows: DataFrame, back: int) -> DataFrame:
    """What a run writes of each sample: rows (status, ttc, fit_points, slope, ref of the box estimate, n_rows, truth, and of
    the other predictor fallback, fell and fell_confidence) with status and ttc of ``with_fallback`` plus
    error_pct, confidence, fallback_ttc and debug_ref.

    An own estimate is the surer the more of the back + 1 boxes its fit had, at most 1; otherwise the other predictor's
    confidence counts.  debug_ref tells the fit, or both statuses where the other predictor was asked, or the boxes there
    were where there is none; it is empty without truth.
    """
    out = with_fallback(rows.withColumn("own", F.col("status")).withColumn("own_ttc", F.col("ttc")))
    known, own, other = F.col("truth").isNotNull(), F.col("own_ttc").isNotNull(), F.col("fell").isNotNull()
    share = F.least(F.lit(1.0), F.col("fit_points") / F.lit(float(max(back + 1, 1))))
    text = F.when(~known, "").when(own, F.format_string("fit_points=%d;slope_px_per_s=%.6f;width_ref_px=%.6f", "fit_points", "slope", "ref"))
    text = text.when(other, F.concat(F.lit("bbox_status="), "own", F.lit(";fallback_status="), "fell")).otherwise(F.concat(F.lit("fit_points="), F.col("n_rows").cast("string")))
    return out.withColumns({
        "error_pct": F.when(F.col("truth") > 0, F.abs(F.col("ttc") - F.col("truth")) / F.col("truth") * 100), "confidence": F.when(known & own, share).when(known, F.col("fell_confidence")),
        "fallback_ttc": F.when(known & ~own, F.col("fallback")), "debug_ref": text,
    }).drop("own", "own_ttc", "fallback", "fell_confidence")
