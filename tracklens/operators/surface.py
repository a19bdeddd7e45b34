"""Events to per-pixel time surfaces, grid statistics, confidence and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import interval_join

#: Targets, weights and gates of the local confidence.
TARGET_EVENTS, FRESH_LOW, FRESH_HIGH = 8.0, 0.05, 0.65
WEIGHTS = {"event": 0.35, "occupancy": 0.30, "fresh": 0.35}
SELECT_FROM = 0.55


def roi(df: DataFrame, width: int = 100, height: int = 100, pad: int = 0) -> DataFrame:
    """Half-open pixel bounds rx0, ry0, rx1, ry1 of the box, clipped to the sensor; empty ones drop out."""
    out = df.withColumns({
        "rx0": F.greatest(F.lit(0), F.floor("x1") - pad), "ry0": F.greatest(F.lit(0), F.floor("y1") - pad),
        "rx1": F.least(F.lit(width), F.ceil("x2") + pad), "ry1": F.least(F.lit(height), F.ceil("y2") + pad),
    })
    return out.where("rx1 > rx0 AND ry1 > ry0")


def in_roi(events: DataFrame, intervals: DataFrame, slot: int) -> DataFrame:
    """Events of each interval inside its region of interest."""
    joined = interval_join(events, roi(intervals), slot)
    return joined.where((F.col("x") >= F.col("rx0")) & (F.col("x") < F.col("rx1")) & (F.col("y") >= F.col("ry0")) & (F.col("y") < F.col("ry1")))


def in_closed_region(events: DataFrame, intervals: DataFrame, slot: int, width: int = 100, height: int = 100, pad: int = 0) -> DataFrame:
    """Events of each interval inside its padded box, both bounds included and clipped to the sensor's last pixel."""
    joined = interval_join(events, intervals, slot)
    across = F.col("x").between(F.greatest(F.lit(0), F.floor("x1") - pad), F.least(F.lit(width - 1), F.ceil("x2") + pad))
    return joined.where(across & F.col("y").between(F.greatest(F.lit(0), F.floor("y1") - pad), F.least(F.lit(height - 1), F.ceil("y2") + pad)))


def last_events(rows: DataFrame, n: int) -> DataFrame:
    """The n latest rows of each interval; of equal times those of greater event_id."""
    order = Window.partitionBy("seq", "idx").orderBy(F.desc("t_us"), F.desc("event_id"))
    return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place")


def time_surface(rows: DataFrame, tau_us: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per pixel (and extra keys): count, last time, and decay since then at the interval's end; the box and its region go along."""
    keys = ["seq", "idx", *extra, "x", "y"]
    out = rows.groupBy(*keys, "hi", "rx0", "ry0", "rx1", "ry1", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))
    return out.withColumn("surface", F.exp(-(F.col("hi") - F.col("last_us")) / F.lit(float(tau_us))))


def _cell(offset: Column, size: Column, k: int) -> Column:
    """Cell of a grid with edges floor(i * size / k)."""
    return sum((F.when(offset >= F.floor(F.lit(i) * size / k), 1).otherwise(0) for i in range(1, k)), F.lit(0))


def _cell_area(h: Column, w: Column, k: int) -> Column:
    """Pixels of the cell (row, col) of such a grid."""
    edge = lambda i, n: F.floor(i * n / k)
    return (edge(F.col("row") + 1, h) - edge(F.col("row"), h)) * (edge(F.col("col") + 1, w) - edge(F.col("col"), w))


def region_stats(surface: DataFrame, regions: DataFrame) -> DataFrame:
    """regions plus n events, active pixels, occupancy and mean surface; zeros where an interval has no event in its region."""
    sums = surface.groupBy("seq", "idx").agg(F.sum("n").alias("n"), F.count("*").alias("active"), F.avg("surface").alias("mean"))
    area = (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))
    return regions.join(sums, ["seq", "idx"], "left").fillna(0, ["n", "active", "mean"]).withColumn("occupancy", F.col("active") / area)


def grid_stats(surface: DataFrame, regions: DataFrame, k: int = 3) -> DataFrame:
    """All k * k cells of each region (of ``roi``): events, active pixels, ratio, mean, max and min surface; empty cells are zeros."""
    h, w = F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0")
    cells = surface.withColumns({"row": _cell(F.col("y") - F.col("ry0"), h, k), "col": _cell(F.col("x") - F.col("rx0"), w, k)})
    have = cells.groupBy("seq", "idx", "row", "col").agg(
        F.sum("n").alias("events"), F.count("*").alias("active"), F.avg("surface").alias("mean"), F.max("surface").alias("top"), F.min("surface").alias("low")
    )
    dense = regions.select("seq", "idx", "rx0", "ry0", "rx1", "ry1").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = dense.withColumn("area", _cell_area(h, w, k)).join(have, ["seq", "idx", "row", "col"], "left").fillna(0, ["events", "active", "mean", "top", "low"])
    return out.withColumn("ratio", F.col("active") / F.greatest(F.col("area"), F.lit(1))).select("seq", "idx", "row", "col", "events", "active", "ratio", "mean", "top", "low")


def active_cells(surface: DataFrame, unit_us: float, k: int = 3) -> DataFrame:
    """The cells of ``grid_stats`` that have events (events, active, ratio and mean), with the sums of the fit of ``expansion_cues``:
    the surface is grouped once for grid, region and cues."""
    h, w = F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0")
    cells = surface.withColumns({"row": _cell(F.col("y") - F.col("ry0"), h, k), "col": _cell(F.col("x") - F.col("rx0"), w, k)}).withColumn("area", _cell_area(h, w, k))
    have = cells.groupBy("seq", "idx", "row", "col", "area").agg(F.sum("n").alias("events"), F.count("*").alias("active"), F.avg("surface").alias("mean"), *_sums(*_away(unit_us), F.col("surface")))
    return have.withColumn("ratio", F.col("active") / F.greatest(F.col("area"), F.lit(1))).drop("area")


def count_frames(rows: DataFrame, width: int = 100, height: int = 100, flip_x: bool = False, flip_y: bool = False, above: int = 0, log: bool = False) -> DataFrame:
    """seq, idx, x, y, n and brightness (0 to 255) of every pixel that has events in its window.

    Coordinates are mirrored if asked, then those off the sensor are left out.  Counts of at most ``above`` are dark (n is 0);
    the others are brightest at the window's greatest count, by share or by share of logs, in single precision, cut to whole numbers.
    A window has at most width * height pixels, counted before they meet.
    """
    if above < 0:
        raise ValueError("a count cannot lie above a negative one only")
    x, y = (F.lit(width - 1) - F.col("x") if flip_x else F.col("x")), (F.lit(height - 1) - F.col("y") if flip_y else F.col("y"))
    placed = rows.select("seq", "idx", x.alias("x"), y.alias("y")).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    counts = placed.groupBy("seq", "idx", "x", "y").agg(F.count("*").alias("n"))
    counts = counts.withColumn("n", F.when(F.col("n") > above, F.col("n")).otherwise(0)) if above else counts
    counts = counts.withColumn("top", F.max("n").over(Window.partitionBy("seq", "idx")))
    share = F.log1p("n").cast("float") / F.log1p("top") if log else (F.col("n") / F.col("top")).cast("float")
    scaled = (share * F.lit(255.0)) if log else (share * F.lit(255.0).cast("float"))
    return counts.select("seq", "idx", "x", "y", "n", F.when(F.col("top") == 0, 0).otherwise(F.floor(scaled)).cast("int").alias("brightness"))


def payload(regions: DataFrame, cells: DataFrame, selected: DataFrame, tau_us: int, components: bool = True) -> DataFrame:
    """seq, idx and payload, the nested summary of each region: its box, counts and surface, the grids of its cells
    as rows of rows, and its confidence with the chosen cells in row order.

    ``regions`` are of ``region_stats``, ``cells`` of ``local_confidence``, ``selected`` of ``selected_cells``.  With
    ``components``, the confidence has the grids of its three scores and of activity, too.
    """
    keys = ["seq", "idx"]
    values = {
        "event_count": F.col("events"), "occupancy_ratio": F.col("ratio").cast("double"), "mean_surface": F.col("mean"), "confidence": F.col("conf"), "active": (F.col("active") > 0).cast("int"),
        "event_score": log_score(F.col("events"), TARGET_EVENTS), "occupancy_score": band_score(F.col("ratio"), 0.0, 0.05), "freshness_score": band_score(F.col("mean"), FRESH_LOW, FRESH_HIGH),
    }
    parts = cells.select(*keys, "row", "col", *[v.alias(n) for n, v in values.items()])
    parts = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", *values))).alias("parts"))  # the cells of one region
    size = lambda c: F.array_max(F.transform("parts", lambda p: p[c])) + 1
    grid = lambda name: F.transform(F.sequence(F.lit(0), size("row") - 1), lambda r: F.transform(F.filter("parts", lambda p: p["row"] == r), lambda p: p[name]))
    chosen = selected.groupBy(*keys).agg(F.sort_array(F.collect_list(F.array("row", "col"))).alias("chosen"))
    whole = global_confidence(cells).withColumnRenamed("confidence", "whole")
    rows = regions.join(parts, keys).join(whole, keys).join(chosen, keys, "left").withColumn("chosen", F.coalesce("chosen", F.array().cast("array<array<int>>")))
    h, w, shape = F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0"), F.array(size("row"), size("col")).alias("grid_shape")
    grids = [grid(f"{n}_score").alias(f"{n}_score_grid") for n in ("event", "occupancy", "freshness")] + [grid("active").alias("active_mask")] if components else []
    return rows.select(*keys, F.struct(
        F.array("rx0", "ry0", "rx1", "ry1").alias("roi_xyxy"), F.array(h, w).alias("roi_shape_hw"), (h * w).alias("roi_area"), F.col("n").alias("roi_event_count"), F.col("active").alias("active_pixel_count"),
        F.col("occupancy").alias("occupancy_ratio"), F.col("mean").alias("mean_surface"), F.lit(tau_us).alias("tau_us"), F.col("hi").alias("reference_t_us"),
        F.struct(shape, *[grid(n).alias(f"{n}_grid") for n in ("event_count", "occupancy_ratio", "mean_surface")]).alias("local_stats"),
        F.struct(shape, F.col("whole").alias("global_confidence"), F.col("chosen").alias("selected_cell_indices"), F.size("chosen").alias("selected_cell_count"), grid("confidence").alias("confidence_grid"), *grids).alias("confidence"),
    ).alias("payload"))


def feature_vector(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Per interval an array: log counts, occupancies and mean surfaces of its cells in
    row order, then height, width, area, events, occupancy and mean surface of its region."""
    parts = F.sort_array(F.collect_list(F.struct("row", "col", F.log1p("events").alias("log"), F.col("ratio").cast("double").alias("ratio"), "mean")))
    grids = cells.groupBy("seq", "idx").agg(parts.alias("parts"))
    h, w = F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0")
    whole = F.array(*[c.cast("double") for c in (h, w, h * w, F.col("n"), F.col("occupancy"), F.col("mean"))])
    return grids.join(regions.select("seq", "idx", whole.alias("whole")), ["seq", "idx"]).select("seq", "idx", F.concat("parts.log", "parts.ratio", "parts.mean", "whole").alias("vector"))


def log_score(value: Column, target: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log1p(value) / F.log1p(F.lit(max(1e-6, target)))))


def band_score(value: Column, low: float, high: float) -> Column:
    if high <= low:
        raise ValueError("an empty band")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def local_confidence(stats: DataFrame) -> DataFrame:
    """Confidence of each cell from events, occupancy and freshness; cells without activity have none."""
    parts = WEIGHTS["event"] * log_score(F.col("events"), TARGET_EVENTS) + WEIGHTS["occupancy"] * band_score(F.col("ratio"), 0.0, 0.05) + WEIGHTS["fresh"] * band_score(F.col("mean"), FRESH_LOW, FRESH_HIGH)
    return stats.withColumn("conf", F.when(F.col("active") > 0, parts / sum(WEIGHTS.values())).otherwise(0.0))


def selected_cells(conf: DataFrame, least: int = 1) -> DataFrame:
    """Active cells of confidence SELECT_FROM or more; if none, the ``least`` best active ones."""
    inside = Window.partitionBy("seq", "idx")
    good = (F.col("active") > 0) & (F.col("conf") >= SELECT_FROM)
    place = F.row_number().over(inside.orderBy((F.col("active") > 0).desc(), F.desc("conf"), "row", "col"))
    df = conf.withColumns({"n_good": F.count_if(good).over(inside), "place": place})
    chosen = F.when(F.col("n_good") >= least, good).otherwise((F.col("active") > 0) & (F.col("place") <= least))
    return df.where(chosen).drop("n_good", "place")


def global_confidence(conf: DataFrame) -> DataFrame:
    """Cell confidences averaged by active pixels and events; 0 where nothing is active."""
    return conf.groupBy("seq", "idx").agg(_averaged().alias("confidence"))


def _averaged() -> Column:
    weight = F.greatest(F.col("events"), F.lit(1)) * F.col("active")
    return F.coalesce(F.try_divide(F.sum(F.col("conf") * weight), F.sum(weight)), F.lit(0.0))


def cell_regions(conf: DataFrame, regions: DataFrame) -> DataFrame:
    """regions plus what ``region_stats`` (n, active, mean) and ``global_confidence`` (confidence) give, from the confidences of ``active_cells``."""
    sums = conf.groupBy("seq", "idx").agg(F.sum("events").alias("n"), F.sum("active").alias("active"), (F.sum("sw") / F.sum("active")).alias("mean"), _averaged().alias("confidence"))
    return regions.join(sums, ["seq", "idx"], "left").fillna(0, ["n", "active", "mean", "confidence"])


def weighted_median(rows: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median: the first value at which the weights reach half their sum."""
    upto = Window.partitionBy(*group).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns({"__upto": F.sum(weight).over(upto), "__all": F.sum(weight).over(Window.partitionBy(*group))})
    return marked.where(F.col("__upto") >= 0.5 * F.col("__all")).groupBy(*group).agg(F.min(value).alias("median"))


def weighted_fit(rows: DataFrame, group: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least squares of y on x per group, from sums; null slope without spread."""
    return _line(rows.groupBy(*group).agg(*_sums(x, y, w)), group)


def _sums(x: Column, y: Column, w: Column) -> list[Column]:
    return [F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count("*").alias("points")]


def _line(sums: DataFrame, group: list[str]) -> DataFrame:
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")
    slope = F.when((F.col("points") >= 2) & (F.col("sw") > 0) & (F.abs(spread) >= 1e-12), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")) / spread)
    return sums.withColumn("slope", slope).withColumn("icept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).select(*group, "points", "slope", "icept")


#: Gates of a cell's expansion cue, its share against the fallback.
CUE_PIXELS, CUE_RADIUS, CUE_SLOPE, CUE_RANGE = 8, 3.0, 1.0, (0.05, 20.0)
FALLBACK_SHARE = 0.35


_CUE = ["seq", "idx", "row", "col", "conf"]


def expansion_cues(surface: DataFrame, cells: DataFrame, unit_us: float, k: int = 3, pixels: int = CUE_PIXELS) -> DataFrame:
    """Per selected cell: a weighted fit of the pixels' distance from the box's
    centre on their age, its status, and the time to contact it gives."""
    h, w = F.col("ry1") - F.col("ry0"), F.col("rx1") - F.col("rx0")
    rows = surface.withColumns({"row": _cell(F.col("y") - F.col("ry0"), h, k), "col": _cell(F.col("x") - F.col("rx0"), w, k)})
    rows = rows.join(cells.select("seq", "idx", "row", "col", "conf"), ["seq", "idx", "row", "col"])
    return _cues(weighted_fit(rows, _CUE, *_away(unit_us), F.col("surface")), pixels)


def cell_cues(cells: DataFrame, pixels: int = CUE_PIXELS) -> DataFrame:
    """``expansion_cues`` of selected ``active_cells``, from their sums."""
    return _cues(_line(cells, _CUE), pixels)


def _away(unit_us: float) -> tuple[Column, Column]:
    """A pixel's age and its distance from the box's centre."""
    dx, dy = F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2
    return (F.col("last_us") - F.col("hi")) / F.lit(unit_us), F.sqrt(dx * dx + dy * dy)


def _cues(fits: DataFrame, pixels: int) -> DataFrame:
    ttc = F.col("icept") / F.col("slope")
    status = (
        F.when(F.col("points") < pixels, "TOO_FEW_PIXELS").when(F.col("slope").isNull(), "FIT_FAIL").when(F.col("icept") <= CUE_RADIUS, "RADIUS_TOO_SMALL").when(F.col("slope") <= CUE_SLOPE, "NON_POSITIVE_EXPANSION")
        .when(~ttc.between(*CUE_RANGE), "TTC_OUT_OF_RANGE").otherwise("OK")
    )
    return fits.withColumn("status", status).withColumn("ttc", F.when(F.col("status") == "OK", ttc))


def predict_from_cues(cues: DataFrame, fallback: DataFrame) -> DataFrame:
    """ttc and status of each interval: the weighted median of its good cues
    blended with the fallback, the fallback alone without a cue; other columns of the fallback go along."""
    weight = F.col("conf") * F.greatest(F.col("points"), F.lit(1))
    median = weighted_median(cues.where("status = 'OK'").withColumn("weight", weight), ["seq", "idx"], "ttc", "weight")
    both = fallback.join(median, ["seq", "idx"], "left")
    blend = (1 - FALLBACK_SHARE) * F.col("median") + FALLBACK_SHARE * F.col("fallback")
    more = [c for c in fallback.columns if c not in ("seq", "idx", "fallback")]
    return both.select("seq", "idx", *more, F.coalesce(blend, "median", "fallback").alias("ttc"), F.when(F.col("median").isNotNull(), "OK").when(F.col("fallback").isNotNull(), "OK_FALLBACK").otherwise("NO_VALID_FEATURE").alias("status"))


#: A growing spread of events counts from this slope and size, within this range of times.
GROW_SLOPE, GROW_SIZE, GROW_RANGE = 1.0, 3.0, (0.05, 16.0)


def expansion_candidates(rows: DataFrame, bins: int, least: int, unit_us: float) -> DataFrame:
    """seq, cue, slope, size, ttc and bins of each interval whose events spread out.

    ``rows`` are the interval's events with its lo, hi (us) and box, of which those inside the closed
    float box count.  Each of ``bins`` equal bins (the last closed) with ``least`` events gives its median time,
    three quantiles of the distance from the box's centre, and the widths between the 5 and 95 % quantiles; a
    line through three or more bins gives a cue's size at ``hi`` and its growth.
    """
    inside = rows.where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")) & (F.col("t_us") >= F.col("lo")) & (F.col("t_us") <= F.col("hi")))
    place = F.least(F.lit(bins - 1), F.floor((F.col("t_us") - F.col("lo")) * bins / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))))
    dx, dy = F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2
    q = lambda c, p: F.percentile(c, F.lit(p))
    age = (F.col("t_us") - F.col("hi")) / F.lit(unit_us)
    binned = inside.withColumns({"bin": place, "r": F.sqrt(dx * dx + dy * dy), "age": age}).groupBy("seq", "bin").agg(
        F.count("*").alias("n"), q("age", 0.5).alias("age"), q("r", 0.7).alias("r70"), q("r", 0.8).alias("r80"), q("r", 0.9).alias("r90"), (q("x", 0.95) - q("x", 0.05)).alias("w90"), (q("y", 0.95) - q("y", 0.05)).alias("h90")
    )
    cues = ("r70", "r80", "r90", "w90", "h90")
    enough = binned.withColumn("all_n", F.sum("n").over(Window.partitionBy("seq"))).where((F.col("all_n") >= bins * least) & (F.col("n") >= least))
    fits = enough.groupBy("seq").agg(F.count("*").alias("bins"), F.array(*[F.struct(F.lit(c).alias("cue"), F.regr_slope(c, "age").alias("slope"), F.regr_intercept(c, "age").alias("size")) for c in cues]).alias("fits"))
    out = fits.where("bins >= 3").select("seq", "bins", F.inline("fits")).withColumn("ttc", F.col("size") / F.col("slope"))
    return out.where((F.col("slope") > GROW_SLOPE) & (F.col("size") > GROW_SIZE) & F.col("ttc").between(*GROW_RANGE))
