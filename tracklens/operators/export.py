"""Training samples of intervals: images, statistics and targets, with a row for each that is left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import surface as surf

#: Why an interval gives no sample.
INVALID_GT, EXPORT_FAIL = "INVALID_GT", "EXPORT_FAIL"
#: Values of the image of an interval at most, whatever is asked for.
MAX_VALUES = 1 << 22


def judged(intervals: DataFrame) -> DataFrame:
    """intervals (seq, idx, rx0, ry0, rx1, ry1, hi, truth, truth_status) plus reason and detail, null for those that give a sample.

    Without truth: INVALID_GT and its status.  With a truth that is not positive, or an
    empty region: EXPORT_FAIL and which of both.
    """
    empty = (F.col("rx1") <= F.col("rx0")) | (F.col("ry1") <= F.col("ry0"))
    reason = F.when(F.col("truth").isNull(), INVALID_GT).when((F.col("truth") <= 0) | empty, EXPORT_FAIL)
    detail = F.when(F.col("truth").isNull(), F.col("truth_status")).when(F.col("truth") <= 0, "truth is not positive").when(empty, "region is empty")
    return intervals.withColumns({"reason": reason, "detail": detail})


def images(intervals: DataFrame, rows: DataFrame, taus_us: list[int], height: int, width: int, split: bool = False) -> DataFrame:
    """intervals plus image: their channels as one array, channel by channel, row by row.

    rows: events in the intervals' regions (seq, idx, x, y, t_us, p).  For each tau the channels are the decay
    since a pixel's last event, ln(1 + events) and occupancy; if split, each of them for
    positive, then for other polarity.  The region's dense map is read at height x width evenly spaced
    places (nearest below).  Events become one row per pixel before the shuffle, so that an interval's
    list is bounded by the sensor; the scatter into dense maps runs in Arrow batches.
    """
    planes = 2 if split else 1
    if not taus_us or min(taus_us) <= 0:
        raise ValueError("at least one positive tau")
    if 3 * planes * len(taus_us) * height * width > MAX_VALUES:
        raise ValueError(f"an image of more than {MAX_VALUES} values")
    plane = F.when(F.col("p") > 0, 0).otherwise(1) if split else F.lit(0)
    pixels = rows.groupBy("seq", "idx", plane.alias("plane"), "x", "y").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))
    pixels = pixels.groupBy("seq", "idx").agg(F.collect_list(F.struct("plane", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "n", "last_us")).alias("pixels"))
    both = intervals.join(pixels, ["seq", "idx"], "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in intervals.schema)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                shown = [_image(*r, taus_us, height, width, planes) for r in zip(*[part.column(c).to_pylist() for c in ("rx0", "ry0", "rx1", "ry1", "hi", "pixels")], strict=True)]
                yield part.drop_columns(["pixels"]).append_column("image", pa.array(shown, pa.list_(pa.float64())))

    return both.mapInArrow(scatter, f"{fields}, image array<double>")


def _image(x0: int, y0: int, x1: int, y1: int, at: int, pixels: list | None, taus: list[int], height: int, width: int, planes: int) -> np.ndarray:
    h, w = y1 - y0, x1 - x0
    last, count = np.full((planes, h, w), -1, np.int64), np.zeros((planes, h, w), np.int64)
    for p in pixels or []:
        place = p["plane"], p["y"] - y0, p["x"] - x0
        last[place], count[place] = p["last_us"], p["n"]
    down, across = np.linspace(0, h - 1, height).astype(int), np.linspace(0, w - 1, width).astype(int)
    last, count = last[:, down][:, :, across], count[:, down][:, :, across]
    there = count > 0
    channels = []
    for tau in taus:
        channels += [np.where(there, np.exp(-(at - last) / tau), 0.0), np.log1p(count), there.astype(float)]
    return np.concatenate(channels).ravel()


def samples(intervals: DataFrame, rows: DataFrame, tau_us: int, height: int, width: int, taus_us: list[int] | None = None, split: bool = False, k: int = 3, most: int | None = None) -> DataFrame:
    """One row for each judged interval without a reason (of the first ``most`` of its sequence, if given):
    seq, idx, image, stats (k * k cells), metadata (region), gt_ttc and gt_log."""
    good = intervals.where("reason IS NULL")
    if most is not None:
        place = F.row_number().over(Window.partitionBy("seq").orderBy("idx"))
        good = good.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")
    good = good.drop("reason", "detail", "truth_status")
    pixels = surf.time_surface(rows, tau_us)
    vector = surf.feature_vector(surf.grid_stats(pixels, good, k), surf.region_stats(pixels, good))
    shown = images(good.select("seq", "idx", "rx0", "ry0", "rx1", "ry1", "hi", "truth"), rows, taus_us or [tau_us], height, width, split)
    cells = 3 * k * k
    return shown.join(vector, ["seq", "idx"]).select("seq", "idx", "image", F.slice("vector", 1, cells).alias("stats"), F.slice("vector", cells + 1, 6).alias("metadata"), F.col("truth").alias("gt_ttc"), F.log("truth").alias("gt_log"))


def skips(intervals: DataFrame) -> DataFrame:
    """seq, idx, reason and detail of the judged intervals that give no sample."""
    return intervals.where("reason IS NOT NULL").select("seq", "idx", "reason", "detail")


def summary(intervals: DataFrame) -> DataFrame:
    """Samples and skipped intervals of each sequence, and of all (a null seq)."""
    counts = [F.count_if(F.col("reason").isNull()).alias("samples"), F.count("reason").alias("skipped"), *[F.count_if(F.col("reason") == r).alias(r.lower()) for r in (INVALID_GT, EXPORT_FAIL)]]
    return intervals.rollup("seq").agg(*counts)
