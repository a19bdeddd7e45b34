"""Scans over a dataset's files: one folder per sequence with CSV and JSON tables.

Readers take a glob or folder, infer nothing and prune by column; the sequence is
the name of the folder that holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import records

#: The columns of the dataset's tables, in file order.
BOXES = "label_id int, frame_idx int, timestamp_s double, x1 double, y1 double, x2 double, y2 double, area double, category string, object_index int, json_path string"
TRUTH = "index int, time_s double, distance_m double, velocity_mps double, ttc_s double"
INTERVALS = (
    "sample_id string, sequence_id string, interval_idx int, start_label_id int, end_label_id int, start_frame_idx int, end_frame_idx int, t_start_s double, t_end_s double, dt_s double, query_t_s double, bbox_t_s double, "
    "bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, bbox_area double, event_idx_lo bigint, event_idx_hi bigint, event_count bigint, gt_ttc_s double, status_gt string, segmentation_json string, category string"
)


def _sequence(depth: int = 2) -> Column:
    """Name of the folder ``depth - 1`` levels above the file."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV table with header plus ``seq``; blanks are null, malformed cells null."""
    rows = spark.read.schema(schema).options(header=True, sep=sep, nullValue="", mode="PERMISSIVE").csv(path)
    return rows.select("*", _sequence().alias("seq"))


def boxes(spark: SparkSession, root: str) -> DataFrame:
    return csv(spark, f"{root}/*/bbox.csv", BOXES)


def truth(spark: SparkSession, root: str) -> DataFrame:
    return csv(spark, f"{root}/*/gt_ttc.csv", TRUTH)


def intervals(spark: SparkSession, root: str) -> DataFrame:
    return csv(spark, f"{root}/*/IntervalIndex.csv", INTERVALS)


def tracks(boxes: DataFrame) -> DataFrame:
    """seq, label_id, ts, w, h, area of a box table, as the estimators take them."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.select("seq", F.col("label_id").cast("bigint").alias("label_id"), F.col("timestamp_s").alias("ts"), w.alias("w"), h.alias("h"), F.greatest(F.lit(0.0), w * h).alias("area"))


def sequences(spark: SparkSession, root: str) -> DataFrame:
    """Sorted names of the sequences that have any file."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*").select(F.col("path"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("seq")).distinct().orderBy("seq")


def inventory(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """seq, n_files, bytes, missing (sorted) and status ready or missing_required."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*").select("path", "length")
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -2).alias("seq"), F.element_at(parts, -1).alias("name"), "length")
    want = F.array(*[F.lit(x) for x in sorted(required)])
    out = named.groupBy("seq").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), F.collect_set(F.when(F.col("name").isin(required), F.col("name"))).alias("have"))
    out = out.withColumn("missing", F.array_except(want, "have")).drop("have")
    return out.withColumn("status", F.when(F.size("missing") == 0, "ready").otherwise("missing_required"))


def json_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document, keys cast by the schema, plus ``seq``."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", _sequence().alias("seq"))


def tab_series(spark: SparkSession, path: str, columns: int = 5) -> DataFrame:
    """Rows of at least ``columns`` tab-separated numbers as ``cells``; shorter rows drop out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("cells"))
    return lines.where(F.size("cells") >= columns).select(F.transform("cells", lambda c: c.try_cast("double")).alias("cells"))


def label_objects(spark: SparkSession, path: str, n_frames: int | None = None, category: str = "car") -> DataFrame:
    """frame, x, y, w, h, area of one object (bbox: x, y, w, h) per label file.

    The file's stem is the frame (frames outside [0, n_frames) drop out); the
    first object of the category counts, or else the first; a missing area is
    w * h, at least 0.
    """
    schema = "objects array<struct<category:string,bbox:array<double>,area:double>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("objects", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("bigint").alias("frame"))
    inside = F.col("frame").isNotNull() & (F.size("objects") > 0)
    if n_frames is not None:
        inside &= F.col("frame").between(0, n_frames - 1)
    o = first_matching("objects", category)
    rows = rows.where(inside).withColumn("o", o)
    rows = rows.select("frame", "o.area", *[F.get("o.bbox", i).alias(c) for i, c in enumerate("xywh")])
    return rows.select("frame", *"xywh", F.greatest(F.lit(0.0), F.coalesce("area", F.col("w") * F.col("h"))).alias("area"))


def first_matching(objects: str, category: str) -> Column:
    """The first element of the category, or else the first."""
    return F.coalesce(F.get(F.filter(objects, lambda x: x["category"] == category), F.lit(0)), F.get(objects, F.lit(0)))


def keyed_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one of the greatest ``order``."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return last.select(key, "r.*").select(*rows.columns)


def sample(intervals: DataFrame, idx: int | None = None, sample_id: str | None = None) -> DataFrame:
    """The row of a key; KeyError if there is none, ValueError without a key."""
    if idx is None and sample_id is None:
        raise ValueError("idx or sample_id is needed")
    found = intervals.where(F.col("interval_idx") == idx if idx is not None else F.col("sample_id") == sample_id).limit(1)
    if found.isEmpty():
        raise KeyError(idx if idx is not None else sample_id)
    return found


def samples(intervals: DataFrame, start: int = 0, most: int | None = None, key: str = "seq", idx: str = "interval_idx") -> DataFrame:
    """Rows from ``start`` on, at most ``most`` of each sequence."""
    rows = intervals.where(F.col(idx) >= start)
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy(key).orderBy(idx))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def metric_records(spark: SparkSession, path: str, keys: tuple[str, ...] = records.METRIC_KEYS) -> DataFrame:
    """file, path and record of every object with one of the keys in the JSON documents of a folder."""
    return records.metric_records(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"), keys)


def numbered(events: DataFrame, slot_us: int) -> DataFrame:
    """events plus event_idx, their place in their sequence by (t_us, event_id), from 0.

    Places are taken within (seq, slot of time) and moved by the counts of the slots before, so that a long sequence spreads over many tasks.
    """
    slots = events.withColumn("__slot", F.floor(F.col("t_us") / slot_us))
    counts = slots.groupBy("seq", "__slot").agg(F.count("*").alias("n"))
    before = counts.select("seq", "__slot", (F.sum("n").over(Window.partitionBy("seq").orderBy("__slot")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("seq", "__slot").orderBy("t_us", "event_id")) - 1
    return slots.withColumn("__place", place).join(before, ["seq", "__slot"]).withColumn("event_idx", (F.col("__before") + F.col("__place")).cast("bigint")).drop("__slot", "__before", "__place")


def write_events(events: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Numbered events as Parquet in order of (seq, event_idx) over ranges: files hold few sequences, and row
    groups of about so many bytes hold a stretch of one, told by their statistics."""
    ordered = events.repartitionByRange("seq", "event_idx").sortWithinPartitions("seq", "event_idx")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def event_slice(spark: SparkSession, path: str, seq: int, lo: int, hi: int) -> DataFrame:
    """Events [lo, hi) of a sequence; both bounds reach the scan, which skips row groups outside them."""
    if lo > hi:
        raise ValueError("lo is greater than hi")
    return spark.read.parquet(path).where((F.col("seq") == seq) & (F.col("event_idx") >= lo) & (F.col("event_idx") < hi))
