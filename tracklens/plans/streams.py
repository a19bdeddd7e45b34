"""Structured Streaming queries: each runs over all there is now, then reads its log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.driver import DAY_US, EVENTS_SQL, TRACKS_SQL, event_columns, table, tracks
from ..sources.shared import shared_folder
from ..streaming import windows
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    return event_columns(rows)


@query("stream_tumbling_counts", f"WITH {EVENTS_SQL} SELECT seq, t_us // {DAY_US} AS win, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    windows.follow(windows.tumbling_counts(event_stream(spark, sf_dir), DAY_US), f"{at}/log", f"{at}/state", "update")
    return windows.latest(spark, f"{at}/log", ["seq", "win"]).select("seq", "win", "n")


@query("stream_filled_windows", f"WITH {EVENTS_SQL}, c AS (SELECT seq, t_us // {DAY_US} AS win, count(*) AS n FROM ev GROUP BY 1, 2), s AS (SELECT seq, unnest(range(min(win), max(win) + 1)) AS win FROM c GROUP BY 1) SELECT s.seq, s.win, coalesce(n, 0) AS n FROM s LEFT JOIN c ON c.seq = s.seq AND c.win = s.win")
def stream_filled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.filled(stream_tumbling_counts(spark, sf_dir))


@query("stream_latest_pixels", f"WITH {EVENTS_SQL} SELECT seq, x, y, count(*) AS n, max(t_us) AS last_us FROM ev GROUP BY 1, 2, 3")
def stream_latest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    windows.follow(windows.latest_pixels(event_stream(spark, sf_dir)), f"{at}/log", f"{at}/state", "update")
    return windows.latest(spark, f"{at}/log", ["seq", "x", "y"])


@query("stream_interval_join", f"WITH {EVENTS_SQL}, s AS (SELECT seq, event_id AS span, t_us AS lo, t_us + 3600000000 AS hi FROM ev) SELECT s.span, count(*) AS n, max(e.event_id) AS last_event FROM ev e JOIN s ON s.seq = e.seq AND e.t_us >= s.lo AND e.t_us < s.hi GROUP BY 1")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour after every event, joined as a second stream."""
    at = _folder(spark)
    first, last = event_columns(table(spark, sf_dir, "events")).agg(F.min("t_us"), F.max("t_us")).first()
    left = event_stream(spark, sf_dir).withColumn("ts", F.timestamp_micros("t_us"))
    begins = event_stream(spark, sf_dir).select("seq", F.col("event_id").alias("span"), F.timestamp_micros("t_us").alias("lo_ts"))
    spans = begins.withColumn("hi_ts", F.col("lo_ts") + F.expr("INTERVAL 1 HOUR"))
    # Each file is a batch, and files come in any order: with the table's time spread as slack no row is late.
    slack = f"{((last or 0) - (first or 0)) // 1_000_000 + 1} seconds"
    windows.follow(windows.interval_stream_join(left, spans, slack).select("span", "event_id"), f"{at}/log", f"{at}/state")
    return spark.read.parquet(f"{at}/log").groupBy("span").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query(
    "stream_delta_clip",
    f"""WITH RECURSIVE {TRACKS_SQL}, r AS (SELECT seq, label_id AS start, w AS pred, row_number() OVER (PARTITION BY seq ORDER BY label_id) AS k FROM tracks),
    c(seq, k, start, smooth) AS (SELECT seq, k, start, pred FROM r WHERE k = 1 UNION ALL SELECT r.seq, r.k, r.start, greatest(c.smooth - 1, least(c.smooth + 1, r.pred)) FROM c JOIN r ON r.seq = c.seq AND r.k = c.k + 1) SELECT seq, start, round(smooth, 5) AS smooth FROM c""",
)
def stream_delta_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box widths clipped along each track, from two files that arrive in order."""
    at = _folder(spark)
    boxes = tracks(spark, sf_dir).select("seq", F.col("label_id").alias("start"), F.col("w").alias("pred"))
    boxes.where("start < 30").write.parquet(f"{at}/in/part=0")
    boxes.where("start >= 30").write.parquet(f"{at}/in/part=1")
    for k in range(2):
        stream = spark.readStream.schema(boxes.schema).parquet(f"{at}/in/part=[0-{k}]")
        windows.follow(windows.clip_stream(stream, 1.0), f"{at}/log", f"{at}/state")
    return spark.read.parquet(f"{at}/log").select("seq", "start", F.round("smooth", 5).alias("smooth"))
