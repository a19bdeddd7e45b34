"""Event streams: tumbling windows, latest state per pixel, interval joins, recursive clips.

Aggregating streams are kept as a log of updates: each micro-batch appends the
groups it changed, and ``latest`` reads the last version of each.  A batch that is
repeated after a failure overwrites its own part of the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Longest piece of a span in a stream join's state.  Hours, as a day's length depends on the time zone.
PIECE = "24 HOURS"


def follow(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run the stream over all there is now, appending to the log at path."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last version of each key in a log."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def tumbling_counts(events: DataFrame, width_us: int) -> DataFrame:
    """Events of each (seq, window number); an event that comes late still counts in its window."""
    return events.groupBy("seq", F.floor(F.col("t_us") / width_us).alias("win")).agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def filled(counts: DataFrame) -> DataFrame:
    """Tumbling counts with the empty windows between a sequence's first and last, as zeros."""
    w = Window.partitionBy("seq").orderBy("win")
    after = F.coalesce(F.lead("win").over(w), F.col("win") + 1)
    gaps = counts.withColumn("__after", after).withColumn("k", F.explode(F.sequence(F.col("win"), F.col("__after") - 1)))
    return gaps.select("seq", F.col("k").alias("win"), F.when(F.col("k") == F.col("win"), F.col("n")).otherwise(0).alias("n"))


def latest_pixels(events: DataFrame) -> DataFrame:
    """The time surface's state: count and last time of each pixel."""
    return events.groupBy("seq", "x", "y").agg(F.count("*").alias("n"), F.max("t_us").alias("last_us"))


def interval_stream_join(events: DataFrame, spans: DataFrame, slack: str = "10 minutes") -> DataFrame:
    """Two streams: events (seq, ts, ...) with the spans [lo_ts, hi_ts) they fall in.

    Spans may be of any length.  They are cut into pieces of at most PIECE, so that
    watermarks bound what either side keeps: an event waits for pieces that begin
    before it, a piece for events until PIECE after its begin.  Rows more than
    ``slack`` behind the latest are late and lost.
    """
    left = events.withWatermark("ts", slack).alias("e")
    piece = F.expr(f"INTERVAL {PIECE}")
    begins = F.filter(F.sequence("lo_ts", "hi_ts", piece), lambda t: t < F.col("hi_ts"))
    cut = spans.where("lo_ts < hi_ts").withColumn("__lo", F.explode(begins)).withColumn("__hi", F.least("hi_ts", F.col("__lo") + piece))
    right = cut.withWatermark("__lo", slack).alias("s")
    inside = (F.col("e.seq") == F.col("s.seq")) & (F.col("ts") >= F.col("__lo")) & (F.col("ts") < F.col("__hi"))
    bounded = (F.col("ts") <= F.col("__lo") + piece) & inside
    return left.join(right, bounded).select("e.*", *[F.col(f"s.{c}") for c in spans.columns if c != "seq"])


def clip_stream(estimates: DataFrame, step: float) -> DataFrame:
    """Estimates (seq, start, pred), each clamped to within ``step`` of the clamped
    one before it in its sequence; a null passes and forgets the one before.  A
    sequence's state is one number; its batches must come in order."""

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("start")
        smooth = []
        for value in rows["pred"]:
            if pd.isna(value):
                last = None
            else:
                last = float(value) if last is None else max(last - step, min(last + step, float(value)))
            smooth.append(last)
        state.update((last,))
        yield pd.DataFrame({"seq": rows["seq"], "start": rows["start"], "smooth": pd.array(smooth, "Float64")})

    return estimates.groupBy("seq").applyInPandasWithState(fold, "seq bigint, start bigint, smooth double", "last double", "append", GroupStateTimeout.NoTimeout)
