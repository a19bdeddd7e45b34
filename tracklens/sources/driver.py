"""The engine's inputs, derived from the star-schema tables.

* tracks: one box per supplier (sequence) and month (label), with injected area collapses;
* ground truth: a monthly series of item values for each sequence;
* events: the event stream, as (sequence, time, x, y, polarity);
* intervals: days on which a sequence has a region of interest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, label_id and what boxes (q, c) and ground truth (price) are made of."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("seq"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("bigint").alias("label_id"), "l_quantity", "l_extendedprice"
    )
    return rows.groupBy("seq", "label_id").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("c"), F.avg("l_extendedprice").alias("price"))


def observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """tracks and ground truth, for queries that need both: the items are read and grouped once."""
    rows = written(monthly(spark, sf_dir), "monthly")
    return _boxes(rows), _series(rows)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, label_id, ts, w, h, area: boxes centred on (320, 240)."""
    return _boxes(monthly(spark, sf_dir))


def _boxes(boxes: DataFrame) -> DataFrame:
    m = F.col("label_id")
    k = F.when((F.col("seq") * 7 + m) % 23 == 0, 0.3).otherwise(1.0)
    jitter = lambda a, b, n: (F.col("seq") * a + m * b) % n  # noqa: E731  keeps fits off the thresholds
    return boxes.select("seq", "label_id", (m * 0.1).alias("ts"), (k * (20 + F.col("q") / 10 + m * 0.4 + jitter(31, 17, 101) * 0.00137)).alias("w"), (k * (20 + F.col("c") * 3 + m * 0.3 + jitter(13, 29, 97) * 0.00173)).alias("h")).withColumn("area", F.col("w") * F.col("h"))


TRACKS_SQL = """tracks AS (
  SELECT seq, label_id, label_id * 0.1::DOUBLE AS ts, w, h, w * h AS area FROM (
    SELECT seq, label_id, k * (20 + q / 10 + label_id * 0.4::DOUBLE + (seq * 31 + label_id * 17) % 101 * 0.00137::DOUBLE) AS w, k * (20 + c * 3 + label_id * 0.3::DOUBLE + (seq * 13 + label_id * 29) % 97 * 0.00173::DOUBLE) AS h FROM (
      SELECT l_suppkey AS seq, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS label_id, sum(l_quantity) AS q, count(*) AS c,
        CASE WHEN (l_suppkey * 7 + label_id) % 23 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS k
      FROM lineitem GROUP BY 1, 2)))"""


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, t, v: a series over months for each sequence, in the tracks' time."""
    return _series(monthly(spark, sf_dir))


def _series(rows: DataFrame) -> DataFrame:
    return rows.select("seq", (F.col("label_id") * 0.1 + 0.05).alias("t"), (F.col("price") / 10007).alias("v"))


GROUND_TRUTH_SQL = """gt AS (SELECT seq, m * 0.1::DOUBLE + 0.05::DOUBLE AS t, v FROM (
  SELECT l_suppkey AS seq, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS m, avg(l_extendedprice) / 10007 AS v FROM lineitem GROUP BY 1, 2)),
seg AS (SELECT seq, t, v, lag(t) OVER (PARTITION BY seq ORDER BY t) AS p, lag(v) OVER (PARTITION BY seq ORDER BY t) AS pv FROM gt)"""


def event_columns(rows: DataFrame) -> DataFrame:
    """seq, event_id, t_us, x, y, p on a 100 x 100 sensor, of a batch or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return rows.select(
        F.col("user_id").alias("seq"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), k.alias("x"), (F.floor("value") % 100).cast("int").alias("y"), F.col("event_type").isin("click", "purchase").cast("int").alias("p")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


EVENTS_SQL = """ev AS (SELECT user_id AS seq, event_id, epoch_us(ts) AS t_us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS x,
  CAST(floor(value) AS BIGINT) % 100 AS y, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS p FROM events)"""

#: Length of an interval.
DAY_US = 86_400_000_000


def intervals(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    """seq, idx, lo, hi (us, half-open) and the region of interest of every span of so many days with events."""
    width = days * DAY_US
    ev = events(spark, sf_dir)
    days = ev.select("seq", F.floor(F.col("t_us") / width).alias("idx")).distinct()
    x1, y1 = (F.col("seq") % 20).cast("double"), (F.col("seq") * 3 % 15).cast("double")
    return days.select("seq", "idx", (F.col("idx") * width).alias("lo"), ((F.col("idx") + 1) * width).alias("hi"), (x1 + 0.5).alias("x1"), (y1 + 0.5).alias("y1"), (x1 + 75.2).alias("x2"), (y1 + 80.7).alias("y2"))


INTERVALS_SQL = f"""iv AS (SELECT seq, idx, idx * {DAY_US} AS lo, (idx + 1) * {DAY_US} AS hi, seq % 20 + 0.5::DOUBLE AS x1, seq * 3 % 15 + 0.5::DOUBLE AS y1,
  seq % 20 + 75.2::DOUBLE AS x2, seq * 3 % 15 + 80.7::DOUBLE AS y2 FROM (SELECT DISTINCT seq, t_us // {DAY_US} AS idx FROM ev))"""
