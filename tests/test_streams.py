"""Stream joins over several files in any order, and over long spans."""

from pyspark.sql import functions as F

from tracklens.plans import QUERIES
from tracklens.sources.driver import events
from tracklens.streaming import windows


def test_stream_interval_join_over_unsorted_files(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values("ts", ascending=False)
    schema, n = spark.read.parquet(f"{sf}/events.parquet").schema, len(rows)
    for k in (0, 2, 1, 3):  # the latest first
        spark.createDataFrame(rows[n * k // 4 : n * (k + 1) // 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    e = events(spark, sf)
    s = e.select("seq", F.col("event_id").alias("span"), F.col("t_us").alias("lo"))
    want = e.join(s, "seq").where("t_us >= lo AND t_us < lo + 3600000000").groupBy("span").agg(F.count("*"), F.max("event_id")).collect()
    got = QUERIES["stream_interval_join"](spark, str(tmp_path)).select("span", "n", "last_event").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_interval_stream_join_keeps_all_of_a_long_span(spark, tmp_path):
    hour = 3_600_000_000
    start = 480_000 * hour  # a stream's first watermark is 1970, and drops what is not later
    times = [start + h * hour for h in (0, 23, 24, 25, 47, 48, 71, 72, 100)]
    # A file each, in order of time.
    for k, t in enumerate(times):
        spark.createDataFrame([(1, k, t)], "seq bigint, event_id bigint, t_us bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    spans = [(seq, span, start + a * hour, start + b * hour) for seq, span, a, b in ((1, 7, 0, 72), (1, 8, 24, 25), (1, 9, 1, 1), (2, 10, 0, 72))]
    spark.createDataFrame(spans, "seq bigint, span bigint, lo bigint, hi bigint").coalesce(1).write.parquet(f"{tmp_path}/s")
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    left = read("e", "seq bigint, event_id bigint, t_us bigint").withColumn("ts", F.timestamp_micros("t_us"))
    right = read("s", "seq bigint, span bigint, lo bigint, hi bigint").select("seq", "span", F.timestamp_micros("lo").alias("lo_ts"), F.timestamp_micros("hi").alias("hi_ts"))
    windows.follow(windows.interval_stream_join(left, right), f"{tmp_path}/log", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r["span"], r["event_id"]) for r in got.collect()) == [(7, k) for k in range(7)] + [(8, 2)]
    assert {"lo_ts", "hi_ts"} <= set(got.columns) and not [c for c in got.columns if c.startswith("__")]
