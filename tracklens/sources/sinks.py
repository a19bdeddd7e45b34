"""Sinks: tables by sequence, run folders, resumable builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.joins import unfinished
from .shared import written


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV table of the fields in this order; other columns are left out."""
    df.select(*fields).write.mode("overwrite").options(header=True, nullValue="").csv(path)


def write_sequences(df: DataFrame, path: str, key: str = "seq") -> None:
    """Parquet in a folder per sequence; sequences that df has are replaced, others stay.

    Rows are dealt by sequence and, within large ones, by a hash, so that no
    sequence falls to one task.
    """
    rows = df.repartition(key, F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if c != key and not kind.startswith("map")]), F.lit(8)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_run(results: DataFrame, path: str, config: dict[str, str]) -> None:
    """A run: interval metrics by sequence, summary per sequence and over all, and its configuration."""
    spark = results.sparkSession
    write_sequences(results, f"{path}/metrics")
    metrics.run_summary(results).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    spark.createDataFrame(sorted(config.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/config")


def write_samples(samples: DataFrame, wanted: DataFrame, path: str, key: str = "seq") -> None:
    """Training samples in a folder per sequence, arrays as 32-bit floats; sequences already written stay.

    wanted: key of every sequence.  ValueError, naming a few, if one of those still to write has no sample; nothing is written then.
    """
    todo = resume(samples.sparkSession, wanted.select(key).distinct(), path, key)
    rows = written(samples.join(todo, key, "left_semi"), "samples")
    without = [r[0] for r in todo.join(rows, key, "left_anti").limit(5).collect()]
    if without:
        raise ValueError(f"no sample in: {without}")
    floats = {c: F.col(c).cast("array<float>") for c, kind in rows.dtypes if kind == "array<double>"}
    write_sequences(rows.withColumns(floats), path, key)


def build_status(wanted: DataFrame, built: DataFrame, key: str = "seq") -> DataFrame:
    """key and status of each wanted output: complete, partial (fewer rows than wanted) or missing.

    wanted has key and n_wanted, built key and n_built.
    """
    both = wanted.join(built, key, "left")
    status = F.when(F.col("n_built").isNull() | (F.col("n_built") == 0), "missing").when(F.col("n_built") < F.col("n_wanted"), "partial").otherwise("complete")
    return both.select(key, status.alias("status"))


def resume(spark: SparkSession, work: DataFrame, path: str, key: str = "seq") -> DataFrame:
    """The work whose sequences a written table does not have yet; all of it without a table."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except Exception as e:  # noqa: BLE001  the table's absence is the only case handled
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return work
    return unfinished(work, done, key)
