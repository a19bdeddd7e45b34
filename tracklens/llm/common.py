"""Shared helpers: where intermediate tables go, batch sizes, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; texts are long, so few.
BATCH_ROWS = 256
#: A table may be broadcast when its rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def reserved(keep: list[str], *names: str) -> None:
    """ValueError if a kept column bears a name that the operator needs itself."""
    clash = sorted({c.lower() for c in keep} & set(names))
    if clash:
        raise ValueError(f"reserved column names: {clash}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's spark.checkpoint.dir.

    Only where that is unset and the master is local, as in tests, a temporary
    folder stands in; on a cluster executors would each write their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tracklens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back.

    It cuts the lineage: a lost executor costs no recomputation, and the sizes
    that later joins see are those of the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int, rows_each: int = 100_000) -> DataFrame:
    """df of about so many rows in few partitions, one for each core at least, so
    that a small table isn't written as one tiny file for each shuffle partition.
    It narrows the stage that makes df, too: not for stages that work in Python."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // rows_each))


def gathered(df: DataFrame, rows: int, rows_each: int = 100_000) -> DataFrame:
    """df of at most about so many rows in few partitions, after a shuffle of them: the
    stage that makes df keeps its width."""
    return df.repartition(max(1, rows // rows_each))


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if df's rows, of row_bytes each, fit a broadcast."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size allows it, else unchanged."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
