"""Records inside nested JSON documents, and the coverage frontier of run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: Keys that make an object a metric record, and the policy that a frontier leaves out.
METRIC_KEYS = ("est_valid", "est_valid_count", "e_ttc_pct", "mae_s", "failure", "failure_count")
BASE_POLICY = "base_all_v13_valid"
#: Mean error in percent below which a policy counts as a success.
SUCCESS_PCT = 7.0


def _children(docs: DataFrame) -> DataFrame:
    """docs (file, path, v) with a row for each member of v: key (null in arrays), pos and value."""
    return docs.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))


def metric_records(texts: DataFrame, keys: tuple[str, ...] = METRIC_KEYS) -> DataFrame:
    """file, path and record (JSON) of every object, however deep, that has one of the keys, be its value null.

    texts: file and value, a JSON document each; what is no JSON has no records.  The documents are
    opened level by level as variants; each level's members are a table, so the number of passes is the depth of the deepest.
    """
    spark = texts.sparkSession
    level = written(texts.select("file", F.lit("$").alias("path"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL"), "level")
    found = None
    while not level.isEmpty():
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        members = written(_children(level).select("file", "path", "v", "key", F.concat("path", step).alias("inner"), "value"), "members")
        # One of the keys tells the object: the least that it has.
        hits = members.where(F.col("key").isin(*keys)).groupBy("file", "path").agg(F.min(F.struct("key", F.to_json("v").alias("record")))["record"].alias("record"))
        found = hits if found is None else found.unionByName(hits)
        inside = F.schema_of_variant("value")
        level = written(members.where(inside.startswith("OBJECT") | inside.startswith("ARRAY")).select("file", F.col("inner").alias("path"), F.col("value").alias("v")), "level")
    return found if found is not None else spark.createDataFrame([], "file string, path string, record string")


def coverage_rows(summaries: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row for each policy of each wanted run, but the base policy; one with status missing for runs without a summary.

    summaries: run and value, its JSON; wanted: run.  A summary that is no JSON has the status unreadable.
    """
    docs = wanted.select("run").distinct().join(summaries.select("run", "value", F.try_parse_json("value").alias("doc")), "run", "left")
    state = F.when(F.col("value").isNull(), "missing").when(F.col("doc").isNull(), "unreadable").otherwise("ok")
    docs = docs.select("run", state.alias("status"), F.try_variant_get("doc", "$.args.target_e_ttc_pct", "double").alias("target"), F.try_variant_get("doc", "$.policy_summaries", "variant").alias("v"))
    names = {"est_valid": ("count", "bigint"), "mae_s": ("mae_s", "double"), "e_ttc": ("e_ttc_pct", "double"), "of_valid": ("coverage_of_v13_valid", "double"), "of_truth": ("coverage_of_gt_valid", "double"), "over50": ("over50", "bigint"), "over100": ("over100", "bigint")}
    good = _children(docs.where("status = 'ok'")).where(F.col("key") != BASE_POLICY)
    rows = good.select("run", "target", F.col("key").alias("policy"), *[F.try_variant_get("value", f"$.{k}", kind).alias(n) for n, (k, kind) in names.items()], "status")
    rows = rows.withColumn("success", F.coalesce(F.col("e_ttc") < SUCCESS_PCT, F.lit(False)))
    return rows.unionByName(docs.where("status <> 'ok'").select("run", F.col("status").alias("policy"), "status"), allowMissingColumns=True)


def frontier(rows: DataFrame, part: str = "run") -> DataFrame:
    """rows plus best: no other row of its part covers at least as much with a lower mean error, or more with no higher one."""
    order = Window.partitionBy(part).orderBy(F.desc_nulls_last("of_truth"), F.asc_nulls_last("e_ttc"))
    before = F.min("e_ttc").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = F.col("e_ttc").isNotNull() & F.col("of_truth").isNotNull()
    out = rows.withColumns({"__before": before})
    # Rows equal in both stand or fall together.
    same = Window.partitionBy(part, "of_truth", "e_ttc")
    return out.withColumn("best", told & F.coalesce(F.min(F.when(F.col("__before").isNull() | (F.col("e_ttc") < F.col("__before")), 1).otherwise(2)).over(same) == 1, F.lit(False))).drop("__before")
