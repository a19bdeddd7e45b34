"""A training-corpus pipeline: four stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents, others that docs may have included.

1. language_id: drops texts without a letter (null and empty ones, too), and those that no learned language
   explains better than the others.
2. ngram_jaccard: keeps, of each group of near copies (SHINGLE-word shingles, PERCENT
   of them shared; op2's query has its own bounds), the document of least id (null ids
   come last; of one id the text of least hash; of rows equal in both the row of least hash).  Rows
   that repeat an id with another text are documents of their own; texts without words all stay.
3. decontamination: drops documents that hold a benchmark item.
4. byte_bpe: the token ids of what is left, beside all columns but the text (and
   columns that bear the name of a result).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import bpe, decontaminate, jaccard, langid
from tracklens.llm.common import maybe_broadcast, table, written

#: Share of the winner below which a language is not told.
LEAST_SCORE = 0.35
#: Words of a shingle and least Jaccard similarity of near copies.
SHINGLE = 5
PERCENT = 80

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with its columns named by their place, so that none clashes with an operator's own, and the text's name."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, ~langid.held_out())
    numbered, text = _numbered(docs)
    told = langid.predict(numbered, model, numbered.columns, text=text)
    kept = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*numbered.columns).toDF(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "__row"
    while row in docs.columns:
        row += "_"
    # What tells a document: its id, or else the greatest number, and its text's hash.
    named = docs.withColumn(row, F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text")))
    classes = jaccard.components(named.select(row, "text"), key=row, size=SHINGLE, percent=PERCENT)
    classes = written(classes.where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "components")
    gone = written(classes.where(F.col(row) != F.col("component_id")).select(row).distinct(), "gone")
    kept = named.join(maybe_broadcast(gone, 48), row, "left_anti")
    repeated = written(classes.where(F.col(row) == F.col("component_id")).groupBy(row).agg(F.count("*").alias("c")).where("c > 1").select(row), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    repeated = maybe_broadcast(repeated, 48)
    first = kept.join(repeated, row, "left_semi").groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("first"))
    return kept.join(repeated, row, "left_anti").select(*docs.columns).unionByName(first.select("first.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered, text = _numbered(docs)
    keep = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in ("text", *bpe.RESULTS)}
    return bpe.encode(numbered, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, list(keep), text=text, with_ids=True).withColumnsRenamed(keep)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
