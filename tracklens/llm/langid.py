"""Language identification: known words first, then ever shorter character n-grams.

``fit`` counts the words of a bounded sample of labelled texts per language, in
Spark; all words and character n-grams of the sample make up the model.  A text's score for a language is the
sum, over its words, of

* the word's log relative frequency in that language, if the word is known, else
* the mean log relative frequency of its n-grams of the greatest length (from
  ``MAX_GRAM`` down to 1) of which any is known, less a penalty for each step.

Words are maximal runs of letters, lower-cased, framed by spaces for n-grams.
Frequencies get add-half smoothing.  Equal scores go to the alphabetically first
language.  ``score`` is the softmax share of the winner, over the scores divided
by the square root of the number of words.  A text that is null or has no letter
is ``und`` with score 0; without any labelled text every text is ``und``.  Repeated
rows are told alike, each to its own row; columns named __text, lang_pred or score
cannot be kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reserved, small_batches

#: About so many labelled texts are counted; beyond, a share chosen by a hash of id and text.
SAMPLE_TEXTS = 4_000
#: The broadcast model may be so large; a larger one is refused, not cut.
MODEL_BYTES = 256 << 20
MAX_GRAM = 4
#: Log-probability lost with each shorter length of n-grams.
STEP_PENALTY = 0.5
#: Scores of unknown words remembered by a worker.
CACHE_ENTRIES = 200_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def _counted(labelled: DataFrame) -> DataFrame:
    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for word in _WORD.findall((text or "").lower()):
                    pairs[lang, word] = pairs.get((lang, word), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["lang", "word", "n"])

    return labelled.mapInPandas(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, key: str, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """The keys, numbered, and their log frequencies per language."""
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(languages)]
    table = counts.groupBy(key).agg(F.sum("n").alias("all_n"), *sums).persist()
    try:
        n, size = table.agg(F.count("*"), F.sum(F.octet_length(key))).first()
        if (size or 0) + n * (100 + 4 * len(languages)) > MODEL_BYTES:
            raise ValueError(f"a model of {n} keys is larger than MODEL_BYTES: take a smaller sample")
        rows = table.toPandas().sort_values(key, ignore_index=True)
    finally:
        table.unpersist()
    each = rows[[f"l{i}" for i in range(len(languages))]].to_numpy(dtype=float)
    logs = np.log(each + 0.5) - np.log(each.sum(axis=0) + 0.5 * (len(rows) + 1))
    return {k: i for i, k in enumerate(rows[key])}, logs.astype(np.float32)


class Model:
    """Languages, and log frequencies of words and n-grams."""

    def __init__(self, languages: list[str], words: tuple[dict[str, int], np.ndarray], grams: tuple[dict[str, int], np.ndarray]) -> None:
        self.languages, self.words, self.grams = languages, words, grams
        self._grams = dict(zip(grams[0], grams[1].tolist(), strict=True))

    def of_word(self, word: str) -> list[float]:
        at, logs = self.words
        known = at.get(word)
        if known is not None:
            return logs[known].tolist()
        framed = f" {word} "
        for back, size in enumerate(range(min(MAX_GRAM, len(framed)), 0, -1)):
            hits = [g for i in range(len(framed) - size + 1) if (g := self._grams.get(framed[i : i + size])) is not None]
            if hits:
                return [sum(x) / len(hits) - STEP_PENALTY * back for x in zip(*hits, strict=True)]
        return [0.0] * len(self.languages)

    def predict(self, text: str | None, cache: dict[str, list[float]]) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        n = len(self.languages)
        if not words or not n or not any(c.isalpha() for c in text or ""):
            return UNDETERMINED, 0.0
        get = cache.get
        rows = []
        for word in words:
            row = get(word)
            if row is None:
                row = self.of_word(word)
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                if len(word) <= 32:
                    cache[word] = row
            rows.append(row)
        total = np.array(rows).sum(axis=0) if len(rows) > 8 else [sum(r[k] for r in rows) for k in range(n)]
        best = max(range(n), key=lambda k: (total[k], -k))
        scale = math.sqrt(len(words))
        share = 1.0 / sum(math.exp(max(-700.0, (total[k] - total[best]) / scale)) for k in range(n))
        return self.languages[best], min(1.0, share)


def fit(docs: DataFrame, training: Column, sample: int = SAMPLE_TEXTS, key: str = "doc_id") -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows where ``training``.

    ``sample`` bounds (about) how many labelled texts are counted: of N labelled
    rows, those whose hash of id and text lies below sample / N of its range (rows
    equal in both share their lot).  The number of languages is taken to be small.
    """
    labelled = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(key, "lang", "text")
    n = labelled.select(key).count()
    if n > sample:
        labelled = labelled.where(F.shiftrightunsigned(F.xxhash64(key, "text"), 1) < F.lit(max(1, sample * (1 << 63) // n)))
    spark = docs.sparkSession
    small_batches(spark)
    counts = _counted(labelled.select("lang", "text")).persist()
    try:
        languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
        words = _table(counts, "word", languages)
        framed = F.concat(F.lit(" "), "word", F.lit(" "))
        sizes = F.sequence(F.lit(1), F.least(F.lit(MAX_GRAM), F.length(framed)))
        grams = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.length(framed) - s + 1), lambda i: framed.substr(i, s))))
        by_gram = counts.select("lang", "n", F.explode(grams).alias("gram")).where(F.col("gram") != " ").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        return Model(languages, words, _table(by_gram, "gram", languages))
    finally:
        counts.unpersist()


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns ``keep`` plus ``lang_pred`` and ``score``; only the text is
    looked at.  A map over the scan, without a shuffle; the model is broadcast,
    its size checked against MODEL_BYTES when it was learned.
    """
    reserved(keep, "__text", "lang_pred", "score")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.words, model.grams))

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, cache = Model(*shared.value), {}
        for batch in it:
            out = [local.predict(x.as_py(), cache) for x in batch.column("__text")]
            rest = batch.drop_columns(["__text"])
            yield rest.append_column("lang_pred", pa.array([x for x, _ in out], pa.string())).append_column("score", pa.array([x for _, x in out], pa.float64()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(batches, ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id, as text, leaves remainder 1 modulo 3; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
