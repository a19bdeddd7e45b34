"""Document fingerprints by spot signatures, DataFrame functions only.

A text is lower-cased and cut into words (runs of letters and digits).  At every
anchor, one of the common words ANCHORS, the CHAIN content words (words that are
no anchors) that follow form a signature with the anchor, however many further
anchors lie between; at the text's end a chain may be shorter.  A signature is kept as 16
hexadecimal digits of its MD5 (64 bits: two different ones of a million in
a pair of texts coincide with a chance of some 10**-8).  A text's fingerprint is its sorted set of
signatures, one after the other; a text without any signature has the one signature of its whole
word sequence, or of its raw text if it has no word; the empty text's fingerprint
is empty.

Likeness is the Jaccard similarity of two sets; two empty sets are alike.  Sets
are partitioned by length: sets whose length classes are neither equal nor
neighbours cannot be near copies, and only the others are compared for that.

Repeated rows have equal fingerprints; columns other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

#: Common words of English, French, German and Spanish.
ANCHORS = ("a an and are as at be by for from in is it of on or that the this to was with au avec dans de des du elle est et la le les ou par pas pour que qui sur un une auf das dem den der die ein eine im ist mit nicht sich und von zu con del el en las los no para por se su una y").split()  # noqa: SIM905
CHAIN = 2
DIGITS = 16
#: Similarity from which documents count as near copies.
SIMILAR = 0.8


def _any_anchor() -> str:
    """A pattern for the anchors, grouped by first letter so that a word tries few of them."""
    rests: dict[str, list[str]] = {}
    for a in ANCHORS:
        rests.setdefault(a[0], []).append(a[1:])
    return "|".join(f"{first}(?:{'|'.join(r)})(?![^ ])" for first, r in sorted(rests.items()))


def _signature(anchor: Column, chain: Column) -> Column:
    return F.substring(F.md5(F.concat(anchor, F.lit(" "), chain)), 1, DIGITS)


def with_signatures(df: DataFrame, text: str, into: str) -> DataFrame:
    """df plus the sorted distinct signatures of a non-null text, as string array."""
    joined = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    keep = [c for c in df.columns if c != into]
    df = df.select(*keep, joined.alias("__joined"))
    # A line for each run of anchors and the content words after it; the anchors of a
    # run are set apart by tabs.  The first line precedes all anchors.
    before_anchor = rf"(?<![^ ])(?=[{''.join(sorted({a[0] for a in ANCHORS}))}])(?={_any_anchor()})"
    longest = max(map(len, ANCHORS))
    runs = F.regexp_replace(F.regexp_replace("__joined", before_anchor, "\n"), rf"(?<=\n[^ ]{{1,{longest}}} )\n", "\t")
    df = df.select(*keep, "__joined", F.split(runs, "\n").alias("__runs"))

    def content(run: Column) -> Column:
        """The first words after a run's anchors."""
        last = F.substring_index(run, "\t", -1)
        return F.when(F.instr(last, " ") > 0, F.nullif(F.trim(F.substring_index(F.substring(last, F.instr(last, " ") + 1, F.length(last)), " ", CHAIN)), F.lit("")))

    # Every line but the last has a content word, so CHAIN lines hold a chain.
    df = df.select("*", F.transform("__runs", content).alias("__content"))

    def signatures(i: Column) -> Column:
        chain = F.substring_index(F.concat_ws(" ", *[F.get("__content", i + k) for k in range(CHAIN)]), " ", CHAIN)
        anchors = F.transform(F.split(F.get("__runs", i), "\t"), lambda a: F.substring_index(a, " ", 1))
        return F.transform(anchors, lambda a: _signature(a, chain))

    n = F.size("__runs")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), signatures))))
    whole = F.array(_signature(F.lit(""), F.when(F.col("__joined") == "", F.col(text)).otherwise(F.col("__joined"))))
    sigs = F.when(F.col(text) == "", F.array().cast("array<string>")).when(n > 1, found).otherwise(whole)
    return df.select(*keep, sigs.alias(into))


def fingerprint(sigs: Column) -> Column:
    """The signatures, one after the other."""
    return F.array_join(sigs, "")


def length_class(sigs: Column, similar: float = SIMILAR) -> Column:
    """Sets of likeness ``similar`` or more lie in the same or in neighbouring classes."""
    return F.when(F.size(sigs) > 0, F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / similar)) + 1e-9)).otherwise(-1).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / F.greatest(union, F.lit(1)))


def is_near_copy(a: Column, b: Column, similar: float = SIMILAR) -> Column:
    """Likeness of at least ``similar``; pruned by the sets' lengths first."""
    apart = F.abs(length_class(a, similar) - length_class(b, similar)) > 1
    return F.when(apart, False).otherwise(likeness(a, b) >= similar)


def _bounds(rows: DataFrame, n: int) -> tuple[list[int], dict[int | None, int]]:
    """About n quantiles of the key, each once, and into how many parts the rows of
    one key (null, too) fall where it holds several shares of 1/n."""
    shares = [k / n for k in range(1, n)]
    found, total, nulls = rows.agg(F.percentile_approx("key", shares or [0.5], max(10_000, 10 * n)), F.count("*"), F.count_if(F.col("key").isNull())).first()
    found = found or []
    parts = {k: found.count(k) for k in set(found) if found.count(k) > 1}
    if total and nulls * n > total:
        parts[None] = -(-nulls * n // total)
    return sorted(set(found)), parts


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search; -1 for null."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    all_bounds = F.lit(bounds)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    below = lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(all_bounds, acc + s - 1) <= key), acc + s).otherwise(acc)
    return F.when(key.isNull(), -1).otherwise(F.aggregate(F.lit(steps), F.lit(0), below))


def _part(key: Column, tie: Column, parts: dict[int | None, int]) -> Column:
    """Which part of a hot key's rows, by the hash that orders them; -1 for other keys, which come first."""
    out = F.lit(-1)
    place = F.conv(F.substring(tie, 1, 8), 16, 10).cast("bigint")
    for value, n in parts.items():
        out = F.when(key.isNull() if value is None else key == value, F.floor(place * n / F.lit(1 << 32)).cast("int")).otherwise(out)
    return out


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, sigs, next_text and next_sigs, where next is the next row by
    descending key (ties by the text's MD5; null keys come last); the last row's
    next is the first.

    Rows are dealt to buckets of neighbouring keys, those of a key that fills
    several buckets by their place among its rows, so that the texts are
    shuffled once; the first row of each bucket, found by its key, is what the
    last row of the bucket above looks at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds, parts = _bounds(rows, 4 * partitions(spark))
    rows = rows.withColumn("tie", F.md5("text"))
    rows = rows.withColumns({"bucket": _bucket(F.col("key"), bounds), "part": _part(F.col("key"), F.col("tie"), parts)})
    inside = Window.partitionBy("bucket", "part").orderBy(F.col("key").desc_nulls_last(), F.col("tie"))
    df = with_signatures(rows.withColumn("next_text", F.lead("text").over(inside)), "text", "sigs")
    df = df.withColumn("next_sigs", F.lead("sigs").over(inside))

    # At most one row for each bucket from here on.
    tops = rows.groupBy("bucket", "part").agg(F.max("key").alias("top_key"))
    firsts = rows.join(F.broadcast(tops), ["bucket", "part"]).where(F.col("key").eqNullSafe(F.col("top_key"))).groupBy("bucket", "part").agg(F.min_by("text", "tie").alias("text"))
    below = Window.orderBy(F.desc("bucket"), F.asc("part"))
    chain = firsts.select("bucket", "part", F.coalesce(F.lead("text").over(below), F.first("text").over(below)).alias("first_text"))
    after = with_signatures(chain, "first_text", "first_sigs")
    df = df.join(after, ["bucket", "part"], "left")
    inner = F.col("next_text").isNotNull()
    return df.select("key", "text", "sigs", F.coalesce("next_text", "first_text").alias("next_text"), F.when(inner, F.col("next_sigs")).otherwise(F.col("first_sigs")).alias("next_sigs"))
