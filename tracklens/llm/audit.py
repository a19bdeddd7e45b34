"""How filters overlap under every order in which they may be applied.

Each document fails a set of filters, a mask.  Documents are counted by (part, mask), with those labelled good
and toxic; all else follows from these at most 32 cells of a part.  The orders are visited by
adjacent transpositions: each differs from the one before in two neighbouring
steps, and only these two are counted anew from the cells.  What a filter removes is added up along
the walk for its Shapley value.

Filters, on words (maximal runs without white space, case-sensitive): A under 100 words; B under
80 percent distinct words; C over 10 percent A-Z; D holds one of #$%&*|; E equal to the text of a smaller doc_id.

Null texts count as empty; a null doc_id is no smaller than any and has none smaller, so it never fails E.
Equal rows of the least doc_id of their text all pass E.  A null lang is the part ''.
A document with several rows in labels is good (toxic) if one of them says so; without any it is neither.
An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters, bit k of a mask the k-th.
FILTERS = "ABCDE"
#: Documents counted in a cell: all, good, toxic.
COUNTS = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D for a text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * distinct < 80 * n, 100 * upper > 10 * F.length(text), text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for k, f in enumerate(fails):
        mask = mask + f.cast("int") * (1 << k)
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail.

    Texts become hashes in the scan, so shuffles carry narrow rows.  A copy is told
    by joining (text hash, doc_id) with each text's least doc_id, keys that no
    group of copies makes hot; what doesn't join has failed E.  Equal rows are counted before each shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_id"), text_mask(text).cast("byte").alias("mask"))
    rows = rows.groupBy("doc_id", "part", "text_id", "mask").agg(F.count("*").alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    rows = rows.join(told, "doc_id", "left")
    first = rows.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    rows = rows.join(first, ["text_id", "doc_id"], "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    counted = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    return rows.groupBy("part", mask.cast("int").alias("mask")).agg(F.sum("n").alias("n"), counted(F.col("is_good")).alias("good"), counted(F.col("is_toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k such that swapping k and k + 1, one after the other, visits every order of n things once."""
    if n < 2:
        return
    down = list(range(n - 2, -1, -1))
    for k, inner in enumerate([*swaps(n - 1), None]):
        yield from down if k % 2 == 0 else reversed(down)
        if inner is not None:
            yield inner + (k % 2 == 0)


def walk(cell: np.ndarray) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all
    orders; cell: masks x COUNTS."""
    size = len(FILTERS)
    masks = np.arange(1 << size)
    fails = [(masks >> f & 1).astype(bool) for f in range(size)]
    total = [int(cell[x, 0].sum()) for x in fails]

    def of_step(before: int, f: int) -> tuple[int, ...]:
        """Counts of filter f after the filters of the mask before."""
        here = fails[f] & (masks & before == 0)
        n, good, toxic = (int(x) for x in cell[here].sum(axis=0))
        kept = int(cell[masks & (before | 1 << f) == 0, 0].sum())
        return kept, n, total[f] - n, int(cell[1 << f, 0]), good, toxic

    order = list(range(size))
    steps = [of_step(before, f) for before, f in zip([0, *accumulate(1 << f for f in order)], order, strict=False)]
    shapley, visited = [0] * size, []
    for swap in [None, *swaps(size)]:
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            before = sum(1 << f for f in order[:swap])
            steps[swap] = of_step(before, order[swap])
            steps[swap + 1] = of_step(before | 1 << order[swap], order[swap + 1])
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]
        visited.append((order[:], steps[:]))
    return [("".join(FILTERS[f] for f in o), k + 1, *s, shapley[f]) for o, each in visited for k, (f, s) in enumerate(zip(o, each, strict=True))]


def walk_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part, found in zip(frame["part"], frame["cells"], strict=True):
            cell = np.zeros((1 << len(FILTERS), len(COUNTS)), dtype=np.int64)
            for c in found:
                cell[c["mask"]] = [c[x] for x in COUNTS]
            out = pd.DataFrame(walk(cell), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
            out.insert(0, "part", part)
            yield out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic.  kept: documents left
    after the step; removed, good_lost, toxic_lost: taken here; redundant: failing its filter,
    but taken before; unique_fails: failing its filter only; shapley: what its filter takes, added up over all orders.
    """
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 32 a part
    return parts.mapInPandas(walk_parts, SCHEMA)
