"""Regression across folds from sums: no fold's training rows are joined or gathered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import gates


def ridge_loso(rows: DataFrame, features: list[str], target: str, alpha: float, group: str = "fold", median: bool = False) -> DataFrame:
    """For each group, n, intercept, coefficients (of the raw features) and fills of a ridge
    regression on all other groups' rows.

    Features are z-scored by population deviation (1 where that is below 1e-9),
    null ones stand for the training mean (or median), the fills; the intercept is free of the penalty.
    Rows without target drop out.  One row of moments per group is all that is
    solved in Python, a row at a time.
    """
    k = len(features)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    y, have = F.col(target).cast("double"), [F.col(c).isNotNull().cast("double") for c in features]
    # With nulls at one value of each group's training rows, cross moments need the counts and sums of what is present on both sides.
    terms = [F.lit(1.0), y, *x, *have, *[a * y for a in x], *[a * y for a in have]]
    terms += [x[i] * x[j] for i in range(k) for j in range(k)] + [x[i] * have[j] for i in range(k) for j in range(k)] + [have[i] * have[j] for i in range(k) for j in range(k)]
    names = [f"__m{i}" for i in range(len(terms))]
    own = rows.where(F.col(target).isNotNull()).groupBy(group).agg(*[F.sum(t).alias(n) for t, n in zip(terms, names, strict=True)])
    every = Window.partitionBy()  # one row a group
    train = own.select(group, F.array(*[F.sum(n).over(every) - F.col(n) for n in names]).alias("moments"))
    kind = train.schema[group].dataType.simpleString()
    if median:
        used = rows.where(F.col(target).isNotNull())
        for i, c in enumerate(features):
            middle = gates.training_quantiles(used, c, [0.5], group).select(F.col(group).alias("__g"), F.col("threshold").alias(f"__f{i}"))
            train = train.join(middle, F.col(group) == F.col("__g"), "left").drop("__g")
        train = train.withColumn("fills", F.array(*[F.coalesce(f"__f{i}", F.lit(0.0)) for i in range(k)]))
    else:
        train = train.withColumn("fills", F.lit(None).cast("array<double>"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(g, *_solve(np.asarray(m, float), k, alpha, f)) for g, m, f in zip(part[group], part["moments"], part["fills"], strict=True)]
            yield pd.DataFrame(out, columns=[group, "n", "intercept", "coefficients", "fills"])

    return train.select(group, "moments", "fills").mapInPandas(solve, f"{group} {kind}, n bigint, intercept double, coefficients array<double>, fills array<double>")


def _solve(m: np.ndarray, k: int, alpha: float, fills: np.ndarray | None) -> tuple[int, float, list[float], list[float]]:
    n, sy = m[0], m[1]
    if n < 0.5:
        return 0, float("nan"), [float("nan")] * k, [float("nan")] * k
    sx, sh, sxy, shy = (m[2 + i * k : 2 + (i + 1) * k] for i in range(4))
    xx, xh, hh = (m[2 + 4 * k + i * k * k : 2 + 4 * k + (i + 1) * k * k].reshape(k, k) for i in range(3))
    fill = sx / np.maximum(sh, 1) if fills is None else np.asarray(fills, float)
    mean = (sx + fill * (n - sh)) / n
    # Sums of products of the filled features, then about their means.
    lone = fill[None, :] * (sx[:, None] - xh)
    cross = xx + lone + lone.T + np.outer(fill, fill) * (n - sh[:, None] - sh[None, :] + hh) - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cross), 0) / n)
    std[std <= 1e-9] = 1
    with_y = sxy + fill * (sy - shy) - sy * mean
    beta = np.linalg.solve(cross / np.outer(std, std) + alpha * np.eye(k), with_y / std) / std
    return round(n), float(sy / n - beta @ mean), [float(b) for b in beta], [float(f) for f in fill]


def predicted(rows: DataFrame, models: DataFrame, features: list[str], group: str = "fold", name: str = "fitted") -> DataFrame:
    """rows plus their group's model's value; null features stand for the model's fills."""
    models = models.select(group, "intercept", "coefficients", "fills")
    value = F.col("intercept")
    for i, c in enumerate(features):
        value = value + F.get("coefficients", F.lit(i)) * F.coalesce(F.col(c), F.get("fills", F.lit(i)))
    return rows.join(models, group, "left").withColumn(name, value).drop("intercept", "coefficients", "fills")


def pair_gate(rows: DataFrame, a: str, b: str, a_at: list[float], b_at: list[float], target: float, least: int, group: str = "fold") -> DataFrame:
    """For each group, thresholds on two features chosen from the other groups.

    Rows at most at both thresholds are kept; the choice is that of
    ``gates.threshold_gate``, ties by a, then b.  Counts per (group, bin a, bin b)
    are added up along both axes, so each row is read once whatever the grid.
    """
    at = {a: F.array(*[F.lit(float(t)) for t in a_at]), b: F.array(*[F.lit(float(t)) for t in b_at])}

    def spot(c: str) -> Column:
        return F.size(F.filter(at[c], lambda t: t < F.col(c)))

    used = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("error").isNotNull())
    cells = used.groupBy(group, spot(a).alias("i"), spot(b).alias("j")).agg(F.count("*").alias("n"), F.sum("error").alias("e"))
    grid = cells.select(group).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(a_at) - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(b_at) - 1))))
    sums = grid.join(cells, [group, "i", "j"], "left").fillna(0, ["n", "e"])
    for along, across in (("i", "j"), ("j", "i")):
        w = Window.partitionBy(group, across).orderBy(along)
        sums = sums.withColumns({"n": F.sum("n").over(w), "e": F.sum("e").over(w)})
    every = Window.partitionBy("i", "j")
    train = sums.withColumns({"train_n": F.sum("n").over(every) - F.col("n"), "train_e": F.sum("e").over(every) - F.col("e")}).where(F.col("train_n") >= least)
    train = train.withColumn("mean", F.col("train_e") / F.col("train_n"))
    good = F.col("mean") <= target
    order = Window.partitionBy(group).orderBy(good.desc(), F.when(good, -F.col("train_n")), F.when(~good, F.col("mean")), "i", "j")
    best = train.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.select(group, F.get(at[a], F.col("i")).alias(a), F.get(at[b], F.col("j")).alias(b), "train_n", "mean", F.col("n").alias("kept"))
