"""Threshold search for confidence gates, leave-one-sequence-out, by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .joins import less_own


#: Rows of a group up to which its thresholds are looked for near the common ones, and parts of all values
#: whose rows are counted to find those.
SMALL, PARTS = 2048, 1024
#: Sums near the thresholds, over all rows, that are sent to every task.
NEAR_SUMS = 1 << 20


@dataclass
class Near:
    """The values of an axis among which groups of least to most rows find thresholds (values) and how many of all rows are at or below each (upto)."""

    values: np.ndarray
    upto: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """2k + 1 of the k-th value, 2k of what lies before it and after the one before; thresholds are at or above both ends of a gap or at or below both."""
        at = np.searchsorted(self.values, x, side="left")
        return 2 * at + (np.append(self.values, np.nan)[at] == x)

    def thresholds(self, codes: np.ndarray, total: int, shares: np.ndarray) -> np.ndarray:
        """The interpolated quantiles of all rows less those with these codes."""
        own = np.bincount(codes // 2, minlength=len(self.values) + 1).cumsum()[:-1]
        at = (total - len(codes) - 1) * shares
        low, high = (self.values[np.searchsorted(self.upto - own, f(at) + 1, side="left")] for f in (np.floor, np.ceil))
        return low + (at - np.floor(at)) * (high - low)

    def places(self, thresholds: np.ndarray) -> np.ndarray:
        """For each code how many thresholds lie below its values."""
        out = np.zeros(2 * len(self.values) + 1, dtype=int)
        for first, side in ((1, "right"), (2, "left")):
            out[first::2] = np.bincount(np.searchsorted(self.values, thresholds, side=side), minlength=len(self.values) + 1).cumsum()[:-1]
        return out


def _near(used: DataFrame, xs: list[str], shares: list[float], total: int, least: int, most: int) -> list[Near]:
    """For each axis what groups of least to most rows need.

    A quantile of the others has, among all rows, a rank at most the group's rows beyond its own, so that those of
    all groups and one share lie in a window of about twice ``most`` ranks, however many rows there are.  Rows are counted by parts
    of the values, and only the parts that hold windows are put in order; approximate ends make parts larger, never wrong.
    """
    told = used.agg(*[F.percentile_approx(x, [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias(x) for x in xs]).first()
    cuts = [np.unique(told[x]) for x in xs]
    windows = [(int(np.floor((total - most - 1) * s)) + 1, int(np.ceil((total - least - 1) * s)) + 1 + most) for s in shares]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(c) + 1, dtype=np.int64) for c in cuts]
        for batch in batches:
            for i, x in enumerate(xs):
                sums[i] += np.bincount(np.searchsorted(cuts[i], batch.column(x).to_numpy(zero_copy_only=False)), minlength=len(sums[i]))
        axis = np.repeat(np.arange(len(xs)), [len(s) for s in sums])
        yield pa.RecordBatch.from_arrays([pa.array(axis, pa.int32()), pa.array(np.concatenate([np.arange(len(s)) for s in sums]), pa.int32()), pa.array(np.concatenate(sums))], ["axis", "part", "n"])

    found = used.select(*xs).mapInArrow(counted, "axis int, part int, n bigint").groupBy("axis", "part").agg(F.sum("n").alias("n")).toPandas()  # PARTS rows an axis
    upto = [np.zeros(len(c) + 1, dtype=np.int64) for c in cuts]
    for axis, part, n in found.itertuples(index=False):
        upto[axis][part] = n
    before = [u.cumsum() - u for u in upto]
    holds = [np.any([(b < last) & (b + u >= first) for first, last in windows], axis=0) for b, u in zip(before, upto, strict=True)]

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(xs):
                value = batch.column(x).to_numpy(zero_copy_only=False)
                part = np.searchsorted(cuts[i], value)
                there = holds[i][part]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(there.sum(), i), pa.int32()), pa.array(part[there], pa.int32()), pa.array(value[there])], ["axis", "part", "x"])

    cells = used.select(*xs).mapInArrow(taken, "axis int, part int, x double").groupBy("axis", "part", "x").agg(F.count("*").alias("n"))
    starts = used.sparkSession.createDataFrame([(i, int(p), int(before[i][p])) for i in range(len(xs)) for p in np.flatnonzero(holds[i])], "axis int, part int, before bigint")
    cells = cells.withColumn("within", F.sum("n").over(Window.partitionBy("axis", "part").orderBy("x"))).join(F.broadcast(starts), ["axis", "part"])
    cells = cells.select("axis", "x", "n", (F.col("before") + F.col("within")).alias("upto"))
    met = F.lit(False)
    for first, last in windows:
        met = met | ((F.col("upto") >= first) & (F.col("upto") - F.col("n") < last))
    near = cells.where(met).toPandas().sort_values(["axis", "x"])  # a window's values for each axis and share
    each = [near[near["axis"] == i] for i in range(len(xs))]
    return [Near(e["x"].to_numpy(dtype=float), e["upto"].to_numpy(dtype=np.int64)) for e in each]


def _sizes(used: DataFrame) -> tuple[int, int, int, bool]:
    """Of a table by groups (g): all rows, the rows of the least group and of the greatest up to SMALL (0 where there is none), and whether there are greater groups."""
    n = F.col("n")
    row = used.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum(n), F.min(n), F.max(F.when(n <= SMALL, n)), F.max(n)).first()
    return row[0] or 0, row[1] or 0, row[2] or 0, (row[3] or 0) > SMALL


def _gathered(used: DataFrame, columns: list[str]) -> DataFrame:
    """g and own, the rows (columns) of each group of up to SMALL rows."""
    some = used.join(used.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("g"), "g", "left_semi")
    return some.groupBy("g").agg(F.collect_list(F.struct(*columns)).alias("own"))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches of ``_gathered`` as the column of groups, the fields of own as arrays, and where each group's rows end."""
    for batch in batches:
        own = batch.column("own")
        flat = own.flatten()
        fields = [flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type]
        yield batch.column("g"), fields, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))


def training_quantiles(rows: DataFrame, feature: str, shares: list[float], group: str = "fold") -> DataFrame:
    """group, share, threshold: for each group, the interpolated quantiles of the other groups' values.

    Groups of up to SMALL rows look for theirs near the common quantiles, all with the same few values; greater ones,
    of which there are at most rows / SMALL, among the ranks of all values.
    """
    x = F.col(feature).cast("double")
    used = written(rows.where(F.col(group).isNotNull() & x.isNotNull()).select(F.col(group).alias("g"), x.alias("x")), "training")
    total, least, most, greater = _sizes(used)
    out = _ranked_quantiles(used, shares, SMALL if most else 0) if greater or not most else None
    if most:
        near, at = _near(used, ["x"], shares, total, least, most)[0], np.array(shares)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, (value,), ends in _by_group(batches):
                codes, found, kept = near.codes(value), [], []
                for j, (first, last) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    if last - first < total:
                        found.append(near.thresholds(codes[first:last], total, at))
                        kept.append(j)
                yield pa.RecordBatch.from_arrays([g.take(pa.array(np.repeat(kept, len(at)), pa.int32())), pa.array(np.tile(at, len(kept))), pa.array(np.concatenate([np.empty(0), *found]))], ["g", "share", "threshold"])

        told = _gathered(used, ["x"]).mapInArrow(find, f"g {used.schema['g'].dataType.simpleString()}, share double, threshold double")
        out = told if out is None else out.unionByName(told)
    return out.withColumnRenamed("g", group)


def _ranked_quantiles(used: DataFrame, shares: list[float], above: int) -> DataFrame:
    """g, share, threshold for the groups of more than ``above`` rows (g, x).

    The values are ranked once, by distinct value; a group's training ranks are those
    ranks less its own rows below, so no fold's training rows are joined or gathered.
    Ranks over all rows come from the ranks within each of RANGES value ranges and the counts of the ranges before.
    """
    cells = used.groupBy("x", "g").agg(F.count("*").alias("own"))
    sizes = cells.groupBy("g").agg(F.sum("own").alias("own_n"))
    sizes = sizes.withColumn("__one", F.lit(1)).join(F.broadcast(sizes.agg(F.sum("own_n").alias("all_n")).withColumn("__one", F.lit(1))), "__one").drop("__one")
    cuts = cells.agg(F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts")).withColumn("__one", F.lit(1))
    values = cells.groupBy("x").agg(F.sum("own").alias("c")).withColumn("__one", F.lit(1)).join(F.broadcast(cuts), "__one")
    values = values.select("x", "c", F.size(F.filter("cuts", lambda t: t < F.col("x"))).alias("range"))
    before = values.groupBy("range").agg(F.sum("c").alias("c"))
    before = before.select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))  # one row a range
    up_to = F.sum("c").over(Window.partitionBy("range").orderBy("x"))
    ranked = values.withColumn("upto", up_to).join(F.broadcast(before), "range").select("x", "c", (F.col("before") + F.col("upto")).alias("upto"))
    # A wanted rank of a group lies among all values below that of rank + own rows; the own
    # rows split the values into stretches on which own rows below are constant.
    ranked = written(ranked, "ranked")
    sizes = sizes.where(F.col("own_n") > above)
    own = cells.join(sizes.select("g"), "g", "left_semi").join(ranked, "x").select("g", "x", "own", "upto", "c")
    inside = Window.partitionBy("g").orderBy("x")
    own_upto = F.sum("own").over(inside)
    own = written(own, "own")
    stretches = own.withColumns({"own_upto": own_upto, "next_from": F.lead(F.col("upto") - F.col("c")).over(inside), "low": F.col("upto") - F.col("c") - (own_upto - F.col("own"))})
    # Training ranks (from 1) before the first own value, of an own value, if other groups have it, and of the
    # stretch after it: rank + shift is a rank among all.  All come from one row, so nothing is dealt twice.
    stretches = stretches.withColumn("opens", F.row_number().over(inside) == 1).join(sizes.select("g", "all_n"), "g")
    part = lambda there, first, last, shift, x: F.when(there, F.struct(first.alias("first"), last.alias("last"), shift.cast("bigint").alias("shift"), x.cast("double").alias("x")))
    head = part(F.col("opens"), F.lit(1).cast("bigint"), F.col("upto") - F.col("c"), F.lit(0), F.lit(None))
    at_value = part(F.col("c") > F.col("own"), F.col("low") + 1, F.col("low") + F.col("c") - F.col("own"), F.lit(None), F.col("x"))
    after = part(F.lit(True), F.col("upto") - F.col("own_upto") + 1, F.coalesce("next_from", "all_n") - F.col("own_upto"), F.col("own_upto"), F.lit(None))
    parts = stretches.select("g", F.explode(F.array_compact(F.array(head, at_value, after))).alias("p")).select("g", "p.*").where("last >= first")
    position = lambda s: (F.col("all_n") - F.col("own_n") - 1) * F.lit(s)
    each = F.array(*[F.struct(F.lit(s).alias("share"), position(s).alias("at")) for s in shares])
    wanted = sizes.where("all_n > own_n").select("g", F.explode(each).alias("w")).select("g", "w.share", "w.at")
    wanted = wanted.select("g", "share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k")).withColumn("rank", F.col("k") + 1)
    told = wanted.join(parts, "g").where(F.col("rank").between(F.col("first"), F.col("last"))).select("g", "share", "at", "k", "x", (F.col("rank") + F.col("shift")).alias("place"))
    told = written(told, "told")
    spread = ranked.select(F.col("x").alias("value"), F.explode(F.sequence(F.floor((F.col("upto") - F.col("c")) / STEP), F.floor((F.col("upto") - 1) / STEP))).alias("step"), "upto", (F.col("upto") - F.col("c")).alias("from_"))
    missing = told.where("x IS NULL").withColumn("step", F.floor((F.col("place") - 1) / STEP)).join(spread, "step").where((F.col("place") > F.col("from_")) & (F.col("place") <= F.col("upto")))
    values = told.where("x IS NOT NULL").select("g", "share", "at", "k", "x").unionByName(missing.select("g", "share", "at", "k", F.col("value").alias("x")))
    low, high = F.min("x"), F.max("x")
    found = values.groupBy("g", "share").agg((low + (F.first("at") - F.floor(F.first("at"))) * (high - low)).alias("threshold"))
    return found.select("g", "share", "threshold")


#: Ranges of values that are ranked apart, and ranks that are looked up together.
RANGES, STEP = 256, 1024


def threshold_gate(rows: DataFrame, feature: str, shares: list[float], target: float, least: int, group: str = "fold") -> DataFrame:
    """For each group, the threshold on ``feature`` chosen from the other groups.

    Thresholds are the ``shares`` quantiles of the training rows.  Kept rows have a
    feature of at most the threshold.  Of the thresholds that
    keep at least ``least`` training rows at a mean error of at most ``target``,
    the one that keeps most wins (the least of equals); if there is none, the one
    of least mean error.
    """
    return feature_gate(rows, [feature], shares, target, least, group).withColumnRenamed(feature, "threshold")


#: Value ranges of an axis are found in two steps of so many cuts each.
TREE = 32


def feature_gate(rows: DataFrame, features: list[str], shares: list[float], target: float, least: int, group: str = "fold") -> DataFrame:
    """For each group, thresholds on two or three features chosen from the other groups.

    The thresholds are the training rows' quantiles of each feature, so every group has a grid of its
    own.  Kept rows are at or below all thresholds; the choice is that of ``threshold_gate``, ties by the last
    feature's threshold, then the first's, then the second's.

    Groups of up to SMALL rows have their thresholds near the common ones: over all rows there are few sums of cells that these may
    part, and each group adds up these and its own rows (``_near_gate``).  Greater groups, and all where there are more than NEAR_SUMS such sums,
    are counted over a common grid (``_common_gate``).
    """
    xs = [f"x{i}" for i in range(len(features))]
    used = rows.where(F.col(group).isNotNull() & F.col("error").isNotNull())
    for f in features:
        used = used.where(F.col(f).isNotNull())
    used = written(used.select(F.col(group).alias("g"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs, strict=True)], F.col("error").cast("double").alias("error")), "gate")
    sizes = _sizes(used)
    small = _near_gate(used, xs, shares, target, least, sizes) if sizes[2] else None
    found = _common_gate(used, xs, shares, target, least, SMALL if small is not None else 0) if sizes[3] or small is None else None
    found = small if found is None else found if small is None else small.unionByName(found)
    return found.select(F.col("g").alias(group), *[F.col(x).alias(f) for x, f in zip(xs, features, strict=True)], "train_n", "mean", "kept", "kept_error")


def _near_gate(used: DataFrame, xs: list[str], shares: list[float], target: float, least: int, sizes: tuple[int, int, int, bool]) -> DataFrame | None:
    """The choices of the groups of up to SMALL rows; None where there are more sums than tasks can take."""
    total, d, k = sizes[0], len(xs), len(shares)
    near, at = _near(used, xs, shares, *sizes[:3]), np.array(shares)
    names, strides = [f"c{i}" for i in range(d)], [(k + 1) ** (d - 1 - i) for i in range(d)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pa.array(a.codes(batch.column(x).to_numpy(zero_copy_only=False)), pa.int32()) for a, x in zip(near, xs, strict=True)]
            yield pa.RecordBatch.from_arrays([*codes, batch.column("error")], [*names, "e"])

    sums = used.mapInArrow(coded, f"{', '.join(f'{c} int' for c in names)}, e double").groupBy(*names).agg(F.count("*").alias("n"), F.sum("e").alias("e")).limit(NEAR_SUMS + 1).toPandas()
    if len(sums) > NEAR_SUMS:
        return None
    sums = sums.sort_values(names)
    every, n, e = [sums[c].to_numpy() for c in names], sums["n"].to_numpy(dtype=float), sums["e"].to_numpy(dtype=float)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, (*values, error), ends in _by_group(batches):
            codes, out, kept = [a.codes(v) for a, v in zip(near, values, strict=True)], [], []
            for j, (first, last) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if last - first == total:
                    continue
                own = [c[first:last] for c in codes]
                thresholds = [a.thresholds(c, total, at) for a, c in zip(near, own, strict=True)]
                places = [a.places(t) for a, t in zip(near, thresholds, strict=True)]
                grid = lambda c, w, places=places: np.bincount(sum(p[x] * s for p, x, s in zip(places, c, strides, strict=True)), w, (k + 1) ** d).reshape((k + 1,) * d)[(slice(k),) * d]
                own_n, own_e = grid(own, np.ones(last - first)), grid(own, error[first:last])
                found = _best(thresholds, (grid(every, n) - own_n, grid(every, e) - own_e, own_n, own_e), target, least)
                if found:
                    out.append(found)
                    kept.append(j)
            columns = list(zip(*out, strict=True)) or [()] * (d + 4)
            kinds = [pa.float64()] * d + [pa.int64(), pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([g.take(pa.array(kept, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["g", *xs, "train_n", "mean", "kept", "kept_error"])

    return _gathered(used, [*xs, "error"]).mapInArrow(choose, _found(used, xs))


def _found(used: DataFrame, xs: list[str]) -> str:
    return f"g {used.schema['g'].dataType.simpleString()}, {', '.join(f'{x} double' for x in xs)}, train_n bigint, mean double, kept bigint, kept_error double"


def _common_gate(used: DataFrame, xs: list[str], shares: list[float], target: float, least: int, above: int) -> DataFrame:
    """The choices of the groups of more than ``above`` rows.

    No row meets every group: all rows are counted once over a common grid, by quantiles of all rows.
    A row lies in another cell of a group's own grid only if one of the group's thresholds and the
    common one are on either side of it.  A group of n rows moves each quantile by at most n ranks, so those
    rows are at most features x shares x rows over all groups, however uneven these are; they are found by a join on value ranges.
    Cells of a group are common ones, with moved rows taken from one and given to another, less the group's own rows; running sums
    along the axes give the counts below each choice of thresholds, at most shares ** features a group.
    """
    d, k = len(xs), len(shares)
    axes = range(d)
    cells = [f"c{i}" for i in axes]
    own_at = None
    for i, x in enumerate(xs):
        at = _ranked_quantiles(used.select("g", F.col(x).alias("x")), shares, above).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("share", "threshold"))), lambda q: q["threshold"]).alias(f"t{i}"))
        own_at = at if own_at is None else own_at.join(at, "g")
    own_at = written(own_at, "gate-thresholds")
    many = TREE * TREE
    common = used.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"r{i}") for i, x in enumerate(xs)], *[F.percentile_approx(x, [j / many for j in range(1, many)], 10 * many).alias(f"v{i}") for i, x in enumerate(xs)]).withColumn("__one", F.lit(1))
    spot = lambda at, x: F.size(F.filter(at, lambda t: t < x))

    def blocks(i: int) -> Column:
        """The cuts of axis i, TREE by TREE."""
        return F.transform(F.sequence(F.lit(0), F.lit(TREE - 1)), lambda j: F.slice(f"v{i}", j * TREE + 1, TREE))

    common = written(common.select("__one", *[f"r{i}" for i in axes], *[blocks(i).alias(f"v{i}") for i in axes]), "gate-common")

    def span(i: int, x: Column) -> Column:
        """The value range of x on axis i; greater values have no lesser range."""
        block = F.size(F.filter(F.slice(F.transform(f"v{i}", lambda b: F.element_at(b, -1)), 1, TREE - 1), lambda t: t < x))
        return block * TREE + F.size(F.filter(F.get(f"v{i}", block), lambda t: t < x))

    def with_common(df: DataFrame) -> DataFrame:
        return df.withColumn("__one", F.lit(1)).join(F.broadcast(common), "__one").drop("__one")

    points = used.groupBy(*xs).agg(F.count("*").alias("n"), F.sum("error").alias("e"))
    points = with_common(points).select(*xs, "n", "e", *[spot(F.col(f"r{i}"), F.col(xs[i])).alias(f"c{i}") for i in axes], F.array(*[span(i, F.col(xs[i])) for i in axes]).alias("spans"))
    points = written(points, "gate-points")
    # Ranges in which a group's thresholds and the common ones differ.
    apart = with_common(own_at)

    def between(i: int) -> Column:
        each = F.transform(F.arrays_zip(F.col(f"r{i}").alias("r"), F.col(f"t{i}").alias("t")), lambda z: F.when(z["r"] != z["t"], F.sequence(span(i, F.least(z["r"], z["t"])), span(i, F.greatest(z["r"], z["t"])))))
        return F.transform(F.array_distinct(F.flatten(F.array_compact(each))), lambda b: F.struct(F.lit(i).alias("axis"), b.alias("span")))

    thresholds = [f"t{i}" for i in axes]
    apart = apart.select("g", *thresholds, F.explode(F.concat(*[between(i) for i in axes])).alias("w")).select("g", *thresholds, "w.axis", "w.span")
    near = points.select(*xs, "n", "e", *cells, F.posexplode("spans").alias("axis", "span")).join(apart, ["axis", "span"])
    mine = [spot(F.col(t), F.col(x)) for t, x in zip(thresholds, xs, strict=True)]
    near = near.withColumns({f"m{i}": c for i, c in enumerate(mine)})
    # A row that several axes move is taken at the first of them.
    first = F.coalesce(*[F.when(F.col(f"m{i}") != F.col(f"c{i}"), i) for i in axes])
    nothing = F.lit(0).cast("bigint")
    change = lambda names, n, e, own_n, own_e: F.struct(*[F.col(m).alias(c) for m, c in zip(names, cells, strict=True)], n.alias("n"), e.alias("e"), own_n.alias("own_n"), own_e.alias("own_e"))
    moved = near.where(first == F.col("axis")).select("g", F.explode(F.array(change(cells, -F.col("n"), -F.col("e"), nothing, F.lit(0.0)), change([f"m{i}" for i in axes], F.col("n"), F.col("e"), nothing, F.lit(0.0)))).alias("p")).select("g", "p.*")
    own = used.join(own_at, "g").withColumns({f"m{i}": c for i, c in enumerate(mine)})
    own = own.select("g", change([f"m{i}" for i in axes], -F.lit(1).cast("bigint"), -F.col("error"), F.lit(1).cast("bigint"), F.col("error")).alias("p")).select("g", "p.*")
    sums = [F.sum(c).alias(c) for c in ("n", "e", "own_n", "own_e")]
    kept_cells = moved.unionByName(own).where(" AND ".join(f"{c} < {k}" for c in cells)).groupBy("g", *cells).agg(*sums)
    of_group = kept_cells.groupBy("g").agg(F.collect_list(F.struct(*cells, "n", "e", "own_n", "own_e")).alias("own"))  # at most k ** d
    every = points.where(" AND ".join(f"{c} < {k}" for c in cells)).groupBy(*cells).agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    every = every.agg(F.collect_list(F.struct(*cells, "n", "e")).alias("every")).withColumn("__one", F.lit(1))  # at most k ** d
    # A group whose rows all lie above its thresholds has no cells.
    whole = own_at.join(of_group, "g", "left").withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one").drop("__one")

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                grids = [np.zeros((k,) * d) for _ in range(4)]
                for names, sums in ((("n", "e"), row["every"]), (("n", "e", "own_n", "own_e"), row["own"] if row["own"] is not None else [])):
                    for c in sums:
                        for grid, name in zip(grids, names, strict=False):
                            grid[tuple(c[x] for x in cells)] += c[name]
                found = _best([row[t] for t in thresholds], grids, target, least)
                if found:
                    out.append((row["g"], *found))
            yield pd.DataFrame(out, columns=["g", *xs, "train_n", "mean", "kept", "kept_error"])

    return whole.mapInPandas(choose, _found(used, xs))


def _best(thresholds: list, grids: tuple | list, target: float, least: int) -> tuple | None:
    """The thresholds chosen from the cells' sums of training rows and errors, own rows and errors, with train_n, mean, kept and kept_error; None if none keeps enough rows."""
    d = len(thresholds)
    grids = [np.array(g) for g in grids]
    for grid in grids:
        for axis in range(d):
            np.cumsum(grid, axis=axis, out=grid)
    last_first = (d - 1, *range(d - 1)) if d > 2 else tuple(range(d))
    n, e, own_n, own_e = (g.transpose(last_first) for g in grids)
    valid = np.rint(n) >= least
    if not valid.any():
        return None
    mean = np.where(valid, np.round(e / np.maximum(n, 1), 9), np.inf)
    good = mean <= target
    at = np.unravel_index(np.argmax(np.where(good, np.rint(n), -1)) if good.any() else np.argmin(mean), n.shape)
    place = dict(zip(last_first, at, strict=True))
    return (*[float(thresholds[i][place[i]]) for i in range(d)], round(n[at]), float(e[at] / n[at]), round(own_n[at]), float(own_e[at]))


def gated(rows: DataFrame, found: DataFrame, bounds: dict[str, str], group: str = "fold") -> DataFrame:
    """The rows whose features lie at or below their group's thresholds (feature: threshold column)."""
    named = found.select(group, *[F.col(t).alias(f"__{t}") for t in bounds.values()])
    joined = rows.join(named, group)
    for feature, t in bounds.items():
        joined = joined.where(F.col(feature) <= F.col(f"__{t}"))
    return joined.select(*rows.columns)


def family_gate(rows: DataFrame, member: Column, features: list[str], shares: list[float], target: float, least: int, group: str = "fold") -> DataFrame:
    """Thresholds for the rows of a family (``member``), for each group that has such rows, chosen from the other groups.

    A group is trained on the others' rows of the family or, where those are fewer than ``least``, on all rows of the others
    (``widened``); both are ``feature_gate``'s choice.  Beside the thresholds, train_n and mean come ``tested`` (the group's rows of the
    family), and ``kept`` and ``kept_error`` of those at or below the thresholds.  Rows without error, group or a feature count
    nowhere, those of unknown membership are not of the family; a group without a choice that keeps ``least`` training rows has no row.
    """
    names = [f"f{i}" for i in range(len(features))]
    used = rows.select(F.col(group).alias("g"), F.coalesce(member, F.lit(False)).alias("member"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)], "error")
    used = written(used.where(" AND ".join(f"{c} IS NOT NULL" for c in ("g", "error", *names))), "gate-family")
    own = used.groupBy("g").agg(F.count_if("member").alias("tested")).withColumn("train", F.col("tested"))
    asked = written(less_own(own, ["train"]).where("tested > 0").select("g", "tested", (F.col("train") < least).alias("widened")), "gate-asked")
    mine = used.where("member")
    found = None
    # Most runs need one of the two; which, the groups' counts tell.
    for widened in [r["widened"] for r in asked.select("widened").distinct().collect()]:
        chosen = feature_gate(used if widened else mine, names, shares, target, least, "g").drop("kept", "kept_error")
        part = asked.where(F.col("widened") == widened).join(chosen, "g")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = asked.join(feature_gate(mine, names, shares, target, least, "g").drop("kept", "kept_error"), "g")
    found = written(found, "gate-found")
    kept = gated(mine, found, {n: n for n in names}, "g").groupBy("g").agg(F.count("*").alias("kept"), F.sum("error").alias("kept_error"))
    out = found.join(kept, "g", "left").fillna(0, ["kept"])
    return out.select(F.col("g").alias(group), *[F.col(n).alias(f) for n, f in zip(names, features, strict=True)], "widened", "tested", "train_n", "mean", "kept", "kept_error")


def decided(rows: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """rows plus kept, as the decisions (``on``, kept) have it, of repeated ones any; false where there is none."""
    told = decisions.groupBy(*on).agg(F.bool_or("kept").alias("kept"))
    return rows.drop("kept").join(told, on, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def log_affine(rows: DataFrame, group: str = "fold") -> DataFrame:
    """ln truth = a + b ln pred, fitted for each group on all others from sums."""
    x, y = F.log("pred"), F.log("truth")
    used = rows.where("pred > 0 AND truth > 0")
    own = used.groupBy(group).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    t = less_own(own, ["n", "x", "y", "xx", "xy"])
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    return t.withColumn("b", slope).withColumn("a", (F.col("y") - F.col("b") * F.col("x")) / F.col("n")).select(group, F.col("n").cast("bigint").alias("n"), "a", "b")
