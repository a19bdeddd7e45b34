"""Recursive clips along sequences of any length, by composed maps of blocks.

A clip's step sends the clamped value before, s, to the value p held within [s - d, s + d] (or [s / r, s * r]): a monotone
piecewise-linear map of s.  Rows are sorted over ranges of (seq, start), so a long sequence lies in many
partitions; each block of at most BLOCK rows composes its steps into one map, the maps of a
sequence's blocks are applied one after the other to find where each block begins, and a second
pass over the blocks clips their rows.  All passes take time in proportion to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block.
BLOCK = 1024


class Steps:
    """Steps of a clip composed: what follows a null (``fresh``), and what follows a value, as a map or, behind a null, as ``fresh``."""

    def __init__(self, step: float, ratio: bool) -> None:
        self.step, self.ratio = step, ratio
        self.fresh: float | None = None
        self.cut = False  # a null has been met: what came before no longer counts
        self.xs, self.ys = np.array([1.0]), np.array([1.0])
        self.left = self.right = 1.0  # slopes before the first and after the last point

    def clip(self, before: float | None, p: float | None) -> float | None:
        if p is None or before is None:
            return p
        low, high = (before / self.step, before * self.step) if self.ratio else (before - self.step, before + self.step)
        return max(low, min(high, p))

    def add(self, p: float | None) -> None:
        self.fresh = self.clip(self.fresh, p)
        if p is None:
            self.cut = True
        if self.cut:
            return
        if self.ratio and p <= 0:
            raise ValueError("clips by a ratio need positive values")
        for at in (p / self.step, p * self.step) if self.ratio else (p - self.step, p + self.step):
            self._mark(at)
        low, high = (self.ys / self.step, self.ys * self.step) if self.ratio else (self.ys - self.step, self.ys + self.step)
        self.ys = np.maximum(low, np.minimum(high, p))
        if self.ratio:
            self.left, self.right = self.left * self.step, self.right / self.step
        inner = np.zeros(len(self.ys), dtype=bool)
        inner[1:-1] = (self.ys[1:-1] == self.ys[:-2]) & (self.ys[1:-1] == self.ys[2:])
        self.xs, self.ys = self.xs[~inner], self.ys[~inner]

    def _mark(self, y: float) -> None:
        """A point where the map reaches y, if it has none."""
        k = int(np.searchsorted(self.ys, y))
        if k < len(self.ys) and self.ys[k] == y:
            return
        if k == 0:
            x = self.xs[0] + (y - self.ys[0]) / self.left
        elif k == len(self.ys):
            x = self.xs[-1] + (y - self.ys[-1]) / self.right
        else:
            x = self.xs[k - 1] + (y - self.ys[k - 1]) / (self.ys[k] - self.ys[k - 1]) * (self.xs[k] - self.xs[k - 1])
        self.xs, self.ys = np.insert(self.xs, k, x), np.insert(self.ys, k, y)


def through(block: dict, before: float | None) -> float | None:
    """The clamped value at a block's end after ``before``."""
    if before is None or block["cut"]:
        return block["fresh"]
    xs, ys = block["xs"], block["ys"]
    if before < xs[0]:
        return ys[0] + (before - xs[0]) * block["left"]
    if before > xs[-1]:
        return ys[-1] + (before - xs[-1]) * block["right"]
    return float(np.interp(before, xs, ys))


_MAP = [("block", pa.int64()), ("fresh", pa.float64()), ("cut", pa.bool_()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("left", pa.float64()), ("right", pa.float64())]
_ROWS = [("starts", pa.list_(pa.int64())), ("values", pa.list_(pa.float64()))]
_MAP_SQL = "block bigint, fresh double, cut boolean, xs array<double>, ys array<double>, `left` double, `right` double"


def _batches(rows: Iterator[dict], kind: pa.DataType, fields: list, size: int) -> Iterator[pa.RecordBatch]:
    held, schema = [], pa.schema([("seq", kind), *fields])
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def recursive_clip(df: DataFrame, step: float, ratio: bool = False, value: str = "ttc", rows: int = BLOCK) -> DataFrame:
    """seq, start, the value and smooth: it clamped to within ``step`` of (or by the factor ``step`` around)
    the clamped value before it; a null passes and forgets the one before.

    Rows of one start are taken in order of their values, nulls first.  Clips by a ratio need positive values.  rows: of a block.
    """
    ordered = df.select("seq", F.col("start").cast("bigint").alias("start"), F.col(value).cast("double").alias("v")).repartitionByRange("seq", "start").sortWithinPartitions("seq", "start", "v")
    seq = f"seq {ordered.schema['seq'].dataType.simpleString()}"

    def block(s: object, number: int, starts: list, values: list) -> dict:
        steps = Steps(step, ratio)
        for v in values:
            steps.add(v)
        return {"seq": s, "block": number, "fresh": steps.fresh, "cut": steps.cut, "xs": steps.xs, "ys": steps.ys, "left": steps.left, "right": steps.right, "starts": starts, "values": values}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, starts, values, before = TaskContext.get().partitionId() << 32, [], [], None
        for batch in batches:
            for s, start, v in zip(*[batch[c].to_pylist() for c in ("seq", "start", "v")], strict=True):
                if starts and (s != before or len(starts) >= rows):
                    yield block(before, number, starts, values)
                    number, starts, values = number + 1, [], []
                starts.append(start)
                values.append(v)
                before = s
        if starts:
            yield block(before, number, starts, values)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for one in batches:
            yield from _batches(blocks(chain([one], batches)), one.schema.field("seq").type, [*_MAP, *_ROWS], 64)

    cuts = written(ordered.mapInArrow(cut, f"{seq}, {_MAP_SQL}, starts array<bigint>, `values` array<double>"), "clip-blocks")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        s = at = object()
        for batch in batches:
            for row in batch.to_pylist():
                at = None if row["seq"] != s else at
                s = row["seq"]
                yield {"seq": s, "block": row["block"], "entry": at}
                at = through(row, at)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        for one in batches:
            yield from _batches(entries(chain([one], batches)), one.schema.field("seq").type, [("block", pa.int64()), ("entry", pa.float64())], 1024)

    narrow = cuts.drop("starts", "values").repartition("seq").sortWithinPartitions("seq", "block")
    known = narrow.mapInArrow(enter, f"{seq}, block bigint, entry double").select("block", "entry")

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(step, ratio)
        for batch in batches:
            smooth = []
            for values, at in zip(batch["values"].to_pylist(), batch["entry"].to_pylist(), strict=True):
                out = []
                for v in values:
                    at = steps.clip(at, v)
                    out.append(at)
                smooth.append(out)
            yield batch.drop_columns(["entry"]).append_column("smooth", pa.array(smooth, pa.list_(pa.float64())))

    both = cuts.select("seq", "block", "starts", "values").join(known, "block").select("seq", "starts", "values", "entry")
    shown = both.mapInArrow(clip, f"{seq}, starts array<bigint>, `values` array<double>, smooth array<double>")
    rows_of = shown.select("seq", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("values").alias("v"), F.col("smooth").alias("smooth"))).alias("r"))
    return rows_of.select("seq", "r.start", F.col("r.v").alias(value), "r.smooth")
