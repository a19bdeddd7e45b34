"""Lines through trailing boxes, of many samples at once in Arrow batches.

A batch's histories stand in arrays of samples x boxes, the newest first.  Sums run over them box by box, as a loop over
one history would, so results don't depend on how rows are dealt; a box that is left out adds zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Samples that are worked on together: their arrays fit a core's cache.
PIECE = 1024


def _dealt(hist: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The boxes' fields as samples x boxes, the newest first, unknown ones NaN; and where there is a box."""
    size = pc.fill_null(pc.list_value_length(hist), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = hist.flatten()
    ends = np.cumsum(size)
    row = np.repeat(np.arange(len(size)), size)
    place = ends[row] - 1 - np.arange(len(flat))
    there = np.arange(max(1, size.max(initial=0))) < size[:, None]
    out = {}
    for name in (f.name for f in flat.type):
        out[name] = np.full(there.shape, np.nan)
        out[name][row, place] = flat.field(name).to_numpy(zero_copy_only=False).astype(float)
    return out, there


def _fits(boxes: dict[str, np.ndarray], used: np.ndarray, start: np.ndarray, query_t: np.ndarray, backs: list[int], cues: int) -> tuple[np.ndarray, ...]:
    """n (samples x windows), slope and ref (samples x windows x cues) of the lines through the used boxes of each window."""
    put = lambda x: np.where(used, x, 0.0)
    t, w, h = boxes["ts"] - query_t[:, None], boxes["w"], boxes["h"]
    sizes = [w, h, np.sqrt(w * w + h * h), np.sqrt(np.fmax(boxes["area"], 1e-6)), h / 2][:cues]
    # The boxes from a window's first label on; none at all is the place before the first.
    places = np.stack([(boxes["label_id"] >= (start - b)[:, None]).sum(axis=1) for b in backs], axis=1)
    upto = lambda x: np.take_along_axis(np.concatenate([np.zeros((len(x), 1)), np.cumsum(put(x), axis=1)], axis=1), places, axis=1)
    n, st, stt = upto(np.ones_like(t)), upto(t), upto(t * t)
    below = n * stt - st * st
    slope, ref = np.empty((2, *places.shape, cues))
    for i, y in enumerate(sizes):
        sy, sty = upto(y), upto(t * y)
        slope[:, :, i] = np.where((n >= 2) & (below != 0), (n * sty - st * sy) / below, np.nan)
        ref[:, :, i] = (sy - slope[:, :, i] * st) / n
    return n, slope, ref


def _judged(slope: np.ndarray, ref: np.ndarray, limits: tuple[float, float, float, float]) -> np.ndarray:
    """The times to contact (samples x windows x cues), NaN where a line is no candidate."""
    least_slope, least_ref, low, high = limits
    ttc = ref / slope
    return np.where((slope > least_slope) & (ref > least_ref) & (ttc >= low) & (ttc <= high), ttc, np.nan)


def _statistics(ttc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, most boxes of a line, and the times in order, NaN after them."""
    good = ~np.isnan(ttc)
    most = np.where(good.any(axis=2), n, 0).max(axis=1, initial=0)
    return good.sum(axis=(1, 2)), most, np.sort(ttc.reshape(len(ttc), -1), axis=1)


def _quantile(ordered: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """Of each row's first ``count`` values, interpolated."""
    at = np.maximum(count - 1, 0) * q
    low, high = (ordered[np.arange(len(ordered)), f(at).astype(int)] for f in (np.floor, np.ceil))
    return low + (at - np.floor(at)) * (high - low)


def _median(values: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Of each row's (last axis) used values, of which unknown ones stand first; NaN where the middle is unknown or there are none."""
    ordered = np.sort(np.where(used, np.where(np.isnan(values), -np.inf, values), np.nan), axis=-1)
    size = used.sum(axis=-1)
    at = lambda k: np.take_along_axis(ordered, np.maximum((size - k) // 2, 0)[..., None], axis=-1)[..., 0]
    middle = (at(1) + at(0)) / 2
    return np.where((size > 0) & np.isfinite(middle), middle, np.nan)


def _collapsed(boxes: dict[str, np.ndarray], there: np.ndarray, start: np.ndarray, share: float) -> np.ndarray:
    """Whether the newest box's area falls below the share of the median of the boxes up to five labels before, three at least."""
    recent = there & (boxes["label_id"] >= (start - 5)[:, None]) & (boxes["label_id"] <= (start - 1)[:, None])
    return (recent.sum(axis=1) >= 3) & (boxes["area"][:, 0] / _median(boxes["area"], recent) < share)


def _dropped(area: np.ndarray, there: np.ndarray, share: float) -> np.ndarray:
    """The boxes (newest first) whose area falls below the share of the median of the up to two before and two after, of which both sides have some."""
    pad = lambda x, fill: np.pad(x, ((0, 0), (2, 2)), constant_values=fill)
    width, a, t = area.shape[1], pad(area, np.nan), pad(there, False)
    beside = [2 + k for k in (-2, -1, 1, 2)]
    near, known = (np.stack([x[:, k : k + width] for k in beside], axis=2) for x in (a, t))
    return there & known[:, :, :2].any(axis=2) & known[:, :, 2:].any(axis=2) & (area / _median(near, known) < share)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each piece the record batch, boxes, where they are, start and query_t."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            part = batch.slice(k, PIECE)
            boxes, there = _dealt(part.column("hist"))
            yield part, boxes, there, *(part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("start", "query_t"))


def _appended(rows: DataFrame, without: tuple[str, ...], fields: list[str], add: Callable[..., list[pa.Array]]) -> DataFrame:
    """rows less the columns ``without`` plus the fields that ``add`` gives for a piece."""
    kept = [c for c in rows.columns if c not in without]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    names = [*kept, *[f.split()[0] for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for part, *known in _pieces(batches):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *add(part, *known)], names)

    return rows.mapInArrow(run, f"{kinds}, {', '.join(fields)}")


def prefix(guard: bool, kept: bool) -> str:
    """How the columns of a set of boxes begin."""
    return f"{'c' if guard else 'a'}{'k' if kept else ''}_"


def with_statistics(rows: DataFrame, sets: dict[tuple[bool, bool], dict[str, float]], backs: list[int], cues: int, limits: tuple[float, float, float, float], share: float, keep: bool = False) -> DataFrame:
    """rows (seq, start, query_t, hist and others) less hist (unless ``keep``) plus statistics of the candidates from sets of boxes.

    A set (guard, kept) is all boxes, without the current one where that has collapsed (guard), and without those
    that the history guard drops of the rest (kept).  Under its ``prefix`` come n, max_fit, low and its quantiles, null where there is no
    candidate; under that of each guard n_rows and n_kept (boxes before and after the history guard) and ratio, the
    current area over the median of the five boxes before, null without the current box.  collapsed tells whether
    the current box has collapsed, ratio_prev is its area over that of the box before.
    """
    guards = sorted({g for g, _ in sets})
    fields = ["collapsed boolean", "ratio_prev double", *[f"{prefix(g, False)}{c}" for g in guards for c in ("n_rows bigint", "n_kept bigint", "ratio double")]]
    fields += [f"{prefix(*s)}{c}" for s, shares in sets.items() for c in ("n bigint", "max_fit bigint", "low double", *[f"{q} double" for q in shares])]

    def add(part: pa.RecordBatch, boxes: dict, there: np.ndarray, start: np.ndarray, query_t: np.ndarray) -> list[pa.Array]:
        area = boxes["area"]
        number = lambda x, none=None: pa.array(x, pa.float64(), mask=np.isnan(x) if none is None else none)
        whole = lambda x, none=None: pa.array(x.astype(np.int64), pa.int64(), mask=none)
        collapsed = _collapsed(boxes, there, start, share)
        previous = area[:, 1] if area.shape[1] > 1 else np.full(len(area), np.nan)
        out, used = [pa.array(collapsed), number(area[:, 0] / previous)], {}
        for g in guards:
            left = there.copy()
            if g:
                left[:, 0] &= ~collapsed
            used[g, False] = left
            used[g, True] = left & ~_dropped(np.where(left, area, np.nan), left, share)
            before = _median(area[:, 1:6], left[:, 1:6]) if area.shape[1] > 1 else np.full(len(area), np.nan)
            out += [whole(left.sum(axis=1)), whole(used[g, True].sum(axis=1)), number(np.where(left[:, 0], area[:, 0] / before, np.nan))]
        last = None
        for s, shares in sets.items():
            # Samples whose boxes are those of the set before have its statistics.
            again = np.arange(len(start)) if last is None else np.flatnonzero((used[s] != last).any(axis=1))
            if len(again):
                n, slope, ref = _fits({k: x[again] for k, x in boxes.items()}, used[s][again], start[again], query_t[again], backs, cues)
                new = _statistics(_judged(slope, ref, limits), n)
                if last is None:
                    found = new
                else:
                    found = tuple(x.copy() for x in found)
                    for x, y in zip(found, new, strict=True):
                        x[again] = y
            last = used[s]
            count, most, ordered = found
            none = count == 0
            out += [whole(count, none), whole(most, none), number(ordered[:, 0], none), *[number(_quantile(ordered, count, q), none) for q in shares.values()]]
        return out

    return _appended(rows, () if keep else ("hist",), fields, add)


def with_nearest(rows: DataFrame, backs: list[int], cues: int, limits: tuple[float, float, float, float], share: float) -> DataFrame:
    """rows (start, query_t, hist, cur_guard, hist_guard, ttc and others) less hist plus fit_points, slope and ref of the candidate nearest to ttc,
    of those from the boxes that the guards leave.

    Gaps are compared to nine places; of equals the shortest window counts, then the first cue.  All are null without ttc.
    """
    fields = ["fit_points bigint", "slope double", "ref double"]

    def add(part: pa.RecordBatch, boxes: dict, there: np.ndarray, start: np.ndarray, query_t: np.ndarray) -> list[pa.Array]:
        guarded, dropping = (pc.fill_null(part.column(c), False).to_numpy(zero_copy_only=False) for c in ("cur_guard", "hist_guard"))
        ttc = pc.fill_null(part.column("ttc"), np.nan).to_numpy(zero_copy_only=False)
        used = there.copy()
        used[:, 0] &= ~guarded
        used &= ~(dropping[:, None] & _dropped(np.where(used, boxes["area"], np.nan), used, share))
        some = np.flatnonzero(~np.isnan(ttc))
        n, slope, ref = _fits({k: x[some] for k, x in boxes.items()}, used[some], start[some], query_t[some], backs, cues)
        gap = np.floor(np.abs(_judged(slope, ref, limits) - ttc[some, None, None]) * 1e9 + 0.5)
        window, cue = np.divmod(np.where(np.isnan(gap), np.inf, gap).reshape(len(some), len(backs) * cues).argmin(axis=1), cues)
        at, out = np.arange(len(some)), np.full((3, len(ttc)), np.nan)
        out[:, some] = n[at, window], slope[at, window, cue], ref[at, window, cue]
        none = np.isnan(ttc)
        return [pa.array(np.where(none, 0, out[0]).astype(np.int64), pa.int64(), mask=none), *[pa.array(x, pa.float64(), mask=none) for x in out[1:]]]

    return _appended(rows, ("hist",), fields, add)


def with_candidates(rows: DataFrame, into: str, kept_only: bool, backs: list[int], cues: int, limits: tuple[float, float, float, float]) -> DataFrame:
    """rows plus an array of the candidates, by window, then cue, from all boxes of hist or those that are not dropped."""
    fields = [f"{into} array<struct<back:int,ord:int,fit_points:bigint,slope:double,ref:double,ttc:double>>"]

    def add(part: pa.RecordBatch, boxes: dict, there: np.ndarray, start: np.ndarray, query_t: np.ndarray) -> list[pa.Array]:
        n, slope, ref = _fits(boxes, there & (boxes["dropped"] != 1) if kept_only else there, start, query_t, backs, cues)
        ttc = _judged(slope, ref, limits)
        row, window, cue = np.nonzero(~np.isnan(ttc))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ttc)))])
        columns = {"back": pa.array(np.array(backs)[window], pa.int32()), "ord": pa.array(cue, pa.int32()), "fit_points": pa.array(n[row, window].astype(int), pa.int64())}
        columns |= {k: pa.array(x[row, window, cue], pa.float64()) for k, x in (("slope", slope), ("ref", ref), ("ttc", ttc))}
        found = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]

    return _appended(rows, (), fields, add)
