"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as words: maximal runs of bytes that are no ASCII
white space or punctuation, A-Z lower-cased (as 64-bit hashes, see wordhash).
An item of m words matches a text that holds a run of words within
k = floor(m * ERROR_SHARE) word edits of it.  The item is split into k + 1
pieces; k edits leave one of them whole, so every match contains an exact hit of
a piece.  Hits are found on rolling hashes of the text's words, and each is
verified on the words around it with Myers' bit-parallel distance.

Items of fewer than 1 / ERROR_SHARE words must be met exactly; ``min_words`` leaves
out items of fewer words, by default none.  Items without a word, null or empty
texts match nothing; equal items under one id count once, repeated documents each.

The benchmark is read in blocks of about BLOCK_BYTES, one at a time: its items go to
the driver and in the plan to the tasks, so both are bounded.  Every block reads all texts once, in
a map without a shuffle; where there are several blocks, each one's result is written to the
shared folder before the next begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import small_batches, written

ERROR_SHARE = 0.2
BLOCK_BYTES = 16 << 20
_U = np.uint64
_WEIGHTS = wordhash.mix(np.arange(1, 4097, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BITS = 20


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total += words[k : k + n] * _WEIGHTS[k % len(_WEIGHTS)]
    return wordhash.mix(total)


def myers(masks: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int]:
    """Least edit distance of the pattern (masks: its places by word, as bits) to
    a run of the text, and the run's end; (most + 1, -1) if none is within most."""
    ones, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = ones, 0, m
    best = (most + 1, -1)
    for at, word in enumerate(text):
        equal = masks.get(word, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        plus, minus = (down | ~(across | up)) & ones, up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & ones, minus << 1 & ones
        vertical = equal | down
        up, down = (minus | ~(vertical | plus)) & ones, plus & vertical
        if score < best[0]:
            best = (score, at + 1)
    return best


class Matcher:
    """The pieces of a block of items, by their number of words."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, words in items:
            m = len(words)
            if not m:
                continue
            k = math.floor(m * ERROR_SHARE)
            masks: dict[int, int] = {}
            for at, word in enumerate(words.tolist()):
                masks[word] = masks.get(word, 0) | 1 << at
            self.items.append((item_id, masks, m, k))
            edges = [m * i // (k + 1) for i in range(k + 2)]
            for start, end in zip(edges, edges[1:], strict=False):
                piece = int(rolling(words[start:end], end - start)[0])
                pieces.setdefault(end - start, []).append((piece, len(self.items) - 1, start))
        self.tables = []
        for size, found in pieces.items():
            found.sort()
            hashes = np.array([x[0] for x in found], dtype=_U)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(hashes >> _U(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((size, hashes, found, seen))

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item id, distance) of every match, once per row and item."""
        for row, _, words, first in wordhash.batch_words(texts, wordhash.PUNCT):
            spots: set[tuple[int, int, int]] = set()  # text, item, where the item would begin
            for size, hashes, found, seen in self.tables:
                runs = rolling(words, size)
                maybe = np.flatnonzero(seen[(runs >> _U(64 - _BITS)).astype(np.int64)])
                if not len(maybe):
                    continue
                low = np.searchsorted(hashes, runs[maybe], "left")
                high = np.searchsorted(hashes, runs[maybe], "right")
                texts_of = np.searchsorted(first, maybe, "right") - 1
                for at, a, b, text in zip(maybe.tolist(), low.tolist(), high.tolist(), texts_of.tolist(), strict=True):
                    for _, item, start in found[a:b]:
                        spots.add((text, item, at - start))
            yield from ((row + text, item_id, d) for text, item_id, d in self._verified(spots, words, first))

    def _verified(self, spots: set[tuple[int, int, int]], words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        best: dict[tuple[int, int], int] = {}
        done: dict[tuple[int, int], int] = {}  # up to where the text has been read for the item
        for text, item, begin in sorted(spots):
            item_id, masks, m, k = self.items[item]
            low, high = max(int(first[text]), begin - k), min(int(first[text + 1]), begin + m + k)
            if high <= done.get((text, item), -1):
                continue
            done[text, item] = high
            distance, _ = myers(masks, m, words[low:high].tolist(), k)
            if distance <= k:
                best[text, item] = min(distance, best.get((text, item), k))
        for (text, item), distance in best.items():
            yield text, self.items[item][0], distance


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items (id, text) in blocks of bounded size (or of one item)."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted({(r[0], r[1].encode()) for r in rows if r[0] is not None})


def _matcher(items: list[tuple[int, bytes]], min_words: int) -> Matcher:
    words = ((i, wordhash.words_of(text, wordhash.PUNCT)[2]) for i, text in items)
    return Matcher([(i, w) for i, w in words if len(w) >= min_words])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """doc_id, item_id, distance (in words) of every text that holds an item."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items in blocks(benchmark):

        def batches(it: Iterable[pa.RecordBatch], items: list[tuple[int, bytes]] = items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, min_words)
            for batch in it:
                found = sorted(matcher.batch(batch.column(1)))
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int32())], names=["doc_id", "item_id", "distance"])

        part = source.mapInArrow(batches, f"doc_id {source.schema[0].dataType.simpleString()}, item_id bigint, distance int")
        out = part if out is None else written(out.unionByName(part), "found")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_words: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text)
    out = None
    for items in blocks(benchmark):

        def batches(it: Iterable[pa.RecordBatch], items: list[tuple[int, bytes]] = items) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, min_words)
            for batch in it:
                bad = {row for row, _, _ in matcher.batch(batch.column(at))}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_())) if bad else batch

        rows = docs if out is None else written(out, "clean")
        out = rows.mapInArrow(batches, docs.schema)
    return out
