"""Byte-level BPE encoding and decoding with a segment tree per pre-token.

A text is cut by the vocabulary's pattern; each match is merged separately.  A
segment tree (of WIDE children a node) over the byte positions of a match holds,
at each position, the rank of the pair that starts there, and the position, so
that the minimum is the leftmost one.  The root names the next merge, and a
merge updates three leaves: the pair it removes, the pair that now starts at the
merged part and the one before it.  A match of n bytes so takes O(n log n), however long it is.
The leaves of up to WIDE positions are one node: short matches are a tree of one level.

Null texts count as empty, repeated rows are encoded alike; columns named __text or as
one of RESULTS cannot be kept.  Ids are packed as little-endian uint32.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import reserved, small_batches

#: Pre-tokens remembered by a Python worker; when full, it starts anew.
CACHE_ENTRIES = 300_000
#: Longer pre-tokens are encoded each time.
CACHE_BYTES = 64

#: The columns that ``encode`` adds.
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")

_NONE = 1 << 62
#: Children of a node of the segment tree: enough that most pre-tokens are one node.
WIDE = 16
#: The pattern's classes for code points below U+0250, all that most texts hold.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_BEYOND = re.compile("[ɐ-\U0010ffff]")


def _narrow(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0250, by the faster standard library."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
    return re.compile(inside.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


class Bpe:
    """One vocabulary: ranks of byte strings, and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.packs = [x.to_bytes(4, "little") for x in range(len(self.pieces))]
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.pattern = regex.compile(pattern)
        known = set(re.findall(r"\\p\{\w+\}|\\[a-zA-Z]", pattern)) <= {r"\p{L}", r"\p{N}", r"\s", r"\S"}
        self.narrow = _narrow(pattern) if known else None
        self.cache: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, pairs = len(data), self.pairs
        if data in self.ranks:
            return [self.ranks[data]]
        ids = [self.byte_ids[b] for b in data]
        if n < 2:
            return ids
        get, leaves = pairs.get, [_NONE] * (n - 1)
        left = ids[0] << 32
        for i in range(n - 1):
            right = ids[i + 1]
            rank = get(left | right)
            if rank is not None:
                leaves[i] = rank << 32 | i
            left = right << 32
        tree = [leaves]
        while len(tree[-1]) > WIDE:
            tree.append([min(tree[-1][i : i + WIDE]) for i in range(0, len(tree[-1]), WIDE)])
        root = tree[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := min(root)) != _NONE:
            at = best & 0xFFFFFFFF
            gone = after[at]
            merged = ids[at] = best >> 32
            ids[gone] = -1
            follows = after[at] = after[gone]
            prior = before[at]
            if follows < n:
                before[follows] = at
                rank = get(merged << 32 | ids[follows])
                leaves[at] = _NONE if rank is None else rank << 32 | at
                leaves[gone] = _NONE
            else:
                leaves[at] = _NONE
            if prior >= 0:
                rank = get(ids[prior] << 32 | merged)
                leaves[prior] = _NONE if rank is None else rank << 32 | prior
            if root is not leaves:
                for node in (at, gone if follows < n else at, prior):
                    for below, level in zip(tree, tree[1:], strict=False):
                        node //= WIDE
                        value = min(below[node * WIDE : node * WIDE + WIDE], default=_NONE)
                        if node < 0 or level[node] == value:
                            break
                        level[node] = value
        return [x for x in ids if x >= 0]

    def _packed(self, token: str) -> bytes:
        data = token.encode()
        packed = b"".join([self.packs[x] for x in self.merge(data)])
        if len(data) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian uint32."""
        cut = self.pattern if self.narrow is None or _BEYOND.search(text) else self.narrow
        known, make = self.cache.get, self._packed
        return b"".join([known(x) or make(x) for x in cut.findall(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64 rank`` of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(maxsize=4)
def loaded(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe(parse_ranks(f.read()), pattern)


def encode_batches(batches: Iterable[pa.RecordBatch], column: str, path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path, pattern)
    for batch in batches:
        n, ids, digest, decoded = [], [], [], []
        for text in batch.column(column):
            packed = bpe.encode(text.as_py() or "")
            n.append(len(packed) // 4)
            digest.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            if with_ids:
                ids.append(packed)
        out = batch.drop_columns([column])
        for name, values, kind in (("n_tokens", n, pa.int64()), ("ids_sha256", digest, pa.string()), ("decoded_sha256", decoded, pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        yield out.append_column("ids", pa.array(ids, pa.binary())) if with_ids else out


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs' columns ``keep`` plus n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, the packed ids of the whole text.

    path: a rank file that every executor can open, part of an installed
    package; texts that are null count as empty, repeated rows stay.  No
    shuffle: a map over the scan's partitions.
    """
    reserved(keep, "__text", *RESULTS)
    small_batches(docs.sparkSession)
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(["ids binary"] if with_ids else [])])
    return source.mapInArrow(lambda it: encode_batches(it, "__text", path, pattern, with_ids), schema)


def decode_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path, pattern)
    for batch in batches:
        texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
        yield batch.drop_columns(["ids"]).append_column("text", pa.array(texts, pa.string()))


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The texts of packed ids (column ``ids``); bytes that are no UTF-8 become U+FFFD."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema]
    return encoded.select(*keep, "ids").mapInArrow(lambda it: decode_batches(it, path, pattern), ", ".join([*fields, "text string"]))
