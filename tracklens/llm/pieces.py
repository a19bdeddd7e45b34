"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text gets a space in front, its spaces and U+2581 are one sign, and its characters are the
first symbols.  An agenda (a heap) holds the adjacent pairs of symbols whose union is a piece of the
vocabulary, ordered by score, then by place; the best pair is merged and its two new neighbours
enter the agenda.  Entries whose pair has changed since are passed over.  n characters take
O(n log n), however long a text is.  What is no piece in the end becomes its bytes' pieces.

Where two neighbouring signs stand together in no piece of the vocabulary, no symbol can
grow over that place: texts are cut there, first between letters and other signs and before spaces, then between
any such signs, and each part is merged on its own, with the same result; parts that recur are remembered.

Null texts count as empty: the end id alone.  Repeated rows are encoded alike; columns named
__text or as one of RESULTS cannot be kept.  Ids are packed as little-endian uint32.
Vocabularies of another type or with rules for normalisation, and those without all 256 bytes,
are refused with a ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .common import reserved, small_batches

#: The columns that ``encode`` adds.
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256", "agrees", "ids")
#: Parts of texts remembered by a Python worker; when full, it starts anew.
CACHE_ENTRIES = 500_000
#: Longer parts are encoded each time.
CACHE_CHARS = 64

# The sign for a space, kinds of pieces, and numbers of the fields read from a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, SPACE_AS_SUFFIX = 3, 35, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BPE = 2
END = "</s>"

#: A part's ids in decimal, joined by spaces, and the bytes that they stand for.
Coded = tuple[str, bytes]

_MASK = (1 << 32) - 1
codecs.register_error("tracklens-each-byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else 4 if wire == 5 else 8
        yield number, data[at : at + size]
        at += size


def _parts(pairs: set[str]) -> str:
    """A pattern for parts that no piece crosses: spaces, then letters or other signs; only whole texts if pieces hold a space after another sign."""
    if any(p[1] == " " != p[0] for p in pairs):
        return ".+"
    letter = re.compile(r"[^\W\d_]")
    crossing = {c for p in pairs if " " not in p and bool(letter.match(p[0])) != bool(letter.match(p[1])) for c in p if letter.match(c)}
    other = r"\W\d_" + re.escape("".join(sorted(crossing)))
    return rf" *[^{other}]+| *(?:(?! )[{other}])+| +"


def _kept(cache: dict[str, Coded], part: str, value: Coded) -> Coded:
    """value, remembered unless the part is long."""
    if len(part) <= CACHE_CHARS:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[part] = value
    return value


class Pieces:
    """One vocabulary: pieces with scores, by id."""

    def __init__(self, model: bytes) -> None:
        rows, spec = [], {TRAINER: {}, NORMALIZER: {}}
        for number, value in _fields(model):
            if number == PIECES:
                piece = dict(_fields(value))
                rows.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number in spec:
                spec[number] = dict(_fields(value))
        trainer, rules = spec[TRAINER], spec[NORMALIZER]
        kinds = {kind for _, _, kind in rows}
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or trainer.get(SPACE_AS_SUFFIX) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies with byte fallback and without pieces of the user are read")
        if rules.get(CHARSMAP) or rules.get(REMOVE_SPACES, 1) or not rules.get(DUMMY_PREFIX, 1) or not rules.get(ESCAPE_SPACES, 1):
            raise ValueError("only vocabularies that put a space in front and change nothing else are read")
        places = {score: k for k, score in enumerate(sorted({s for _, s, kind in rows if kind == NORMAL}, reverse=True))}
        self.ids = {p.replace(SPACE, " "): i for i, (p, _, kind) in enumerate(rows) if kind == NORMAL}
        self.ranks = {p.replace(SPACE, " "): places[s] for p, s, kind in rows if kind == NORMAL}
        bytes_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(rows) if kind == BYTE}
        if len(bytes_ids) < 256:
            raise ValueError("the vocabulary has no piece for some byte")
        self.byte_ids = [bytes_ids[b] for b in range(256)]
        self.is_control = {i for i, r in enumerate(rows) if r[2] == CONTROL}
        self.opens_with_space = {i for p, i in self.ids.items() if p[0] == " "}
        self.end = next(i for i, r in enumerate(rows) if r[0] == END and r[2] == CONTROL)
        self.surfaces = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in rows]
        self.decimals = [str(i) for i in range(len(rows))]
        self.pairs = {p[k : k + 2] for p in self.ranks for k in range(len(p) - 1)}
        self.parts = re.compile(_parts(self.pairs), re.DOTALL)
        self.cache: dict[str, Coded] = {}
        self.merged: dict[str, Coded] = {}
        self.fresh: list[tuple[str, list[int]]] = []  # merged since the library was last asked
        joined = set("".join(self.pairs))
        self.wall = next(c for c in map(chr, range(1, 0x110000)) if c not in joined)  # no piece joins it to anything

    def merge(self, part: str) -> list[int]:
        """Ids of a part, by the agenda of adjacent pairs."""
        n, rank_of, symbols = len(part), self.ranks.get, list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [rank_of(pair, -1) for pair in map(add, part, part[1:])]  # of the pair that starts there
        agenda = [rank << 32 | i for i, rank in enumerate(best) if rank >= 0]
        best.append(-1)
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            at = entry & _MASK
            if best[at] != entry >> 32:
                continue  # the pair is gone
            gone = after[at]
            merged = symbols[at] = symbols[at] + symbols[gone]
            symbols[gone], best[gone] = "", -1
            follows, prior = after[gone], before[at]
            after[at] = follows
            if follows < n:
                before[follows] = at
                rank = best[at] = rank_of(merged + symbols[follows], -1)
                if rank >= 0:
                    heappush(agenda, rank << 32 | at)
            else:
                best[at] = -1
            if prior >= 0:
                rank = best[prior] = rank_of(symbols[prior] + merged, -1)
                if rank >= 0:
                    heappush(agenda, rank << 32 | prior)
        id_of = self.ids.get
        ids = [id_of(s) for s in symbols if s]
        if None in ids:
            return [i for s in symbols if s for i in ([id_of(s)] if s in self.ids else [self.byte_ids[b] for b in s.encode()])]
        return ids

    def cut(self, text: str) -> list[str]:
        """The parts of a text, with the space in front, that are merged apart."""
        return self.parts.findall(" " + text.replace(SPACE, " ")) if text else []

    def _merged(self, part: str) -> Coded:
        ids = self.merge(part)
        self.fresh.append((part, ids))
        return " ".join([self.decimals[i] for i in ids]), b"".join([self.surfaces[i] for i in ids])

    def _coded(self, part: str) -> Coded:
        """A part, merged between the signs that no piece holds together."""
        pairs, known = self.pairs, self.merged.get
        ends = [k + 1 for k in range(len(part) - 1) if part[k : k + 2] not in pairs]
        if not ends:
            found = known(part) or _kept(self.merged, part, self._merged(part))
        else:
            each = [known(x) or _kept(self.merged, x, self._merged(x)) for x in map(part.__getitem__, map(slice, [0, *ends], [*ends, len(part)]))]
            found = " ".join([x[0] for x in each]), b"".join([x[1] for x in each])
        return _kept(self.cache, part, found)

    def coded(self, text: str) -> Coded:
        """A text's ids with the end id, and what they decode to: a part's signs are decoded when it
        is first merged, the space in front goes."""
        if not text:
            return self.decimals[self.end], b""
        known, make = self.cache.get, self._coded
        each = [known(x) or make(x) for x in self.cut(text)]
        ids, data = " ".join([x[0] for x in each]), b"".join([x[1] for x in each])
        return f"{ids} {self.decimals[self.end]}", data[1:]

    def encode(self, text: str) -> list[int]:
        """Ids of a text and the end id."""
        return [int(x) for x in self.coded(text)[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, each byte that is no UTF-8 becomes U+FFFD, the space in front goes."""
        data = b"".join(map(self.surfaces.__getitem__, ids))
        first = next((i for i in ids if i not in self.is_control), self.end)
        if first in self.opens_with_space:
            data = data[1:]
        return data.decode("utf-8", "tracklens-each-byte")

    def agrees(self, library: SentencePieceProcessor) -> bool:
        """Whether the library gives the same ids for all parts merged since the last call."""
        if not self.fresh:
            return True
        asked, self.fresh = self.fresh, []
        skip = len(library.encode(self.wall))
        told = library.encode([self.wall + part for part, _ in asked], num_threads=1)
        return all(theirs[skip:] == ours for theirs, (_, ours) in zip(told, asked, strict=True))


@lru_cache(maxsize=4)
def loaded(path: str) -> tuple[Pieces, SentencePieceProcessor]:
    with open(path, "rb") as f:
        model = f.read()
    return Pieces(model), SentencePieceProcessor(model_proto=model)


def encode_batches(batches: Iterable[pa.RecordBatch], column: str, path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    pieces, library = loaded(path)
    for batch in batches:
        n, packed, digest, decoded, agrees = [], [], [], [], []
        for text in batch.column(column):
            ids, data = pieces.coded(text.as_py() or "")
            n.append(ids.count(" ") + 1)
            digest.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(data).hexdigest())
            agrees.append(pieces.agrees(library))
            if with_ids:
                packed.append(np.array(ids.split(" "), dtype="<u4").tobytes())
        out = batch.drop_columns([column])
        for name, values, kind in (("n_tokens", n, pa.int64()), ("ids_sha256", digest, pa.string()), ("decoded_sha256", decoded, pa.string()), ("agrees", agrees, pa.bool_())):
            out = out.append_column(name, pa.array(values, kind))
        yield out.append_column("ids", pa.array(packed, pa.binary())) if with_ids else out


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs' columns ``keep`` plus n_tokens (the end id counts), ids_sha256 (of the decimal
    ids, joined by spaces), decoded_sha256, agrees and, if asked for, the packed ids.

    agrees: whether the library gives the same ids for those parts of the text that this
    worker had not met before.  path: a model file that every executor can open, part of an installed
    package.  No shuffle: a map over the scan's partitions.
    """
    reserved(keep, "__text", *RESULTS)
    small_batches(docs.sparkSession)
    source = docs.select(*keep, docs[text].alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean", *(["ids binary"] if with_ids else [])])
    return source.mapInArrow(lambda it: encode_batches(it, "__text", path, with_ids), schema)


def decode_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pieces, _ = loaded(path)
    for batch in batches:
        texts = [None if x is None else pieces.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in batch.column("ids").to_pylist()]
        yield batch.drop_columns(["ids"]).append_column("text", pa.array(texts, pa.string()))


def decode(encoded: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The texts of packed ids (column ``ids``; null for null)."""
    reserved(keep, "ids", "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema]
    return encoded.select(*keep, "ids").mapInArrow(lambda it: decode_batches(it, path), ", ".join([*fields, "text string"]))
