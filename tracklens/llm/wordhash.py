"""64-bit hashes of the white-space separated words of Arrow string batches.

The text operators that work on word shingles (the n-gram join and the
decontamination) read whole texts, so tokenising has to cost little.  Words are
hashed with numpy over the UTF-8 buffer of a batch: a prefix sum of
``byte_value * BASE**position`` gives every word's polynomial hash by one
subtraction.  Separators are ASCII, so cutting bytes never cuts a code point.

Buffers are processed in pieces of at most ``PIECE`` bytes, so that memory stays
bounded for texts of any length; a word that lies across a cut is put together
from the hashes of its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64's)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    values[65:91] = values[97:123]  # A-Z count as a-z
    return values


BYTE_VALUES = _byte_values()
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, and all ASCII that is neither letter nor digit.
PUNCT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below at least n."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            powers = np.full(n, base, dtype=_U)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        _POWERS[0] = (out[0], out[1])
    return _POWERS[0]


def _pieces(data: np.ndarray, separator: np.ndarray, piece: int):
    """(start, length, hash) of the words of one text, piece by piece."""
    power, inverse = _powers(piece)
    carry: tuple[int, int, int] | None = None  # an unfinished word
    for at in range(0, len(data), piece):
        part = data[at : at + piece]
        inside = ~separator[part]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(BYTE_VALUES[part] * power[: len(part)], dtype=_U)))
        hashes = (sums[ends] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, _U)
        starts, lengths = starts + at, ends - starts
        if carry is not None:
            if len(starts) and starts[0] == at:
                lengths[0] += carry[1]
                hashes[0] = (carry[2] + pow(BASE, carry[1], 1 << 64) * int(hashes[0])) & _MASK
                starts[0] = carry[0]
            else:
                yield np.array([carry[0]]), np.array([carry[1]]), np.array([carry[2]], dtype=_U)
            carry = None
        if len(starts) and starts[-1] + lengths[-1] == at + len(part) and at + len(part) < len(data):
            carry = (int(starts[-1]), int(lengths[-1]), int(hashes[-1]))
            starts, lengths, hashes = starts[:-1], lengths[:-1], hashes[:-1]
        yield starts, lengths, hashes


def words_of(text: bytes | np.ndarray, separator: np.ndarray = SPACE, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte length and hash of each word of one UTF-8 text."""
    data = np.frombuffer(text, dtype=np.uint8) if isinstance(text, bytes) else text
    found = list(_pieces(data, separator, piece))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    starts, lengths, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, lengths, mix(hashes ^ _U(0x2545F4914F6CDD1D))


def batch_words(texts: pa.Array, separator: np.ndarray = SPACE):
    """For each group of neighbouring rows of a string column, of about PIECE
    bytes: (first row, row count, word hashes, first word of each row).

    The last array has one entry more than there are rows.  Null counts as empty.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        part = data[offsets[row] : offsets[last]]
        if last == row + 1:
            _, _, hashes = words_of(part, separator)
            first = np.array([0, len(hashes)])
        else:
            hashes, first = _many(part, offsets[row : last + 1] - offsets[row], separator)
        yield row, last - row, hashes, first
        row = last


def _many(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(max(PIECE, len(data)))
    inside = ~separator[data]
    before = np.concatenate(([False], inside[:-1]))
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(BYTE_VALUES[data] * power[: len(data)], dtype=_U)))
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes ^ _U(0x2545F4914F6CDD1D)), np.searchsorted(starts, offsets)
