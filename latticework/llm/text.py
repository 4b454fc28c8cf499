"""Whole-batch tokenising over Arrow buffers, shared by the operators that run Arrow functions.

Texts stay UTF-8 bytes: the two word classes used here contain either every byte of a multi-byte character or none, so word
boundaries found on bytes are the boundaries on code points.  Batches are cut into pieces of bounded size (a single longer
text is its own piece), which bounds memory at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21

_BYTES = np.arange(256)
SPACE_FREE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LETTER_DIGIT = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_BYTE_CODE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "word2": 0xAF251AF3B0F025B5}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        base = _BASES[kind]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        have = (both[0], both[1])
        if size <= 8 * PIECE_BYTES:
            _POWERS[kind] = have
    return have


def _segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A 64-bit hash of values[starts[i]:ends[i]] for every i, from one running sum."""
    power, inverse = _powers(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


@dataclass
class Piece:
    """Some whole texts of a batch: rows [first, last), their bytes and where each text begins and ends."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Words of a piece in order; words of text i are [bounds[i], bounds[i+1])."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Whole texts in pieces of at most ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Piece(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(piece: Piece, member: np.ndarray) -> Words:
    """Maximal runs of member bytes inside each text."""
    inside = member[piece.data]
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(piece.offsets), np.int64))
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edge = piece.offsets[piece.offsets < n]
    begin[edge] = inside[edge]
    edge = piece.offsets[piece.offsets > 0] - 1
    stop[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, piece.offsets))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return _segments(_BYTE_CODE[data], w.starts, w.ends, "byte")


def gram_hashes(hashes: np.ndarray, k: int, kind: str = "word") -> np.ndarray:
    """Hash of each run of k consecutive words of a piece; runs that cross a text's end are the caller's to mask."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return _segments(hashes, at, at + k, kind)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for every pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    out[0] = s[0]
    ends = np.cumsum(n)[:-1]
    out[ends] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def joined(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where in that text each word begins and ends."""
    lengths = w.ends - w.starts
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    out[ranges(ends - lengths, lengths)] = data[ranges(w.starts, lengths)]
    return out, ends - lengths, ends
