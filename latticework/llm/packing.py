"""Simple-8b: unsigned numbers packed word by word, in blocks that can be decoded on their own.

A 64-bit word has a 4-bit selector on top, which tells how many numbers of how many bits follow below, first number lowest.  A number of
more than 60 bits is an escape: a word of selector 0 and the number as the next word.  All places of a word are used, and no word crosses
the blocks of BLOCK numbers.  Encoding finds the selector of most numbers that fits at every position with doubling windows and then steps
through all blocks side by side; decoding unpacks all words of one selector at a time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Numbers and bits of each selector from 1 on (fixed values of the code).
SLOTS = (120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_LIMITS = np.array([1 << b for b in BITS], np.uint64)
_SLOTS = np.array([1, *SLOTS])
_TOP = np.uint64(60)


def whole_windows(fits: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` neighbours from a place on all fit, by windows that double."""
    width, window = 1, fits
    while 2 * width <= size:
        window, width = window[: len(window) - width] & window[width:], 2 * width
    return window[: len(fits) - size + 1] & window[size - width : len(fits) - width + 1]


def encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the place of each block's first word (one more at the end: the number of words)."""
    n = len(numbers)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    padded = np.zeros(n + SLOTS[0], np.uint64)
    padded[:n] = numbers
    kind = np.searchsorted(_LIMITS, padded[:n], side="right").astype(np.int8)
    inside = np.arange(n, dtype=np.int32) % BLOCK
    room = (np.where(np.arange(n) // BLOCK == blocks - 1, n - BLOCK * (blocks - 1), BLOCK) - inside).astype(np.int16)
    selector = np.zeros(n, np.int8)
    for k in reversed(range(int(kind.min()), len(SLOTS))):
        if n >= SLOTS[k]:
            found = whole_windows(kind <= k, SLOTS[k])
            np.putmask(selector[: len(found)], found & (room[: len(found)] >= SLOTS[k]), k + 1)
    step = _SLOTS[selector]
    found, here = [], np.arange(blocks) * BLOCK
    while len(here):
        found.append(here)
        left = room[here] > step[here]
        here = (here + step[here])[left]
    starts = np.sort(np.concatenate(found))
    chosen = selector[starts]
    place = np.concatenate([[0], np.cumsum(1 + (chosen == 0))])
    words = np.zeros(place[-1], np.uint64)
    for k in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == k)
        first = starts[of]
        if k == 0:
            words[place[of] + 1] = padded[first]
            continue
        count, bits = SLOTS[k - 1], BITS[k - 1]
        packed = np.full(len(of), k << 60, np.uint64)
        for j in range(count if bits else 0):
            packed |= padded[first + j] << np.uint64(j * bits)
        words[place[of]] = packed
    offsets = place[np.searchsorted(starts, np.arange(blocks) * BLOCK)]
    return words, np.append(offsets, place[-1]).astype(np.int64)


def decode(words: np.ndarray, total: int) -> np.ndarray:
    """The ``total`` numbers of whole blocks."""
    if not total:
        return np.zeros(0, np.uint64)
    selector = (words >> _TOP).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == 0).tolist():
        if not raw[k]:  # a raw number may look like an escape
            raw[k + 1] = True
    lead = np.flatnonzero(~raw)
    chosen = selector[lead]
    sizes = _SLOTS[chosen]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(total + SLOTS[0], np.uint64)
    for k in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == k)
        if k == 0:
            out[starts[of]] = words[lead[of] + 1]
            continue
        bits = BITS[k - 1]
        mask = np.uint64((1 << bits) - 1)
        for j in range(SLOTS[k - 1] if bits else 0):
            out[starts[of] + j] = (words[lead[of]] >> np.uint64(j * bits)) & mask
    return out[:total]
