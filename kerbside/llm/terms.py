"""Terms of texts as exact Arrow strings: maximal runs of bytes of a class, A-Z lower-cased.

Both classes hold every byte from 0x80 on, so a run of such bytes is a run of whole code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kerbside.llm import common as C

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[ord("0") : ord("9") + 1] = True


def terms(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, in order and with repeats, and each text's first (n + 1 places). No term crosses texts."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    before = np.concatenate(([0], np.cumsum(inside)))  # bytes of terms before each place
    ends = np.append(before[starts], before[-1])
    packed = C.LOWER[data[inside]]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
    return found, np.searchsorted(starts, offsets)


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs. Sorts `keys` in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))
