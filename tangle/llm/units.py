"""Units of text for the classifiers: runs of letters (A-Z lower-cased), of digits, and of other characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common as C

# 0 white space, 1 letters and all bytes beyond ASCII, 2 digits, 3 the rest
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def units(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the units, and units before each document (n + 1 values)."""
    buf, offs = C.buffers(col)
    if not len(buf):
        return buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND.take(buf)
    turn = np.ones(len(buf) + 1, bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn[offs] = True
    at = np.flatnonzero(turn)
    st, en = at[:-1], at[1:]
    real = kind[st] > 0
    st, en = st[real], en[real]
    return _LOW.take(buf), st, en, np.searchsorted(st, offs)
