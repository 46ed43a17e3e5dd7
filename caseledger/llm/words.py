"""Words of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are read
as the UTF-8 bytes that Arrow already holds, in slices of about a megabyte, so
that the temporaries stay small whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time (a longer word makes a longer slice).
SLICE = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown as needed."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def _slices(data: np.ndarray):
    """Bounds that cut the bytes at white space, about SLICE apart."""
    at, n = 0, len(data)
    while at < n:
        to = at + SLICE
        while to < n:
            blank = SPACE[data[to:to + SLICE]]
            if blank.any():
                to += int(blank.argmax())
                break
            to += SLICE
        yield at, (at := min(to, n))


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, word offsets per text): 64-bit hashes of all words, A-Z
    lower-cased if asked for, and where they lie in the bytes."""
    at, heads, tails = [], [], []
    first = np.unique(offs[:-1]) if len(offs) > 1 else np.zeros(0, np.int64)
    for lo, hi in _slices(data):
        part = data[lo:hi]
        blank = SPACE[part]
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = blank[:-1]
        edge = first[np.searchsorted(first, lo):np.searchsorted(first, hi)] - lo
        before[edge] = True
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = blank[1:]
        after[edge[edge > 0] - 1] = True
        a, b = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[part] if lower else part] * _power(_STEP, "on", len(part)), out=total[1:])
        h = (total[b] - total[a]) * _power(_STEP_BACK, "back", len(part))[a] + (b - a).astype(np.uint64)
        at.append(mix(h))
        heads.append(a + lo)
        tails.append(b + lo)
    none = np.zeros(0, np.int64)
    starts = np.concatenate(heads) if heads else none
    ends = np.concatenate(tails) if tails else none
    hashes = np.concatenate(at) if at else none.astype(np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, offs).astype(np.int64)
