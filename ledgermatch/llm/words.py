"""Words of many texts at once, as numpy arrays over their UTF-8 bytes, and rolling hashes over them.

A word is a run of bytes other than space and U+0009 to U+000D. All of it works on arrays of a whole slice of rows, with no
loop over words or characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(20_240_607).integers(1, 2**63, (2, 256), dtype=np.uint64) | U(1)
_BYTE = _BYTES[0]
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


#: Powers that a worker keeps of each base; a slice that needs more makes its own and lets them go.
_KEPT = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    made = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, x, U)
        p[:1] = 1
        made.append(np.cumprod(p, dtype=U))
    return made[0], made[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if size > _KEPT:
        return _table(base, size)
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        _POWERS[base] = _table(base, max(size, 1 << 16))
    up, down = _POWERS[base]
    return up[:size], down[:size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Words:
    raw: np.ndarray  # bytes
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    doc: np.ndarray  # row of each word
    first: np.ndarray  # first word of each row, and the number of words at the end

    def hashes(self, which: int = 0) -> np.ndarray:
        """One 64-bit hash per word; ``which`` picks one of two that know nothing of each other."""
        if not len(self.starts):
            return np.zeros(0, U)
        up, down = powers(_BASES[-which], len(self.raw) + 1)
        sums = np.zeros(len(self.raw) + 1, U)
        np.cumsum(_BYTES[which][self.raw] * up[:-1], dtype=U, out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])


def split_words(raw: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> Words:
    """Words of the rows that ``at`` bounds. ``keep`` marks the byte values that stay; others vanish before words are cut."""
    if keep is not None:
        stay = keep[raw]
        at = np.concatenate(([0], np.cumsum(stay)))[at]
        raw = raw[stay]
    inside = ~SEPARATOR[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]  # rows meet without a separator between them
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = at[1:][at[:-1] < at[1:]] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, at)
    return Words(raw, starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def grams(hashes: np.ndarray, size: int, which: int = 1) -> np.ndarray:
    """Hash of every run of ``size`` words, whether or not it stays within one row."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U)
    up, down = powers(_BASES[which], n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(hashes * up[:-1], dtype=U, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def stretches(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 1) -> np.ndarray:
    """Hash of the words from each start up to, but not with, its end; equal words of equal number give equal hashes."""
    up, down = powers(_BASES[which], len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], dtype=U, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def spans_rows(w: Words, size: int) -> np.ndarray:
    """For every run of ``size`` words: whether it lies within one row."""
    return w.doc[size - 1 :] == w.doc[: len(w.doc) - size + 1] if len(w.doc) >= size else np.zeros(0, bool)


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over every window of ``width``, in a logarithmic number of passes."""
    if len(a) < width:
        return a[:0]
    done = 1
    while done * 2 <= width:
        a = op(a[:-done], a[done:])
        done *= 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if done < width else a
