"""Vectorised words of many texts at once: runs of word bytes and their 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
#: An odd multiplier; its powers have inverses modulo 2**64, so a run's hash is a difference of two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def letters_and_digits() -> np.ndarray:
    """Bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] in lower-cased UTF-8: digits, a-z, all of non-ASCII characters."""
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the maximal runs of bytes that `inside` marks, none across texts; first: each text's first run."""
    mask = inside[data]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    before[edge] = False
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; up to 8 million of them are kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, _U)]), dtype=_U) for b in (_BASE, pow(_BASE, -1, 2**64)))
        if size > 1 << 23:
            return up[:n], down[:n]
        _powers[:] = [up, down]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads differences over all of them."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
