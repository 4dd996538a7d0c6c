"""Whitespace words of whole Arrow text columns, hashed with numpy inside Spark tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so the byte-level rule equals the regular
expression ``[^\\x20\\x09-\\x0D]+`` on the decoded text. Nulls and empty texts have no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
#: Multipliers of window hashes; odd, so that each has an inverse modulo 2**64.
_STEP = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
#: Bytes of text hashed at a time; bounds the temporaries of a task, not its result.
CHUNK = 1 << 20


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    z = z ^ (z >> U64(30))
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of all rows, one after another; row i owns words bounds[i] to bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False, spans: bool = False) -> Words:
    """Hash every word; ``lower`` folds A-Z, ``spans`` also returns the byte offsets of each word."""
    hashes, starts_all, ends_all, counts = [], [], [], []
    first, n_rows = 0, len(at) - 1
    while first < n_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        lo, hi = int(at[first]), int(at[last])
        part = raw[lo:hi]
        if lower:
            part = _LOWER[part]
        bounds = at[first : last + 1] - lo
        sep = _SEP[part]
        begins = ~sep
        opens = begins.copy()
        opens[1:] &= sep[:-1]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        opens[heads] = begins[heads]
        starts = np.flatnonzero(opens)
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        if len(starts):
            place = np.arange(len(part)) - starts[np.cumsum(opens) - 1]
            place[sep] = 0
            power = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
            value = _BYTE[part]
            value *= power[place]
            value[sep] = 0
            hashes.append(mix(np.add.reduceat(value, starts)))
            if spans:
                length = np.add.reduceat(begins.astype(np.int64), starts)
                starts_all.append(starts + lo)
                ends_all.append(starts + lo + length)
        first = last
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    bounds = np.concatenate(([0], np.cumsum(join(counts, np.int64)))).astype(np.int64)
    return Words(join(hashes, np.uint64), bounds, join(starts_all, np.int64) if spans else None, join(ends_all, np.int64) if spans else None)


def windows(w: Words, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row start, and the hash of those words (``which``: of two independent ones)."""
    n, h, step = len(w.hashes), w.hashes, _STEP[which]
    if which:
        h = mix(h + U64(0x632BE59BD9B4E019))
    end = np.repeat(w.bounds[1:], np.diff(w.bounds))
    at = np.flatnonzero(np.arange(n) + k <= end)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    if k <= 8:
        total, power = np.zeros(n - k + 1, np.uint64), step
        for j in range(k):
            total += h[j : n - k + 1 + j] * power
            power = U64(int(power) * int(step) & (2**64 - 1))
        return at, mix(total[at])
    power = np.cumprod(np.full(n, step, np.uint64))
    inverse = np.cumprod(np.full(n, U64(pow(int(step), -1, 2**64)), np.uint64))
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power)))
    return at, mix((prefix[at + k] - prefix[at]) * inverse[at])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each row, sorted, and their bounds; a row of fewer words is one shingle."""
    at, h = windows(w, k)
    lengths = np.diff(w.bounds)
    row = np.repeat(np.arange(len(lengths)), lengths)[at]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        extra = [mix(np.add.reduce(w.hashes[w.bounds[i] : w.bounds[i + 1]] * np.cumprod(np.full(lengths[i], _STEP[0], np.uint64)), keepdims=True) + U64(lengths[i])) for i in short]
        row, h = np.concatenate((row, short)), np.concatenate((h, *extra))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(lengths) + 1))
