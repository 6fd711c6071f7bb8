"""Vectorised hashes of words and of runs of words, straight from Arrow string buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = _LOWER.astype(np.uint64) + np.uint64(1)
_powers: list[np.ndarray] = []


def give_back() -> None:
    """Returns freed memory of a worker that lives on to the system: Arrow's and, where the C library can, the heap's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k for k below n, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of a string column, about slice_bytes at a time; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and byte position of every word; words are split at ASCII white space, A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    values = _VALUES[data]
    values *= up[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets))), starts


def run_sums(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sums of hashes[i + j] * STEP ** j over j below k, for every i that has k words: those of twice as many words are made of two."""
    n = max(len(hashes) - k + 1, 0)
    out, done, part, size = np.zeros(n, np.uint64), 0, hashes, 1
    while n:
        if k & size:
            out += part[done : done + n] * np.uint64(pow(int(STEP), done, 1 << 64))
            done += size
        if done == k:
            break
        part = part[:-size] + part[size:] * np.uint64(pow(int(STEP), size, 1 << 64))
        size *= 2
    return out


def run_hashes(hashes: np.ndarray, rows: np.ndarray, k: int, short: bool = True, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of k words within a row. short: a row of fewer words, but
    not none, is one run. where: only runs that begin with one of these words."""
    n = len(hashes)
    total = run_sums(hashes, k)
    ok = rows[: n - k + 1] == rows[k - 1 :] if n >= k else np.zeros(0, bool)
    at = np.flatnonzero(ok if where is None else ok & where[: len(ok)])
    out, out_rows = mix(total[at]), rows[at]
    if short and n:
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        count = np.diff(np.append(begin, n))
        few = np.flatnonzero(count < k)
        if len(few):
            whole = [mix(np.array([np.sum(hashes[b : b + c] * np.cumprod(np.full(c, STEP, np.uint64), dtype=np.uint64), dtype=np.uint64) + np.uint64(c)]))[0] for b, c in zip(begin[few], count[few], strict=True)]
            out, out_rows, at = np.append(out, np.array(whole, np.uint64)), np.append(out_rows, rows[begin[few]]), np.append(at, begin[few])
    return out, out_rows, at


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of k words."""
    for _, data, offsets in buffers(column):
        hashes, rows, _ = word_hashes(data, offsets)
        runs, owner, _ = run_hashes(hashes, rows, k)
        order = np.argsort(owner, kind="stable")
        runs, bounds = runs[order], np.searchsorted(owner[order], np.arange(len(offsets)))
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield np.unique(runs[a:b])
