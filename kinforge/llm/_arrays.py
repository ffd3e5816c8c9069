"""Numpy helpers: hashes of many segments at once, a hash table for whole arrays, words of Arrow strings."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]
#: Powers that a worker keeps; longer runs of them last as long as their text is read.
_KEPT_POWERS = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n + 1, 1 << 16), base, dtype=U)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps, out=steps))
    if n < _KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers of the base; one longer than ``values``."""
    pw, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * pw[: len(values)], out=out[1:])
    return out


def segment_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the segments [start, end) of what ``sums`` was made of; equal segments have equal hashes."""
    _, ipw = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * ipw[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class HashTable:
    """Open addressing from 64-bit keys to positions 0, 1, ... in order of insertion."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, dtype=U)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        self.n, self.probes = 0, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        todo, slot, steps = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            free = np.flatnonzero(self.at[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]] = keys[todo[won]]
            self.at[slot[won]] = self.n + todo[won]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & ((1 << self.bits) - 1)
            steps += 1
        self.probes = max(self.probes, steps)
        self.n += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's position, -1 where it is missing."""
        slot = self._slot(keys)
        got = self.at[slot]
        out = np.where(self.keys[slot] == keys, got, -1)
        left = np.flatnonzero((out < 0) & (got >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = slot[left]
            got = self.at[at]
            same = (self.keys[at] == keys[left]) & (got >= 0)
            out[left[same]] = got[same]
            left = left[~same & (got >= 0)]
        return out


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def _lower_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of an Arrow string array, null strings having none.

    data: the bytes; start, end: of each word in data; doc: the row of each word; first: each row's first
    word, one longer than there are rows; hash: 64 bits for each word.
    """

    def __init__(self, column: pa.Array, lower: bool):
        column = column.cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        base, stop = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[base:stop] if raw is not None and stop > base else np.zeros(0, dtype=np.uint8)
        offsets = offsets - base if n else np.zeros(1, dtype=np.int64)
        self.raw = data
        if lower:
            data = _lower_bytes()[data]
        self.data, self.offsets = data, offsets
        inside = np.ones(len(data) + 1, dtype=bool)
        inside[-1] = False
        inside[:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        if column.null_count:
            for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
                inside[offsets[k] : offsets[k + 1]] = False
        new = np.empty(len(data), dtype=bool)
        if len(data):
            new[0] = True
            new[1:] = ~inside[:-2]
            cut = offsets[:-1]
            new[cut[cut < len(data)]] = True
            last = np.empty(len(data), dtype=bool)
            last[:-1] = ~inside[1:-1]
            last[-1] = True
            cut = offsets[1:] - 1
            last[cut[cut >= 0]] = True
            self.start = np.flatnonzero(new & inside[:-1])
            self.end = np.flatnonzero(last & inside[:-1]) + 1
        else:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = segment_hash(prefix(byte_values()[self.data]), self.start, self.end)
        return self._hash


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def free_memory() -> None:
    """Give unused memory back: a worker lives on from stage to stage, beside others."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """Slices of a batch with about ``limit`` bytes of text each; one row at least."""
    sizes = batch[column].cast(pa.large_string())
    offsets = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + 20_000, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
    free_memory()
