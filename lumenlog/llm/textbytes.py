"""Vectorised work on the UTF-8 bytes of many texts: spans, their hashes, and a hash table from hashes to places."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space: the tab to the carriage return, and the space.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of a hash's word; what is read past a buffer's end.
PAD = 8
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)
try:
    _trim = ctypes.CDLL(None).malloc_trim  # glibc only
except (AttributeError, OSError):
    _trim = None


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S32)) * _B
    x = (x ^ (x >> _S29)) * _C
    return x ^ (x >> _S32)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with PAD zeros behind, and where each begins and the last ends. Nulls have none."""
    if not len(texts):
        return np.zeros(PAD, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return np.concatenate([body, np.zeros(PAD, dtype=np.uint8)]), bounds - bounds[0]


def release() -> None:
    """Give memory that this process has freed back to the system, so that what one task needed isn't held in the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about most bytes of text, at least a row each; frees what the task held at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
    release()


def words(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans without ASCII white space: their starts and ends, and the number of spans before each text."""
    inside = ~ASCII_SPACE[body[:-PAD]]
    first = np.zeros(len(inside) + 1, dtype=bool)
    first[bounds] = True
    first = first[:-1]
    starts = np.flatnonzero(inside & (first | np.concatenate([[True], ~inside[:-1]]))) if len(inside) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate([~inside[1:] | first[1:], [True]])) + 1 if len(inside) else starts
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every span."""
    at64 = np.ndarray(shape=(len(body) - 7,), dtype="<u8", buffer=body, strides=(1,))
    sizes = ends - starts
    one = sizes.astype(np.uint64) * _A
    two = mixed(one + _C)
    active = np.arange(len(starts))
    k = 0
    while len(active):
        left = sizes[active] - k
        part = at64[starts[active] + k] & _KEEP[np.minimum(left, 8)]
        one[active] = mixed(one[active] ^ part)
        two[active] = (two[active] + part) * _A ^ (two[active] >> _S29)
        k += 8
        active = active[left > 8]
    return one, mixed(two)


def packed(rising: np.ndarray) -> bytes:
    """Rising 64-bit numbers, as compressed planes of their differences' bytes."""
    steps = np.diff(rising, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(run: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(run, 8 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


class SlotTable:
    """A hash table from pairs of hashes to 0, 1, 2, ... in order of arrival, by open addressing over arrays."""

    def __init__(self, room: int = 1 << 16):
        self.count = 0
        self.one, self.two = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.table = np.full(4 * room, -1, dtype=np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slots, -1 where there is none."""
        out = np.full(len(one), -1, dtype=np.int64)
        left = np.arange(len(one))
        mask = np.int64(len(self.table) - 1)
        place = (one & np.uint64(mask)).astype(np.int64)
        while len(left):
            slot = self.table[place]
            there = slot >= 0
            same = there & (self.one[slot] == one[left]) & (self.two[slot] == two[left])
            out[left[same]] = slot[same]
            go = there & ~same
            left, place = left[go], (place[go] + 1) & mask
        return out

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        """Add pairs that differ and aren't there."""
        first, self.count = self.count, self.count + len(one)
        if self.count > len(self.one):
            room = 1 << int(2 * self.count - 1).bit_length()
            for name in ("one", "two"):
                grown = np.zeros(room, np.uint64)
                grown[:first] = getattr(self, name)[:first]
                setattr(self, name, grown)
            self.table = np.full(4 * room, -1, dtype=np.int32)
            fresh = np.arange(self.count)
        else:
            fresh = np.arange(first, self.count)
        self.one[first : self.count], self.two[first : self.count] = one, two
        mask = np.int64(len(self.table) - 1)
        place = (self.one[fresh] & np.uint64(mask)).astype(np.int64)
        while len(fresh):
            free = self.table[place] < 0
            self.table[place[free]] = fresh[free]
            go = self.table[place] != fresh
            fresh, place = fresh[go], (place[go] + 1) & mask
