"""Whole Arrow string columns as NumPy byte arrays, without per-row objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP = 1 << 18

U64 = np.uint64
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty string."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def steps(raw: np.ndarray, at: np.ndarray, size: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents of about ``size`` bytes."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that never cross a document."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = at[(at > 0) & (at < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def segment_sums(values: np.ndarray, at: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of each slice ``values[at[i]:at[i+1]]``; 0 for an empty one."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), dtype)
    full = at[:-1] < at[1:]
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0, dtype=dtype)
    return out


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of every slice ``raw[start:end]``, all slices at a time."""
    with np.errstate(over="ignore"):
        buf = np.concatenate([raw, np.zeros(16, np.uint8)])
        lanes8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        lanes4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
        s, size, pos = U64(seed), (end - start).astype(np.int64), start.astype(np.int64).copy()
        h = np.full(len(start), s + P5, U64)
        big = np.flatnonzero(size >= 32)
        if len(big):
            acc = [np.full(len(big), v, U64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            stripes, live, k = size[big] // 32, np.arange(len(big)), 0
            while len(live):
                p = pos[big[live]]
                for q in range(4):
                    acc[q][live] = _round(acc[q][live], lanes8[p + 8 * q])
                pos[big[live]] += 32
                k += 1
                live = live[stripes[live] > k]
            hb = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for q in range(4):
                hb = (hb ^ _round(np.zeros(len(big), U64), acc[q])) * P1 + P4
            h[big] = hb
        h += size.astype(U64)
        for _ in range(3):
            live = np.flatnonzero(end - pos >= 8)
            if not len(live):
                break
            p = pos[live]
            h[live] = _rotl(h[live] ^ _round(np.zeros(len(live), U64), lanes8[p]), 27) * P1 + P4
            pos[live] = p + 8
        live = np.flatnonzero(end - pos >= 4)
        if len(live):
            p = pos[live]
            h[live] = _rotl(h[live] ^ (lanes4[p].astype(U64) * P1), 23) * P2 + P3
            pos[live] = p + 4
        for _ in range(3):
            live = np.flatnonzero(end > pos)
            if not len(live):
                break
            p = pos[live]
            h[live] = _rotl(h[live] ^ (buf[p].astype(U64) * P5), 11) * P1
            pos[live] = p + 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
        return h


class KeyTable:
    """Open-addressing map from distinct unsigned 64-bit keys to 0..n-1, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, U64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.slot_key = np.zeros(1 << self.bits, U64)
        self.slot_id = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot_id[slot] < 0
            self.slot_id[slot[free]] = left[free]
            won = self.slot_id[slot] == left
            self.slot_key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    @property
    def keys(self) -> np.ndarray:
        """The keys in the order of their ids."""
        held = self.slot_id >= 0
        out = np.empty(int(held.sum()), U64)
        out[self.slot_id[held]] = self.slot_key[held]
        return out

    def __reduce__(self):
        return KeyTable, (self.keys,)  # slots are made anew where it is sent to

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * P1) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the keys, -1 where unknown."""
        slot = self._home(keys)
        got = self.slot_id[slot]
        wrong = np.flatnonzero((self.slot_key[slot] != keys) & (got >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            got[wrong] = self.slot_id[slot[wrong]]
            wrong = wrong[(self.slot_key[slot[wrong]] != keys[wrong]) & (got[wrong] >= 0)]
        return got
