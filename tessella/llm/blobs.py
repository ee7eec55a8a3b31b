"""Compact arrays in binary columns, and key-value exchange by blocks instead of rows.

A chunk of documents sends each partition of a distributed table one block of sorted keys; the partition's task sums the
blocks and answers each with values in the same order. Blocks cost a few bytes a key where rows cost tens.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Byte planes under zstandard: small numbers take little."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T if len(v) else np.zeros((0, 0), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, part bounds): ``keys[order]`` is grouped by partition and sorted within each. Both sides of an exchange
    compute it again, so answers need no keys."""
    part = ((keys >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def deal_ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Like deal(), with partitions that are ranges: only for keys that are spread evenly. Sorted blocks then have small
    differences."""
    order = np.argsort(keys, kind="stable")
    part = (((keys[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    return order, np.searchsorted(part, np.arange(parts + 1))


class Sums:
    """Blocks of keys merged: ``of`` maps every row of the blocks to its distinct key's place."""

    def __init__(self, blocks: list[np.ndarray]):
        self.bounds = np.cumsum([0, *map(len, blocks)])
        rows = np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)
        self.keys, self.of = np.unique(rows, return_inverse=True)

    def total(self, values: list[np.ndarray]) -> np.ndarray:
        return np.bincount(self.of, weights=np.concatenate(values), minlength=len(self.keys)) if len(self.keys) else np.zeros(0)

    def answer(self, values: np.ndarray) -> list[np.ndarray]:
        rows = values[self.of]
        return [rows[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]
