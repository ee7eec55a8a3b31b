"""Vectorised words and hashes over Arrow text columns: whole batches of documents at numpy speed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at a time; a longer document is a chunk of its own.
CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: ASCII characters that are neither letters nor digits: what separates words whose punctuation doesn't matter.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = numbers(256, 11)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.have = U(base), np.ones(1, dtype=U)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.have):
            steps = np.full(max(n, 2 * len(self.have)), self.base)
            steps[0] = U(1)
            self.have = np.cumprod(steps, dtype=U)
        return self.have[:n]


POWERS, INVERSES, PLACES = Powers(BASE), Powers(INVERSE), Powers(0xD6E8FEB86659FD93)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls are empty."""
    if pa.types.is_string_view(column.type) or not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``limit`` bytes, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a chunk of documents, in order: hash (of the lower-cased bytes), document and the documents' bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        data = data[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        n, self.docs = len(data), len(at) - 1
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            self.first = np.zeros(self.docs + 1, np.int64)
            self.doc = np.zeros(0, np.int64)
            return
        inside = ~separators[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.empty(n, dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(BYTE[LOWER][data] * POWERS.upto(n), out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * INVERSES.upto(n + 1)[self.starts] + U(1))
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.first))

    def sequences(self, seed: int) -> np.ndarray:
        """A hash of each document's whole word sequence; 0 for one without words."""
        return sequence_hashes(self.hash, self.first, seed)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each run hashes[first[i]:first[i+1]]; 0 for an empty one."""
    sizes = np.diff(first)
    out = np.zeros(len(sizes), dtype=U)
    full = np.flatnonzero(sizes)
    if len(full):
        place = np.arange(len(hashes)) - np.repeat(first[:-1], sizes)
        terms = mix(hashes + U(seed)) * PLACES.upto(int(sizes.max()))[place]
        out[full] = mix(np.add.reduceat(terms, first[:-1][full]) + sizes[full].astype(U))
    return out


def shingles(words: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document: ``width`` words, or the whole sequence of a shorter text."""
    h, first = words.hash, words.first
    out: list[np.ndarray] = []
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, dtype=U)
        for k in range(width):
            rolled = rolled * U(0xA24BAED4963EE407) + h[k : len(h) - width + 1 + k]
        rolled = mix(rolled)
    whole = words.sequences(5)
    for d in range(words.docs):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(whole[d : d + 1] if b > a else np.zeros(0, U))
    return out
