"""Vectorised text blocks shared by the Arrow-batch operators.

A map function receives Arrow record batches of any size. `text_blocks` deals their rows out again in blocks of a
bounded number of bytes, so that the numpy temporaries of a block stay small whatever the batch size is; one text that
is longer than the bound is a block of its own. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000

#: Bytes 0x09-0x0D and 0x20, the white space of the operators' contracts.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Rows lo..hi of a batch: `data` holds their bytes end to end, `starts` (n + 1 entries) where each begins."""

    batch: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def texts(self) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist())]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield Block(batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on after its task, next to others."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_libc(), "malloc_trim", None)) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    return ctypes.CDLL(None)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Slices:
    """64-bit hashes of slices data[begin:end], many at once: a polynomial whose prefix sums give any slice."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(16, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slice_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Slices(data).hashes(begin, end) if len(begin) else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes that `is_word` (256 flags) marks, never across texts, and the number of
    words before each text (n + 1 entries)."""
    inside = is_word[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    first = starts[:-1][starts[:-1] < starts[1:]]
    opens[first] = inside[first]
    last = first[1:] - 1
    closes[last] = inside[last]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return begin, end, np.searchsorted(begin, starts)


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and the number of runs before each text (n + 1 entries).

    A text with fewer words, but at least one, has one run: all its words. `per_text` is what word_bounds returns.
    """
    counts = np.diff(per_text)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    before = np.concatenate([[0], np.cumsum(runs)])
    if not before[-1]:
        return np.zeros(0, np.uint64), before
    at = np.repeat(per_text[:-1] - before[:-1], runs) + np.arange(before[-1])
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = np.repeat(np.where(counts < size, counts, size), runs)
    for k in range(size):
        part = mix64(padded[at + k] + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        out = out * np.uint64(0xFF51AFD7ED558CCD) + np.where(k < short, part, np.uint64(k + 1))
    return mix64(out), before


def take_columns(block: Block, names: list[str]) -> list[pa.Array]:
    return [block.batch.column(block.batch.schema.get_field_index(c)) for c in names]


class KeyTable:
    """64-bit keys -> values, as a cascade of hash tables; each takes the keys that collided in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        keys, values = np.asarray(keys, np.uint64), np.asarray(values, np.int32)
        self.missing, self.levels = np.int32(missing), []
        bits, level = max(10, (4 * len(keys) + 1).bit_length()), 0
        while len(keys):
            factor, shift = np.uint64(_BASE + 2 * level * 0x1234567), np.uint64(64 - bits)
            slot = ((keys * factor) >> shift).astype(np.int64)
            at, stored = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.full(1 << bits, missing, np.int32)
            _, one = np.unique(slot, return_index=True)
            at[slot[one]], stored[slot[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            self.levels.append((factor, shift, at, stored))
            keys, values, bits, level = keys[rest], values[rest], max(10, bits - 3), level + 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, self.missing, np.int32)
        for factor, shift, at, stored in self.levels:
            slot = ((keys * factor) >> shift).astype(np.intp)
            out = np.where(at[slot] == keys, stored[slot], out)
        return out
