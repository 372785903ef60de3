"""Words, hashes and shingles of a block of texts in numpy, used inside tasks.

Texts stay UTF-8 bytes in one buffer per block. A word hash is a polynomial over its
bytes modulo 2**64 (random odd base, random value per byte), read off a running sum,
then mixed; a shingle hash combines its word hashes. Two different words or shingles
of one comparison share a hash with a probability of about 2**-64, which the
operators count as never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Small enough for a block's arrays to stay in a core's cache.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_bytes = np.arange(256)
#: Bytes outside words: ASCII white space; or all ASCII but digits and letters.
SPACE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
NOT_ALNUM = (_bytes < 128) & ~(
    ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | ((_bytes >= 65) & (_bytes <= 90))
)
del _bytes

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


@dataclass
class Block:
    """Words of consecutive texts. Arrays are by word, but for the last two (by text)."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of text i: words first[i] .. first[i + 1]
    offset: np.ndarray  # of text i: bytes offset[i] .. offset[i + 1]

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def cut_words(data: bytes, offset: np.ndarray, outside: np.ndarray) -> Block:
    """Words are maximal runs of bytes that are not ``outside``, within each text."""
    buf = np.frombuffer(data, np.uint8)
    inside = ~outside[buf]
    n = len(buf)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offset[:-1][offset[:-1] < offset[1:]]
        before[edges] = False
        after[edges[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power_table(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offset)
    doc = np.repeat(np.arange(len(offset) - 1), np.diff(first))
    return Block(data, start, end, doc, h, first, offset)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes; the caller drops runs over two texts."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for k in range(1, width):
        acc = acc * _STEP + h[k : k + n]
    return mix(acc + np.uint64(width))


def text_column(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """A view of the UTF-8 bytes of a string array, and where its texts start; null counts as empty."""
    values = values.cast(pa.large_string()) if not pa.types.is_large_string(values.type) else values
    if values.null_count:
        values = values.fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return memoryview(b"" if data is None else data), offsets


def text_blocks(values: pa.Array, lower: bool = True, target: int = BLOCK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first text, past last text, bytes, where texts start) for runs of whole texts of about ``target`` bytes.

    Only the bytes of one run are copied at a time, not those of the whole array.
    """
    data, offset = text_column(values)
    i, n = 0, len(values)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + target, "right")) - 1)
        j = min(j, n)
        part = data[int(offset[i]) : int(offset[j])].tobytes()
        yield i, j, part.translate(_LOWER) if lower else part, offset[i : j + 1] - offset[i]
        i = j


def blocks(values: pa.Array, outside: np.ndarray, lower: bool = True, target: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first text, past last text, words) for the runs of ``text_blocks``."""
    for i, j, data, offset in text_blocks(values, lower, target):
        yield i, j, cut_words(data, offset, outside)


def distinct_sorted(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    if len(a) < 2:
        return a
    keep = np.empty(len(a), bool)
    keep[0] = True
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct shingle hashes; fewer words than ``width``: one shingle."""
    grams = shingles(block.hash, width)
    first = block.first
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield distinct_sorted(grams[a : b - width + 1])
        elif b > a:
            yield shingles(block.hash[a:b], b - a)
        else:
            yield grams[:0]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An array<kind> column out of one numpy array per row."""
    offset = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offset[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(flat, kind))


def lists_of(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column of consecutive pieces of ``flat``, one of each length."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(flat))
