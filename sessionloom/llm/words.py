"""Words and word hashes of whole Arrow batches, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D; words never cross texts. Hashes are 64-bit, depend on the bytes
alone and are the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words hashed at a time, so that scratch arrays stay in cache whatever the batch holds.
BLOCK = 65_536

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) <= n:
        size = 1 << max(16, n.bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        held = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, inverse))
        if n <= 1 << 21:
            _POWERS[int(base)] = held
    return held


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each text; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in byte positions, and the index of each text's first word (one more entry than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    stops[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), BLOCK):
        b = min(a + BLOCK, len(starts))
        low = starts[a]
        up, down = _powers(_BASE, int(ends[b - 1] - low))
        n = int(ends[b - 1] - low)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[low : low + n]] * up[:n], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive words, by the place of its first word; runs over the border of texts are the caller's to drop."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        m = b - a + size - 1
        up, down = _powers(_GRAM, m)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(words[a : a + m] * up[:m], out=sums[1:])
        out[a:b] = mix((sums[size : size + b - a] - sums[: b - a]) * down[: b - a])
    return out


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every `width` neighbours, by doubling."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def inside(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which places of `n` words start a run of `size` words within one text; first: as word_bounds gives it."""
    ok = np.zeros(max(n, 0) + 1, np.int64)
    begin, end = first[:-1], first[1:] - size + 1
    some = end > begin
    np.add.at(ok, begin[some], 1)
    np.add.at(ok, end[some], -1)
    return np.cumsum(ok)[:n] > 0


def slices(batch: pa.RecordBatch, text: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each (one text at least), to bound scratch memory."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    _, offsets = text_buffer(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
