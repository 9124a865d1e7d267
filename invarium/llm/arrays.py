"""Whole Arrow batches of texts as flat NumPy arrays.

A batch of texts is one byte buffer with offsets; words, chunks and lines are
index ranges in it.  Everything here works on a bounded slice of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ``[\x20\x09-\x0D]``
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte as it is (UTF-8 continuation bytes are above 127).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: An odd constant to roll hashes by.
A = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(batches, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``max_bytes`` in each; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = flat(batch.column(column))
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), n)
            yield batch.slice(start, end - start)
            start = end


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_large_string(texts.type) else b"")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The byte ranges (ascending, not overlapping) of ``buf`` as one Arrow array."""
    n = len(starts)
    if not n:
        return pa.array([], pa.large_binary())
    if np.array_equal(starts[1:], ends[:-1]):
        edges = np.append(starts, ends[-1])
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = starts, ends
    runs = pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf))])
    return runs.take(pa.array(np.arange(0, 2 * n - 1, 2)))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word (with the total last)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines split at \\n (an empty text is one empty line), and each text's first line."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    first = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    return starts, ends, first


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense codes of equal values, and the distinct values."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``lengths``, one after the other."""
    return gather(np.zeros(len(lengths), np.int64), lengths)


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lengths)
    small = total < 1 << 31 and (not len(starts) or int(starts.max()) + int(lengths.max()) < 1 << 31)
    kind = np.int32 if small else np.int64
    return np.repeat(shift.astype(kind), lengths) + np.arange(total, dtype=kind)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values from a flat buffer; ``offsets`` count bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
