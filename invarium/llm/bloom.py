"""Once-seen and twice-seen Bloom filters, built and merged in Spark.

Both filters have one hash function.  A pair (once, twice) of partial filters
merges as ``twice = twice1 | twice2 | once1 & once2``, ``once = once1 | once2``:
a key that two rows hold is always in ``twice``.  The filters are dealt out in
pieces of 2^17 bits, so that no task holds more than one piece of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.shared import shuffle_partitions

PIECE_BITS = 17


def seen_twice(hashes: DataFrame, log2_bits: int) -> np.ndarray:
    """Bits (packed) of the keys that ``hashes`` may hold twice or more.

    ``hashes``: rows of (once binary, twice binary, piece int) from ``partial``.
    What reaches the driver is 2^log2_bits bits at most: a fixed size, whatever
    the input.  A filter that fills up passes more keys, never fewer.
    """

    def merge(batches):
        piece, once, twice = -1, None, None

        def done():
            packed = np.packbits(twice, bitorder="little")
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["piece", "bits"])

        for batch in batches:
            for p, a, b in zip(batch.column("piece").to_pylist(), batch.column("once").to_pylist(), batch.column("twice").to_pylist()):
                if p != piece:
                    if piece >= 0 and twice.any():
                        yield done()
                    piece, once, twice = p, np.zeros(1 << PIECE_BITS, bool), np.zeros(1 << PIECE_BITS, bool)
                own = np.frombuffer(a, np.uint32)
                twice[own[once[own]]] = True
                twice[np.frombuffer(b, np.uint32)] = True
                once[own] = True
        if piece >= 0 and twice.any():
            yield done()

    n = max(1, min(shuffle_partitions(hashes.sparkSession), 1 << (log2_bits - PIECE_BITS)))
    pieces = hashes.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, bits binary")
    out = np.zeros(1 << (log2_bits - 3), np.uint8)
    size = 1 << (PIECE_BITS - 3)
    for row in pieces.toLocalIterator():
        out[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def partial(positions: np.ndarray) -> pa.RecordBatch:
    """The filters of one task, from the positions of all its keys (with repeats)."""
    distinct, counts = np.unique(positions, return_counts=True)
    piece = (distinct >> PIECE_BITS).astype(np.int64)
    within = (distinct & ((1 << PIECE_BITS) - 1)).astype(np.uint32)
    present, first = np.unique(piece, return_index=True)
    edges = np.append(first, len(piece))
    once = [within[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    twice = [within[a:b][counts[a:b] > 1].tobytes() for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["piece", "once", "twice"])


PARTIAL = "piece int, once binary, twice binary"


def position(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - log2_bits)).astype(np.int64)


def holds(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def row_key(*columns: str):
    """A 128-bit name of a row's content, for joining a decision back to its row; equal rows share it."""
    parts = [F.coalesce(F.hex(F.encode(F.col(f"`{c}`").cast("string"), "UTF-8")), F.lit("-")) if c != columns[-1] else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("|", *parts).cast("binary")))
