"""Packing by power-of-two decomposition (operator 1).

A document of n ids is cut into pieces whose lengths are powers of two: as many
of the longest length as fit, then one for each binary digit of the rest.  Each
piece is a sequence of its own: no sequence crosses documents, and as every
length is a power of two, nothing is padded.  Equal lengths share a bucket: a
sequence id holds the bucket in its top bits, so that ordering or partitioning
by it deals out batches of one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import binary_array, flat, ranges, slices
from invarium.llm.shared import small_batches
from invarium.llm.tokenizing import file_encoder

#: Bits of a sequence id below the bucket: partition (25) and number in the bucket there (33).
BUCKET_SHIFT, PARTITION_SHIFT = 58, 33

SCHEMA = "start long, length long, bucket int, doc_tokens long, sequence_id long, offset long, ids binary"


def decompose(n: np.ndarray, log2_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary pieces of the lengths ``n``: (pieces of each, their exponents), longest first."""
    digits = np.arange(log2_longest - 1, -1, -1)
    has = (n[:, None] >> digits) & 1
    counts = np.concatenate([(n >> log2_longest)[:, None], has], axis=1)
    exponents = np.tile(np.arange(log2_longest, -1, -1), len(n))
    return counts.sum(axis=1), np.repeat(exponents, counts.ravel())


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, log2_longest: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: key, start, length, bucket, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit.  A null or empty text is packed
    as its end id alone, a null key stays null, a repeated row is packed again
    with sequences of its own, an empty table gives an empty table; other
    columns play no part.  One pass over the texts without a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        encoder = file_encoder(tokenizer)
        base = TaskContext.get().partitionId() << PARTITION_SHIFT
        used = np.zeros(log2_longest + 1, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = encoder.encode(*flat(batch.column("text")))
            n = np.diff(offsets) + 1
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            pieces, exponents = decompose(n, log2_longest)
            lengths = np.int64(1) << exponents
            ends = np.cumsum(lengths)
            document = np.repeat(np.arange(len(n)), pieces)
            start = ends - lengths - (np.cumsum(n) - n)[document]
            order = np.argsort(exponents, kind="stable")
            each = np.bincount(exponents, minlength=log2_longest + 1)
            number = np.empty(len(exponents), np.int64)
            number[order] = ranges(each)
            sequence = (exponents << BUCKET_SHIFT) + base + used[exponents] + number
            used += each
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(document)), pa.array(start), pa.array(lengths), pa.array(lengths.astype(np.int32)),
                    pa.array(n[document]), pa.array(sequence), pa.array(np.zeros(len(start), np.int64)), binary_array(ids.view(np.uint8), np.concatenate([[0], ends]) * 4),
                ],
                ["doc_id", "start", "length", "bucket", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return rows.mapInArrow(pack, f"doc_id {kind}, {SCHEMA}")
