"""Byte-level BPE encoding and decoding (operator 2).

The tiktoken library encodes with a local rank file; texts are split at safe
boundaries first, so that a long text costs no more than its distinct chunks.
Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import binary_array, flat, list_array, slices
from invarium.llm.shared import small_batches
from invarium.llm.tokenizing import rank_bytes, rank_encoder


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row's whole text.

    A null or empty text gives an empty list, a null key stays null, a repeated
    row is encoded again, an empty table gives an empty table; other columns
    play no part.  No shuffle.
    """
    small_batches(docs.sparkSession)
    keys = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def encode(batches):
        encoder = rank_encoder(ranks, pattern)
        for batch in slices(batches, "text"):
            ids, offsets = encoder.encode(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(ids.astype(np.int32), offsets, pa.int32())], ["doc_id", "ids"])

    kind = keys.schema["doc_id"].dataType.simpleString()
    return keys.mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def bpe_decode(tokens: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids, decoded): the raw bytes of the ids, which need not be valid text.

    Null or empty ids give empty bytes; a null id among them gives no bytes; an
    id beyond the ranks fails the query.  Repeated rows are decoded each, an
    empty table gives an empty table; other columns play no part.
    """
    rows = tokens.select("doc_id", "ids")

    def decode(batches):
        table = rank_bytes(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                lists = part.column("ids")
                lengths = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
                values = table.take(lists.flatten())
                data, ends = flat(values)
                at = np.concatenate([[0], np.cumsum(lengths)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, binary_array(data, ends[at])], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decode, f"doc_id {kind}, ids array<int>, decoded binary")
