"""Blocks of documents that pass after pass reads without another shuffle.

A block is a bucket of a table in the shared folder.  Grouping by ``block`` or
joining packed answers to it moves the answers only, never the texts.
"""

from __future__ import annotations

import uuid
import zlib
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame

from invarium.llm.shared import drop_path, scratch_path


@contextmanager
def bucketed(rows: DataFrame, n: int):
    """``rows`` (with a column ``block`` from 0 to n - 1) as a table of n buckets, while the context lasts."""
    spark = rows.sparkSession
    name, path = f"blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks")
    rows.repartition(n, "block").write.bucketBy(n, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)


def edges_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Edges of equal hash ranges in ascending hashes."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1))


def pack(values: np.ndarray, dtype: str) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers cost next to nothing."""
    planes = values.astype(dtype).view(np.uint8).reshape(len(values), -1).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_ascending(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)), "<u8")


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)
