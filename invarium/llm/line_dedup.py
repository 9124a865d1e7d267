"""Line dedup with two Bloom filters (operator 10).

Pass one puts the hash of every distinct line key of a document into a
once-seen filter and, where it is there already, into a twice-seen filter.  Pass
two lets only lines in the twice-seen filter through: these few are shuffled by
their 128-bit digest, counted exactly by documents, and either dropped in every
document or kept at their first occurrence alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import LOWER, SPACE, flat, line_spans, slices, spans
from invarium.llm.bloom import PARTIAL, holds, partial, position, row_key, seen_twice
from invarium.llm.shared import fresh, small_batches, staged
from invarium.llm.tokenizing import release

#: 2^27 bits: 16 MB for each Python worker.  More lines than that need more bits to keep suspects few.
LOG2_BITS = 27


def line_keys(texts, least_chars: int):
    """(text, line number, key) of each line of an Arrow array whose key has ``least_chars`` code points.

    The key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in lower
    case.  The keys are one Arrow array, texts and line numbers NumPy arrays.
    """
    buf, offsets = flat(texts)
    starts, ends, first = line_spans(buf, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number = np.arange(len(starts)) - first[text]
    solid = np.flatnonzero(~SPACE[buf]) if len(buf) else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = hi > lo
    key_start, key_end = solid[lo[full]], solid[hi[full] - 1] + 1
    text, number = text[full], number[full]
    if least_chars > 1:
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        long = chars[key_end] - chars[key_start] >= least_chars
        key_start, key_end, text, number = key_start[long], key_end[long], text[long], number[long]
    return text, number, spans(LOWER[buf], key_start, key_end)


def _distinct(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One line of each key in each text."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return order[new]


def _hashes(keys: pa.Array) -> np.ndarray:
    coded = keys.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(k) for k in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def repeated_lines(docs: DataFrame, min_docs: int, least_chars: int, keep_first: bool = False, key: str = "doc_id", text: str = "text", log2_bits: int = LOG2_BITS) -> DataFrame:
    """(row, lines): line numbers to drop, for the rows that have any; ``row`` is ``row_key(key, text)``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))

    def fill(batches):
        release()
        found = []
        for batch in slices(batches, "__text", 4 << 20):
            t, _, keys = line_keys(batch.column("__text"), least_chars)
            hashes = _hashes(keys)
            found.append(position(hashes[_distinct(t, hashes)], log2_bits))
        if found:
            yield partial(np.concatenate(found))

    bits = spark.sparkContext.broadcast(seen_twice(rows.select("__text").mapInArrow(fill, PARTIAL), log2_bits))

    def suspect(batches):
        release()
        table = bits.value
        for batch in slices(batches, "__text", 4 << 20):
            t, number, keys = line_keys(batch.column("__text"), least_chars)
            hashes = _hashes(keys)
            at = np.flatnonzero(holds(table, position(hashes, log2_bits)))
            at = at[np.lexsort((number[at], hashes[at], t[at]))]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (t[at[1:]] != t[at[:-1]]) | (hashes[at[1:]] != hashes[at[:-1]])
            first = np.flatnonzero(new)
            names = [hashlib.blake2b(k, digest_size=16).digest() for k in keys.take(pa.array(at[first])).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(number[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(t[at[first]])), batch.column("__key").take(pa.array(t[at[first]])), pa.array(names, pa.binary()), lists], ["row", "__key", "line", "lines"])

    keyed = rows.select(row_key("__key", "__text").alias("row"), "__key", "__text")
    suspects = staged(keyed.mapInArrow(suspect, "row binary, __key string, line binary, lines array<int>"), "suspects")
    whole_number = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    named = F.coalesce("__key", F.hex("row"))
    confirmed = suspects.groupBy("line").agg(F.count_distinct(named).alias("n"), F.min(F.struct(F.col("__key").isNull().alias("unnamed"), F.col("__key").cast("long") if whole_number else F.col("__key"), "row")).alias("owner"))
    confirmed = staged(confirmed.filter(F.col("n") >= min_docs).select("line", F.col("owner.row").alias("owner")), "confirmed")
    hit = suspects.join(confirmed, "line")
    lines = F.when(F.col("row") == F.col("owner"), F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).otherwise(F.col("lines")) if keep_first else F.col("lines")
    return hit.groupBy("row").agg(F.flatten(F.collect_set(lines)).alias("lines"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, least_chars: int = 1, keep_first: bool = False, key: str = "doc_id", text: str = "text", log2_bits: int = LOG2_BITS) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and two more columns: ``__n_lines`` and ``__n_dropped`` (long).

    A key found in ``min_docs`` documents or more loses all its lines in every
    document; with ``keep_first`` the first line of the document with the
    smallest key stays.  Lines with less than ``least_chars`` code points are
    never dropped.  Rows that share a key are one document; rows without one are
    a document for each text, and come last.  Null and empty texts have one
    empty line and become empty; texts of any length are whole; other columns
    pass through, and where they have one of the new names the new column gets
    an underscore more in front; an empty table gives an empty table.

    The suspects are a small part of the lines; the texts are shuffled once, by
    the row's own key, so that a line in a third of all documents meets in no
    single task.
    """
    drops = repeated_lines(docs, min_docs, least_chars, keep_first, key, text, log2_bits).select("row", F.array_distinct("lines").alias("drop"))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text], body.alias("text"), row_key(key, text).alias("row"))
    joined = rows.join(drops, "row", "left").withColumn("lines", F.split("text", "\n", -1))  # lines are not shuffled
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    # one struct, so that the lines are split once, whatever the plan
    kept = F.transform(F.array(F.struct(F.col("lines").alias("l"), left.alias("k"))), lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))[0]
    back = {c: F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept) if c == text else F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    more = [F.size("lines").cast("long").alias(fresh(docs, "__n_lines")), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias(fresh(docs, "__n_dropped"))]
    return joined.select(*[back[c].alias(c) for c in docs.columns], *more)
