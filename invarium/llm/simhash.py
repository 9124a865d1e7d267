"""SimHash near-duplicates (operator 8).

Fingerprints of 64 bits link at ``radius`` (2) or fewer differing bits.  The
distinct fingerprints are compared only: those that agree in two of four bands
of 16 bits meet in a bucket (two bits cannot touch more than two bands, so no
link is lost).  Buckets are compared bit-sliced: bit planes are stored
vertically, a plane's XOR is added to the distances of 64 pairs at a time by
carry-save counters, and a block is abandoned once all of its distances exceed
the radius.  A bucket beyond ``BUCKET_LIMIT`` is resolved exactly by masking
every choice of up to two bits, which leaves groups of at most four.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import flat, slices
from invarium.llm.bit_slices import SMALL, majority, pairs_large, pairs_small
from invarium.llm.components import components
from invarium.llm.jaccard import jaccard_links, set_prints
from invarium.llm.shared import fresh, small_batches, staged
from invarium.llm.tokenizing import release

RADIUS = 2
BANDS = 4
WIDTH = 64 // BANDS
PAIRS = tuple(combinations(range(BANDS), 2))
BUCKET_LIMIT = 8192


def fingerprints_of(texts, shingle: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included (no words: zero)."""
    buf, offsets = flat(texts)
    data = buf.tobytes()
    hashed, counts = [], []
    digest = xxhash.xxh64_intdigest
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = b" ".join(data[a:b].lower().split())
        gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        if len(gaps) < shingle - 1:
            own = [digest(text, seed)] if text else []
        else:
            starts = [0, *(gaps + 1).tolist()]
            ends = [*gaps.tolist(), len(text)]
            own = [digest(text[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :])]
        hashed += own
        counts.append(len(own))
    values, counts = np.array(hashed, np.uint64), np.array(counts, np.int64)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(full):  # about a million hashes at a time
        hi = max(lo + 1, int(np.searchsorted(ends[full], (ends[full[lo - 1]] if lo else 0) + (1 << 20), side="right")))
        own = full[lo:hi]
        first = int(ends[own[0]] - counts[own[0]])
        out[own] = majority(values[first : int(ends[own[-1]])], ends[own] - counts[own] - first, counts[own])
        lo = hi
    return out


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint long): the signed 64 bits of each row's SimHash; a null or empty text has zero."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        release()
        for batch in slices(batches, "text", 2 << 20):
            found = fingerprints_of(batch.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the links, those that join something: a spanning forest with the same components."""
    parent: dict[int, int] = {}
    keep = np.zeros(len(a), bool)

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[k] = True
    return keep


def bucket_links(values: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within buckets (``bucket`` ascending from 0)."""
    sizes = np.bincount(bucket)
    small = sizes[bucket] <= SMALL
    at = np.flatnonzero(small)
    a, b = pairs_small(values[at], np.unique(bucket[at], return_inverse=True)[1], RADIUS) if len(at) else (at, at)
    found_a, found_b = [at[a]], [at[b]]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k in np.flatnonzero(sizes > SMALL):
        a, b = pairs_large(values[edges[k] : edges[k + 1]], RADIUS)
        keep = _forest(a, b)
        found_a.append(a[keep] + edges[k])
        found_b.append(b[keep] + edges[k])
    return np.concatenate(found_a), np.concatenate(found_b)


def _link_groups(batches):
    """Links of the buckets in a stream sorted by bucket; a bucket may span batches."""
    key, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key, value):
        _, bucket, sizes = np.unique(key, return_inverse=True, return_counts=True)
        full = sizes[bucket] > 1
        if full.any():
            value = value[full]
            a, b = bucket_links(value, np.unique(bucket[full], return_inverse=True)[1])
            keep = _forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(value[a[keep]].view(np.int64)), pa.array(value[b[keep]].view(np.int64))], ["a", "b"])

    for batch in batches:
        key = np.concatenate([key, batch.column("bucket").to_numpy()])
        value = np.concatenate([value, batch.column("fingerprint").to_numpy().view(np.uint64)])
        end = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if end >= 1 << 16:
            yield from links(key[:end], value[:end])
            key, value = key[end:], value[end:]
    yield from links(key, value)


def near_links(distinct: DataFrame, limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b): links between the distinct fingerprints (column ``fingerprint``) that keep all components."""
    f = F.col("fingerprint")
    band = [F.shiftrightunsigned(f, WIDTH * k).bitwiseAND((1 << WIDTH) - 1) for k in range(BANDS)]
    keys = F.array(*[F.shiftleft(F.lit(n).cast("long"), 2 * WIDTH).bitwiseOR(F.shiftleft(band[i], WIDTH)).bitwiseOR(band[j]) for n, (i, j) in enumerate(PAIRS)])
    rows = distinct.select(F.explode(keys).alias("bucket"), "fingerprint")
    large = staged(rows.groupBy("bucket").count().filter(F.col("count") > limit).select("bucket"), "large-buckets")
    normal = rows.join(large, "bucket", "left_anti")
    links = normal.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_groups, "a long, b long")
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    masked = (
        rows.join(large, "bucket", "left_semi").select("fingerprint").distinct()
        .select("fingerprint", F.posexplode(F.lit(np.array(masks, np.uint64).view(np.int64).tolist())).alias("m", "mask"))
        .select("m", f.bitwiseAND(F.bitwise_not("mask")).alias("rest"), "fingerprint")
    )
    groups = masked.groupBy("m", "rest").agg(F.min("fingerprint").alias("a"), F.collect_set("fingerprint").alias("all")).filter(F.size("all") > 1)
    return links.union(groups.select("a", F.explode("all").alias("b")).filter("a <> b"))


def near_duplicates(fingerprints: DataFrame, links=near_links) -> DataFrame:
    """(doc_id, fingerprint, component_id) of rows (doc_id, fingerprint); ``links`` joins distinct fingerprints.

    ``component_id`` is the smallest doc_id that the row reaches over links,
    its own group of equal fingerprints included; null ids are in no case the
    smallest, and a group of null ids alone has null.  Repeated rows are
    returned as often as given; an empty table gives an empty table.
    """
    prints = staged(fingerprints, "fingerprints")
    groups = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = components(links(groups.select("fingerprint")))
    placed = groups.join(parts, groups.fingerprint == parts.node, "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    placed = staged(placed, "placed")
    least = staged(placed.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    named = staged(placed.join(least, "component").select("fingerprint", "component_id"), "named")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def dedup_near(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest id.

    Near-duplicates have an exact Jaccard similarity of ``least`` or more over
    the sets of their ``shingle``-word shingles.  Rows that share an id are one
    document and stay or go together; rows without an id cannot be named by a
    decision and stay.  Texts without a word are one group.  An empty table
    gives an empty table.
    """
    prints = staged(set_prints(docs, key, text, shingle), "prints")
    found = near_duplicates(prints.select("doc_id", "fingerprint"), lambda _: jaccard_links(docs, prints, key, text, shingle, least)).filter("doc_id <> component_id")
    gone = staged(found.select(F.col("doc_id").alias(fresh(docs, "gone"))).distinct(), "gone")
    return docs.join(gone, F.col(f"`{key}`") == F.col(gone.columns[0]), "left_anti")
