"""Near-duplicates by exact Jaccard similarity of word shingles.

No radius of a 64-bit SimHash names all pairs of a given Jaccard similarity and
no others (at 0.8 the differing bits scatter around ten), so SimHash sieves and
whole sets decide.

Sets meet in bands of ``ROWS`` minima each, as many as leave a pair of
similarity ``least`` apart with probability ``LOSS`` (23 at 0.8), whatever the
length of its texts.  Sets that meet are compared bit-sliced by their SimHashes
at a radius of ``SIEVE`` bits.  At similarity 0.8 a bit differs with probability
0.152, so that a pair is lost with probability 1.5e-7; sets of fewer than
``LEAST_SIEVED`` shingles, where bits are less sure, pass unsieved.  What passes
is verified with the whole sets: components of sieved pairs hold all links, and
each set is sent to its component once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import A, LOWER, codes_of, flat, gather, mixed, slices, spans, word_spans
from invarium.llm.bit_slices import SMALL, clustered, least_labels, majority, pairs_small
from invarium.llm.components import components
from invarium.llm.shared import small_batches, staged
from invarium.llm.tokenizing import release

#: Minima of a band, and the probability that no band brings a pair together.
ROWS, LOSS = 3, 1e-7
#: Differing bits of SimHashes that pass, and sets too small to be sieved.
SIEVE, LEAST_SIEVED = 26, 64
#: Rows of one band's key, and members of all sets of a group, that one task holds.
CHUNK_ROWS, UNIT_SIZE = 1 << 17, 1 << 21


def sets_of(texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets; fewer words are one shingle, none is no shingle."""
    buf, offsets = flat(texts)
    starts, ends, first = word_spans(buf, offsets)
    codes, distinct = codes_of(spans(LOWER[buf], starts, ends))
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[codes]
    n = np.diff(first)
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at, length = gather(first[:-1], counts), np.repeat(np.minimum(n, shingle), counts)
    document = np.repeat(np.arange(len(n)), counts)
    rolled = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            more = rolled * A + words[np.minimum(at + k, len(words) - 1)]
            rolled = np.where(k < length, more, rolled)
    hashes = mixed(rolled)
    order = np.lexsort((hashes, document))
    hashes, document = hashes[order], document[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    return hashes[new], np.searchsorted(document[new], np.arange(len(n) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each range of ``values`` as a set."""
    with np.errstate(over="ignore"):
        totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ A), dtype=np.uint64)])
        return mixed(totals[offsets[1:]] - totals[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * A)


def _simhashes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each range of ``values``."""
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = majority(values, offsets[:-1][full], counts[full])
    return out


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(body).alias("row"), body.alias("text"))


def set_prints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, row, fingerprint, size) of each row: hashes that name its text and its shingle set, and the set's size."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, key, text)

    def run(batches):
        release()
        for batch in slices(batches, "text", 2 << 20):
            hashes, offsets = sets_of(batch.column("text"), shingle)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(_sums(hashes, offsets).view(np.int64)), pa.array(np.diff(offsets).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "fingerprint", "size"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, fingerprint long, size int")


def n_bands(least: float, rows: int = ROWS, loss: float = LOSS) -> int:
    """Bands of ``rows`` minima that a pair of similarity ``least`` misses with probability ``loss`` at most."""
    return 1 if least >= 1 else math.ceil(math.log(loss) / math.log(1 - least**rows))


def band_keys(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """(sets, bands): the key of each non-empty set in each band."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.empty((len(offsets) - 1, bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(offsets) - 1, band, np.uint64)
            for factor in factors[band * rows : (band + 1) * rows]:
                key = mixed(key * A + np.minimum.reduceat(hashes * factor, offsets[:-1]))
            keys[:, band] = key
    return keys


def banded(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(key, size, fingerprint, simhash): the bands of each distinct set that a task meets."""
    bands = n_bands(least)

    def run(batches):
        release()
        seen = np.zeros(0, np.uint64)
        for batch in slices(batches, "text", 2 << 20):
            hashes, offsets = sets_of(batch.column("text"), shingle)
            sums, sizes = _sums(hashes, offsets), np.diff(offsets)
            prints, at = np.unique(sums, return_index=True)
            at = at[~np.isin(prints, seen) & (sizes[at] > 0)]
            seen = np.union1d(seen, prints)
            if not len(at):
                continue
            own, edges = hashes[gather(offsets[:-1][at], sizes[at])], np.concatenate([[0], np.cumsum(sizes[at])])
            keys = band_keys(own, edges, bands).ravel().view(np.int64)
            named = [np.repeat(x, bands).view(np.int64) for x in (sums[at], _simhashes(own, edges))]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(sizes[at], bands).astype(np.int32)), *map(pa.array, named)], ["key", "size", "fingerprint", "simhash"])

    return texts.select("text").mapInArrow(run, "key long, size int, fingerprint long, simhash long")


_SIEVED = ("kind", "key", "chunk", "fingerprint", "size", "simhash")
_SIEVED_DDL = "kind int, key long, chunk int, fingerprint long, size int, simhash long"


def _candidates(key, size, value, simhash, least: float):
    """Stars (the smallest name, another) of sets that share a key and may be alike by size and SimHash."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (least * size[1:] > size[:-1] + 1e-9)
    group = np.cumsum(new) - 1
    counts = np.bincount(group)
    several = counts[group] > 1
    value, size, simhash, group = value[several], size[several].astype(np.int64), simhash[several], np.unique(group[several], return_inverse=True)[1]
    if not len(value):
        return value, value
    counts = np.bincount(group)
    edges = np.concatenate([[0], np.cumsum(counts)])
    exempt = size < LEAST_SIEVED
    small, lenient = counts[group] <= SMALL, np.bincount(group[exempt], minlength=len(counts))[group] > 0
    found_a, found_b = [], []
    for which, radius in ((small & ~lenient, SIEVE), (small & lenient, 64)):
        at = np.flatnonzero(which)
        if len(at):
            a, b = pairs_small(simhash[at], np.unique(group[at], return_inverse=True)[1], radius)
            found_a.append(at[a])
            found_b.append(at[b])
    for k in np.flatnonzero(counts > SMALL):
        own = slice(edges[k], edges[k + 1])
        label = clustered(simhash[own], size[own], exempt[own], SIEVE, least) + edges[k]
        found_a.append(label)
        found_b.append(np.arange(edges[k], edges[k + 1]))
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    ok = (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9) | (counts[group[a]] > SMALL)
    label = least_labels(a[ok], b[ok], len(value))
    centre = np.full(len(value), np.iinfo(np.int64).max)
    np.minimum.at(centre, label, value)
    centre = centre[label]
    other = centre != value
    return centre[other], value[other]


def _sieve(least: float, chunk_rows: int):
    """Links (key, fingerprint) of sets that may be alike, from rows sorted by (key, size, fingerprint).

    A task holds ``chunk_rows`` rows of a key at most: more are cut into chunks
    that share a row, and handed on (kind 1) so that chunks can meet.
    """

    def made(columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(_SIEVED))

    def groups(held):
        key, size, value, simhash = held
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
        names, members = _candidates(key[keep], size[keep], value[keep], simhash[keep].view(np.uint64), least)
        n = len(names)
        return made([np.zeros(n, np.int32), names, np.zeros(n, np.int32), members, np.zeros(n, np.int32), np.zeros(n, np.int64)])

    def handed(held, chunk):
        key, size, value, simhash = held
        return made([np.ones(len(key), np.int32), key, np.full(len(key), chunk, np.int32), value, size, simhash])

    def run(batches):
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        held, chunk = empty, 0
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "size", "fingerprint", "simhash"))]
            while len(held[0]):
                if chunk:  # the first rows go on with a key that was cut
                    end = int(np.searchsorted(held[0], held[0][0], side="right"))
                    if end < len(held[0]):
                        yield handed([h[:end] for h in held], chunk)
                        yield groups([h[:end] for h in held])
                        held, chunk = [h[end:] for h in held], 0
                        continue
                    end = 0
                else:
                    end = int(np.searchsorted(held[0], held[0][-1]))
                if end >= 1 << 18 or (end and len(held[0]) - end >= chunk_rows):
                    yield groups([h[:end] for h in held])
                    held = [h[end:] for h in held]
                elif not end and len(held[0]) >= chunk_rows:
                    own = [h[:chunk_rows] for h in held]
                    yield handed(own, chunk)
                    yield groups(own)
                    held, chunk = [h[chunk_rows - 1 :] for h in held], chunk + 1
                else:
                    break
        if chunk:
            yield handed(held, chunk)
        yield groups(held)

    return run


def _linked(names: list[int], labels: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of similarity ``least`` or more that join all sets of one component, beyond what ``labels`` join already.

    One set asks all others at a time, those of the smallest components first;
    once all that are left belong to one component, nothing can change.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    label = np.unique(labels, return_inverse=True)[1]
    if n == 2:
        if label[0] == label[1]:
            return []
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(min(names), max(names))] if common >= least * (sizes.sum() - common) - 1e-9 else []
    given = label.copy()
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    edges = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(distinct)))])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    left = np.arange(n)
    while len(left) > 1:
        own, counts = np.unique(label[left], return_counts=True)
        if len(own) < 2:
            break
        i = int(left[label[left] == own[np.argmin(counts)]][0])
        left = left[left != i]
        mine = codes[begin[i] : begin[i + 1]]
        common = np.bincount(owner[gather(edges[:-1][mine], np.diff(edges)[mine])], minlength=n)[left]
        hit = left[(common >= least * (sizes[i] + sizes[left] - common) - 1e-9) & (label[left] != label[i])]
        if len(hit):
            label[np.isin(label, np.unique(label[hit]))] = label[i]
    # a star around the smallest name, which is the same wherever these sets meet again
    links, order = [], np.array(sorted(range(n), key=names.__getitem__))
    order = order[np.sort(np.unique(given[order], return_index=True)[1])]
    centre: dict[int, int] = {}
    for i in order.tolist():
        first = centre.setdefault(int(label[i]), i)
        if first != i:
            links.append((names[first], names[i]))
    return links


def _verified(least: float):
    """Links within the units of a stream sorted by unit; a unit may span batches."""

    def made(found):
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        unit, held = None, ([], [], [])

        def done():
            if len(held[0]) < 2:
                return []
            found = _linked(*held, least)
            for h in held:
                h.clear()
            return found

        for batch in slices(batches, "shingles", 4 << 20):
            found = []
            for u, name, label, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "fingerprint", "label", "shingles"))):
                if u != unit:
                    found += done()
                    unit = u
                    for h in held:
                        h.clear()
                held[0].append(name)
                held[1].append(label)
                held[2].append(np.frombuffer(data, np.uint64))
            yield made(found)
        yield made(done())

    return run


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component (``label``) of their fingerprint under ``links``."""
    parts = components(links).select(F.col("node").alias("fingerprint"), "component")
    return rows.join(parts, "fingerprint", "left").withColumn("label", F.coalesce("component", "fingerprint")).drop("component")


def _unsettled(chunks: DataFrame, of: str) -> DataFrame:
    """(of, i, j): pairs of an ``of``'s chunks that do not belong to one component, from rows (of, chunk, label)."""
    parts = chunks.groupBy(of, "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    parts = staged(parts, "chunks")
    other = parts.select(of, F.col("chunk").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    same = (F.col("low") == F.col("low_j")) & (F.col("high") == F.col("high_j")) & (F.col("low") == F.col("high"))
    return parts.withColumnRenamed("chunk", "i").join(other, of).filter((F.col("i") < F.col("j")) & ~same).select(of, "i", "j")


def _met(chunks: DataFrame, pairs: DataFrame, of: str) -> DataFrame:
    """The rows of both chunks of each pair, with the name of the pair as ``unit``."""
    ways = pairs.select(of, F.xxhash64(of, "i", "j").alias("unit"), F.explode(F.array("i", "j")).alias("chunk"))
    return chunks.join(ways, [of, "chunk"])


def verified(groups: DataFrame, sizes: DataFrame, sets: DataFrame, least: float, unit_size: int) -> DataFrame:
    """Links (a, b) of similarity ``least`` or more that keep the components within ``groups`` (group, fingerprint).

    A group whose sets hold more than ``unit_size`` members is dealt out in
    chunks, which are resolved by themselves first, each with the group's first
    set; chunks then meet in pairs, where they are not one component already.
    """
    check = lambda units: staged(units.join(sets, "fingerprint").select("unit", "fingerprint", "label", "shingles").repartition("unit").sortWithinPartitions("unit").mapInArrow(_verified(least), "a long, b long"), "verified")
    sized = groups.join(sizes, "fingerprint")
    total = staged(sized.groupBy("group").agg(F.sum("size").alias("n"), F.min("fingerprint").alias("first")).withColumn("chunks", F.ceil(F.col("n") / unit_size).cast("int")), "groups")
    own = F.pmod(F.xxhash64("fingerprint", "group"), F.col("chunks")).cast("int")
    leads = F.when(F.col("fingerprint") == F.col("first"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    dealt = staged(groups.join(total, "group").select("group", "chunks", "fingerprint", F.explode(leads).alias("chunk")), "dealt")
    links = check(dealt.select(F.xxhash64("group", "chunk").alias("unit"), "fingerprint", F.col("fingerprint").alias("label")))
    large = dealt.filter("chunks > 1")
    if large.limit(1).count():
        large = staged(_labelled(large.select("group", "chunk", "fingerprint"), links), "large")
        met = _met(large, _unsettled(large, "group"), "group").dropDuplicates(["unit", "fingerprint"])
        links = links.union(check(met.select("unit", "fingerprint", "label")))
    return links


def jaccard_links(docs: DataFrame, prints: DataFrame, key: str, text: str, shingle: int, least: float, chunk_rows: int = CHUNK_ROWS, unit_size: int = UNIT_SIZE) -> DataFrame:
    """(a, b): links between the distinct fingerprints of sets of similarity ``least`` or more that keep all components.

    ``prints``: the (staged) ``set_prints`` of ``docs``.
    """
    texts = _rows(docs, key, text)
    order = ["key", "size", "fingerprint"]
    sieve = lambda rows, most: staged(rows.repartition("key").sortWithinPartitions(*order).mapInArrow(_sieve(least, most), _SIEVED_DDL), "sieved")
    sieved = sieve(banded(texts, shingle, least), chunk_rows)
    candidates = sieved.filter("kind = 0").select(F.col("key").alias("a"), F.col("fingerprint").alias("b"))
    hot = sieved.filter("kind = 1")
    if hot.limit(1).count():
        hot = staged(_labelled(hot.select("key", "chunk", "fingerprint", "size", "simhash"), candidates), "hot")
        met = _met(hot, _unsettled(hot, "key"), "key").select(F.col("unit").alias("key"), "size", "fingerprint", "simhash")
        candidates = candidates.union(sieve(met, 2 * chunk_rows + 2).filter("kind = 0").select("key", "fingerprint"))
    groups = components(candidates).select(F.col("component").alias("group"), F.col("node").alias("fingerprint"))
    sizes = prints.groupBy("fingerprint").agg(F.first("size").alias("size"), F.min("row").alias("row"))
    sized = staged(groups.join(sizes, "fingerprint"), "candidates")
    sets = _sets(texts.join(staged(sized.select("row"), "asked"), "row", "left_semi"), shingle).dropDuplicates(["fingerprint"])
    return verified(sized.select("group", "fingerprint"), sized.select("fingerprint", "size"), sets, least, unit_size)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fingerprint, shingles): each row's shingle set as sorted 64-bit hashes."""

    def run(batches):
        release()
        for batch in slices(batches, "text", 2 << 20):
            hashes, offsets = sets_of(batch.column("text"), shingle)
            packed = pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_sums(hashes, offsets).view(np.int64)), packed], ["fingerprint", "shingles"])

    return texts.select("text").mapInArrow(run, "fingerprint long, shingles binary")
