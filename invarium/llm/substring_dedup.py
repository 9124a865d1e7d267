"""Substring dedup by paragraph MinHash banding (operator 9).

A paragraph is what stands between two content-defined edges: the word pairs
whose hash is the least among ``REACH`` pairs to either side (some nine words
apart, five at least).  An edge depends on the words around it alone, so that a
passage falls into the same paragraphs wherever it is quoted, however its lines
are broken, but for what lies before its first and after its last edge.

Bands: the whole paragraph (equal paragraphs collide surely) and one minimum
each of as many hash functions over its five-word shingles as the target recall
needs (``bands_for``).  Colliding paragraphs are verified by the exact Jaccard
similarity of their shingles and clustered by connected components.  The first
occurrence of a cluster, by document id, owns it.

Others are repeats.  A run of them grows word by word for as long as the words
before it (after it) are those before (after) its first (last) paragraph's
owner; runs at most ``BRIDGE`` words apart are one; and runs of ``min_words``
words or more go.  The owner's own words are never removed on account of a later
occurrence, so that one copy always stays.

Documents are dealt out in blocks of bounded bytes.  A block sends each of its
distinct paragraphs once, so that a passage in a third of all documents is one
entry a block, and gets back who owns it; texts never meet in one task by what
they share.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import A, LOWER, codes_of, flat, mixed, spans, word_spans
from invarium.llm.blocks import bucketed, edges_of, pack, pack_ascending, unpack, unpack_ascending
from invarium.llm.components import components
from invarium.llm.jaccard import UNIT_SIZE, verified
from invarium.llm.shared import fresh, shuffle_partitions, small_batches, staged
from invarium.llm.tokenizing import release

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.99
#: An edge has the least hash among so many pairs to either side; longer paragraphs without one are cut every ``LONGEST`` words.
REACH, LONGEST = 4, 64
#: Words that a run needs to be removed, and other words that it may go on after.
MIN_WORDS, BRIDGE = 30, 2
#: Words of an owner's neighbourhood that repeats see; a longer common stretch has an edge, hence a paragraph, of its own (999 times in 1000).
CONTEXT = 24
#: Text of a block, and of the paragraphs that one task compares.
BLOCK_BYTES = 24 << 20
_NONE = np.int64((1 << 63) - 1)


def bands_for(similarity: float, recall: float) -> int:
    """Bands of one minimum so that a pair of that similarity collides with probability ``recall`` or more."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity) - 1e-9))


BANDS = bands_for(SIMILARITY, RECALL)
#: Two sets of similarity 0.8 differ only where the smaller has four shingles.
NEAR_WORDS = math.ceil(SIMILARITY / (1 - SIMILARITY) - 1e-9) + SHINGLE - 1


class Paragraphs:
    """Paragraphs of a batch of texts: word ranges, their document, number there, and hash of the whole."""

    def __init__(self, texts):
        self.buf, self.offsets = flat(texts)
        self.starts, self.ends, self.first = word_spans(self.buf, self.offsets)
        codes, distinct = codes_of(spans(LOWER[self.buf], self.starts, self.ends))
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()], np.uint64)
        self.words = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
        edge = self._edges()
        self.hi = edge
        self.lo = np.concatenate([[0], self.hi[:-1]]).astype(np.int64)[: len(self.hi)]
        self.n_words = self.hi - self.lo
        self.document = np.searchsorted(self.first, self.lo, side="right") - 1
        begin = np.searchsorted(self.document, np.arange(len(self.offsets) - 1))
        self.number = np.arange(len(self.lo)) - begin[self.document] if len(self.lo) else np.zeros(0, np.int64)
        self.begin = np.append(begin, len(self.lo))
        self.whole = self._whole()
        self.eligible = self.n_words >= SHINGLE

    def _edges(self) -> np.ndarray:
        """Ends of the paragraphs, as word numbers."""
        n = len(self.words)
        if not n:
            return np.zeros(0, np.int64)
        pair = mixed(self.words[1:] * A + self.words[:-1])
        between = np.unique(self.first[1:-1])
        between = between[(between > 0) & (between < n)]
        most = np.uint64((1 << 64) - 1)
        pair[between - 1] = most
        least = pair < most
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[:-1]
        for k in range(1, min(REACH, len(pair) - 1) + 1):
            apart = text[k:] != text[:-k]
            least[k:] &= (pair[k:] < pair[:-k]) | apart
            least[:-k] &= (pair[:-k] <= pair[k:]) | apart
        least[between - 1] = True
        ends = np.append(np.flatnonzero(least) + 1, n)
        begins = np.concatenate([[0], ends[:-1]])
        long = ends - begins > 2 * LONGEST
        cuts = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        return np.sort(np.concatenate([ends, *cuts])) if cuts else ends

    def context(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short hashes of the ``CONTEXT`` words before and after the paragraphs, the nearest first; zero beyond the document."""
        short = np.append(np.maximum(self.words >> np.uint64(48), np.uint64(1)).astype("<u2"), np.uint16(0))
        lo, hi = self.first[self.document[which]], self.first[self.document[which] + 1]
        step = np.arange(CONTEXT)
        before, after = self.lo[which, None] - 1 - step, self.hi[which, None] + step
        return short[np.where(before >= lo[:, None], before, -1)], short[np.where(after < hi[:, None], after, -1)]

    def _whole(self) -> np.ndarray:
        """Hash of each paragraph's words in order."""
        if not len(self.lo):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.words)) - np.repeat(self.lo, self.n_words)
        with np.errstate(over="ignore"):
            placed = mixed(self.words + mixed(place.astype(np.uint64) * A + np.uint64(1)))
            return mixed(np.add.reduceat(placed, self.lo) + self.n_words.astype(np.uint64) * A)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the five-word shingles of the (eligible) paragraphs ``which``, and their offsets."""
        counts = self.n_words[which] - SHINGLE + 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.lo[which] - offsets[:-1], counts) + np.arange(offsets[-1])
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(at), np.uint64)
            for k in range(SHINGLE):
                rolled = rolled * A + self.words[at + k]
        return mixed(rolled), offsets

    def minima(self, which: np.ndarray) -> list[np.ndarray]:
        """One minimum for each hash function; functions differ, so that no two bands mix."""
        hashes, offsets = self.shingles(which)
        if not len(which):
            return [np.zeros(0, np.uint64)] * BANDS
        with np.errstate(over="ignore"):
            return [mixed(np.minimum.reduceat(mixed(hashes ^ s), offsets[:-1]) + s) for s in mixed(np.arange(1, BANDS + 1, dtype=np.uint64))]


def _ids(column) -> np.ndarray:
    return column.fill_null(int(_NONE)).to_numpy()


def _least(keys: list[np.ndarray], document: np.ndarray, number: np.ndarray):
    """The first paragraph of each distinct key: positions, ascending by key, and whether the key has others."""
    order = np.lexsort((number, document, *reversed(keys)))
    new = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:] if len(order) > 1 else new[1:]
    first = np.flatnonzero(new)
    d, n = document[order], number[order]
    differs = np.zeros(len(order), np.int64)
    group = np.cumsum(new) - 1
    differs[:] = (d != d[first][group]) | (n != n[first][group])
    return order[first], np.add.reduceat(differs, first) > 0 if len(first) else np.zeros(0, bool)


_SENT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("near", pa.int32()), ("keys", pa.binary()), ("wholes", pa.binary()), ("documents", pa.binary()), ("numbers", pa.binary()), ("more", pa.binary())])
_FOUND = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("whole", pa.int64()), ("document", pa.int64()), ("number", pa.int64()), ("first", pa.bool_()), ("needs", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _exact_keys(p: Paragraphs, ids: np.ndarray):
    at = np.flatnonzero(p.eligible)
    document, number = ids[p.document[at]], p.number[at]
    first, more = _least([p.whole[at]], document, number)
    return at[first], document[first], number[first], more


def sent(blocks: DataFrame, parts: int) -> DataFrame:
    """Each block's distinct paragraphs and minima, packed by hash range."""

    def send(table):
        release()
        block, rows = table.column("block")[0].as_py(), []
        p, ids = Paragraphs(table.column("text")), _ids(table.column("doc_id"))
        at, document, number, more = _exact_keys(p, ids)
        sets = [(0, p.whole[at], p.whole[at], document, number, more)]
        near = np.flatnonzero(p.n_words[at] >= NEAR_WORDS)
        minima = p.minima(at[near])
        keys, wholes = np.concatenate(minima), np.tile(p.whole[at[near]], BANDS)
        order = np.lexsort((wholes, keys))
        sets.append((1, keys[order], wholes[order], np.tile(document[near], BANDS)[order], np.tile(number[near], BANDS)[order], np.zeros(len(order), bool)))
        for kind, keys, wholes, document, number, more in sets:
            edges = edges_of(keys, parts)
            for part in np.flatnonzero(np.diff(edges)):
                own = slice(edges[part], edges[part + 1])
                rows.append((int(part), block, kind, pack_ascending(keys[own]), pack(wholes[own], "<u8") if kind else b"", pack(document[own], "<i8"), pack(number[own], "<i4"), pack(more[own], "<u1")))
        return _rows(rows, _SENT)

    return blocks.select("block", "doc_id", "text").groupBy("block").applyInArrow(send, _ddl(_SENT))


def found(packed: DataFrame) -> DataFrame:
    """Rows of paragraphs that occur twice and, with ``key``, of minima that different paragraphs share.

    (block, whole, document, number, first, needs) of the former name the owner;
    ``first``: it is this block's own; ``needs``: the block has others.
    """

    def find(table):
        rows = []
        blocks = table.column("block").to_numpy()
        kinds = table.column("near").to_numpy()
        columns = {c: table.column(c).to_pylist() for c in ("keys", "wholes", "documents", "numbers", "more")}
        for kind in (0, 1):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            keys = [unpack_ascending(columns["keys"][i]) for i in own]
            sizes = np.array([len(k) for k in keys])
            keys, document, number = np.concatenate(keys), np.concatenate([unpack(columns["documents"][i], "<i8") for i in own]), np.concatenate([unpack(columns["numbers"][i], "<i4") for i in own]).astype(np.int64)
            block = np.repeat(blocks[own], sizes)
            distinct, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
            if kind:
                wholes = np.concatenate([unpack(columns["wholes"][i], "<u8") for i in own])
                shared = np.flatnonzero(counts[at] > 1)
                shared = shared[np.lexsort((wholes[shared], at[shared]))]
                new = np.ones(len(shared), bool)
                new[1:] = (at[shared][1:] != at[shared][:-1]) | (wholes[shared][1:] != wholes[shared][:-1])
                several = np.bincount(at[shared][new], minlength=len(distinct))
                shared = shared[several[at[shared]] > 1]
                rows.append((block[shared], keys[shared].view(np.int64), wholes[shared].view(np.int64), document[shared], number[shared], np.zeros(len(shared), bool), np.zeros(len(shared), bool)))
                continue
            more = np.concatenate([unpack(columns["more"][i], "<u1") for i in own]).astype(bool)
            order = np.lexsort((number, document, at))
            head = order[np.searchsorted(at[order], np.arange(len(distinct)))]
            repeated = np.zeros(len(distinct), bool)
            repeated[at[more]] = True
            repeated[at[(document != document[head][at]) | (number != number[head][at])]] = True
            hit = np.flatnonzero(repeated[at])
            owner = head[at[hit]]
            first = hit == owner
            rows.append((block[hit], None, keys[hit].view(np.int64), document[owner], number[owner], first, ~first | more[hit]))
        tables = [pa.table([pa.nulls(len(r[0]), f.type) if c is None else pa.array(c, f.type) for c, f in zip(r, _FOUND)], schema=_FOUND) for r in rows]
        return pa.concat_tables(tables) if tables else _rows([], _FOUND)

    return packed.groupBy("part").applyInArrow(find, _ddl(_FOUND))


def published(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(whole, shingles, before, after) of the asked occurrences (whole, block, near): shingles where ``near``, and the words around."""
    schema = pa.schema([("whole", pa.int64()), ("shingles", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])

    def publish(table, wanted):
        if not wanted.num_rows or not table.num_rows:
            return _rows([], schema)
        p, ids = Paragraphs(table.column("text")), _ids(table.column("doc_id"))
        wholes = wanted.column("whole").to_numpy().view(np.uint64)
        order = np.argsort(wholes)
        wholes, near = wholes[order], wanted.column("near").to_numpy(zero_copy_only=False)[order]
        at = np.flatnonzero(p.eligible & np.isin(p.whole, wholes))
        at = at[_least([p.whole[at]], ids[p.document[at]], p.number[at])[0]]
        near = near[np.searchsorted(wholes, p.whole[at])]
        sets = np.full(len(at), None, object)
        hashes, offsets = p.shingles(at[near])
        for i, a, b in zip(np.flatnonzero(near), offsets[:-1], offsets[1:]):
            sets[i] = np.unique(hashes[a:b]).tobytes()
        before, after = ([x.tobytes() for x in c] for c in p.context(at))
        return pa.table([pa.array(p.whole[at].view(np.int64)), pa.array(sets.tolist(), pa.binary()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], schema=schema)

    ask = asked.select("whole", F.col("block").alias("at_block"), "near")
    return staged(blocks.select("block", "doc_id", "text").groupBy("block").cogroup(ask.groupBy("at_block")).applyInArrow(publish, _ddl(schema)), "published")


def near_owners(candidates: DataFrame, asked: DataFrame, published: DataFrame, unit_size: int = UNIT_SIZE) -> DataFrame:
    """(whole, document, number, owner): who owns every paragraph in a cluster of similar ones, and the owner's own hash.

    ``candidates``: (key, whole) of paragraphs that share a minimum; ``asked``:
    the first occurrence (whole, document, number) of each.
    """
    sets = published.filter("shingles IS NOT NULL").select(F.col("whole").alias("fingerprint"), "shingles")
    groups = staged(candidates.select(F.col("key").alias("group"), F.col("whole").alias("fingerprint")).distinct(), "colliding")
    sizes = sets.select("fingerprint", (F.octet_length("shingles") / 8).cast("long").alias("size"))
    parts = components(verified(groups, sizes, sets, SIMILARITY, unit_size))
    placed = staged(parts.join(asked, parts.node == asked.whole).select("whole", "component", "document", "number"), "near")
    owner = staged(placed.groupBy("component").agg(F.min(F.struct("document", "number", "whole")).alias("owner")), "near-owners")
    return placed.join(owner, "component").select("whole", "owner.document", "owner.number", F.col("owner.whole").alias("owner"))


def grown(p: Paragraphs, flags: np.ndarray, equal: np.ndarray, around: np.ndarray, before: np.ndarray, after: np.ndarray, i: int, least: int) -> list[tuple[int, int]]:
    """Word ranges of document ``i`` to be removed: runs of repeats (flag 1), grown as far as their owners' neighbours agree.

    ``around``: the row of ``before`` and ``after`` that tells each paragraph's
    owner's neighbours.  A paragraph that is only similar to its owner may be cut
    elsewhere than this, so that the outermost equal one (``equal``) is asked too.
    """
    lo, hi, first, end = int(p.begin[i]), int(p.begin[i + 1]), int(p.first[i]), int(p.first[i + 1])
    short = np.maximum(p.words[first:end] >> np.uint64(48), np.uint64(1)).astype("<u2")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags[lo:hi], [0]]))) + lo
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        same = np.flatnonzero(equal[a:b]) + a
        start, stop = int(p.lo[a]), int(p.hi[b - 1])
        for k in {a, *same[:1].tolist()}:
            at = int(p.lo[k]) - first
            own = short[max(0, at - CONTEXT) : at][::-1]
            start = min(start, first + at - int(np.argmin(np.append(own == before[around[k]][: len(own)], False))))
        for k in {b - 1, *same[-1:].tolist()}:
            at = int(p.hi[k]) - first
            own = short[at : at + CONTEXT]
            stop = max(stop, first + at + int(np.argmin(np.append(own == after[around[k]][: len(own)], False))))
        if out and start - out[-1][1] <= BRIDGE:
            out[-1] = (min(start, out[-1][0]), max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return [(a, b) for a, b in out if b - a >= least]


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the byte ranges ``cuts``; a line of which nothing is left goes with its break."""
    out, at, line_start = [], 0, 0
    for line in text.split(b"\n"):
        line_end = line_start + len(line)
        pieces, begin, touched = [], line_start, False
        while at < len(cuts) and cuts[at][0] < line_end:
            a, b = cuts[at]
            touched = True
            pieces.append(text[begin : max(begin, a)])
            begin = min(b, line_end)
            if b > line_end:
                cuts = [*cuts[:at], (line_end + 1, b), *cuts[at + 1 :]]
                break
            at += 1
        if not touched:
            out.append(line)
        else:
            pieces.append(text[begin:line_end])
            kept = b" ".join(x for x in (y.strip(b" \t\r\x0b\x0c") for y in pieces) if x)
            if kept:
                out.append(kept)
        line_start = line_end + 1
    return b"\n".join(out)


def _applied(blocks: DataFrame, given: DataFrame, min_words: int) -> DataFrame:
    """The blocks' rows without their repeated passages."""
    keep = [c for c in blocks.columns if c not in ("block", "text")]

    def apply(table, answers):
        p, ids = Paragraphs(table.column("text")), _ids(table.column("doc_id"))
        wholes = np.unique(p.whole[p.eligible])
        own = np.flatnonzero(p.eligible)
        index, document, number = np.searchsorted(wholes, p.whole[own]), ids[p.document[own]], p.number[own]
        hit = np.searchsorted(wholes, answers.column("whole").to_numpy().view(np.uint64))
        near = answers.column("near").to_numpy(zero_copy_only=False)
        owner, place = answers.column("document").to_numpy(), answers.column("number").to_numpy()

        def answered(which):
            """The answer's row for each paragraph, and whether it names another than this one."""
            row = np.full(len(wholes), -1)
            row[hit[which]] = np.flatnonzero(which)
            row = row[index]
            return row, (row >= 0) & ((owner[row] != document) | (place[row] != number)) if len(owner) else row >= 0

        equal_row, equal = answered(~near)
        near_row, alike = answered(near)
        before, after = (np.frombuffer(b"".join(answers.column(c).to_pylist()), "<u2").reshape(-1, CONTEXT) for c in ("before", "after"))
        flags, told, same = np.zeros(len(p.lo), np.int8), np.full(len(p.lo), -1), np.zeros(len(p.lo), bool)
        flags[own] = np.where(near_row >= 0, alike, equal)
        told[own], same[own] = np.where(equal, equal_row, near_row), equal
        texts, removed, cut = table.column("text").to_pylist(), [0] * table.num_rows, [[] for _ in range(table.num_rows)]
        for i in np.unique(p.document[flags == 1]).tolist():
            words = grown(p, flags, same, told, before, after, i, min_words)
            if words:
                spans_of = [(int(p.starts[a] - p.offsets[i]), int(p.ends[b - 1] - p.offsets[i])) for a, b in words]
                removed[i] = sum(b - a for a, b in words)
                texts[i] = without(texts[i].encode(), spans_of).decode()
                cut[i] = [x for s in spans_of for x in s]
        arrays = [table.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(cut, pa.list_(pa.int64()))]
        return pa.table(arrays, [*keep, "text", "n_removed", "spans"])

    kinds = dict(blocks.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + ["text string", "n_removed long", "spans array<long>"])
    asked = given.withColumnRenamed("block", "at_block")
    return blocks.groupBy("block").cogroup(asked.groupBy("at_block")).applyInArrow(apply, schema)


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``text`` without repeated passages, and two more columns: ``__n_removed_words`` and ``__spans`` (bytes [start, end) of the old text).

    The document with the smallest integer key keeps a passage (keys of other
    types are ordered by their hash); null keys come last, rows that share a key
    and a text are one document.  Null and empty texts become empty; a text of
    any length is one document, compared as a whole; other columns pass through,
    and where they have one of the new names the new column gets an underscore
    more in front; an empty table gives an empty table.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    whole_number = docs.select(F.col(f"`{key}`")).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    ident = F.col(f"`{key}`").cast("long") if whole_number else F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`").cast("string")))
    rows = docs.select(ident.alias("doc_id"), body.alias("text"), *columns)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // (2 * block_bytes)))
    n = max(2 * shuffle_partitions(spark), -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int"))
    with bucketed(rows, n) as table:
        answers = staged(found(sent(table, parts)), "answers")
        equal, alike = answers.filter("key IS NULL"), answers.filter("key IS NOT NULL")
        first = staged(alike.groupBy("whole").agg(F.min(F.struct("document", "number", "block")).alias("at")).select("whole", "at.document", "at.number", "at.block"), "candidates")
        asked = equal.filter("first").select("whole", "block", F.lit(False).alias("near")).union(first.select("whole", "block", F.lit(True)))
        told = published(table, asked.groupBy("whole", "block").agg(F.max("near").alias("near")))
        near = staged(near_owners(alike, first, told), "near-named")
        around = told.select(F.col("whole").alias("owner"), "before", "after").dropDuplicates(["owner"])
        given = equal.filter("needs").select("block", "whole", "document", "number", F.col("whole").alias("owner"), F.lit(False).alias("near"))
        given = given.union(alike.select("block", "whole").distinct().join(near, "whole").select("block", "whole", "document", "number", "owner", F.lit(True)))
        out = staged(_applied(table, given.join(around, "owner").select("block", "whole", "document", "number", "near", "before", "after"), min_words), "without-repeats")
    back = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text}
    more = [F.col("n_removed").alias(fresh(docs, "__n_removed_words")), F.col("spans").alias(fresh(docs, "__spans"))]
    return out.select(*[F.col("text").alias(c) if c == text else F.col(back[c]).alias(c) for c in docs.columns], *more)
