"""Language-model scoring by a weighted backoff automaton (operator 7).

The model is a trigram model with Dirichlet smoothing, order by order, down to
add-one unigrams:

    p(w | u v) = (c(u v w) + k3 p(w | v)) / (c(u v) + k3)
    p(w | v)   = (c(v w) + k2 p(w)) / (c(v) + k2)
    p(w)       = (c(w) + 1) / (N + V + 1)

As an automaton (``BackoffAutomaton``): every history seen in training is a
state; an n-gram seen there is an arc from its history to the longest suffix
that is a state, with its log-probability; a failure arc leads from a history to
the next shorter one, with the log of the share k / (c(h) + k) that is left to
what was not seen.  The root has an arc for every token.  A text is read once
from left to right: a token without an arc takes failure arcs until there is one.

The model grows with the corpus and no task holds it whole.  Texts are never
shuffled: each scan task writes its documents as blocks of bounded bytes, in
which a token is a number.  A block sends the distinct n-grams of all of its
documents with their counts in its training documents, packed by ranges of their
64-bit hashes; each range is summed over all blocks, and each block gets back
the totals of its own n-grams in the order in which it sent them: the part of
the automaton that its documents can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invarium.llm.arrays import A, LOWER, codes_of, flat, gather, mixed, slices, spans, word_spans
from invarium.llm.blocks import edges_of, pack, pack_ascending, unpack, unpack_ascending
from invarium.llm.shared import shuffle_partitions, small_batches, staged
from invarium.llm.tokenizing import release

END, START = np.uint64(0x8C3B4E0F1D2A5967), np.uint64(0x51F0A9C37E6B2D84)
#: Strength of the unigram prior of bigrams, and of the bigram prior of trigrams.
PRIOR2, PRIOR3 = 100.0, 30.0
#: Text of a block, and tokens whose n-grams one task sums.
BLOCK_BYTES, PART_TOKENS = 12 << 20, 6 << 20
#: Tokens that a lane of the traversal reads; long texts have several lanes.
LANE = 256


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token (each text's words, then its end; frequent ones have small numbers, which take less room), the hashes that the numbers stand for, and each text's first token (with the total last)."""
    buf, offsets = flat(texts)
    starts, ends, first = word_spans(buf, offsets)
    codes, distinct = codes_of(spans(LOWER[buf], starts, ends))
    hashes, at = np.unique(np.array([END, *(xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist())], np.uint64), return_inverse=True)
    code = np.insert(at[1 + codes], first[1:], at[0])
    order = np.argsort(-np.bincount(code, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[code], hashes[order], first + np.arange(len(first))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and each key's number; in less room than np.unique takes."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], number


class Grams:
    """Tokens, pairs and triples of a block as numbers, and the order in which their hashes are sent.

    A text starts after START; its first token ends no triple (number -1).
    """

    def __init__(self, code: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.code, self.first, self.n = code, first, len(hashes)
        hashes = np.append(hashes, START)
        keys = np.concatenate([[self.n], code[:-1]])[: len(code)].astype(np.int64)
        keys[first[:-1]] = self.n
        keys *= self.n + 1
        keys += code
        keys, self.pair = _numbered(keys)
        before, self.pair_last = ((x).astype(np.int32) for x in divmod(keys, self.n + 1))
        self.pair_before = before
        with np.errstate(over="ignore"):
            pair_hash = mixed(mixed(hashes[before]) * A + hashes[self.pair_last])
        begins = np.zeros(len(code), bool)
        begins[first[:-1]] = True
        self.inner = np.flatnonzero(~begins).astype(np.int32)
        keys = self.pair[self.inner - 1].astype(np.int64)
        keys *= self.n + 1
        keys += code[self.inner]
        keys, at = _numbered(keys)
        self.triple_before, triple_last = ((x).astype(np.int32) for x in divmod(keys, self.n + 1))
        with np.errstate(over="ignore"):
            triple_hash = mixed(pair_hash[self.triple_before] * A + hashes[triple_last])
        self.triple = np.full(len(code), -1, np.int32)
        self.triple[self.inner] = at
        self.triple_pair = np.zeros(len(keys), np.int32)  # the pair that a triple ends with
        self.triple_pair[at] = self.pair[self.inner]
        self.hash = {1: hashes[:-1], 2: pair_hash, 3: triple_hash}
        self.order = {k: np.argsort(h).astype(np.int32) for k, h in self.hash.items()}

    def counts(self, weight: np.ndarray):
        """(order, ascending hashes, counts) of tokens, pairs and triples."""
        for kind, grams, own in ((1, self.code, weight), (2, self.pair, weight), (3, self.triple[self.inner], weight[self.inner])):
            order = self.order[kind]
            yield kind, self.hash[kind][order], np.bincount(grams, own, len(order)).astype(np.int64)[order]


def blocks_of(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, doc_ids, held_out, lengths, codes, hashes): documents of a scan task, ``block_bytes`` of text at a time; a longer text stands alone."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        release()
        made, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            code, hashes, first = tokens_of(table.column("text"))
            made += 1
            columns = [table.column("doc_id").to_pylist(), table.column("held_out").to_pylist(), np.diff(first).tolist(), pack(code, "<i4"), pack(hashes, "<u8")]
            types = [pa.list_(table.schema.field("doc_id").type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([made]), *(pa.array([c], t) for c, t in zip(columns, types))], ["block", "doc_ids", "held_out", "lengths", "codes", "hashes"])

        for batch in slices(batches, "text", min(block_bytes, 4 << 20)):
            own = len(flat(batch.column("text"))[0])
            if held and size + own > block_bytes:
                yield block()
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield block()

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, held_out array<boolean>, lengths array<int>, codes binary, hashes binary")


def _grams(lengths, codes: bytes, hashes: bytes) -> Grams:
    return Grams(unpack(codes, "<i4"), unpack(hashes, "<u8"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))


_COUNTED = "kind int, part int, block long, hashes binary, counts binary"
_TOTALLED = "kind int, part int, block long, totals binary, n_tokens long, n_distinct long"


def counted(blocks: DataFrame, parts: int) -> DataFrame:
    """(kind, part, block, hashes, counts): distinct n-grams of each block, by kind (their order) and hash range."""

    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, held, lengths, codes, hashes = (batch.column(c)[i].as_py() for c in ("block", "held_out", "lengths", "codes", "hashes"))
                rows = []
                for kind, distinct, counts in _grams(lengths, codes, hashes).counts(np.repeat(1.0 - np.array(held, float), lengths)):
                    edges = edges_of(distinct, parts)
                    for part in np.flatnonzero(np.diff(edges)):
                        own = slice(edges[part], edges[part + 1])
                        rows.append((kind, int(part), block, pack_ascending(distinct[own]), pack(counts[own], "<u8")))
                yield from pa.table(list(map(list, zip(*rows))), schema).to_batches()

    return blocks.select("block", "held_out", "lengths", "codes", "hashes").mapInArrow(count, _COUNTED)


def totalled(counts: DataFrame) -> DataFrame:
    """(kind, part, block, totals, n_tokens, n_distinct): totals of a block's n-grams in its own order; a row with block -1 has the range's sums."""

    def total(table):
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        blocks = table.column("block").to_pylist()
        grams = [unpack_ascending(x) for x in table.column("hashes").to_pylist()]
        edges = np.cumsum([0, *map(len, grams)])
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        for x, lo, hi in zip(table.column("counts").to_pylist(), edges, edges[1:]):
            totals[at[lo:hi]] += unpack(x, "<u8").astype(np.int64)  # a block sends each n-gram once
        rows = [(kind, part, b, pack(totals[at[lo:hi]], "<u8"), 0, 0) for b, lo, hi in zip(blocks, edges, edges[1:])]
        rows.append((kind, part, -1, b"", int(totals.sum()), int((totals > 0).sum())))
        return pa.table(list(map(list, zip(*rows))), pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("totals", pa.binary()), ("n_tokens", pa.int64()), ("n_distinct", pa.int64())]))

    return counts.groupBy("kind", "part").applyInArrow(total, _TOTALLED)


class BackoffAutomaton:
    """States, arcs and failure arcs that a block's texts can reach, and the traversal.

    States: 0 the root, 1 + t the history of token t, 1 + n + p the history of
    pair p, the last one START.  Arcs are numbered like the n-grams that they
    complete: the root's by token, a token's by pair, a pair's by triple; a
    block's texts know the number of each of their n-grams, so that a state
    finds its arc without a search.
    """

    def __init__(self, grams: Grams, totals, n_tokens: int, n_distinct: int, starts: int, prior2: float, prior3: float):
        """``totals(kind, ascending hashes)``: training counts of the block's n-grams."""
        self.grams, n = grams, grams.n
        c1, c2, c3 = (np.empty(len(order)) for order in grams.order.values())
        for kind, c in ((1, c1), (2, c2), (3, c3)):
            c[grams.order[kind]] = totals(kind, grams.hash[kind][grams.order[kind]])
        self.known, self.start = c1 > 0, 1 + n + len(c2)
        count = np.concatenate([[0.0], c1, c2, [float(starts)]])  # of each state's history
        prior = np.full(self.start + 1, prior2)
        prior[1 + n : self.start] = prior3
        self.fail_weight = np.log10(prior / (count + prior))
        self.fail_next = np.zeros(self.start + 1, np.int32)
        self.fail_next[1 + n : self.start] = np.where(c1[grams.pair_last] > 0, 1 + grams.pair_last, 0)
        # arcs by level of their state: root, token, pair; no arc: next state -1
        pairs = np.arange(1 + n, 1 + n + len(c2), dtype=np.int32)
        self.next = [np.where(c1 > 0, np.arange(1, 1 + n, dtype=np.int32), 0), np.where(c2 > 0, pairs, -1), np.where(c3 > 0, pairs[grams.triple_pair], -1)]
        history = np.append(c1, float(starts))[grams.pair_before]
        p1 = (c1 + 1) / (n_tokens + n_distinct + 1)
        p2 = (c2 + prior2 * p1[grams.pair_last]) / (history + prior2)
        p3 = (c3 + prior3 * p2[grams.triple_pair]) / (c2[grams.triple_before] + prior3)
        self.weight = [np.log10(p, out=p) for p in (p1, p2, p3)]

    def traverse(self) -> np.ndarray:
        """Weight of each text's path.  Lanes read their tokens side by side, each carrying its state.

        The state after two tokens does not depend on what came before them, so
        that a lane inside a text reads two tokens ahead without their weight.
        """
        first = self.grams.first
        lengths = np.diff(first)
        lanes = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), lanes)
        begin = first[:-1][text] + LANE * gather(np.zeros(len(lanes), np.int64), lanes)
        size = np.minimum(first[1:][text] - begin, LANE)
        inside = begin > first[:-1][text]
        order = np.argsort(-size, kind="stable")
        text, begin, size, inside = text[order], begin[order], size[order], inside[order]
        state = np.where(inside, 0, self.start).astype(np.int32)
        weight = np.zeros(len(text))
        for step in (2, 1):
            ahead = np.flatnonzero(inside)
            state[ahead] = self._read(state[ahead], begin[ahead] - step)[0]
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -step))
            state[:live], added = self._read(state[:live], begin[:live] + step)
            weight[:live] += added
        return np.bincount(text, weight, len(lengths))

    def _read(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the tokens ``at`` these places, and the weights of the arcs taken."""
        state, after, weight = state.copy(), np.full(len(state), -1, np.int32), np.zeros(len(state))
        levels = ((2, self.grams.triple, (state > self.grams.n) & (state < self.start)), (1, self.grams.pair, None), (0, self.grams.code, None))
        for level, arcs, own in levels:
            if own is None:
                own = (after < 0) & ((state > 0) if level else True)
            own = np.flatnonzero(own)
            arc = arcs[at[own]]
            found = self.next[level][arc]
            hit = found >= 0
            done = own[hit]
            after[done] = found[hit]
            weight[done] += self.weight[level][arc[hit]]
            failed = own[~hit]
            weight[failed] += self.fail_weight[state[failed]]
            state[failed] = self.fail_next[state[failed]]
        return after, weight


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", prior2: float = PRIOR2, prior3: float = PRIOR3, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that are not ``held_out`` (null: not held
    out) and scores all.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower
    case; each text has one end token more.  A null or empty text is its end
    alone; a text of any length is scored whole; null keys are scored like
    others, repeated rows count and are scored each; an empty table gives an
    empty table; other columns play no part.  Without training rows all counts
    are 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = staged(blocks_of(rows, block_bytes), "blocks")
    total, starts = blocks.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.sum(F.size(F.filter("held_out", lambda x: ~x)))).first()
    parts = max(shuffle_partitions(spark), -(-(total or 0) // PART_TOKENS))
    totals = staged(totalled(counted(blocks, parts)), "totals")
    sums = totals.filter("block = -1 AND kind = 1").agg(F.sum("n_tokens"), F.sum("n_distinct")).first()
    n_tokens, n_distinct = sums[0] or 0, sums[1] or 0
    out = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(table, answers):
        found = []
        given = dict(zip(zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist()), answers.column("totals").to_pylist()))

        def of(which, distinct):
            own = [unpack(given[which, int(p)], "<u8") for p in np.flatnonzero(np.diff(edges_of(distinct, parts)))]
            own = np.concatenate(own) if own else np.zeros(0, np.uint64)
            if len(own) != len(distinct):
                raise ValueError("a block's n-grams changed between two passes")
            return own

        release()
        for i in range(table.num_rows):
            lengths, codes, hashes = (table.column(c)[i].as_py() for c in ("lengths", "codes", "hashes"))
            grams = _grams(lengths, codes, hashes)
            automaton = BackoffAutomaton(grams, of, n_tokens, n_distinct, starts or 0, prior2, prior3)
            text, n = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), len(lengths)
            base = np.bincount(text, automaton.weight[0][grams.code], n)
            known = np.bincount(text[automaton.known[grams.code]], minlength=n)
            own = pa.table([pa.array(lengths, pa.int64()), pa.array(known), pa.array(base), pa.array(automaton.traverse())], schema=out)
            ids, held = (table.column(c)[i].values for c in ("doc_ids", "held_out"))
            found.append(own.add_column(0, "held_out", [held]).add_column(0, "doc_id", [ids]))
        return pa.concat_tables(found) if found else out.insert(0, pa.field("held_out", pa.bool_())).insert(0, pa.field("doc_id", table.schema.field("doc_ids").type.value_type)).empty_table()

    given = totals.filter("block >= 0").select(F.col("block").alias("at_block"), "kind", "part", "totals").groupBy("at_block")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(given).applyInArrow(score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
