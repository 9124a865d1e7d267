"""Vocabulary files applied to whole batches of texts.

Every vocabulary used here merges inside pre-split pieces: runs of letters, of
digits or of other visible characters, with at most one space before, or runs
of white space.  A text may hence be cut where two pieces are sure to meet, and
equal chunks have equal ids.  A batch encodes each distinct chunk once; the ids of the texts are
gathered with NumPy.
"""

from __future__ import annotations

import base64
import gc
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from invarium.llm.arrays import LOWER, codes_of, gather, spans

#: Chunks kept from batch to batch; beyond it, those of one batch alone are forgotten.
CACHE_CHUNKS = 700_000
#: Bytes beyond which the tiktoken library gets a text in parts.
LONG_TEXT = 1 << 16

_CUT, _BLANK, _WORD = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CUT[[10, 32, *b".,;:!?"]] = True
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def safe_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Chunk edges, at which no piece of any text is cut.

    The edges of the texts; before a plain space or a line break that follows a
    visible character; behind a single line break before a visible character;
    and before ``.,;:!?`` behind a Latin letter or a digit.
    """
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero(_CUT[buf])
    at = at[at > 0]
    here, last = buf[at], buf[at - 1]
    two, three = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    # White space beyond ASCII is C2 xx, E1 9A 80, E2 8x xx or E3 80 80: no cut behind its lead bytes.
    odd = (last >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80)))
    visible = ~_BLANK[last] & ~odd
    letter = _WORD[last] | ((two == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    white = (here == 32) | (here == 10)
    cut[at[white & visible]] = True
    cut[at[~white & letter]] = True
    line = at[(here == 10) & visible & (at + 1 < n)]
    after = buf[line + 1]
    cut[line[((after > 32) & (after < 127)) | ((after >= 0xC3) & (after <= 0xC5))] + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """``encode_many`` maps distinct chunks (str) to all their ids and how many each has; ``encode`` applies it to a batch of texts.

    ``fold``: A-Z and a-z have the same ids.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cache_chunks: int = CACHE_CHUNKS, fold: bool = False):
        self.encode_many, self.cache_chunks, self.fold = encode_many, cache_chunks, fold
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Keep what more than one batch had, the most used half of the store at most."""
        n = len(self.known)
        uses = self.uses[:n]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > self.cache_chunks // 2:
            keep = np.sort(keep[np.argsort(-uses[keep], kind="stable")[: self.cache_chunks // 2]])
        names = list(self.known)
        start, length, ids = self.start[keep], self.length[keep], self.ids
        uses = uses[keep]
        self._reset()
        self._grow(len(keep), int(length.sum()))
        m = len(keep)
        self.length[:m], self.uses[:m] = length, uses // 2
        self.start[:m] = np.cumsum(length) - length
        self.used = int(length.sum())
        self.ids[: self.used] = ids[gather(start, length)]
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}

    def _grow(self, chunks: int, ids: int) -> None:
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), ids - len(self.ids)), np.uint32)])
        if chunks > len(self.start):
            more = np.zeros(max(len(self.start), chunks - len(self.start)), np.int64)
            self.start, self.length, self.uses = (np.concatenate([x, more]) for x in (self.start, self.length, self.uses))

    def _learn(self, chunks: list[bytes]) -> None:
        for lo in range(0, len(chunks), 20_000):
            part = chunks[lo : lo + 20_000]
            values, lengths = self.encode_many([c.decode("utf-8") for c in part])
            n, m = len(self.known), len(part)
            self._grow(n + m, self.used + len(values))
            self.ids[self.used : self.used + len(values)] = values
            self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
            self.length[n : n + m] = lengths
            self.known.update(zip(part, range(n, n + m)))
            self.used += len(values)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' offsets in them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of short lists, none of them in a cycle
        try:
            return self._encode(buf, offsets)
        finally:
            if collects:
                gc.enable()

    def _encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.cache_chunks:
            self._forget()
        if self.fold:
            buf = LOWER[buf]
        cuts = safe_cuts(buf, offsets)
        codes, distinct = codes_of(spans(buf, cuts[:-1], cuts[1:]))
        chunks = distinct.to_pylist()
        known = self.known
        self._learn([c for c in chunks if c not in known])
        at = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.uses[at] += 1
        at = at[codes]
        lengths = self.length[at]
        ids = self.ids[gather(self.start[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(cuts, offsets)]


@lru_cache(maxsize=4)
def file_encoder(path: str) -> ChunkEncoder:
    """Encoder of a ``tokenizers`` JSON file, one for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text

    def encode_batch(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # Where a vocabulary makes no difference between A-Z and a-z, chunks that differ in it are one.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    samples = [letters, *letters, *(f"x{c}y" for c in letters)]
    fold = encode_batch(samples) == encode_batch([x.lower() for x in samples])
    return ChunkEncoder(JoinedChunks(encode_batch), fold=fold)


class JoinedChunks:
    """Encode many short chunks in few calls.

    Chunks that begin with a space and end with a letter are joined by a control
    character: between a letter and a space it is a piece of its own with an id
    of its own, at which the ids fall apart again.  Other chunks are encoded one
    by one, as are all where the vocabulary has no such id.
    """

    MARK, GROUP = "\x01", 400

    def __init__(self, encode_batch: Callable[[list[str]], list[list[int]]]):
        self.encode_batch = encode_batch
        alone, word, joined = encode_batch(["a" + self.MARK, " word", f" word{self.MARK} word{self.MARK} word"])
        mark = encode_batch(["a"])[0]
        mark = alone[len(mark) :] if alone[: len(mark)] == mark else []
        self.mark = mark[0] if len(mark) == 1 and joined == word + mark + word + mark + word and mark[0] not in word else None

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None:
            return self._each(chunks)
        fits = np.fromiter((c[0] == " " and c[-1].isalpha() and self.MARK not in c for c in chunks), bool, len(chunks))
        joinable, others = np.flatnonzero(fits), np.flatnonzero(~fits)
        own = [chunks[i] for i in joinable]
        parts = [np.array(ids, np.uint32) for ids in self.encode_batch([self.MARK.join(own[k : k + self.GROUP]) for k in range(0, len(own), self.GROUP)])]
        flat = np.concatenate([x for p in parts for x in (p, [np.uint32(self.mark)])]).astype(np.uint32) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(flat == self.mark)
        if len(ends) != len(own):
            raise ValueError("a chunk holds the id of the mark")
        values, each = self._each([chunks[i] for i in others])
        lengths = np.zeros(len(chunks), np.int64)
        lengths[joinable] = np.diff(ends, prepend=-1) - 1
        lengths[others] = each
        out, starts = np.zeros(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        out[gather(starts[joinable], lengths[joinable])] = flat[flat != self.mark]
        out[gather(starts[others], lengths[others])] = values
        return out, lengths

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode_batch(chunks) if chunks else []
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), lengths


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankEncoder:
    """The tiktoken library with a local rank file.

    A text beyond ``LONG_TEXT`` bytes is encoded in parts that end at safe cuts;
    where a part has none, its pieces are found by the pattern and encoded one
    by one.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        # In a rank file's pattern \s is Unicode White_Space, without the four ASCII separators that Python adds.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def _parts(self, data: np.ndarray):
        cuts = safe_cuts(data, np.array([0, len(data)]))
        start = 0
        while start < len(data):
            end = int(cuts[np.searchsorted(cuts, min(start + LONG_TEXT, len(data)), side="right") - 1])
            if end <= start:
                end = int(cuts[np.searchsorted(cuts, start, side="right")])
            yield data[start:end].tobytes().decode("utf-8")
            start = end

    def _one(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        return np.array([i for m in self.pieces.finditer(text) for i in self.encoding._encode_single_piece(m[0])], np.uint32)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the texts' offsets in them."""
        found, lengths = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            data = buf[lo:hi]
            own = [self._one(part) for part in (self._parts(data) if hi - lo > LONG_TEXT else [data.tobytes().decode("utf-8")])]
            found += own
            lengths.append(sum(map(len, own)))
        return np.concatenate(found).astype(np.uint32) if found else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> RankEncoder:
    """Encoder of a local rank file, one for each Python worker."""
    return RankEncoder(path, pattern)


@lru_cache(maxsize=4)
def rank_bytes(path: str) -> pa.Array:
    """The bytes of each id of a rank file, as an Arrow array to take from."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def release() -> None:
    """Give back what vocabularies of an earlier stage hold in this Python worker, which stages share."""
    held = [f for f in (file_encoder, rank_encoder, rank_bytes) if f.cache_info().currsize]
    for f in held:
        f.cache_clear()
    if held:
        gc.collect()
        pa.default_memory_pool().release_unused()
