"""Content-addressed store of token ids (operator 4).

A store is a folder of Parquet tables:

``data/kind=0``  chunks: ``key`` (BLAKE2b-128 of the payload) and ``payload``
(little-endian ids, 16 bits each where the vocabulary allows it, else 32);
every distinct chunk once.

``recipes``  one row a document in ascending doc_id order: ``pack`` and ``seq``
(place in that order), ``doc_id``, ``n_tokens``, ``local_start`` (ids before it
in its pack), ``hashes`` and ``lens`` of its chunks, ``root`` (Merkle root of
the hashes).

``manifest``  one row a pack: ``n_docs``, ``n_tokens``, ``base`` (ids of all
packs before it) and ``root`` (Merkle root of its documents' roots).

Chunks end where a rolling hash of the last 16 ids has nine leading zero bits
(512 ids on average, 64 at least, 4096 at most), so equal passages meet in equal
chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from invarium.llm.arrays import flat, slices
from invarium.llm.shared import scratch_path, shuffle_partitions, small_batches
from invarium.llm.tokenizing import file_encoder

WINDOW, ZERO_BITS, LEAST, MOST = 16, 9, 64, 4096
#: Documents of a group of the Merkle tree, as a power of two.
GROUP_BITS = 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: zlib's polynomial, reflected
_CRC_POLY = np.uint32(0xEDB88320)


def _mix(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last ``WINDOW`` ids asks for a cut."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        back = np.full(len(ids), _STEP_BACK)
        back[0] = 1
        prefix = np.cumsum(_mix(ids) * np.cumprod(back))
        window = prefix[WINDOW - 1 :].copy()
        window[1:] -= prefix[:-WINDOW]
        forth = np.full(len(window), _STEP)
        forth[0] = 1
        rolled = window * np.cumprod(forth)
    return np.flatnonzero(rolled >> np.uint64(64 - ZERO_BITS) == 0) + WINDOW


def chunk_ends(n: int, cuts: list[int]) -> list[int]:
    """Chunk ends of a document of ``n`` ids; ``cuts``: its cut points, ascending."""
    ends, start = [], 0
    for cut in [*cuts, n]:
        while cut - start > MOST:
            start += MOST
            ends.append(start)
        if cut - start >= LEAST and cut < n:
            ends.append(cut)
            start = cut
    ends.append(n)
    return ends


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(nodes: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is."""
    nodes = [digest(b"\x00" + x) for x in nodes] or [digest(b"")]
    while len(nodes) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = pairs + nodes[2 * len(pairs) :]
    return nodes[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2), modulo the CRC's."""
    out, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _CRC_POLY, np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """x^(32 n) for each chunk length n, by doubling."""
    table = np.array([1 << 31], np.uint32)
    step = table
    for _ in range(32):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), _CRC_POLY, np.uint32(0))
    while len(table) <= MOST:
        table = np.concatenate([table, _times(np.broadcast_to(step, table.shape), table)])
        step = _times(step, step)
    return table[: MOST + 1]


def joined_crc32(crcs: np.ndarray, lens: np.ndarray, offsets: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC-32 of each document's ids, from those of its chunks in order."""
    out, counts = np.zeros(len(offsets) - 1, np.uint32), np.diff(offsets)
    for k in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > k)
        at = offsets[own] + k
        out[own] = _times(shifts[lens[at]], out[own]) ^ crcs[at]
    return out


def _empty(n: int, kind: pa.DataType) -> pa.Array:
    return pa.nulls(n, kind)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", text: str = "text", id_bits: int = 16) -> None:
    """Encode every whole text, append ``end_id`` and write the store below ``path``.

    A null or empty text is stored as its end id, a null key comes first, a
    repeated row is a document of its own whose chunks are stored already, an
    empty table gives empty tables; other columns play no part.  ``id_bits``:
    16 or 32, checked against the ids.  One shuffle moves each distinct chunk
    of a task once; texts are not shuffled.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dtype = {16: "<u2", 32: "<u4"}[id_bits]

    def encode(batches):
        encoder = file_encoder(tokenizer)
        seen: set[bytes] = set()
        row = TaskContext.get().partitionId() << 33
        names = ["kind", "key", "doc_id", "n_tokens", "root", "hashes", "lens", "payload"]
        for batch in slices(batches, "text", 4 << 20):
            ids, offsets = encoder.encode(*flat(batch.column("text")))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            if len(ids) and int(ids.max()) >> id_bits:
                raise ValueError(f"ids need more than {id_bits} bits")
            cuts, data = cut_points(ids), ids.astype(dtype)
            split = np.searchsorted(cuts, offsets, side="right")
            hashes, lens, roots, new_keys, new_data = [], [], [], [], []
            for d in range(batch.num_rows):
                lo, hi = int(offsets[d]), int(offsets[d + 1])
                own, begin = [], 0
                ends = chunk_ends(hi - lo, [c for c in (cuts[split[d] : split[d + 1]] - lo).tolist() if c < hi - lo])
                for end in ends:
                    chunk = data[lo + begin : lo + end].tobytes()
                    own.append(name := digest(chunk))
                    if name not in seen:
                        seen.add(name)
                        new_keys.append(name)
                        new_data.append(chunk)
                    begin = end
                hashes.append(own)
                lens.append(np.diff([0, *ends]).tolist())
                roots.append(merkle(own))
            n, m = batch.num_rows, len(new_keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([1] * n, pa.int32()), pa.array([(row + d).to_bytes(16, "big") for d in range(n)], pa.binary()), batch.column("doc_id"), pa.array(np.diff(offsets)),
                    pa.array(roots, pa.binary()), pa.array(hashes, pa.list_(pa.binary())), pa.array(lens, pa.list_(pa.int32())), _empty(n, pa.binary()),
                ],
                names,
            )
            row += n
            if m:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * m, pa.int32()), pa.array(new_keys, pa.binary()), _empty(m, batch.column("doc_id").type), _empty(m, pa.int64()),
                        _empty(m, pa.binary()), _empty(m, pa.list_(pa.binary())), _empty(m, pa.list_(pa.int32())), pa.array(new_data, pa.binary()),
                    ],
                    names,
                )

    schema = f"kind int, key binary, doc_id {kind}, n_tokens long, root binary, hashes array<binary>, lens array<int>, payload binary"
    encoded = rows.mapInArrow(encode, schema).repartition("kind", "key").dropDuplicates(["kind", "key"])
    encoded.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")

    whole = T._parse_datatype_string(schema)
    recipes = spark.read.schema(whole).parquet(f"{path}/data").filter("kind = 1").select("key", "doc_id", "n_tokens", "root", "hashes", "lens")

    def number(batches):
        pack, seq, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = start + np.cumsum(n)
            arrays = [pa.array(np.full(len(n), pack, np.int32)), pa.array(np.arange(seq, seq + len(n))), pa.array(ends - n)]
            seq, start = seq + len(n), int(ends[-1]) if len(n) else start
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[1:]], ["pack", "seq", "local_start", *batch.schema.names[1:]])

    ordered = recipes.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    numbered = ordered.mapInArrow(number, f"pack int, seq long, local_start long, doc_id {kind}, n_tokens long, root binary, hashes array<binary>, lens array<int>")
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    packs = _pack_roots(spark.read.schema(numbered.schema).parquet(f"{path}/recipes").select("pack", "seq", "n_tokens", "root")).orderBy("pack").collect()  # a row a partition
    base, out = 0, []
    for p in packs:
        out.append((p.pack, p.n_docs, p.n_tokens, base, bytes(p.root)))
        base += p.n_tokens
    spark.createDataFrame(out, "pack int, n_docs long, n_tokens long, base long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


def _pack_roots(recipes: DataFrame) -> DataFrame:
    """Merkle root of each pack: of groups of 2^``GROUP_BITS`` documents, in order, so that no task folds a whole pack's."""
    folded = F.udf(lambda nodes: merkle([bytes(x) for x in nodes]), "binary")
    part = F.shiftright("seq", GROUP_BITS)
    groups = recipes.groupBy("pack", part.alias("part")).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "root"))).alias("nodes"))
    groups = groups.select("pack", "part", "n_docs", "n_tokens", folded(F.col("nodes.root")).alias("root"))
    packs = groups.groupBy("pack").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "root"))).alias("nodes"))
    return packs.select("pack", "n_docs", "n_tokens", folded(F.col("nodes.root")).alias("root"))


class TokenStore:
    """Reader of a store written by ``write_store``."""

    def __init__(self, spark: SparkSession, path: str, id_bits: int = 16):
        self.spark, self.path, self.dtype = spark, path, {16: "<u2", 32: "<u4"}[id_bits]

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("kind int, key binary, payload binary").parquet(f"{self.path}/data").filter("kind = 0").select("key", "payload")

    def recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def _references(self) -> DataFrame:
        return self.recipes().select("pack", "seq", F.posexplode("hashes").alias("pos", "key"))

    def read_ids(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids): every document's payloads in order, little-endian."""
        parts = self._references().join(self.chunks(), "key").groupBy("pack", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
        ids = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["payload"])), ""))  # in one go, not one chunk after the other
        return self._placed(parts.select("pack", "seq", ids.alias("ids")), "ids")

    def read_digests(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) read back and verified.

        Every stored payload is hashed again and must have its name; a
        document's CRC-32 is joined from those of its chunks, so that no
        payload is shuffled; lengths and Merkle roots of documents and packs
        must be those of recipes and manifest, or the query fails.
        """
        dtype = self.dtype

        def read(batches):
            import zlib

            for batch in batches:
                keys, crcs, lens = batch.column("key").to_pylist(), [], []
                for name, payload in zip(keys, batch.column("payload").to_pylist()):
                    if digest(payload) != name:
                        raise ValueError(f"chunk {name.hex()} is damaged")
                    ids = np.frombuffer(payload, dtype)
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    lens.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64()), pa.array(lens, pa.int32())], ["key", "crc", "len"])

        def fold(batches):
            shifts = _shifts()
            for batch in batches:
                parts = batch.column("parts")
                offsets, inner = parts.offsets.to_numpy(), parts.values
                offsets, lo, hi = offsets - offsets[0], int(offsets[0]), int(offsets[-1])
                key, crc, length = (inner.field(k).slice(lo, hi - lo) for k in ("key", "crc", "len"))
                lens = length.to_numpy().astype(np.int64)
                crcs = joined_crc32(crc.to_numpy().astype(np.uint32), lens, offsets, shifts)
                names = key.to_pylist()
                roots = [merkle(names[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                total = np.add.reduceat(np.append(lens, 0), offsets[:-1]) if len(lens) else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("pack"), batch.column("seq"), pa.array(crcs.astype(np.int64)), pa.array(total), pa.array(roots, pa.binary())], ["pack", "seq", "ids_crc32", "read_tokens", "read_root"])

        found = self.chunks().mapInArrow(read, "key binary, crc long, len int")
        parts = self._references().join(found, "key").groupBy("pack", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "crc", "len"))).alias("parts"))
        folded = parts.mapInArrow(fold, "pack int, seq long, ids_crc32 long, read_tokens long, read_root binary")
        damaged = self.manifest().join(_pack_roots(self.recipes().select("pack", "seq", "n_tokens", "root")).select("pack", F.col("root").alias("read_root")), "pack", "left").filter("NOT (root <=> read_root)").count()
        if damaged:
            raise ValueError(f"{damaged} packs differ from the manifest")
        return self._placed(folded, "ids_crc32", F.col("read_tokens") == F.col("n_tokens"), F.col("read_root") == F.col("root"))

    def _placed(self, found: DataFrame, column: str, *must) -> DataFrame:
        base = self.manifest().select("pack", "base")  # a row a partition
        rows = self.recipes().select("pack", "seq", "local_start", "doc_id", "n_tokens", "root").join(found, ["pack", "seq"], "left").join(F.broadcast(base), "pack")
        holds = F.col(column).isNotNull()
        for m in must:
            holds = holds & m
        value = F.when(holds, F.col(column)).otherwise(F.raise_error(F.lit("a document differs from its recipe")))
        return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", value.alias(column))


def stored(docs: DataFrame, tokenizer: str, end_id: int) -> TokenStore:
    """Write a store to the shared folder and open it."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, end_id, path)
    return TokenStore(docs.sparkSession, path)
