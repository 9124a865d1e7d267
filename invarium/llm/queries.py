"""The thin ``opN_<name>`` queries: whole tables, production parameters, contract columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invarium.llm.byte_bpe import bpe_decode, bpe_encode
from invarium.llm.language_model import score_documents
from invarium.llm.line_dedup import dedup_lines
from invarium.llm.neighbours import nearest
from invarium.llm.packing import pack_documents
from invarium.llm.quality_classifier import site_quality
from invarium.llm.quality_rules import fit_label_model, judged, measured
from invarium.llm.shared import staged
from invarium.llm.simhash import fingerprint, near_duplicates
from invarium.llm.substring_dedup import dedup_substrings
from invarium.llm.token_store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2).read_digests()



def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = staged(measured(table(spark, sf_dir, "documents"), ["doc_id"]), "measures")
    return judged(measures, fit_label_model(measures)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )



def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprint(table(spark, sf_dir, "documents"), shingle=3, seed=42))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__n_removed_words").alias("n_removed_words"), F.col("__spans").alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, least_chars=1)
    return lines.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_byte_bpe, op3_neighbours, op4_token_store, op5_quality_rules, op6_quality_classifier, op7_language_model, op8_simhash, op9_substring_dedup, op10_line_dedup)}
SQL: dict[str, str] = {
    "op10_line_dedup": """
WITH d0 AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM d0
), k AS (
  SELECT r, doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(d.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE d.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN d ON k.key = d.key
GROUP BY k.r""",
}
