"""Training-data pipeline over ``documents``: each stage is written as Parquet and read again by the next.

Every stage but the last returns the columns that it is given, in their order,
whatever else they hold and are called; ``text`` and ``doc_id`` (an integer) are
the ones it reads, ``n_chars`` follows a changed text where it is there.  An
empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invarium.llm.line_dedup import dedup_lines
from invarium.llm.packing import pack_documents
from invarium.llm.quality_rules import quality_filter
from invarium.llm.shared import staged
from invarium.llm.simhash import dedup_near
from invarium.llm.substring_dedup import dedup_substrings


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the new text."""
    chars = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return found.select(*[chars[c].alias(c) if c in chars else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model keeps.

    Null and empty texts have no words and go.  Null ids are judged like others;
    repeated rows are judged each, alike.  A posterior of exactly the threshold
    is kept.
    """
    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go.

    Rows of one id are one document, rows without an id one for each text.  A
    null text becomes empty; a text of which nothing is left stays as an empty
    one.
    """
    return _like(dedup_lines(docs, min_docs=10, least_chars=1), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, exact Jaccard similarity of 0.8 or more.

    The smallest id stays.  Rows of one id stay or go together; rows without an
    id stay.  Null texts and texts without words are alike, one of them stays.
    """
    return dedup_near(docs, shingle=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in the document with the smallest id alone.

    Null ids come last; rows of one id and text are one document and keep their
    passages.  A null text becomes empty; so may a text that is all repeated.
    """
    return _like(dedup_substrings(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, a row each.

    A null or empty text is its end token alone; null ids are packed like
    others, repeated rows each.
    """
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can express neither the label model nor similarity; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
