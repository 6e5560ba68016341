"""A corpus pipeline of the operators in ``gridloom.llm``: identify, deduplicate, mask, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``. The first drops documents in no known language, the second all but one of each group of near
duplicates, the third masks personal data, the fourth repeats or leaves out documents to meet its sources' targets, and
the last returns ids and what they decode to. Null and empty texts are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, nearcopies, pii, ppm, queries
from gridloom.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_first(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids, text): the text is what the ids decode to."""
    path, pattern = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.pattern()
    both = bpe.round_trip(docs, path, pattern)
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("pii", mask_pii), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can't express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
