"""The corpus pipeline: quality rules, language ID, SimHash near-dedup, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epicohort.llm import bpe, decontaminate, langid, queries, rules, simhash
from epicohort.llm.common import fresh_name, held_out, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others keep the lines that pass."""
    return rules.clean_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a language of at least half their text go."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id."""
    return simhash.keep_one(docs, queries.SIMHASH_WORDS, queries.SIMHASH_BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its packed token ids, their number, and whether they decode to its text."""
    coded = bpe.encode_documents(docs, *queries.tokenizer(), ids="token_ids", decoded="decoded")
    ids, decoded = coded.columns[-2:]
    names = [fresh_name(docs, n) for n in ("n_tokens", "round_trip")]
    return coded.select(*docs.columns, ids, F.floor(F.octet_length(ids) / 4).cast("long").alias(names[0]),
                        (F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias(names[1]))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("byte-level BPE", tokenize)]

#: SQL has neither the mixtures nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
