"""A training corpus from ``documents``: filter, deduplicate, redact, mix, encode.

``STAGES`` are applied in turn; each is written as Parquet and reread.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import bpe, mixing, quality_rules, registry, secret_scan, shared, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines.

    A text of a few plain lines is no worse for being short: its lines decide.
    """
    return quality_rules.keep_cleaned(docs, rules=quality_rules.LineRules(fail_short=False))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id."""
    columns = docs.columns
    marked = shared.materialise(simhash.with_fingerprints(docs, "__fp"), "marked")
    light = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__fp").alias("fp"))
    kept = simhash.group_fingerprints(light).where("doc_id <=> component_id")
    # A key without nulls, so that the join's partitions serve the window as well.
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    kept = kept.select(F.col("fp").alias("__fp"), key.alias("__id")).distinct()
    chosen = marked.withColumn("__id", key).join(kept, ["__fp", "__id"], "left_semi")
    # Repeated ids, and groups whose ids are all null, still hold several rows.
    first = W.partitionBy("__fp", "__id").orderBy(*[F.col(c) for c in columns])
    return chosen.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the sources' mix by the target weights."""
    return mixing.in_mixed_order(docs, weights=registry.TARGET_PARTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each document, with ``mix_position`` and in its order.

    Spark rereads files in an order of its own, so the schedule is computed
    again: the same rows have the same positions.
    """
    mixed = mixing.in_mixed_order(docs, keep_position=True, weights=registry.TARGET_PARTS).select("doc_id", "source", "mix_position", "text")
    return bpe.encode_documents(mixed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("secret scan", redact), ("source mix", mix_sources), ("byte-level BPE", encode)]

#: SQL can't express the fingerprints, the line rules or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the whole of ``documents``, in the mix's order."""

    def after(i: int) -> DataFrame:
        if i < 0:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        # Written and reread; what the stage before wrote is deleted then.
        return shared.settled(lambda: STAGES[i][1](spark, after(i - 1), sf_dir), f"stage{i}")

    return after(len(STAGES) - 1).orderBy("mix_position")
