"""From raw documents to packed training sequences, in five stages.

Every stage takes the columns of ``documents`` in any order with whatever columns there are beside them, and all but the last return them
unchanged. Null texts count as empty: the base rules reject them in the first stage, and a later stage by itself would keep them. An empty
table stays empty. The tables beside the documents may be empty, too: without labels only the base rules reject, without a benchmark
nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import decontamination, near_copies, packing, pii, quality_rules
from twinframe.llm.common import stage_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff of their language (null: one of its own) go; rows that repeat are judged each for itself."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard of 0.8 or more) the document with the least id stays, and one of rows that repeat it.

    Texts without words are copies of each other. Rows with a null id stay only if no named row has their shingles, one of each set.
    """
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts until none is left; null ids, null texts and clean texts stay as they are."""
    return decontamination.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; null texts stay null."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are tokenised and packed into sequences of 2048; rows that repeat or have a null id are packed each for itself."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", dedup), ("decontamination", decontaminate), ("personal data", personal_data), ("packing", pack)]
#: Shingle sets, exact binomial cutoffs and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
