"""A corpus pipeline: bad documents go, one of each group of near copies stays, test items go, sources are mixed, tokens are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wherewhen.llm.common import settled, table
from wherewhen.llm.decontamination import decontaminate
from wherewhen.llm.jaccard_join import keep_one
from wherewhen.llm.mixing import mix_sources
from wherewhen.llm.quality_classifier import keep_good
from wherewhen.llm.token_files import token_files


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier finds good."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that 5-word shingles with a similarity of 0.75 or more link."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' mixed weights have them read."""
    return mix_sources(docs, entropy_ratio=0.95, max_repeats=4.0, keep=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens stand in the token files."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_files", tokens),
]

#: Kneser-Ney models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
