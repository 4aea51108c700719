"""The corpus pipeline: STAGES in order, each applied to all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm import byte_bpe, common, mixing, near_dedup, pii, toxicity

#: Near copies share at least this percentage of their five-word shingles.
SIMILAR = 80
#: The mixture's token shares by language. No document's rate falls below 1: this mixing repeats, it doesn't drop.
LANGUAGES = {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id. Rows without a doc_id stay."""
    groups = near_dedup.near_dedup(docs, SIMILAR)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents recur by rates of 1 or more that bring the languages' tokens to their targets."""
    labelled = mixing.labelled_domains(docs, common.table(spark, sf_dir, "labels"))
    rates, _ = mixing.mix(docs, labelled, LANGUAGES, list(LANGUAGES), least=1.0)
    return mixing.resample(docs, rates)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of each row."""
    return byte_bpe.digests(docs)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("byte_bpe", bpe_stage)]

#: SQL can't express the stages' models; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
