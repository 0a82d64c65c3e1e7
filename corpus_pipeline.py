"""A corpus pipeline of five operators: quality, near duplicates, secrets, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._shared import stage, unstage
from gridloom.llm.gam_quality import quality_model, score_quality
from gridloom.llm.mixing import apply_mix
from gridloom.llm.prob_minhash import drop_near_duplicates
from gridloom.llm.queries import word_vocabulary
from gridloom.llm.rank_bpe import bpe_digest, tokenizer_spec
from gridloom.llm.secret_scan import redact

#: Documents with a lower score are rejected.
KEEP_FROM = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, learned from the folder's labels, doesn't reject."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = max([*docs.columns, "score"], key=len) + "_"  # a name that no column has
    return score_quality(docs, model, keep_from=KEEP_FROM, out=score).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return bpe_digest(docs, tokenizer_spec(word_vocabulary()))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written, read again by the next and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "staged_path"):
            unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
