"""From documents to a training mix, in stages; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcover.llm import decontaminate, jaccard, language, mixing, toxicity
from gridcover.llm.common import free_name, materialize, table

#: A document whose language has less than this posterior is rejected, as is one without any letter.
LEAST_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with at least LEAST_LANGUAGE_SCORE."""
    pred, score = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    found = language.identify(docs, language.learn_from(docs), pred_col=pred, score_col=score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of the operator."""
    score = free_name(docs, "_toxicity")
    machine = toxicity.learn_from(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine, score_col=score).where(F.col(score) < toxicity.TOXIC).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that are inside occurrences of benchmark windows."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mix_sources),
]

#: The learned stages can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
