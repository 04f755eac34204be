"""The corpus pipeline: each stage reads what the one before it has kept, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklens.llm import decontaminate, mixing, neardup, quality, tokens
from ticklens.llm.common import stored
from ticklens.llm.queries import TOKENIZER

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
#: Shares of the tokens of each domain that are kept.
KEPT_TOKENS = {"clean": 1.0, "low": 0.5, "toxic": 0.1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score less than LEAST_QUALITY go.

    NULL and empty texts are scored like others; every row is judged by its own text, whatever its id.
    """
    return quality.good_documents(docs, _table(spark, sf_dir, "labels"), LEAST_QUALITY)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id stays, missing ids last.

    Rows that repeat an id or have none are compared like others: of several with one text, one stays. Rows without words
    are in no group and stay.
    """
    return neardup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has any passage of the benchmark go.

    A row is not judged by the text of another that repeats its id, and rows without an id are judged as well.
    """
    return decontaminate.clean_rows(docs, _table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely clean than not stay; the others are thinned towards KEPT_TOKENS.

    Without usable labels all domains are equally likely. A missing id draws like an empty one, so such rows of the
    same probabilities stay or go together.
    """
    labelled = mixing.quality_domains(_table(spark, sf_dir, "labels"))
    return mixing.thinned(docs, labelled, KEPT_TOKENS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back; rows without an id come last, an empty text has its end only."""
    return tokens.token_files(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_targets),
    ("token-ID / binary output", token_output),
]

#: Fitting models and tokenising cannot be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage_" + "".join(c if c.isalnum() else "_" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
