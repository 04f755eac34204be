"""The registered query of each operator: (session, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.llm import (
    decontaminate,
    fingerprints,
    fixity,
    html_main,
    katz,
    licenses,
    mixing,
    neardup,
    periodic,
    quality,
    resample,
    secrets,
    tokens,
)
from ticklens.session import new_dir

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Target shares of the tokens by domain.
MIX = {"clean": 0.92, "low": 0.07, "toxic": 0.01}

_queries: dict[str, Query] = {}


def _register(query: Query) -> Query:
    _queries[query.__name__] = query
    return query


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scores = quality.quality_scores(docs, labels)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_register
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(_table(spark, sf_dir, "documents"))


@_register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


@_register
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@_register
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = new_dir(spark, "secret_ledger")
    secrets.create_ledger(spark, ledger)
    return secrets.secret_report(_table(spark, sf_dir, "documents"), ledger)


@_register
def op6_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return mixing.document_rates(docs, mixing.quality_domains(labels), MIX)


@_register
def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_table(spark, sf_dir, "documents"), TOKENIZER)


@_register
def op8_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which some pages are altered and some are lost."""
    pages = _table(spark, sf_dir, "pages")
    digit = F.crc32(F.col("page_id").cast("string"))
    altered = F.when(F.pmod(digit, F.lit(97)) == 0, F.concat("html", F.lit("?"))).otherwise(F.col("html"))
    replica = pages.where(F.pmod(digit, F.lit(193)) != 0).withColumn("html", altered)
    return fixity.audit(pages, replica)


@_register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark).drop("items")


@_register
def op10_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"))


@_register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(_table(spark, sf_dir, "documents"))


@_register
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return resample.resample(docs, benchmark).drop("n_words")


@_register
def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(_table(spark, sf_dir, "pages"))
