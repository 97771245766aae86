"""The queries of the training-data operators, each over its whole table, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlake.llm import arcfiles, decontaminate, licenses, linededup, packing, quality, recurrent, simhash, syncmers, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer anchors of every document."""
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


@query("op4_line_dedup", linededup.SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the repeats of earlier lines removed."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest match of every document with every benchmark item it overlaps."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has a near duplicate, with its group."""
    return simhash.groups(_table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2,048 words."""
    return packing.pack(_table(spark, sf_dir, "documents"), cut_long=True)


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public 50k byte-level BPE."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


@query("op10_licenses", licenses.sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license wording in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query("op1_arc_to_warc", arcfiles.SQL)
def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, put into ARC archives and converted into WARC records."""
    return arcfiles.to_warc(arcfiles.archive(_table(spark, sf_dir, "pages")))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that neither rule ensemble rejects, with their chances of low quality and of toxicity."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.keep(documents, _table(spark, sf_dir, "labels")).select("doc_id", "low_quality", "toxicity")


@query("op8_language_model")
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document under a recurrent network trained on all of them."""
    return recurrent.language_model(_table(spark, sf_dir, "documents"))
