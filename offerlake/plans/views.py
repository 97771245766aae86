"""The engine's views over the driver's tables, in Spark and in the SQL of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators.offers import SOURCES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as offers: id, title, url, brand, category, price, source, image."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://shop"), key % 7, F.lit(".example.com/product/"), key).alias("url"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (key % 4 + 1).cast("int")).alias("source"), F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("i"), key)).alias("image"),
    )


OFFERS = """offers AS (
  SELECT p_partkey AS id, p_name AS title, 'https://shop' || (p_partkey % 7) || '.example.com/product/' || p_partkey AS url, p_brand AS brand, p_type AS category,
    p_retailprice AS price, p_size AS size, ['wildberries', 'ozon', 'yandex_market', 'runet'][p_partkey % 4 + 1] AS source,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'i' || p_partkey END AS image FROM part)"""

SYNONYMS = [("widget", "gadget", 0.9, 0), ("widget", "device", 0.7, 1), ("bolt", "screw", 0.8, 2), ("ring", "loop", 0.6, 3), ("blue", "azure", 0.5, 4), ("gadget", "widget", 0.4, 5), ("red", "scarlet", 0.9, 6)]


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "term string, synonym string, weight double, ordinal int")


SYNONYMS_SQL = "synonyms(term, synonym, weight, ordinal) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST({w} AS DOUBLE), {o})" for a, b, w, o in SYNONYMS) + ")"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


WORDS = "words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)"


def typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a part's name with its second character doubled."""
    return words(spark, sf_dir).select(F.concat(F.substring("word", 1, 2), F.substring("word", 2, 99)).alias("word"))


TYPOS = "typos AS (SELECT substr(word, 1, 2) || substr(word, 2) AS word FROM words)"
