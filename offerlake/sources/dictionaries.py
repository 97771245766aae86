"""Dictionaries, synonyms, settings and exports."""

from __future__ import annotations

from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators import expand, spell

DEFAULTS = {
    "spell": {"max_levenshtein": 5, "band": 3, "top_grams": 50, "phonetic": "combined"},
    "hybrid": {"cutoff": 82.0, "min_length": 4},
    "expander": {"max_combinations": 100, "format": "boolean"},
    "dictionary": {"reload_seconds": 300},
}


def config(overrides: dict | None = None) -> dict:
    """Settings by section: a section of overrides is merged into the defaults' one, key by key, and no deeper."""
    out = deepcopy(DEFAULTS)
    for section, values in (overrides or {}).items():
        if isinstance(values, dict):
            out.setdefault(section, {}).update(values)
        else:
            out[section] = values
    return out


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spell.dictionary(spark.read.text(path), "value")


def write_dictionary(words: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One word a line, in order over all files."""
    words.select("word").orderBy("word").write.mode(mode).text(path)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(term, synonym, weight, ordinal) of JSON objects whose values are lists of words, lists of {word, weight} or {word: weight}."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "value"))
    value = F.trim("value")
    listed = F.from_json(value, "array<string>")
    weighted = F.transform(F.map_entries(F.from_json(value, "map<string,double>")), lambda e: F.struct(e["key"].alias("synonym"), e["value"].alias("weight")))
    from_list = F.transform(
        listed,
        lambda x: F.when(F.ltrim(x).startswith("{"), F.struct(F.get_json_object(x, "$.word").alias("synonym"), F.coalesce(F.get_json_object(x, "$.weight").cast("double"), F.lit(1.0)).alias("weight"))).otherwise(
            F.struct(x.alias("synonym"), F.lit(1.0).alias("weight"))
        ),
    )
    entries = F.when(value.startswith("["), from_list).otherwise(weighted)
    return pairs.select(F.lower("term").alias("term"), F.posexplode(entries).alias("ordinal", "e")).select("term", F.lower("e.synonym").alias("synonym"), "e.weight", "ordinal").filter("synonym is not null")


def read_synonyms_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a term and any number of synonyms."""
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(c)))
    rows = spark.read.text(path).select(cells.alias("c")).filter("size(c) > 1 and c[0] != ''")
    return rows.select(F.get("c", F.lit(0)).alias("term"), F.posexplode(F.filter(F.slice("c", 2, F.size("c")), lambda s: s != "")).alias("ordinal", "synonym")).withColumn("weight", F.lit(1.0))


def write_synonyms(synonyms: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON object a term, its synonyms by weight."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("synonym").alias("word"), "weight")))
    out = synonyms.groupBy("term").agg(listed.alias("s")).select("term", F.transform("s", lambda e: F.struct(e["word"].alias("word"), e["weight"].alias("weight"))).alias("synonyms"))
    out.write.mode(mode).json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """(original, corrected, expected) as JSON lines."""
    rows.select("original", "corrected", "expected").write.mode("append").json(path)


def exported(expanded: DataFrame, how: str, column: str = "title") -> DataFrame:
    """expand()'s groups as ``boolean``, ``elastic``, ``like`` or ``list``."""
    forms = {"boolean": expand.boolean_query, "elastic": expand.as_elastic, "like": lambda g: expand.as_like(g, column), "list": lambda g: F.array_join(F.array_distinct(F.flatten(g)), ", ")}
    if how not in forms:
        raise ValueError(f"unknown form {how!r}")
    return expanded.withColumn("exported", forms[how](F.col("groups")))
