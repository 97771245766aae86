"""Query expansion by weighted synonyms: tables in, ranked terms, boolean queries and combinations out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import text as X

VARIANTS, COMBINATIONS = 10, 100


def bidirectional(synonyms: DataFrame) -> DataFrame:
    """(term, synonym, weight) with every pair the other way round, where that isn't given already."""
    swapped = synonyms.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"), "weight")
    new = swapped.join(synonyms.select("term", "synonym"), ["term", "synonym"], "left_anti").groupBy("term", "synonym").agg(F.max("weight").alias("weight"))
    return synonyms.select("term", "synonym", "weight").unionByName(new)


def reverse_index(synonyms: DataFrame) -> DataFrame:
    """synonym and its term; of several the last by ordinal."""
    return synonyms.groupBy("synonym").agg(F.max_by("term", "ordinal").alias("term"))


def add_pairs(synonyms: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs added or given a new weight, both ways."""
    both = new.select("term", "synonym", "weight").unionByName(new.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"), "weight")).dropDuplicates(["term", "synonym"])
    return synonyms.select("term", "synonym", "weight").join(both, ["term", "synonym"], "left_anti").unionByName(both)


def remove_pairs(synonyms: DataFrame, gone: DataFrame) -> DataFrame:
    both = gone.select("term", "synonym").union(gone.select("synonym", "term")).distinct()
    return synonyms.join(both, ["term", "synonym"], "left_anti")


def weighted(words: DataFrame, synonyms: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """word, target and the greatest weight by the word or its lemma; the word itself stands first with 1."""
    keys = words.select("word", F.col("word").alias("term"))
    if lemmas is not None:
        keys = keys.unionByName(words.join(lemmas, words["word"] == lemmas["form"]).select("word", F.col("lemma").alias("term"))).distinct()
    found = keys.join(synonyms, "term").select("word", F.col("synonym").alias("target"), "weight")
    every = found.filter("target != word").unionByName(words.select("word", F.col("word").alias("target"), F.lit(1.0).alias("weight")))
    best = every.groupBy("word", "target").agg(F.max("weight").alias("weight"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy((F.col("target") != F.col("word")).cast("int"), F.desc("weight"), "target")))


def phrases(queries: DataFrame, phrase_table: DataFrame, query: str = "query") -> DataFrame:
    """Phrases of the table that stand in a query between other characters; longer ones first, none within a longer one.

    The table of phrases is small by its nature; it is broadcast by Spark where its size allows, and scanned where not.
    """
    q = F.lower(F.col(query))
    padded = F.concat(F.lit(" "), F.regexp_replace(q, r"(?U)[^\p{L}\p{N}]+", " "), F.lit(" "))
    hit = queries.select(query, padded.alias("__p")).join(phrase_table, F.expr("contains(__p, concat(' ', lower(phrase), ' '))"))
    order = Window.partitionBy(query).orderBy(F.desc(F.length("phrase")), "phrase").rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.collect_list("phrase").over(order), F.array().cast("array<string>"))
    marked = hit.withColumn("__longer", longer)
    return marked.filter(~F.exists("__longer", lambda p: F.concat(F.lit(" "), p, F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))).select(query, "phrase")


def combinations(groups: Column, most: int = COMBINATIONS) -> Column:
    """The first combinations of one of each group, the last group turning fastest; by index, without a cross join.

    groups: array of arrays; an empty group leaves none.
    """
    sizes = F.transform(groups, lambda g: F.size(g).cast("long"))
    total = F.aggregate(sizes, F.lit(1).cast("long"), lambda a, n: F.least(a * n, F.lit(1 << 40)))
    steps = F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, i + 2, F.greatest(F.size(sizes) - i - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, m: F.least(a * m, F.lit(1 << 40))))
    one = lambda k: F.array_join(F.transform(groups, lambda g, i: F.get(g, ((k / F.get(steps, i)).cast("long") % F.size(g)).cast("int"))), " ")
    indices = F.sequence(F.lit(0).cast("long"), F.least(total, F.lit(most)) - 1)
    return F.when((F.size(groups) == 0) | (total == 0), F.array().cast("array<string>")).otherwise(F.transform(indices, one))


def expand(queries: DataFrame, synonyms: DataFrame, stop_words: Sequence[str] = (), most: int = COMBINATIONS, query: str = "query") -> DataFrame:
    """queries with ``groups`` (each word's targets), ``boolean_query`` and ``variants``."""
    keyed = queries.select(query).distinct().withColumn("__words", X.expander_tokens(query, stop_words))
    words = keyed.select(query, F.posexplode("__words").alias("at", "word"))
    targets = weighted(words.select("word").distinct(), synonyms)
    listed = targets.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda t: t["target"]).alias("targets"))
    grouped = words.join(listed, "word").groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "targets"))), lambda g: g["targets"]).alias("groups"))
    ready = grouped.withColumn("boolean_query", boolean_query(F.col("groups"))).withColumn("variants", combinations(F.col("groups"), most))
    empty = F.array().cast("array<string>")
    return queries.join(ready, query, "left").withColumn("boolean_query", F.coalesce("boolean_query", F.lit(""))).withColumn("variants", F.coalesce("variants", empty))


def boolean_query(groups: Column) -> Column:
    quoted = lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
    either = F.transform(groups, lambda g: F.when(F.size(g) > 1, F.concat(F.lit("("), F.array_join(F.transform(g, quoted), " OR "), F.lit(")"))).otherwise(F.array_join(F.transform(g, quoted), "")))
    return F.array_join(either, " AND ")


def as_elastic(groups: Column) -> Column:
    """The query in the JSON form of common search servers: every group, any of its terms."""
    must = F.transform(groups, lambda g: F.struct(F.struct(F.transform(g, lambda t: F.struct(F.struct(t.alias("text")).alias("match"))).alias("should")).alias("bool")))
    return F.to_json(F.struct(F.struct(F.struct(must.alias("must")).alias("bool")).alias("query")))


def as_like(groups: Column, column: str) -> Column:
    """A condition in SQL text; quotes, percent signs and underscores in terms are taken as they are."""
    escaped = lambda t: F.regexp_replace(F.replace(t, F.lit("'"), F.lit("''")), "([%_!])", "!$1")
    one = lambda t: F.concat(F.lit(f"{column} LIKE '%"), escaped(t), F.lit("%' ESCAPE '!'"))
    return F.array_join(F.transform(groups, lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, one), " OR "), F.lit(")"))), " AND ")


def matches(groups: Sequence[Sequence[str]], column: Column) -> Column:
    """The same condition as a Column."""
    return reduce(lambda a, b: a & b, [X.any_of(F.lower(column), [t.lower() for t in g]) for g in groups], F.lit(True))


def query_variants(queries: DataFrame, synonyms: DataFrame, query: str = "query", most: int = VARIANTS) -> DataFrame:
    """queries with ``search_variants`` (itself first, then replacements by ordinal) and ``used_synonyms``.

    A term that stands in the query is replaced by each of its synonyms and the other way round. Synonym tables are
    dimensions: Spark broadcasts them by their size, or scans where they are too large.
    """
    base = queries.select(query).distinct()
    there = base.join(synonyms, F.expr(f"contains({query}, term)")).select(query, "ordinal", F.lit(0).alias("way"), F.col("term").alias("a"), F.col("synonym").alias("b"))
    back = base.join(synonyms, F.expr(f"contains({query}, synonym)")).select(query, "ordinal", F.lit(1).alias("way"), F.col("synonym").alias("a"), F.col("term").alias("b"))
    found = there.unionByName(back).withColumn("new", X.squeeze(F.replace(F.col(query), F.col("a"), F.col("b"))))
    listed = found.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "way", "new"))), lambda v: v["new"]).alias("__new"), F.array_sort(F.collect_set(F.when(F.col("way") == 0, F.col("b")))).alias("used_synonyms"))
    none = F.array().cast("array<string>")
    every = F.concat(F.array(F.col(query)), F.coalesce("__new", none), tire_variants(F.col(query)))
    out = queries.join(listed, query, "left").withColumn("search_variants", F.slice(F.array_distinct(F.filter(every, lambda v: v != "")), 1, most))
    return out.withColumn("used_synonyms", F.coalesce("used_synonyms", none)).drop("__new")


def tire_variants(q: Column) -> Column:
    w, h, r = (F.regexp_extract(q, "(?i)([0-9]{3})/([0-9]{2}) R([0-9]{2})", k) for k in (1, 2, 3))
    forms = F.array(F.concat(F.lit("шины "), w, F.lit("/"), h, F.lit(" R"), r), F.concat_ws(" ", w, h, r, F.lit("шины")), F.concat(w, F.lit("-"), h, F.lit("-r"), r, F.lit(" покрышки")))
    return F.when(w != "", forms).otherwise(F.array().cast("array<string>"))


def suggest(terms: DataFrame, part: str, most: int = 8) -> DataFrame:
    """Terms that contain the part, the first by ordinal."""
    return terms.filter(F.lower("term").contains(part.lower())).orderBy("ordinal").limit(most)


def statistics(synonyms: DataFrame) -> DataFrame:
    return synonyms.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("pairs"), F.round(F.avg("weight"), 4).alias("mean_weight"), F.count_if(F.col("term").contains(" ")).alias("phrases"))


def most_common(log: DataFrame, column: str, most: int = 10, first: str | None = None) -> DataFrame:
    """The commonest values; of equals the first seen, or the least."""
    out = log.groupBy(column).agg(F.count(F.lit(1)).alias("uses"), F.min(first or column).alias("first_seen"))
    return out.orderBy(F.desc("uses"), "first_seen", column).limit(most).select(column, "uses")
