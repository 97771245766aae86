"""Full-text search: postings, statistics and BM25, kept up to date by document, with a search by parts as a fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X

K1, B = 1.2, 0.75


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """token, key and the token's number in the key's columns."""
    every = reduce(lambda a, b: F.concat(a, b), [X.fts_tokens(c) for c in columns])
    return docs.select(key, F.explode(every).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def token_counts(docs: DataFrame, key: str, column: str) -> DataFrame:
    """token, its uses and the number of different keys, null not among them, whose texts hold it.

    A row counts its own tokens once, so what is grouped has the vocabulary's size. Only the rows of a repeated key are grouped by
    token and key, to take off what they count more than once.
    """
    texts = docs.select(key, X.fts_tokens(column).alias("__tokens"))
    split = texts.select(key, F.size("__tokens").alias("__n"), F.posexplode(F.concat("__tokens", F.array_distinct("__tokens"))).alias("__at", "token"))
    rows = split.select("token", (F.col("__at") < F.col("__n")).cast("long").alias("uses"), ((F.col("__at") >= F.col("__n")) & F.col(key).isNotNull()).cast("long").alias("docs"))
    repeated = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select(key)
    held = texts.join(F.broadcast(repeated), key, "left_semi").select(key, F.explode(F.array_distinct("__tokens")).alias("token"))
    surplus = held.groupBy("token", key).agg((1 - F.count(F.lit(1))).alias("docs")).select("token", F.lit(0).cast("long").alias("uses"), "docs")
    return rows.unionByName(surplus).groupBy("token").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def lengths(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy(key).agg(F.sum("tf").alias("dl"))


def refresh(index: DataFrame, changed: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Postings with those of changed and gone documents replaced."""
    touched = changed.select(key).union(gone.select(key)).distinct()
    return index.join(touched, key, "left_anti").unionByName(postings(changed, key, columns))


def bm25(docs: DataFrame, query: str, key: str, columns: list[str], k1: float = K1, b: float = B, fold: bool = True) -> DataFrame:
    """key and score of the documents that hold every token of the query; with fold, whatever the accents.

    Documents are measured where they are; all that is shuffled is one row of statistics.
    """
    words = list(dict.fromkeys(_query_tokens(query, fold)))
    every = reduce(lambda a, c: F.concat(a, c), [X.fts_tokens(c, fold) for c in columns])
    hits = lambda v: F.filter(v["tokens"], lambda t: t.isin(*words) if words else F.lit(False))
    measured = docs.select(key, F.inline(F.array(X.let(lambda v: F.struct(F.size(v["tokens"]).alias("__dl"), hits(v).alias("__hits")), tokens=every))))
    df = [F.count_if(F.array_contains("__hits", w)).alias(f"__df{i}") for i, w in enumerate(words)]
    corpus = measured.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__dl").alias("__avg"), *df)
    full = measured.filter(F.size(F.array_distinct("__hits")) == len(words)) if words else measured.limit(0)
    score = F.lit(0.0)
    for i, w in enumerate(words):
        n, tf = F.col(f"__df{i}"), F.size("__hits") - F.size(F.array_remove("__hits", w))
        idf = F.greatest(F.log((F.col("__docs") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))
    return full.crossJoin(F.broadcast(corpus)).select(key, score.alias("score"))  # one row


def _query_tokens(query: str, fold: bool = True) -> list[str]:
    import re

    folded = query.lower().translate(str.maketrans(X.ACCENTED, X.PLAIN) if fold else {})
    return [t for w in folded.split() if len(w) > 1 for t in re.findall(r"[^\W_]+", w)]


def contains_all(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Documents in which every word of more than two characters stands in one of the columns."""
    words = list(filter(lambda part: len(part) >= 3, query.lower().split()))
    test = reduce(lambda a, b: a & b, [reduce(lambda x, y: x | y, [F.lower(X.text(c)).contains(w) for c in columns]) for w in words], F.lit(bool(words)))
    return docs.filter(test)


def search(docs: DataFrame, query: str, key: str, columns: list[str], limit: int, category: str | None = None, category_col: str = "category", places: int | None = None, fold: bool = True) -> DataFrame:
    """The best documents by BM25, of a category unless that is general; a query without a token goes by parts of words.

    With places, scores are rounded before they rank; the key decides between equal ones.
    """
    scope = docs.filter(F.col(category_col) == category) if category and category != "general" else docs
    if not _query_tokens(query, fold):
        return contains_all(docs, query, columns).select(key, F.lit(0.0).alias("score")).orderBy(key).limit(limit)
    found = bm25(scope, query, key, columns, fold=fold)
    if places is not None:
        found = found.withColumn("score", F.round("score", places))
    return found.orderBy(F.desc("score"), key).limit(limit)
