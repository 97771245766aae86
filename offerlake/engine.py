"""What a caller uses: search, spelling and expansion over tables, without a server."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators import expand, offers, spell


@dataclass
class Search:
    """Search over a table of offers (title, url, price, source, ...)."""

    table: DataFrame
    text_columns: tuple[str, ...] = ("title",)
    key: str = "url"

    def __call__(self, query: str, category: str = "", limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Best offers of each source, the sources' groups and the price summary. The query has two characters at least."""
        if len((query or "").strip()) < 2:
            raise ValueError("a query has two characters at least")
        rows = self.table.filter(F.col("category") == category) if category else self.table
        checks = [X.text(c) != "" for c, t in rows.dtypes if t == "string"] + [F.col("price") > 0]
        found = offers.scored(rows, query.lower().strip(), [F.col(c) for c in self.text_columns], checks)
        top = offers.top_per_source(offers.admitted(found, query), offers.clamp_limit(limit), self.key)
        return top, offers.source_groups(top), offers.price_summary(top)

    def health(self) -> DataFrame:
        return self.table.groupBy("source").agg(F.count(F.lit(1)).alias("items"))


@dataclass
class Speller:
    """Correction against a dictionary (word)."""

    dictionary: DataFrame
    max_distance: float = spell.MAX_DISTANCE
    #: Adds ``suggested`` to a table of texts, null where it has nothing to say; it goes before the dictionary.
    model: Callable[[DataFrame], DataFrame] | None = None

    def correct(self, texts: DataFrame) -> DataFrame:
        if self.model is None:
            return spell.correct(texts, self.dictionary, self.max_distance)
        own = self.model(texts).withColumn("__source", X.text("text")).withColumn("text", F.coalesce("suggested", "text"))
        done = spell.correct(own, self.dictionary, self.max_distance)
        return done.withColumn("text", F.col("__source")).withColumn("was_corrected", F.col("corrected") != F.col("__source")).drop("__source", "suggested")

    def topk(self, words: DataFrame, k: int = 5) -> DataFrame:
        return spell.topk_texts(words, self.dictionary, max(1, min(10, k)), self.max_distance)

    def evaluate(self, dataset: DataFrame, by: list[str] | None = None) -> DataFrame:
        """dataset: typo, expected. Quality overall or by columns."""
        done = self.correct(dataset.withColumn("text", F.col("typo")))
        return spell.metrics(done, "typo", "corrected", "expected", by)


def suggest(terms: DataFrame, part: str) -> DataFrame:
    return expand.suggest(terms, part)
