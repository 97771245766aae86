"""Offers: canonical rows, scoring, top k of each source, groups and price summaries, merging and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import markup, numbers, similarity, urls
from offerlake.functions import text as texts

SOURCES = tuple("wildberries ozon yandex_market runet".split())
FLOOR, MOST = 0.03, 30


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MOST, limit or 10))


def canonical(offers: DataFrame) -> DataFrame:
    """mainImage stands first in images, and the first image is mainImage where that is empty."""
    main, images = texts.text("mainImage"), F.coalesce("images", F.array().cast("array<string>"))
    images = F.when((main != "") & ~F.array_contains(images, main), F.array_prepend(images, main)).otherwise(images)
    return offers.withColumn("images", images).withColumn("mainImage", F.coalesce(F.nullif(main, F.lit("")), F.get(F.col("images"), F.lit(0)), F.lit("")))


def wire(offers: DataFrame) -> DataFrame:
    """The row with the names that older clients read."""
    aliases = {"name": "title", "link": "url", "image": "mainImage", "seller_name": "seller", "reviews": "reviewsCount", "old_price": "oldPrice", "score": "relevanceScore"}
    have = set(offers.columns)
    out = offers.withColumns({k: F.col(v) for k, v in aliases.items() if v in have and k not in have})
    ids = [F.nullif(F.col(c), F.lit("")) for c in ("productId", "sku") if c in have]
    return out.withColumn("id", F.coalesce(*ids, F.lit(""))) if ids else out


def body(columns: list[Column]) -> Column:
    return texts.clean_text(F.concat_ws(" ", *columns))


def scored(offers: DataFrame, query: str | Column, text_columns: list[Column], checks: list[Column]) -> DataFrame:
    """offers with relevance and completeness, through a generator, so that filters and sorts on them don't make them anew."""
    q = F.lit(query) if isinstance(query, str) else query
    scores = F.struct(similarity.relevance(q, F.col("title"), body(text_columns)).alias("relevance"), similarity.completeness(checks).alias("completeness"))
    return offers.select("*", F.inline(F.array(scores)))


def admitted(offers: DataFrame, query: str) -> DataFrame:
    """Rows with a title and URL; for queries of more than three characters only those above the floor."""
    kept = offers.filter((texts.text("title") != "") & (texts.text("url") != ""))
    return kept.filter(F.col("relevance") >= FLOOR) if len(query) > 3 else kept


def order(*tie: str | Column) -> list[Column]:
    price = F.coalesce(F.nullif(F.col("price"), F.lit(0.0)), F.lit(1e12))
    return [F.desc("relevance"), F.desc("completeness"), price.asc(), *[F.col(t).asc() if isinstance(t, str) else t for t in tie]]


def top_per_source(offers: DataFrame, limit: int, *tie: str) -> DataFrame:
    """The best rows of each source; Spark limits each partition's groups before it shuffles."""
    return offers.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(*order(*tie)))).filter(F.col("place") <= limit)


def source_groups(offers: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """Every source in its order, with its number of rows and status; a source without rows is empty unless it says otherwise."""
    spark = offers.sparkSession
    dimension = F.broadcast(spark.createDataFrame([(i, s) for i, s in enumerate(SOURCES)], "ordinal int, source string"))
    counted = offers.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(numbers.present(F.col("price"))).alias("lo"), F.max(numbers.present(F.col("price"))).alias("hi"))
    out = dimension.join(counted, "source", "left")
    if statuses is not None:
        out = out.join(statuses.select("source", F.col("status").alias("said")), "source", "left")
    else:
        out = out.withColumn("said", F.lit("ok"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, F.when(F.col("said").isin("empty") | F.col("said").isNull(), "ok").otherwise(F.col("said"))).otherwise(F.when(F.coalesce("said", F.lit("ok")) == "ok", "empty").otherwise(F.col("said")))
    return out.select("ordinal", "source", n.cast("bigint").alias("n"), status.alias("status"), F.coalesce("lo", F.lit(0.0)).alias("min_price"), F.coalesce("hi", F.lit(0.0)).alias("max_price"))


def price_summary(offers: DataFrame) -> DataFrame:
    """Rows, least, greatest and mean price, of prices that aren't 0, and sources, over all; 0 where there is no price."""
    price = numbers.present(F.col("price"))
    return offers.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.min(price), F.lit(0.0)).alias("min_price"), F.coalesce(F.max(price), F.lit(0.0)).alias("max_price"),
        F.coalesce(F.round(F.avg(price), 4), F.lit(0.0)).alias("avg_price"), F.count_distinct("source").alias("sources"),
    )


def grouped_items(offers: DataFrame, fields: list[str]) -> DataFrame:
    """One row a source with its items in order of place."""
    return offers.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("items"))


def merge_detail(summary: DataFrame, detail: DataFrame, key: str, maps: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows of summary with what detail knows better: its values where they aren't empty, unions of maps and lists."""
    d = detail.select(*[F.col(c).alias(c if c == key else f"__{c}") for c in detail.columns])
    joined, out = summary.join(d, key, "left"), []
    for c in summary.columns:
        other = F.col(f"__{c}")
        if c == key or c not in detail.columns:
            out.append(F.col(c))
        elif c in maps:
            out.append(markup.last_wins(F.col(c), other).alias(c))
        elif c in lists:
            none = F.array().cast("array<string>")
            out.append(F.array_distinct(F.concat(F.coalesce(F.col(c), none), F.coalesce(other, none))).alias(c))
        else:
            kind = dict(detail.dtypes)[c]
            empty = F.lit("") if kind == "string" else F.lit(0).cast(kind)
            out.append(F.coalesce(F.nullif(other, empty), F.col(c)).alias(c))
    return joined.select(*out)


def keep_first(rows: DataFrame, key: Column | list[Column], by: list[Column]) -> DataFrame:
    keys = key if isinstance(key, list) else [key]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__n = 1").drop("__n")


def dedup_by_url(rows: DataFrame, by: list[Column], source: str | None = None) -> DataFrame:
    return keep_first(rows, [urls.dedup_key("url"), *([F.col(source)] if source else [])], by)


def dedup_entities(rows: DataFrame, by: list[Column]) -> DataFrame:
    """First by URL; then, among those left, by title, whole price and source."""
    once = dedup_by_url(rows, by)
    return keep_first(once, [F.substring(texts.normalize_title("title"), 1, 100), F.col("price").cast("bigint"), F.col("source")], by)


def index_admission(rows: DataFrame) -> DataFrame:
    title = texts.text("title")
    kept = rows.filter((title != "") & (texts.text("url") != "") & (F.length(title) >= 4) & (F.col("price").isNull() | F.col("price").between(10, 10_000_000)))
    out = kept.withColumn("title", F.substring("title", 1, 500))
    return out.withColumn("description", F.substring("description", 1, 1000)) if "description" in rows.columns else out


def rank_items(items: DataFrame, query: str, by: list[Column]) -> DataFrame:
    """Junk and category pages out, entities once, scored by words and quality, best first."""
    kept = items.filter((F.length(texts.text("title")) >= 4) & (texts.text("url") != "") & ~urls.category_page("url"))
    once = dedup_entities(kept, by)
    n_specs = F.greatest(F.size("characteristics"), F.lit(0))
    quality = similarity.rank_quality(F.col("price"), texts.text("image") != "", n_specs, F.col("title"))
    full = texts.item_text("title", F.col("characteristics"))
    return once.withColumn("score", similarity.rank_score(F.lit(query), full, quality)).withColumn("explanation", similarity.rank_explanation(F.lit(query), full, F.col("price"), n_specs)).orderBy(F.desc("score"), *by)


def excluded(rows: DataFrame, domains: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Rows whose domain neither is, nor is below, an excluded one: by all its own endings, so it is an equi-join."""
    parts = F.split(F.col(domain_col), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    gone = rows.select(domain_col).distinct().withColumn("__ending", F.explode(endings)).join(domains.select(F.col("domain").alias("__ending")), "__ending").select(domain_col).distinct()
    return rows.join(gone, domain_col, "left_anti")


def first_variant(results: DataFrame, keys: list[str], variant: str = "variant") -> DataFrame:
    """Rows of the first variant of a query that gave any, of each key."""
    return results.withColumn("__least", F.min(variant).over(Window.partitionBy(*keys))).filter(F.col(variant) == F.col("__least")).drop("__least")


def quota(rows: DataFrame, key: str, most: int, by: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("__n") <= most).drop("__n")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All rows of the sources, in their order by ordinal."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("ordinal", F.lit(i)) for i, p in enumerate(parts)])
