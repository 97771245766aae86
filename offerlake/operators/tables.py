"""Tables that live on: upserts, health, crawls, quotas and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import markup, urls


def upsert(table: DataFrame, changes: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """The latest row of each key, of the table and its changes together."""
    return latest(table.unionByName(changes, allowMissingColumns=True), key, by)


def latest(rows: DataFrame, key: str, by: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("__n = 1").drop("__n")


def health(log: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Each source's last status, latency and number of items."""
    last = F.max_by(F.struct("status", "latency_ms", "items"), ts).alias("last")
    return log.groupBy(source).agg(last, F.max(ts).alias("last_seen")).select(source, "last.*", "last_seen")


def too_soon(log: DataFrame, key: str, ts: str, seconds: float = 0.7, tie: str | None = None) -> DataFrame:
    """Requests that came sooner after their key's last one than is allowed, with the gap in seconds."""
    order = Window.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    return log.withColumn("gap", gap / 1e6).filter(F.col("gap") < seconds)


def until_total(rows: DataFrame, amount: str, most: float, by: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Rows up to the one with which the running total reaches the limit."""
    order = Window.partitionBy(*(partition or [])).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__before", F.coalesce(F.sum(amount).over(order), F.lit(0))).filter(F.col("__before") < most).drop("__before")


def sitemap_urls(sitemaps: DataFrame, start: list[str], depth: int = 8) -> DataFrame:
    """Page URLs reached from the start over nested sitemaps (url, xml), each once, with the depth at which it is found.

    A level a join; a sitemap is read once, and so is a cycle.
    """
    spark = sitemaps.sparkSession
    links = sitemaps.select("url", F.explode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<]*?)\s*</loc"), F.lit(1))).alias("loc"))
    frontier = spark.createDataFrame([(u,) for u in start], "url string")
    seen, pages = frontier, None
    for level in range(depth):
        found = links.join(frontier, "url").select("loc").distinct()
        part = found.filter(~F.col("loc").rlike(r"(?i)\.xml(\.gz)?($|\?)")).select(F.col("loc").alias("url"), F.lit(level).alias("depth"))
        pages = part if pages is None else pages.unionByName(part)
        frontier = found.filter(F.col("loc").rlike(r"(?i)\.xml(\.gz)?($|\?)")).select(F.col("loc").alias("url")).join(seen, "url", "left_anti")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return pages.groupBy("url").agg(F.min("depth").alias("depth"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """host and URL of each sitemap that its robots file (host, body) names."""
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))
    return robots.select("host", F.explode(lines).alias("url"))


def crawl(seeds: DataFrame, pages: DataFrame, per_domain: int = 30) -> DataFrame:
    """Products found from seeds (domain, catalog_url): catalog page, its product links of the same host, their pages."""
    start = seeds.join(pages, seeds["catalog_url"] == pages["url"]).select("domain", "catalog_url", "html")
    links = start.select("domain", "catalog_url", F.posexplode(markup.hrefs("html")).alias("at", "href")).withColumn("url", urls.resolve("href", "catalog_url"))
    links = links.filter((urls.domain("url") == urls.domain("catalog_url")) & markup.product_link(F.col("url"), F.lit("")))
    once = links.groupBy("domain", "url").agg(F.min("at").alias("at"))
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("at", "url"))).filter(F.col("n") <= per_domain)
    found = kept.join(pages, "url").withColumn("product", markup.extract_product("url", "html"))
    return found.filter(F.col("product.title").isNotNull()).select("domain", "url", "product.*")


def category_hosts(queries: DataFrame, hosts: DataFrame, fallback: str = "tires") -> DataFrame:
    """Queries with the hosts of their category, or of the fallback where it has none."""
    known = hosts.select("category").distinct().withColumn("__known", F.lit(True))
    chosen = queries.join(known, "category", "left").withColumn("__c", F.when(F.col("__known"), F.col("category")).otherwise(fallback)).drop("__known")
    return chosen.join(hosts.withColumnRenamed("category", "__c"), "__c").drop("__c")


def adapter_fields(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, text) with brand and seller by the first pattern of their host's rules that matches."""
    joined = rows.join(rules, "host", "left")

    def first(patterns: str) -> Column:
        found = F.expr(f"transform(coalesce({patterns}, cast(array() as array<string>)), p -> regexp_extract(text, p, 1))")
        return F.coalesce(F.get(F.filter(found, lambda v: v != ""), F.lit(0)), F.lit(""))

    return joined.withColumns({"brand": first("brand_patterns"), "seller_found": F.coalesce(F.nullif(first("seller_patterns"), F.lit("")), F.col("seller"))})
