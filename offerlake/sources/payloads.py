"""Marketplace payloads as tables of offers. A source is a directory or table of raw payloads; nothing is fetched."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions import markup, numbers, urls
from offerlake.functions import text as X

REGIONS = {"москва": -1257786, "санкт-петербург": -1198055, "новосибирск": -364763, "екатеринбург": -5818883}
#: Upper end of each range of numbers that a shard of the image network serves; beyond the last, one more shard.
SHARD_ENDS = tuple(accumulate((143, 144, 144, 288, 288, 54, 54, 54, 144, 288, 54, 264, 126, 144, 216, 216, 216)))

_PRICE = "struct<total: bigint, product: bigint, sale: bigint>"
SEARCH = (
    "struct<data: struct<products: array<struct<id: bigint, name: string, brand: string, supplier: string, rating: double, reviewRating: double, feedbacks: bigint, "
    f"salePriceU: bigint, priceU: bigint, sizes: array<struct<price: {_PRICE}>>>>>>"
)


def region_code(region: Column, codes: dict[str, int] = REGIONS, default: int = -1257786) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(codes.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(X.text(region))), F.lit(default))


def shard(nm: Column) -> Column:
    """Number of the image shard of an article, by ranges of its volume."""
    volume = F.floor(nm / 100_000)
    hit = F.filter(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(i + 1).alias("n")) for i, e in enumerate(SHARD_ENDS)]), lambda r: volume <= r["e"])
    return F.coalesce(F.get(hit, F.lit(0))["n"], F.lit(len(SHARD_ENDS) + 1))


def image_urls(nm: Column, count: int = 6) -> Column:
    base = F.format_string("https://basket-%02d.wbbasket.ru/vol%d/part%d/%d/images/big/", shard(nm), F.floor(nm / 100_000), F.floor(nm / 1000), nm)
    return F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.concat(base, i.cast("string"), F.lit(".webp")))


def card_price(product: Column) -> Column:
    """The first size's price, total before product before sale, else the card's own, in whole units."""
    priced = F.filter(product["sizes"], lambda s: s["price"].isNotNull())
    first = F.get(priced, F.lit(0))["price"]
    minor = F.coalesce(F.nullif(first["total"], F.lit(0)), F.nullif(first["product"], F.lit(0)), F.nullif(first["sale"], F.lit(0)), F.nullif(product["salePriceU"], F.lit(0)), product["priceU"], F.lit(0))
    return minor / 100.0


def wildberries(payloads: DataFrame, limit: int = 30, json: str = "json") -> DataFrame:
    """Offers of search payloads, so many of each, in their order. Malformed payloads give none."""
    parsed = payloads.withColumn("__p", F.from_json(json, SEARCH))
    rows = parsed.select(*[c for c in payloads.columns if c != json], F.posexplode(F.slice("__p.data.products", 1, limit)).alias("ordinal", "p"))
    title = X.squeeze(F.concat_ws(" ", "p.brand", "p.name"))
    return rows.select(
        *[c for c in payloads.columns if c != json], "ordinal", F.lit("wildberries").alias("source"), F.col("p.id").cast("string").alias("productId"), title.alias("title"), F.col("p.brand").alias("brand"),
        F.col("p.supplier").alias("seller"), card_price(F.col("p")).alias("price"), F.coalesce("p.reviewRating", "p.rating").alias("rating"), F.coalesce("p.feedbacks", F.lit(0)).alias("reviewsCount"),
        F.format_string("https://www.wildberries.ru/catalog/%d/detail.aspx", "p.id").alias("url"), image_urls(F.col("p.id")).alias("images"),
    )


def card_details(cards: DataFrame, json: str = "json") -> DataFrame:
    """Characteristics of card payloads (grouped options), the first of a name, with the description."""
    kind = "struct<description: string, grouped_options: array<struct<options: array<struct<name: string, value: string>>>>, options: array<struct<name: string, value: string>>>"
    parsed = cards.withColumn("__c", F.from_json(json, kind))
    none = F.array().cast("array<struct<name: string, value: string>>")
    options = F.concat(F.coalesce(F.flatten(F.transform("__c.grouped_options", lambda g: g["options"])), none), F.coalesce("__c.options", none))
    entries = F.transform(options, lambda o: F.struct(o["name"].alias("key"), o["value"].alias("value")))
    return parsed.select(*[c for c in cards.columns if c != json], F.col("__c.description").alias("description"), markup.first_wins(entries).alias("characteristics"))


_NODE = {"title": ("title", "name"), "link": ("link", "url", "action.link"), "price": ("price", "finalPrice", "cardPrice"), "image": ("image", "coverImage", "picture"), "id": ("id", "sku", "productId")}


def _first(node: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.coalesce(F.get_json_object(node, f"$.{p}.text"), F.get_json_object(node, f"$.{p}")), F.lit("")) for p in paths], F.lit(""))


def _nodes(payloads: DataFrame, json: str, depth: int, width: int) -> DataFrame:
    return payloads.lateralJoin(markup.JsonWalk(F.col(json).outer(), F.lit(depth), F.lit(width))).select(*[c for c in payloads.columns if c != json], "ordinal", "node").withColumns({k: _first(F.col("node"), v) for k, v in _NODE.items()})


def ozon(payloads: DataFrame, base: str = "https://www.ozon.ru", json: str = "json") -> DataFrame:
    """Nodes with a title and link that have a price or lead to a product."""
    found = _nodes(payloads, json, 13, 350).filter((F.col("title") != "") & (F.col("link") != "") & ((F.col("price") != "") | F.col("link").contains("/product/")))
    return _offers(found, "ozon", base)


def yandex_market(payloads: DataFrame, base: str = "https://market.yandex.ru", json: str = "json") -> DataFrame:
    """Nodes with a name and an id or URL."""
    found = _nodes(payloads, json, 13, 350).filter((F.col("title") != "") & ((F.col("id") != "") | (F.col("link") != "")))
    return _offers(found, "yandex_market", base)


def _offers(found: DataFrame, source: str, base: str) -> DataFrame:
    url = F.when(F.col("link") != "", urls.normalize("link", F.lit(base))).otherwise(F.concat(F.lit(f"{base}/product/"), F.col("id")))
    slug = F.when(F.col("title") == "", X.slug_title("link")).otherwise(F.col("title"))
    return found.select(*[c for c in found.columns if c not in (*_NODE, "node")], F.lit(source).alias("source"), X.clean_text(slug).alias("title"), url.alias("url"), numbers.price("price").alias("price"), F.col("image").alias("mainImage"))


def shop_pages(pages: DataFrame, limit: int) -> DataFrame:
    """Offers of shop pages (url, html): limit // hosts + 1 of each host, at least one."""
    from pyspark.sql import Window

    hosted = pages.withColumn("host", urls.host("url"))
    per_host = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("__hosts")) + 1)
    one = hosted.agg(F.greatest(F.count_distinct("host"), F.lit(1)).alias("__hosts"))
    placed = hosted.withColumn("__n", F.row_number().over(Window.partitionBy("host").orderBy("url"))).crossJoin(F.broadcast(one)).filter(F.col("__n") <= per_host)  # one row
    found = placed.withColumn("p", markup.extract_product("url", "html")).filter(F.col("p.title").isNotNull())
    return found.select(F.lit("runet").alias("source"), "host", "url", "p.title", F.coalesce("p.price", F.lit(0.0)).alias("price"), F.col("p.image").alias("mainImage"), "p.brand", "p.characteristics")


def usable(fetches: DataFrame) -> DataFrame:
    """Fetch log (status_code, text, error) with whether it was blocked and whether to try again."""
    blocked = markup.blocked(F.col("status_code"), "text")
    again = F.coalesce(F.col("status_code").isin(408, 425, 429, 500, 502, 503, 504), F.lit(False)) | (X.text("error") != "")
    return fetches.withColumns({"blocked": blocked, "retry": again, "usable": ~blocked & ~again & F.coalesce(F.col("status_code") < 400, F.lit(False))})


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, json)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
