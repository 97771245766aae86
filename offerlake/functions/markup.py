"""Product records out of HTML and JSON.

Titles, links and meta tags are regular expressions; what needs a parser (JSON-LD, microdata, nested JSON) is one vectorised
UDF a page, so that a page is parsed once, and a table function that walks JSON to a given depth.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions.text import any_of, clean_text, let, text

BLOCK_MARKS = ("captcha", "access denied", "доступ ограничен", "are you a robot", "вы не робот", "too many requests", "forbidden", "cloudflare", "подозрительн", "проверка браузера", "antibot", "blocked")
BLOCK_CODES = (401, 403, 407, 418, 429, 498, 503)
PRODUCT_MARKS = ('"price"', '"sku"', '"offers"', '"product"', '"brand"', '"rating"', '"reviews"', '"name"', '"title"', '"image"')

# expressions
def first_tag(html: Column | str, tag: str) -> Column:
    """Text of the first element of a tag."""
    return clean_text(F.regexp_extract(text(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(text(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def meta(html: Column | str, name: str) -> Column:
    """Content of a meta tag by property or name, whichever attribute comes first."""
    one = rf'(?i)<meta\s[^>]*?(?:property|name)="{name}"[^>]*?content="([^"]*)"'
    other = rf'(?i)<meta\s[^>]*?content="([^"]*)"[^>]*?(?:property|name)="{name}"'
    first = F.regexp_extract(text(html), one, 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(text(html), other, 1))


def json_scripts(html: Column | str) -> Column:
    """Contents of the scripts that hold JSON, state assignments included."""
    typed = F.regexp_extract_all(text(html), F.lit(r'(?i)<script\b[^>]*?(?:application/(?:ld\+)?json|__NEXT_DATA__)[^>]*>([\s\S]*?)</script'), F.lit(1))
    assigned = F.regexp_extract_all(text(html), F.lit(r"(?i)window\.__(?:NUXT|PRELOADED_STATE|INITIAL_STATE)__ ?= ?([\s\S]*?);?\s*</script"), F.lit(1))
    return F.concat(typed, assigned)


def blocked(code: Column, body: Column | str) -> Column:
    marked = let(lambda v: any_of(v["body"], BLOCK_MARKS), body=F.lower(text(body)))
    return F.coalesce(code.isin(*BLOCK_CODES), F.lit(False)) | marked


def product_payload(body: Column | str) -> Column:
    """At least two marks of a product in the first 250,000 characters."""
    start = F.lower(F.substring(text(body), 1, 250_000))
    return let(lambda v: sum((v["body"].contains(m).cast("int") for m in PRODUCT_MARKS), F.lit(0)) >= 2, body=start)


def product_link(href: Column, anchor: Column, fragments: tuple[str, ...] = ("/product/", "/catalog/", "/item/", "/detail", "/p/", "/goods/")) -> Column:
    hit = F.lit(False)
    for f in fragments:
        hit = hit | href.contains(f)
    return hit | (F.length(F.trim(text(anchor))) > 20)


def allowed_link(url: Column, host_col: Column, suffix: Column, fragments: Column) -> Column:
    """On the host or below it, and with one of the path fragments, if there are any."""
    on = (host_col == suffix) | host_col.endswith(F.concat(F.lit("."), suffix))
    return on & ((F.size(fragments) == 0) | F.exists(fragments, lambda f: url.contains(f)))


def city(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?U)(?:г\.|город)\s*([А-ЯЁ][а-яё]+(?:[- ][А-ЯЁ][а-яё]+)?)", 1))


def address(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?iU)((?:ул\.|улица|проспект|пр-т|шоссе)\s*[^,<>]{2,60},\s*(?:д\.\s*)?\d+[а-я]?)", 1))


def coordinates(c: Column | str) -> Column:
    found = lambda k: F.regexp_extract(text(c), rf'(?i)"?(?:{k})"?\s*[:=]\s*"?(-?\d{{1,3}}\.\d+)', 1).try_cast("double")
    return F.struct(found("lat|latitude").alias("latitude"), found("lon|lng|longitude").alias("longitude"))


GEO = ("requestedRegion", "detectedRegion", "city", "deliveryRegion", "storeAddress", "pickupAddress", "warehouse")


def default_geo(region: Column) -> Column:
    return F.struct(*[(region if k in ("requestedRegion", "detectedRegion", "deliveryRegion", "city") else F.lit("")).alias(k) for k in GEO], F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"))


def merge_geo(base: Column, over: Column) -> Column:
    """Fields of over where they aren't empty, else of base."""
    texts = [F.coalesce(F.nullif(over[k], F.lit("")), base[k]).alias(k) for k in GEO]
    return F.struct(*texts, *[F.coalesce(over[k], base[k]).alias(k) for k in ("latitude", "longitude")])


def first_wins(entries: Column) -> Column:
    """A map of entries (key, value) of which the first of a key counts; empty keys and values are left out."""
    clean = F.filter(entries, lambda e: (text(e["key"]) != "") & (text(e["value"]) != ""))
    indexed = F.transform(clean, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    first = F.filter(indexed, lambda e: ~F.exists(indexed, lambda o: (o["key"] == e["key"]) & (o["i"] < e["i"])))
    return F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"])))


def last_wins(a: Column, b: Column) -> Column:
    """Union of two maps; b's values win where they aren't empty."""
    b = F.map_filter(F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, v: text(v) != "")
    a = F.coalesce(a, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def ordered_union(a: Column, b: Column, most: int = 12) -> Column:
    return F.slice(F.array_distinct(F.concat(a, b)), 1, most)


# parsing
def walk(node: object, depth: int = 12, width: int = 300):
    """Dictionaries of nested JSON, outer ones first, so deep and so wide at most."""
    todo = [(node, depth)]
    while todo:
        at, left = todo.pop()
        if left >= 0 and isinstance(at, dict | list):
            inner = at[:width] if isinstance(at, list) else list(at.values())
            todo += [(v, left - 1) for v in reversed(inner)]
            if isinstance(at, dict):
                yield at


def load(source: str | None) -> object:
    try:
        return json.loads(source or "")
    except ValueError:
        return None


def plain(value: object) -> str:
    """A scalar, or the text, name, value or url in a dictionary, or the first such in a list."""
    if isinstance(value, dict):
        return next((p for k in ("text", "name", "value", "url", "@id", "link") if (p := plain(value.get(k)))), "")
    if isinstance(value, list):
        return next((p for v in value if (p := plain(v))), "")
    return "" if value is None or isinstance(value, bool) else str(value).strip()


AMOUNT = r"[0-9][0-9\s\u00a0]*(?:[.,][0-9][0-9]?)?"


def number(value: object) -> float | None:
    found = re.search(AMOUNT, plain(value))
    return float(re.sub(r"[\s ]", "", found[0]).replace(",", ".")) if found else None


def characteristics(node: object, most: int = 80) -> dict[str, str]:
    """Name and value pairs, and scalars under keys for specifications; the first of a name counts."""
    out: dict[str, str] = {}

    def add(k: object, v: object) -> None:
        k, v = plain(k)[:80], plain(v)[:800]
        if k and v and len(out) < most and not re.match(r"(?i)https?:|/", k):
            out.setdefault(k, v)

    for d in walk(node):
        name = d.get("name") or d.get("title") or d.get("key")
        value = d.get("value", d.get("values"))
        if name and value not in (None, "", []):
            add(name, value)
        for key in ("characteristics", "specs", "specifications", "attributes", "properties", "params"):
            if isinstance(d.get(key), dict):
                for k, v in d[key].items():
                    if not isinstance(v, dict | list):
                        add(k, v)
    return out


class Page(HTMLParser):
    """One pass over a page: headings, links, images, meta tags, microdata, tables of specifications and JSON scripts."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title = self.heading = ""
        self.links: list[list[str]] = []
        self.images: list[str] = []
        self.meta: dict[str, str] = {}
        self.item: dict[str, str] = {}
        self.crumbs: list[str] = []
        self.json: list[str] = []
        self.cells: list[str] = []
        self.words: list[str] = []
        self.open: list[tuple[str, str, list[str]]] = []
        self.product = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a.get("content", ""))
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])
        if "product" in a.get("itemtype", "").lower():
            self.product += 1
        key = a.get("itemprop", "") if self.product else ""
        if key and (value := a.get("content") or a.get("href") or a.get("src")):
            self.item.setdefault(key, value)
            key = ""
        crumb = "breadcrumb" in (a.get("class", "") + a.get("itemtype", "")).lower()
        kind = tag if tag in ("title", "h1", "a", "script", "style", "td", "th", "dt", "dd") else "crumb" if crumb else f"prop:{key}" if key else ""
        if kind and tag not in ("meta", "img", "link", "br", "input"):
            self.open.append((tag, kind + ("|" + a.get("href", "") if kind == "a" else "|" + a.get("type", "") + a.get("id", "") if kind == "script" else ""), []))

    def handle_data(self, data):
        if not any(kind.startswith(("script", "style")) for _, kind, _ in self.open):
            self.words.append(data)
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        for _, kind, parts in self.open[at:]:
            value = " ".join("".join(parts).split())
            if kind == "title":
                self.title = self.title or value
            elif kind == "h1":
                self.heading = self.heading or value
            elif kind.startswith("a|"):
                self.links.append([kind[2:], value])
            elif kind.startswith("script|") and "json" in kind.lower() or kind.startswith("script|") and "__NEXT_DATA__" in kind:
                self.json.append("".join(parts))
            elif kind in ("td", "th", "dt", "dd"):
                self.cells.append(value)
            elif kind.startswith("prop:"):
                self.item.setdefault(kind[5:], value)
            elif kind == "crumb":
                self.crumbs += [value] if value else []
        del self.open[at:]


def _ld_product(scripts: list[str]) -> dict | None:
    for script in scripts:
        for d in walk(load(script)):
            kinds = d.get("@type")
            kinds = kinds if isinstance(kinds, list) else [kinds]
            if {str(k).lower() for k in kinds} & {"product", "offer", "aggregateoffer"} and plain(d.get("name")):
                return d
    return None


def extract(url: str | None, html: str | None, least: int = 200) -> dict | None:
    """The product of a page: JSON-LD with a price, then microdata, OpenGraph, headings, then JSON-LD without one."""
    html = html or ""
    if len(html) < least:
        return None
    page = Page(html[:1_000_000])
    out: dict = {"brand": "", "category": "", "description": page.meta.get("description", "")[:1000], "old_price": None, "characteristics": {}}
    ld = _ld_product(page.json)
    if ld:
        offers = ld.get("offers")
        offer = offers[0] if isinstance(offers, list) and offers else offers if isinstance(offers, dict) else {}
        brand = plain(ld.get("brand"))
        specs = {plain(p.get("name")): plain(p.get("value")) for p in (ld.get("additionalProperty") or [])[:8] if isinstance(p, dict)}
        found = {"title": plain(ld.get("name")), "price": number(offer.get("price") or offer.get("lowPrice")), "image": plain(ld.get("image")), "brand": brand, "category": plain(ld.get("category")), "description": plain(ld.get("description"))[:200], "how": "json-ld", "characteristics": ({"Бренд": brand} if brand else {}) | {k: v for k, v in specs.items() if k and v}}
        if found["price"]:
            return out | found
        ld = out | found
    if page.item.get("name") and page.item.get("price"):
        return out | {"title": page.item["name"], "price": number(page.item["price"]), "image": page.item.get("image", ""), "brand": page.item.get("brand", ""), "how": "microdata"}
    if page.meta.get("og:title") and (page.meta.get("product:price:amount") or page.meta.get("og:price:amount")):
        return out | {"title": page.meta["og:title"], "price": number(page.meta.get("product:price:amount") or page.meta["og:price:amount"]), "image": page.meta.get("og:image", ""), "how": "opengraph"}
    stated = re.search(rf"({AMOUNT})\s*(?:руб|rub|₽|р\.)", " ".join(page.words), re.I)
    if len(page.heading) >= 4 and (stated or not ld):
        image = page.meta.get("og:image") or next((i for i in page.images if re.search("product|main|hero", i)), "")
        cells = dict(zip(page.cells[::2], page.cells[1::2], strict=False))
        return out | {"title": page.heading, "price": number(stated[1]) if stated else None, "image": image, "how": "heuristic", "characteristics": {k: v for k, v in list(cells.items())[:30] if k and v}}
    return ld


PRODUCT = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("title", "image", "brand", "category", "description", "how")]
    + [T.StructField(k, T.DoubleType()) for k in ("price", "old_price")]
    + [T.StructField("characteristics", T.MapType(T.StringType(), T.StringType()))]
)


@F.pandas_udf(PRODUCT)
def extract_product(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    rows = [extract(u, h) or {} for u, h in zip(url, html, strict=True)]
    return pd.DataFrame([[row.get(f.name) for f in PRODUCT] for row in rows], columns=PRODUCT.names)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_characteristics(source: pd.Series) -> pd.Series:
    return pd.Series([characteristics(load(s)) for s in source], dtype=object)


_GEO_KEYS = {"city": ("city", "cityName", "addressLocality", "locality"), "storeAddress": ("address", "streetAddress", "storeAddress"), "pickupAddress": ("pickupAddress", "pickupPoint"), "warehouse": ("warehouse", "warehouseName", "stock"), "deliveryRegion": ("region", "deliveryRegion", "addressRegion")}


def geo_of(node: object) -> dict[str, object]:
    """Places named in nested JSON: the first value of each kind, and the first pair of coordinates."""
    out: dict[str, object] = dict.fromkeys(GEO, "") | {"latitude": None, "longitude": None}
    for d in walk(node):
        for field, keys in _GEO_KEYS.items():
            out[field] = out[field] or next((v for k in keys if not isinstance(d.get(k), list) and (v := plain(d.get(k)))), "")
        lat, lon = (next((number_at(d[k]) for k in keys if k in d), None) for keys in (("lat", "latitude"), ("lon", "lng", "longitude")))
        if out["latitude"] is None and lat is not None and lon is not None:
            out["latitude"], out["longitude"] = lat, lon
    return out


def number_at(value: object) -> float | None:
    try:
        return float(str(value))
    except ValueError:
        return None


_GEO_TYPE = T.StructType([T.StructField(k, T.StringType()) for k in GEO] + [T.StructField(k, T.DoubleType()) for k in ("latitude", "longitude")])


@F.pandas_udf(_GEO_TYPE)
def json_geo(source: pd.Series) -> pd.DataFrame:
    rows = [geo_of(load(s)) for s in source]
    return pd.DataFrame([[r[k] for k in _GEO_TYPE.names] for r in rows], columns=_GEO_TYPE.names)


_TEXTS = T.ArrayType(T.StringType())
_DETAILS = T.StructType([T.StructField("images", _TEXTS), T.StructField("breadcrumbs", _TEXTS), T.StructField("description", T.StringType()), T.StructField("specs", T.MapType(T.StringType(), T.StringType()))])


def details(url: str | None, html: str | None) -> tuple[list[str], list[str], str, dict[str, str]]:
    """At most 12 images, resolved, 12 breadcrumbs, the description, and 30 specifications of cells or of lines name: value."""
    page = Page((html or "")[:1_000_000])
    images = list(dict.fromkeys(urljoin(url or "", i) for i in [page.meta.get("og:image", ""), *page.images] if i))[:12]
    specs = {k: v for k, v in zip(page.cells[::2], page.cells[1::2], strict=False) if k and v}
    for line in " \n".join(page.words).split("\n"):
        name, mark, value = line.strip().partition(":")
        if mark and 2 <= len(name) <= 40 and 1 <= len(value.strip()) <= 120 and "//" not in line:
            specs.setdefault(name.strip(), value.strip())
    description = page.meta.get("description") or page.meta.get("og:description") or page.item.get("description", "")
    return images, list(dict.fromkeys(page.crumbs))[:12], description, dict(list(specs.items())[:30])


@F.pandas_udf(_DETAILS)
def page_details(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([details(u, h) for u, h in zip(url, html, strict=True)], columns=_DETAILS.names)


@F.udtf(returnType="ordinal int, depth int, node string")
class JsonWalk:
    """The dictionaries in a JSON text, outer ones first: json_walk(json, depth, width)."""

    def eval(self, source: str, depth: int, width: int):
        def down(node, at):
            if at > depth:
                return
            if isinstance(node, dict):
                yield at, node
            for value in list(node.values()) if isinstance(node, dict) else node[:width] if isinstance(node, list) else ():
                yield from down(value, at + 1)

        for k, (at, node) in enumerate(down(load(source), 0)):
            yield k, at, json.dumps(node, ensure_ascii=False)


@F.udtf(returnType="ordinal int, url string, anchor string")
class HtmlLinks:
    """The links of a page, resolved and each once: html_links(html, base)."""

    def eval(self, html: str, base: str):
        seen: set[str] = set()
        for href, anchor in Page(html or "").links:
            url = urljoin(base or "", href).split("#")[0]
            if url and url not in seen:
                seen.add(url)
                yield len(seen) - 1, url, anchor


def register(spark) -> None:
    """SQL names of the table functions and UDFs."""
    from offerlake.functions import similarity, urls
    from offerlake.functions import text as texts

    spark.udtf.register("json_walk", JsonWalk)
    spark.udtf.register("html_links", HtmlLinks)
    for name, function in (("weighted_levenshtein", similarity.weighted_levenshtein), ("indel_ratio", similarity.indel_ratio), ("safe_replace", texts.safe_replace), ("extract_words", texts.extract_words), ("resolve_url", urls.resolve), ("extract_product", extract_product), ("json_characteristics", json_characteristics), ("json_geo", json_geo), ("page_details", page_details)):
        spark.udf.register(name, function)
