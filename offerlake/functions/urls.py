"""URLs as Column expressions; relative ones are resolved by a vectorised UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions.text import text


def host(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(text(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain(c: Column | str) -> Column:
    """The host without a leading www., and only without that."""
    return F.regexp_replace(host(c), r"^www\.", "")


def dedup_key(c: Column | str) -> Column:
    """Lower case, without the query and slashes at the end."""
    return F.regexp_replace(F.element_at(F.split(F.lower(text(c)), r"\?"), 1), "/+$", "")


def normalize(c: Column | str, base: Column | str | None = None) -> Column:
    """Trimmed, with a scheme, without parameters and fragment; an absolute path is taken from the base's host."""
    u = F.regexp_replace(F.trim(text(c)), "#.*$", "")
    rooted = F.concat(F.regexp_extract(text(base), r"^[a-z]+://[^/?#]+", 0), u) if base is not None else u
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), rooted).otherwise(u)
    return F.regexp_replace(full, r";[^/?]*(?=\?|$)", "")


def path(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def quote_plus(c: Column | str) -> Column:
    return F.url_encode(text(c))


def fill_pattern(pattern: Column | str, query: Column | str) -> Column:
    return F.replace(text(pattern), F.lit("{query}"), quote_plus(query))


def under(domain_col: Column, parent: Column) -> Column:
    """The domain is the parent or below it."""
    return (domain_col == parent) | domain_col.endswith(F.concat(F.lit("."), parent))


def category_page(c: Column | str, product_marks: tuple[str, ...] = ("/product/", "/detail", "/item/", "/p/")) -> Column:
    u = dedup_key(c)
    listed = u.contains("/category/") | u.contains("/search/")
    product = F.lit(False)
    for mark in product_marks:
        product = product | u.contains(mark)
    return listed & ~product


@F.pandas_udf(T.StringType())
def resolve(link: pd.Series, base: pd.Series) -> pd.Series:
    """A link as seen from the page it is on, dots and all, without a fragment."""
    from urllib.parse import urldefrag, urljoin

    def one(u, b):
        try:
            return urldefrag(urljoin(b or "", (u or "").strip()))[0]
        except ValueError:
            return ""

    return pd.Series([one(u, b) for u, b in zip(link, base, strict=True)], dtype=object)
