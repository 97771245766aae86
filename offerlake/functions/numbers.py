"""Prices, ratings and counts out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake.functions.text import text

CURRENCY = r"(?iu)([0-9][0-9\s\u00a0]{0,12}(?:[.,][0-9][0-9]?)?)\s*(?:руб|rub|₽|р\.)"


def _in_range(value: Column) -> Column:
    """1 to 100 million, of which more than 10 million are hundredths where 100 divides them; else 0."""
    scaled = F.when((value > 10_000_000) & (value % 100 == 0), value / 100).otherwise(value)
    return F.when(scaled.between(1, 100_000_000), scaled).otherwise(F.lit(0.0))


def price(c: Column | str) -> Column:
    """The digits of the first run that looks like a price; 0 where there is none or it is out of range."""
    run = F.regexp_extract(F.regexp_replace(text(c), " ", " "), r"\d[\d\s.,]{1,14}", 0)
    return F.coalesce(_in_range(F.regexp_replace(run, r"\D", "").try_cast("double")), F.lit(0.0))


def price_strict(c: Column | str) -> Column:
    """A price with decimals: of both marks the comma is decimal, of commas alone one with two digits or fewer behind it is.

    Null outside 10 to 10 million.
    """
    digits = F.regexp_replace(text(c), r"[^\d.,]", "")
    both = digits.contains(",") & digits.contains(".")
    european = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    decimal = digits.rlike(r"^\d*,\d{1,2}$")
    plain = F.when(both, european).when(decimal, F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    return F.when(value.between(10, 10_000_000), value)


def price_in_text(c: Column | str) -> Column:
    """The number in front of the first currency sign, as price_strict reads it."""
    return price_strict(F.regexp_extract(text(c), CURRENCY, 1))


def labelled_price(c: Column | str) -> Column:
    """The number behind a word for price and in front of a currency sign."""
    found = F.regexp_extract(text(c), r"(?iu)(?:цена|стоимость)\D{0,40}?([0-9][0-9\s\u00a0]*)(?:руб|₽)", 1)
    return F.regexp_replace(found, r"\D", "").try_cast("double")


def rating(c: Column | str) -> Column:
    return F.replace(F.regexp_extract(text(c), r"\b([1-5][.,]\d)\b", 1), F.lit(","), F.lit(".")).try_cast("double")


def reviews(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(text(c), r"(?iu)([0-9][0-9\s\u00a0]*)(?:оцен|отзыв)", 1), r"\D", "").try_cast("int")


def rounded(c: Column, places: int = 4) -> Column:
    return F.round(c, places)


def present(c: Column) -> Column:
    """A number, or null where it is missing, which 0 stands for."""
    return F.when(c != 0, c)
