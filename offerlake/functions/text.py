"""Normalisation of queries and titles as Column expressions; null reads as an empty text throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEYS = (("qwertyuiop[]", "йцукенгшщзхъ"), ("asdfghjkl;'", "фывапролджэ"), ("zxcvbnm,./", "ячсмитьбю."), ("`", "ё"))
LATIN_KEYS, CYRILLIC_KEYS = ("".join(row[k] for row in _KEYS) for k in (0, 1))
#: Beginnings that tell a real word from a chance one when a query typed in the wrong layout is turned.
ROOTS = tuple("ботин брюк клавиатур кроссов куртк монитор мышь ноутбук покрыш принтер резин сканер шин".split())
#: (wrong, right), applied one after another in this order.
TYPOS = (("кросовки", "кроссовки"), ("нотбук", "ноутбук"), ("принтар", "принтер"), ("орг техника", "оргтехника"))
CATEGORY_RULES = (
    ("tires", ("/", " r1", " r2", *"покрышк резин шин".split())),
    ("office_tech", tuple("картридж клавиатур монитор мфу ноутбук принтер проектор роутер сканер".split())),
    ("clothing", tuple("ботинк брюки джинс кроссовк куртк пальто платье рубашк свитер футболк".split())),
)
DIGIT_LETTERS = ("03468517@$#%&*", "озчбвслтасноио")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(then, **values: Column) -> Column:
    """then(v) with each value evaluated once a row, as v["name"]; lambdas would evaluate an expression anew each time."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def any_of(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts], F.lit(False))


def turn_layout(c: Column | str) -> Column:
    return F.translate(F.lower(text(c)), LATIN_KEYS, CYRILLIC_KEYS)


def layout_fix(c: Column | str, roots: Sequence[str] = ROOTS) -> Column:
    """The text as if typed in the Cyrillic layout, where it is all Latin keys and so turned holds a known root."""
    turned = turn_layout(c)
    return F.when(text(c).rlike(r"^[\s\-`/.,';\]\[a-zA-Z]+$") & any_of(turned, roots), turned).otherwise(text(c))


def tire_size(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?iu)\b([0-9]{3})\s*[-/ ]\s*([0-9]{2})\s*[-/ rр]?\s*([0-9]{2})\b", "$1/$2 R$3")


def fix_typos(c: Column, typos: Sequence[tuple[str, str]] = TYPOS) -> Column:
    return reduce(lambda a, pair: F.replace(a, F.lit(pair[0]), F.lit(pair[1])), typos, c)


def normalize_query(c: Column | str, layout: str = "guarded", typos: Sequence[tuple[str, str]] = TYPOS) -> Column:
    """Lower case, layout, no odd characters, single spaces, ordered typo fixes, tire sizes.

    layout: ``guarded`` turns only what holds a known root, ``compat`` turns every Latin query, ``none`` turns nothing.
    """
    lowered = F.trim(F.lower(text(c)))
    if layout == "guarded":
        lowered = F.lower(layout_fix(lowered))
    elif layout == "compat":
        lowered = F.when(lowered.rlike(r"^[a-z0-9/\- .]+$") & lowered.rlike("[a-z]"), turn_layout(lowered)).otherwise(lowered)
    elif layout != "none":
        raise ValueError(f"unknown layout {layout!r}")
    plain = squeeze(F.regexp_replace(lowered, r"(?U)[^\w/.\- ]+", " "))
    return tire_size(fix_typos(plain, typos))


def normalize_guarded(c: Column | str) -> Column:
    return F.lower(squeeze(layout_fix(c)))


def tire_variant(c: Column | str, mark: str = "r") -> Column:
    """A size as W/H and the mark with the rim, and the word for tires in front where none is there."""
    size = F.regexp_replace(text(c), r"(?iu)\b([0-9]{3})[\\/]([0-9]{2})\s*[rр]([0-9]{2})\b", f"$1/$2 {mark}$3")
    named = F.lower(size).contains("шин") | F.lower(size).contains("резин")
    return F.when(size.rlike(rf"\b\d{{3}}/\d{{2}} {mark}\d{{2}}\b") & ~named, F.concat(F.lit("шины "), size)).otherwise(size)


def clean_text(c: Column | str) -> Column:
    """Text without tags, white space squeezed."""
    return squeeze(F.regexp_replace(text(c), "<[^>]+>", " "))


def visible_text(c: Column | str) -> Column:
    return clean_text(F.regexp_replace(text(c), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "))


def flatten_map(c: Column, most: int = 120) -> Column:
    """Keys and values of a map, in order and without empty ones, as one text of so many parts at most."""
    parts = F.flatten(F.transform(F.map_entries(c), lambda e: F.array(e["key"], e["value"])))
    return F.coalesce(F.array_join(F.slice(F.filter(parts, lambda p: F.trim(p) != ""), 1, most), " "), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Words and word/word pairs of more than one character, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[0-9a-zа-яё]+(?:/[0-9a-zа-яё]+)?"), F.lit(0)), lambda w: F.length(w) > 1)


def token_set(c: Column | str) -> Column:
    """Words of more than two characters, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-zа-яё0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def fts_tokens(c: Column | str, fold: bool = True) -> Column:
    """Letters and digits of any script, lower case; with fold, without Latin accents and the Cyrillic breve and dots."""
    lowered = F.lower(text(c))
    return F.regexp_extract_all(fold_accents(lowered) if fold else lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def expander_tokens(c: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Quoted phrases and hyphenated words in order, lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(r'(?U)"[^"]+"|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*'), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(w, '"', ""))
    return F.filter(bare, lambda w: ~w.isin(*stop_words)) if stop_words else bare


def digits_to_letters(c: Column | str) -> Column:
    return F.translate(F.lower(text(c)), *DIGIT_LETTERS)


def preserve_capitalization(original: Column | str, corrected: Column | str) -> Column:
    """corrected in the case of original: all upper, first upper or lower."""
    o, c = text(original), text(corrected)
    shouted = (F.upper(o) == o) & (F.lower(o) != o)
    first = F.substring(o, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    title = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    return F.when(shouted, F.upper(c)).when(capital, title).otherwise(F.lower(c))


def normalize_title(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s]", " "))


def item_text(title: Column | str, characteristics: Column) -> Column:
    """Title and the first three characteristics, 256 characters at most."""
    first = F.transform(F.slice(F.map_entries(characteristics), 1, 3), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.substring(F.concat_ws(" ", text(title), F.array_join(F.coalesce(first, F.array().cast("array<string>")), " ")), 1, 256)


def category(c: Column | str, rules=CATEGORY_RULES, default: str = "general") -> Column:
    """The first rule one of whose parts the lower-cased text contains."""
    lowered, out = F.lower(text(c)), None
    for name, parts in rules:
        test = any_of(lowered, parts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def ui_category(c: Column | str) -> Column:
    q = F.lower(text(c))
    return F.when(q.rlike(r"шин|резин|покрыш|\d{3}/\d{2}"), "tires").when(q.rlike("принтер|мфу|картридж|бумаг|сканер|ноутбук"), "office").otherwise("clothes")


def availability(c: Column | str) -> Column:
    """In stock where the phrase for it stands, even within the phrase that denies it, as searchers have come to expect."""
    q = F.lower(text(c))
    return F.when(any_of(q, ("в наличии", "instock", "in stock")), "in_stock").when(any_of(q, ("нет", "под заказ", "outofstock")), "limited_or_out_of_stock").otherwise("")


def cache_key(c: Column | str, max_length: int, k: int, model: str) -> Column:
    return F.md5(F.concat_ws("|", text(c), F.lit(max_length), F.lit(k), F.lit(model)))


def slug_title(url: Column | str) -> Column:
    """The last part of a URL's path as words, without a number behind it."""
    path = F.regexp_replace(F.regexp_replace(text(url), r"[?#].*$", ""), "/+$", "")
    slug = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"-?\d+$", "")
    return F.trim(F.regexp_replace(slug, "[-_]+", " "))


def format_rubles(c: Column | str) -> Column:
    return F.concat(F.replace(F.format_number(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)), 0), F.lit(","), F.lit(" ")), F.lit(" ₽"))


def lemmatize(words: Column, lemmas: dict[str, str]) -> Column:
    """Words by a table of lemmas; one that isn't there stays as it is."""
    if not lemmas:
        return words
    table = F.create_map(*[F.lit(x) for pair in sorted(lemmas.items()) for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


@F.pandas_udf(T.StringType())
def safe_replace(source: pd.Series, word: pd.Series, replacement: pd.Series) -> pd.Series:
    """Every whole-word occurrence of word, in any case, replaced; nothing in it is read as a pattern."""
    import re

    def one(s, w, r):
        return s if not s or not w else re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", lambda _: r or "", s, flags=re.I)

    return pd.Series([one(*row) for row in zip(source, word, replacement, strict=True)], dtype=object)


_PLACED = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_PLACED)
def extract_words(source: pd.Series) -> pd.Series:
    """Cyrillic words, marks that stand for letters within them included, with their places."""
    import re

    pattern = re.compile(r"[а-яё](?:[\w@#$%&*]*[а-яё\d@#$%&*])?", re.I)
    return pd.Series([[{"word": m[0], "start": m.start(), "end": m.end()} for m in pattern.finditer(s or "")] for s in source], dtype=object)
