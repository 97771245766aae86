"""Similarities and scores. Whatever can be a Column expression is one; the edit distances over a keyboard are vectorised UDFs."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.functions.text import let, squeeze, text, token_set, tokens

# n-grams
def grams(c: Column, n: int) -> Column:
    """Every substring of n characters in order; the whole text where it is shorter, nothing where it is empty."""

    def of(v: Column) -> Column:
        size = F.length(v["c"])
        many = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(v["c"], i, F.lit(n)))
        return F.when(size == 0, F.array().cast("array<string>")).otherwise(many)

    return let(of, c=c)


def trigrams(c: Column | str) -> Column:
    return grams(F.lower(squeeze(c)), 3)


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of characters of the word between marks."""
    return F.array_distinct(grams(F.concat(F.lit("#"), F.lower(text(c)), F.lit("#")), 2))


def square_norm(items: Column) -> Column:
    """Sum of squares of how often each item stands in an array; where all differ that is its size, and only repeats are counted."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1.0)  # a run of n adds 1 + 3 + ... + (2n - 1) = n * n
        return F.struct(x.alias("last"), run.alias("run"), (s["total"] + 2 * run - 1).alias("total"))

    def repeated(v: Column) -> Column:
        more = F.filter(v["s"], lambda x, i: x == F.get(v["s"], i - 1))  # n - 1 of n, and n * n = n + (n - 1) + (n - 1) * (n - 1)
        return let(lambda w: F.size(v["s"]) + F.size(w["more"]) + F.aggregate(w["more"], start, step, lambda s: s["total"]), more=more)

    size = F.size(items)
    return F.when(F.size(F.array_distinct(items)) == size, size.cast("double")).otherwise(let(repeated, s=F.sort_array(items)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two multisets given as arrays of texts; 0 where one is empty."""

    def of(v: Column) -> Column:
        times = lambda items, x: (F.size(items) - F.size(F.array_remove(items, x))).cast("double")
        dot = F.aggregate(F.array_intersect(v["a"], v["b"]), F.lit(0.0), lambda s, x: s + times(v["a"], x) * times(v["b"], x))
        norm = F.sqrt(square_norm(v["a"])) * F.sqrt(square_norm(v["b"]))
        return F.when(norm > 0, dot / norm).otherwise(0.0)

    return let(of, a=a, b=b)


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# relevance and completeness
def _share(items: Column, test) -> Column:
    return F.size(F.filter(items, test)) / F.greatest(F.size(items), F.lit(1))


def relevance(query: Column | str, title: Column | str, body: Column | str) -> Column:
    """0.42 tokens + 0.22 title + 0.24 trigrams + 0.12 numbers + 0.15 phrase, 1 at most, to four places.

    Tokens count where the body has them as a token or within one; numbers only where all of the query's occur.
    """
    q, t, b = F.lower(squeeze(query)), F.lower(text(title)), F.lower(squeeze(body))

    def of(o: Column, v: Column) -> Column:
        q, t, b, words, numbers = o["q"], o["t"], o["b"], v["words"], v["numbers"]
        all_numbers = (F.size(numbers) > 0) & F.forall(numbers, lambda n: b.contains(n))
        score = (
            0.42 * _share(words, lambda w: b.contains(w)) + 0.22 * _share(words, lambda w: t.contains(w)) + 0.24 * cosine(v["qg"], v["bg"])
            + F.when(all_numbers, 0.12).otherwise(0.0) + F.when(b.contains(q), 0.15).otherwise(0.0)
        )
        return F.when((q == "") | (b == "") | (F.size(words) == 0), 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 4))

    def parts(o: Column) -> Column:  # of texts that are lower case and squeezed
        numbers = F.regexp_extract_all(o["q"], F.lit("[0-9]+(?:/[0-9]+)?"), F.lit(0))
        return let(lambda v: of(o, v), words=tokens(o["q"]), numbers=numbers, qg=grams(o["q"], 3), bg=grams(o["b"], 3))

    return let(parts, q=q, t=t, b=b)


def relevance_breakdown(query: Column | str, body: Column | str, fields: dict[str, Column], characteristics: Column) -> Column:
    words, b = tokens(query), F.lower(text(body))
    used = F.filter(F.array(*[F.when(text(c) != "", F.lit(k)) for k, c in fields.items()]), lambda x: x.isNotNull())
    return F.struct(
        F.filter(words, lambda w: b.contains(w)).alias("matched_tokens"), F.filter(words, lambda w: ~b.contains(w)).alias("missing_tokens"),
        F.greatest(F.size(characteristics), F.lit(0)).alias("characteristics_used"), used.alias("text_fields_used"),
    )


def completeness(checks: list[Column]) -> Column:
    """Share of checks that hold, to four places; a null check doesn't hold."""
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks]) / F.lit(float(len(checks))), 4)


def rank_quality(price: Column, has_image: Column, n_specs: Column, title: Column) -> Column:
    size = F.length(text(title))
    return (
        F.when(price > 0, 0.12).otherwise(-0.10) + F.when(has_image, 0.05).otherwise(-0.05) + 0.02 * F.least(F.greatest(n_specs, F.lit(0)), F.lit(5))
        + F.when(size < 8, -0.20).when(size > 20, 0.03).otherwise(0.0)
    )


def rank_score(query: Column | str, title_text: Column | str, quality: Column) -> Column:
    q, t = token_set(query), token_set(title_text)
    overlap = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    return F.round(F.least(F.greatest(0.75 * overlap + quality, F.lit(0.0)), F.lit(1.0)), 4)


def rank_explanation(query: Column | str, title_text: Column | str, price: Column, n_specs: Column) -> Column:
    common = F.array_sort(F.array_intersect(token_set(query), token_set(title_text)))
    return F.concat_ws(
        "; ", F.when(F.size(common) > 0, F.concat(F.lit("matched: "), F.array_join(common, ", "))), F.when(price > 0, F.lit("has price")),
        F.when(n_specs > 0, F.concat(F.lit("specs: "), n_specs.cast("string"))),
    )


# phonetics
_SOUNDS = {"1": "бпфв", "2": "цсз", "3": "дт", "4": "л", "5": "мн", "6": "р", "7": "гкх", "8": "жшчщ"}
_SILENT = "аеёиоуыэюяьъ"
_CODE = "".join(k * len(v) for k, v in _SOUNDS.items())
_LETTERS = "".join(_SOUNDS.values())


def soundex_ru(c: Column | str, size: int = 4) -> Column:
    """First letter and the codes of the consonants behind it that differ from the one before, padded with 0."""
    w = F.trim(F.lower(text(c)))
    coded = F.regexp_replace(F.translate(F.regexp_replace(w, f"[{_SILENT}]", ""), _LETTERS, _CODE), "[^1-8]", "")
    first = F.substring(w, 1, 1)
    opening = F.regexp_replace(F.translate(F.regexp_replace(first, f"[{_SILENT}]", ""), _LETTERS, _CODE), "[^1-8]", "")
    squeezed = F.regexp_replace(coded, r"(.)\1+", "$1")
    tail = F.when(opening != "", F.substring(squeezed, 2, 99)).otherwise(squeezed)
    return F.when(w == "", F.lit("0" * size)).otherwise(F.substring(F.concat(first, tail, F.lit("0" * size)), 1, size))


#: Letters, and below each the one that stands for its sound; the rest stand for themselves.
_SOUNDING = ("ыёэеяющзчпфкхтнл", "иооаауш" + "жцбвггдмр")


def metaphone_ru(c: Column | str) -> Column:
    """Letters by sound, without the signs, and repeats squeezed."""
    word = F.replace(F.regexp_replace(F.trim(F.lower(text(c))), "[ъь]", ""), F.lit("йо"), F.lit("ё"))
    return F.regexp_replace(F.translate(word, *_SOUNDING), r"(.)\1+", "$1")


def phonetic_key(c: Column | str, algorithm: str = "combined") -> Column:
    keys = {"soundex": [soundex_ru], "metaphone": [metaphone_ru], "combined": [soundex_ru, metaphone_ru]}
    if algorithm not in keys:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return F.concat_ws("-", *[f(c) for f in keys[algorithm]])


def phonetic_similarity(a: Column | str, b: Column | str, algorithm: str = "metaphone") -> Column:
    x, y = phonetic_key(a, algorithm), phonetic_key(b, algorithm)
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


# keyboard
_ROWS = ("ё1234567890-=", "йцукенгшщзхъ\\", "фывапролджэ", "ячсмитьбю.")
_SHIFTED = dict(zip('!"№;%:?*()_+', "1234567890-=", strict=True))


@lru_cache(1)
def _keys() -> dict[str, tuple[int, int]]:
    return {ch: (r, k) for r, row in enumerate(_ROWS) for k, ch in enumerate(row)} | {",": (3, 9), "/": (3, 10)}


@lru_cache(1 << 16)
def keyboard_distance(a: str, b: str) -> float:
    """0 for one key, 1 for neighbours, more by columns and rows apart, 5 for what isn't on the keyboard."""
    a, b = (_SHIFTED.get(x.lower(), x.lower()) for x in (a, b))
    if a == b:
        return 0.0
    p, q = _keys().get(a), _keys().get(b)
    if p is None or q is None:
        return 5.0
    rows, columns = abs(p[0] - q[0]), abs(p[1] - q[1])
    if rows <= 1 and columns <= 1:
        return 1.0
    return 1.5 + 0.5 * columns if rows == 0 else 2.0 + rows + 0.5 * columns


@lru_cache(1 << 16)
def substitution_cost(a: str, b: str) -> float:
    if a == b:
        return 0.0
    d = keyboard_distance(a, b)
    return 1.0 if d <= 1 else 1.5 if d <= 2 else 3.0


def weighted_distance(a: str, b: str, indel: float = 2.0) -> float:
    """Edit distance in which replacing near keys is cheap."""
    row = np.arange(len(b) + 1) * indel
    for x in a:
        new = np.empty_like(row)
        new[0] = row[0] + indel
        replaced = row[:-1] + np.array([substitution_cost(x, y) for y in b])
        removed = row[1:] + indel
        best = np.minimum(replaced, removed)
        for k in range(len(b)):
            new[k + 1] = min(best[k], new[k] + indel)
        row = new
    return float(row[-1])


@F.pandas_udf(T.DoubleType())
def weighted_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def near_by_keyboard(a: Column, b: Column, most: float = 4.0) -> Column:
    """Weighted distance within the limit; what plain edits and lengths rule out never gets to the UDF."""
    possible = (F.levenshtein(a, b) <= most) & (2 * F.abs(F.length(a) - F.length(b)) <= most)
    return F.when(possible, weighted_levenshtein(a, b) <= most).otherwise(False)


def ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that indel_ratio can be, by lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * F.least(F.length(a), F.length(b)) / total)


def candidate_score(distance: Column, a: Column | str, b: Column | str) -> Column:
    """Less is better: distance, and two each for what bigrams and sound don't share."""
    return distance + 2 * (1 - jaccard(bigrams(a), bigrams(b))) + 2 * (1 - phonetic_similarity(a, b))
