"""Worked values of the text, number, URL and similarity functions."""

import random

import pytest
from pyspark.sql import functions as F

from offerlake.functions import numbers as N
from offerlake.functions import similarity as S
from offerlake.functions import text as X
from offerlake.functions import urls as U

L = F.lit
GOLDEN = lambda: [  # noqa: E731  (columns need a session)
    (X.normalize_query(L("шины 205 55 r16")), "шины 205/55 R16"),
    (X.normalize_query(L("  Кросовки   NIKE!! ")), "кроссовки nike"),
    (X.normalize_query(L("ibys")), "шины"),
    (X.normalize_query(L("hp laser")), "hp laser"),
    (X.normalize_query(L("hp"), "compat"), "рз"),
    (X.normalize_query(L("a b"), "none"), "a b"),
    (X.layout_fix(L("ibys")), "шины"),
    (X.layout_fix(L("apple")), "apple"),
    (X.tire_variant(L("205\\55R16"), "R"), "шины 205/55 R16"),
    (X.tire_variant(L("шины 205/55 r16")), "шины 205/55 r16"),
    (X.clean_text(L("<p>a &nbsp;<b>b</b></p> c")), "a &nbsp; b c"),
    (X.visible_text(L("<script>x</script><p>a</p><!-- n -->b")), "a b"),
    (X.tokens(L("Шины 205/55 R16 b")), ["шины", "205/55", "r16"]),
    (X.token_set(L("Шины шины R16 ab")), ["шины", "r16"]),
    (X.fts_tokens(L("Café, naïve—x2")), ["cafe", "naive", "x2"]),
    (X.expander_tokens(L('"игровой ноутбук" веб-камера для'), ("для",)), ["игровой ноутбук", "веб-камера"]),
    (X.digits_to_letters(L("тел3фон")), "телзфон"),
    (X.digits_to_letters(L("экр@н")), "экран"),
    (X.preserve_capitalization(L("Тлефон"), L("телефон")), "Телефон"),
    (X.preserve_capitalization(L("КОМПЬТЕР"), L("компьютер")), "КОМПЬЮТЕР"),
    (X.preserve_capitalization(L("123"), L("Abc")), "abc"),
    (X.category(L("зимняя резина")), "tires"),
    (X.category(L("Ноутбук игровой")), "office_tech"),
    (X.category(L("куртка")), "clothing"),
    (X.category(L("чайник")), "general"),
    (X.ui_category(L("принтер")), "office"),
    (X.availability(L("Нет в наличии")), "in_stock"),
    (X.availability(L("под заказ")), "limited_or_out_of_stock"),
    (X.slug_title(L("https://a.b/product/cool-thing-123/?x")), "cool thing"),
    (X.format_rubles(L(34990.0)), "34 990 ₽"),
    (X.flatten_map(F.create_map(L("a"), L("1"), L("b"), L(""))), "a 1 b"),
    (N.price(L("34 990 ₽")), 34990.0),
    (N.price(L("34 990,00")), 3499000.0),
    (N.price(L("5")), 0.0),
    (N.price(L("12 999 000,00")), 12999000.0),
    (N.price(L(None).cast("string")), 0.0),
    (N.price_strict(L("12.999,00")), 12999.0),
    (N.price_strict(L("12999,00")), 12999.0),
    (N.price_strict(L("12,999")), 12999.0),
    (N.price_strict(L("34.990")), 34.99),
    (N.price_strict(L("5")), None),
    (N.price_in_text(L("всего 1 299 руб. в день")), 1299.0),
    (N.labelled_price(L("Цена сегодня: 7 500 ₽")), 7500.0),
    (N.rating(L("оценка 4,7 из 5")), 4.7),
    (N.reviews(L("1 234 отзыва")), 1234),
    (U.domain(L("https://www.wildberries.ru/x")), "wildberries.ru"),
    (U.dedup_key(L("HTTPS://A.b/C/?x=1")), "https://a.b/c"),
    (U.normalize(L(" //a.b/c;p=1?q#f ")), "https://a.b/c?q"),
    (U.normalize(L("/x"), L("https://a.b/c/d")), "https://a.b/x"),
    (U.quote_plus(L("a b/ё")), "a+b%2F%D1%91"),
    (U.fill_pattern(L("https://a/?q={query}"), L("a b")), "https://a/?q=a+b"),
    (U.category_page(L("https://a/category/x/product/1")), False),
    (U.category_page(L("https://a/category/x?y")), True),
    (U.resolve(L("../c#x"), L("https://a.b/d/e/f")), "https://a.b/d/c"),
    (S.soundex_ru(L("телефон")), "т415"),
    (S.soundex_ru(L("тилефон")), "т415"),
    (S.soundex_ru(L("роутер")), "р360"),
    (S.soundex_ru(L("")), "0000"),
    (S.metaphone_ru(L("телефон")), "даравом"),
    (S.metaphone_ru(L("тилефон")), "диравом"),
    (S.phonetic_key(L("телефон")), "т415-даравом"),
    (S.phonetic_similarity(L("телефон"), L("тилефон")), pytest.approx(6 / 7)),
    (S.bigrams(L("телефон")), "#т те ел ле еф фо он н#".split()),
    (S.jaccard(S.bigrams(L("телефон")), S.bigrams(L("тлефон"))), pytest.approx(6 / 9)),
    (S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), 1.0),
    (S.trigrams(L(" аб ")), ["аб"]),
    (S.trigrams(L("")), []),
    (S.weighted_levenshtein(L("тлефон"), L("телефон")), 2.0),
    (S.weighted_levenshtein(L("мыш"), L("мышь")), 2.0),
    (S.near_by_keyboard(L("мыш"), L("мышь")), True),
    (S.indel_ratio(L("нотбук"), L("ноутбук")), pytest.approx(1200 / 13)),
    (S.relevance(L("шины"), L("Шины зимние"), L("")), 0.0),
    (S.vector_cosine(F.array(L(1.0), L(0.0)), F.array(L(1.0), L(1.0))), pytest.approx(0.5**0.5)),
    (S.completeness([L(True), L(False), L(None).cast("boolean"), L(True)]), 0.5),
]


def test_worked_values(spark):
    golden = GOLDEN()
    row = spark.range(1).select(*[c.alias(f"v{i}") for i, (c, _) in enumerate(golden)]).first()
    got = [v.replace("\xa0", " ") if isinstance(v, str) else v for v in row]
    assert not [(i, g, want) for i, (g, (_, want)) in enumerate(zip(got, golden, strict=True)) if g != want]


def test_keyboard():
    assert [S.keyboard_distance(*p) for p in ("ен", "ая", "аq", "йу", "йй")] == [1.0, 4.5, 5.0, 2.5, 0.0]
    assert [S.substitution_cost(*p) for p in ("аа", "ен", "йу", "Аа")] == [0.0, 1.0, 3.0, 1.0]


def plain_distance(a, b):
    d = [[2.0 * (i + j) if not i or not j else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 2, d[i][j - 1] + 2, d[i - 1][j - 1] + S.substitution_cost(a[i - 1], b[j - 1]))
    return d[-1][-1]


def test_weighted_distance_and_ratio_on_random_words(spark):
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("абвгдеклмн") for _ in range(rng.randint(0, 8))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", S.weighted_levenshtein("a", "b").alias("d"), S.weighted_levenshtein("b", "a").alias("e"), F.levenshtein("a", "b").alias("u"), S.indel_ratio("a", "b").alias("r"), S.ratio_bound(F.col("a"), F.col("b")).alias("most")).collect()
    for r in rows:
        assert r["d"] == plain_distance(r["a"], r["b"]) == r["e"]
        assert r["u"] <= r["d"] and 2 * abs(len(r["a"]) - len(r["b"])) <= r["d"]
        assert 0 <= r["r"] <= r["most"] + 1e-9


def test_normalising_twice_changes_nothing(spark):
    texts = ["  Шины 205/55 R16!! ", "hp  Принтар", "a b", "", "ЁЛКА", "%_'", "x-y / z."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize_query("t").alias("once"))
    assert all(r[0] == r[1] for r in df.select("once", X.normalize_query("once")).collect())


def test_words_with_places_and_whole_word_replacement(spark):
    row = spark.range(1).select(X.extract_words(L("тел3фон и экр@н")).alias("w"), X.safe_replace(L("кот котик КОТ a.c abc"), L("кот"), L("пёс")).alias("r"), X.safe_replace(L("a.c abc"), L("a.c"), L("\\1")).alias("q")).first()
    assert [(w["word"], w["start"], w["end"]) for w in row["w"]] == [("тел3фон", 0, 7), ("и", 8, 9), ("экр@н", 10, 15)]
    assert row["r"] == "пёс котик пёс a.c abc" and row["q"] == "\\1 abc"


def test_unknown_choices_are_errors():
    with pytest.raises(ValueError):
        S.phonetic_key(L("a"), "other")
    with pytest.raises(ValueError):
        X.normalize_query(L("a"), "other")


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_similarities_clean_a_text_once_a_row(spark):
    rows = spark.createDataFrame([("a", "b")], "title string, body string")
    assert plan(rows.select(S.trigrams("body").alias("x"))).count("regexp_replace") == 1
    body = F.regexp_replace("body", "<[^>]+>", " ")
    assert plan(rows.select(S.relevance(L("blue widget"), F.col("title"), body).alias("x"))).count("<[^>]+>") == 1
    cosine = S.cosine(S.trigrams(L("blue widget")), S.trigrams(body))
    assert plan(rows.select(cosine.alias("x"))).count("<[^>]+>") == 1


def test_completeness_score_makes_no_grams(spark, sf_small):
    from offerlake.plans import catalogue

    assert "lambda" not in plan(catalogue.QUERIES["completeness_score"](spark, sf_small))


def test_cosine_of_texts_with_repeats(spark):
    from collections import Counter

    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("aб 𝒳") for _ in range(rng.randint(0, 30))).strip() for _ in "ab") for _ in range(200)]
    pairs += [("aaaaaaa", "aaaa"), ("", "aaa"), ("ab", "ab"), ("𝒳𝒳", "𝒳𝒳𝒳")]

    def grams(t):
        return Counter(t[i : i + 3] for i in range(max(len(t) - 2, 1))) if t else Counter()

    def expected(a, b):
        a, b = (grams(" ".join(t.split())) for t in (a, b))
        norm = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
        return sum(n * b[x] for x, n in a.items()) / norm if norm else 0.0

    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", S.cosine(S.trigrams("a"), S.trigrams("b")).alias("c"), S.square_norm(S.trigrams("a")).alias("n")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["c"] == pytest.approx(expected(r["a"], r["b"]))
        assert r["n"] == sum(n * n for n in grams(" ".join(r["a"].split())).values())
