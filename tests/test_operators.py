"""Spelling, expansion, full text, crawling, vectors and offers on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from offerlake.engine import Search, Speller, suggest
from offerlake.functions import markup
from offerlake.operators import expand, fulltext, offers, spell, tables, vectors
from offerlake.sources import dictionaries, payloads

KNOWN = "телефон компьютер мышь наушники ноутбук клавиатура экран зарядка планшет смартфон принтер сканер роутер для игр монитор".split()
CASES = [("тлефон", "телефон"), ("Тлефон", "Телефон"), ("КОМПЬТЕР", "КОМПЬЮТЕР"), ("мыш", "мышь"), ("НаУшНиКи", "Наушники"), ("наушнеки для игр", "наушники для игр"), ("тел3фон", "телефон"), ("экр@н!", "экран!"), ("роутре", "роутер"), ("ноутбук", "ноутбук"), ("", ""), ("монитор 24 дюйма", "монитор 24 дюйма")]


@pytest.fixture(scope="module")
def known(spark):
    return spell.dictionary(spark.createDataFrame([(w,) for w in [*KNOWN, " Дюйма ", "", None]], "word string"))


def test_correction(spark, known):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES)], "id int, text string, expected string")
    out = Speller(known).correct(rows).collect()
    assert {r["id"]: r["corrected"] for r in out} == {i: b for i, (_, b) in enumerate(CASES)}
    assert {r["id"] for r in out if not r["was_corrected"]} == {9, 10, 11}


def test_evaluation_and_metrics(spark, known):
    data = spark.createDataFrame([*CASES[:4], ("мышь", "клавиатура")], "typo string, expected string")
    row = Speller(known).evaluate(data).first()
    assert (row["total"], row["tp"], row["fn"], row["fp"]) == (5, 4, 1, 0) and row["precision"] == 1.0 and row["recall"] == 0.8
    same = spark.createDataFrame([("a", "a", "a"), ("a", "b", "a")], "original string, corrected string, expected string")
    assert spell.metrics(same).select("total", "tp", "fp", "fn", "f1").first() == (2, 0, 1, 0, 0.0)


def test_candidates_and_topk(spark, known):
    words = spark.createDataFrame([("тлефон",), ("мышь",)], "word string")
    top = {r["word"]: r["candidates"] for r in Speller(known).topk(words, 3).collect()}
    assert top["мышь"] == ["мышь"] and top["тлефон"][0] == "телефон" and len(top["тлефон"]) <= 3
    pairs = spell.length_band(words, known, 1).collect()
    assert {(p["word"], p["candidate"]) for p in pairs} == {(w["word"], k["word"]) for w in words.collect() for k in known.collect() if abs(len(w["word"]) - len(k["word"])) <= 1}
    assert spell.learn(spark.createDataFrame([("новое слово мышь",)], "corrected string"), known).count() == 2
    assert spell.phonetic_index(known).count() > 5


def test_fast_path_and_record(spark, known):
    typos = spark.createDataFrame([("нотбук", "ноутбук"), ("беспроводная мышь", "мышь беспроводная")], "typo string, right string")
    names = ["нотбук", "ноутбук", "принтер", "laptop"]
    terms = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "term string, ordinal int")
    canonical = spark.createDataFrame([("laptop", "ноутбук")], "synonym string, term string")
    synonyms = spark.createDataFrame([("ноутбук", "laptop", 1.0, 0)], "term string, synonym string, weight double, ordinal int")
    q = spark.createDataFrame([("нотбук",), ("Беспроводная  мышь",), ("принтерр hp",), ("laptopp",), ("тлефон",)], "query string")
    out = {r["query"]: r for r in spell.process(q, typos, terms, canonical, synonyms, known).collect()}
    assert out["нотбук"]["corrected"] == "ноутбук" and "laptop" in out["нотбук"]["search_variants"]
    assert out["Беспроводная  мышь"]["corrected"] == "мышь беспроводная"
    assert out["принтерр hp"]["corrected"] == "принтер hp" and out["принтерр hp"]["category"] == "office_tech"
    assert out["laptopp"]["corrected"] == "ноутбук" and out["тлефон"]["corrected"] == "телефон"
    compat = {r["query"]: r["corrected"] for r in spell.fast_path(spark.createDataFrame([("нотбукк",)], "query string"), typos, terms, canonical, compat=True).collect()}
    assert compat["нотбукк"] in ("нотбук", "ноутбук")


SYNONYMS = [("ноутбук", "laptop", 0.9, 0), ("ноутбук", "лэптоп", 0.8, 1), ("игровой ноутбук", "gaming laptop", 1.0, 2)]


@pytest.fixture(scope="module")
def synonyms(spark):
    return spark.createDataFrame(SYNONYMS, "term string, synonym string, weight double, ordinal int")


def test_expansion(spark, synonyms):
    q = spark.createDataFrame([("ноутбук asus",), ("",)], "query string")
    out = {r["query"]: r for r in expand.expand(q, synonyms).collect()}
    row = out["ноутбук asus"]
    assert row["variants"] == ["ноутбук asus", "laptop asus", "лэптоп asus"] and row["boolean_query"] == "(ноутбук OR laptop OR лэптоп) AND asus"
    assert out[""]["variants"] == [] and out[""]["boolean_query"] == ""
    groups = F.array(F.array(F.lit("a%"), F.lit("b'c")), F.array(F.lit("d e")))
    like, elastic = spark.range(1).select(expand.as_like(groups, "t"), expand.as_elastic(groups)).first()
    assert like == "(t LIKE '%a!%%' ESCAPE '!' OR t LIKE '%b''c%' ESCAPE '!') AND (t LIKE '%d e%' ESCAPE '!')" and elastic.startswith('{"query":{"bool":{"must":[{"bool":{"should":[{"match":{"text":"a%"}}')
    many = F.array(*[F.array(*[F.lit(f"{c}{i}") for i in range(9)]) for c in "abcd"])
    listed = spark.range(1).select(expand.combinations(many, 11)).first()[0]
    assert listed[0] == "a0 b0 c0 d0" and listed[9] == "a0 b0 c1 d0" and len(listed) == 11
    with pytest.raises(ValueError):
        dictionaries.exported(q, "other")


def test_phrases_variants_and_maintenance(spark, synonyms):
    table = spark.createDataFrame([("игровой ноутбук",), ("ноутбук",), ("бук",)], "phrase string")
    found = expand.phrases(spark.createDataFrame([("купить Игровой ноутбук!",)], "query string"), table).collect()
    assert [r["phrase"] for r in found] == ["игровой ноутбук"]
    v = expand.query_variants(spark.createDataFrame([("шины 205/55 R16",), ("laptop hp",)], "query string"), synonyms)
    rows = {r["query"]: r["search_variants"] for r in v.collect()}
    assert rows["laptop hp"] == ["laptop hp", "ноутбук hp"] and len(rows["шины 205/55 R16"]) == 3
    both = expand.bidirectional(synonyms)
    assert both.count() == 6
    more = expand.add_pairs(both, spark.createDataFrame([("a", "b", 0.5)], "term string, synonym string, weight double"))
    assert more.count() == 8 and expand.remove_pairs(more, spark.createDataFrame([("b", "a")], "term string, synonym string")).count() == 6
    assert [r["term"] for r in suggest(spark.createDataFrame([("Бук", 1), ("куб", 0), ("ноутбук", 2)], "term string, ordinal int"), "БУК").collect()] == ["Бук", "ноутбук"]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "red fox", "a"), (2, "Red dog red", "b"), (3, "café dog", "b"), (4, None, "a")], "id int, text string, category string")
    assert [r["id"] for r in fulltext.search(docs, "red", "id", ["text"], 5).collect()] == [2, 1]
    assert [r["id"] for r in fulltext.search(docs, "RED dog", "id", ["text"], 5, "b").collect()] == [2]
    assert [r["id"] for r in fulltext.search(docs, "cafe", "id", ["text"], 5, "general").collect()] == [3]
    assert fulltext.contains_all(docs, "dog caf", ["text"]).count() == 1
    index = fulltext.postings(docs, "id", ["text"])
    changed = spark.createDataFrame([(1, "blue fox", "a")], "id int, text string, category string")
    new = fulltext.refresh(index, changed, spark.createDataFrame([(3,)], "id int"), "id", ["text"])
    assert {(r["token"], r["id"], r["tf"]) for r in new.collect()} == {("blue", 1, 1), ("fox", 1, 1), ("red", 2, 2), ("dog", 2, 1)}


PAGE = "<html><head><title>T</title>{head}</head><body><h1>Cool thing</h1>{body}" + "<p>pad</p>" * 40 + "</body></html>"
LD = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Ld thing","brand":{"name":"B"},"offers":[{"price":"1 299,50"}],"additionalProperty":[{"name":"Size","value":"5"}]}]}</script>'


@pytest.mark.parametrize(
    "head, body, how, title, price",
    [
        (LD, "", "json-ld", "Ld thing", 1299.5),
        (LD.replace('"offers":[{"price":"1 299,50"}],', ""), "", "json-ld", "Ld thing", None),
        ("", '<div itemtype="http://schema.org/Product"><span itemprop="name">Micro</span><meta itemprop="price" content="77"></div>', "microdata", "Micro", 77.0),
        ('<meta property="og:title" content="Og"><meta content="5" property="product:price:amount">', "", "opengraph", "Og", 5.0),
        ("", "<p>Цена 12 990 ₽</p><img src='/main.jpg'>", "heuristic", "Cool thing", 12990.0),
    ],
)
def test_extraction_cascade(head, body, how, title, price):
    out = markup.extract("http://a", PAGE.format(head=head, body=body))
    assert (out["how"], out["title"], out["price"]) == (how, title, price)


def test_extraction_of_nothing_and_json_walks(spark):
    assert markup.extract("u", "short") is None and markup.load("{") is None
    assert markup.characteristics({"specs": {"a": 1, "b": ""}, "x": [{"name": "a", "value": 2}, {"name": "c", "value": "d"}]}) == {"a": "1", "c": "d"}
    markup.register(spark)
    assert spark.sql("""SELECT count(*) FROM json_walk('{"a": [{"b": 1}, {"c": {"d": 2}}]}', 5, 1)""").first()[0] == 2
    assert [r["url"] for r in spark.sql("""SELECT url FROM html_links('<a href="/x#1">t</a><a href="/x">u</a>', 'http://a.b/c')""").collect()] == ["http://a.b/x"]


def test_maps_and_geo(spark):
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    geo = markup.default_geo(F.lit("Москва"))
    over = F.struct(*[F.lit("X" if k == "city" else "").alias(k) for k in markup.GEO], F.lit(1.0).alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    row = spark.range(1).select(
        markup.first_wins(F.array(entry("a", "1"), entry("a", "2"), entry("b", ""))).alias("first"), markup.last_wins(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit(""))).alias("last"),
        markup.merge_geo(geo, over).alias("geo"), markup.city(F.lit("г. Москва, ул. Мира, д. 5")).alias("city"), markup.coordinates(F.lit('"lat": 55.7, "lon": 37.6')).alias("at"), markup.product_payload(F.lit('{"price":1,"sku":2}')).alias("p"),
    ).first()
    assert row["first"] == {"a": "1"} and row["last"] == {"a": "2"} and row["geo"]["city"] == "X" and row["geo"]["detectedRegion"] == "Москва" and row["geo"]["latitude"] == 1.0
    assert row["city"] == "Москва" and (row["at"]["latitude"], row["at"]["longitude"]) == (55.7, 37.6) and row["p"]


def test_geo_and_details_of_pages(spark):
    payload = '{"store":{"city":"Тверь","address":{"name":"ул. Мира, 5"},"lat":"56.8","lng":35.9},"city":"Клин"}'
    html = '<meta name="description" content="D"><div class="breadcrumb">Home</div><img src="/a.jpg"><img src="/a.jpg"><table><tr><td>Size</td><td>5</td></tr></table><p>Weight: 2 kg</p>'
    row = spark.range(1).select(markup.json_geo(F.lit(payload)).alias("g"), markup.page_details(F.lit("http://x.y/z"), F.lit(html)).alias("d"), markup.json_geo(F.lit("{")).alias("none")).first()
    assert (row["g"]["city"], row["g"]["storeAddress"], row["g"]["latitude"], row["g"]["longitude"]) == ("Клин", "ул. Мира, 5", 56.8, 35.9)
    assert row["none"]["city"] == "" and row["none"]["latitude"] is None
    assert row["d"]["images"] == ["http://x.y/a.jpg"] and row["d"]["breadcrumbs"] == ["Home"] and row["d"]["description"] == "D" and row["d"]["specs"] == {"Size": "5", "Weight": "2 kg"}


def test_a_model_goes_before_the_dictionary(spark, known):
    texts = spark.createDataFrame([("запрос", ), ("тлефон",)], "text string")
    model = lambda df: df.withColumn("suggested", F.when(F.col("text") == "запрос", F.lit("мыш")))
    out = {r["text"]: (r["corrected"], r["was_corrected"]) for r in Speller(known, model=model).correct(texts).collect()}
    assert out == {"запрос": ("мышь", True), "тлефон": ("телефон", True)}


def test_market_payloads(spark):
    wb = '{"data":{"products":[{"id":14400001,"name":"Шина","brand":"B","feedbacks":3,"sizes":[{"price":null},{"price":{"total":0,"product":499900}}]},{"id":2,"name":"N","brand":null,"salePriceU":1000}]}}'
    rows = payloads.wildberries(spark.createDataFrame([("p", wb), ("q", "{broken")], "path string, json string")).orderBy("ordinal").collect()
    assert [(r["title"], r["price"], r["reviewsCount"]) for r in rows] == [("B Шина", 4999.0, 3), ("N", 10.0, 0)] and "basket-02" in rows[0]["images"][0]
    other = '{"w":[{"title":"T","link":"/product/t-1","price":"1 990 ₽"},{"title":"no link"},{"name":"Named","id":"7"}]}'
    df = spark.createDataFrame([(other,), (None,)], "json string")
    assert [(r["title"], r["url"], r["price"]) for r in payloads.ozon(df).collect()] == [("T", "https://www.ozon.ru/product/t-1", 1990.0)]
    assert {r["title"] for r in payloads.yandex_market(df).collect()} == {"T", "Named"}
    card = '{"description":"d","grouped_options":[{"options":[{"name":"a","value":"1"},{"name":"a","value":"2"}]}]}'
    assert payloads.card_details(spark.createDataFrame([(card,)], "json string")).first()["characteristics"] == {"a": "1"}
    assert spark.range(1).select(payloads.shard(F.lit(1)), payloads.shard(F.lit(999_999_999)), payloads.region_code(F.lit("нигде"))).first() == (1, 18, -1257786)
    fetched = payloads.usable(spark.createDataFrame([(200, "ok", None), (403, "", None), (429, "", None), (200, "Captcha", None)], "status_code int, text string, error string"))
    assert [(r["blocked"], r["retry"], r["usable"]) for r in fetched.collect()] == [(False, False, True), (True, False, False), (True, True, False), (True, False, False)]
    pages = spark.createDataFrame([(f"http://h{h}.x/{i}", PAGE.format(head="", body="<p>99 руб</p>")) for h in range(2) for i in range(3)], "url string, html string")
    assert payloads.shop_pages(pages, 2).count() == 4


def test_dictionaries_and_settings(spark, tmp_path, synonyms, known):
    (tmp_path / "s.json").write_text('{"A": ["x", "y"], "b": [{"word": "z", "weight": 0.5}], "c": {"w": 0.25}}')
    got = {(r["term"], r["synonym"], r["weight"]) for r in dictionaries.read_synonyms(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("a", "x", 1.0), ("a", "y", 1.0), ("b", "z", 0.5), ("c", "w", 0.25)}
    (tmp_path / "s.csv").write_text("a, b,,c\nonly\n")
    assert {(r["term"], r["synonym"]) for r in dictionaries.read_synonyms_csv(spark, str(tmp_path / "s.csv")).collect()} == {("a", "b"), ("a", "c")}
    dictionaries.write_dictionary(known, str(tmp_path / "d"))
    assert dictionaries.read_dictionary(spark, str(tmp_path / "d")).count() == known.count()
    dictionaries.write_synonyms(synonyms, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    dictionaries.append_metrics(spark.createDataFrame([("a", "b", None)], "original string, corrected string, expected string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    assert dictionaries.config({"spell": {"band": 2}})["spell"]["band"] == 2 and dictionaries.config()["spell"]["band"] == 3


def test_crawls(spark):
    xml = lambda *urls: "<x>" + "".join(f"<loc> {u} </loc>" for u in urls) + "</x>"
    maps = spark.createDataFrame([("r.xml", xml("a.xml", "p1")), ("a.xml", xml("r.xml", "p1", "p2"))], "url string, xml string")
    assert {(r["url"], r["depth"]) for r in tables.sitemap_urls(maps, ["r.xml"]).collect()} == {("p1", 0), ("p2", 1)}
    assert tables.robots_sitemaps(spark.createDataFrame([("h", "User-agent: *\nSitemap: http://h/s.xml")], "host string, body string")).first()["url"] == "http://h/s.xml"
    start = "http://s.x/catalog"
    pages = [(start, '<a href="/product/1">a</a><a href="http://other.y/product/3">b</a><a href="/product/2">c</a>')] + [(f"http://s.x/product/{i}", PAGE.format(head="", body=f"<p>{i}00 руб</p>")) for i in (1, 2)]
    found = tables.crawl(spark.createDataFrame([("s.x", start)], "domain string, catalog_url string"), spark.createDataFrame(pages, "url string, html string"), 1).collect()
    assert [(r["url"], r["price"]) for r in found] == [("http://s.x/product/1", 100.0)]
    hosts = spark.createDataFrame([("tires", "t.x"), ("office", "o.x")], "category string, host string")
    q = spark.createDataFrame([("a", "office"), ("b", "nothing")], "query string, category string")
    assert {(r["query"], r["host"]) for r in tables.category_hosts(q, hosts).collect()} == {("a", "o.x"), ("b", "t.x")}
    rules = spark.createDataFrame([("h", ["Brand: (\\w+)"], [], "Shop")], "host string, brand_patterns array<string>, seller_patterns array<string>, seller string")
    assert tables.adapter_fields(spark.createDataFrame([("h", "Brand: Acme")], "host string, text string"), rules).select("brand", "seller_found").first() == ("Acme", "Shop")


def test_offers(spark):
    rows = [("wildberries", "red widget", "u1", 0.0, ["a"], "b"), ("ozon", "red widget", "u2", 10.0, [], ""), ("ozon", "", "u3", 5.0, None, None), ("ozon", "nothing alike", "u4", 5.0, ["z"], "")]
    df = spark.createDataFrame(rows, "source string, title string, url string, price double, images array<string>, mainImage string")
    top, groups, summary = Search(df)("red widget", limit=99)
    assert {r["url"] for r in top.collect()} == {"u1", "u2"}
    assert [(r["source"], r["status"]) for r in groups.orderBy("ordinal").collect()] == [("wildberries", "ok"), ("ozon", "ok"), ("yandex_market", "empty"), ("runet", "empty")]
    assert groups.filter("source = 'wildberries'").first()["min_price"] == 0.0 and summary.first()["max_price"] == 10.0
    said = spark.createDataFrame([("runet", "blocked")], "source string, status string")
    assert offers.source_groups(top, said).filter("source = 'runet'").first()["status"] == "blocked"
    assert [(r["images"], r["mainImage"]) for r in offers.canonical(df).orderBy("url").collect()] == [(["b", "a"], "b"), ([], ""), ([], ""), (["z"], "z")]
    assert "link" in offers.wire(df).columns and offers.clamp_limit(99) == 30 and offers.clamp_limit(None) == 10
    assert [r["ordinal"] for r in offers.union_sources([df.limit(1), df.limit(1)]).collect()] == [0, 1]
    with pytest.raises(ValueError):
        Search(df)("x")


def test_upsert_and_running_total(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "url string, at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "url string, at int, v string")
    assert {(r["url"], r["v"]) for r in tables.upsert(old, new, "url", [F.desc("at")]).collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    rows = spark.createDataFrame([(i, 4) for i in range(5)], "i int, n int")
    assert tables.until_total(rows, "n", 10, [F.col("i")]).count() == 3


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_nearest_vectors_against_brute_force(spark, block_bytes):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(80)]
    rows += [(80 + i, rows[0][1]) for i in range(40)] + [(200, [0.0] * 3), (201, None), (202, [1.0]), (None, [1.0] * 3), (203, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got = vectors.nearest(df, df.filter("vec_id % 20 = 0"), 7, block_bytes=block_bytes).collect()
    good = [(i, v) for i, v in spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").collect() if i is not None and v and len(v) == 3 and None not in v]

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 9) if norm else 0.0

    expected = {(q, i) for q, v in good if q % 20 == 0 for _, i in sorted((-cosine(v, w), i) for i, w in good)[:7]}
    assert {(r["query_id"], r["vec_id"]) for r in got} == expected and len(got) == len(expected)
    assert vectors.nearest(df, df.limit(0), 7).count() == 0
