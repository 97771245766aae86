"""Spelling correction over tables: distinct words, candidate joins, weighted distances, the best of each word, texts rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.functions import similarity as S
from offerlake.functions import text as X

MAX_DISTANCE, BAND, TOP_GRAMS, CUTOFF = 5.0, 3, 50, 82.0


def dictionary(words: DataFrame, column: str = "word") -> DataFrame:
    return words.select(F.lower(F.trim(X.text(column))).alias("word")).filter("word != ''").distinct()


def gram_index(words: DataFrame) -> DataFrame:
    """Postings of bigrams: gram and word."""
    return words.select("word", F.explode(S.bigrams("word")).alias("gram"))


def phonetic_index(words: DataFrame, algorithm: str = "combined") -> DataFrame:
    return words.groupBy(S.phonetic_key("word", algorithm).alias("key")).agg(F.array_sort(F.collect_set("word")).alias("words"))


def gram_candidates(words: DataFrame, known: DataFrame, most: int = TOP_GRAMS) -> DataFrame:
    """word, candidate and shared bigrams: those with the most, ties by candidate."""
    left, right = gram_index(words), gram_index(known).withColumnRenamed("word", "candidate")
    shared = left.join(right, "gram").groupBy("word", "candidate").agg(F.count(F.lit(1)).alias("shared"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("shared"), "candidate"))
    return shared.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def phonetic_candidates(words: DataFrame, known: DataFrame, algorithm: str = "combined") -> DataFrame:
    key = S.phonetic_key("word", algorithm)
    return words.withColumn("key", key).join(known.select(F.col("word").alias("candidate"), key.alias("key")), "key").select("word", "candidate")


def length_band(words: DataFrame, known: DataFrame, band: int = BAND) -> DataFrame:
    """Pairs whose lengths differ by the band at most, as an equi-join on every length in reach."""
    near = words.withColumn("size", F.explode(F.sequence(F.length("word") - band, F.length("word") + band)))
    return near.join(known.select(F.col("word").alias("candidate"), F.length("word").alias("size")), "size").select("word", "candidate")


def candidates(words: DataFrame, known: DataFrame, band: int = BAND) -> DataFrame:
    """What shares bigrams, sound or about the length, each pair once."""
    parts = gram_candidates(words, known).select("word", "candidate"), phonetic_candidates(words, known), length_band(words, known, band)
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def ranked(words: DataFrame, known: DataFrame, k: int = 1, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The k best candidates of each word within twice the distance, least score first, ties by candidate.

    Plain edits and lengths bound the weighted distance from below, so most pairs never reach the UDF.
    """
    most = 2 * max_distance
    pairs = candidates(words, known).filter((F.levenshtein("word", "candidate", int(most)) >= 0) & (2 * F.abs(F.length("word") - F.length("candidate")) <= most))
    measured = pairs.withColumn("distance", S.weighted_levenshtein("word", "candidate")).filter(F.col("distance") <= most)
    scored = measured.withColumn("score", S.candidate_score(F.col("distance"), "word", "candidate"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("score", "candidate"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


_PIECES = r"(?U)\p{IsCyrillic}[\w@#$%&*]*|[^\p{IsCyrillic}]+"


def split_words(c: Column | str) -> Column:
    """A text in pieces, words and what stands between, that together are the text."""
    return F.regexp_extract_all(X.text(c), F.lit(_PIECES), F.lit(0))


def correct(texts: DataFrame, known: DataFrame, max_distance: float = MAX_DISTANCE, text: str = "text") -> DataFrame:
    """texts with ``corrected`` and ``was_corrected``: words that aren't known are replaced by their best candidate.

    Case is kept (a known word in mixed case gets that of its first letter), each word is corrected once however often it stands in the corpus, and texts are rebuilt by place.
    """
    keyed = texts.withColumn("__row", F.xxhash64(X.text(text)))
    pieces = keyed.select("__row", text).dropDuplicates(["__row"]).select("__row", F.posexplode(split_words(text)).alias("at", "piece"))
    plain = F.when(F.col("piece").rlike(r"^\p{IsCyrillic}"), X.digits_to_letters("piece"))
    pieces = pieces.withColumn("word", plain)
    unknown = pieces.select("word").filter("word is not null and length(word) > 1").distinct().join(known, "word", "left_anti")
    best = ranked(unknown, known, 1, max_distance).select("word", "candidate")
    fixed = pieces.join(best, "word", "left").join(known.select("word", F.lit(True).alias("__known")), "word", "left")
    changed = F.coalesce(F.col("candidate"), F.when(F.col("__known") | (F.col("word") != F.lower("piece")), F.col("word")))
    new = F.when(changed.isNull(), F.col("piece")).otherwise(X.preserve_capitalization("piece", changed))
    whole = fixed.groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))), lambda p: p["new"]), "").alias("corrected"))
    out = keyed.join(whole, "__row", "left").drop("__row").withColumn("corrected", F.coalesce("corrected", X.text(text)))
    return out.withColumn("was_corrected", F.col("corrected") != X.text(text))


def topk_texts(words: DataFrame, known: DataFrame, k: int, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """word and its k candidates in order; a known word has itself."""
    found = ranked(words.join(known, "word", "left_anti"), known, k, max_distance)
    listed = found.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    return words.distinct().join(listed, "word", "left").withColumn("candidates", F.coalesce("candidates", F.array("word")))


def fuzzy_best(words: DataFrame, terms: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """word and the term most like it by ratio, at least at the cutoff; of equals the first by ordinal.

    A length band follows from the cutoff, so the join is on lengths in reach.
    """
    share = cutoff / (200 - cutoff)
    near = words.distinct().withColumn("size", F.explode(F.sequence(F.ceil(F.length("word") * share).cast("int"), F.floor(F.length("word") / share).cast("int"))))
    pairs = near.join(terms.select("term", "ordinal", F.length("term").alias("size")), "size")
    measured = pairs.withColumn("ratio", S.indel_ratio("word", "term")).filter(F.col("ratio") >= cutoff)
    return measured.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("ratio"), "ordinal"))).filter("n = 1").select("word", "term", "ratio")


def fast_path(queries: DataFrame, typos: DataFrame, terms: DataFrame, canonical: DataFrame, query: str = "query", compat: bool = False) -> DataFrame:
    """queries with ``corrected`` and ``was_corrected``: layout and size, whole-query typos, then words by fuzzy ratio.

    typos: typo, right; terms: term, ordinal; canonical: synonym, term. compat leaves a typo that is itself a known term as
    it is; else a match that is a typo is put right, too.
    """
    base = queries.withColumn("__q", X.tire_variant(X.normalize_guarded(query))).withColumn("__id", F.xxhash64("__q"))
    whole = base.join(F.broadcast(typos.select(F.col("typo").alias("__q"), F.col("right").alias("__whole"))), "__q", "left")
    pieces = base.select("__id", "__q").dropDuplicates(["__id"]).select("__id", F.posexplode(F.split("__q", " ")).alias("at", "word"))
    best = fuzzy_best(pieces.filter(F.length("word") > 3).select("word"), terms)
    best = best.join(canonical.select(F.col("synonym").alias("term"), F.col("term").alias("__canon")), "term", "left").withColumn("fixed", F.coalesce("__canon", "term"))
    if not compat:
        best = best.join(typos.select(F.col("typo").alias("fixed"), F.col("right").alias("__right")), "fixed", "left").withColumn("fixed", F.coalesce("__right", "fixed"))
    words = pieces.join(best.select("word", "fixed"), "word", "left")
    joined = words.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "word").alias("w")))), lambda p: p["w"]), " ").alias("__words"))
    out = whole.join(joined, "__id", "left").withColumn("corrected", F.coalesce("__whole", "__words", "__q"))
    return out.withColumn("was_corrected", F.col("corrected") != F.col("__q")).select(*queries.columns, "corrected", "was_corrected")


def process(queries: DataFrame, typos: DataFrame, terms: DataFrame, canonical: DataFrame, synonyms: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The record of a query: corrected text, variants, synonyms in use and category; what the fast path leaves goes to known."""
    from offerlake.operators import expand

    out = fast_path(queries, typos, terms, canonical)
    if known is not None:
        again = correct(out.filter(~F.col("was_corrected")).select("query").distinct(), known, text="query").select("query", F.col("corrected").alias("__slow"))
        out = out.join(again, "query", "left").withColumn("corrected", F.when(F.col("was_corrected"), F.col("corrected")).otherwise(F.coalesce("__slow", "corrected")))
        out = out.withColumn("was_corrected", F.col("was_corrected") | (F.col("corrected") != F.lower("query"))).drop("__slow")
    variants = expand.query_variants(out.select("corrected").distinct(), synonyms, "corrected")
    return out.join(variants, "corrected", "left").withColumn("primary_query", F.col("corrected")).withColumn("category", X.category("corrected"))


def learn(texts: DataFrame, known: DataFrame, column: str = "corrected", least: int = 3) -> DataFrame:
    """Words of corrected texts that the dictionary lacks; appending them is the caller's choice."""
    words = texts.select(F.explode(X.fts_tokens(column)).alias("word")).filter(F.length("word") >= least).distinct()
    return words.join(known, "word", "left_anti")


def metrics(rows: DataFrame, original: str = "original", corrected: str = "corrected", expected: str = "expected", by: list[str] | None = None) -> DataFrame:
    """total, tp, fp, fn, precision, recall, f1 and accuracy; 0 where a denominator is."""
    o, c, e = (X.text(x) for x in (original, corrected, expected))
    tp, fp, fn = (o != e) & (c == e), (c != e) & (c != o), (o != e) & (c == o)
    counts = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(tp).alias("tp"), F.count_if(fp | ((o == e) & (c != o))).alias("fp"), F.count_if(fn).alias("fn"),
        F.round(F.avg((F.lower(F.trim(c)) == F.lower(F.trim(e))).cast("double")), 4).alias("accuracy"),
    )
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumn("precision", F.round(share(F.col("tp"), F.col("tp") + F.col("fp")), 4)).withColumn("recall", F.round(share(F.col("tp"), F.col("tp") + F.col("fn")), 4))
    return out.withColumn("f1", F.round(share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 4))


def noise(texts: DataFrame, seed: int = 1, column: str = "text", deletion: float = 0.1, masking: float = 0.3) -> DataFrame:
    """Noisy copies for training: words deleted or masked and sentences shuffled, by hashes of the seed, text and place."""
    chance = lambda key, salt, i: F.pmod(F.xxhash64(key, F.lit(salt), i), F.lit(10_000)) / 10_000.0

    def of(v: Column) -> Column:
        kept = F.filter(v["words"], lambda w, i: chance(v["key"], "drop", i) >= deletion)
        masked = F.transform(kept, lambda w, i: F.when(chance(v["key"], "mask", F.floor(i / 3)) < masking, F.lit("<mask>")).otherwise(w))
        merged = F.regexp_replace(F.array_join(masked, " "), "<mask>(?: <mask>)+", "<mask>")
        sentences = F.transform(F.split(merged, r"(?<=[.!?]) "), lambda s, i: F.struct(F.xxhash64(v["key"], s, i).alias("k"), s.alias("s")))
        return F.array_join(F.transform(F.array_sort(sentences), lambda x: x["s"]), " ")

    return texts.withColumn("noisy", X.let(of, key=F.xxhash64(F.lit(seed), F.col(column)), words=F.split(X.text(column), " ")))
