import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from offerlake.llm import columnar as C
from offerlake.llm import simhash as S


def prints(texts):
    data, off = C.utf8(pa.array([t.lower() for t in texts]))
    rows, bits = S.prints(data, off)
    return rows, bits.view(np.uint64)


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_votes_are_those_of_each_word():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (1, 3, 254, 255, 256, 700)]
    rows, bits = prints(["", *texts])
    assert rows.tolist() == [1, 2, 3, 4, 5, 6]
    votes = S._votes().view(np.uint8).reshape(1 << 16, S.BITS)
    for text, got in zip(texts, bits, strict=True):
        words = sorted(set(text.split()))
        data, off = C.utf8(pa.array(words))
        hashed = C.hashes(data, off[:-1], off[1:])
        total = votes[((hashed >> np.uint64(24)) & np.uint64(0xFFFF)).astype(int)].astype(int).sum(axis=0)
        assert (np.unpackbits(got.view(np.uint8), bitorder="little") == (2 * total > len(words))).all()


def test_manhattan_of_counts_is_a_lower_bound():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, (80, 4), dtype=np.int64).view(np.uint64)
    c = S.counts(np.ascontiguousarray(x).view(np.uint8))
    m = np.abs(c[:, None] - c[None]).sum(axis=2)
    assert (m == S.manhattan(S.embed(x)[:, None], S.embed(x)[None])).all()
    assert (m <= S.hamming(x[:, None], x[None])).all()


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    for _ in range(25):
        n = int(rng.integers(1, 400))
        x = rng.integers(0, 2**63, (5, 4), dtype=np.int64).view(np.uint64)[rng.integers(0, 5, n)]
        for _ in range(int(rng.integers(0, 25))):
            x = x ^ ((np.uint64(1) << rng.integers(0, 64, (n, 4), dtype=np.uint64)) * rng.integers(0, 2, (n, 4), dtype=np.uint64))
        limit = int(rng.integers(5, 60))
        a, b = S.link(x, limit)
        assert (S.hamming(x[a], x[b]) <= limit).all() and len(a) < n
        near = (S.hamming(x[:, None], x[None]) <= limit) & (np.arange(n)[:, None] < np.arange(n))
        assert roots(n, zip(a, b, strict=True)) == roots(n, zip(*np.nonzero(near), strict=True))


def test_components_of_random_and_long_graphs(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (40, 60), (26, -1)):
        pairs = [(i, i + 1) for i in range(n - 1)] if m < 0 else [tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)]
        expected = roots(n, pairs)
        got = dict(map(tuple, S.components(spark.createDataFrame(sorted(set(pairs)), "a bigint, b bigint")).collect()))
        assert got == {i: expected[i] for i in {x for p in pairs for x in p}}
    assert S.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_against_all_pairs_on_the_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    at, bits = prints([r["text"] for r in rows])
    near = np.argwhere(np.triu(S.hamming(bits[:, None], bits[None]) <= S.LIMIT, 1))
    expected = roots(len(rows), [(at[a], at[b]) for a, b in near])
    got = {r["doc_id"]: r["group_id"] for r in S.groups(docs).collect()}
    same = [got.get(rows[at[a]]["doc_id"]) == got.get(rows[at[b]]["doc_id"], -1) for a, b in near]
    assert len(same) > 5 and np.mean(same) >= 0.9
    size = {r: expected.count(r) for r in expected}
    assert all(size[expected[k]] > 1 for k, r in enumerate(rows) if r["doc_id"] in got)


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_copies_and_near_copies_form_groups_and_others_none(documents):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(edited(rng, b, 0.04)) for b in base[:6]] + [texts[7]] * 70
    out = {r["doc_id"]: (r["group_id"], r["group_size"]) for r in S.groups(documents(texts)).collect()}
    assert out == {i: (i % 12, 2) for i in [*range(6), *range(12, 18)]} | {i: (7, 71) for i in [7, *range(18, 88)]}
    assert sorted(r["doc_id"] for r in S.dedup(documents(texts)).collect()) == list(range(12))


def test_awkward_rows(awkward, nothing):
    assert {(r["doc_id"], r["group_id"], r["group_size"]) for r in S.groups(awkward).collect()} == {(1, 1, 2), (6, 1, 2)}
    kept = S.dedup(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 1
    assert S.groups(nothing).count() == 0 and S.dedup(nothing).count() == 0


def at_distance(rng, n, distance):
    """n random fingerprints, and n that differ from them in `distance` bits at random places."""
    a = rng.integers(0, 2, (n, S.BITS), np.uint8)
    b = a.copy()
    for row in b:
        row[rng.permutation(S.BITS)[:distance]] ^= 1
    return (np.packbits(x, axis=1, bitorder="little").view(np.uint64) for x in (a, b))


def test_bits_run_on_around_the_ring():
    x = np.random.default_rng(8).integers(0, 2**63, (20, 4), dtype=np.int64).view(np.uint64)
    ring = np.tile(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), 2)
    for at, length in ((0, 64), (0, 9), (60, 4), (60, 5), (63, 64), (191, 10), (192, 64), (250, 30), (255, 64)):
        expected = ring[:, at : at + length].astype(object) @ np.array([1 << k for k in range(length)], object)
        assert S.bits(x, at, length).tolist() == expected.tolist()


def test_every_pair_within_the_limit_is_within_the_bounds_of_a_span():
    rng = np.random.default_rng(4)
    for number in S.SPANS:
        for limit, n in ((S.LIMIT, 2000), (5, 200), (60, 200)):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(S, "SPANS", (number,))
                cut = S.spans(1000, limit)
            a, b = at_distance(rng, n, limit)
            met = np.zeros(n, bool)
            for at, width, radius, length, bound in cut:
                in_cell = np.bitwise_count(S.bits(a, at, width) ^ S.bits(b, at, width)) <= radius
                met |= in_cell & (np.bitwise_count(S.bits(a, at, length) ^ S.bits(b, at, length)) <= bound)
            assert met.all()


def test_links_are_the_same_by_any_spans_and_of_two_blocks_those_between_them(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, (40, 4), dtype=np.int64).view(np.uint64)[rng.integers(0, 40, 700)]
    for _ in range(24):
        x = x ^ ((np.uint64(1) << rng.integers(0, 64, (700, 4), dtype=np.uint64)) * rng.integers(0, 2, (700, 4), dtype=np.uint64))
    near = (S.hamming(x[:, None], x[None]) <= S.LIMIT) & (np.arange(700)[:, None] < np.arange(700))
    between = near.copy()
    between[:300, :300] = between[300:, 300:] = False
    for number in (4, 16, 21, 30):
        monkeypatch.setattr(S, "SPANS", (number,))
        a, b = S.link(x, S.LIMIT)
        assert (S.hamming(x[a], x[b]) <= S.LIMIT).all() and roots(700, zip(a, b, strict=True)) == roots(700, zip(*np.nonzero(near), strict=True))
        a, b = S.link(x, S.LIMIT, 300)
        assert ((a < 300) != (b < 300)).all() and roots(700, zip(a, b, strict=True)) == roots(700, zip(*np.nonzero(between), strict=True))


def test_a_large_group_gives_as_many_links():
    rng = np.random.default_rng(10)
    x = np.repeat(rng.integers(0, 2**63, (1, 4), dtype=np.int64).view(np.uint64), 6000, axis=0)
    for _ in range(5):
        x ^= (np.uint64(1) << rng.integers(0, 64, (6000, 4), dtype=np.uint64)) * (rng.random((6000, 4)) < 0.4)
    for over in (None, S.spans(300_000)[:2]):
        assert len(S.link(x, S.LIMIT, None, over)[0]) == 5999


def test_all_pairs_at_the_limit_are_linked_among_few_and_among_many(spark):
    a, b = at_distance(np.random.default_rng(11), 400, S.LIMIT)
    others = np.random.default_rng(12).integers(0, 2**63, (12_000, 4), dtype=np.int64).view(np.uint64)
    for n in (0, 12_000):
        x = np.concatenate([a, b, others[:n]])
        rows = [(i, *r) for i, r in enumerate(x.view(np.int64).tolist())]
        reps = spark.createDataFrame(rows, "rep bigint, " + ", ".join(f"{f} bigint" for f in S.PRINT))
        assert {tuple(p) for p in S.pairs(reps, len(x)).collect()} == {(i, i + 400) for i in range(400)}


def test_the_pipeline_keeps_one_document_of_each_group_of_pairs_near_the_limit(spark, documents):
    rng = random.Random(13)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(11_000)]
    for k in range(1500):
        texts.append(" ".join(edited(rng, texts[k].split(), 0.13)))
    at, bits = prints(texts)
    near = []
    for k in range(0, len(bits), 500):
        apart = np.bitwise_count(bits[k : k + 500, None, 0] ^ bits[None, :, 0])
        for word in (1, 2, 3):
            apart += np.bitwise_count(bits[k : k + 500, None, word] ^ bits[None, :, word])
        i, j = np.nonzero(apart <= S.LIMIT)
        near += [(int(a), int(b)) for a, b in zip(i + k, j, strict=True) if a < b]
    assert at.tolist() == list(range(12_500)) and sum(S.hamming(bits[a], bits[b]) > 40 for a, b in near) > 100
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, documents(texts), "").select("doc_id").collect()}
    assert kept == set(roots(12_500, near))


def test_blocks_give_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, (60, 4), dtype=np.int64).view(np.uint64)[rng.integers(0, 60, 500)]
    for _ in range(30):
        x = x ^ ((np.uint64(1) << rng.integers(0, 64, (500, 4), dtype=np.uint64)) * rng.integers(0, 2, (500, 4), dtype=np.uint64))
    rows = [(i, *r) for i, r in enumerate(x.view(np.int64).tolist())]
    reps = spark.createDataFrame(rows, "rep bigint, " + ", ".join(f"{f} bigint" for f in S.PRINT)).repartition(4)
    near = np.argwhere(np.triu(S.hamming(x[:, None], x[None]) <= 35, 1))
    found = [roots(500, map(tuple, S.pairs(reps, 500, 35).collect()))]
    for most in (200, 64):
        monkeypatch.setattr(S, "MOST", most)
        found.append(roots(500, map(tuple, S.pairs(reps, 500, 35).collect())))
    assert found == [roots(500, near)] * 3
