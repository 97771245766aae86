"""The rule ensemble, the language model and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import quality as Q
from offerlake.llm import recurrent as R

# rules
def test_rules_find_a_conjunction_and_few_are_kept():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(Q.NUMBERS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.2)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    assert 0 < len(model.rules) < len(Q.tree_rules(x[:3000], y[:3000]))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 12)) < 0.4).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    w, b = Q.lasso(x, y, 0.02, rounds=4000)
    gradient = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert np.all(np.abs(gradient[w == 0]) <= 0.021) and np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=2e-3)
    assert w[0] > 0 > w[1] and (w == 0).sum() >= 5


def test_one_class_or_no_labels_keep_every_document(spark, documents):
    docs = documents(["some text here", "other text"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (9, None, 1)], "doc_id bigint, quality int, toxic int")
    assert Q.keep(docs, labels).count() == 2 and Q.keep(docs, labels.limit(0)).count() == 2


WORDS = [f"{a}{b}{c}{d}{e}" for a in "bdfglm" for b in "aeiou" for c in "nrst" for d in "ptk" for e in "aeiou"]


def corpus():
    """Texts with (doc_id, text, quality, toxic): good ones, junk, and ones with one of a few words."""
    rng, rows = random.Random(8), []
    for i in range(400):
        text = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        kind = i % 8
        if kind == 0:
            text = [w + rng.choice(["***", "$$$", "%%%"]) for w in text]
        if kind == 1:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["zzloathing", "zzvile", "qqwretch"])
        rows.append((i, " ".join(text).capitalize() + ".", int(kind != 0), int(kind == 1)))
    return rows


def test_column_and_array_give_the_same_and_held_out_documents_are_right(spark, documents):
    rows = corpus()
    docs = documents([(i, t) for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 2 == 0 or i < 100], "doc_id bigint, quality int, toxic int")
    model = Q.train(docs, labels)
    assert {u for units in model.lexicon.values() for u in units} & {"zzl", "zzv", "qqw", "zzvi", "zzlo", "qqwr"}
    scored = Q.score(docs, model)
    table = scored.select("doc_id", "low_quality", "toxicity").orderBy("doc_id").toPandas()
    x = Q.with_words(docs).select("doc_id", *[c.alias(k) for k, c in Q.statistics(model.lexicon).items()]).orderBy("doc_id").toPandas()[Q.NUMBERS].to_numpy(float)
    assert np.allclose(table["low_quality"], model.low.probability(x)) and np.allclose(table["toxicity"], model.toxic.probability(x))
    held = np.array([i % 2 == 1 and i >= 100 for i, *_ in rows])
    keep = (table["low_quality"] < 0.5) & (table["toxicity"] < 0.5)
    right = np.array([bool(q) and not t for _, _, q, t in rows])
    assert (keep.to_numpy()[held] == right[held]).mean() > 0.95
    bounded = Q.train(docs, labels, max_train=50)
    assert Q.score(docs, bounded).count() == 400


def test_scores_of_awkward_rows(spark, awkward, nothing):
    rule = Q.Ensemble((Q.Rule((("symbols", True, 0.1), ("log_words", False, 2.0))),), (3.0,), -1.0)
    model = Q.Model({0: ("alpha",)}, rule, Q.Ensemble((Q.Rule((("hits", True, 0.5),)),), (9.0,), -2.0))
    out = Q.score(awkward, model)
    assert set(out.columns) == {*awkward.columns, "toxicity"} and out.count() == awkward.count()
    rows = out.select("doc_id", "low_quality", "toxicity").collect()
    assert all(0 < r["low_quality"] < 1 and 0 < r["toxicity"] < 1 for r in rows)
    assert sum(r["toxicity"] > 0.5 for r in rows) == 1
    assert Q.score(nothing, model).count() == 0
    flat = Q.with_words(awkward).select(*[c.alias(k) for k, c in Q.statistics({}).items()])
    assert flat.filter(" or ".join(f"{k} is null or isnan({k})" for k in Q.NUMBERS)).count() == 0


# language model
def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: rng.standard_normal(s) * 0.3 for k, s in R.shapes(8, 5, 4).items()}
    ids, targets, begins, h = rng.integers(0, 8, (6, 3)), rng.integers(0, 8, (6, 3)), rng.random((6, 3)) < 0.2, np.zeros((3, 5))

    def total():
        return R.output(p, R.forward(p, ids, begins, h)[0].reshape(-1, 5), targets.ravel())[0].sum()

    gradients = {k: np.zeros_like(v) for k, v in p.items()}
    states, _, kept = R.forward(p, ids, begins, h, keep=True)
    _, back = R.output(p, states.reshape(-1, 5), targets.ravel(), gradients)
    R.backward(p, ids, begins, kept, back.reshape(6, 3, 5), gradients)
    for k in p:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            old = p[k][at]
            p[k][at] = old + 1e-2
            above = total()
            p[k][at] = old - 1e-2
            below = total()
            p[k][at] = old
            assert abs((above - below) / 2e-2 - gradients[k][at]) < 2e-2 * max(1, abs(gradients[k][at]))


def test_probabilities_sum_to_one():
    p = R.initial(np.arange(64.0), hidden=6, size=8)
    states = np.random.default_rng(1).standard_normal((5, 6)).astype(np.float32)
    total = sum(np.exp(R.output(p, states, np.full(5, w))[0]) for w in range(64))
    assert np.allclose(total, 1, atol=1e-5)


def sample(n=300, seed=2):
    """Documents over a grammar in which each word nearly tells the next."""
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 60, n)
    words = np.zeros(lengths.sum(), np.int16)
    at = 0
    for size in lengths:
        w = rng.integers(2, 60)
        for _ in range(size):
            words[at] = w
            w = (w * 7) % 59 + 2 if rng.random() < 0.9 else rng.integers(2, 61)
            at += 1
    return words, lengths


def test_state_is_carried_across_windows_and_lanes_do_not_matter():
    words, lengths = sample()
    p = R.initial(np.bincount(words, minlength=64), hidden=8, size=8)
    whole = R.likelihood(p, words, lengths, lanes=1, window=10**6)
    for lanes, window in ((1, 1), (7, 5), (300, 16)):
        assert np.allclose(R.likelihood(p, words, lengths, lanes, window), whole, atol=1e-3)
    first = R.likelihood(p, words[: lengths[0]], lengths[:1])
    assert np.allclose(first, whole[:1], atol=1e-4) and len(R.likelihood(p, words[:0], lengths[:0])) == 0


def test_training_beats_word_frequencies_on_held_out_documents():
    words, lengths = sample(1500)
    cut = int(lengths[:1200].sum())
    p = R.initial(np.bincount(words, minlength=64), hidden=16, size=8)
    before = R.likelihood(p, words[cut:], lengths[1200:]).sum()
    memory = {}
    for _ in range(6):
        p = R.train(p, words[:cut], lengths[:1200], memory, lanes=32, every=1)
    after = R.likelihood(p, words[cut:], lengths[1200:]).sum()
    assert after > 0.75 * before


@pytest.mark.parametrize("every", [None, 1, 3])
def test_every_window_gives_a_gradient(monkeypatch, every):
    words, lengths = np.tile(np.arange(2, 62, dtype=np.int16), 20), np.full(4, 300)
    p, seen, real = R.initial(np.ones(64), hidden=4, size=8), [], R.backward

    def spy(p, ids, *rest):
        seen.append(len(ids))
        return real(p, ids, *rest)

    monkeypatch.setattr(R, "backward", spy)
    memory = {}
    R.train(p, words, lengths, memory, lanes=4, window=16, **({} if every is None else {"every": every}))
    assert sum(seen) == 301 and memory["t"] == -(-len(seen) // (every or 1))


def test_average_over_teams_is_that_of_all_tasks(spark):
    rng = np.random.default_rng(3)
    values, weights = rng.standard_normal((40, 2, 5)).astype(np.float32), rng.integers(1, 9, 40)
    rows = [(b, k % 7, int(weights[k]), bytearray(zlib.compress(values[k, b].tobytes()))) for k in range(40) for b in range(2)]
    got = R.average(spark.createDataFrame(rows, "block int, team int, weight bigint, packed binary").repartition(5))
    assert np.allclose(got, np.average(values, axis=0, weights=weights).ravel(), atol=1e-5)
    assert len(R.average(spark.createDataFrame([], "block int, team int, weight bigint, packed binary"))) == 0


def test_vocabulary_counts_are_exact(spark, documents):
    docs = documents(["a b a", "b c", None, "", "a"]).repartition(3)
    v, counts = R.learn_vocabulary(docs, 64)
    assert sorted(v.frequency[v.frequency > 0].tolist()) == [1, 2, 3, 5] and v.frequency[R.END] == 5
    assert sorted(r["n"] for r in counts.collect()) == [1, 2, 3]


@pytest.mark.parametrize("distinct", [0, 1, 40, 700, 5000])
def test_every_word_has_its_number_and_share(distinct):
    rng, own = np.random.default_rng(distinct), 64 - R.SPECIAL
    words = np.unique(rng.integers(0, 2**64, distinct, np.uint64))
    counts = rng.integers(1, 50, len(words))
    v = R.Vocabulary(words, counts, int(counts.sum()) + 7, 3, 64)
    numbers, share = v(words), v.share[v.find(words)]
    order = np.lexsort((words, -counts))
    for rank, at in enumerate(order.tolist()):
        band = next(b for b in range(1, R.BANDS) if rank < own << b or b == R.BANDS - 1) if rank >= own else rank + R.SPECIAL
        assert numbers[at] == band
    for number in np.unique(numbers):
        assert np.isclose(np.exp(share[numbers == number], dtype=float).sum(), 1, atol=1e-5) and v.frequency[number] == counts[numbers == number].sum()
    strange = np.setdiff1d(rng.integers(0, 2**64, 2000, np.uint64), words)
    assert (v(strange) == R.BANDS).all() and v.frequency[R.BANDS] == 7 and (v.share[v.find(strange)] == 0).all()


def test_words_beyond_the_table_have_their_share_of_all_such_words(documents):
    rows = ["a a a a b b b c c d e", "d e f g g", None, "h", "f f i"]
    docs = documents([(i, t) for i, t in enumerate(rows)]).select("doc_id", "text")
    p = R.initial(np.ones(64), size=8)
    v, counts = R.learn_vocabulary(docs, 64)
    whole = {r["doc_id"]: r for r in R.score(docs, v, counts, p).collect()}
    assert [whole[i]["n_unknown"] for i in range(5)] == [0] * 5
    occurs = {"a": 4, "b": 3, "c": 2, "d": 2, "e": 2, "f": 3, "g": 2, "h": 1, "i": 1}
    v = R.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), sum(occurs.values()), 5, 64)
    net = R.likelihood(p, np.full(21, R.BANDS, np.int16), np.array([11, 5, 0, 1, 3]))
    for r in R.score(docs, v, counts, p).collect():
        text = (rows[r["doc_id"]] or "").split()
        expected = net[r["doc_id"]] + sum(np.log(occurs[w] / 20) for w in text)
        assert np.isclose(r["log_likelihood"], expected, atol=1e-4) and r["n_words"] == r["n_unknown"] == len(text)


def test_documents_of_words_that_occur_twice_are_likelier(documents):
    rng = random.Random(3)
    common = [" ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60)) for _ in range(150)]
    own = [" ".join(f"name{i}x{k}" for k in range(30)) for i in range(20)]
    found = {r["doc_id"]: r["log_likelihood"] for r in R.language_model(documents(common + own + own[:10])).collect()}
    assert min(found[i] for i in range(150, 160)) > max(found[i] for i in range(160, 170)) + 10
    assert all(np.isclose(found[i], found[i + 20], atol=1e-3) for i in range(150, 160))


def test_language_model_of_awkward_rows(awkward, nothing):
    rows = R.language_model(awkward).collect()
    assert len(rows) == awkward.count() and all(np.isfinite(r["log_likelihood"]) and r["log_likelihood"] < 0 for r in rows)
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}
    one = [r["log_likelihood"] for r in rows if r["doc_id"] in (1, 6)]
    assert max(one) - min(one) < 1e-3
    assert R.language_model(nothing).count() == 0


# pipeline
def test_pipeline_keeps_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    rows = corpus()
    item = " ".join(WORDS[7 * i] for i in range(25))
    base = [" ".join(rng.choice(WORDS) for _ in range(90)).capitalize() + "." for _ in range(6)]
    extra = [base[0], base[1], base[2], f"{base[3]} {item}", " ".join(w if k % 30 else WORDS[k] for k, w in enumerate(base[0].split())), base[1] + "\nUn.", base[4], None, ""]
    texts = [(i, t) for i, t, _, _ in rows] + [(1000 + i, t) for i, t in enumerate(extra)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.filter("n_chars <> length(text)").count() == 0
    good = {i for i, _, q, t in rows if q and not t}
    assert len(kept["quality"] & good) >= 0.97 * len(good) and len(kept["quality"] & ({i for i, *_ in rows} - good)) <= 3
    assert {1000, 1001, 1002, 1003, 1006} <= kept["quality"]
    assert 1005 not in kept["line_dedup"] and {1000, 1001, 1002, 1003, 1004} <= kept["line_dedup"]
    assert 1004 not in kept["near_duplicates"] and {1000, 1001, 1002, 1003} <= kept["near_duplicates"]
    assert kept["decontamination"] == kept["near_duplicates"] - {1003}
    windows = corpus_pipeline.run(spark, str(tmp_path))
    packed = {d for r in windows.select("doc_ids").collect() for d in r["doc_ids"]}
    assert packed == {r["doc_id"] for r in docs.filter(F.trim("text") != "").collect()}


def test_driver_entry_has_every_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("module", ["offerlake.plans.catalogue", "offerlake.engine"])
def test_the_rest_does_not_import_this_folder(module):
    import subprocess
    import sys

    code = f"import sys, {module}; sys.exit(any(m.startswith('offerlake.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
