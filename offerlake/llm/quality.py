"""Quality classification by a sparse rule ensemble.

Statistics of a text are Spark columns. Small boosted trees over them are cut into rules, each a conjunction of bounds on a
path; a logistic model with an L1 penalty weighs the rules, and those that keep a weight are compiled back into one Spark
column. Two ensembles are fitted, for low quality and for toxic texts; what either finds likelier than not is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.shared import checkpoint

#: Labelled documents that are fitted on at most: those of the least hash of their ids.
MAX_TRAIN = 20_000
#: Units of the lexicon at most, and how much likelier than by chance all but a few of their texts are toxic.
LEXICON, SURE, EVIDENCE = 200, 0.95, 14.0
PREFIXES = (3, 4, 5, 6, 7, 8)
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
NUMBERS = ["log_words", "word_length", "upper", "symbols", "digits", "bangs", "bars", "stops", "distinct", "short", "line_repeats", "line_words", "hits", "hit_share"]


@dataclass(frozen=True)
class Rule:
    """Bounds that all hold: (statistic, above?, threshold); above is >, otherwise <=."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.all([(x[:, NUMBERS.index(f)] > t) == above for f, above, t in self.bounds], axis=0)

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > t if above else F.col(f) <= t for f, above, t in self.bounds])


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


@dataclass(frozen=True)
class Model:
    """The lexicon by length of unit (0: the whole word) and the two ensembles."""

    lexicon: dict[int, tuple[str, ...]]
    low: Ensemble
    toxic: Ensemble


def words_of(text: str | Column = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a clean text and its words and lines, from which the statistics are made."""
    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__text": clean, "__words": words_of(text), "__lines": F.filter(F.split(clean, "\n"), lambda x: F.trim(x) != "")})


def statistics(lexicon: dict[int, tuple[str, ...]]) -> dict[str, Column]:
    """Statistics by name, over with_words(). All are 0 for a text without words or characters, and none is null."""
    text, words, lines = F.col("__text"), F.col("__words"), F.col("__lines")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def without(mark: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / chars

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")) / chars

    def toxic(w: Column) -> Column:
        tests = [(w if k == 0 else F.substring(w, 1, k)).isin(*units) for k, units in sorted(lexicon.items()) if units]
        if not tests:
            return F.lit(False)
        begins = sorted({u[:3] for units in lexicon.values() for u in units})  # nearly all words fail here
        return F.substring(w, 1, 3).isin(*begins) & reduce(lambda a, b: a | b, tests)

    hits = F.size(F.filter(words, toxic)).cast("double")
    letters = F.length(F.array_join(words, "")).cast("double")
    return {
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": letters / n,
        "upper": left(r"[^\p{Lu}]+"),
        "symbols": left(r"[\p{L}\p{N}\s]+"),
        "digits": left("[^0-9]+"),
        "bangs": without("!"),
        "bars": without("|"),
        "stops": without("."),
        "distinct": F.size(F.array_distinct(words)) / n,
        "short": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "line_repeats": (n_lines - F.greatest(F.size(F.array_distinct(lines)), F.lit(1))) / n_lines,
        "line_words": F.log1p(n / n_lines),
        "hits": hits,
        "hit_share": hits / n,
    }


def learn_lexicon(sample: DataFrame) -> dict[int, tuple[str, ...]]:
    """Words, and beginnings of 3 to 8 letters, that toxic texts have and others hardly. sample: __words and toxic.

    Each word of a text counts once. A unit is taken when SURE of its counts are in toxic texts and so many would come up
    by chance only once in exp(EVIDENCE) draws; one that a shorter taken one begins is left out, and of more than LEXICON
    those of most counts stay.
    """
    words = sample.select("toxic", F.explode(F.array_distinct("__words")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    words = checkpoint(words)
    toxic, n = words.agg(F.sum("toxic"), F.sum("n")).first()
    if not toxic or toxic == n:
        return {}
    least = EVIDENCE / -np.log(toxic / n)
    unit = lambda k: F.struct(F.lit(k).alias("k"), (F.col("word") if k == 0 else F.substring("word", 1, k)).alias("unit"))
    long_enough = F.filter(F.array(*map(unit, (0, *PREFIXES))), lambda u: (u["k"] == 0) | (F.length(u["unit"]) == u["k"]))
    counted = words.select("toxic", "n", F.explode(long_enough).alias("u")).groupBy("u.k", "u.unit").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    found = counted.filter((F.col("toxic") >= float(least)) & (F.col("toxic") >= SURE * F.col("n"))).orderBy(F.desc("toxic"), "k", "unit").limit(8 * LEXICON).collect()
    taken = {(r["k"], r["unit"]) for r in found}
    first = [r for r in found if not any((k, r["unit"][:k]) in taken for k in PREFIXES if k < (r["k"] or 99))][:LEXICON]
    return {k: tuple(sorted(r["unit"] for r in first if r["k"] == k)) for k in (0, *PREFIXES)}


def _bins(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bins of each statistic, and the thresholds between them, halfway between neighbouring values near quantiles."""
    edges, binned = [], np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)))
        edges.append((values[1:] + values[:-1]) / 2)
        binned[:, f] = np.searchsorted(edges[f], x[:, f], "left")
    return binned, edges


def _tree(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray) -> list[tuple[tuple, np.ndarray, float]]:
    """Nodes of one tree, as bounds, rows and the value of a leaf (0 for inner nodes); splits by Newton gain."""
    out, todo = [], [((), rows, 0)]
    while todo:
        bounds, rows, depth = todo.pop()
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-3, -1, -1)
        if depth < DEPTH and len(rows) >= 10:
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                left_g = np.bincount(binned[rows, f], gradient[rows], len(edge) + 1).cumsum()[:-1]
                left_h = np.bincount(binned[rows, f], hessian[rows], len(edge) + 1).cumsum()[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        _, f, k = best
        if f < 0:
            out.append((bounds, rows, g / (h + 1)))
            continue
        out.append((bounds, rows, 0.0))
        above = binned[rows, f] > k
        for side in (False, True):
            todo.append(((*bounds, (NUMBERS[f], side, float(edges[f][k]))), rows[above == side], depth + 1))
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5) -> list[Rule]:
    """Distinct rules of the paths of boosted trees, each tree over a half of the rows."""
    binned, edges = _bins(x)
    rng = np.random.Generator(np.random.PCG64(seed))
    z, rules = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(10, len(y) // 2)])
        for bounds, _, value in _tree(binned, edges, y - p, p * (1 - p), rows):
            if bounds:
                rules.setdefault(Rule(bounds))
                if value:
                    z += SHRINK * value * Rule(bounds).holds(x)
    return list(rules)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression with an L1 penalty, by accelerated proximal gradient descent. x: 0 or 1.

    Rows that agree in x are taken together, with their number and the mean of y.
    """
    n, width = x.shape
    _, first, group, number = np.unique(np.packbits(x.astype(bool), axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    share = (number / n).astype(np.float32)
    y = (np.bincount(group.ravel(), y, len(first)) / number).astype(np.float32)
    x = np.ascontiguousarray(x[first], np.float32)
    root = np.sqrt(share)[:, None]
    step = np.float32(4.0 / max(1.0, np.linalg.norm(np.column_stack([x, np.ones(len(x))]) * root, 2) ** 2))
    w, ahead, b, ahead_b, t = np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0, 0.0, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(x @ ahead + np.float32(ahead_b), -30, 30))) - y) * share
        moved = ahead - step * (error @ x)
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * np.float32(penalty), 0), ahead_b - float(step * error.sum())
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        pull = np.float32((old - 1) / t)
        ahead, ahead_b = new + pull * (new - w), new_b + float(pull) * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble of the penalty that does best on every fifth row, fitted again on all. One class alone gives that class, and no rows give 0."""
    if not len(y) or y.min() == y.max():
        return Ensemble((), (), 10.0 if len(y) and y[0] else -10.0)
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble((), (), float(np.log(y.mean() / (1 - y.mean()))))
    matrix = np.column_stack([r.holds(x) for r in rules])
    held = np.arange(len(y)) % 5 == 0
    best = (np.inf, 0.01)
    for penalty in (0.03, 0.01, 0.003, 0.001, 0.0003):
        w, b = lasso(matrix[~held], y[~held], penalty)
        z = np.clip(matrix[held] @ w + b, -30, 30)
        best = min(best, (float(np.mean(np.logaddexp(0, z) - y[held] * z)), penalty))
    w, b = lasso(matrix, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), b)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on max_train labelled documents at most. Labels that are null, or of no document, are left out.

    Of several labels of a document each counts. Without usable labels every document is kept.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    rows = F.broadcast(rows.orderBy(F.xxhash64("__id"), "__id", "quality", "toxic").limit(max_train))  # of a fixed size
    sample = with_words(checkpoint(docs.select(F.col("doc_id").cast("bigint").alias("__id"), "text").join(rows, "__id")))
    lexicon = learn_lexicon(sample)
    table = sample.select("__id", "quality", "toxic", *[c.alias(k) for k, c in statistics(lexicon).items()]).orderBy("__id", "quality", "toxic", "log_words").toPandas()
    x = table[NUMBERS].to_numpy(float)
    return Model(lexicon, fit(x, 1.0 - table["quality"].to_numpy(float)), fit(x, table["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the chances ``low_quality`` and ``toxicity``, a Spark expression each; rows stay where they are.

    A null or empty text has the statistics of a text without words. All columns and rows of docs stay; columns of the new
    names give way.
    """
    kept = [c for c in docs.columns if c not in ("low_quality", "toxicity")]
    named = with_words(docs.select(*[F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(kept)], F.col("text").alias("__source")), "__source")
    measured = named.select(*[f"__own{i}" for i in range(len(kept))], *[c.alias(k) for k, c in statistics(model.lexicon).items()])
    # through a generator, so that no filter on a score is moved before the statistics and makes them anew for each rule
    both = F.inline(F.array(F.struct(model.low.column().alias("low_quality"), model.toxic.column().alias("toxicity"))))
    return measured.select(*[F.col(f"__own{i}").alias(c) for i, c in enumerate(kept)], both)


def keep(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that neither ensemble rejects, with their chances."""
    return score(docs, train(docs, labels, max_train)).filter((F.col("low_quality") < 0.5) & (F.col("toxicity") < 0.5))
