"""Benchmark decontamination by training suffix arrays.

Training text is cut into shards of whole documents; each shard gets a suffix array over its words, and every suffix of
every benchmark item is binary-searched in it. The words are numbered by the benchmark's own vocabulary and pairs of
neighbouring words by its own pairs: where the training text leaves those, a match must end, so suffixes that leave them
before the required length can't match and aren't sorted. All this is exact, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C

MIN_WORDS = 12
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text that are sent to the executors at a time; a larger benchmark takes several passes.
BENCHMARK_BYTES = 32 << 20
SCHEMA = "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int"


class Items:
    """A slice of the benchmark: its words numbered from 1, items one after another with a 0 behind each."""

    def __init__(self, ids: list, texts: list[str], min_words: int):
        data, off = C.utf8(pa.array([t.lower() for t in texts], pa.string()))
        starts, ends, rows = C.spans(data, off)
        words = C.hashes(data, starts, ends)
        self.ids, self.min_words = ids, min_words
        self.vocabulary = np.unique(words)
        n = np.bincount(rows, minlength=len(ids))
        self.text = np.zeros(len(words) + len(ids), np.int32)
        place = np.arange(len(words)) + rows
        self.text[place] = np.searchsorted(self.vocabulary, words) + 1
        self.item = np.repeat(np.arange(len(ids)), n + 1)
        first = np.cumsum(n + 1) - n - 1
        self.word = np.arange(len(self.text)) - first[self.item]
        left = n[self.item] - self.word
        self.need = np.minimum(min_words, n)[self.item]
        self.suffixes = np.flatnonzero((left >= self.need) & (left > 0))
        self.least = int(self.need[self.suffixes].min()) if len(self.suffixes) else 1
        pairs = self.text[:-1].astype(np.int64) * (len(self.vocabulary) + 1) + self.text[1:]
        self.pairs = np.unique(pairs[(self.text[:-1] > 0) & (self.text[1:] > 0)])


def _member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


def suffix_array(text: np.ndarray, deepest: int) -> np.ndarray:
    """Places of the non-zero words in the order of what follows them, as far as deepest words; a zero ends every suffix.

    Prefix doubling: ranks by the first word, then by 2, 4, ... words, until all differ or the depth is reached.
    """
    n = len(text)
    rank, reach = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    rank[text == 0] = 0
    while reach < deepest:
        behind = np.zeros(n, np.int64)
        behind[:-reach] = rank[reach:]
        behind[text == 0] = 0
        values, fresh = np.unique(rank * (n + 1) + behind, return_inverse=True)
        done = len(values) == rank.max() + 1
        rank, reach = fresh.astype(np.int64), reach * 2
        if done:
            break
    places = np.flatnonzero(text)
    return places[np.argsort(rank[places], kind="stable")]


def _common(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words a[x:] and b[y:] have in common, at most `most`; zeros match nothing."""
    n = np.zeros(len(x), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        left, right = a[x[live] + n[live]], b[y[live] + n[live]]
        live = live[(left == right) & (left != 0)]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n


def _bound(text: np.ndarray, order: np.ndarray, items: Items, query: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all queries at once: the first place in order whose suffix isn't below (or is above) their first words."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    need = items.need[query]
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        middle = (low[live] + high[live]) // 2
        x, y, most = order[middle], query[live], need[live]
        n = _common(text, x, items.text, y, most)
        equal = n >= most
        n = np.minimum(n, most - 1)
        right = (text[x + n] < items.text[y + n]) & ~equal | (equal & upper)
        low[live] = np.where(right, middle + 1, low[live])
        high[live] = np.where(right, high[live], middle)


def search(data: np.ndarray, off: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item): words of the longest match, and where it begins in the document and in the item (the first of equals)."""
    starts, ends, rows = C.spans(data, off)
    if not len(starts) or not len(items.suffixes):
        return {}
    at, known = _member(C.hashes(data, starts, ends), items.vocabulary)
    number = np.where(known, at + 1, 0).astype(np.int32)
    joined = np.zeros(len(number), bool)  # with the word behind it
    both = np.flatnonzero(known[:-1] & known[1:] & (rows[:-1] == rows[1:]))
    joined[both] = _member(number[both].astype(np.int64) * (len(items.vocabulary) + 1) + number[both + 1], items.pairs)[1]
    begins = np.flatnonzero(known & ~np.concatenate([[False], joined[:-1]]))
    finishes = np.flatnonzero(known & ~joined) + 1
    long = finishes - begins >= items.least
    begins, finishes = begins[long], finishes[long]
    if not len(begins):
        return {}
    size = finishes - begins
    slot = np.cumsum(size + 1) - size - 1
    source = np.repeat(begins - slot, size + 1) + np.arange(int((size + 1).sum()))
    text = np.zeros(len(source) + 1, np.int32)
    inside = np.ones(len(source), bool)
    inside[slot + size] = False
    text[:-1][inside] = number[source[inside]]
    order = suffix_array(text, int(items.need.max()))
    low, high = (_bound(text, order, items, items.suffixes, upper) for upper in (False, True))
    n = high - low
    query = np.repeat(items.suffixes, n)
    x = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    before = (x > 0) & (query > 0)
    extends = before & (text[x - 1] == items.text[query - 1]) & (text[x - 1] != 0)
    x, query = x[~extends], query[~extends]
    length = _common(text, x, items.text, query, np.full(len(x), len(items.text)))
    place = source[x]
    doc, first_word = rows[place], np.searchsorted(rows, np.arange(len(off) - 1), "left")
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, k, p, q in zip(doc.tolist(), items.item[query].tolist(), length.tolist(), (place - first_word[doc]).tolist(), items.word[query].tolist(), strict=True):
        old = found.get((d, i))
        if old is None or (-k, p, q) < (-old[0], old[1], old[2]):
            found[d, i] = (k, p, q)
    return found


def _slices(benchmark: DataFrame, min_words: int, most: int) -> list[Items]:
    rows = benchmark.select(F.col("item_id").cast("bigint"), "text").filter(F.col("text").isNotNull())
    out, ids, texts, size = [], [], [], 0
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text)
        if size > most:
            out.append(Items(ids, texts, min_words))
            ids, texts, size = [], [], 0
    return [*out, Items(ids, texts, min_words)] if ids else out


def matches(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The longest verbatim match of each document with each item that it shares min_words words in a row with.

    Words are compared in lower case without what stands between them; an item of fewer words must occur as a whole.
    n_words is the match's length, doc_word and item_word count words from 0, the first place among equals. Null or empty
    texts and items match nothing; a null id stays null; repeated rows each give their rows; other columns aren't read.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    result = None
    for items in _slices(benchmark, min_words, benchmark_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            items = sent.value
            for batch in batches:
                data, off = C.utf8(batch.column(1))
                rows = []
                for i, j in C.chunks(off, SHARD_BYTES):
                    found = search(data[off[i] : off[j]], off[i : j + 1] - off[i], items)
                    rows += [(i + d, items.ids[k], *m) for (d, k), m in sorted(found.items())]
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at))] + [pa.array(c, t) for c, t in zip(rest, kinds, strict=True)], names=["doc_id", "item_id", "n_words", "doc_word", "item_word"])

        part = source.mapInArrow(run, SCHEMA)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """docs without the documents that matches() would name; all columns stay, no row moves between tasks."""
    C.small_batches(docs.sparkSession)
    kept = docs
    for items in _slices(benchmark, min_words, benchmark_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)
        text = "__lowered_text"
        wide = kept.withColumn(text, F.lower("text"))

        def run(batches, sent=sent):
            for batch in batches:
                data, off = C.utf8(batch.column(batch.num_columns - 1))
                clean = np.ones(batch.num_rows, bool)
                for i, j in C.chunks(off, SHARD_BYTES):
                    for d, _ in search(data[off[i] : off[j]], off[i : j + 1] - off[i], sent.value):
                        clean[i + d] = False
                yield batch.filter(pa.array(clean)).select(range(batch.num_columns - 1))

        kept = wide.mapInArrow(run, kept.schema)
    return kept
