"""SimHash near-duplicates through a segment-popcount embedding.

A document's distinct lower-cased words vote on 256 bits. The bits are cut into 128 segments of two, and a fingerprint is
embedded as its segments' bit counts: the Manhattan distance between two embeddings is never more than the Hamming distance
between the fingerprints. The range join is complete: every pair within the limit is found, at any size of the corpus. The
bits are also cut into spans in a ring, each with a radius, so that a pair within the limit is within the radius of one span
at least, and within the radii's sum on those that follow it: had it more differing bits all around, it had more than the
limit in all. A cell holds the fingerprints of the same bits on a span, and is compared with every cell within the radius,
itself among them: by the 64 bits from the span on, by Manhattan distance over the segments, and by exact Hamming distance.
How many spans there are follows from how many fingerprints there are, and changes only how long the search takes.

Fingerprints are cut into blocks of at most MOST, and each block meets each, so that no task holds more than two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C
from offerlake.llm.shared import checkpoint

BITS, SEGMENTS = 256, 128
LIMIT = 44
#: Rows of a block at most, and tasks that even one block's spans are dealt to.
MOST, DEALT = 800_000, 12
#: Numbers of spans that are considered, bits of a cell at most, and the comparisons that cost as much as a cell; see spans().
SPANS, WIDEST, PER_CELL = (4, *range(15, 33)), 18, 40_000
PRINT = ["f0", "f1", "f2", "f3"]
_SCHEMA = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in PRINT)


@lru_cache(1)
def _votes() -> np.ndarray:
    """A row of 256 votes, 0 or 1 in a byte each, for each of 65,536 values of a word's hash, seen as 32 words of 8 bytes."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2, (1 << 16, BITS), np.uint8).view(np.uint64)


def prints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a word, and their fingerprints as 32 bytes each."""
    starts, ends, rows = C.spans(data, off)
    hashed = C.hashes(data, starts, ends)
    key = np.unique((rows.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8)
    rows = (key >> np.uint64(40)).astype(np.int64)
    start = np.flatnonzero(np.diff(rows, prepend=-1))
    size = np.diff(start, append=len(rows))
    # up to 255 votes are added within their bytes, and those sums as integers
    blocks = (size + 254) // 255
    first = np.repeat(start - (np.cumsum(blocks) - blocks) * 255, blocks) + np.arange(int(blocks.sum())) * 255
    sums = np.add.reduceat(_votes()[(key & np.uint64(0xFFFF)).astype(np.int64)], first, axis=0).view(np.uint8)
    total = np.add.reduceat(sums.astype(np.int32), np.cumsum(blocks) - blocks, axis=0)
    return rows[start], np.packbits(2 * total > size[:, None], axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint's four longs; documents without an id or without a word have none."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = C.utf8(batch.column(1))
            for i, j in C.chunks(off):
                rows, bits = prints(data[off[i] : off[j]], off[i : j + 1] - off[i])
                longs = np.ascontiguousarray(bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + i))] + [pa.array(longs[:, k]) for k in range(4)], names=["doc_id", *PRINT])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text")).filter(F.col("doc_id").isNotNull())
    return source.mapInArrow(run, _SCHEMA)


def counts(bits: np.ndarray) -> np.ndarray:
    """The embedding of fingerprints given as 32 bytes each: 128 segment counts of 0 to 2."""
    return np.unpackbits(bits, axis=1, bitorder="little").reshape(len(bits), SEGMENTS, 2).sum(axis=2, dtype=np.int64)


class Span(NamedTuple):
    """A cell is the `width` bits from bit `at` on; the `length` bits from there may differ by `bound`."""

    at: int
    width: int
    radius: int
    length: int
    bound: int


def spans(n: int, limit: int = LIMIT) -> list[Span]:
    """Spans for n fingerprints that are compared with each other.

    Each span may differ by a number of bits, and with one more for each these add up to limit + 1. A pair within the limit
    stays, from one of the spans on, below the sum of these, over as many spans as one likes: from the place on at which
    its differing bits less these sums, added up around the ring, are at their last maximum. Of SPANS the number is taken
    that costs least for random bits, in comparisons; any finds the same pairs.
    """
    found: list[tuple[float, list[Span]]] = []
    for number in SPANS:
        widths = [BITS // number + (k < BITS % number) for k in range(number)]
        below = [(limit + 1) // number + (k < (limit + 1) % number) for k in range(number)]
        cut, cost = [], 0.0
        for k in range(number):
            follow = 1
            while sum(np.roll(widths, -k)[: follow + 1]) <= 64:
                follow += 1
            width, radius = widths[k] if widths[k] <= WIDEST else 0, below[k] - 1
            if radius >= 0:
                cut.append(Span(sum(widths[:k]), width, radius, int(sum(np.roll(widths, -k)[:follow])), int(sum(np.roll(below, -k)[:follow])) - 1))
                cost += n * n * sum(math.comb(width, d) for d in range(min(radius, width) + 1)) / 2**width + PER_CELL * min(n, 2**width)
        found.append((cost, cut))
    return min(found)[1]


def bits(longs: np.ndarray, at: int, length: int) -> np.ndarray:
    """The `length` bits of each fingerprint, (n, 4) longs, from bit `at` on, the first following the last; up to 64."""
    word, shift = divmod(at, 64)
    found = longs[:, word] >> np.uint64(shift)
    if shift + length > 64:
        found = found | longs[:, (word + 1) % 4] << np.uint64(64 - shift)
    return found & np.uint64((1 << length) - 1)


def _parts(batches, size: int = 4000) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches of rep and f0 to f3, and their fingerprints."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, np.stack([part.column(k + 1).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)


def _in_blocks(reps: DataFrame, number: int, dealt: int) -> DataFrame:
    """Every fingerprint in each task that its block is in: once with each of `number` blocks, for each share of the spans.

    task is the lesser block, the greater and the share, as one number; second says whether the row is of the greater.
    """

    def run(batches):
        for part, longs in _parts(batches):
            own = (C.mix(longs[:, 0].view(np.uint64) ^ longs[:, 3].view(np.uint64)) % np.uint64(number)).astype(np.int64)
            for other in range(number):
                pair = np.minimum(own, other) * number + np.maximum(own, other)
                for share in range(dealt):
                    yield pa.RecordBatch.from_arrays([pa.array(pair * dealt + share), pa.array(own > other), *part.columns], names=["task", "second", "rep", *PRINT])

    return reps.mapInArrow(run, "task bigint, second boolean, rep bigint, " + ", ".join(f"{f} bigint" for f in PRINT))


_ODD = np.uint64(0x5555555555555555)
#: Rows that are compared with all others of a cell at once, and the others at a time.
_ROWS, _COLUMNS = 32, 4096
#: Pairs that wait to be verified together.
_WAITING = 4096


def embed(longs: np.ndarray) -> np.ndarray:
    """Segment counts in the two bits of each segment, as 00, 01 and 11, so that differing bits are the difference of counts."""
    upper = longs >> np.uint64(1)
    return ((longs | upper) & _ODD) | ((longs & upper & _ODD) << np.uint64(1))


def manhattan(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Between embeddings, over their last axis."""
    return np.bitwise_count(p ^ q).sum(axis=-1, dtype=np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


@lru_cache(1)
def _held() -> tuple[np.ndarray, np.ndarray]:
    """Memory for the comparison of rows with columns, used again and again."""
    return np.empty(_ROWS * _COLUMNS, np.uint64), np.empty(_ROWS * _COLUMNS, np.uint8)


def _within(mine: np.ndarray, others: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in mine and in others of pairs that differ by `bound` bits at most."""
    shape = (len(mine), len(others))
    apart, number = (held[: shape[0] * shape[1]].reshape(shape) for held in _held())
    np.bitwise_count(np.bitwise_xor(mine[:, None], others, out=apart), out=number)
    return np.divmod(np.flatnonzero(number.ravel() <= bound), len(others))


class _Forest:
    """Rows that are connected so far, and the pairs that connect them."""

    def __init__(self, n: int):
        self.parent, self.left, self.right = np.arange(n), [], []

    def roots(self, rows: np.ndarray) -> np.ndarray:
        found = self.parent[rows]
        while True:
            onward = self.parent[found]
            if (onward == found).all():
                self.parent[rows] = found
                return found
            found = onward

    def _root(self, row: int) -> int:
        while (up := int(self.parent[row])) != row:
            self.parent[row] = row = int(self.parent[up])
        return row

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of rows; those within what is connected already are passed over."""
        while len(a):
            apart = self.roots(a) != self.roots(b)
            a, b = a[apart], b[apart]
            # one pair of each row of b at a time, as most of the others are connected then
            for k in np.unique(b, return_index=True)[1].tolist():
                x, y = self._root(int(a[k])), self._root(int(b[k]))
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.left.append(int(a[k]))
                    self.right.append(int(b[k]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.left, np.int64), np.array(self.right, np.int64)


def link(longs: np.ndarray, limit: int, first: int | None = None, over: list[Span] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, verified to be within the limit, that connect all that such pairs connect; longs is (n, 4).

    All pairs are searched, or those of one of the `first` rows with one of the others, over all spans or those given. Rows
    of one group are compared with rows of others only, so that a group of thousands gives as many pairs, not their square.
    """
    forest, found, waiting = _Forest(len(longs)), [], 0
    for at, width, radius, length, bound in spans(len(longs), limit) if over is None else over:
        word, every = bits(longs, at, length), np.arange((1 << width) + 1)
        cell = (word & np.uint64((1 << width) - 1)).astype(np.int64)
        order = others = np.argsort(cell[:first], kind="stable")
        start = others_start = np.searchsorted(cell[order], every)
        if first is not None:
            others = first + np.argsort(cell[first:], kind="stable")
            others_start = np.searchsorted(cell[others], every)
        near, word_of_others = np.flatnonzero(np.bitwise_count(every[:-1]) <= radius), word[others]
        for c in np.flatnonzero(np.diff(start)).tolist():
            rows, to = order[start[c] : start[c + 1]], near ^ c
            if first is None:
                to = to[to >= c]
            begin = others_start[to]
            sizes = others_start[to + 1] - begin
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(begin - ends + sizes, sizes)
            among, words = others[places], word_of_others[places]
            several = len(rows) > _ROWS
            if several:  # those of one group together
                rows = rows[np.argsort(forest.roots(rows), kind="stable")]
            for k in range(0, len(rows), _ROWS):
                some, left, theirs = rows[k : k + _ROWS], among, words
                if several:
                    root = forest.roots(some)
                    if (root == root[0]).all():
                        apart = forest.roots(among) != root[0]
                        left, theirs = among[apart], words[apart]
                for p in range(0, len(left), _COLUMNS):
                    i, j = _within(word[some], theirs[p : p + _COLUMNS], bound)
                    if len(i):
                        found.append((some[i], left[p + j]))
                        waiting += len(i)
                    if waiting > _WAITING:
                        forest.add(*_near(longs, found, forest, limit))
                        found, waiting = [], 0
    if found:
        forest.add(*_near(longs, found, forest, limit))
    return forest.pairs()


def _near(longs: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], forest: _Forest, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, not known as connected, that are within the limit by their embeddings' distance and then by their own."""
    a, b = (np.concatenate(rows) for rows in zip(*found, strict=True))
    keep = forest.parent[a] != forest.parent[b]
    a, b = a[keep], b[keep]
    keep = manhattan(embed(longs[a]), embed(longs[b])) <= limit
    a, b = a[keep], b[keep]
    keep = hamming(longs[a], longs[b]) <= limit
    return a[keep], b[keep]


def pairs(reps: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints within the limit, by their representatives, that connect all such pairs.

    reps: rep and f0 to f3, n rows. Of a task's pairs those are given that connect its groups; see link().
    """
    number = max(1, math.ceil(n / MOST))
    cut = spans(math.ceil(n / number), limit)
    dealt = max(1, min(DEALT // number, len(cut)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pair, share = divmod(key[0].as_py(), dealt)
        table = table.sort_by("second")
        rep = table["rep"].to_numpy()
        longs = np.stack([table[f].to_numpy() for f in PRINT], axis=1).view(np.uint64)
        first = None if pair // number == pair % number else int(np.sum(~table["second"].to_numpy()))
        a, b = link(longs, limit, first, cut[share::dealt])
        return pa.table({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})

    reps = reps.select("rep", *PRINT)
    return _in_blocks(reps, number, dealt).groupBy("task").applyInArrow(run, "a bigint, b bigint").filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the least node that it is connected to, for every node of the edges (a, b).

    Each round every node goes to its least neighbour and on, by doubled steps, to where no lesser one is next; edges are
    drawn anew between these places and those within one are gone. A dense group or a chain collapses at once, and at most
    half of the nodes remain from round to round.
    """
    edges, steps = checkpoint(edges.select("a", "b")), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        while True:
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("onward"))
            jumped = checkpoint(step.join(onward, "to").select("node", F.col("onward").alias("to"), (F.col("onward") != F.col("to")).alias("moved")))
            step = jumped.select("node", "to")
            if jumped.filter("moved").isEmpty():
                break
        steps.append(step)
        there = [step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab"]
        moved = edges.join(there[0], "a").join(there[1], "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = checkpoint(moved.filter(F.col("a") != F.col("b")).distinct())
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0].withColumnRenamed("to", "label")
    for step in steps[1:]:
        labels = labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels


def groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, group_id and group_size of every document that has a near duplicate.

    Near duplicates differ in `limit` of their fingerprints' 256 bits at most; groups are what such pairs connect, and
    group_id is a group's least doc_id. Rows that repeat a doc_id and its text count once. Documents without an id or
    without a word (null, empty or blank text) are in no group. Only fingerprints are shuffled, and of equal ones only
    one is compared, so a thousand exact copies cost no more than one.
    """
    found = checkpoint(fingerprints(docs).distinct())
    reps = checkpoint(found.groupBy(*PRINT).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    labels = components(pairs(reps, reps.count(), limit))
    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select(*PRINT, "n", F.coalesce("label", "rep").alias("group_id"))
    sizes = named.groupBy("group_id").agg(F.sum("n").alias("group_size")).filter(F.col("group_size") > 1)
    return found.join(named.drop("n"), PRINT).join(sizes, "group_id").select("doc_id", "group_id", "group_size").distinct()


def dedup(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with one document of each group, the one of the least doc_id; all columns and all ungrouped documents stay.

    Of rows that repeat a kept doc_id all stay.
    """
    gone = groups(docs, limit).filter(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
