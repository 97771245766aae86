"""Order-preserving packing of documents into windows by dynamic programming.

Documents stand in the order of their ids, cut into shards of an id range each; within a shard, windows may end after any
sentence. A window costs its padding, or a penalty for each word beyond its capacity, which is cut off; a cut within a
document costs a penalty of its own. With S the words before each sentence end and f the least cost up to it,

    f(j) = end(j) + min( W - S_j + min f(i) + S_i          over S_j - S_i <= W,
                         T (S_j - W) + min f(i) - T S_i    over S_j - S_i > W )

The first inner minimum is over a sliding range and kept in a monotone queue, the second over a growing one, so the work is
linear in the sentences.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C
from offerlake.llm.shared import hot_pieces, with_piece

WINDOW, TRUNCATED, SPLIT = 2048, 4, 32
#: Ids that share a shard; a shard's last window is padded, so this bounds padding and a task's memory alike.
SHARD_IDS = 1024
#: Rows of a shard, beyond which it is cut into pieces.
SHARD_ROWS = 8192
SCHEMA = "shard bigint, piece int, window int, n_words int, padding int, truncated int, doc_ids array<bigint>, first_words array<int>, word_counts array<int>"


def _codes(*marks: str) -> np.ndarray:
    return np.array(sorted(int.from_bytes(m.encode(), "big") for m in marks))


#: Closing quotes and brackets, which may follow a stop, and stops.
_CLOSING = _codes(*"\"')]}”’»」』）】")
_STOPS = _codes(*".!?…。！？।॥۔؟")


def _ends_in(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Bytes of the mark that each span ends in, 0 for none."""
    found = np.zeros(len(ends), np.int64)
    code = np.zeros(len(ends), np.int64)
    for size in (1, 2, 3):
        code += data[np.maximum(ends - size, 0)].astype(np.int64) << 8 * (size - 1)
        found[(ends - size >= starts) & np.isin(code, marks)] = size
    return found


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each sentence, all rows one after another, and the number of sentences of each row.

    A word is a run of bytes without white space; a sentence ends with a word that ends in a stop (of _STOPS), up to three
    closing marks behind it or not, before a line break, and with its row.
    """
    starts, ends, rows = C.spans(data, off, C.SPACED)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    breaks = np.cumsum(data == 10)
    final = np.ones(len(starts), bool)
    final[:-1] = (rows[1:] != rows[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1] - 1])
    last = data[ends - 1]
    letter = ((last | 32) >= 97) & ((last | 32) <= 122)
    other = np.flatnonzero(~letter & ~final)
    begin, end = starts[other], ends[other].copy()
    for _ in range(3):
        end -= _ends_in(data, begin, end, _CLOSING)
    final[other] = _ends_in(data, begin, end, _STOPS) > 0
    at = np.flatnonzero(final)
    return np.diff(at, prepend=-1), np.bincount(rows[at], minlength=len(off) - 1)


def pieces(words: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentences, n of each row, with those longer than a window cut into windows and a rest."""
    times = np.maximum(1, -(-words // window))
    out = np.full(int(times.sum()), window, np.int64)
    out[np.cumsum(times) - 1] = words - (times - 1) * window
    sums = np.concatenate([[0], np.cumsum(times)])
    return out, sums[np.cumsum(n)] - sums[np.cumsum(n) - n]


def cuts(words: list[int], penalties: list[int], window: int, truncated: int) -> tuple[list[int], int]:
    """Sentences before each cut of a cheapest packing, and its cost. penalties: of a cut after each sentence."""
    n = len(words)
    best, before, total = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    over, over_at, gone = 1 << 62, 0, 0
    s = 0
    for j in range(1, n + 1):
        s += words[j - 1]
        total[j] = s
        while total[gone] < s - window:  # leaves the range that fits
            x = best[gone] - truncated * total[gone]
            if x < over:
                over, over_at = x, gone
            gone += 1
        while queue and queue[0][1] < gone:
            queue.popleft()
        cost, at = over + truncated * (s - window), over_at
        if queue and queue[0][0] + window - s <= cost:
            cost, at = queue[0][0] + window - s, queue[0][1]
        best[j], before[j] = cost + penalties[j - 1], at
        x = best[j] + s
        while queue and queue[-1][0] >= x:
            queue.pop()
        queue.append((x, j))
    out = []
    j = n
    while j:
        out.append(j)
        j = before[j]
    return out[::-1], best[n]


def pack(docs: DataFrame, window: int = WINDOW, truncated: int = TRUNCATED, split: int = SPLIT, shard_ids: int = SHARD_IDS, cut_long: bool = False) -> DataFrame:
    """Windows in order: their words, padding and words cut off at the end, and what of which document they hold.

    first_words and word_counts say from which word of each document how many words are in the window; words cut off are
    counted in word_counts and in n_words beyond the capacity. Documents of a null id come in a shard of their own, named
    null. A document without a word (null, empty or blank text) is in no window. Repeated rows are packed one after another;
    equal ids are ordered by a hash of the text. Other columns aren't read. Only sentence lengths are shuffled.
    A sentence of more words than a window is truncated, or with cut_long, as op5 and the pipeline have it, cut into windows
    first, so that none of its words are lost.

    A shard of over SHARD_ROWS rows, as one of null or much repeated ids can be, is cut into pieces by a hash, each of which
    is packed on its own in the order of its ids; piece is 0 in all other shards.
    """
    C.small_batches(docs.sparkSession)

    def measure(batches):
        for batch in batches:
            data, off = C.utf8(batch.column(2))
            for i, j in C.chunks(off):
                words, n = sentences(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if cut_long:
                    words, n = pieces(words, n, window)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), C.list_column(words.astype(np.int32), n, pa.int32())], names=["doc_id", "tie", "words"])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        lists = table["words"].combine_chunks()
        ids = table["doc_id"].to_pylist()
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), n)
        penalties = np.full(len(words), split)
        penalties[np.cumsum(n)[n > 0] - 1] = 0
        sums = np.concatenate([[0], np.cumsum(words)])
        opening = sums[np.cumsum(n) - n]
        rows, i = [], 0
        for w, j in enumerate(cuts(words.tolist(), penalties.tolist(), window, truncated)[0]):
            size = int(sums[j] - sums[i])
            held = range(int(doc[i]), int(doc[j - 1]) + 1)
            held = [d for d in held if n[d]]
            start = [max(int(sums[i]), int(opening[d])) for d in held]
            stop = [*start[1:], int(sums[j])]
            rows.append((w, size, max(0, window - size), max(0, size - window), [ids[d] for d in held], [a - int(opening[d]) for a, d in zip(start, held, strict=True)], [b - a for a, b in zip(start, stop, strict=True)]))
            i = j
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int32()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["window", "n_words", "padding", "truncated", "doc_ids", "first_words", "word_counts"]
        out = {"shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "piece": pa.array([key[1].as_py()] * len(rows), pa.int32())}
        return pa.table(out | {name: pa.array(list(c), k) for name, c, k in zip(names, columns, kinds, strict=True)})

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    measured = source.mapInArrow(measure, "doc_id bigint, tie bigint, words array<int>").filter(F.size("words") > 0)
    shard = F.floor(F.col("doc_id") / shard_ids).alias("shard")
    hot = hot_pieces(source.select(shard), "shard", max(SHARD_ROWS, 2 * shard_ids))
    return with_piece(measured.select("*", shard), hot, "shard", "doc_id", "tie").groupBy("shard", "piece").applyInArrow(fill, SCHEMA)
