"""Document fingerprints by closed syncmers.

A k-mer is k consecutive words of the lower-cased text, hashed; it is chosen when the least hash among its inner s-mers
stands first or last. Whether a k-mer is chosen depends on its own words only, so a passage that two documents share gives
the same anchors in both, whatever surrounds it. About 2 / (k - s + 1) of the k-mers are chosen, and any k - s + 1
consecutive k-mers hold at least one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C

K_WORDS, S_WORDS = 12, 3
SCHEMA = "doc_id bigint, n_words int, n_kmers int, hashes array<bigint>, positions array<int>"


def _roll(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; the last n - 1 places are cut off."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    total = np.zeros(last, np.uint64)
    for j in range(n):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += words[j : j + last]
    return C.mix(total)


def choose(words: np.ndarray, rows: np.ndarray, k: int = K_WORDS, s: int = S_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each chosen k-mer. words: hashes in order; rows: the document of each."""
    if len(words) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner, width, last = _roll(words, s), k - s + 1, len(words) - k + 1
    first, final = inner[:last], inner[width - 1 : width - 1 + last]
    least = np.minimum(first, final)
    reach, window = 1, inner
    while reach * 2 <= width:
        window = np.minimum(window[:-reach], window[reach:])
        reach *= 2
    lowest = np.minimum(window[:last], window[width - reach : width - reach + last])
    at = np.flatnonzero((least == lowest) & (rows[:last] == rows[k - 1 :]))
    return at, _roll(words, k)[at]


def fingerprints(docs: DataFrame, k: int = K_WORDS, s: int = S_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its words, its k-mers, and hash and word position of each chosen k-mer in order.

    A null or empty text, or one of fewer than k words, has empty lists. A null id stays null; repeated rows each give
    their row; other columns are not read. Positions count words from 0. Nothing is shuffled.
    """
    if not 0 < s < k:
        raise ValueError("0 < s < k")
    C.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = C.utf8(batch.column(1))
            for i, j in C.chunks(off):
                part, edges = data[off[i] : off[j]], off[i : j + 1] - off[i]
                starts, ends, rows = C.spans(part, edges)
                words = C.hashes(part, starts, ends)
                at, hashed = choose(words, rows, k, s)
                n_words = np.bincount(rows, minlength=j - i)
                first = np.cumsum(n_words) - n_words
                counts = np.bincount(rows[at], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n_words.astype(np.int32)),
                        pa.array(np.maximum(n_words - k + 1, 0).astype(np.int32)),
                        C.list_column(hashed.view(np.int64), counts, pa.int64()),
                        C.list_column((at - first[rows[at]]).astype(np.int32), counts, pa.int32()),
                    ],
                    names=["doc_id", "n_words", "n_kmers", "hashes", "positions"],
                )

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.lower(F.col(f"`{text_col}`")).alias("text"))
    return source.mapInArrow(run, SCHEMA)


def positional_matches(left: DataFrame, right: DataFrame, min_anchors: int = 2) -> DataFrame:
    """Pairs of documents with anchors in common on one diagonal (the same distance between positions).

    left, right: results of fingerprints(). A pair is given once a diagonal on which it has at least min_anchors anchors,
    with their number and the first and last left position. Only anchors, never texts, are shuffled.
    """

    def flat(df, side):
        both = F.explode(F.arrays_zip("hashes", "positions")).alias("a")
        return df.select(F.col("doc_id").alias(f"{side}_id"), both).select(f"{side}_id", F.col("a.hashes").alias("hash"), F.col("a.positions").alias(f"{side}_pos"))

    joined = flat(left, "left").join(flat(right, "right"), "hash").withColumn("shift", F.col("right_pos") - F.col("left_pos"))
    found = joined.groupBy("left_id", "right_id", "shift").agg(F.count(F.lit(1)).alias("anchors"), F.min("left_pos").alias("first_pos"), F.max("left_pos").alias("last_pos"))
    return found.filter(F.col("anchors") >= min_anchors)
