"""Line deduplication with two Bloom filters.

The first scan hashes every line into two filters a task: one of what it has seen, one of what it has seen again. Two
tasks' filters merge as ``seen = a | b`` and ``again = again_a | again_b | (a & b)``, so the bits of a line that stands in
two tasks end up in ``again`` without any text having moved. The second scan tests each line against ``again``; of the
lines suspected, each task sends the first of its own to be confirmed by their whole text, and only there is the first
occurrence in the corpus chosen. A false positive costs a shuffled line, never a wrong result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlake.llm import columnar as C

MIN_WORDS = 4
PROBES = 2
#: Bits of a filter: by the input's size, within these bounds. The upper bound is what is broadcast at most (32 MB); a
#: fuller filter suspects more lines, and all that are suspected are confirmed exactly.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_SEGMENT = 1 << 20
#: A letter of a script that sets no spaces between words.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def filter_bits(docs: DataFrame) -> int:
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(size, 1) // 4).bit_length()))


def _lines(data: np.ndarray, off: np.ndarray, min_words: int):
    """Row, number in the row, start, end and hash of each line that has min_words words at least; ends are trimmed of spaces."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([off[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    rows = np.searchsorted(off, starts, "right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(data)]]), off[rows + 1])
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))
    # a break that ends a row opens a last, empty line, which counts for nothing: numbers within a row need only starts
    first = np.searchsorted(starts, off[:-1], "left")
    number = np.arange(len(starts)) - first[rows]
    words, word_ends, _ = C.spans(data, off, C.SPACED)
    n = np.searchsorted(words, ends, "left") - np.searchsorted(words, starts, "left")
    keep = n >= min_words
    starts, ends, rows, number = starts[keep], ends[keep], rows[keep], number[keep]
    inner = np.searchsorted(words, starts, "left")
    starts, ends = words[inner], word_ends[inner + n[keep] - 1]
    return rows, number, starts, ends, C.hashes(data, starts, ends)


def _bits(hashed: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter: one row a probe."""
    again = C.mix(hashed + np.uint64(0x632BE59BD9B4E019))
    return np.stack([(h & np.uint64(bits - 1)).astype(np.int64) for h in (hashed >> np.uint64(20), again >> np.uint64(20))[:PROBES]])


def twice_seen(docs: DataFrame, bits: int, min_words: int = MIN_WORDS) -> np.ndarray:
    """The merged filter of lines seen twice, as bytes; docs has a column text. Each task sends the places it has set."""

    def build(batches):
        once: list[np.ndarray] = []
        for batch in batches:
            data, off = C.utf8(batch.column(0))
            for i, j in C.chunks(off):
                once.append(_lines(data[off[i] : off[j]], off[i : j + 1] - off[i], min_words)[4])
        found = np.concatenate(once) if once else np.zeros(0, np.uint64)
        found.sort()
        same = found[1:] == found[:-1]
        repeated = np.unique(found[1:][same])
        seen = np.unique(_bits(found[np.concatenate([[True], ~same])] if len(found) else found, bits))
        names = ["segment", "again", "places"]
        for again, places in ((False, seen), (True, np.unique(_bits(repeated, bits)))):
            cut = np.searchsorted(places, np.arange(0, bits + _SEGMENT, _SEGMENT))
            where = [k for k in range(len(cut) - 1) if cut[k + 1] > cut[k]]
            packed = [zlib.compress(np.diff(places[cut[k] : cut[k + 1]] - k * _SEGMENT, prepend=0).astype(np.uint32).tobytes(), 1) for k in where]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([again] * len(where), pa.bool_()), pa.array(packed, pa.binary())], names=names)

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # batch by batch: a segment's filters have one size, however many tasks send places
        seen, again = np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)
        for part in parts:
            for repeated, packed in zip(part["again"], part["places"], strict=True):
                places = np.cumsum(np.frombuffer(zlib.decompress(packed.as_py()), np.uint32), dtype=np.int64)
                if repeated.as_py():
                    again[places] = True
                else:
                    again[places[seen[places]]] = True
                    seen[places] = True
        whole = zlib.compress(np.packbits(again, bitorder="little").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([whole], pa.binary())], names=["segment", "filter"])

    parts = docs.select("text").mapInArrow(build, "segment int, again boolean, places binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment int, filter binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, packed in merged.collect():  # MOST_BITS / 8 bytes at most, whatever the input
        at = segment * _SEGMENT // 8
        out[at : at + _SEGMENT // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return out


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, bits: int | None = None) -> DataFrame:
    """Lines to drop of each document: row_key and the list of their numbers. docs: row_key, doc_id, text."""
    spark = docs.sparkSession
    bits = bits or filter_bits(docs)
    again = spark.sparkContext.broadcast(twice_seen(docs, bits, min_words))

    def suspect(batches):
        table = again.value
        first: dict[bytes, tuple] = {}
        sent: list[tuple] = []

        def out(rows):
            line, key, doc, number = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(line, pa.binary()), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(number, pa.int32())], names=["line", "row_key", "doc_id", "number"])

        for batch in batches:
            data, off = C.utf8(batch.column(2))
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in C.chunks(off):
                part = data[off[i] : off[j]]
                rows, number, starts, ends, hashed = _lines(part, off[i : j + 1] - off[i], min_words)
                places = _bits(hashed, bits)
                hit = np.flatnonzero(np.all((table[places >> 3] >> (places & 7).astype(np.uint8)) & 1, axis=0))
                raw = part.tobytes() if len(hit) else b""
                for r, n, a, b in zip(rows[hit].tolist(), number[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), strict=True):
                    key, doc = keys[i + r], ids[i + r]
                    this = (doc is None, doc or 0, key, n)
                    best = first.setdefault(line := raw[a:b], this)
                    if best is this or best == this:
                        continue
                    if this < best:
                        first[line], this = this, best
                    sent.append((None, this[2], this[1], this[3]))
                if len(sent) > 20_000:
                    yield out(sent)
                    sent = []
        if sent:
            yield out(sent)
        rows = [(line, f[2], None if f[0] else f[1], f[3]) for line, f in first.items()]
        for k in range(0, len(rows), 10_000):
            yield out(rows[k : k + 10_000])

    found = docs.select("row_key", "doc_id", "text").mapInArrow(suspect, "line binary, row_key bigint, doc_id bigint, number int")
    # One scan serves both kinds: a task's own later occurrences go by, each in a group of its own.
    group = F.when(F.col("line").isNull(), F.xxhash64("row_key", "number")).otherwise(F.lit(0))
    order = Window.partitionBy("line", group).orderBy(F.col("doc_id").asc_nulls_last(), "row_key", "number")
    ranked = found.withColumn("nth", F.row_number().over(order)).filter(F.col("line").isNull() | (F.col("nth") > 1))
    return ranked.groupBy("row_key").agg(F.collect_set("number").alias("numbers"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, bits: int | None = None, drop_emptied: bool = False) -> DataFrame:
    """Every line's first occurrence stays, by (doc_id, null last; then a hash of the row; then place), and later ones go.

    A line is what stands between line breaks, compared without spaces at its ends; one of fewer than min_words words
    always stays. All columns of docs are kept and text is replaced; ``lines_dropped`` is added (a column of that name in
    docs gives way). Rows that agree in doc_id and text count as one document and get the same result. A null text stays
    null and an empty one empty. With drop_emptied, documents that have lost lines and have no two words
    left, on whatever lines, are removed (with min_words of 1, those that have none); a letter of a script without spaces
    counts as a word here.
    """
    C.small_batches(docs.sparkSession)
    rest = docs.drop("lines_dropped", "row_key")
    keyed = rest.withColumn("row_key", F.xxhash64("doc_id", "text"))
    drops = dropped_lines(keyed.select("row_key", F.col("doc_id").cast("bigint").alias("doc_id"), "text"), min_words, bits)
    joined = keyed.join(drops, "row_key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("numbers", i)), "\n")
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(kept)
    out = joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest.columns], F.coalesce(F.size("numbers"), F.lit(0)).alias("lines_dropped"))
    if drop_emptied:
        more = rf"[^\x00-\x20][\x00-\x20]++[^\x00-\x20]|{_UNSPACED}[^\x00-\x20]" if min_words > 1 else r"[^\x00-\x20]"
        out = out.filter((F.col("lines_dropped") == 0) | F.col("text").rlike(more))
    return out


SQL = f"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents
), marked AS (
  SELECT doc_id, n, line, row_number() OVER (PARTITION BY regexp_replace(line, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') ORDER BY doc_id, n) > 1
    AND len(regexp_extract_all(line, '[^\\x00-\\x20]+')) >= {MIN_WORDS} AS again FROM cut
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT again), '') AS text, CAST(count(*) FILTER (again) AS INT) AS lines_dropped
FROM marked GROUP BY doc_id
"""
