"""Exact nearest neighbours of a set of query vectors, in blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the queries that are sent to the tasks at a time.
BLOCK_BYTES = 32 << 20
#: Products of vectors that a task holds at a time.
_HELD = 4_000_000
SCHEMA = "query_id bigint, vec_id bigint, cosine double"


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length 1 (a zero vector stays zero) of a batch of id and vector, all of one length."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(batch.num_rows, -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return batch.column(0).to_numpy(zero_copy_only=False), np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple] = []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield _units(_batch(held))
            held = []
    if held:
        yield _units(_batch(held))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, vectors = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "v"])


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what it was made from can be let go."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="offerlake-vectors-"))
    return df.checkpoint()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, vec_id and cosine of the k rows of vectors nearest to each query; queries has the columns of vectors.

    Every query is compared with every row, and equal cosines (to 9 places) are ordered by vec_id. Queries go to the rows in
    blocks of block_bytes at most, one pass over vectors each; a task gives its own k best of each query, and only these are
    shuffled. Rows and queries without an id or a vector, or with a vector of another length than the first query's or with a
    null in it, are left out; the cosine of a zero vector is 0.
    """
    usable = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    asked = usable(queries)
    first = asked.select(F.size("v").alias("n")).head()
    spark = vectors.sparkSession
    if first is None or not first["n"]:
        return spark.createDataFrame([], SCHEMA)
    fits = F.size("v") == first["n"]
    rows, asked = usable(vectors).filter(fits), asked.filter(fits)

    def best(parts: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "vec_id"))
        return parts.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "vec_id", "cosine")

    result, last = None, None
    for ids, block in _blocks(asked, max(1, block_bytes // (8 * first["n"]))):
        if last is not None:  # there is more than one block
            done = _kept(best(rows.mapInArrow(last[0], SCHEMA)))
            last[1].unpersist()
            result = done if result is None else result.unionByName(done)
        sent = spark.sparkContext.broadcast((ids, block))
        last = (_search(sent, k), sent)
    final = best(rows.mapInArrow(last[0], SCHEMA))
    return final if result is None else result.unionByName(final)


def _search(sent, k: int):
    """A task's k best rows of each query of a block."""

    def run(batches):
        ids, block = sent.value
        own = np.arange(len(ids))
        # k best of each query so far, best first: rounded and whole cosines, and whose they are
        top, whole, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k)), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, units = _units(batch)
            step = max(1, _HELD // len(ids))
            for at in range(0, len(names), step):
                cosine = block @ units[at : at + step].T
                rounded, least = np.round(cosine, 9), top[:, -1]
                if cosine.shape[1] > k:
                    least = np.maximum(least, np.partition(rounded, -k, axis=1)[:, -k])
                q, row = np.nonzero(rounded >= least[:, None])
                query = np.concatenate([np.repeat(own, k), q])
                values, exact, owner = np.concatenate([top.ravel(), rounded[q, row]]), np.concatenate([whole.ravel(), cosine[q, row]]), np.concatenate([who.ravel(), names[at + row]])
                order = np.lexsort((owner, -values, query))
                first = np.searchsorted(query[order], own)
                best = order[(first[:, None] + np.arange(k)).ravel()]
                top, whole, who = (x[best].reshape(-1, k) for x in (values, exact, owner))
        q, place = np.nonzero(np.isfinite(top))
        for at in range(0, len(q), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[part]]), pa.array(who[q[part], place[part]]), pa.array(whole[q[part], place[part]])], names=["query_id", "vec_id", "cosine"])

    return run
