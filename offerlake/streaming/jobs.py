"""Streaming forms: ingestion with upserts, deduplication, rate limits, health, windows of the query log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from offerlake.operators import offers, spell, tables

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def upsert_into(path: str, key: str, by: Callable[[], list]) -> Callable[[DataFrame, int], None]:
    """A batch function that folds changes into a table on disk. Versions alternate, so that no reader sees half of one.

    The version to read next stands in a file that is replaced last; a batch that is tried again writes the same rows.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark, now, new = batch.sparkSession, f"{path}/v{(epoch + 1) % 2}", f"{path}/v{epoch % 2}"
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(now)
        there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
        rows = tables.upsert(spark.read.parquet(now), batch, key, by()) if there else tables.latest(batch, key, by())
        rows.write.mode("overwrite").parquet(new)

    return fold


def current(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{epoch % 2}")


def refresh(spark: SparkSession, source: str, table: str, checkpoint: str, schema: str, key: str, by: Callable[[], list], every: str | None = None):
    """Keep an index up to date from a folder of extracted pages: all that is new at once, or again after each interval."""
    writer = admit(files(spark, source, schema)).writeStream.foreachBatch(upsert_into(table, key, by)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def admit(stream: DataFrame) -> DataFrame:
    """Extracted pages that may enter the index."""
    return offers.index_admission(stream)


def dedup(stream: DataFrame, key: str = "url", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, which bounds the state."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def health(stream: DataFrame) -> DataFrame:
    return stream.groupBy("source").agg(F.max_by(F.struct("status", "latency_ms", "items"), "ts").alias("last")).select("source", "last.*")


def tumbling(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def corrected(stream: DataFrame, dictionary: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer that corrects each batch against the dictionary as it is then, so a changed one is read at the next batch."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(spell.correct(batch, dictionary(batch.sparkSession)), epoch))


def append_json(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


class RateLimiter(StatefulProcessor):
    """Lets a request of a domain through when the last one let through is long enough ago.

    State is one time a domain; with forget_ms it is forgotten after so long without a request.
    """

    def __init__(self, seconds: float = 0.7, forget_ms: int | None = None):
        self.seconds, self.forget_ms = seconds, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        passed = []
        for ts in frame["ts"]:
            ok = last is None or (ts - pd.Timestamp(last)).total_seconds() >= self.seconds
            last = ts if ok else last
            passed.append(ok)
        self.last.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame({"domain": key[0], "url": frame["url"].to_numpy(), "ts": frame["ts"].to_numpy(), "passed": passed})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, seconds: float = 0.7, forget_ms: int | None = None) -> DataFrame:
    """stream (domain, url, ts) with whether each request may go. Forgetting needs a query that goes on, since it has timers."""
    out = "domain string, url string, ts timestamp, passed boolean"
    return stream.groupBy("domain").transformWithStateInPandas(RateLimiter(seconds, forget_ms), out, "append", "ProcessingTime" if forget_ms else "None")
