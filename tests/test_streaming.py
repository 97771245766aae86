"""Streams give what the same rows give as a table."""

import datetime as dt

from pyspark.sql import functions as F

from offerlake.operators import tables
from offerlake.streaming import jobs

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def events(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 3, "view", float(i), "{}") for i in range(60)]
    table = spark.createDataFrame(rows, jobs.EVENTS)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    return table, jobs.files(spark, str(tmp_path / "in"), jobs.EVENTS)


def test_windows_equal_the_batch(spark, tmp_path):
    table, stream = events(spark, tmp_path)
    run(jobs.tumbling(stream), "tumbling", "complete")
    expected = table.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")
    assert sorted(map(tuple, spark.table("tumbling").select("start", "n").collect())) == sorted(map(tuple, expected.collect()))
    run(jobs.sliding(stream), "sliding", "complete")
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 120
    run(jobs.sessions(stream), "sessions", "complete")
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == 60


def test_upserts_health_and_deduplication(spark, tmp_path):
    table, stream = events(spark, tmp_path)
    by = lambda: [F.desc("ts"), F.desc("event_id")]
    query = stream.writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "t"), "user_id", by)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = jobs.current(spark, str(tmp_path / "t"), 0).select("user_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables.latest(table, "user_id", by()).select("user_id", "event_id").collect()))
    log = stream.select(F.col("event_type").alias("source"), "ts", F.lit("ok").alias("status"), F.lit(1).alias("latency_ms"), F.col("value").alias("items"))
    run(jobs.health(log), "health", "complete")
    assert spark.table("health").first()["items"] == 59.0
    run(jobs.dedup(stream.withColumn("url", F.col("user_id").cast("string")), within="10 hours"), "dedup")
    assert spark.table("dedup").count() == 3


def test_logs_are_appended(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    query = jobs.append_json(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 60


def test_correction_reads_the_dictionary_at_each_batch(spark, tmp_path):
    spark.createDataFrame([("тлефон",)], "text string").write.parquet(str(tmp_path / "q"))
    seen = []
    words = lambda s: s.createDataFrame([("телефон",)], "word string")
    writer = jobs.corrected(jobs.files(spark, str(tmp_path / "q"), "text string"), words, lambda df, epoch: seen.extend(r["corrected"] for r in df.collect()))
    writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start().awaitTermination(120)
    assert seen == ["телефон"]


def test_rate_limits_are_kept_from_batch_to_batch(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = ([("a", "1", at(0)), ("a", "2", at(0.5)), ("b", "3", at(0.5))], [("a", "4", at(0.8)), ("a", "5", at(1.0)), ("b", "6", at(1.0))])
    for rows in batches:
        spark.createDataFrame(rows, "domain string, url string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        stream = jobs.files(spark, str(tmp_path / "in"), "domain string, url string, ts timestamp", per_trigger=1)
        query = jobs.rate_limited(stream).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        ended = query.awaitTermination(60)
        query.stop()
        assert ended
    finally:
        spark.conf.set(key, old)
    assert {r["url"]: r["passed"] for r in spark.table("limited").collect()} == {"1": True, "2": False, "3": True, "4": True, "5": False, "6": False}
