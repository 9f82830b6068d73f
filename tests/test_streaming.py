import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import sequences as Q
from cairn.streaming import overlay as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in shuffled order over several files, which a stream reads one by one."""
    p = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 3 = 0").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.orderBy("event_id").collect()
    random.Random(3).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], e.schema).coalesce(1).write.mode("append").parquet(p)
    return p, e


def stream(spark, p):
    return spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 1).parquet(p)


def drain(spark, df, name, mode="update"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_gated_updates_do_not_depend_on_order(spark, parts):
    p, e = parts
    got = drain(spark, S.gated_updates(stream(spark, p), "user_id", "event_id", "event_type"), "gated")
    last = got.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))
    want = Q.newest(e.select("user_id", "event_id", "event_type"), "user_id", "event_id")
    assert {tuple(r) for r in last.select("user_id", "event_id", "event_type").collect()} == {tuple(r) for r in want.collect()}


def test_windows_equal_the_batch(spark, parts):
    p, e = parts
    got = drain(spark, S.windowed_rate(stream(spark, p), "event_type", "ts", "1 day", "60 days"), "rate")
    last = {(r.event_type, r.start): r.n for r in got.groupBy("event_type", "start").agg(F.max("n").alias("n")).collect()}
    want = {(r.event_type, r.w.start): r["count"] for r in e.groupBy("event_type", F.window("ts", "1 day").alias("w")).count().collect()}
    assert last == want


def test_sessions_are_given_out_once(spark, parts):
    p, e = parts
    got = drain(spark, S.debounce(stream(spark, p), "user_id", "ts", "2 hours", "60 days"), "debounce", "append")
    assert got.isEmpty()  # the watermark has not passed any end
    batch = S.debounce(e, "user_id", "ts", "2 hours", "60 days")
    assert batch.agg(F.sum("n")).first()[0] == e.count()


def test_duplicates_count_once(spark, parts):
    p, e = parts
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = drain(spark, S.once(stream(spark, p).unionByName(stream(spark, p)), ["event_id"], "ts", "60 days"), "once", "append")
    assert got.count() == e.count()


def test_ewma_of_batches(spark, parts):
    p, e = parts
    one = spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 100).parquet(p)
    got = drain(spark, S.running_ewma(one, "user_id", "ts", "event_id", "value"), "ewma")
    want = {r.user_id: (r.n, round(r.ewma, 6)) for r in Q.ewma(e, "user_id", ["ts", "event_id"], "value").collect()}
    assert {r.user_id: (r.n, round(r.ewma, 6)) for r in got.collect()} == want


def test_silent_keys_are_forgotten(spark, tmp_path):
    """Four files: the key of the first is forgotten once the watermark has passed it."""
    for i, rows in enumerate(([("a", 5, "x", 1)], [("b", 1, "y", 20)], [("b", 2, "y", 21)], [("a", 3, "z", 21)])):
        d = spark.createDataFrame(rows, "k string, v bigint, p string, day int").selectExpr("k", "v", "p", "timestamp'2026-01-01' + make_dt_interval(day) ts")
        d.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        (next((tmp_path / f"in/{i}").glob("*.parquet"))).rename(tmp_path / f"{i}.parquet")
    for late, want in ((None, {("a", 5), ("b", 1), ("b", 2)}), ("1 day", {("a", 5), ("b", 1), ("b", 2), ("a", 3)})):
        src = spark.readStream.schema("k string, v bigint, p string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
        got = drain(spark, S.gated_updates(src, "k", "v", "p", "ts", late), "silent_" + ("no" if late is None else "yes"))
        assert {(r.k, r.v) for r in got.collect()} == want


def test_flush_is_durable(spark, parts, tmp_path):
    p, e = parts
    q = S.flush(stream(spark, p), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q = S.flush(stream(spark, p), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
