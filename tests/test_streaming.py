from __future__ import annotations

import datetime as dt

from conftest import values
from pyspark.sql import functions as F

from skeinflow.sources.sinks import VersionedTable
from skeinflow.streaming import streams

SCHEMA = "k string, ts timestamp, t string"


def stream(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_sessions_and_repeated_deliveries(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda h: t + dt.timedelta(hours=h)
    rows = [("a", at(0), "x"), ("a", at(1), "y"), ("a", at(9), "z"), (None, at(1), "n"), ("b", at(99), "late mark")]
    got = run(streams.sessions(stream(spark, tmp_path, rows), "k", "ts", "2 hours", "1 hour"), "sessions")
    assert values(got.select("k", "event_count")) == [("a", 1), ("a", 2)]
    twice = stream(spark, tmp_path / "d", [("a", at(0), "x"), ("a", at(0), "x"), ("b", at(0), "x")])
    assert run(streams.first_deliveries(twice, ["k"], "ts", "1 hour"), "first").count() == 2


def test_prior_context(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    df = stream(spark, tmp_path, [("a", at(2), "2"), ("b", t, "x"), ("a", at(1), "1"), (None, t, "n")], [("a", at(4), "4"), ("a", at(3), None)])
    got = values(run(streams.prior_context(df, "k", "ts", "t", 2, "1 hour", "1 day"), "prior").select("k", "t", "prior"))
    assert got == sorted([("a", "1", ""), ("a", "2", "1"), ("a", None, "1\n2"), ("a", "4", "2\n"), ("b", "x", "")], key=repr)


def test_incremental_work_and_markers(spark, tmp_path):
    done = VersionedTable(spark, f"file://{tmp_path}/done")
    done.write(spark.createDataFrame([("a", 1)], "k string, n int"))
    rows = spark.createDataFrame([("a", 5), ("b", 6)], "k string, n int")
    assert streams.incremental(rows, "k", done, lambda x: x.withColumn("n", F.col("n") * 10)) == 1
    assert streams.incremental(rows, "k", done, lambda x: x) == 0
    assert values(done.read()) == [("a", 1), ("b", 60)]
    counts = VersionedTable(spark, f"file://{tmp_path}/counts")
    counts.write(spark.createDataFrame([("m", 1)], "marker string, uses long"))
    streams.count_markers(spark.createDataFrame([("m",), ("n",), (None,)], "marker string"), "marker", counts, 2)
    assert values(counts.read()) == [("m", 2, True), ("n", 1, False)]
