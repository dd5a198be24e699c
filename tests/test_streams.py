import time

import pytest
from pyspark.sql import functions as F

from grainmill.streaming import frontier
from grainmill.streaming.frontier import leases

REQUEST, REPORT = "host string, hash string, url string, depth int, score double", "host string, hash string, attempt int, ok boolean"


def run(spark, stream, path, enough, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and query.isActive and not enough():
            time.sleep(0.3)
    finally:
        query.stop()
    return spark.table(name).collect()


def test_hosts_hand_out_one_at_a_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "u1", 0, 0.1), ("a", "2", "u2", 0, 0.9), ("a", "2", "u2", 0, 0.9), ("b", "3", "u3", 1, 0.5)], REQUEST).selectExpr("*", "timestamp'2024-01-01' discovered")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = leases(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rate_ms=3_600_000)
    got = run(spark, stream, tmp_path, lambda: spark.table("leased").count() >= 2, "leased")
    assert sorted((r["host"], r["hash"], r["attempt"]) for r in got) == [("a", "2", 1), ("b", "3", 1)]
    with pytest.raises(ValueError, match="no policy"):
        leases(rows, "best")


def test_reports_are_fenced(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "u1", 0, 0.1), ("a", "2", "u2", 0, 0.9)], REQUEST).selectExpr("*", "timestamp'2024-01-01' discovered")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    put = lambda *said: spark.createDataFrame(said, REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / "reports"))
    put(("z", "0", 1, True))
    stream = leases(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rate_ms=0, reports=spark.readStream.schema(REPORT).parquet(str(tmp_path / "reports")))
    state = {"sent": 0}

    def enough():
        n = spark.table("fenced").count()
        if n >= 2 and state["sent"] == 0:
            state["sent"] = put(("a", "1", 7, True), ("a", "2", 1, False)) or 1  # a stale success, and a failure: only the second is leased again
        return n >= 3

    got = run(spark, stream, tmp_path, enough, "fenced")
    assert sorted((r["hash"], r["attempt"]) for r in got) == [("1", 1), ("2", 1), ("2", 2)]


def test_events_once_and_batches_once(spark, tmp_path):
    events = spark.createDataFrame([("n", {"t": "1"}, {"v": str(i)}, i) for i in (1, 2)], "name string, tags map<string,string>, fields map<string,string>, seq long").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = frontier.distinct_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    assert len(run(spark, stream, tmp_path, lambda: spark.table("once").count() >= 1, "once")) == 1
    write = frontier.upsert_batches(str(tmp_path / "out"))
    for _ in range(2):
        write(events, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
