import time

import pytest
from pyspark.sql import functions as F

from binloom.geometry import Geometry
from binloom.operators import hist as H
from binloom.operators import stats as S
from binloom.sources import interval_log
from binloom.streaming import windows

G = Geometry(1, 10**9, 3)
SCHEMA = "ts timestamp, k string, v bigint"
ROWS = "select timestamp_seconds(1700000000 + id * 10) as ts, if(id % 3 = 0, 'a', 'b') as k, id * 37 as v from range(200)"


def stream(spark, tmp_path):
    spark.sql(ROWS).repartition(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_merged_stream_equals_one_pass(spark, tmp_path):
    h = windows.merged_stream(stream(spark, tmp_path), "v", G, ["k"])
    query = h.bins.writeStream.outputMode("complete").format("memory").queryName("merged").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert H.same(h.with_bins(spark.table("merged")), H.record(spark.sql(ROWS), "v", G, ["k"]))


def test_windows_to_log_snapshots(spark, tmp_path):
    rows = stream(spark, tmp_path)
    h = windows.windowed(rows, "v", G, "ts", "100 seconds", ["k"], late="1 hour")
    windows.log_sink(h, str(tmp_path / "log"), str(tmp_path / "cp"), "k").trigger(availableNow=True).start().awaitTermination()
    batch = windows.windowed(spark.sql(ROWS), "v", G, "ts", "100 seconds", ["k"])
    assert batch.bins.select("start").distinct().count() == 20
    assert windows.windowed(spark.sql(ROWS), "v", G, "ts", "100 seconds", ["k"], slide="50 seconds").bins.agg({"cnt": "sum"}).first()[0] == 400
    lines = windows.intervals(batch, "k")
    interval_log.write_log(lines, str(tmp_path / "whole"))
    assert interval_log.read_log(spark, str(tmp_path / "whole")).where("kind = 'interval'").count() == 40


def running(spark, h, name, tmp_path):
    return h.bins.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()


def test_writers_with_weights_corrections_caps_and_saturation(spark, tmp_path):
    small = Geometry(1, 1000, 2)
    w = F.col("v") % 5
    for n, how in enumerate(({"weight": w}, {"weight": w, "interval": 500}, {"weight": w, "counter": "u8"}, {"interval": 100, "counter": "u16"})):
        query = running(spark, windows.merged_stream(stream(spark, tmp_path), "v", G, ["k"], **how), f"written{n}", tmp_path)
        assert windows.refresh(query, 120)
        query.stop()
        want = windows.written(spark.sql(ROWS), "v", G, ["k"], **how)
        assert H.same(want.with_bins(spark.table(f"written{n}")), want) and want.bins.count() > 10
    query = running(spark, windows.merged_stream(stream(spark, tmp_path), "v", small, ["k"], saturate=True), "saturated", tmp_path)
    assert windows.refresh(query, 120)
    query.stop()
    assert {(r.k, r["bin"], r.cnt) for r in spark.table("saturated").collect()} == {(r.k, r["bin"], r.cnt) for r in H.record(spark.sql(ROWS), "v", small, ["k"], saturate=True).bins.collect()}


def test_samples_taken_away(spark, tmp_path):
    twice = spark.sql(ROWS).union(spark.sql(ROWS)).withColumn("less", F.lit(False)).union(spark.sql(ROWS).withColumn("less", F.lit(True)))
    once = H.record(spark.sql(ROWS), "v", G, ["k"])
    assert H.same(windows.written(twice, "v", G, ["k"], minus=F.col("less")), once)
    assert H.same(windows.written(twice, "v", G, ["k"], minus=F.col("less"), interval=500), H.record_correct(spark.sql(ROWS), "v", G, 500, ["k"]))
    with pytest.raises(Exception, match="SubtrahendCountExceedsMinuendCount"):
        windows.written(twice.where("less"), "v", G, ["k"], minus=F.col("less")).bins.collect()
    twice.repartition(3).write.parquet(str(tmp_path / "signed_in"))
    source = spark.readStream.schema(SCHEMA + ", less boolean").parquet(str(tmp_path / "signed_in"))
    query = running(spark, windows.merged_stream(source, "v", G, ["k"], minus=F.col("less")), "signed", tmp_path)
    assert windows.refresh(query, 120)
    query.stop()
    assert H.same(once.with_bins(spark.table("signed")), once)


def test_refresh_with_a_deadline(spark, tmp_path):
    rows = stream(spark, tmp_path)
    slow = F.udf(lambda v: (time.sleep(0.1), v)[1], "bigint")
    query = running(spark, windows.merged_stream(rows.withColumn("v", slow("v")), "v", G, ["k"]), "slow", tmp_path)
    assert not windows.refresh(query, 0.01)
    assert windows.refresh(query, 300) and windows.refresh(query)
    query.stop()
    assert spark.table("slow").agg({"cnt": "sum"}).first()[0] == 200


def test_sessions(spark):
    rows = spark.sql("select timestamp_seconds(1700000000 + if(id < 10, id, id * 100)) as ts, 'a' as k, id as v from range(20) union all select timestamp_seconds(1700000500), null, 7")
    got = {(r.k, r.start.timestamp(), r.end.timestamp(), r.total) for r in S.summary(windows.windowed(rows, "v", G, "ts", None, ["k"], gap="60 seconds")).collect()}
    want = {("a", 1700000000.0, 1700000069.0, 10), (None, 1700000500.0, 1700000560.0, 1)} | {("a", 1700000000.0 + i * 100, 1700000060.0 + i * 100, 1) for i in range(10, 20)}
    assert got == want
    slid = windows.windowed(spark.sql(ROWS), "v", G, "ts", "100 seconds", ["k"], slide="50 seconds", late="1 hour")
    assert slid.bins.agg({"cnt": "sum"}).first()[0] == 400
