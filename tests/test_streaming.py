"""Streams over small folders."""

from gridweave.streaming import events


def test_windowed_sampling(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in (1, 5, 40)] + [("a", "2024-01-01 02:30:00", 7.0)]
    spark.createDataFrame(rows, "k string, t string, v double").selectExpr("k", "cast(t as timestamp) as ts", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    out = events.windowed_sampling(stream, "ts", "v", ["k"])
    q = out.writeStream.outputMode("append").format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select n, mean from sampled").collect()
    assert [(r["n"], r["mean"]) for r in got] == [(3, 46.0 / 3)]


def test_restarts(spark, tmp_path):
    rows = [("a", t) for t in (0.0, 1.0, 2.0, 0.5, 0.6)]
    spark.createDataFrame(rows, "k string, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t double").parquet(str(tmp_path / "in"))
    q = events.restarts(stream, "k", "t").writeStream.outputMode("append").format("memory").queryName("restarts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select n_before, t_before, t_after from restarts").collect()] == [(3, 2.0, 0.5)]
