"""The streaming extension on files that arrive one by one."""

from datetime import datetime, timedelta

from skyloom.streaming import live

START = datetime(2024, 1, 1)


def _arrive(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _run(spark, df, mode, name, folder):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_hourly(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(at(5), "a", 1.0), (at(50), "a", 3.0), (at(55), "b", 7.0)], [(at(65), "a", 5.0)], [(at(300), "a", 9.0)], [(at(305), "d", 2.0)], [(at(10), "a", 100.0)], [(at(600), "c", 0.0)]]
    s = _arrive(spark, tmp_path / "in", batches, "ts timestamp, event_type string, value double")
    got = sorted((r.hour, r.event_type, r.n, r.mean_value) for r in _run(spark, live.hourly(s), "append", "hourly_out", tmp_path).collect())
    # a row is late by the watermark of the batch before: the one at ten past midnight, two after five o'clock, is; the last hour is open
    assert got == [(START, "a", 2, 2.0), (START, "b", 1, 7.0), (START + timedelta(hours=1), "a", 1, 5.0), (START + timedelta(hours=5), "a", 1, 9.0), (START + timedelta(hours=5), "d", 1, 2.0)]


def test_hits(spark, tmp_path):
    batches = [[(START, 1, 10), (START, 1, 10), (START, 2, 10)], [(START, 1, 10), (START, 1, 11)]]
    s = _arrive(spark, tmp_path / "in", batches, "ts timestamp, route_id long, node_id long")
    got = {r.node_id: r["count"] for r in _run(spark, live.hits(s), "complete", "hits_out", tmp_path).collect()}
    assert got == {10: 2, 11: 1}
