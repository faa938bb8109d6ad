"""Counters of batch jobs and streams, and running peaks that survive a restart."""

import os

from pyspark.sql import functions as F

from folium.streaming import ingest, monitor


def test_counts_come_with_the_same_pass(spark, tmp_path):
    df = spark.range(100).withColumn("even", F.col("id") % 2 == 0)
    same, seen = monitor.counted(df, even=F.col("even"), large=F.col("id") >= 90)
    same.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"rows": 100, "even": 50, "large": 10}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


def lines(path, *texts):
    # written elsewhere and moved, as a stream may see a file half written
    tmp = f"{path}.part"
    with open(tmp, "w") as f:
        f.write("\n".join(texts) + "\n")
    os.rename(tmp, path)


def test_counters_of_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    said = []
    counters = monitor.Counters(lambda *x: said.append(x))
    spark.streams.addListener(counters)
    try:
        for k, texts in enumerate([["a", "error b"], ["error c", "d", "e"], ["f"]]):
            lines(str(folder / f"{k}.txt"), *texts)
        stream = ingest.drop_folder(spark, str(folder), "value string", "text", files_per_batch=1, pattern="*.txt")
        stream = monitor.progress(stream, "lines", errors=F.col("value").startswith("error"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        assert counters.settled(query, "lines") == {"rows": 6, "errors": 2}
        assert spark.read.parquet(str(tmp_path / "out")).count() == 6
        assert [s[1]["rows"] for s in said if s[0] == "lines"][-3:].count(0) == 0 and counters.sums("other") == {}
    finally:
        spark.streams.removeListener(counters)


def test_running_peaks_survive_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = ingest.drop_folder(spark, str(folder), "value string", "text", files_per_batch=1, pattern="*.log")
        stream = stream.withColumn("host", F.regexp_extract("value", "^([a-z]+) ", 1))
        got = []

        def keep(batch, number):
            got.extend(sorted((number, r.server, r.peak_running, r.peak_waiting, r.rose) for r in batch.collect()))

        monitor.running_peaks(stream, "host").writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [g[1:] for g in sorted(got)]

    lines(str(folder / "a.log"), "one Running: 3 reqs, Waiting: 1 reqs", "one Running: 5 reqs", "nothing of the kind", "two Running: 1 reqs, Waiting: 0 reqs")
    os.utime(folder / "a.log", (1, 1))
    lines(str(folder / "b.log"), "one Running: 4 reqs, Waiting: 7 reqs", "two Running: 1 reqs")
    assert run() == [("one", 5, 1, "running and waiting"), ("two", 1, 0, "running and waiting"), ("one", 5, 7, "waiting")]
    # another query on the same checkpoint knows the peaks, and says nothing of lower ones
    lines(str(folder / "c.log"), "one Running: 5 reqs, Waiting: 7 reqs", "two Running: 0 reqs")
    assert run() == []
    lines(str(folder / "d.log"), "one Running: 6 reqs", "three Waiting: 2 reqs")
    assert run() == [("one", 6, 7, "running"), ("three", None, 2, "waiting")]
