"""The store of keys: what it knows, how many runs it has, what a batch reads, and crashes."""

import pytest
from pyspark.sql import types as T

from folium.streaming import ingest, keys
from folium.streaming.keys import KeyStore


def store(spark, path):
    return KeyStore(spark, str(path), "k", T.LongType())


def frame(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "k long")


def known(s):
    return sorted(r.k for r in s._keys([(r["id"], None) for r in s.runs()]).collect()) if s.runs() else []


def test_what_is_known(spark, tmp_path):
    s = store(spark, tmp_path / "keys")
    assert s.runs() == [] and sorted(r.k for r in s.unknown(frame(spark, [1, 2])).collect()) == [1, 2]
    s.add("b0", frame(spark, [1, 2, 2, None]))
    s.add("b1", frame(spark, range(100, 400)))
    assert sorted(str(r.k) for r in s.unknown(frame(spark, [1, 3, 150, 500, None])).collect()) == ["3", "500", "None"]
    # a batch that runs again doesn't know itself, and takes its own place
    assert sorted(r.k for r in s.unknown(frame(spark, [1, 150]), but="b1").collect()) == [150]
    s.add("b1", frame(spark, range(100, 300)))
    assert known(s) == [1, 2, *range(100, 300)] and len(s.runs()) == 2


def test_runs_stay_few_and_filters_spare_reading(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "FAN", 3)
    s = store(spark, tmp_path / "keys")
    for b in range(10):
        s.compact(but=f"b{b}")
        s.add(f"b{b}", frame(spark, range(20 * b, 20 * b + 20)))
    assert known(s) == list(range(200))
    levels = [r["level"] for r in s.runs()]
    assert max(levels) == 2 and all(levels.count(x) <= 3 for x in levels)
    folders = sorted(p.name for p in (tmp_path / "keys/keys").iterdir() if not p.name.startswith("."))
    assert folders == sorted(r["id"] for r in s.runs())
    # a key that is there is found in its part of one run; unknown ones are read for hardly ever
    rows = frame(spark, [5]).withColumn("_part", keys.part_of("k"))
    assert [len(parts) for _, parts in s.hits(rows)] == [1]
    far = frame(spark, range(10**6, 10**6 + 200)).withColumn("_part", keys.part_of("k"))
    assert sum(len(parts) for _, parts in s.hits(far)) <= 30


def test_crashes_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "FAN", 2)
    s = store(spark, tmp_path / "keys")
    s.add("b0", frame(spark, [1, 2]))
    s.add("b1", frame(spark, [3]))

    def fails(*_):
        raise OSError("killed")

    # after the merged run is written, before it counts
    with monkeypatch.context() as m:
        m.setattr(KeyStore, "_publish", fails)
        with pytest.raises(OSError):
            s.compact()
    assert known(store(spark, tmp_path / "keys")) == [1, 2, 3] and len(s.runs()) == 2
    # after it counts, before the old ones are deleted
    with monkeypatch.context() as m:
        m.setattr(KeyStore, "sweep", fails)
        with pytest.raises(OSError):
            s.compact()
    again = store(spark, tmp_path / "keys")
    assert known(again) == [1, 2, 3] and len(again.runs()) == 1
    assert len([p for p in (tmp_path / "keys/keys").iterdir() if not p.name.startswith(".")]) > 1
    again.sweep()
    assert known(again) == [1, 2, 3] and len([p for p in (tmp_path / "keys/keys").iterdir() if not p.name.startswith(".")]) == 1


def test_a_stream_of_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keys, "FAN", 3)
    (tmp_path / "in").mkdir()
    for b in range(7):
        frame(spark, [b, b + 1, 100 + b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "k long"
    for _ in range(2):
        stream = ingest.drop_folder(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "state"), key="k").awaitTermination()
    got = sorted(r.k for r in ingest.landed(spark, str(tmp_path / "out"), schema).collect())
    assert got == [*range(8), *range(100, 107)]
    assert len(store(spark, tmp_path / "out-keys").runs()) <= 5
