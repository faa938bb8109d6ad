"""The keys that a stream has landed: runs of keys with Bloom filters, merged as they grow in number."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a run by hash, runs of a level that are merged into one of the next, bits of a filter for each key and how many a key sets.
PARTS, FAN, BITS, PROBES = 64, 8, 10, 7


def part_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits that keys set, a row for each."""
    step = (h2.astype(np.uint64) | np.uint64(1))[:, None] * np.arange(PROBES, dtype=np.uint64)
    return ((h1.astype(np.uint64)[:, None] + step) % np.uint64(bits)).astype(np.int64)


class KeyStore:
    """A log-structured table of keys below a folder, for one writer at a time.

    A batch's keys are a run of level 0: Parquet parted by a hash of the key, with a Bloom filter for
    each part. FAN runs of a level become one of the next, so that there are at most FAN times the
    number of levels. Which runs there are is said by the newest manifest alone, a file that is
    moved to its name when it is complete; what an older one names is deleted after that, so a crash
    in between costs space and nothing else. New keys are compared with those parts of runs only
    whose filter knows one of them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, kind: T.DataType):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.layout = T.StructType([T.StructField(key, kind), T.StructField("_part", T.IntegerType())])
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        found = self._files.globStatus(self._hadoop(f"{self.path}/manifest-*.json"))
        return sorted(int(s.getPath().getName()[9:-5]) for s in (found or []))

    def runs(self) -> list[dict]:
        """The runs of the newest manifest: id, level and, at level 0, the batch."""
        numbers = self._manifests()
        if not numbers:
            return []
        stream = self._files.open(self._hadoop(self._name(numbers[-1])))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _name(self, number: int) -> str:
        return f"{self.path}/manifest-{number:010d}.json"

    def _publish(self, runs: list[dict]) -> None:
        """Makes these the runs; then drops what is named no more."""
        numbers, tmp = self._manifests(), f"{self.path}/tmp-{uuid.uuid4().hex}"
        stream = self._files.create(self._hadoop(tmp), True)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        new = (numbers[-1] if numbers else 0) + 1
        if not self._files.rename(self._hadoop(tmp), self._hadoop(self._name(new))):
            raise RuntimeError("another writer has published a manifest")
        self.sweep(runs)
        for n in numbers[:-1]:
            self._files.delete(self._hadoop(self._name(n)), False)

    def sweep(self, runs: list[dict] | None = None) -> None:
        """Deletes run folders that the newest manifest doesn't name, as a crash leaves them."""
        named = {r["id"] for r in (self.runs() if runs is None else runs)}
        for kind in ("keys", "filters"):
            for s in self._files.globStatus(self._hadoop(f"{self.path}/{kind}/*")) or []:
                if s.getPath().getName() not in named:
                    self._files.delete(s.getPath(), True)

    def _write(self, keys: DataFrame) -> str:
        """A new run of (key, _part), each key once; its id."""
        run = uuid.uuid4().hex
        keys.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/keys/{run}")
        written = self._keys([(run, None)])
        sizes = written.groupBy("_part").agg(F.count("*").alias("n"))
        hashed = written.select("_part", F.xxhash64(self.key).alias("h1"), F.xxhash64(F.lit(7), self.key).alias("h2"))
        # PARTS rows at most
        rows = hashed.join(F.broadcast(sizes), "_part").repartition("_part").sortWithinPartitions("_part")

        def fill(batches):
            part, bits = None, None
            for batch in batches:
                p, h1, h2, n = (batch.column(c).to_numpy() for c in ("_part", "h1", "h2", "n"))
                cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]).tolist() if len(p) else [0]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if p[a] != part:
                        if bits is not None:
                            yield _filter(part, bits)
                        part, bits = int(p[a]), np.zeros(-(-max(64, BITS * int(n[a])) // 8) * 8, dtype=bool)
                    bits[_places(h1[a:b], h2[a:b], len(bits)).reshape(-1)] = True
            if bits is not None:
                yield _filter(part, bits)

        rows.mapInArrow(fill, "_part int, bits binary").write.parquet(f"{self.path}/filters/{run}")
        return run

    def _keys(self, wanted: list[tuple[str, list[int] | None]]) -> DataFrame:
        """(key, _part) of runs, all their parts or some."""
        out = None
        for run, parts in wanted:
            rows = self.spark.read.schema(self.layout).parquet(f"{self.path}/keys/{run}")
            rows = rows if parts is None else rows.where(F.col("_part").isin(parts))
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, batch: str, keys: DataFrame) -> None:
        """The keys of a batch; if it is there already, as after a failure, they take its place."""
        old = self.runs()
        run = self._write(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("_part", part_of(self.key)))
        self._publish([r for r in old if r.get("batch") != batch] + [{"id": run, "level": 0, "batch": batch}])

    def compact(self, but: str | None = None) -> None:
        """Merges runs of levels that have FAN of them; not the batch `but`, which may run again."""
        while True:
            runs = self.runs()
            levels: dict[int, list[dict]] = {}
            for r in runs:
                if but is None or r.get("batch") != but:
                    levels.setdefault(r["level"], []).append(r)
            full = next((lv for lv in sorted(levels) if len(levels[lv]) >= FAN), None)
            if full is None:
                return
            gone = {r["id"] for r in levels[full]}
            # a key is in one run only, as later batches have left it out, but for those of repeated batches
            new = self._write(self._keys([(i, None) for i in sorted(gone)]).distinct())
            self._publish([r for r in runs if r["id"] not in gone] + [{"id": new, "level": full + 1}])

    def hits(self, rows: DataFrame, but: str | None = None) -> list[tuple[str, list[int]]]:
        """The runs, and their parts, whose filters know a key of rows (key, _part); the batch `but` is left out."""
        runs = [r["id"] for r in self.runs() if but is None or r.get("batch") != but]
        filters = None
        for run in runs:
            own = self.spark.read.schema("_part int, bits binary").parquet(f"{self.path}/filters/{run}").withColumn("run", F.lit(run))
            filters = own if filters is None else filters.unionByName(own)
        if filters is None:
            return []
        hashed = rows.where(F.col(self.key).isNotNull()).select("_part", F.xxhash64(self.key).alias("h1"), F.xxhash64(F.lit(7), self.key).alias("h2"))

        def probe(key, left: pa.Table, right: pa.Table) -> pa.Table:
            h1, h2, out = left.column("h1").to_numpy(), left.column("h2").to_numpy(), []
            for run, blob in zip(right.column("run").to_pylist(), right.column("bits").to_pylist(), strict=True):
                bits = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
                if len(h1) and bits[_places(h1, h2, len(bits))].all(axis=1).any():
                    out.append(run)
            part = left.column("_part")[0].as_py() if left.num_rows else -1
            return pa.table([pa.array(out, pa.string()), pa.array([part] * len(out), pa.int32())], names=["run", "_part"])

        # a row for each run and part that is known, so as many as a manifest names at most
        found: dict[str, list[int]] = {}
        for r in hashed.groupBy("_part").cogroup(filters.groupBy("_part")).applyInArrow(probe, "run string, _part int").collect():
            found.setdefault(r["run"], []).append(r["_part"])
        return sorted((run, sorted(parts)) for run, parts in found.items())

    def unknown(self, rows: DataFrame, but: str | None = None) -> DataFrame:
        """The rows whose key isn't in the store; a null key never is."""
        rows = rows.withColumn("_part", part_of(self.key))
        hits = self.hits(rows, but)
        return (rows.join(self._keys(hits).select(self.key), self.key, "left_anti") if hits else rows).drop("_part")


def _filter(part: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["_part", "bits"])
