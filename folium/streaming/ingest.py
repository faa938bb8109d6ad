"""Incremental ingestion: new files are appended once, whatever is there already is skipped."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .keys import KeyStore


def drop_folder(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream of the files of a folder, or of one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(where):
        path, pattern = path.rsplit("/", 1)
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, key: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Appends what the stream brings until it has caught up; with a key, only rows whose key isn't there yet.

    Rows land in out/batch-<run>-<number>, where run is a hash of the checkpoint's path: a batch
    that is run again after a failure overwrites its own folder, so nothing is doubled, and a stream
    with a new checkpoint never overwrites another's. The keys that are there are kept in the folder
    <out>-keys (see KeyStore), so a batch reads keys and not rows, and only those parts of them whose
    filters know one of its own. Read what has landed with landed().
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{run}-{number}"
        if key is None:
            batch.write.mode("overwrite").format(fmt).save(f"{out}/batch-{own}")
            return
        store = KeyStore(spark, f"{out}-keys", key, batch.schema[key].dataType)
        store.compact(but=own)
        batch = batch.dropDuplicates([key]).persist()
        try:
            new = store.unknown(batch, but=own)
            new.write.mode("overwrite").format(fmt).save(f"{out}/batch-{own}")
            store.add(own, spark.read.format(fmt).schema(new.schema).load(f"{out}/batch-{own}"))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed(spark: SparkSession, out: str, schema, fmt: str = "parquet") -> DataFrame:
    """All rows that append_new has written."""
    return spark.read.format(fmt).option("recursiveFileLookup", True).schema(schema).load(out)


def server_load(lines: DataFrame, *more: str) -> DataFrame:
    """(value, more.., running, waiting) of a server's log lines that tell of its load."""
    n = lambda word: F.nullif(F.regexp_extract("value", rf"(?i){word}[:=]?\s*([0-9]+)", 1), F.lit("")).try_cast("int")
    return lines.select("value", *more, n("running").alias("running"), n("(?:waiting|pending)").alias("waiting")).where("running is not null or waiting is not null")


def peak_load(lines: DataFrame) -> DataFrame:
    return server_load(lines).agg(F.max("running").alias("peak_running"), F.max("waiting").alias("peak_waiting"))
