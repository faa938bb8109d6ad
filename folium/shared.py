"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="folium-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir() or root
    return f"{root.rstrip('/')}/folium-{uuid.uuid4().hex}"


class Scope:
    """Tables that were written in it and not kept."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Leaves this table there when the scope ends."""
        self.made = [t for t in self.made if t is not df]
        return df


_scopes: list[Scope] = []


@contextmanager
def scope() -> Iterator[Scope]:
    """Deletes on exit what table() writes inside; results must have been written, or kept, by then."""
    own = Scope()
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes.remove(own)
        drop_tables(*own.made)


def table(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    if _scopes:
        _scopes[-1].made.append(out)
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what table() wrote, once nothing reads it any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_table_path", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
