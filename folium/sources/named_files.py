"""A Python data source that writes one named file for each document, category or batch."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_ASIDE = "_writing"


def _open(path: str):
    """(file system, path there) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where it has put them, for which names."""

    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    """Tasks write into folders of their own; the commit moves whole files to their names, an abort leaves none."""

    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header, self.overwrite, self.run = path, header, overwrite, uuid.uuid4().hex
        # made here, on the driver, and not by tasks: one that outlives an abort finds it gone and fails
        _open(path)[0].create_dir(self.aside, recursive=True)

    @property
    def aside(self) -> str:
        return posixpath.join(_open(self.path)[1], f"{_ASIDE}-{self.run}")

    def write(self, rows: Iterator) -> Written:
        files, _ = _open(self.path)
        # an attempt that is lost never shares a folder with the one that takes its place
        folder = posixpath.join(self.aside, uuid.uuid4().hex)
        files.create_dir(folder, recursive=False)
        names, name, file = [], None, None
        try:
            for row in rows:
                if row[0] != name:
                    if file:
                        file.close()
                    name = row[0]
                    if name in (None, "", ".", "..") or "/" in name or "\0" in name or name.startswith(_ASIDE):
                        raise ValueError(f"{name!r} is no name of a file")
                    if names and name <= names[-1]:
                        raise ValueError("rows must come in order of their names")
                    names.append(name)
                    file = files.open_output_stream(posixpath.join(folder, name), compression=None)
                    if self.header:
                        file.write((self.header + "\n").encode())
                file.write((row[1] or "").encode("utf-8", "surrogatepass"))
        finally:
            if file:
                file.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        told = [m for m in messages if m is not None]
        every = [n for m in told for n in m.names]
        if len(set(every)) != len(every):
            self.abort(messages)
            raise ValueError("a name comes from two tasks; repartition by it")
        if self.overwrite:
            from pyarrow import fs

            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        for m in told:
            for n in m.names:
                files.move(posixpath.join(m.folder, n), posixpath.join(root, n))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, _ = _open(self.path)
        for last in (False, False, True):
            try:
                if files.get_file_info(self.aside).type == fs.FileType.Directory:
                    files.delete_dir(self.aside)
                return
            except OSError:  # a task that is being stopped has just written there
                if last:
                    raise
                time.sleep(0.5)


class NamedFiles(DataSource):
    """Format `named_files`: rows (name, text), whose texts go to path/name in the order they come. Option: header."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("header", ""), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def named_files(df: DataFrame, name: str, text: str, path: str, order: str | None = None, header: str = "", files_each: int = 2000, overwrite: bool = True) -> None:
    """Writes the texts of each name, one after the other by `order`, to the file path/name.

    Tasks write many files each, some files_each of them, one at a time; a name's rows are in one
    task, since they are one file. Files appear under their names only when all tasks are done, so a
    task that is killed leaves no half file. path may be any that pyarrow can open on driver and
    executors; the package must be on the workers' path.
    """
    spark = df.sparkSession
    register(spark)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"), *([F.col(order).alias("_o")] if order else []))
    parts = max(1, -(-rows.select("name").distinct().count() // files_each))
    rows = rows.repartition(max(parts, min(spark.sparkContext.defaultParallelism, 8 * parts)), "name").sortWithinPartitions("name", *(["_o"] if order else []))
    rows.select("name", "text").write.format("named_files").mode("overwrite" if overwrite else "append").option("header", header).save(path)
