"""Versions, resolution of ids against a listing, resume and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..shared import table


def best_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order; each task passes on one row of a key."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")


def latest_versions(listing: DataFrame, path: str = "path", pos: str = "src_pos") -> DataFrame:
    """(paper_id, version, path, local_path): the highest version of each paper, the first listed of equals."""
    rows = listing.withColumn("e", ids.listed_paper(F.col(path))).where("e is not null")
    rows = rows.select("e.paper_id", "e.version", F.col(path).alias("path"), "e.local_path", F.col(pos).alias("_p"))
    return best_per(rows, "paper_id", F.desc("version"), F.col("_p")).drop("_p")


def last_wins(df: DataFrame, key: str | list[str], *pos: str) -> DataFrame:
    """The last row of each key."""
    return best_per(df, key, *(F.desc(p) for p in pos))


def resolve(requested: DataFrame, manifest: DataFrame, listing: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """(id, url, status): each requested id's newest file by the manifest, else by a constructed link, else not_found.

    manifest: id_col, url. listing: url of every object there is; it is what links are probed against.
    """
    wanted = requested.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    hit = best_per(wanted.join(manifest, id_col), id_col, F.desc(ids.file_version(F.col("url"))), F.col("url")).select(id_col, "url")
    rest = wanted.join(hit, id_col, "left_anti").withColumn("base", ids.base_url(ids.paper_url(F.col(id_col))))
    there = listing.select("url", ids.base_url(F.col("url")).alias("base"))
    probed = best_per(rest.where("base is not null").join(there, "base"), id_col, F.desc(ids.file_version(F.col("url"))), F.col("url")).select(id_col, "url")
    found = hit.withColumn("status", F.lit("manifest")).unionByName(probed.withColumn("status", F.lit("constructed")))
    none = wanted.join(found, id_col, "left_anti").select(id_col, F.lit(None).cast("string").alias("url"), F.lit("not_found").alias("status"))
    return found.unionByName(none)


def not_present(wanted: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't there yet (resume)."""
    return wanted.join(present.select(on).distinct(), on, "left_anti")


def not_downloaded(wanted: DataFrame, files: DataFrame, on: str, length: str = "length", least: int = 4096) -> DataFrame:
    """Rows whose file isn't there or is no longer than `least` bytes, as broken downloads are."""
    return not_present(wanted, files.where(F.col(length) > least), on)


def set_sides(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(value, side) of the distinct values of two tables: left, right or both."""
    a, b = left.select(on).distinct().withColumn("_l", F.lit(1)), right.select(on).distinct().withColumn("_r", F.lit(1))
    return a.join(b, on, "full").select(on, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("side"))


def pending(resolved: DataFrame, todo: DataFrame, on: str) -> DataFrame:
    return resolved.join(todo.select(on).distinct(), on, "left_semi")


def by_base_name(df: DataFrame, path: str, out: str = "name") -> DataFrame:
    return df.withColumn(out, ids.base_name(F.col(path)))


def restrict_to_names(manifest: DataFrame, names: DataFrame, path: str = "pdf_path") -> tuple[DataFrame, DataFrame]:
    """(manifest rows of the named files, names that have none)."""
    named = by_base_name(manifest, path, "name")
    return named.join(names, "name", "left_semi").drop("name"), names.join(named, "name", "left_anti")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds n = 1, 2, ... over a global order, without bringing rows into one task.

    Rows are range-sorted; each partition counts its own, and the partitions' first numbers are
    joined on. Only the counts of the partitions are summed in one place. The sorted rows are kept
    in a table, since a second range sort could draw other bounds.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    rows = table(rows)
    counts = rows.groupBy("_p").agg(F.count("*").alias("c"), F.min("_m").alias("_lo"))
    first = counts.withColumn("base", F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_lo", F.coalesce("base", F.lit(0)).alias("base"))
    return rows.join(F.broadcast(first), "_p").withColumn("n", F.col("base") + F.col("_m") - F.col("_lo") + 1).drop("_p", "_m", "_lo", "base")  # a row for each partition


def batches(df: DataFrame, *order: str, size: int | None = None, count: int | None = None) -> DataFrame:
    """Adds batch = 1, 2, ...: contiguous runs of `size` rows, or of the size that gives at most `count` batches."""
    if (size is None) == (count is None):
        raise ValueError("give either size or count")
    if size is None:
        size = max(1, -(-df.count() // count))
    return numbered(df, *order).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long") + 1).drop("n")


def input_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """(document_id, pdf_path) of files; the id is the file's name without its last suffix."""
    return files.select(F.regexp_replace(ids.base_name(F.col(path)), r"\.[^.]*$", "").alias("document_id"), F.col(path).alias("pdf_path"))
