"""Rows of usable vectors, with exact copies taken together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def marked(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>, ok): ok where there is an id and the vector is not null, not zero and has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("ok"))
    return rows.withColumn("ok", F.col("ok") & F.col("id").isNotNull())


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, v array<double>) of the rows that marked() finds good."""
    return marked(df, id_col, vector_col).where("ok").drop("ok")


def distinct(rows: DataFrame, most_ids: int = 1) -> DataFrame:
    """A row per distinct vector: rep (smallest id), copies (rows), v and, if asked for, its smallest ids."""
    out = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    if most_ids > 1:
        # each task passes on no more than most_ids rows of a vector
        rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        some = rows.withColumn("r", rank).where(F.col("r") <= most_ids).groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids"))
        return some
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
