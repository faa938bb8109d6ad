"""Rendering of logged conversations of which only the longest snapshots are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table


def collapse_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Renders the conversations whose turns aren't the beginning of a longer conversation's.

    Returns id_col, n_turns, n_prefixes (other logged conversations that it contains as beginnings
    or copies, itself not counted, all of its own prefix hashes considered), rendered. Of
    conversations with the same turns the one with the smallest id stays.

    Each turn has a rolling 128-bit hash of all turns up to it: the exclusive or of hashes of
    (position, role, text). Conversations whose last hash is a shorter hash of another are
    anti-joined away; hashes are summed up before that join, so that a first turn that very many
    conversations share is one row. Turns are ordered by turn, role and text; equal rows of a
    conversation are one turn; a null role is `unknown`, a null text empty, a null turn comes first.
    Texts of any length are hashed and rendered whole. Rows without an id are left out; an empty
    table gives an empty result. Other columns, whatever their names, aren't used.
    """
    turns = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("t"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).distinct()
    order = Window.partitionBy("c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    hashed = placed.withColumns({"p1": F.expr("bit_xor(xxhash64(i, r, x))").over(so_far), "p2": F.expr("bit_xor(xxhash64(17, x, r, i))").over(so_far)})
    heads = table(hashed.select("c", "i", "n", "p1", "p2"))
    whole = heads.where("i = n").select("c", "n", "p1", "p2")
    # for each beginning: the longest conversation with it, and the first that ends there
    known = heads.groupBy("i", "p1", "p2").agg(F.max("n").alias("longest"), F.min(F.when(F.col("i") == F.col("n"), F.col("c"))).alias("first"), F.sum((F.col("i") == F.col("n")).cast("long")).alias("ends"))
    # from a table, so that joins have plain shuffles on both sides and hot beginnings can be split
    known = table(known)
    same = [F.col("n") == F.col("i"), F.col("w.p1") == F.col("k.p1"), F.col("w.p2") == F.col("k.p2")]
    maximal = whole.alias("w").join(known.alias("k"), [*same, (F.col("longest") > F.col("n")) | (F.col("first") < F.col("c"))], "left_anti").select("c")
    inner = heads.join(maximal, "c", "left_semi").join(known.where("ends > 0").select("i", "p1", "p2", "ends"), ["i", "p1", "p2"]).groupBy("c").agg((F.sum("ends") - 1).alias("n_prefixes"))
    part = F.concat(F.lit("<|"), F.col("r"), F.lit("|>\n"), F.col("x"), F.lit("<|end|>\n"))
    text = placed.join(maximal, "c", "left_semi").groupBy("c").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("i", part.alias("s")))).alias("parts"))
    out = text.join(inner, "c").select(F.col("c").alias(id_col), "n_turns", "n_prefixes", F.array_join(F.col("parts.s"), "").alias("rendered"))
    return out
