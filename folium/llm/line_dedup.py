"""Removal of lines that many sites share, by sketches of each line's sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LG_K = 12
#: Estimates this near the threshold, as factors, are replaced by exact counts. At 2**12 registers
#: one standard error is 1.6 per cent, so this is over ten of them.
NEAR = (0.8, 1.25)


def shared_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of lines that at least min_sites distinct sites have. lines: h1, h2, site."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= NEAR[0] * min_sites)
    spread = table(spread)
    near = spread.where(F.col("sites") <= NEAR[1] * min_sites).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > NEAR[1] * min_sites).select("h1", "h2")
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))


def remove_shared_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """Takes lines that occur on min_sites or more distinct sites out of every document.

    Returns all columns of df, with the kept lines in text_col, and _n_lines and _n_removed, which
    replace columns of those names. Lines end at a line feed and are compared without blanks at
    either end; blank lines are kept. All of a line's copies go, also within one site's documents.

    Sketches of the sites of each line are built before the shuffle and merged after it; only lines
    whose estimate is near the threshold are counted exactly. Null sites count as none. A null text
    stays null with no lines; a document may end up empty. Rows are told apart by id and text, so
    null and repeated ids are fine, and equal rows get equal results. Texts and lines of any length
    are taken whole; an empty table gives an empty result.
    """
    text = F.col(text_col)
    key = [F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(7), text, F.col(id_col)).alias("k2")]
    lines = df.where(text.isNotNull()).select(*key, F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim(F.col("line"), F.lit(" \t\r\u000b\u000c"))).where("line <> ''")
    lines = table(lines.select("k1", "k2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2")))
    gone = lines.join(shared_lines(lines, min_sites), ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    # the row travels as one struct, so that none of its columns can clash with those added
    out = df.select(*key, F.struct(*df.columns).alias("row")).join(gone, ["k1", "k2"], "left")
    text = F.col(f"row.`{text_col}`")
    parts = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("_n_lines")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("_n_removed")
    own = [c for c in df.columns if c not in ("_n_lines", "_n_removed")]
    columns = [F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own]
    return out.select(*columns, n_lines, n_removed)
