"""One-to-one matching of entities and of their attribute values within documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import MatchType, assign_pairs, edit_distance, similarity
from ..shared import table
from .near import GROUP_CELLS, assign_pairs_of_groups, near_pairs

#: Rows of a group that are compared with as many others at once, and pairs that a task makes.
TILE_ROWS, TASK_PAIRS = 1024, 4_000_000


def occurrence(df: DataFrame, keys: list[str], order: str, out: str = "occ") -> DataFrame:
    """Adds the rank of a row among those of equal keys, so that duplicates pair off instead of fanning out."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def strict_pairs(gt: DataFrame, pred: DataFrame, keys: list[str], idx: str = "idx") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs keys.., gt_idx, pred_idx; unmatched gt; unmatched pred) of rows with equal keys, one to one."""
    g = occurrence(gt, keys, idx).withColumnRenamed(idx, "gt_idx")
    p = occurrence(pred, keys, idx).withColumnRenamed(idx, "pred_idx")
    on = [*keys, "occ"]
    pairs = g.select(*on, "gt_idx").join(p.select(*on, "pred_idx"), on)
    return pairs.drop("occ"), g.join(p, on, "left_anti").drop("occ").withColumnRenamed("gt_idx", idx), p.join(g, on, "left_anti").drop("occ").withColumnRenamed("pred_idx", idx)


def strict_counts(gt: DataFrame, pred: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, tp, fp, fn) of strict one-to-one pairs without making them: of equal keys the smaller count pairs off."""
    side = lambda df, g, p: df.select(doc, key, F.lit(g).alias("g"), F.lit(p).alias("p"))
    n = side(gt, 1, 0).unionByName(side(pred, 0, 1)).groupBy(doc, key).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    n = n.withColumn("m", F.when(F.col(key).isNull(), 0).otherwise(F.least("g", "p")))
    return n.groupBy(doc).agg(F.sum("m").alias("tp"), F.sum(F.col("p") - F.col("m")).alias("fp"), F.sum(F.col("g") - F.col("m")).alias("fn"))


def fuzzy_pairs(gt: DataFrame, pred: DataFrame, doc: str, text: str, threshold: float, idx: str = "idx", kind: MatchType | None = None, cells: int = GROUP_CELLS) -> DataFrame:
    """(doc, gt_idx, pred_idx, score): the best one-to-one assignment of similar texts in each document.

    Meant for what strict pairs leave over, so documents without rows on both sides never reach
    Python. A document of up to `cells` pairs is one row and one call. In larger ones an index of
    rare grams (or a kind's blocks) finds the similar pairs by a join, and each connected component
    of them is assigned by itself; a kind without blocks has all its documents compared as rows.
    """
    gt, pred = (table(df.select(doc, F.col(idx).alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("_t"))) for df in (gt, pred))
    large = _large_groups(gt, pred, doc, cells, kind)
    few = lambda df: df if large is None else df.join(large.hint("merge"), doc, "left_anti")
    side = lambda df, name: few(df).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias(name))
    both = side(gt, "_g").join(side(pred, "_p"), doc)
    found = both.withColumn("_m", F.explode(assign_pairs(F.col("_g._t"), F.col("_p._t"), threshold, kind.score if kind else None)))
    found = found.select(doc, F.element_at("_g", F.col("_m.l") + 1)["_i"].alias("gt_idx"), F.element_at("_p", F.col("_m.r") + 1)["_i"].alias("pred_idx"), F.col("_m.score").alias("score"))
    if large is None:
        return found
    gt, pred = (df.join(large.hint("merge"), doc, "left_semi") for df in (gt, pred))
    return found.unionByName(assign_pairs_of_groups(gt, pred, doc, "_t", near_pairs(gt, pred, doc, "_t", threshold, kind), "_i"))


def _large_groups(left: DataFrame, right: DataFrame, group: str, cells: int, kind: MatchType | None) -> DataFrame | None:
    """The groups with more than so many pairs of rows, if their similar pairs can be found by a join; none if there are none."""
    if kind is not None and kind.blocks is None:
        return None
    count = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    large = table(count(left, "_l").join(count(right, "_r"), group).where(F.col("_l") * F.col("_r") > cells).select(group))
    return None if large.isEmpty() else large


def compare_values(gt: Column, pred: Column) -> dict[str, Column]:
    """Sorted distinct values that both arrays have, and that one has alone."""
    g, p = F.coalesce(gt, F.expr("cast(array() as array<string>)")), F.coalesce(pred, F.expr("cast(array() as array<string>)"))
    return {"matched": F.array_sort(F.array_intersect(g, p)), "missing": F.array_sort(F.array_except(g, p)), "extra": F.array_sort(F.array_except(p, g))}


def greedy_map(source: DataFrame, target: DataFrame, group: str, text: str, threshold: float = 90.0, idx: str = "idx", kind: MatchType | None = None, cells: int = GROUP_CELLS) -> DataFrame:
    """(group, src_idx, tgt_idx, score): each source's most similar target of its group, from the threshold on.

    Several sources may have one target; equal scores go to the first target. Raw text, 0 to 100; a
    registered kind's score is a share too. Distinct texts are compared, so copies cost nothing: all
    pairs of a group of up to `cells` pairs, and in larger ones those that a join on rare grams (or
    on a kind's blocks) finds with the threshold as bound. Only a threshold of 0, which every pair
    meets, or a kind without blocks has all pairs of a large group compared.
    """
    name = F.col(group).cast("string").alias("_g")
    s = table(source.select(name, F.col(group).alias("_group"), F.col(idx).alias("src_idx"), F.coalesce(F.col(text), F.lit("")).alias("_t")))
    t = target.select(name, F.col(idx).alias("tgt_idx"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # of equal targets the first one counts
    t = table(t.groupBy("_g", "_t").agg(F.min("tgt_idx").alias("tgt_idx")))
    asked = s.select("_g", "_t").distinct()
    large = _large_groups(asked, t, "_g", cells, kind) if threshold > 0 else None
    few = lambda df: df if large is None else df.join(large.hint("merge"), "_g", "left_anti")
    pairs = few(asked).withColumnRenamed("_t", "a").join(few(t).select("_g", F.col("_t").alias("b")), "_g")
    if kind is None:
        # texts whose lengths don't allow the threshold never reach Python
        pairs = pairs.where(200 * F.least(F.length("a"), F.length("b")) >= threshold * (F.length("a") + F.length("b")) - 1e-6)
    pairs = pairs.withColumn("score", similarity(F.col("a"), F.col("b"), kind.score if kind else None))
    if large is not None:
        near = near_pairs(*(df.join(large.hint("merge"), "_g", "left_semi") for df in (asked, t)), "_g", "_t", threshold / 100 - 1e-12, kind)
        pairs = pairs.unionByName(near.withColumnRenamed("group", "_g"))
    pairs = pairs.withColumn("score", F.col("score") * 100).where(F.col("score") >= threshold)
    placed = pairs.join(t.withColumnRenamed("_t", "b"), ["_g", "b"])
    rank = F.row_number().over(Window.partitionBy("_g", "a").orderBy(F.desc("score"), "tgt_idx"))
    best = placed.withColumn("_r", rank).where("_r = 1").select("_g", F.col("a").alias("_t"), "tgt_idx", "score")
    return s.join(best, ["_g", "_t"]).select(F.col("_group").alias(group), "src_idx", "tgt_idx", "score")


def mapping_iou(mapping: DataFrame, source: DataFrame, target: DataFrame, group: str, idx: str = "idx") -> DataFrame:
    """(group, mapped, iou): mapped / (unmapped sources + unmapped targets + mapped); null if both sides are empty."""
    n = lambda df, name: df.groupBy(group).agg(F.count(idx).alias(name))
    m = mapping.groupBy(group).agg(F.count("*").alias("mapped"), F.count_distinct("tgt_idx").alias("targets"))
    out = n(source, "s").join(n(target, "t"), group, "full").join(m, group, "left").na.fill(0)
    whole = F.col("s") - F.col("mapped") + F.col("t") - F.col("targets") + F.col("mapped")
    return out.select(group, "mapped", F.when(whole > 0, F.col("mapped") / whole).alias("iou"))


def edit_pairs(df: DataFrame, key: str, text: str, *groups: str, tile: int = TILE_ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b, edits): all pairs of keys a < b whose rows agree in the group columns, with the edit distance of their texts.

    The work is dealt by pairs, of which a small table may have very many. Rows of a group are dealt
    into tiles by a hash of their key, each two tiles (and each with itself) meet once, and there is
    a task for every task_pairs pairs. In two tiles each two distinct texts are compared once. Rows
    with a null key or group are in no pair; a null text has null edits.
    """
    rows = df.select(*groups, F.col(key).alias("_k"), F.col(text).alias("_t")).dropna(subset=[*groups, "_k"])
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0.0
    tasks = int(pairs // task_pairs) + 1
    dealt = rows.join(sizes, list(groups)).withColumn("_m", F.ceil(F.col("_n") / tile)).withColumn("_own", F.pmod(F.xxhash64("_k"), F.col("_m")))
    unit = [*groups, "_i", "_j"]

    def side(name, i, j):
        # a number of partitions that is asked for isn't reduced for their few bytes
        met = dealt.select(*groups, i.alias("_i"), j.alias("_j"), "_t", "_k")
        return met.repartition(tasks, *unit).groupBy(*unit, F.col("_t").alias(f"_t{name}")).agg(F.collect_list("_k").alias(f"_{name}"))

    own, last = F.col("_own"), F.col("_m") - 1
    left, right = side("a", own, F.explode(F.sequence(own, last))), side("b", F.explode(F.sequence(F.lit(0).cast("long"), own)), own)
    met = left.join(right, unit).withColumn("edits", edit_distance(F.col("_ta"), F.col("_tb")).cast("long"))
    met = met.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b")).where("_i < _j or _a < _b")
    return met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "edits")


def canonical_ids(df: DataFrame, known: DataFrame, id_col: str, normal, *pos: str) -> DataFrame:
    """Replaces ids by the spelling of `known` (a column of the same name) where the normal forms agree.

    Of several spellings the last by the columns pos of `known` counts; without pos the largest text.
    """
    place = F.struct(*pos, id_col) if pos else F.col(id_col)
    spelling = known.select(F.col(id_col).alias("_k"), normal(F.col(id_col)).alias("_n"), place.alias("_p")).groupBy("_n").agg(F.max_by("_k", "_p").alias("_k"))
    out = df.withColumn("_n", normal(F.col(id_col))).join(spelling, "_n", "left")
    return out.withColumn(id_col, F.coalesce("_k", "_n")).drop("_k", "_n")
