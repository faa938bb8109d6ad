"""Scores of model completions against answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonfix import completion_list
from ..functions.similarity import indel
from ..shared import table
from .matching import greedy_map, mapping_iou

#: From so many characters of a completion times names and affiliations of its answer on, a row is scored by joins.
ROW_WORK = 1_000_000


def rewards(df: DataFrame, id_col: str, completion: str, answer: str, row_work: int = ROW_WORK) -> DataFrame:
    """(id, format_reward, answer_reward) of completions; answer: array<struct<name, affiliations>>.

    A completion without a valid list scores 0 in both. Otherwise the answer's reward is the share
    of authors that map (their IoU; two empty lists give null) plus, for each mapped author with
    affiliations on both sides, the IoU of those. Each row is scored by itself, whatever its id, and
    without a shuffle; only rows too large for that, as their lengths tell, are mapped by joins.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(completion).alias("said"), F.col(answer).alias("want"))
    entries = F.aggregate("want", F.lit(0).cast("long"), lambda n, a: n + 1 + F.greatest(F.coalesce(F.size(a.affiliations), F.lit(0)), F.lit(0)))
    large = F.coalesce(F.length("said").cast("long") * entries > row_work, F.lit(False))
    out = _scored(rows.where(~large))
    if not rows.where(large).isEmpty():
        out = out.unionByName(_joined(table(rows.where(large).withColumn("g", F.monotonically_increasing_id()))))
    return out.withColumnRenamed("id", id_col)


def _nearest(source: list, target: list) -> list[int]:
    """For each source that has one its most similar target from 90 per cent on, as greedy_map finds it."""
    first: dict[str, int] = {}
    for j, t in enumerate(target):
        first.setdefault(t or "", j)
    known: dict[str, int | None] = {"": None}
    for x in source:
        x = x or ""
        if x in known:
            continue
        # nothing is more similar than an equal text
        known[x] = first.get(x)
        if known[x] is None:
            near = [(-indel(x, t) * 100, j) for t, j in first.items() if 200 * min(len(x), len(t)) >= 90 * (len(x) + len(t)) - 1e-6]
            score, j = min(near, default=(0.0, 0))
            known[x] = j if -score >= 90 else None
    return [known[x or ""] for x in source]


def _iou(near: list, target: list) -> float | None:
    found = [j for j in near if j is not None]
    whole = len(near) + len(target) - len(set(found))
    return len(found) / whole if whole else None


def answer_reward(got: list[dict | None], want: list[dict | None]) -> float | None:
    """The reward of one list of authors; a null element is an author without a name."""
    got, want = [a or {} for a in got], [a or {} for a in want]
    near = _nearest([a.get("name") for a in got], [a.get("name") for a in want])
    total = _iou(near, want)
    for a, j in zip(got, near, strict=True):
        s, t = (a.get("affiliations"), want[j].get("affiliations")) if j is not None else (None, None)
        if s and t:
            total += _iou(_nearest(s, t), t)
    return total


def _scored(rows: DataFrame) -> DataFrame:
    @F.arrow_udf("double")
    def run(got: pa.Array, want: pa.Array) -> pa.Array:
        return pa.array([0.0 if g is None else answer_reward(g, w or []) for g, w in zip(got.to_pylist(), want.to_pylist(), strict=True)], pa.float64())

    rows = rows.select("id", completion_list(F.col("said")).alias("got"), "want")
    return rows.select("id", F.col("got").isNotNull().cast("int").alias("format_reward"), run("got", "want").alias("answer_reward"))


def _joined(rows: DataFrame) -> DataFrame:
    """The same of rows (g, id, said, want), by joins of their names and affiliations."""
    rows = rows.select("g", "id", completion_list(F.col("said")).alias("got"), "want")
    good = rows.where("got is not null")
    side = lambda c: good.select("g", F.posexplode(c).alias("idx", "a")).select("g", "idx", F.col("a.name").alias("text"), F.col("a.affiliations").alias("affs"))
    got, want = side("got"), side("want")
    people = greedy_map(got, want, "g", "text")
    authors = mapping_iou(people, got, want, "g")
    pair = F.concat_ws(":", F.col("g").cast("string"), F.col("src_idx").cast("string")).alias("pair")
    source = people.join(got.withColumnRenamed("idx", "src_idx").select("g", "src_idx", F.col("affs").alias("s")), ["g", "src_idx"]).join(want.withColumnRenamed("idx", "tgt_idx").select("g", "tgt_idx", F.col("affs").alias("t")), ["g", "tgt_idx"]).where("size(s) > 0 and size(t) > 0")
    left = source.select("g", pair, F.posexplode("s").alias("idx", "text"))
    right = source.select("g", pair, F.posexplode("t").alias("idx", "text"))
    affs = mapping_iou(greedy_map(left, right, "pair", "text"), left, right, "pair")
    extra = left.select("g", "pair").distinct().join(affs, "pair").groupBy("g").agg(F.sum("iou").alias("extra"))
    out = rows.select("g", "id", F.col("got").isNotNull().alias("ok")).join(authors, "g", "left").join(extra, "g", "left")
    total = F.col("iou") + F.coalesce("extra", F.lit(0.0))
    return out.select("id", F.col("ok").cast("int").alias("format_reward"), F.when(F.col("ok"), total).otherwise(0.0).alias("answer_reward"))
