"""Pairs of similar texts within groups, and their one-to-one assignment, without comparing all pairs of a group."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import MatchType, assignment, indel_ratio, similarity
from ..graphs import components
from ..shared import drop_tables, table

#: Groups of more cells (texts of one side times those of the other) go through the candidate join.
GROUP_CELLS = 10_000
#: Components of more cells are assigned along their edges; smaller ones as a matrix.
MATRIX_CELLS = 250_000
_CELL = "group string, a string, b string, first_a long, first_b long, flow long"


def least_common(total: int, threshold: float, q: int = 1) -> int:
    """How many q-grams, counted with repeats, two texts with `total` characters have in common at least if their Indel similarity is threshold or more.

    They share a subsequence of c >= threshold * total / 2 characters. What is not in it, total - 2c
    characters, breaks a neighbourhood of q of its characters at most q - 1 times each.
    """
    c = max(1, math.ceil(threshold * total / 2 - 1e-9))
    return c - (q - 1) * (1 + total - 2 * c)


def gram_classes(threshold: float) -> list[tuple[int, int, int, int | None]]:
    """(q, grams that must agree, least and largest total length): the pairs that each kind of gram finds, of all lengths once.

    Two pairs of neighbouring characters are asked for where the threshold promises them, else one character.
    """
    slope = 1.5 * threshold - 1
    if slope < 0.1:
        return [(1, 1, 1, None)]
    # from so many characters on the promise holds for certain; below, it is looked up
    sure = math.ceil((2 + 1) / slope) + 1
    first = max([n for n in range(1, sure + 1) if least_common(n, threshold, 2) < 2], default=0) + 1
    return [(2, 2, first, None), (1, 1, 1, first - 1)]


def _tokens(q: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            seen: dict[str, int] = {}
            out = []
            for i in range(len(t) - q + 1):
                g = t[i : i + q]
                seen[g] = seen.get(g, 0) + 1
                out.append(f"{g}{seen[g]}")
            return out

        return texts.map(one)

    return run


def _index(rows: DataFrame, q: int, agree: int, low: int, high: int | None, threshold: float) -> DataFrame:
    """(group, side, text, n, prefix, key) of rows (group, side, text, n): the keys of one class of grams.

    A text's grams are put in order of their frequency in all rows, the rarest first. If two texts
    have enough grams in common, they agree in `agree` of the first ones (the prefix) already.
    """
    share = threshold / (2 - threshold)
    n = F.col("n")
    least, most = F.greatest(F.lit(1), F.ceil(n * share - 1e-9)), F.floor(F.least(n / share + 1e-9, F.lit(1e9)))
    start = F.greatest(n + least, F.lit(low)).cast("long")
    stop = F.least(n + most, F.lit(2**31 if high is None else high)).cast("long")
    common = lambda s: F.greatest(F.lit(1), F.ceil(threshold * s / 2 - 1e-9)).cast("long")
    needed = lambda s: F.greatest(common(s) * (2 * q - 1) - (q - 1) * (1 + s), F.lit(agree))
    # with single characters more are needed the longer the pair; with more, within so many lengths they are needed most rarely
    reach = 0 if q == 1 else math.ceil((2 * q - 1) / (1.5 * threshold - 1))
    need = F.array_min(F.transform(F.sequence(start, F.least(stop, start + reach)), needed))
    able = rows.where((start <= stop) & (n >= q)).withColumn("need", need).where((F.col("need") <= n - (q - 1)))
    able = able.withColumn("keep", (n - (q - 1) - F.col("need") + agree).cast("int"))
    each = able.withColumn("token", F.explode(_tokens(q)("text")))
    rarity = each.groupBy("token").agg(F.count("*").alias("_f"))
    placed = F.concat(F.lpad(F.col("_f").cast("string"), 12, "0"), "token")
    listed = each.join(rarity, "token").groupBy("group", "side", "text", "n", "keep").agg(F.sort_array(F.collect_list(placed)).alias("prefix"))
    listed = listed.withColumn("prefix", F.slice("prefix", F.lit(1), F.col("keep")))
    if agree == 1:
        keys = F.col("prefix")
    else:
        keys = F.flatten(F.transform("prefix", lambda x, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda y: F.concat(x, F.lit("\n"), y))))
    return listed.select("group", "side", "text", "n", "prefix", F.explode(keys).alias("key"))


def near_pairs(left: DataFrame, right: DataFrame, group: str, text: str, threshold: float, kind: MatchType | None = None) -> DataFrame:
    """(group, a, b, score): all pairs of distinct texts of a group, one of each side, whose similarity is at least the threshold.

    By Indel similarity (kind None): texts are indexed by their rarest grams (see least_common and
    _index) and joined on them; a pair is taken where its first common key is, so once. Lengths and
    then a banded edit distance are checked before the exact similarity. A registered kind gives its
    own keys and bound. Empty texts are similar to nothing, unless a kind's keys say so. A group may
    be of any size: the join is on group and key.
    """
    threshold = min(max(threshold, 1e-9), 1.5)
    side = lambda df, s: df.select(F.col(group).cast("string").alias("group"), F.lit(s).alias("side"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    both = side(left, "a").unionByName(side(right, "b")).withColumn("n", F.length("text"))
    if kind is not None:
        keyed = both.withColumn("prefix", F.array_distinct(kind.blocks(F.col("text"))))
        keyed = keyed.withColumn("key", F.explode("prefix"))
        fits = lambda a, b: F.lit(True) if kind.bound is None else kind.bound(F.col(a), F.col(b), threshold)
        met = _met(keyed, 1).where(fits("a", "b"))
        return met.withColumn("score", similarity(F.col("a"), F.col("b"), kind.score)).where(F.col("score") >= threshold).select("group", "a", "b", "score")
    both = table(both.where("n > 0"))
    found = None
    for q, agree, low, high in gram_classes(threshold):
        met = _met(_index(both, q, agree, low, high, threshold), agree)
        total = F.col("na") + F.col("nb")
        fits = (2 * F.least("na", "nb") >= threshold * total - 1e-9) & (total >= low)
        fits = fits if high is None else fits & (total <= high)
        met = met.where(fits)
        found = met if found is None else found.unionByName(met)
    # insertions and deletions are edits too, so an edit distance above what is left over rules a pair out
    left_over = (F.col("na") + F.col("nb") - 2 * F.ceil(threshold * (F.col("na") + F.col("nb")) / 2 - 1e-9)).cast("int")
    found = found.withColumn("_d", left_over).where(F.expr("levenshtein(a, b, _d) >= 0"))
    return found.withColumn("score", indel_ratio("a", "b")).where(F.col("score") >= threshold).select("group", "a", "b", "score")


def _met(keyed: DataFrame, agree: int) -> DataFrame:
    """(group, a, na, b, nb) of texts of both sides that share a key, each pair at its first common one."""
    left = keyed.where("side = 'a'").select("group", "key", F.col("text").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    right = keyed.where("side = 'b'").select("group", "key", F.col("text").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
    first = F.array_join(F.slice(F.array_intersect("pa", "pb"), 1, agree), "\n")
    # both sides grow with the input; a key that many texts of a group have is split by adaptive execution
    return left.join(right.hint("merge"), ["group", "key"]).where(first == F.col("key")).drop("key", "pa", "pb")


def flow_assignment(edges: list[tuple[int, int, float]], left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
    """(i, j, flow) with the largest total weight; left and right say how often each may be used.

    One left node after the other is placed along a cheapest path: to a right node that is free, or
    to a left one that does better without a partner. Prices keep all costs from being negative, so
    a search stays where prices have to change. Copies of a text are one node, so neither time nor
    memory follows their pairs.
    """
    out: list[list[tuple[int, float, int]]] = [[] for _ in left]
    for k, (i, j, w) in enumerate(edges):
        out[i].append((j, w, k))
    flow, used = [0] * len(edges), [set() for _ in right]
    free = list(right)
    price_left, price_right = [max((w for _, w, _ in own), default=0.0) for own in out], [0.0] * len(right)
    for start, wanted in enumerate(left):
        while wanted and out[start]:
            far_left, far_right = {start: 0.0}, {}
            came_left, came_right = {}, {}
            heap = [(0.0, 0, start)]
            best, end = math.inf, (0, start)
            while heap:
                d, side, x = heapq.heappop(heap)
                if d >= best:
                    break
                if side == 0:
                    if d > far_left[x]:
                        continue
                    # without a partner
                    if d + max(0.0, price_left[x]) < best:
                        best, end = d + max(0.0, price_left[x]), (0, x)
                    for j, w, k in out[x]:
                        new = d + max(0.0, price_left[x] - w - price_right[j])
                        if new < far_right.get(j, math.inf) - 1e-13:
                            far_right[j], came_right[j] = new, k
                            heapq.heappush(heap, (new, 1, j))
                else:
                    if d > far_right[x]:
                        continue
                    if free[x] and d + max(0.0, price_right[x]) < best:
                        best, end = d + max(0.0, price_right[x]), (1, x)
                    for k in used[x]:
                        i, _, w = edges[k]
                        new = d + max(0.0, w + price_right[x] - price_left[i])
                        if new < far_left.get(i, math.inf) - 1e-13:
                            far_left[i], came_left[i] = new, k
                            heapq.heappush(heap, (new, 0, i))
            path, amount, (side, x) = [], wanted, end
            if side == 1:
                amount = min(amount, free[x])
            while (side, x) != (0, start):
                if side == 1:
                    k = came_right[x]
                    path.append((k, 1))
                    side, x = 0, edges[k][0]
                else:
                    k = came_left[x]
                    path.append((k, -1))
                    amount = min(amount, flow[k])
                    side, x = 1, edges[k][1]
            for k, sign in path:
                flow[k] += sign * amount
                (used[edges[k][1]].add if flow[k] else used[edges[k][1]].discard)(k)
            if end[0] == 1:
                free[end[1]] -= amount
            wanted -= amount
            for x, d in far_left.items():
                if d < best:
                    price_left[x] += d - best
            for x, d in far_right.items():
                if d < best:
                    price_right[x] += d - best
    return [(i, j, f) for (i, j, _), f in zip(edges, flow, strict=True) if f]


def assign_component(a: list[str], b: list[str], score: list[float], copies_a: list[int], copies_b: list[int]) -> list[tuple[str, str, int, int, int]]:
    """(text, text, first copy of each, pairs of copies) of the best one-to-one assignment of a component's texts.

    Rows are its pairs, with how often each text is there. Ties go to the smaller texts.
    """
    names_a, names_b = sorted(set(a)), sorted(set(b))
    place_a, place_b = ({x: i for i, x in enumerate(names)} for names in (names_a, names_b))
    many_a, many_b = [0] * len(names_a), [0] * len(names_b)
    edges = sorted((place_a[x], place_b[y], s) for x, y, s in zip(a, b, score, strict=True))
    for x, y, p, q in zip(a, b, copies_a, copies_b, strict=True):
        many_a[place_a[x]], many_b[place_b[y]] = p, q
    if sum(many_a) * sum(many_b) <= MATRIX_CELLS:
        own_a, own_b = np.repeat(np.arange(len(many_a)), many_a), np.repeat(np.arange(len(many_b)), many_b)
        w = np.zeros((len(many_a), len(many_b)))
        for i, j, s in edges:
            w[i, j] = s
        used: dict[tuple[int, int], int] = {}
        for i, j in assignment(w[np.ix_(own_a, own_b)]):
            cell = int(own_a[i]), int(own_b[j])
            used[cell] = used.get(cell, 0) + 1
        found = [(i, j, f) for (i, j), f in sorted(used.items())]
    else:
        found = flow_assignment(edges, many_a, many_b)
    next_a, next_b, out = [0] * len(names_a), [0] * len(names_b), []
    for i, j, f in found:
        out.append((names_a[i], names_b[j], next_a[i], next_b[j], f))
        next_a[i] += f
        next_b[j] += f
    return out


def assign_pairs_of_groups(left: DataFrame, right: DataFrame, group: str, text: str, pairs: DataFrame, idx: str = "idx") -> DataFrame:
    """(group, gt_idx, pred_idx, score): the best one-to-one assignment of rows along pairs (group, a, b, score) of their texts.

    Connected components of the pairs are found by Spark, so a task gets a component, as edges
    between distinct texts with the number of their copies, and not a group. The copies of a text are
    used in order of idx.
    """
    pairs = table(pairs)
    node = lambda s, c: F.xxhash64("group", F.lit(s), c)  # noqa: E731  equal hashes would only join two components
    edges = pairs.select(node("a", "a").alias("a"), node("b", "b").alias("b"))
    parts = components(edges).withColumnRenamed("v", "_v")
    rank = F.row_number().over(Window.partitionBy("group", "text").orderBy(idx)).cast("long") - 1
    side = lambda df: df.select(F.col(group).cast("string").alias("group"), F.col(group).alias("_g"), F.coalesce(F.col(text), F.lit("")).alias("text"), idx).withColumn("rank", rank)
    gt, pred = side(left), side(right)
    count = lambda df, t, c: df.groupBy("group", F.col("text").alias(t)).agg(F.count("*").alias(c))
    rows = pairs.withColumn("_v", node("a", "a")).join(parts.hint("merge"), "_v")
    rows = rows.join(count(gt, "a", "na").hint("merge"), ["group", "a"]).join(count(pred, "b", "nb").hint("merge"), ["group", "b"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, own in part.groupby("group", sort=True):
            found = assign_component(*(own[c].tolist() for c in ("a", "b", "score", "na", "nb")))
            out += [(g, *f) for f in found]
        return pd.DataFrame(out, columns=["group", "a", "b", "first_a", "first_b", "flow"])

    used = rows.groupBy("component").applyInPandas(solve, _CELL)
    used = used.join(pairs.hint("merge"), ["group", "a", "b"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("flow") - 1)))
    g = gt.select("group", "_g", F.col("text").alias("a"), (F.col("rank")).alias("ra"), F.col(idx).alias("gt_idx"))
    p = pred.select("group", F.col("text").alias("b"), F.col("rank").alias("rb"), F.col(idx).alias("pred_idx"))
    cells = used.select("group", "a", "b", "score", (F.col("first_a") + F.col("k")).alias("ra"), (F.col("first_b") + F.col("k")).alias("rb"))
    return cells.join(g.hint("merge"), ["group", "a", "ra"]).join(p.hint("merge"), ["group", "b", "rb"]).select(F.col("_g").alias(group), "gt_idx", "pred_idx", "score")
