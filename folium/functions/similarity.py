"""Text normalisation, similarity and one-to-one assignment as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEEP = re.compile(r"[^a-z0-9\s]")


def plain(text: str | None) -> str:
    """Lower-case ASCII letters and digits with single blanks; accents go, all else is a blank."""
    if not text:
        return ""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(_KEEP.sub(" ", t).split())


def plain_unicode(text: str | None) -> str:
    """As plain, but letters and digits of every script stay, so that other scripts don't vanish."""
    t = "".join(c for c in unicodedata.normalize("NFKD", (text or "").lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in t).split())


@F.pandas_udf(T.StringType())
def normalize(s: pd.Series) -> pd.Series:
    distinct = {x: plain(x) for x in s.unique()}
    return s.map(distinct)


@F.pandas_udf(T.ArrayType(T.StringType()))
def normalize_all(s: pd.Series) -> pd.Series:
    return s.map(lambda a: None if a is None else [plain(x) for x in a])


def with_normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the normalised column; each distinct value is normalised once."""
    known = df.select(column).distinct().withColumn(out, normalize(F.col(column)))
    return df.join(known, df[column].eqNullSafe(known[column])).drop(known[column])


def indel(a: str, b: str) -> float:
    """Indel similarity 2 * LCS / (len a + len b); 0 if either is empty. Bit-parallel."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        hit = open_ & at.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


#: Similarity, 0 to 1, of two texts.
Score = Callable[[str, str], float]


@dataclass(frozen=True)
class MatchType:
    """A registered similarity with what large groups need to find its pairs by a join.

    blocks gives, for a text column, an array of keys: similar texts must have one in common. bound,
    of two text columns and a threshold, is a condition that similar texts meet; it prunes what the
    join finds before the score is called.
    """

    score: Score
    blocks: Callable[[Column], Column] | None = None
    bound: Callable[[Column, Column, float], Column] | None = None


#: Match types that rules may name beside `strict`; none as type means Indel similarity.
MATCH_TYPES: dict[str, MatchType | None] = {"fuzzy": None}


def register_match_type(name: str, score: Score, blocks: Callable[[Column], Column] | None = None, bound: Callable[[Column, Column, float], Column] | None = None) -> None:
    """Lets rules use score(a, b) under a name; it runs in tasks, so it must be importable or picklable there.

    With blocks, entities of a document are compared only if they have a key in common, whatever
    their number; without, all pairs of a document are.
    """
    if name == "strict":
        raise ValueError("strict is equality")
    MATCH_TYPES[name] = MatchType(score, blocks, bound)


def similarity(a: Column, b: Column, score: Score | None = None) -> Column:
    """The similarity of two texts by a match type's score."""
    if score is None:
        return indel_ratio(a, b)

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(score(p or "", q or "")) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight one-to-one matching; zero weights are no pairs. Shortest augmenting paths."""
    n, m = weight.shape
    if n == 0 or m == 0:
        return []
    if n > m:
        return sorted((i, j) for j, i in assignment(weight.T))
    cost = weight.max() - weight
    price_row, price_col = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        best, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, base, last = start, 0.0, -1
        while True:
            reach = base + cost[row] - price_row[row] - price_col
            better = ~done & (reach < best - 1e-12)
            best[better], came[better] = reach[better], last
            j = int(np.where(done, np.inf, best).argmin())
            done[j], base, last = True, best[j], j
            if row_of[j] < 0:
                break
            row = row_of[j]
        seen = np.flatnonzero(done)
        for k in seen:
            if row_of[k] >= 0:
                price_row[row_of[k]] += base - best[k]
            price_col[k] -= base - best[k]
        price_row[start] += base
        while j >= 0:
            before = int(came[j])
            row_of[j] = start if before < 0 else row_of[before]
            j = before
    return sorted((int(i), j) for j, i in enumerate(row_of) if i >= 0 and weight[i, j] > 0)


def pair_up(left: list[str], right: list[str], threshold: float, score: Score | None = None) -> list[tuple[int, int, float]]:
    """One-to-one pairs of similar texts with the largest total similarity; ties go to the lowest places.

    By Indel similarity, texts are compared only if their lengths allow the threshold. Each connected
    group of similar texts is assigned by itself. A threshold of 0 is taken as just above it.
    """
    threshold = max(threshold, 1e-9)
    near: dict[tuple[int, int], float] = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if score is not None or 2 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) - 1e-9:
                s = (score or indel)(a, b)
                if s >= threshold:
                    near[i, j] = s
    links: dict = {}
    for i, j in near:
        links.setdefault((0, i), []).append((1, j))
        links.setdefault((1, j), []).append((0, i))
    out, seen = [], set()
    for node in sorted(links):
        if node in seen:
            continue
        group, stack = [], [node]
        seen.add(node)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in links[x]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        rows, columns = sorted(i for s, i in group if s == 0), sorted(j for s, j in group if s == 1)
        w = np.array([[near.get((i, j), 0.0) for j in columns] for i in rows])
        out += [(rows[i], columns[j], near[rows[i], columns[j]]) for i, j in assignment(w)]
    return sorted(out)


def assign_pairs(left: Column, right: Column, threshold: float, score: Score | None = None) -> Column:
    """array<struct<l int, r int, score double>> of the one-to-one pairs of two text arrays of a row."""

    @F.pandas_udf("array<struct<l:int,r:int,score:double>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        got = [pair_up([x or "" for x in (p if p is not None else [])], [x or "" for x in (q if q is not None else [])], threshold, score) for p, q in zip(a, b, strict=True)]
        return pd.Series([[{"l": i, "r": j, "score": s} for i, j, s in g] for g in got])

    return run(left, right)
