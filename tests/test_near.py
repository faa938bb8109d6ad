"""Similar pairs by the index of rare grams, their assignment, and match types with keys of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.functions.similarity import MATCH_TYPES, MatchType, assignment, indel, pair_up, register_match_type
from folium.operators import near
from folium.operators.matching import fuzzy_pairs, greedy_map
from folium.operators.near import flow_assignment, gram_classes, least_common, near_pairs

SCHEMA = "g string, idx int, text string"


def names(rng, n, letters="abcdeéz ", longest=24):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            out.append("".join(t))
        else:
            out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))))
    return out


def frame(spark, texts, group="x"):
    return spark.createDataFrame([(group, i, t) for i, t in enumerate(texts)], SCHEMA)


def common_grams(a, b, q):
    count = lambda t: {g: [t[i : i + q] for i in range(len(t) - q + 1)].count(g) for g in {t[i : i + q] for i in range(len(t) - q + 1)}}
    x, y = count(a), count(b)
    return sum(min(n, y.get(g, 0)) for g, n in x.items())


def test_promised_grams_are_there():
    rng = random.Random(1)
    for a, b in zip(some := names(rng, 3000, "abc"), some[1:], strict=False):
        s = indel(a, b)
        if s:
            for q in (1, 2, 3):
                assert common_grams(a, b, q) >= least_common(len(a) + len(b), s, q)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.75, 0.8, 0.9, 0.95, 1.0])
def test_classes_cover_every_length_once(threshold):
    kinds = gram_classes(threshold)
    for n in range(2, 400):
        assert sum(low <= n and (high is None or n <= high) for _, _, low, high in kinds) == 1
        for q, agree, low, high in kinds:
            if low <= n and (high is None or n <= high):
                assert max(1, least_common(n, threshold, q)) >= agree


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_near_pairs_agree_with_all_pairs(spark, threshold):
    rng = random.Random(int(100 * threshold))
    left, right = names(rng, 150), names(rng, 120)
    right += rng.sample(left, 20) + [left[3]] * 5 + ["", "a", "ab"]
    got = [(r.a, r.b, r.score) for r in near_pairs(frame(spark, left), frame(spark, right), "g", "text", threshold).collect()]
    want = {(a, b, indel(a, b)) for a in set(left) for b in set(right) if indel(a, b) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_stay_apart_and_nulls_are_empty(spark):
    left = spark.createDataFrame([("x", 0, "smith"), ("y", 0, "smyth"), (None, 0, "smith"), ("x", 1, None)], SCHEMA)
    right = spark.createDataFrame([("x", 0, "smyth"), ("z", 0, "smith"), (None, 0, "smith"), ("x", 1, None)], SCHEMA)
    assert [(r.group, r.a, r.b) for r in near_pairs(left, right, "g", "text", 0.7).collect()] == [("x", "smith", "smyth")]
    assert near_pairs(left.limit(0), right, "g", "text", 0.7).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_as_good_as_the_matrix(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 40, 2)
    left, right = rng.integers(1, 4, n).tolist(), rng.integers(1, 4, m).tolist()
    edges = [(i, j, float(rng.choice([0.8, 0.85, 0.9, rng.random()]))) for i in range(n) for j in range(m) if rng.random() < 0.3]
    w = np.zeros((n, m))
    for i, j, s in edges:
        w[i, j] = s
    a, b = np.repeat(np.arange(n), left), np.repeat(np.arange(m), right)
    whole = w[np.ix_(a, b)]
    best = sum(whole[i, j] for i, j in assignment(whole))
    got = flow_assignment(edges, left, right)
    assert abs(sum(w[i, j] * f for i, j, f in got) - best) < 1e-9
    for k, most in enumerate((left, right)):
        for x, free in enumerate(most):
            assert sum(f for *ij, f in got if ij[k] == x) <= free


def test_flow_of_a_large_component():
    rng = np.random.default_rng(11)
    n = 300
    edges = [(i, int(j), float(0.6 + 0.4 * rng.random())) for i in range(n) for j in rng.choice(n, 6, replace=False)]
    w = np.zeros((n, n))
    for i, j, s in edges:
        w[i, j] = s
    got = flow_assignment(edges, [1] * n, [1] * n)
    assert abs(sum(w[i, j] for i, j, _ in got) - sum(w[i, j] for i, j in assignment(w))) < 1e-8


@pytest.mark.parametrize("cells", [0, 10_000])
def test_fuzzy_pairs_by_join_and_by_rows(spark, cells, monkeypatch):
    rng = random.Random(5)
    left, right = names(rng, 60, "abcd", 8), names(rng, 50, "abcd", 8)
    left, right = left + left[:10], right + right[:7] + left[:3]
    got = fuzzy_pairs(frame(spark, left), frame(spark, right), "g", "text", 0.7, cells=cells).collect()
    want = pair_up(left, right, 0.7)
    assert abs(sum(r.score for r in got) - sum(s for *_, s in want)) < 1e-9
    assert len({r.gt_idx for r in got}) == len(got) == len({r.pred_idx for r in got})
    assert all(r.g == "x" and abs(indel(left[r.gt_idx], right[r.pred_idx]) - r.score) < 1e-12 for r in got)


def test_copies_of_a_large_component_pair_off(spark, monkeypatch):
    monkeypatch.setattr(near, "MATRIX_CELLS", 10)
    left, right = ["abcdefgh"] * 40 + ["abcdefgx"] * 5, ["abcdefgi"] * 30 + ["abcdefxx"] * 20
    got = fuzzy_pairs(frame(spark, left), frame(spark, right), "g", "text", 0.8, cells=0).collect()
    assert abs(sum(r.score for r in got) - sum(s for *_, s in pair_up(left, right, 0.8))) < 1e-9
    assert len({r.gt_idx for r in got}) == len(got) == len({r.pred_idx for r in got})


@pytest.mark.parametrize("cells", [0, 10_000])
@pytest.mark.parametrize("threshold", [0.0, 70.0, 90.0])
def test_greedy_map_agrees_with_all_pairs(spark, cells, threshold):
    rng = random.Random(9)
    left, right = names(rng, 60), names(rng, 60)
    right += right[:10] + left[:4]
    got = {(r.src_idx, r.tgt_idx, round(r.score, 9)) for r in greedy_map(frame(spark, left), frame(spark, right), "g", "text", threshold, cells=cells).collect()}
    want = set()
    for i, a in enumerate(left):
        score, j = max((indel(a, b) * 100, -j) for j, b in enumerate(right))
        if score >= threshold:
            want.add((i, -j, round(score, 9)))
    assert got == want


def test_match_type_with_keys(spark):
    def same_letters(a, b):
        return 1.0 if sorted(a) == sorted(b) else 0.5 if a[:1] == b[:1] else 0.0

    letters = lambda c: F.array(F.array_join(F.array_sort(F.split(c, "")), ""), F.concat(F.lit("first "), F.substring(c, 1, 1)))
    register_match_type("letters", same_letters, letters, lambda a, b, t: F.length(a) == F.length(b) if t > 0.5 else F.lit(True))
    try:
        kind = MATCH_TYPES["letters"]
        assert isinstance(kind, MatchType)
        rng = random.Random(3)
        left, right = names(rng, 80, "abc", 5), names(rng, 80, "abc", 5)
        for threshold in (0.5, 0.9):
            pairs = near_pairs(frame(spark, left), frame(spark, right), "g", "text", threshold, kind)
            got = [(r.a, r.b, r.score) for r in pairs.collect()]
            want = {(a, b, same_letters(a, b)) for a in set(left) for b in set(right) if same_letters(a, b) >= threshold}
            assert len(got) == len(set(got)) and set(got) == want
        plan = pairs._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "key#" in plan
        found = fuzzy_pairs(frame(spark, left), frame(spark, right), "g", "text", 0.9, kind=kind, cells=0).collect()
        assert len(found) == len(pair_up(left, right, 0.9, same_letters))
    finally:
        del MATCH_TYPES["letters"]
