"""Centroid clustering against a plain version in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from folium.llm.centroids import cluster_vectors, search

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own: dict = {}
        for _, v in kept:
            own.setdefault(far(v)[1], []).append(v)
        for c, vs in own.items():
            centres[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *far(v)) for i, v in kept]
    per: dict = {}
    for _, d, c in found:
        per[c] = per.get(c, 0) + d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per.values()), name[c]) for i, d, c in found), key=str)


def got(df):
    return sorted((tuple(r) for r in cluster_vectors(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("kind", ["normal", "copies", "few"])
def test_against_plain(spark, kind):
    rng = np.random.default_rng(7)
    n = 9 if kind == "few" else 300
    x = rng.normal(size=(n, 64))
    if kind == "copies":
        x[:100] = x[0]
        x[100:140] = x[0] + 1e-4 * rng.normal(size=(40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(8)
    good = rng.normal(size=64).tolist()
    rows = [(i, rng.normal(size=64).tolist()) for i in range(30)]
    rows += [(40, None), (41, []), (42, good[:63]), (43, [*good, 1.0]), (44, [math.nan, *good[1:]]), (45, [math.inf, *good[1:]]), (46, [None, *good[1:]]), (47, [0.0] * 64), (None, good), (3, good), (3, good), (48, [-1e4, 1e4, *good[2:]])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    more = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, id string")
    assert got(more) == plain(rows)
    huge = cluster_vectors(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], SCHEMA)).collect()
    assert {r.distance for r in huge} == {0}


def test_search_is_exact_and_abandons():
    rng = np.random.default_rng(9)
    centres = rng.integers(-64, 64, (16, 64)) * np.r_[np.full(8, 20), np.ones(56, np.int64)]
    centres[5] = centres[2]
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-3, 4, (2000, 64))
    order = np.argsort(-x.var(axis=0), kind="stable")
    seen: list = []
    which, best = search(x, centres, order, seen)
    all_ = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == all_.min(axis=1)).all() and (which == all_.argmin(axis=1)).all() and not (which == 5).any()
    assert sum(seen) < 0.4 * x.size * 16
    x = np.full((3, 64), 1 << 27)
    assert search(x, -x[:2], np.arange(64))[1].tolist() == [(1 << 62)] * 3
