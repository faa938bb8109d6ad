"""Recall of the graph search on vectors far from the origin, very large, very small and nearly equal."""

import numpy as np
import pytest

from folium.llm.graph_search import Graph, distances, nearest


def kinds(n, dims=32):
    rng = np.random.default_rng(17)
    x = rng.standard_normal((n, dims))
    near = x / np.linalg.norm(x, axis=1, keepdims=True)
    near[: 3 * n // 8] = near[0] + 1e-4 * rng.standard_normal((3 * n // 8, dims)) / np.sqrt(dims)
    return {"normal": x, "offset": x + 1e4, "far offset": x + 3e4, "huge": x * 1e20, "vast": x * 1e200, "tiny": x * 1e-25, "minute": x * 1e-200, "near copies": rng.permutation(near)}


def recall(x, found, queries, k=10):
    hits = 0
    for q in queries:
        d = distances(x, x[q])
        d[q] = np.inf
        hits += len({*np.argsort(d, kind="stable")[:k].tolist()} & {*found[q]})
    return hits / (k * len(queries))


@pytest.mark.parametrize("kind", list(kinds(8)))
def test_recall_of_a_graph(kind):
    x = kinds(4000)[kind]
    queries = list(range(0, len(x), 50))
    ids, _ = Graph(x).search(x[queries], 128)
    assert recall(x, {q: [i for i in own.tolist() if i not in (q, -1)][:10] for q, own in zip(queries, ids, strict=True)}, queries) >= 0.9


@pytest.mark.parametrize("kind", ["offset", "huge", "near copies"])
def test_recall_through_shards(spark, kind):
    x = kinds(1200)[kind]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=500).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert len(found) == 24 and all(len(f) == 10 for f in found.values())
    assert recall(x, found, sorted(found)) >= 0.9
    for q, f in found.items():
        d = distances(x, x[q])
        assert all(np.isclose(s, d[i], rtol=1e-12) for i, s in f.items())


def test_more_neighbours_than_the_beam(spark):
    x = np.random.default_rng(4).standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict = {}
    for r in nearest(df, df.where("vec_id in (0, 100)"), k=300).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(f) == 300 for f in found.values()) and recall(x, found, [0, 100], 300) >= 0.9


def test_distances_leave_no_range():
    q = np.zeros(2)
    assert np.allclose(distances(np.array([[3e200, 4e200], [3e-200, 4e-200], [0, 0], [3, 4]]), q) / [5e200, 5e-200, 1, 5], [1, 1, 0, 1])


def test_index_is_not_copied(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 4)))], "vec_id long, embedding array<double>")
    plan = nearest(df, df, shard_rows=100)._jdf.queryExecution().toString()
    logical = plan.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    assert logical.count("Generate explode") == 1  # of the queries


def test_texts_without_a_letter(spark):
    from folium.llm.language_id import fit, identify_language, letters

    assert letters("½ ² ③ 12 _") == b"" and letters("Ab½c ²d") == b"ab c d" and letters("Ça") == "ça".encode()
    rows = [(1, "½ ² ③", "de"), (2, "words " * 8, "en"), (3, "x", "xx"), (4, "", "en"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = {r.doc_id: r.lang_pred for r in identify_language(df, dictionaries={"de": b"der die das " * 9, "en": b"words " * 9}).collect()}
    assert [said[i] for i in (1, 4, 5)] == ["und"] * 3 and said[2] == "en"
    # a language with a few bytes is learned too
    learned = fit(spark.createDataFrame([(i, "x" if i % 2 else "many words here", "xx" if i % 2 else "en") for i in range(40)], "doc_id long, text string, lang string"))
    assert set(learned) == {"xx", "en"}
    assert {r.lang_pred for r in identify_language(df, dictionaries=learned).collect()} <= {"xx", "en", "und"}
