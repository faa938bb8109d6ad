"""The training-data operators against plain versions, with awkward rows of all kinds."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.llm import minhash_dedup as mh
from folium.llm import toxicity as tox
from folium.llm.chat_format import collapse_conversations
from folium.llm.common import components, span_hashes, text_buffer, word_spans
from folium.llm.embedding_dedup import near_vectors
from folium.llm.graph_search import Graph, nearest
from folium.llm.language_id import fit as fit_languages
from folium.llm.language_id import identify_language
from folium.llm.line_dedup import remove_shared_lines
from folium.llm.minhash_dedup import near_documents
from folium.llm.mixing import mix_sources, rake
from folium.llm.packing import hilbert_key, pack_documents
from folium.llm.queries import tokenizer_path
from folium.llm.substring_dedup import dedup_substrings
from folium.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.integers(vocabulary)}" for _ in range(n)]


def table(spark, texts, parts=3):
    rows = [(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


# -- op1


def removed_by_hand(rows, window=13):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_substrings(spark):
    rng = np.random.default_rng(1)
    base = words(rng, 60)
    texts = [(i, " ".join(words(rng, 30))) for i in range(20)]
    texts += [(40 + i, " ".join(words(rng, 9) + base[i : 40 + i] + words(rng, 11))) for i in range(8)]
    texts += [(60, " ".join(base)), (61, " ".join(base)), (61, " ".join(base)), (62, None), (63, ""), (64, " \n\t "), (None, " ".join(base)), (65, "a " * 40), (66, "a " * 25), (67, "b a " * 20), (68, "x b a " + "b a " * 15)]
    texts += [(70, " ".join(base[:13])), (71, " ".join(base[:12])), (72, "é ü x " * 15), (73, "é ü x " * 13), (-5, " ".join(base[20:50])), (80, " ".join(words(rng, 20000, 50)))]
    df = table(spark, texts).withColumn("part", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = sorted((tuple(r) for r in dedup_substrings(df).collect()), key=str)
    assert got == removed_by_hand(texts)
    assert dedup_substrings(df.limit(0)).count() == 0


def test_substrings_of_repeated_ids(spark):
    rng = np.random.default_rng(2)
    a, b, c = (words(rng, 30) for _ in range(3))
    long = words(rng, 400)
    texts = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (5, None), (6, " ".join(b[:20] + c)), (7, " ".join(c)), (7, " ".join(c)), (7, " ".join(c + a))]
    texts += [(8, " ".join(long)), (8, " ".join(long + long)), (9, " ".join(long[100:300])), (9, " ".join(words(rng, 20) + long[:150] + words(rng, 20)))]
    texts += [(11, " ".join(a + b))] * 40 + [(11, " ".join(b + [f"x{k}"] + c)) for k in range(40)]
    got = sorted((tuple(r) for r in dedup_substrings(table(spark, texts, 5)).collect()), key=str)
    assert got == removed_by_hand(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), min_size=1, max_size=5), st.integers(0, 4), st.booleans())
def test_late_windows_compare_words(texts, same, clash):
    from unittest import mock

    from folium.llm import substring_dedup

    # even if all windows had one fingerprint
    hashed = substring_dedup.fingerprints
    with mock.patch.object(substring_dedup, "fingerprints", (lambda w, at, n: np.zeros(len(at), np.uint64)) if clash else hashed):
        check_late(texts, same, substring_dedup.late_windows)


def check_late(texts, same, late_windows):

    numbers = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    spans = [(k, p, sum(map(len, texts[:k])) + p) for k, t in enumerate(texts) for p in range(len(t) - 2)]
    doc = np.array([min(k, same) for k, _, _ in spans], dtype=np.int64)
    got = late_windows(numbers, np.array([x for _, _, x in spans], dtype=np.int64), doc, 3)
    first = {}
    for (k, p, _), d in zip(spans, doc, strict=True):
        w = tuple(texts[k][p : p + 3])
        first[w] = min(first.get(w, d), d)
    assert got.tolist() == [bool(first[tuple(texts[k][p : p + 3])] < d) for (k, p, _), d in zip(spans, doc, strict=True)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4))
def test_equal_windows_have_equal_anchors(texts):
    from folium.llm.substring_dedup import window_anchors

    import pyarrow as pa

    buf, off = text_buffer(pa.array([" ".join(t) for t in texts]))
    starts, ends, first = word_spans(buf, off)
    at, doc, anchor = window_anchors(span_hashes(buf, starts, ends), first, 13)
    assert len(at) == sum(max(0, len(t) - 12) for t in texts)
    flat = [w for t in texts for w in t]
    known = {}
    for p, a in zip(at.tolist(), anchor.tolist(), strict=True):
        assert known.setdefault(tuple(flat[p : p + 13]), a) == a


# -- op2


def test_conversations(spark):
    turns = []

    def log(c, *texts):
        turns.extend((c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts))

    log(1, "hi", "hello")
    log(2, "hi", "hello", "how", "fine")
    log(3, "hi", "hello", "how")
    log(4, "hi", "other")
    log(5, "hi", "hello", "how", "fine")
    log(6, None, "x")
    long = "very long " * 50_000
    log(8, "hi", long)
    log(9, "hi", long, "more")
    log(10, "hi", long[:-1] + "!")
    turns += [(7, None, None, "z"), (7, None, None, "z"), (None, 1, "user", "gone"), (2, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(9))
    got = {r["conv_id"]: r for r in collapse_conversations(df).collect()}
    assert set(got) == {2, 4, 6, 7, 9, 10} and long in got[9]["rendered"] and got[9]["n_prefixes"] == 1
    assert (got[2]["n_turns"], got[2]["n_prefixes"]) == (4, 3) and got[7]["rendered"] == "<|unknown|>\nz<|end|>\n"
    assert got[4]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\nother<|end|>\n"
    assert collapse_conversations(df.limit(0)).count() == 0


# -- op3 and op9


def test_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    near = [x[0] + 0.02 * rng.standard_normal(16) for _ in range(60)]
    chain = [x[1] * np.cos(k * 0.25) + x[2] * np.cos(k * 0.25 + 1.57) for k in range(6)]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *chain, x[3], x[3], x[3] * 5])]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (1007, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2))
    u = np.array([np.float32(v) for _, v in rows], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(u))
    for _ in range(len(u)):
        low = np.minimum(label, np.where(link, label[None, :], len(u)).min(axis=1))
        if (low == label).all():
            break
        label = low
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(df).collect()}
    for i in range(len(u)):
        assert got[i] == (link[i].sum(), label[i], label[i] == i), i
    assert len(got) == len(rows + odd)
    assert all(got[i] == (0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1007)) and got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.5], [-1.0, 2.0, 0.0]
    rows = [(5, a), (5, b), (5, None), (5, a), (6, [2 * x for x in a]), (7, b), (None, a), (None, None), (4, [0.0] * 3), (4, b), (3, a + [0.0] * 4096), (2, (a + [0.0] * 4096))]
    got = sorted(map(str, map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect())))
    want = [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (5, 2, 4, False), (7, 2, 4, False), (4, 2, 4, True), (5, 0, 5, True), (4, 0, 4, True), (None, 0, None, True), (None, 0, None, True), (3, 1, 2, False), (2, 1, 2, True)]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("dims", [1, 2, 3, 5, 10, 15, 16, 17, 48, 64, 200, 4097])
def test_caps_catch_pairs_at_the_threshold(dims):
    from folium.llm.embedding_dedup import CODES, ProductCode

    rng = np.random.default_rng(dims)
    x = rng.standard_normal((400, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((400, dims))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = x if dims == 1 else 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    found = np.zeros(400, dtype=bool)
    for c in range(CODES):
        code = ProductCode(dims, 50_000, 0.95, c)
        found |= np.array([bool(set(a) & set(b)) for a, b in zip(code.decode(x), code.decode(y), strict=True)])
    assert found.mean() > 0.995


def test_tiles_give_the_same(spark, monkeypatch):
    from folium.llm import embedding_dedup

    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    rows = [(i, (base + 0.05 * rng.standard_normal(8)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, near_vectors(df).collect()))
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    assert sorted(map(tuple, near_vectors(df).collect())) == whole and whole[0][1] > 40


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    q = rng.standard_normal((50, 24)).astype(np.float32)
    found, dist = Graph(x).search(q, 64)
    true = ((x[None] - q[:, None]) ** 2).sum(axis=2).argsort(axis=1)[:, :10]
    assert np.mean([len({*found[i, :10]} & {*true[i]}) / 10 for i in range(50)]) > 0.9
    assert (np.diff(dist[:, :10], axis=1) >= 0).all()


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + k, x[7].tolist()) for k in range(20)] + [(2000, None), (2001, [0.0] * 8), (2100, [1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0"), shard_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    every = {i: np.array(v) for i, v in rows if v is not None and any(v) and len(v) == 8}
    for q in (0, 100, 200, 1000):
        true = sorted((float(np.sqrt(((v - every[q]) ** 2).sum())), i) for i, v in every.items() if i != q)[:10]
        assert [(s, i) for _, s, i in sorted(got[q])] == true, q
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, 11))
    assert 2000 not in got and 2100 not in got
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nearest(few, few.where("vec_id = 0")).count() == 2 and nearest(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("n, shard, block", [(2000, 700, 16), (6000, 2048, 4096)])
def test_nearest_by_graphs(spark, n, shard, block):
    """Recall of the search, through the graphs of several shards, against brute force."""
    x = np.random.default_rng(n).standard_normal((n, 24)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard, query_block=block).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
        assert r["score"] == np.sqrt(((x[r["query_id"]] - x[r["vec_id"]]) ** 2).sum())
    hits = 0
    for q in range(0, n, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len({*np.argsort(d)[:10].tolist()} & {*found[q]})
    assert len(found) == n // 50 and hits / (10 * len(found)) >= 0.95


# -- op4


def sets_by_hand(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_documents(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(words(rng, int(rng.integers(1, 400))))) for i in range(60)]
    for g, size in enumerate((30, 150, 200, 240, 800)):
        base = words(rng, size)
        for k in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, size // 60)))):
                w[int(rng.integers(size))] = f"new{rng.integers(10**6)}"
            texts.append((1000 + 100 * g + k, " ".join(w)))
    texts += [(1, None), (2, ""), (3, " \t"), (5000, "One two"), (5001, "one  TWO"), (5002, "ÉÀ x"), (5003, "éà x"), (None, "one two"), (None, None), (70, texts[70][1]), (70, "Something else altogether"), (6000, texts[5][1]), (6000, texts[9][1]), (6001, texts[5][1])]
    rows = [(i, t) for i, t in texts if not (i in (1, 2, 3) and t and t.startswith("w"))]
    sets = [sets_by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] == rows[b][0] and rows[a][0] is not None
            both = sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None
            if (both and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])) or (same and sets[a] and sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    want = sorted(((i, len(sets[k]), least[root(k)] if i is not None and sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)
    df = table(spark, rows).withColumn("n", F.lit(0)).withColumn("keys", F.lit(0))
    got = near_documents(df).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in got)
    monkeypatch.setattr(mh, "BLOCK_DOCS", 4)
    monkeypatch.setattr(mh, "BLOCK_LESS", 2)
    assert sorted((tuple(r)[:3] for r in near_documents(df).collect()), key=str) == want
    assert near_documents(df.limit(0)).count() == 0


def test_unsettled_buckets_and_repeats(spark):
    """Chains whose ends aren't near the smallest member, and an id that is repeated very often."""
    rng = np.random.default_rng(14)
    rows = []
    for c in range(6):
        w = words(rng, 120)
        for k in range(9):  # each differs from the one before it in a little
            rows.append((100 * c + (k * 5) % 9, " ".join(w)))
            w = list(w)
            w[(k * 13 + 5) % 120] = f"n{c}x{k}"
    rows += [(900, rows[0][1])] * 3000 + [(901, rows[1][1])]
    sets = {}
    for i, t in rows:
        sets.setdefault(i, sets_by_hand(t))
    ids = sorted(sets)
    label = {i: i for i in ids}
    near = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    got = near_documents(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["component_id"] == label[r["doc_id"]] for r in got)


def test_signatures_find_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    missed = 0
    for n in (6, 12, 20, 100, 180, 240, 300, 900):
        for _ in range(40):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            extra = int(n / 0.85) - n
            a = np.unique(np.r_[both, rng.integers(0, 2**63, extra // 2, dtype=np.uint64)])
            b = np.unique(np.r_[both, rng.integers(0, 2**63, extra - extra // 2, dtype=np.uint64)])
            keys = mh._signed(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            missed += not set(keys[0]) & set(keys[1])
    assert missed == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (200, 100), (7, 7)] + [(1000, 1000 + k) for k in range(1, 40)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[200] == got[102] == 100 and got[1039] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- op5


def test_lines(spark):
    rows = [(i, f"start {i}\n shared \nrare\n\nend {i}" if i < 12 else f"rare\nalone {i}", f"s{i}") for i in range(14)]
    long = "long " * 100_000
    rows += [(90 + k, f"{long}\n{long}{k}", f"s{k}") for k in range(12)]
    rows += [(50, None, "s1"), (51, "", "s1"), (None, "shared\nx", None), (0, "shared", "s0"), (60, "shared\n" * 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("q") for c in ("pos", "line", "k1", "gone", "row", "_n_lines")})
    got = {(r["doc_id"], r["_n_lines"]): (r["_n_removed"], r["text"]) for r in remove_shared_lines(df, min_sites=12).collect()}
    assert all(got[90 + k, 2] == (1, f"{long}{k}") for k in range(12))
    assert got[3, 5] == (2, "start 3\n\nend 3") and got[13, 2] == (1, "alone 13")
    assert got[50, 0] == (0, None) and got[51, 1] == (0, "") and got[None, 2] == (1, "x") and got[0, 1] == (1, "") and got[60, 4] == (3, "")
    assert "shared" in remove_shared_lines(df, min_sites=13).where("doc_id = 3").first()["text"]
    assert remove_shared_lines(df.limit(0)).count() == 0


# -- op6


def test_tokens_are_the_librarys():
    e = Encoder(tokenizer_path())
    texts = ["", "It's we're 'll ' s", "a  b\n\n c\t", "x<|endoftext|>y", "Ünïcode — 中文 😀\u0085z", "1²3 ½", "'s's ''s a's", "  x", "don't\n'tis", "!!'re..'x", "a" * 5000]
    ids, off, _, _ = e.encode(texts, 0)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*e.tool.encode(t, add_special_tokens=False).ids, 0], t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9'sret.\n\té中　!"), max_size=25), max_size=6))
def test_tokens_fuzzed(texts):
    e = _encoder()
    ids, off, _, _ = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == e.tool.encode(t, add_special_tokens=False).ids


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(Encoder(tokenizer_path()))
    return kept[0]


def test_hilbert_curve():
    side = 8
    points = np.array([[a, b] for a in range(side) for b in range(side)])
    order = points[np.argsort(hilbert_key(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    assert (np.abs(np.diff(cube[np.argsort(hilbert_key(cube, 2))], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(words(rng, int(rng.integers(0, 500))))) for i in range(60)] + [(100, None), (101, ""), (102, " ".join(words(rng, 3000))), (None, "no id"), (7, "again")]
    df = table(spark, texts).withColumn("key", F.lit("k")).withColumn("tail", F.lit(1))
    rows = pack_documents(df, tokenizer_path(), length=256, with_ids=True).collect()
    tool = _encoder().tool
    want = sorted(zlib.crc32(np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in texts)
    whole, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got = []
    for (_, n), pieces in whole.items():
        pieces.sort(key=lambda p: p[0])
        assert [p[0] for p in pieces] == [0, *np.cumsum([len(p[1]) for p in pieces])[:-1]] and sum(len(p[1]) for p in pieces) == n
        got.append(zlib.crc32(np.concatenate([p[1] for p in pieces]).tobytes()))
    assert sorted(got) == want
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(sum(n for _, n in p) for p in sequences.values()) > 0.95 * 256 * (len(sequences) - 4)
    assert pack_documents(df.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("partitions", [4, 200, 2000])
def test_padding_is_small(spark, partitions):
    rng = np.random.default_rng(10)
    df = table(spark, [(i, " ".join(words(rng, int(rng.integers(0, 900))))) for i in range(250)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = pack_documents(df, tokenizer_path()).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] > 0.98 * 1024 * got[1]


def test_other_pre_tokenizers_get_whole_texts(tmp_path):
    import json

    spec = json.load(open(tokenizer_path()))
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, spec["pre_tokenizer"]]}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    e = Encoder(str(tmp_path / "t.json"))
    texts = ["a 1234 b", "don't 99", ""]
    ids, off, _, _ = e.encode(texts, 0)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*e.tool.encode(t, add_special_tokens=False).ids, 0]


# -- op7


def test_raking(spark):
    rng = np.random.default_rng(11)
    w = rng.integers(1, 100, (3, 2, 2)).astype(float)
    names = [(f"s{a}", f"l{b}", f"t{c}", float(w[a, b, c])) for a in range(3) for b in range(2) for c in range(2)]
    targets = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"l0": 0.6, "l1": 0.4}, "topic": {"t0": 0.7, "t1": 0.3}}
    got = {tuple(r)[:3]: r["x"] for r in rake(spark.createDataFrame(names, "source string, lang string, topic string, w double"), ("source", "lang", "topic"), targets).collect()}
    x = w / w.sum()
    for _ in range(200):
        x *= (np.array([0.2, 0.3, 0.5]) / x.sum(axis=(1, 2)))[:, None, None]
        x *= (np.array([0.6, 0.4]) / x.sum(axis=(0, 2)))[None, :, None]
        x *= (np.array([0.7, 0.3]) / x.sum(axis=(0, 1)))[None, None, :]
    assert all(abs(got[f"s{a}", f"l{b}", f"t{c}"] - x[a, b, c]) < 1e-5 for a in range(3) for b in range(2) for c in range(2))


def test_mixing(spark):
    rows = [(i, "word " * (5 + i % 7), "en" if i % 3 else "de", "big" if i % 2 else f"s{i % 5}", 1) for i in range(3000)] + [(None, None, None, None, None), (None, "x", None, "big", 1), (3, "word " * 8, "en", "big", 1)]
    df = spark.createDataFrame(rows, DOCS)
    df = df.withColumns({c: F.lit("q") for c in ("p", "n", "topic", "row", "_topic", "lang_", "_source")})
    wanted = {"source": {"big": 0.2}, "lang": {}, "topic": {}}
    out = mix_sources(df, targets=wanted, temperature=1.0)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == {*df.columns, "_topic", "_tokens", "_probability", "_sampled"} and len(set(out.columns)) == len(out.columns)
    assert max(r["_probability"] for r in got) == pytest.approx(1.0) and min(r["_probability"] for r in got) > 0
    kept = [r for r in got if r["_sampled"]]
    share = sum(r["_tokens"] for r in kept if r["source"] == "big") / sum(r["_tokens"] for r in kept)
    # the other values keep their half, so the target of big is 0.2 of 0.7
    assert abs(share - 0.2 / 0.7) < 0.03
    assert sorted(str(r) for r in mix_sources(df.repartition(7), targets=wanted, temperature=1.0).collect()) == sorted(map(str, got))
    assert mix_sources(df.limit(0)).count() == 0


def test_mixing_meets_all_marginals(spark):
    """Topics follow the words, and expected and sampled tokens have the target shares in every dimension."""
    rng = np.random.default_rng(15)
    text = lambda k, n: " ".join(f"{'abcd'[k]}{rng.integers(60)}" for _ in range(n))
    rows = [(i, text(int(rng.integers(4)), int(rng.integers(20, 200))), ["en", "de"][int(rng.random() < 0.3)], f"s{rng.integers(3) if i % 2 else 0}", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, DOCS)
    from folium.llm.mixing import fit_topics

    model = fit_topics(df, topics=4)
    assert sum(len(model.means[k]) for k in ("en", "de")) == 256
    targets = {"lang": {"en": 0.5, "de": 0.5}, "source": {"s0": 0.4, "s1": 0.3, "s2": 0.3}, "topic": {f"t{k}": 0.25 for k in range(4)}}
    got = mix_sources(df, targets=targets, topics=model).collect()
    pure = {(r["_topic"], r["text"][0]) for r in got}
    assert len(pure) == 4 and len({t for t, _ in pure}) == 4
    for weight, slack in ((lambda r: r["_tokens"] * r["_probability"], 1e-4), (lambda r: r["_tokens"] * r["_sampled"], 0.03)):
        whole = sum(map(weight, got))
        for column, want in (("lang", "lang"), ("source", "source"), ("_topic", "topic")):
            for value, share in targets[want].items():
                assert abs(sum(weight(r) for r in got if r[column] == value) / whole - share) < slack, (column, value)


    # a share of all tokens: a small cell is kept whole, the others still have their proportions
    odd = df.unionByName(spark.createDataFrame([(9000, "e1 e2 e3 " * 20, "fr", "tiny", 1)], DOCS))
    for keep in (0.3, 0.6):
        out = mix_sources(odd, targets=targets | {"lang": {"en": 0.5, "de": 0.4, "fr": 0.1}, "source": {"s0": 0.3, "s1": 0.3, "s2": 0.3, "tiny": 0.1}}, topics=model, keep=keep).collect()
        weight = lambda r: r["_tokens"] * r["_probability"]
        assert abs(sum(map(weight, out)) / sum(r["_tokens"] for r in out) - keep) < 0.03
        assert next(r["_probability"] for r in out if r["doc_id"] == 9000) == 1
        if keep == 0.3:
            share = {k: sum(weight(r) for r in out if r["lang"] == k) for k in ("en", "de")}
            assert abs(share["en"] / share["de"] - 0.5 / 0.4) < 0.05


# -- op8


def test_folding():
    assert tox.fold("An IDI0T, a lоsеr!") == " an idiot a ioser "
    assert tox.fold("c1own 5cum tr@sh") == " ciown scum trash " and tox.fold("") == "  "
    m = tox.Model({"trash": 2.0, "idio*": 3.0, "tra*": 1.0, "trash*": 1.5}, ("trash can", "idiot proof"))
    m.weights = {tox.fold(w).strip() if w[-1] != "*" else tox.fold(w[:-1]).strip() + "*": x for w, x in m.weights.items()}
    a = m.automaton()
    assert tox.feature(a, "an idiot proof trash can")[0] == 0 and tox.feature(a, "trash can trash") == (2.0 / np.log2(8 + 4), 1)
    assert tox.feature(a, "can trash idiotic") == ((2.0 + 3.0) / np.log2(8 + 4), 2)
    assert tox.feature(a, "the trash can")[0] == 0 and tox.feature(a, "TRA5H idiots")[0] > tox.feature(a, "tra5h")[0] > 0
    assert tox.feature(a, None) == (0.0, 0) and tox.feature(a, "x " * 500 + "trash")[0] < tox.feature(a, "trash")[0]


def score_by_hand(model, text):
    """The score without an automaton: every word against every entry, phrases by position."""
    w = tox.fold(text or "").split()
    phrases = [tox.fold(e).split() for e in model.exceptions]
    free = [not any(w[k : k + len(p)] == p for p in phrases for k in range(max(0, i - len(p) + 1), i + 1)) for i in range(len(w))]
    best = [max((x for e, x in model.weights.items() if (v.startswith(e[:-1]) if e[-1] == "*" else v == e)), default=0.0) for v in w]
    return 1 / (1 + np.exp(-(model.slope * sum(b for b, f in zip(best, free, strict=True) if f) / np.log2(8 + max(1, len(w) + 1)) + model.intercept)))


def test_scores_by_hand(spark):
    docs, labels = toxic_tables(spark)
    odd = [(7000, "a trash can, an Idiot-proof clown fish", "en", "s", 1), (7001, "grumpf " * 4000 + "trash can", "en", "s", 1), (7002, "x", "en", "s", 1), (7002, "blorgish", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, DOCS))
    model = tox.fit(tox.training_sample(docs, labels, "doc_id", "text", "toxic", 20_000))
    got = sorted((str(r["doc_id"]), r["score"]) for r in tox.score_toxicity(docs, labels).collect())
    want = sorted((str(r["doc_id"]), score_by_hand(model, r["text"])) for r in docs.collect())
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_toxicity_of_repeated_ids(spark):
    docs, labels = toxic_tables(spark)
    more = spark.createDataFrame([(6, "again and again", "en", "s", 1)] * 20_000, DOCS).withColumns({c: F.lit(1) for c in ("id", "y", "x", "score")})
    docs = docs.withColumns({c: F.lit(1) for c in ("id", "y", "x", "score")}).unionByName(more)
    sample = tox.training_sample(docs, labels, "doc_id", "text", "toxic", 20_000)
    assert sample.count() == sample.select("id").distinct().count() <= 900
    got = tox.score_toxicity(docs, labels)
    assert got.count() == 20_903 and got.where("doc_id = 6").select("score").distinct().count() == 2


def toxic_tables(spark):
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, int(rng.integers(10, 80)), 500)
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), ["grumpf", "blorgish", "idi0t"][int(rng.integers(3))])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(bad)))
    rows += [(2000, None, "en", "s", 1), (2001, "", "en", "s", 1), (None, "idiot", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == 903
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held if r["doc_id"] < 900} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 6 == 0) for r in held if r["doc_id"] < 900]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    none = tox.score_toxicity(docs.limit(0), labels.limit(0))
    assert none.count() == 0 and tox.score_toxicity(docs, labels.limit(0)).count() == 903


# -- op10


def test_language(spark):
    rng = np.random.default_rng(13)
    parts = {"aa": ["ka", "ro", "mi", "tu", "sen"], "bb": ["lle", "qua", "vio", "strö", "äh"], "cc": ["zhi", "xun", "pao", "wei", "ling"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    rows = [(i, text(lang, int(rng.integers(5, 80))), lang, "s", 1) for i, lang in enumerate(list(parts) * 80)]
    rows += [(900, None, "aa", "s", 1), (901, "12 34 !!", "aa", "s", 1), (902, text("aa", 9000), None, "s", 1), (None, text("bb", 30), "bb", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in identify_language(df).collect()}
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in range(240) if got[i]["held_out"]]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[901]["rejected"]
    assert got[902]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    from folium.llm import language_id as li

    a, b = [i for i in range(0, 240, 3) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    again = df.unionByName(spark.createDataFrame([(a, rows[a][1], "aa", "s", 1)] * 20_000 + [(3000 + k, rows[b][1], "aa", "s", 1) for k in range(500)], DOCS)).withColumns({c: F.lit(1) for c in ("id", "t", "h", "score", "piece")})
    learned = fit_languages(again)
    # equal texts fill one place, whatever their ids
    assert learned == fit_languages(df) and identify_language(again).count() == 20_744
    # sizes by a plain loop over the pieces, very long texts too
    import zstandard as z

    for i in (0, 100, 902):
        t, size = li.letters(next(r[1] for r in rows if r[0] == i)), {}
        for lang, content in learned.items():
            c = z.ZstdCompressor(level=li.LEVEL, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(t[a : a + li.PIECE])) - 8 for a in range(0, len(t), li.PIECE))
        best = sorted((max(1, n), lang) for lang, n in size.items())
        assert got[i]["lang_pred"] == best[0][1] and got[i]["margin"] == pytest.approx((best[1][0] - best[0][0]) / best[1][0], abs=0.02)
    many = spark.createDataFrame([(3 * k + j, text("bb", 20), f"l{k:04d}", "s", 1) for k in range(300) for j in range(3)], DOCS)
    assert len(fit_languages(many, most_docs=300)) == many.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").select("lang").distinct().count() > 250
    full = li._filled([b"a" * 2000] * 100 + [b"b" * 50] * 10)
    assert len(full) <= li.DICTIONARY_BYTES and len(full) > 0.99 * li.DICTIONARY_BYTES and full.count(b"b" * 50) == 10
    assert fit_languages(df.limit(0)) == {} and identify_language(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify_language(df, dictionaries={}).collect()} == {"und"}
