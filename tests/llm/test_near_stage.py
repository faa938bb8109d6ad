"""The pipeline's near-dedup stage: its threshold, repeated rows and rows without an id."""

import pytest

import corpus_pipeline


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def kept(spark):
    rows, near = [], {}
    for k, changed in enumerate([10, 9, 8, 11, 13]):
        base = [f"p{k}w{i}" for i in range(94)]
        copy = base[: 94 - changed] + [f"p{k}other{i}" for i in range(changed)]
        a, b = " ".join(base), " ".join(copy)
        near[k] = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        rows += [(10 * k + 1, a, "en", "s"), (10 * k + 2, b, "en", "s")]
    long = lambda p: " ".join(f"{p}{i}" for i in range(50))
    rows += [(200, long("twice"), "en", "s")] * 2 + [(201, "", "en", "s")] * 2 + [(202, "", "en", "s"), (202, long("mixed"), "en", "s")]
    rows += [(203, "", "en", "s"), (203, rows[0][1], "en", "s")]
    rows += [(None, long("none"), "en", "s")] * 3 + [(None, long("none"), "de", "t"), (None, rows[0][1], "en", "s"), (None, long("alone"), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return near, [(r["doc_id"], r["text"]) for r in out.collect()]


def test_pairs_from_080_are_linked(kept):
    near, got = kept
    assert sum(0.8 <= s < 0.85 for s in near.values()) == 3 and sum(s < 0.8 for s in near.values()) == 2
    ids = {i for i, _ in got}
    for k, s in near.items():
        assert 10 * k + 1 in ids and (10 * k + 2 in ids) == (s < 0.8)


def test_one_row_for_each_kept_id(kept):
    got = kept[1]
    of = lambda i: [t.split(" ")[0] for j, t in got if j == i]
    assert of(200) == ["twice0"] and of(201) == [""] and of(202) == ["mixed0"] and of(203) == [""]
    assert sorted(of(None)) == ["alone0", "none0"]


def test_clashing_columns(spark, tmp_path):
    """Every filtering stage passes columns on whose names it uses itself."""
    from pyspark.sql import functions as F

    long = lambda p: " ".join(f"{p}{i}" for i in range(50))
    rows = [(1, long("a"), "en", "s"), (2, long("a"), "en", "s"), (3, long("b"), "de", None), (4, None, None, "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("_id", "_text", "row", "_c", "bin", "t", "n", "k1", "line", "x", "p")})
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) == ({1, 3, 4} if "near" in name else {1, 2, 3, 4})
        assert all(r[c] == f"own {c}" for r in got.values() for c in docs.columns[5:])
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() <= 4
