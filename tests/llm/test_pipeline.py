"""The pipeline on small tables against plain versions of its stages, and the queries against SQL."""

import glob
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folium.llm import queries

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture()
def small(spark, tmp_path):
    rng = np.random.default_rng(21)
    text = lambda n: "\n".join(" ".join(f"w{rng.integers(900)}" for _ in range(8)) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = text(int(rng.integers(2, 12))) + "\nall rights reserved here"
        if i % 8 == 0:
            t += " what an idiot, utter scum, stupid clown"
        rows.append((i, t, "en" if i % 2 else "de", f"s{i % 15}", len(t)))
        labels.append((i, 1, int(i % 8 == 0)))
    copy = rows[1][1]
    rows += [(500 + k, copy, "en", "s1", len(copy)) for k in range(5)] + [(600, None, None, None, None), (601, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, small)
    assert clean.columns == docs.columns
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {r["doc_id"] for r in docs.collect() if r["doc_id"] >= 240 or r["doc_id"] % 8}
    lines = stages["line_dedup"](spark, clean, small)
    assert lines.columns == docs.columns and all("rights reserved" not in (r["text"] or "") and (r["n_chars"] or 0) == len(r["text"] or "") for r in lines.collect())
    near = stages["minhash_near_dedup"](spark, lines, small)
    assert {r["doc_id"] for r in near.collect()} == ids - {500 + k for k in range(5)}
    mixed = stages["mixing"](spark, near, small)
    kept = {r["doc_id"] for r in mixed.collect()}
    assert mixed.columns == docs.columns and kept <= {r["doc_id"] for r in near.collect()} and 0.5 * near.count() < len(kept) < near.count()
    pieces = stages["packing"](spark, mixed, small).collect()
    assert {r["doc_id"] for r in pieces} == kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()} == kept


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@have
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        r = con.execute(queries.ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(shown(x[names.index(c)]) for c in columns) for x in r.fetchall())
