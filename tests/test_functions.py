import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.functions import identifiers as ids
from folium.functions import jsonfix
from folium.functions.metrics import f_beta, image_scale, scores, share
from folium.functions.similarity import assignment, indel, normalize, normalize_all, pair_up, plain, plain_unicode


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_normalisation():
    assert plain("  Prof. Zoë  Ångström!  ") == "prof zoe angstrom"
    assert plain(None) == plain("") == plain("東京大学") == ""
    assert plain("Straße") == "stra e" and plain("ﬁn") == "fin"
    assert plain_unicode("東京 Üni") == "東京 uni"


def test_normalisation_columns(spark):
    got = spark.createDataFrame([("Ñandú",), (None,)], "s string").select(normalize("s").alias("n"), normalize_all(F.array("s")).alias("a")).collect()
    assert [r["n"] for r in got] == ["nandu", ""] and got[0]["a"] == ["nandu"]


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_indel_against_table(a, b):
    assert indel(a, b) == (2 * plain_lcs(a, b) / (len(a) + len(b)) if a and b else 0.0)


def test_indel_values():
    assert indel("alpha", "aplha") == 0.8 and indel("", "a") == 0.0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 5), st.integers(0, 5), st.integers(0, 10**6))
def test_assignment_against_enumeration(n, m, seed):
    w = np.random.default_rng(seed).integers(0, 6, (n, m)) / 5
    pairs = assignment(w)
    assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
    small, big = min(n, m), max(n, m)
    v = w if n <= m else w.T
    best = max((sum(v[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small)), default=0)
    assert math.isclose(sum(w[i, j] for i, j in pairs), best, abs_tol=1e-9)


def test_pair_up():
    assert [(i, j) for i, j, _ in pair_up(["alpha", "beta"], ["aplha", "gamma"], 0.8)] == [(0, 0)]
    assert pair_up([], [], 0.5) == [] and pair_up([""], [""], 0.0) == []
    # exactly at the threshold: 19 of 20 signs
    assert len(pair_up(["a" * 19 + "b"], ["a" * 19 + "c"], 0.95)) == 1


@pytest.mark.parametrize(
    ("given_", "expected"),
    [("2301.01234v2", "arXiv:2301.01234v2"), (" ARXIV: 2301.01234", "arXiv:2301.01234"), ("1234_5678", "arXiv:1234/5678"), ("", "arXiv:"), ("see hep-th/9901001 there", "arXiv:hep-th/9901001"), ("math.GT/0309136", "arXiv:GT/0309136"), ("unknown", "arXiv:unknown"), ("hep-th_9901001", "arXiv:hep-th/9901001")],
)
def test_paper_id(spark, given_, expected):
    assert one(spark, ids.paper_id(F.col("c")), c=given_) == expected


def test_identifiers(spark):
    f = lambda e, v: one(spark, e(F.col("c")), c=v)
    assert f(ids.slug, "  An Author! ") == "an_author" and f(ids.slug, "--") == "entity"
    assert f(ids.without_suffix, "a.TEI.XML") == "a" and f(ids.without_suffix, "a.md") == "a.md"
    assert f(ids.base_name, "https://h/x/y.pdf?z=1#q") == "y.pdf"
    assert f(ids.value_or_null, " N/A ") is None and f(ids.value_or_null, " ok ") == "ok"
    assert f(ids.doi_paper, "10.48550/ARXIV.HEP-TH/9901001.pdf").asDict() == {"id": "hep-th/9901001", "file_id": "hep-th_9901001"}
    assert f(ids.doi_paper, "10.1/x") is None
    assert [f(ids.doi_class, x) for x in ("10.48550/arXiv.1", "10.1/x", "  ")] == ["arxiv", "other", "no_doi"]
    assert [f(ids.id_format, x) for x in ("2301.01234", "cs/0101001", "9", "x")] == ["modern", "legacy", "modern", "unknown"]
    assert f(ids.paper_url, "2301.01234") == "gs://arxiv-dataset/arxiv/arxiv/pdf/2301/2301.01234v1.pdf"
    assert f(ids.paper_url, "cs/0101001") == "gs://arxiv-dataset/arxiv/cs/pdf/0101/0101001v1.pdf" and f(ids.paper_url, "x") is None
    assert f(ids.file_version, "a/bv12.pdf") == 12 and f(ids.file_version, "a/b.pdf") == 0
    assert f(ids.base_url, "a/bv12.pdf") == "a/b"
    new = f(ids.listed_paper, "gs://b/arxiv/arxiv/pdf/2301/2301.01234v3.pdf").asDict()
    assert new == {"paper_id": "2301.01234", "version": 3, "local_path": "2301.01234v3.pdf"}
    old = f(ids.listed_paper, "gs://b/arxiv/cs/pdf/0101/0101001v2.pdf").asDict()
    assert old == {"paper_id": "cs/0101001", "version": 2, "local_path": "cs_0101001v2.pdf"} and f(ids.listed_paper, "x.txt") is None
    assert f(ids.manifest_entry, "gs://b/arxiv/cs/pdf/0101/0101001v2.pdf")["arxiv_id"] == "cs/0101001"
    assert f(ids.manifest_entry, "gs://pdf/a.pdf") is None
    assert f(ids.store_path, "s3://b/k/x").asDict() == {"bucket": "b", "key": "k/x"} and f(ids.tokens, "a, b  c,") == ["a", "b", "c"]
    assert one(spark, ids.annotated_ids(F.col("c"))[0], c="http://x/hep-th_9901001.pdf") == "arXiv:hep-th/9901001"


def test_metrics(spark):
    s = spark.createDataFrame([(3, 1, 2), (0, 0, 0), (0, 2, 1)], "tp long, fp long, fn long")
    got = s.select(*(c.alias(k) for k, c in scores(F.col("tp"), F.col("fp"), F.col("fn")).items())).collect()
    assert (got[0]["precision"], got[0]["recall"]) == (0.75, 0.6) and math.isclose(got[0]["f1_score"], 2 / 3)
    assert all(v == 0 for r in got[1:] for v in r)
    assert math.isclose(one(spark, f_beta(F.lit(0.75), F.lit(0.5), 1.0)), 0.6) and math.isclose(one(spark, f_beta(F.lit(0.75), F.lit(0.5), 2.0)), 0.5357142857142857)
    assert one(spark, share(F.lit(1), F.lit(0))) is None and one(spark, image_scale(F.lit(4000), F.lit(100))) == 0.5


def test_json(spark):
    f = lambda e, v: one(spark, F.to_json(e(F.col("c"))), c=v)
    assert f(jsonfix.parse_list, 'Sure: [{"a":1}] done') == '[{"a":1}]' and f(jsonfix.parse_list, "none") is None
    assert f(jsonfix.parse_fenced, '```json\n{"a":[1]}\n```') == '{"a":[1]}'
    assert f(jsonfix.parse_fenced, "```json\n{bad\n``` [1]") is None and f(jsonfix.parse_fenced, "x [1] y") == "[1]"
    good = '<think>hm</think> so [{"name":"A","affiliations":["x"]}]'
    assert one(spark, jsonfix.completion_list(F.col("c")), c=good)[0]["name"] == "A"
    for bad in ('[{"name":"A","affiliations":[]}]', '</think>[{"name":"A"}]', '</think>[{"name":1,"affiliations":[]}]', "</think>[1,"):
        assert one(spark, jsonfix.completion_list(F.col("c")), c=bad) is None


def test_repair():
    assert jsonfix.mend('[{"a":1}]') == ('[{"a": 1}]', None)
    assert jsonfix.mend('[{"a":"say "hi" now"}]')[0] == '[{"a": "say \\"hi\\" now"}]'
    assert jsonfix.mend('[{"a":"x\ny"}]')[0] == '[{"a": "x\\ny"}]'
    assert jsonfix.mend('[{"a":"\\alpha"}]')[0] == '[{"a": "\\\\alpha"}]'
    assert jsonfix.mend('[{"a":1}')[1] == "truncated" and jsonfix.mend('{"a":1}')[1] == "truncated" and jsonfix.mend(None)[1] == "missing"


def test_truncated_lists():
    from folium.functions.jsonfix import truncated

    for whole in ("[]", ' [{"a": "]"}] ', '[{"a": "\\"]"}]', "[1, [2], {}]", '[\\"{}]'):
        assert not truncated(whole), whole
    for cut in ("", "[", "{}", '[{"a": 1}', '[{"a": "x]', "[]]", "[}{]", "[][]]["):
        assert truncated(cut), cut
    # a bracket after a backslash doesn't count, outside strings either
    assert truncated("[\\]") and not truncated("[\\]]")
