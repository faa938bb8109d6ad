"""Every query against its SQL equivalent on the smallest tables, and the command line."""

import glob
import json
import os

import duckdb
import pytest

from folium import cli
from folium.plans import catalogue, roundtrips  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    r = sql.execute(catalogue.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(shown(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/schema.json").write_text(json.dumps({"entity_name": "Author", "doc_id_field": "arxiv_id", "fields": {"name": {"type": "string"}}}))
    (tmp_path / "in/config.json").write_text(json.dumps({"task_name": "t", "entity_schema_path": "schema.json", "reporting_modes": ["strict"]}))
    (tmp_path / "in/gt.json").write_text(json.dumps([{"arxiv_id": "arXiv:2301.00001", "authors": [{"name": "A"}, {"name": "B"}]}]))
    (tmp_path / "in/raw.jsonl").write_text('{"arxiv_id": "2301.00001", "predicted_authors": [{"name": "a"}, {"name": "X"}]}\n{"arxiv_id": "2301.00002", "predicted_authors": null}\n')
    assert cli.main(["convert", "--input", f"{tmp_path}/in/raw.jsonl", "--output", f"{tmp_path}/pred"]) == 0
    assert cli.main(["evaluate", "--ground-truth", f"{tmp_path}/in/gt.json", "--predictions", f"{tmp_path}/pred", "--output", f"{tmp_path}/r.json", "--config", f"{tmp_path}/in/config.json", "--tables", f"{tmp_path}/t"]) == 0
    r = json.loads((tmp_path / "r.json").read_text())
    assert r["reports"]["strict"]["entity:author"]["true_positives"] == 1 and r["summary"] == {"total_documents": 1, "success": 1}
    assert cli.main(["compare", "--base", f"{tmp_path}/r.json", "--candidate", f"{tmp_path}/r.json", "--output", f"{tmp_path}/d.json"]) == 0
    assert json.loads((tmp_path / "d.json").read_text())["strict"]["combined"]["precision"]["delta"] == 0
    (tmp_path / "in/l.txt").write_text("gs://b/arxiv/arxiv/pdf/2301/2301.00001v1.pdf\ngs://b/arxiv/arxiv/pdf/2301/2301.00001v2.pdf\n")
    assert cli.main(["manifest", "--input", f"{tmp_path}/in/l.txt", "--output", f"{tmp_path}/m"]) == 0
    assert cli.main(["batches", "--input", f"{tmp_path}/m", "--output", f"{tmp_path}/b", "--size", "1"]) == 0
    assert "v2.pdf" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/b/*/*.txt"))
    pages = [{"document_id": "d", "page": p, "page_index": p, "success": True, "latency": 1.0, "usage": {"prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 0}, "content": json.dumps([{"bbox": [0, 0, 1, 1], "category": "Text", "text": f"p{p}"}])} for p in (10, 2)]
    (tmp_path / "in/p.jsonl").write_text("\n".join(map(json.dumps, pages)) + "\n")
    (tmp_path / "in/l.jsonl").write_text("\n".join(map(json.dumps, pages)) + "\n" + json.dumps({**pages[0], "page": 11, "success": False}) + "\n")
    assert cli.main(["reassemble", "--input", f"{tmp_path}/in/l.jsonl", "--output", f"{tmp_path}/md2", "--output-jsonl", f"{tmp_path}/mdl"]) == 0
    bare = [json.loads(x) for p in glob.glob(f"{tmp_path}/mdl/*.json") for x in open(p)]
    assert bare[0]["document_id"] == "d" and bare[0]["markdown_text"].startswith("<!-- Page 2 -->")
    said = (tmp_path / "md2/processing_report.txt").read_text()
    assert "Successful pages: 2" in said and "Success rate: 66.67%" in said and "  d: pages 11" in said
    with pytest.raises(SystemExit):
        cli.main(["batches", "--input", f"{tmp_path}/m", "--output", f"{tmp_path}/b2", "--size", "1", "--count", "2"])
    assert cli.main(["batches", "--input", f"{tmp_path}/m", "--output", f"{tmp_path}/b2", "--size", "1", "--dry-run"]) == 0 and not (tmp_path / "b2").exists()
    assert cli.main(["export", "--input", f"{tmp_path}/t/results", "--output-prefix", f"{tmp_path}/e"]) == 0
    assert "missing_author,B,name,B" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/e_errors_details/*.csv"))
    (tmp_path / "in/test.json").write_text(json.dumps([{"arxiv_id": "a1", "doi": "10.1/A", "filename": "f.pdf"}, {"arxiv_id": "a2", "doi": ""}, {"arxiv_id": "a3", "doi": "https://doi.org/10.1/c"}]))
    records = [{"doi": "https://doi.org/10.1/a", "title": "T", "language": "fr", "authorships": [{"raw_author_name": "", "author": {"display_name": "Ann"}, "raw_affiliation_strings": ["U"]}, {"raw_author_name": None}]}]
    (tmp_path / "in/api.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n")
    assert cli.main(["to-test-format", "--input", f"{tmp_path}/in/test.json", "--records", f"{tmp_path}/in/api.jsonl", "--output", f"{tmp_path}/tf.json"]) == 1
    assert json.loads((tmp_path / "tf.json").read_text()) == [{"arxiv_id": "a1", "doi": "https://doi.org/10.1/a", "title": {"text": "T", "lang": "fr"}, "authors": [{"name": "Ann", "affiliations": ["U"]}], "filename": "f.pdf"}]
    (tmp_path / "in/list.txt").write_text("gs://arxiv-dataset/arxiv/arxiv/pdf/2301/2301.00001v1.pdf\n")
    (tmp_path / "in/want.json").write_text(json.dumps([{"arxiv_id": "2301.00001"}, {"arxiv_id": "2301.00009"}]))
    assert cli.main(["resolve", "--input", f"{tmp_path}/in/want.json", "--listing", f"{tmp_path}/in/list.txt", "--output", f"{tmp_path}/rs", "--dry-run"]) == 0 and not (tmp_path / "rs").exists()
    assert cli.main(["resolve", "--input", f"{tmp_path}/in/want.json", "--listing", f"{tmp_path}/in/list.txt", "--output", f"{tmp_path}/rs"]) == 0
    assert "2301.00001" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/rs/pending/*.json"))
    assert cli.main(["merge", "--input", f"{tmp_path}/in/p.jsonl", "--output", f"{tmp_path}/mp"]) == 0
    merged = json.loads("".join(open(p).read() for p in glob.glob(f"{tmp_path}/mp/*.json")))
    assert merged["page_count"] == 2 and merged["total_tokens"] == 6
    assert cli.main(["reassemble", "--input", f"{tmp_path}/in/p.jsonl", "--output", f"{tmp_path}/md"]) == 0
    text = "".join(open(p).read() for p in glob.glob(f"{tmp_path}/md/markdown/document=d/*.txt"))
    assert text.index("p2") < text.index("p10") and "*Processed from 2 pages*" in text
    (tmp_path / "in/doi.csv").write_text("DOI,t\n10.48550/arXiv.1,a\n10.1/x,b\n,c\n")
    assert cli.main(["split-doi", "--input", f"{tmp_path}/in/doi.csv", "--arxiv", f"{tmp_path}/da", "--other", f"{tmp_path}/do", "--no-doi", f"{tmp_path}/dn"]) == 0
    assert cli.main(["sample", "--input", f"{tmp_path}/in/doi.csv", "--output", f"{tmp_path}/s", "--size", "2"]) == 0
    (tmp_path / "in/n.jsonl").write_text('{"prediction": [{"affiliations": [{"affiliation": "x"}]}]}\n{"prediction": null}\n')
    assert cli.main(["profile-nulls", "--input", f"{tmp_path}/in/n.jsonl", "--output", f"{tmp_path}/np"]) == 0
    assert "works_no_authors,1,50.00%" in "".join(open(p).read() for p in glob.glob(f"{tmp_path}/np/stats/*.csv"))
