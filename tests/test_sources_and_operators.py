import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from folium.operators import catalog, documents, matching, predictions, profile, rewards, stages
from folium.sources import readers, writers
from folium.streaming import ingest


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_shapes(spark, tmp_path):
    listed = write(tmp_path / "l.json", json.dumps([{"doc_id": "a", "authors": []}, {"doc_id": "b", "prediction": None}]))
    keyed = write(tmp_path / "k.json", json.dumps({"x": [{"name": "N"}], "y": {"name": "no list"}}))
    lines = write(tmp_path / "n.jsonl", '{"id": "1", "predicted_authors": [{"name": "A", "affiliations": "U"}]}\n\nbroken\n{"id": "2", "authors": null}\n{"none": 1}\n')
    single = write(tmp_path / "s.jsonl", '{"arxiv_id": "1", "authors": []}\n')
    assert readers.json_records(spark, listed).count() == 2
    assert {r["key"] for r in readers.json_records(spark, keyed).collect()} == {"x", "y"}
    assert readers.json_records(spark, single).collect()[0]["key"] is None
    rows = readers.json_records(spark, lines)
    assert rows.count() == 4 and rows.where("error is not null").count() == 1
    out, stats = predictions.convert(rows)
    got = {r["doc_id"]: r["authors"] for r in out.collect()}
    assert got["arXiv:1"][0]["affiliations"] == ["U"] and got["arXiv:2"] == []
    assert stats.first().asDict() == {"total": 3, "with_predictions": 1, "null_predictions": 1, "errors": 2}
    out, _ = predictions.convert(readers.json_records(spark, keyed))
    assert {r["doc_id"]: len(r["authors"]) for r in out.collect()} == {"arXiv:x": 1, "arXiv:y": 0}


def test_authors_are_cleaned(spark):
    rows = spark.createDataFrame([(json.dumps(v),) for v in ([{"name": "A", "affiliations": ["x", 1, None]}, {"name": ""}, 3, {"name": 5}, {"affiliations": []}, {"name": "B", "affiliations": {"a": 1}}, {"name": "C", "affiliations": None}], {"a": 1}, None)], "j string")
    got = [r["authors"] for r in predictions.clean_authors(rows.select(F.parse_json("j").alias("v")), "v").collect()]
    assert [a["name"] for a in got[0]] == ["A", "B", "C"] and got[0][1]["affiliations"] == [] and got[1] == [] == got[2]


def test_known_spelling_and_last_wins(spark, tmp_path):
    p = write(tmp_path / "p.jsonl", '{"filename": "dir/2301.01234v1.tei.xml", "authors": [{"name": "old"}]}\n{"paper_id": "arxiv:2301.01234v1", "authors": [{"name": "new"}]}\n')
    known = spark.createDataFrame([("2301.01234v1",)], "doc_id string")
    out, _ = predictions.convert(readers.json_records(spark, p), known)
    assert [(r["doc_id"], r["authors"][0]["name"]) for r in out.collect()] == [("2301.01234v1", "new")]


def test_adapt_by_presence(spark, tmp_path):
    p = write(tmp_path / "a.json", json.dumps([{"doc_id": "1", "predicted_authors": None, "authors": [1]}, {"doc_id": "2", "authors": "x"}, {"doc_id": "3", "prediction": [1]}, {"doc_id": "3", "prediction": [1, 2]}]))
    got = {r["doc_id"]: r["j"] for r in predictions.adapt(readers.json_records(spark, p), "doc_id", "authors").select("doc_id", F.to_json("entities").alias("j")).collect()}
    assert got == {"1": None, "2": "[]", "3": "[1,2]"}


def test_snapshot(spark, tmp_path):
    os.makedirs(tmp_path / "s/a")
    works = [{"id": "W1", "primary_location": {"source": {"id": "http://o/S1"}}, "authorships": [{"institutions": ["i"]}, {"institutions": []}]}, {"id": "W2", "primary_location": {"source": {"id": "http://o/S1"}}, "authorships": []}, {"id": None, "primary_location": {"source": {"id": "http://o/S1"}}, "authorships": [{"institutions": ["i"]}]}, {"id": "W4", "primary_location": {"source": {}}}]
    with gzip.open(tmp_path / "s/a/part.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, works)) + '\n{"authorships": "str"}\n')
    with gzip.open(tmp_path / "s/x.csv.gz", "wt") as f:
        f.write("no,json\n")
    rows = readers.snapshot(spark, str(tmp_path / "s"))
    assert rows.count() == 5 and rows.where("_corrupt_record is not null").count() == 1
    s = profile.completeness_summary(profile.classify_works(rows, "S1")).first()
    assert (s["works_found"], s["no_authors"], s["partial_affiliations"], s["median_pct"]) == (3, 1, 1, 50.0)
    assert profile.source_match_error(rows).count() == 1


def test_tables_and_listings(spark, tmp_path):
    c = write(tmp_path / "d.csv", 'Title,DOI\n"a, ""b""",10.48550/arXiv.1\nplain,\n"two\nlines",10.1/x\n')
    rows = readers.csv_rows(spark, c)
    assert rows.count() == 3 and rows.select(readers.column_named(rows, "doi").alias("d")).where("d is null").count() == 1
    with pytest.raises(ValueError):
        readers.column_named(rows, "missing")
    t = write(tmp_path / "m.tsv", "gs://a\tb\nbad line\nx\ty\tz\n")
    assert readers.tsv_manifest(spark, t).count() == 1
    m = write(tmp_path / "o.jsonl", '{"document_id": "", "id": "7", "pages": [1, 2]}\n')
    assert readers.ocr_manifest(spark, m).first()["document_id"] == "7"
    with gzip.open(tmp_path / "list.txt.gz", "wt") as f:
        f.write("gs://b/arxiv/arxiv/pdf/2301/2301.00001v1.pdf\ngs://b/arxiv/arxiv/pdf/2301/2301.00001v2.pdf\ngs://b/x.txt\n")
    assert {r["arxiv_id"] for r in readers.object_listing(spark, str(tmp_path / "list.txt.gz")).collect()} == {"2301.00001"}
    assert readers.choose_jsonl(["a/z.jsonl", "a/data.jsonl"]) == "a/data.jsonl"


def test_files(spark, tmp_path):
    os.makedirs(tmp_path / "p")
    for name, body in {"ok.PDF": b"%PDF-1.4 /Type /Page \n%%EOF", "none.pdf": b"%PDF-1.4\n%%EOF", "lock.pdf": b"%PDF-1.4 /Encrypt 1 /Type /Page \n%%EOF", "bad.pdf": b"nope", "void.pdf": b"", "x.txt": b""}.items():
        (tmp_path / "p" / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r["s"] for r in readers.pdf_files(spark, str(tmp_path / "p")).select("path", readers.pdf_status(F.col("length"), F.col("content")).alias("s")).collect()}
    assert got == {"ok.PDF": "valid", "none.pdf": "zero_pages", "lock.pdf": "password_protected", "bad.pdf": "corrupted", "void.pdf": "corrupted"}
    assert spark.range(1).select(readers.pdf_status(F.lit(0), F.lit(b"")).alias("s")).first()["s"] == "corrupted"
    (tmp_path / "doc_page_2.png").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    row = readers.page_images(spark, str(tmp_path)).select("stem", "page", readers.magic(F.col("content")).alias("m")).first()
    assert tuple(row) == ("doc", 2, "png")


def test_fetch(spark):
    def client(key):
        if key == "bad":
            raise RuntimeError("gone")
        return {"title": key.upper()}

    got = {r["doi"]: (r["title"], r["error"]) for r in readers.fetch_by_key(spark.createDataFrame([("a",), ("bad",)], "doi string"), "doi", client, "doi string, title string, error string", wait=0).collect()}
    assert got == {"a": ("A", None), "bad": (None, "gone")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "x"), ("b", "2", "y")], "k string, v string, c string")
    writers.csv(df, str(tmp_path / "c"), ["v", "k", "absent"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert text.startswith("v,k,absent\n") and ",a," in text and "null" not in text
    writers.split_csv_always(df, F.col("c"), {"x": str(tmp_path / "x"), "q": str(tmp_path / "q")})
    assert "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv")) == "k,v,c\n"
    writers.split_lines(df, "k", "c", str(tmp_path / "l"))
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir()) == ["c=x", "c=y"]
    writers.numbered_batches(catalog.batches(df.select("k", "v"), "k", size=1), "batch", str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["batch=batch_001", "batch=batch_002"]
    assert writers.json_report({"b": 1, "a": 2}, sort_keys=True).index('"a"') < 8


def test_merge_pages(spark):
    row = lambda d, p, i, s, c, pos, tot=None: (d, p, i, f"{d}{pos}.pdf", "m", s, 1.5, pos * 90, 3, 4, tot, c, pos)
    schema = "document_id string, page int, page_index int, pdf_path string, model string, success boolean, latency double, rotation_applied int, prompt_tokens int, completion_tokens int, total_tokens int, content string, src_pos long"
    pages = spark.createDataFrame([row("d", 10, 9, True, "ten \n", 0), row("d", 2, 1, True, "two", 1, 100), row("d", 3, 2, None, "  ", 2, 0), row("e", None, None, True, None, 3)], schema)
    got = {r["document_id"]: r for r in documents.merge_pages(pages).collect()}
    d = got["d"]
    assert (d["text"], d["page_count"], d["success"], d["total_latency"], d["total_tokens"], d["pdf_path"]) == ("two\nten", 3, False, 4.5, 114, "d0.pdf")
    assert d["rotation_applied"] == {10: 0, 2: 90, 3: 180} and got["e"]["text"] == "" and got["e"]["success"]
    assert documents.page_totals(pages).first().asDict() == {"total": 4, "succeeded": 3, "failed": 1, "avg_latency": 1.5}
    assert documents.page_failures(pages).first()["pages"] == "3"


@pytest.mark.parametrize(
    ("category", "text", "expected"),
    [("Title", " T ", "# T\n\n"), ("Section-header", "S", "## S\n\n"), ("Formula", "a+b", "$a+b$\n\n"), ("Formula", "$$x$$", "$$x$$\n\n"), ("Formula", "\\a\\b\\c\\d", "$$\n\\a\\b\\c\\d\n$$\n\n"), ("Table", "<t>", "\n<t>\n"), ("List-item", "x", "- x\n"), ("List-item", "3. x", "3. x\n"), ("Caption", "c", "*c*\n\n"), ("Footnote", "f", "^[f]\n\n"), ("Picture", "p", ""), ("Page-header", "h", "_h_\n\n"), ("Other", "o", "o\n\n"), ("Text", "  ", "")],
)
def test_markdown(spark, category, text, expected):
    assert spark.range(1).select(documents.element_markdown(F.lit(category), F.lit(text)).alias("x")).first()["x"] == expected


def test_assembly(spark):
    pages = spark.createDataFrame([("d", 2, 1, [("Text", "b")]), ("d", 1, 2, [("Page-footer", "n")]), ("d", 3, 3, [])], "document_id string, page int, src_pos long, elements array<struct<category:string,text:string>>")
    got = documents.assemble_markdown(pages, skip_margins=True, header=False).first()["markdown"]
    assert got == "<!-- Page 1 -->\n\n<!-- Page 2 -->\n\nb\n\n<!-- Page 3 -->\n\n"


def test_catalog(spark):
    listing = spark.createDataFrame([(f"gs://b/arxiv/arxiv/pdf/2301/2301.0000{i}v{v}.pdf", n) for n, (i, v) in enumerate([(1, 1), (1, 10), (1, 9), (2, 1)])], "path string, src_pos long")
    assert {(r["paper_id"], r["version"]) for r in catalog.latest_versions(listing).collect()} == {("2301.00001", 10), ("2301.00002", 1)}
    wanted = spark.createDataFrame([("2301.00001",), ("2301.00002",), ("bad",), ("bad",), (None,)], "arxiv_id string")
    urls = listing.select(F.col("path").alias("url")).withColumn("url", F.replace("url", F.lit("gs://b/arxiv"), F.lit("gs://arxiv-dataset/arxiv")))
    manifest = urls.where(F.col("url").contains("00001")).withColumn("arxiv_id", F.lit("2301.00001"))
    got = {r["arxiv_id"]: (r["status"], (r["url"] or "")[-6:]) for r in catalog.resolve(wanted, manifest, urls).collect()}
    assert got == {"2301.00001": ("manifest", "10.pdf"), "2301.00002": ("constructed", "v1.pdf"), "bad": ("not_found", "")}
    seven = spark.range(7)
    assert [r["batch"] for r in catalog.batches(seven, "id", count=3).orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3]
    assert [r["n"] for r in catalog.numbered(seven.repartition(5), "id").orderBy("id").collect()] == list(range(1, 8))
    with pytest.raises(ValueError):
        catalog.batches(seven, "id")
    names = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "name string")
    hit, miss = catalog.restrict_to_names(spark.createDataFrame([("x/a.pdf",), ("x/b.pdf",)], "pdf_path string"), names)
    assert hit.count() == 1 and miss.first()["name"] == "z.pdf"


def test_null_profile(spark):
    shape = "prediction array<struct<affiliations:array<struct<affiliation:string>>>>"
    works = spark.createDataFrame([(None,), ([],), ([([("x",), ("",)],), (None,)],), ([([],)],), ([([("y",)],)],)], shape)
    got = {r["category"]: (r["count"], r["pct"]) for r in profile.null_profile(works).collect()}
    assert got["works_no_authors"] == (2, 40.0) and got["works_some_authors_missing_affiliations"][0] == 1 and got["works_all_authors_missing_affiliations"][0] == 1
    assert got["total_authors"] == (4, None) and got["authors_with_affiliations"] == (2, 50.0) and got["total_affiliations"][0] == 3 and got["valid_affiliations"][0] == 2


def test_annotations(spark):
    rows = spark.createDataFrame([("http://x/2301_1.pdf", "T", "en", "B", "u2", 0), ("http://x/2301_1.pdf", "other", "en", "A", "N/A", 1), ("http://x/2301_1.pdf", "T", "en", "B", "u1", 2), ("http://x/2301_1.pdf", "T", "en", "B", "u2", 3), (" ", "T", "en", "Z", "u", 4)], "link string, title string, title_lang string, author string, affiliation string, src_pos long")
    r = predictions.annotations(rows).collect()
    assert len(r) == 1 and r[0]["arxiv_id"] == "arXiv:2301/1" and r[0]["title"]["text"] == "T"
    assert [(a["name"], a["affiliations"]) for a in r[0]["authors"]] == [("B", ["u2", "u1"]), ("A", [])]


def test_rewards(spark):
    answer = [("Ann Lee", ["Unit"]), ("Bob", [])]
    rows = spark.createDataFrame([(1, '</think>[{"name":"Ann Lee","affiliations":["Unit"]}]', answer), (2, "nothing", answer), (3, '</think>[{"name":"Ann Lee","affiliations":[]},{"name":"Bob","affiliations":[]}]', answer)], "id int, c string, a array<struct<name:string,affiliations:array<string>>>")
    got = {r["id"]: (r["format_reward"], r["answer_reward"]) for r in rewards.rewards(rows, "id", "c", "a").collect()}
    assert got == {1: (1, 1.5), 2: (0, 0.0), 3: (1, 1.0)}


def test_rewards_row_by_row_as_by_joins(spark):
    """Rows are scored without a shuffle, and as by the joins that large rows take; odd lists and ids included."""
    name = lambda k: f"Person number {k}"
    units = lambda k: [f"Institute of {x}" for x in ("Physics", "Physicx", "Law", "Law", "")[: k % 6]]
    rows = []
    for i in range(60):
        got = [{"name": name(i * k % 7), "affiliations": units(i + k)} for k in range(i % 5)]
        want = [(name(k % 4), units(i * k)) for k in range(i % 4)] + ([(None, None), ("", ["x"])] if i % 7 == 0 else [])
        rows.append((i, "</think> " + json.dumps(got) if i % 9 else "no list", None if i == 8 else want))
    rows += [(1, '</think> [{"name":"A","affiliations":null}]', [("A", ["u"])]), (1, "</think> [null]", [("A", ["u"])]), (None, "</think> []", []), (None, None, None)]
    df = spark.createDataFrame(rows, "id int, c string, a array<struct<name:string,affiliations:array<string>>>")
    shown = lambda out: sorted(str((r[0], r[1], None if r[2] is None else round(r[2], 9))) for r in out.collect())
    single = rewards.rewards(df, "id", "c", "a")
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    assert shown(single) == shown(rewards.rewards(df, "id", "c", "a", row_work=-1)) and len(shown(single)) == 64
    assert shown(single) == shown(rewards.rewards(df, "id", "c", "a", row_work=300))


def test_greedy_map_many_to_one(spark):
    side = lambda v: spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "g int, idx int, text string")
    got = matching.greedy_map(side(["abcdefghij", "abcdefghik"]), side(["zz", "abcdefghij"]), "g", "text")
    assert {(r["src_idx"], r["tgt_idx"]) for r in got.collect()} == {(0, 1), (1, 1)}


def test_model_stage(spark):
    def client(row):
        if row["text"] == "hot" and row["temperature"] < 0.4:
            raise RuntimeError("bad answer")
        if row["text"] == "dead":
            raise RuntimeError("HTTP 503")
        return row["text"].upper()

    pages = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "hot"), ("b", 1, "dead")], "document_id string, page int, text string")
    out = stages.call_model(pages, client, busy_tries=2, wait=0).collect()
    got = {(r["document_id"], r["page"]): (r["success"], r["content"], r["attempts"]) for r in out}
    assert got == {("a", 1): (True, "OK", 1), ("a", 2): (True, "HOT", 3), ("b", 1): (False, None, 2)}
    assert stages.failed_documents(spark.createDataFrame([("a",), ("q",)], "document_id string"), pages).first()["document_id"] == "q"


def test_stream_appends_once(spark, tmp_path):
    schema = "k long, v string"
    for n in (1, 2):
        spark.createDataFrame([(n, "x"), (n + 1, "y")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_new(ingest.drop_folder(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state"), key="k").awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert sorted(r["k"] for r in rows.collect()) == [1, 2, 3]
    lines = spark.createDataFrame([("Running: 5 reqs, Waiting: 2",), ("idle",), ("running 9",)], "value string")
    assert ingest.peak_load(lines).first().asDict() == {"peak_running": 9, "peak_waiting": 2}


def test_samples(spark):
    df = spark.range(50)
    a = [r["id"] for r in profile.sample_rows(df, 10, 3, "id").collect()]
    assert a == [r["id"] for r in profile.sample_rows(df.repartition(7), 10, 3, "id").collect()] and len(set(a)) == 10
    assert profile.sample_random(df, 80, 1).count() == 50


def test_new_checkpoint_never_overwrites(spark, tmp_path):
    schema = "k long, v string"
    for n, state in ((1, "s1"), (2, "s2"), (3, "s2"), (4, "s1")):
        spark.createDataFrame([(n, "x"), (n + 1, "y"), (1, "again")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_new(ingest.drop_folder(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / state), key="k").awaitTermination()
        got = sorted(r["k"] for r in ingest.landed(spark, str(tmp_path / "out"), schema).collect())
        assert got == list(range(1, n + 2))


def test_line_places_grow_along_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"{i:05d}" for i in range(3000)))
    (tmp_path / "b.txt").write_text("00000\n00001")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.lines(spark, str(tmp_path)).orderBy("src_file", "src_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["value"] for r in rows] == [f"{i:05d}" for i in range(3000)] + ["00000", "00001"]


def test_last_spelling_and_metadata(spark, tmp_path):
    (tmp_path / "gt.jsonl").write_text('{"arxiv_id": "arXiv:2301.00001"}\n{"arxiv_id": "2301.00001"}\n')
    (tmp_path / "p.jsonl").write_text('{"arxiv_id": "ARXIV:2301.00001", "authors": [], "doi": "10.1/x", "title": {"text": "T"}, "error": null, "processing_time": 1.5, "raw_output": "r"}\n{"arxiv_id": "2301.00002", "authors": []}\n')
    known = readers.json_records(spark, str(tmp_path / "gt.jsonl")).select(F.expr("try_variant_get(record, '$.arxiv_id', 'string')").alias("doc_id"), "src_file", "src_pos")
    out, _ = predictions.convert(readers.json_records(spark, str(tmp_path / "p.jsonl")), known, metadata=True)
    got = {r["doc_id"]: r for r in out.collect()}
    r = got["2301.00001"]
    assert (r["doi"], r["title"], r["error"], r["processing_time"], r["filename"]) == ('"10.1/x"', '{"text":"T"}', None, "1.5", None)
    assert len(got) == 2 and "raw_output" not in out.columns


def test_documents_never_share_a_folder(spark, tmp_path):
    from folium.sources import writers

    rows = spark.createDataFrame([("a/b", "one"), ("a_b", "two"), ("a b", "three")], "id string, text string")
    writers.markdown_files(rows, "id", "text", str(tmp_path / "md"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()) == ["one", "three", "two"]
    assert len([d for d in (tmp_path / "md").iterdir() if d.is_dir()]) == 3


def test_rotation_of_repeated_pages(spark):
    schema = "document_id string, page int, page_index int, pdf_path string, model string, success boolean, latency double, rotation_applied int, prompt_tokens int, completion_tokens int, total_tokens int, content string, src_pos long"
    page = lambda n, r, pos: ("d", n, n, None, None, True, 0.0, r, 0, 0, 0, "", pos)
    got = documents.merge_pages(spark.createDataFrame([page(1, 0, 0), page(2, 180, 1), page(1, 90, 2), page(2, 0, 3), page(3, 270, 4)], schema)).first()
    assert got["rotation_applied"] == {1: 90, 2: 0, 3: 270}


def test_sizes_sides_and_previews(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    files = spark.createDataFrame([("a", 5000), ("b", 4096)], "f string, length long")
    assert sorted(r["f"] for r in catalog.not_downloaded(wanted, files, "f").collect()) == ["b", "c"]
    assert {tuple(r) for r in catalog.set_sides(wanted, files.where("f = 'a'").union(spark.createDataFrame([("z", 1)], files.schema)), "f").collect()} == {("a", "both"), ("b", "left"), ("c", "left"), ("z", "right")}
    assert [tuple(r) for r in profile.preview(wanted, 2, "f").collect()] == [("a", 1), ("b", 1)] and profile.preview(wanted, 9, "f").first()["remaining"] == 0
    assert tuple(profile.normalize_stats(spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "v string"), "v").first()) == (3, 2, 1)
