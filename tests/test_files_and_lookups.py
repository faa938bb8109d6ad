"""Files named one by one, lookups under a limit of requests, empty PDF files and the snapshot read once."""

import gzip
import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from folium import cli
from folium.sources import lookups, named_files, readers, writers
from folium.sources.lookups import Busy, NotFound, ask, lookup, pace


@pytest.mark.parametrize("per_second, workers", [(8, 4), (8, 3), (10, 7), (1, 5), (0.5, 2), (3, 1), (2.5, 2)])
def test_pace_stays_under_the_limit(per_second, workers):
    n, gap = pace(per_second, workers)
    assert 1 <= n <= workers
    # any half-open second holds at most that many of each worker's requests
    assert n * math.ceil(1 / gap - 1e-9) <= max(1, per_second)


def test_rules_of_asking(monkeypatch):
    waited = []
    monkeypatch.setattr(lookups.time, "sleep", waited.append)

    def of(*answers):
        left = list(answers)

        def client(key):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return client

    assert ask(of({"a": 1}), "k", 3, 2.0) == ({"a": 1}, None) and waited == []
    assert ask(of(Busy("429"), Busy("429"), {"a": 2}), "k", 3, 2.0) == ({"a": 2}, None) and waited == [2.0, 4.0]
    waited.clear()
    assert ask(of(OSError("down"), OSError("down"), OSError("down")), "k", 3, 2.0) == (None, "down") and waited == [2.0, 2.0]
    waited.clear()
    assert ask(of(NotFound(), {"a": 1}), "k", 3, 2.0) == (None, "not found") and waited == []


def calls_in(folder):
    return sorted((float((folder / f).read_text()), f.rsplit("-", 1)[0]) for f in os.listdir(folder))


def client_into(folder, broken=()):
    def client(key):
        import uuid

        with open(f"{folder}/{key}-{uuid.uuid4().hex}", "w") as f:
            f.write(repr(time.time()))
        if key in broken:
            raise OSError("no line")
        if key.startswith("none"):
            raise NotFound
        return {"title": f"T {key}"}

    return client


def test_lookups_keep_the_limit_and_resume(spark, tmp_path):
    said = tmp_path / "calls"
    said.mkdir()
    keys = spark.createDataFrame([(f"k{i}",) for i in range(20)] + [("k1",), ("none1",), (None,)], "doi string")
    out = str(tmp_path / "answers")
    got = lookup(keys, "doi", client_into(said, {"k3"}), "title string", out, per_second=10, workers=3, tries=1, wait=0.0, round_keys=8).collect()
    assert {r.doi: (r.title, r.error) for r in got} == {**{f"k{i}": (f"T k{i}", None) for i in range(20) if i != 3}, "k3": (None, "no line"), "none1": (None, "not found")}
    times = [t for t, _ in calls_in(said)]
    assert all(sum(t <= u < t + 1 for u in times) <= 10 for t in times) and len(times) == 21
    # another run asks only what failed
    again = tmp_path / "again"
    again.mkdir()
    more = keys.unionByName(spark.createDataFrame([("new",)], "doi string"))
    got = {r.doi: (r.title, r.error) for r in lookup(more, "doi", client_into(again), "title string", out, per_second=50, tries=1).collect()}
    assert sorted(k for _, k in calls_in(again)) == ["k3", "new"] and got["k3"] == ("T k3", None) and len(got) == 22


def test_lookups_go_on_after_a_broken_run(spark, tmp_path):
    said = tmp_path / "calls"
    said.mkdir()
    keys = spark.createDataFrame([(f"k{i}",) for i in range(12)], "doi string")

    asks = client_into(said)

    def dies(key):
        got = asks(key)
        if len(os.listdir(said)) > 7:
            raise SystemExit("killed")
        return got

    out = str(tmp_path / "answers")
    with pytest.raises(Exception):
        lookup(keys, "doi", dies, "title string", out, per_second=100, workers=1, round_keys=3)
    kept = {r.doi for r in spark.read.parquet(out).collect()}
    again = tmp_path / "again"
    again.mkdir()
    assert lookup(keys, "doi", client_into(again), "title string", out, per_second=100, workers=2).count() == 12
    assert kept and {k for _, k in calls_in(again)} == {f"k{i}" for i in range(12)} - kept
    assert lookup(keys.limit(0), "doi", dies, "title string", str(tmp_path / "none")).collect() == []


def test_a_file_for_each_document(spark, tmp_path):
    n = 500
    df = spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("text é "), "id").alias("text"))
    df = df.unionByName(spark.createDataFrame([("a/b", "slash"), ("a_b", "plain"), ("", "none"), (None, None), ("..", "up")], "id string, text string"))
    writers.documents(df, "id", "text", str(tmp_path / "md"))
    names = os.listdir(tmp_path / "md")
    assert len(names) == n + 4 and all(f.endswith(".md") for f in names)  # an empty and a null id are one
    assert (tmp_path / "md/d7.md").read_text() == "text é 7" and (tmp_path / "md/a_b.md").read_text() == "plain"
    assert not (tmp_path / "up").exists()


def test_rows_of_a_file_are_in_order(spark, tmp_path):
    df = spark.createDataFrame([("x", 3, 'say "hi"'), ("x", 1, "a,b"), ("y", 2, None), ("x", 2, "two\nlines")], "c string, k int, v string")
    writers.one_file_each(df, "c", ["k", "v"], str(tmp_path / "c"), ".csv", "k", header=True)
    assert (tmp_path / "c/x.csv").read_text() == 'k,v\n1,"a,b"\n2,"two\nlines"\n3,"say ""hi"""\n' and (tmp_path / "c/y.csv").read_text() == "k,v\n2,\n"
    writers.one_file_each(df, "c", ["v", "k"], str(tmp_path / "c"), ".tsv", "k", sep="\t")
    assert sorted(os.listdir(tmp_path / "c")) == ["x.tsv", "y.tsv"]  # overwritten as a whole


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    out = tmp_path / "f"
    out.mkdir()
    (out / "old").write_text("stays")
    bad = F.udf(lambda i: "x" * 10 if i < 90 else 1 / 0)
    df = spark.range(100).select(F.col("id").cast("string").alias("name"), bad("id").alias("text"))
    with pytest.raises(Exception):
        named_files.named_files(df, "name", "text", str(out))
    assert os.listdir(out) == ["old"]
    with pytest.raises(Exception):
        named_files.named_files(spark.createDataFrame([("../up", "x")], "name string, text string"), "name", "text", str(out))
    assert os.listdir(out) == ["old"] and not (tmp_path / "up").exists()


def test_commit_and_abort_of_attempts(tmp_path):
    writer = named_files.NamedFilesWriter(str(tmp_path / "o"), "", False)
    first = writer.write(iter([("a", "1"), ("a", "2"), ("b", "3")]))
    lost = writer.write(iter([("a", "half")]))  # of an attempt that another one replaced
    with pytest.raises(ValueError):
        writer.write(iter([("b", "1"), ("a", "2")]))
    assert [f for f in os.listdir(tmp_path / "o") if not f.startswith("_writing")] == [] and lost.names == ["a"]
    writer.commit([first, None])
    assert sorted(os.listdir(tmp_path / "o")) == ["a", "b"] and (tmp_path / "o/a").read_text() == "12"
    other = named_files.NamedFilesWriter(str(tmp_path / "o"), "", True)
    other.abort([other.write(iter([("c", "x")])), None])
    assert sorted(os.listdir(tmp_path / "o")) == ["a", "b"]
    other.commit([])
    assert os.listdir(tmp_path / "o") == []


def test_pdf_files_of_every_class(spark, tmp_path):
    folder = tmp_path / "p q"
    (folder / "sub").mkdir(parents=True)
    bodies = {"valid.pdf": b"%PDF-1.7 /Type /Page \n%%EOF", "none.PDF": b"", "sub/cut.pdf": b"%PDF-1.7 /Type /Page ", "sub/text.pdf": b"hello", "locked.pdf": b"%PDF-1.7 /Encrypt 1 /Type /Page \n%%EOF", "zero.pdf": b"%PDF-1.7 nothing\n%%EOF", "sub/other.txt": b""}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    rows = readers.pdf_files(spark, str(folder)).select("path", "length", readers.pdf_status(F.col("length"), F.col("content")).alias("s")).collect()
    assert {r.path.rsplit("/", 1)[1]: r.s for r in rows} == {"valid.pdf": "valid", "none.PDF": "corrupted", "cut.pdf": "corrupted", "text.pdf": "corrupted", "locked.pdf": "password_protected", "zero.pdf": "zero_pages"}
    assert len(rows) == 6 and {r.length for r in rows if "none" in r.path} == {0}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.pdf").write_bytes(b"")
    assert [r.length for r in readers.pdf_files(spark, str(tmp_path / "e")).collect()] == [0]
    (tmp_path / "n").mkdir()
    (tmp_path / "n/x.txt").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        readers.pdf_files(spark, str(tmp_path / "n"))


def test_snapshot_profile_and_annotations_from_the_command_line(spark, tmp_path):
    work = lambda i, source, auths: json.dumps({"id": f"W{i}", "doi": f"10.1/{i}", "primary_location": {"source": source}, "authorships": auths})
    some, none = {"institutions": ["u"]}, {"institutions": []}
    rows = [work(1, {"id": "https://x/S1"}, [some, some]), work(2, {"id": "https://x/S1"}, [some, none]), work(3, {"id": "https://x/S2"}, [some]), work(4, {}, [some]), "{broken", work(5, {"id": "https://x/S1"}, [])]
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    assert cli.main(["profile-snapshot", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/o", "--report", f"{tmp_path}/r.txt", "--source", "S1", "--files"]) == 0
    said = dict(line.split(": ") for line in (tmp_path / "r.txt").read_text().splitlines())
    assert (said["works_found"], said["parse_errors"], said["match_errors"], said["all_affiliations"], said["no_authors"]) == ("3", "1", "1", "1", "1")
    assert sorted(os.listdir(tmp_path / "o/categories")) == ["all_affiliations.csv", "no_authors.csv", "partial_affiliations.csv"]
    assert (tmp_path / "o/categories/all_affiliations.csv").read_text() == "openalex_id,doi\nW1,10.1/1\n"
    pages = [{"document_id": d, "page": 1, "success": True, "content": json.dumps([{"bbox": [0, 0, 1, 1], "category": "Text", "text": f"of {d}"}])} for d in ("one", "two/2")]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, pages)) + "\n")
    assert cli.main(["reassemble", "--input", f"{tmp_path}/p.jsonl", "--output", f"{tmp_path}/md", "--files"]) == 0
    names = sorted(os.listdir(tmp_path / "md/markdown"))
    assert names[0] == "one.md" and names[1].startswith("xtwo_2-") and "of one" in (tmp_path / "md/markdown/one.md").read_text()
