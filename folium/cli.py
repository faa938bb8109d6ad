"""Command line: one subcommand for each job of the package.

Inputs and outputs are paths that Spark can read and write; reports that are small by nature are
written by the driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers as ids
from .functions.metrics import percent_text
from .operators import catalog, documents, predictions, profile
from .plans import evaluation, export
from .schema import load_config
from .session import session
from .shared import drop_tables, scope, table
from .sources import readers, writers
from .streaming.monitor import counted


def _documents(spark: SparkSession, path: str, config) -> DataFrame:
    return predictions.adapt(readers.json_records(spark, path), config.schema.doc_id_field, config.schema.entities_field)


def evaluate(spark, a) -> int:
    config = load_config(a.config)
    e = evaluation.evaluate(_documents(spark, a.ground_truth, config), _documents(spark, a.predictions, config), config)
    reports: dict = {}
    for r in e.report().collect():  # a row per category and mode
        reports.setdefault(r["mode"], {})[r["category"]] = {"label": r["label"], "true_positives": r["tp"], "false_positives": r["fp"], "false_negatives": r["fn"], **{k: r[k] for k in evaluation.METRICS[:5]}}
    status = {r["status"]: r["count"] for r in e.documents.groupBy("status").count().collect()}
    writers.json_report({"task_name": config.task_name, "reporting_modes": list(config.reporting_modes), "summary": {"total_documents": sum(status.values()), **status}, "reports": reports}, a.output)
    if a.tables:
        writers.jsonl(e.document_scores(), f"{a.tables}/documents", "overwrite")
        writers.jsonl(export.document_results(e), f"{a.tables}/results", "overwrite")
        _tables(spark, f"{a.tables}/results", f"{a.tables}/correct", f"{a.tables}/errors", f"{a.tables}/details")
    return 0


def _tables(spark, results: str, correct: str, errors: str, details: str) -> None:
    rows = spark.read.schema(export.RESULTS).json(results)
    writers.csv(export.correct_documents(rows), correct, export.CORRECT)
    writers.csv(export.error_documents(rows), errors, export.ERRORS)
    found = export.error_details(rows)
    if not found.isEmpty():
        writers.csv(found, details, export.DETAILS)


def export_tables(spark, a) -> int:
    """The tables of saved document results (the folder `results` that evaluate --tables writes)."""
    _tables(spark, a.input, a.output_prefix + a.correct_suffix, a.output_prefix + a.error_suffix, a.output_prefix + a.details_suffix)
    return 0


def convert(spark, a) -> int:
    known = None
    if a.ground_truth:
        known = readers.json_records(spark, a.ground_truth).select(F.expr("try_variant_get(record, '$.arxiv_id', 'string')").alias("doc_id"), "src_file", "src_pos").where("doc_id is not null")
    records = readers.json_records(spark, a.input)
    out, stats = predictions.convert(records, known, a.preserve_metadata)
    kept = [F.try_parse_json(f).alias(f) for f in predictions.METADATA if f in out.columns]
    writers.jsonl(out.select(F.col("doc_id").alias("arxiv_id"), F.col("authors").alias("predicted_authors"), *kept), a.output, "overwrite")
    print(stats.first().asDict())
    if a.verbose:
        # records without an id, or that can't be read
        bad = records.where(F.coalesce("key", predictions.record_id()).isNull())
        for r in profile.preview(bad.select("src_file", "src_pos", "error"), 10, "src_file", "src_pos").collect():
            print(r.asDict())
    return 0


def to_test_format(spark, a) -> int:
    """Ground truth in the test format from records of a bibliographic API, saved as JSON lines, joined by DOI."""
    get = lambda k, t="string": F.expr(f"try_variant_get(record, '$.{k}', '{t}')")
    wanted = readers.json_records(spark, a.input).select(get("arxiv_id").alias("arxiv_id"), get("doi").alias("own_doi"), get("filename").alias("filename"), "src_file", "src_pos")
    people = "array<struct<raw_author_name:string,author:struct<display_name:string>,raw_affiliation_strings:array<string>>>"
    records = readers.jsonl(spark, a.records).where("error is null").select(get("doi").alias("doi"), get("title").alias("title"), get("display_name").alias("display_name"), get("language").alias("language"), get("authorships", people).alias("authorships"), "src_file", "src_pos")
    records = catalog.last_wins(records.withColumn("k", ids.plain_doi(F.col("doi"))), "k", "src_file", "src_pos").drop("src_file", "src_pos")
    asked = wanted.where(F.coalesce("own_doi", F.lit("")) != "").withColumn("k", ids.plain_doi(F.col("own_doi")))
    found = asked.join(records, "k").withColumn("doi", F.coalesce("doi", "own_doi"))
    out = predictions.api_record(found, "src_file", "src_pos")
    out = table(out)
    writers.json_array(out.orderBy("src_file", "src_pos").select("arxiv_id", "doi", "title", "authors", "filename"), a.output)
    s = out.agg(F.count("*").alias("converted"), F.count_if("missing_all").alias("no_affiliations")).first()
    total = wanted.count()
    print({"total": total, "converted": s["converted"], "failed": total - s["converted"], "no_affiliations": s["no_affiliations"]})
    return int(total > s["converted"])


def profile_snapshot(spark, a) -> int:
    # the snapshot is read once: what is needed of it is written as it is counted
    good = F.col("_corrupt_record").isNull()
    works, seen = counted(readers.snapshot(spark, a.input), parse_errors=~good, match_errors=good & profile.source_without_id())
    found = table(profile.classify_works(works, a.source).select("id", "doi", "category", "pct"))
    out = found.where("id is not null").select(F.col("id").alias("openalex_id"), "doi", "category")
    if a.files:
        writers.one_file_each(out, "category", ["openalex_id", "doi"], f"{a.output}/categories", ".csv", "openalex_id", header=True)
    else:
        writers.split_csv(out, "category", f"{a.output}/categories")
    s = profile.completeness_summary(found).first().asDict()
    s |= {k: seen.get[k] for k in ("parse_errors", "match_errors")}
    drop_tables(found)
    writers.text_report([f"source: {a.source or 'all'}", *(f"{k}: {v}" for k, v in s.items())], a.report)
    return 0


def profile_nulls(spark, a) -> int:
    rows = readers.jsonl(spark, a.input)
    shape = "array<struct<affiliations:array<struct<affiliation:string>>>>"
    works = rows.where("error is null").select("value", F.expr(f"try_variant_get(record, '$.prediction', '{shape}')").alias("prediction"))
    if a.sample:
        works = profile.sample_rows(works, a.sample, a.seed, "value")
    writers.split_lines(works.withColumn("status", profile.null_status(F.col("prediction"))), "value", "status", f"{a.output}/lines")
    table = profile.null_profile(works).withColumn("percentage", percent_text(F.col("pct"), F.lit(100)))
    writers.csv(table, f"{a.output}/stats", ["category", "count", "percentage"])
    return 0


def compare(spark, a) -> int:
    def long(path):
        shape = "map<string,map<string,map<string,variant>>>"
        rows = readers.json_document(spark, path).select(F.explode(F.expr(f"try_variant_get(record, '$.reports', '{shape}')")).alias("mode", "c"))
        rows = rows.select("mode", F.explode("c").alias("category", "m")).select("mode", "category", F.explode("m").alias("metric", "v"))
        return rows.select("mode", "category", "metric", F.expr("try_variant_get(v, '$', 'double')").alias("value"))

    rows = evaluation.compare_reports(long(a.base), long(a.candidate)).orderBy("mode", "category", "metric").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["mode"], {}).setdefault(r["category"], {})[r["metric"]] = {k: r[k] for k in ("baseline", "candidate", "delta")}
    print(writers.json_report(out, a.output, sort_keys=True) if not a.output else writers.json_report(out, a.output, sort_keys=True) and a.output)
    return 0


def annotations(spark, a) -> int:
    # files in order of their names, rows in that of the file
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = readers.csv_rows(spark, a.input).withColumn("src_pos", place)
    named = rows.select(readers.column_named(rows, "PDF File Link").alias("link"), "title", "title_lang", F.col("authorName").alias("author"), F.col("author_affiliation").alias("affiliation"), "src_pos")
    writers.jsonl(predictions.annotations(named).orderBy("first").drop("first"), a.output, "overwrite")
    return 0


def split_doi(spark, a) -> int:
    rows = readers.csv_rows(spark, a.input)
    writers.split_csv_always(rows, ids.doi_class(readers.column_named(rows, "doi")), {"arxiv": a.arxiv, "other": a.other, "no_doi": a.no_doi})
    return 0


def sample(spark, a) -> int:
    rows = readers.lines(spark, a.input)
    first = rows.orderBy("src_file", "src_pos").first()
    rest = profile.sample_random(rows.where(F.col("src_pos") != first["src_pos"]), a.size, a.seed)
    header = spark.createDataFrame([(first["value"],)], "value string")
    header.unionByName(rest.select("value")).coalesce(1).write.mode("overwrite").text(a.output)  # at most a.size rows
    return 0


def check_pdfs(spark, a) -> int:
    rows = table(readers.pdf_files(spark, a.input).select("path", readers.pdf_status(F.col("length"), F.col("content")).alias("status")))
    writers.csv(rows, a.output)
    for r in profile.share_table(rows, "status").collect():
        print(f"{r['status']}: {r['count']} ({r['pct']:.2f}%)")
    return 0


def manifest(spark, a) -> int:
    rows = readers.lines(spark, a.input).select(F.trim("value").alias("path"), "src_pos")
    out = catalog.latest_versions(rows).orderBy("paper_id").select(F.col("path").alias("gcs_path"), "local_path")
    writers.csv(out, a.output, sep="\t", header=False)
    return 0


def batches(spark, a) -> int:
    rows = readers.tsv_manifest(spark, a.input)
    if a.present:
        there = readers.lines(spark, a.present).select(F.col("value").alias("local_path"))
        rows = catalog.not_present(rows, there, "local_path")
    out = catalog.batches(rows, "gcs_path", size=a.size, count=a.count)
    if a.dry_run:
        s = out.agg(F.count("*").alias("files"), F.max("batch").alias("batches")).first().asDict()
        print(s)
        return 0
    if a.files:
        named = out.withColumn("name", F.format_string("batch_%03d", F.col("batch")))
        writers.one_file_each(named, "name", ["gcs_path", "local_path"], a.output, ".tsv", "gcs_path", sep="\t")
    else:
        writers.numbered_batches(out, "batch", a.output)
    return 0


def resolve(spark, a) -> int:
    wanted = readers.json_records(spark, a.input).select(F.expr("try_variant_get(record, '$.arxiv_id', 'string')").alias("arxiv_id"))
    listing = table(readers.object_listing(spark, a.listing))
    out = catalog.resolve(wanted, listing, listing)
    if a.present:
        there = readers.lines(spark, a.present).select(ids.base_name(F.col("value")).alias("name"))
        left = catalog.not_present(catalog.by_base_name(out.where("status <> 'not_found'"), "url"), there, "name").drop("name")
    else:
        left = out.where("status <> 'not_found'")
    if a.dry_run:
        first = profile.preview(left, 10, "arxiv_id").collect()
        for r in first:
            print(r["url"])
        print(f"{first[0]['remaining'] if first else 0} more to fetch")
        return 0
    writers.routed(out, {"resolved": F.col("status") != "not_found", "not_found": F.col("status") == "not_found"}, a.output)
    writers.jsonl(left, f"{a.output}/pending", "overwrite")
    return 0


def prepare(spark, a) -> int:
    writers.jsonl(catalog.input_manifest(readers.pdf_files(spark, a.input, not a.flat).select("path")).orderBy("pdf_path"), a.output, "overwrite")
    return 0


def _pages(spark, path) -> DataFrame:
    rows = readers.jsonl(spark, path).where("error is null")
    get = lambda k, t: F.expr(f"try_variant_get(record, '$.{k}', '{t}')")
    doc = F.coalesce(get("document_id", "string"), F.expr("try_variant_get(record, '$.metadata[\"Source-File\"]', 'string')"))
    plain = {"page": "int", "page_index": "int", "pdf_path": "string", "model": "string", "success": "boolean", "latency": "double", "rotation_applied": "int", "content": "string"}
    usage = [get(f"usage.{k}", "bigint").alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return rows.select(doc.alias("document_id"), *(get(k, t).alias(k) for k, t in plain.items()), *usage, "src_pos")


def merge(spark, a) -> int:
    out = documents.merge_pages(_pages(spark, a.input).where("document_id is not null"))
    writers.jsonl(out.orderBy("document_id"), a.output, "overwrite")
    return 0


def reassemble(spark, a) -> int:
    from .functions.jsonfix import repair

    pages = _pages(spark, a.input).withColumn("r", repair("content"))
    good = pages.where(F.coalesce("success", F.lit(False))).where("r.error is null").select("document_id", "page", "src_pos", documents.layout_elements(F.col("r.json")).alias("elements"))
    out = documents.assemble_markdown(good, markers=not a.no_page_markers, skip_margins=a.skip_headers_footers)
    (writers.documents if a.files else writers.markdown_files)(out, "document_id", "markdown", f"{a.output}/markdown")
    if a.output_jsonl:
        bare = documents.assemble_markdown(good, markers=not a.no_page_markers, skip_margins=a.skip_headers_footers, header=False)
        writers.jsonl(bare.select("document_id", F.col("markdown").alias("markdown_text")), a.output_jsonl, "overwrite")
    judged = pages.withColumn("success", F.coalesce("success", F.lit(False)) & F.col("r.error").isNull())
    bad = documents.page_failures(judged)
    writers.csv(bad, f"{a.output}/failures")
    s = documents.page_totals(judged).first()
    done, all_ = out.count(), judged.select("document_id").distinct().count()
    share = 100 * s["succeeded"] / s["total"] if s["total"] else 0.0
    head = [f"Input: {a.input}", f"Successful pages: {s['succeeded']}", f"Failed pages: {s['failed']}", f"Success rate: {share:.2f}%", f"Documents processed: {done}", f"Documents failed: {all_ - done}"]
    failed = (f"  {r['document_id']}: pages {r['pages']}" for r in bad.orderBy("document_id").toLocalIterator())
    writers.text_report([*head, "Failed pages:" if s["failed"] else "All pages were processed.", *failed], f"{a.output}/processing_report.txt")
    return 0


COMMANDS = {
    "evaluate": (evaluate, ["ground_truth", "predictions", "output", "config"], {"tables": None}),
    "export": (export_tables, ["input", "output_prefix"], {"correct_suffix": "_correct", "error_suffix": "_errors", "details_suffix": "_errors_details"}),
    "convert": (convert, ["input", "output"], {"ground_truth": None, "preserve_metadata": False, "verbose": False}),
    "to-test-format": (to_test_format, ["input", "records", "output"], {}),
    "profile-snapshot": (profile_snapshot, ["input", "output", "report"], {"source": None, "files": False}),
    "profile-nulls": (profile_nulls, ["input", "output"], {"sample": 0, "seed": 42}),
    "compare": (compare, ["base", "candidate"], {"output": None}),
    "annotations": (annotations, ["input", "output"], {}),
    "split-doi": (split_doi, ["input", "arxiv", "other", "no_doi"], {}),
    "sample": (sample, ["input", "output"], {"size": 10_000, "seed": 42}),
    "check-pdfs": (check_pdfs, ["input", "output"], {}),
    "manifest": (manifest, ["input", "output"], {}),
    "batches": (batches, ["input", "output"], {"size": 0, "count": 0, "present": None, "dry_run": False, "files": False}),
    "resolve": (resolve, ["input", "listing", "output"], {"present": None, "dry_run": False}),
    "prepare": (prepare, ["input", "output"], {"flat": False}),
    "merge": (merge, ["input", "output"], {}),
    "reassemble": (reassemble, ["input", "output"], {"no_page_markers": False, "skip_headers_footers": False, "output_jsonl": None, "files": False}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folium")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, needed, optional) in COMMANDS.items():
        s = sub.add_parser(name)
        for n in needed:
            s.add_argument(f"--{n.replace('_', '-')}", required=True)
        for n, default in optional.items():
            flag = f"--{n.replace('_', '-')}"
            if default is False:
                s.add_argument(flag, action="store_true")
            else:
                s.add_argument(flag, default=default or None, type=int if isinstance(default, int) else str)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "batches" and bool(args.size) == bool(args.count):
        p.error("give either --size or --count")
    with scope():
        return COMMANDS[args.command][0](session(), args)


if __name__ == "__main__":
    sys.exit(main())
