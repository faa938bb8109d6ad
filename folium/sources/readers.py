"""Readers of the messy inputs: JSON in all shapes, CSV, TSV, listings, PDF and image files.

Rows that can't be read are kept with a reason instead of failing the job. Where order decides
(first or last wins), rows carry (src_file, src_pos).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from .lookups import ask

ID_KEYS = ("arxiv_id", "arxivId", "paper_id", "doc_id", "document_id", "id", "filename", "file_name")
#: Narrow schema of a bulk snapshot of works.
WORK = "id string, doi string, primary_location struct<source:struct<id:string>>, authorships array<struct<institutions:array<string>>>, _corrupt_record string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, src_pos, value) of the physical lines of text files, compressed or not.

    src_pos grows along a file, whichever tasks read its blocks: where the block begins, then the
    line's number within its task.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_b"), "value")
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    place = (F.col("_b").cast("decimal(19,0)") * F.lit(2**33).cast("decimal(10,0)") + number.cast("decimal(10,0)")).cast("decimal(30,0)")
    return rows.withColumn("src_pos", place).select("src_file", "src_pos", "value")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, src_pos, value, record variant, error): blank lines are skipped, bad ones have an error."""
    rows = lines(spark, path).where(F.length(ids.strip(F.col("value"))) > 0)
    rows = rows.withColumn("record", F.try_parse_json("value"))
    return rows.withColumn("error", F.when(F.col("record").isNull(), F.lit("invalid JSON")))


def json_document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src_file, value, record variant, error): each file is one JSON document."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src_file"), "value")
    rows = rows.withColumn("record", F.try_parse_json("value"))
    return rows.withColumn("error", F.when(F.col("record").isNull(), F.lit("invalid JSON")))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(src_file, src_pos, key, record, error) of a JSON list, a JSON object or JSON lines.

    The form is found out for each file from its first line: one that is an object by itself, with
    more lines behind it, begins JSON lines, which are read line by line. Only other files are
    read whole; if they don't parse, they are lines after all. key is the object's key where a
    file is one object of records; an object that holds an id key itself is a single record, as is
    a file of one line.
    """
    by_line = jsonl(spark, path)
    # only the first line of each file is parsed for that
    forms = by_line.groupBy("src_file").agg(F.min_by("value", "src_pos").alias("_v"), F.count("*").alias("n"))
    forms = forms.withColumn("first", F.schema_of_variant(F.try_parse_json("_v")))
    lined = F.coalesce(F.col("first").startswith("OBJECT"), F.lit(False)) & (F.col("n") > 1)
    others = [r["src_file"] for r in forms.where(~lined).select("src_file").collect()]  # paths of files, which the driver lists anyway
    none = F.lit(None).cast("string")
    if not others:
        return by_line.select("src_file", "src_pos", none.alias("key"), "record", "error")
    whole = json_document(spark, others)
    kind = F.schema_of_variant("record")
    own_id = F.lit(False)
    for k in ID_KEYS:
        own_id = own_id | F.expr(f"try_variant_get(record, '$.{k}', 'string') is not null")
    single = kind.startswith("OBJECT") & own_id
    shape = lambda df: df.select("src_file", F.col("src_pos").cast("decimal(30,0)").alias("src_pos"), F.col("key").cast("string").alias("key"), "record", none.alias("error"))
    listed = whole.where(kind.startswith("ARRAY")).select("src_file", F.posexplode(F.expr("try_variant_get(record, '$', 'array<variant>')")).alias("src_pos", "record")).withColumn("key", none)
    keyed = whole.where(kind.startswith("OBJECT") & ~single).select("src_file", F.posexplode(F.expr("try_variant_get(record, '$', 'map<string,variant>')")).alias("src_pos", "key", "record"))
    alone = whole.where(single).withColumns({"src_pos": F.lit(0), "key": none})
    parsed = whole.where("record is not null").select("src_file").distinct()
    lines_ = by_line.join(parsed, "src_file", "left_anti").select("src_file", "src_pos", none.alias("key"), "record", "error")
    return shape(listed).unionByName(shape(keyed)).unionByName(shape(alone)).unionByName(lines_)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Works of gzip JSON lines in a folder tree, .csv.gz left out; bad records have _corrupt_record.

    Only the columns of WORK are read from each record. A gzip file is one task.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").text(path)
    rows = rows.where(~F.col("_metadata.file_name").endswith(".csv.gz")).select(F.col("_metadata.file_path").alias("src_file"), "value")
    parsed = rows.withColumn("r", F.from_json("value", WORK, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("src_file", "r.*")


def csv_rows(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """CSV with a header; all columns are text.

    Quoted line ends are allowed, for which a file is one task; large files without any are split
    between tasks with multi_line off.
    """
    return spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("sep", sep).csv(path)


def column_named(df: DataFrame, name: str) -> Column:
    """The column of that name in any case."""
    for c in df.columns:
        if c.strip().lower() == name.lower():
            return df[f"`{c}`"]
    raise ValueError(f"no column {name!r} among {df.columns}")


def tsv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(gcs_path, local_path); lines that aren't two parts are left out."""
    parts = F.split("value", "\t")
    return lines(spark, path).where(F.size(parts) == 2).select(parts[0].alias("gcs_path"), ids.strip(parts[1]).alias("local_path"))


def ocr_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, pdf_path, pages); the id falls back to `id`."""
    rows = jsonl(spark, path).where("error is null")
    get = lambda k, t: F.expr(f"try_variant_get(record, '$.{k}', '{t}')")
    return rows.select(F.coalesce(F.nullif(get("document_id", "string"), F.lit("")), get("id", "string")).alias("document_id"), get("pdf_path", "string").alias("pdf_path"), get("pages", "array<int>").alias("pages"))


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id, url, src_pos) of a listing of objects, plain or gzip; other lines are left out."""
    rows = lines(spark, path).withColumn("e", ids.manifest_entry(F.col("value"))).where("e is not null")
    return rows.select("e.arxiv_id", "e.url", "src_pos")


def pdf_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, content) of PDF files, whatever the case of their suffix; fails if there are none.

    Spark's binary source leaves files of no bytes out; they are found in its listing of the folder.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    # the paths that the driver has listed for the source anyway, as the source spells them
    listed = [re.sub("^file:/+", "file:/", unquote(p)) for p in rows.inputFiles()]
    listed = [p for p in listed if p.lower().endswith(".pdf")]
    if not listed:
        raise FileNotFoundError(f"no PDF files in {path}")
    rows = rows.where(F.lower("path").endswith(".pdf")).select("path", "length", "content")
    void = spark.createDataFrame([(p,) for p in listed], "path string").join(rows.select("path"), "path", "left_anti")
    return rows.unionByName(void.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, path, content) of page images named stem_page_N or stem-N."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = ids.base_name(F.col("path"))
    pattern = r"(?i)^(.*?)[_-](?:page[_-]?)?([0-9]+)\.(?:png|jpe?g)$"
    rows = rows.withColumn("stem", F.regexp_extract(name, pattern, 1)).withColumn("page", F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).try_cast("int"))
    return rows.where("page is not null").select("stem", "page", "path", "content")


def choose_jsonl(paths: list[str]) -> str:
    """data.jsonl if there is one, else the first by name."""
    found = sorted(p for p in paths if p.endswith(".jsonl"))
    if not found:
        raise FileNotFoundError("no JSON lines file")
    return next((p for p in found if p.rsplit("/", 1)[-1] == "data.jsonl"), found[0])


def magic(content: Column) -> Column:
    """png, jpeg, pdf or other, from a file's first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("25504446"), "pdf").otherwise("other")


def pdf_status(length: Column, content: Column) -> Column:
    """corrupted (as an empty file is), password_protected, zero_pages or valid, from the bytes; pages are counted by their objects."""
    text = F.decode(content, "ISO-8859-1")
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]"))
    streams = text.contains("/ObjStm")
    bad = (magic(content) != "pdf") | ~text.contains("%%EOF")
    return F.when((length == 0) | bad, "corrupted").when(text.rlike(r"/Encrypt\s"), "password_protected").when((pages == 0) & ~streams, "zero_pages").otherwise("valid")


def fetch_by_key(keys: DataFrame, column: str, client, schema: str, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Looks each key up with client(key) -> dict; a failure is tried again after a wait, then null with its error.

    The client is shipped to tasks, so that tests and offline runs give a local one. For a service
    with a limit of requests, and answers that are kept, see lookups.lookup.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key in pdf[column]:
                got, error = ask(client, key, tries, wait)
                rows.append({column: key, **(got or {}), "error": error})
            names = [f.split()[0] for f in schema.split(",")]
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return keys.select(column).mapInPandas(run, schema)
