"""Model output of many shapes to (doc_id, entities) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..sources.readers import ID_KEYS
from .catalog import last_wins
from .matching import canonical_ids

# Keys that hold a prediction, in order, and metadata that is kept.
PREDICTION_KEYS = ("predicted_authors", "prediction", "predictions", "authors")
METADATA = ("doi", "title", "filename", "processing_time", "error")
AUTHORS = "array<struct<name:string,affiliations:array<string>>>"


def has_key(variant: str, key: str) -> Column:
    """Whether a variant object has a key, even with a null."""
    return F.expr(f"coalesce(array_contains(json_object_keys(to_json({variant})), '{key}'), false)")


def record_id(variant: str = "record") -> Column:
    """The first usable id of a record; names of files lose folder and suffix."""
    values = []
    for k in ID_KEYS:
        v = ids.blank_to_null(F.expr(f"try_variant_get({variant}, '$.{k}', 'string')"))
        values.append(ids.without_suffix(ids.base_name(v)) if k in ("filename", "file_name") else v)
    return F.coalesce(*values)


def payload(variant: str = "record") -> Column:
    """The prediction of a record: the first key that is there, whatever it holds."""
    out = F.expr(f"try_variant_get({variant}, '$.predicted', 'variant')")
    for k in reversed(PREDICTION_KEYS):
        out = F.when(has_key(variant, k), F.expr(f"try_variant_get({variant}, '$.{k}', 'variant')")).otherwise(out)
    return out


def clean_authors(df: DataFrame, variant: str, out: str = "authors") -> DataFrame:
    """Adds array<struct<name, affiliations>> of a variant list.

    Elements that aren't objects or have no name go; one text as affiliations is a list of it,
    other shapes and elements are left out. All else than a list is an empty list.
    """
    items = F.coalesce(F.expr(f"try_variant_get({variant}, '$', 'array<variant>')"), F.expr("cast(array() as array<variant>)"))
    df = df.withColumn("_items", items)
    shaped = F.expr("""transform(_items, x -> struct(
        try_variant_get(x, '$.name', 'string') as name,
        schema_of_variant(try_variant_get(x, '$.name', 'variant')) as kind,
        coalesce(
          try_variant_get(x, '$.affiliations', 'array<string>'),
          if(schema_of_variant(try_variant_get(x, '$.affiliations', 'variant')) = 'STRING', array(try_variant_get(x, '$.affiliations', 'string')), null),
          cast(array() as array<string>)) as affiliations))""")
    df = df.withColumn("_shaped", shaped)
    kept = F.expr("transform(filter(_shaped, x -> x.kind = 'STRING' and trim(x.name) <> ''), x -> struct(x.name as name, filter(x.affiliations, a -> a is not null) as affiliations))")
    return df.withColumn(out, kept.cast(AUTHORS)).drop("_items", "_shaped")


def convert(records: DataFrame, known: DataFrame | None = None, metadata: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, authors; one row of stats) of records (src_file, src_pos, key, record, error).

    A key of a file's object is the id of its list. Null predictions are empty lists; the last
    record of an id wins; ids take the spelling of `known` (column doc_id, and src_file and src_pos,
    of which the last of equals counts) where it has them. With metadata, a record's METADATA come
    along as JSON text, null where it has none.
    """
    rows = records.withColumn("doc_id", F.coalesce(F.col("key"), record_id()))
    rows = rows.withColumn("_list", F.when(F.col("key").isNotNull(), F.col("record")).otherwise(payload()))
    rows = clean_authors(rows, "_list")
    object_ = F.schema_of_variant("record").startswith("OBJECT") | F.col("key").isNotNull()
    counted = rows.agg(
        F.count_if(object_).alias("total"),
        F.count_if(F.col("doc_id").isNotNull() & (F.size("authors") > 0)).alias("with_predictions"),
        F.count_if(F.col("doc_id").isNotNull() & (F.size("authors") == 0)).alias("null_predictions"),
        F.count_if(F.col("doc_id").isNull()).alias("errors"),
    )
    kept = []
    for f in METADATA if metadata else ():
        v = F.expr(f"try_variant_get(record, '$.{f}', 'variant')")
        kept.append(F.when(F.col("key").isNull() & ~F.is_variant_null(v), F.to_json(v)).alias(f))
    good = rows.where("doc_id is not null").select("doc_id", "authors", "src_file", "src_pos", *kept)
    if known is None:
        good = good.withColumn("doc_id", ids.paper_id(F.col("doc_id")))
    else:
        good = canonical_ids(good, known, "doc_id", ids.paper_id, *(c for c in ("src_file", "src_pos") if c in known.columns))
    return last_wins(good, "doc_id", "src_file", "src_pos").drop("src_file", "src_pos"), counted


def adapt(records: DataFrame, doc_id_field: str, entities_field: str) -> DataFrame:
    """(doc_id, entities variant, src_pos): payload by presence of predicted_X, X or prediction; the last of an id wins.

    A list stays; a null stays null; anything else is an empty list.
    """
    doc = F.coalesce(F.col("key"), F.expr(f"try_variant_get(record, '$.{doc_id_field}', 'string')"))
    get = lambda k: F.expr(f"try_variant_get(record, '$.{k}', 'variant')")
    found = F.lit(None)
    for k in ("prediction", entities_field, f"predicted_{entities_field}"):
        found = F.when(has_key("record", k), get(k)).otherwise(found) if k != "prediction" else F.when(has_key("record", k), get(k))
    rows = records.select(doc.alias("doc_id"), found.alias("entities"), "src_file", "src_pos").where("doc_id is not null")
    lists = F.schema_of_variant("entities").startswith("ARRAY")
    rows = rows.withColumn("entities", F.when(lists, F.col("entities")).when(F.col("entities").isNull() | F.is_variant_null("entities"), None).otherwise(F.parse_json(F.lit("[]"))))
    return last_wins(rows, "doc_id", "src_file", "src_pos").select("doc_id", "entities", "src_pos")


def annotations(rows: DataFrame) -> DataFrame:
    """Nested publications of annotation rows (link, title, title_lang, author, affiliation, src_pos).

    The first row of a link gives its title; authors and affiliations are in first-seen order, once each.
    """
    rows = rows.select(ids.value_or_null(F.col("link")).alias("link"), ids.value_or_null(F.col("title")).alias("title"), ids.value_or_null(F.col("title_lang")).alias("lang"), ids.value_or_null(F.col("author")).alias("author"), ids.value_or_null(F.col("affiliation")).alias("aff"), "src_pos").where("link is not null")
    top = rows.groupBy("link").agg(F.min_by(F.struct(F.col("title").alias("text"), "lang"), "src_pos").alias("title"), F.min("src_pos").alias("first"))
    once = rows.where("author is not null").groupBy("link", "author", "aff").agg(F.min("src_pos").alias("p"))
    people = once.groupBy("link", "author").agg(F.min("p").alias("p"), F.array_sort(F.collect_list(F.when(F.col("aff").isNotNull(), F.struct("p", "aff")))).alias("a"))
    authors = people.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("p", F.struct(F.col("author").alias("name"), F.col("a.aff").alias("affiliations")).alias("v")))).alias("x"))
    ident, doi = ids.annotated_ids(F.col("link"))
    empty = F.expr(f"cast(array() as {AUTHORS})")
    return top.join(authors, "link", "left").select(ident.alias("arxiv_id"), doi.alias("doi"), "title", F.coalesce(F.col("x.v").cast(AUTHORS), empty).alias("authors"), ids.base_name(F.col("link")).alias("filename"), "first")


def api_record(rows: DataFrame, *keep: str) -> DataFrame:
    """Ground-truth documents of bibliographic records joined to their inputs.

    rows: arxiv_id, filename, doi, title, display_name, language, authorships. Raw names win over
    display names; nameless authors go; `missing_all` says that nobody has an affiliation. Columns
    named in keep come along.
    """
    name = lambda a: F.coalesce(F.nullif(a.raw_author_name, F.lit("")), F.nullif(a.author.display_name, F.lit("")))
    people = F.filter(F.transform(F.coalesce("authorships", F.expr("array()")), lambda a: F.struct(name(a).alias("name"), F.coalesce(a.raw_affiliation_strings, F.expr("array()")).alias("affiliations"))), lambda x: x["name"].isNotNull())
    out = rows.withColumn("authors", people.cast(AUTHORS))
    title = F.struct(F.coalesce(F.nullif("title", F.lit("")), F.col("display_name")).alias("text"), F.coalesce("language", F.lit("en")).alias("lang"))
    return out.select("arxiv_id", "doi", title.alias("title"), "authors", "filename", F.coalesce(F.forall("authors", lambda a: F.size(a.affiliations) <= 0), F.lit(True)).alias("missing_all"), *keep)
