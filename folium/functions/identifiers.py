"""Column expressions for identifiers, paths and links. All are native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier and file-name formats of the sources.
PAPER_ID = r"([0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|[a-z\-]+/[0-9]{7}(v[0-9]+)?)"
MODERN_ID = r"^[0-9]{4}\.[0-9]{4,5}$"
VERSION = r"v([0-9]+)\.pdf$"
NEW_FILE = r"/([0-9]{4}\.[0-9]{4,5})v[0-9]+\.pdf$"
LEGACY_FILE = r"/arxiv/([^/]+)/pdf/[0-9]{4}/([0-9]{7})v[0-9]+\.pdf$"
KNOWN_SUFFIX = r"(?i)(\.tei\.xml|\.pdf|\.jsonl|\.json|\.txt|\.xml)$"
STORE = "gs://arxiv-dataset/arxiv"
_EDGE = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, _EDGE, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def slug(c: Column, default: str = "entity") -> Column:
    """Lower-case with single underscores for all but ASCII letters and digits."""
    s = F.regexp_replace(F.regexp_replace(c, "[^0-9a-zA-Z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.lower(s), F.lit("")), F.lit(default))


def paper_id(c: Column) -> Column:
    """The canonical `arXiv:` form of any spelling of a paper's id."""
    s = strip(F.regexp_replace(strip(c), "(?i)^arxiv:", ""))
    joined = F.when(~s.contains("/"), F.regexp_replace(s, "^([^_]+)_(.+)$", "$1/$2")).otherwise(s)
    found = F.regexp_extract(joined, "(?i)" + PAPER_ID, 1)
    return F.concat(F.lit("arXiv:"), F.coalesce(F.nullif(found, F.lit("")), joined))


def without_suffix(c: Column) -> Column:
    return F.regexp_replace(c, KNOWN_SUFFIX, "")


def base_name(c: Column) -> Column:
    """Last part of a path or link, without query and fragment."""
    return F.substring_index(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+$", ""), "/", -1)


def value_or_null(c: Column) -> Column:
    """Trimmed, with empty text and the usual ways to say `not available` as null."""
    s = strip(c)
    return F.when(F.lower(s).isin("", "na", "n/a"), None).otherwise(s)


def annotated_ids(link: Column) -> tuple[Column, Column]:
    """(id, DOI) of an annotated PDF link; every underscore of the name is a slash."""
    name = F.replace(without_suffix(base_name(link)), F.lit("_"), F.lit("/"))
    return F.concat(F.lit("arXiv:"), name), F.concat(F.lit("10.48550/arXiv."), name)


def doi_paper(doi: Column) -> Column:
    """struct(id, file_id) of a DOI that names a paper, else null; both null when nothing is left of it."""
    lowered = F.lower(doi)
    rest = F.nullif(F.regexp_replace(F.substring_index(lowered, "arxiv.", -1), r"\.pdf$", ""), F.lit(""))
    return F.when(lowered.contains("arxiv."), F.struct(rest.alias("id"), F.replace(rest, F.lit("/"), F.lit("_")).alias("file_id")))


def doi_class(doi: Column) -> Column:
    """arxiv, other or no_doi."""
    s = F.coalesce(strip(doi), F.lit(""))
    return F.when(s == "", "no_doi").when(F.lower(s).contains("arxiv"), "arxiv").otherwise("other")


def id_format(c: Column) -> Column:
    """modern, legacy or unknown."""
    return F.when(c.rlike(MODERN_ID), "modern").when(c.contains("/"), "legacy").when(c.rlike("^[0-9]"), "modern").otherwise("unknown")


def paper_url(c: Column, version: int = 1) -> Column:
    """Where a paper's version is in the store; null for ids of unknown form."""
    tail = F.lit(f"v{version}.pdf")
    number = F.regexp_extract(c, "^[^/]*/(.*)$", 1)
    modern = F.concat(F.lit(f"{STORE}/arxiv/pdf/"), F.substring(c, 1, 4), F.lit("/"), c, tail)
    legacy = F.concat(F.lit(f"{STORE}/"), F.substring_index(c, "/", 1), F.lit("/pdf/"), F.substring(number, 1, 4), F.lit("/"), number, tail)
    return F.when(id_format(c) == "modern", modern).when(id_format(c) == "legacy", legacy)


def file_version(c: Column) -> Column:
    """Version at the end of a PDF's name; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, VERSION, 1), F.lit("")).try_cast("int"), F.lit(0))


def base_url(c: Column) -> Column:
    return F.regexp_replace(c, r"(v[0-9]+)?\.pdf$", "")


def listed_paper(path: Column) -> Column:
    """struct(paper_id, version, local_path) of a listed PDF in either layout, else null."""
    new, subject, number = F.regexp_extract(path, NEW_FILE, 1), F.regexp_extract(path, LEGACY_FILE, 1), F.regexp_extract(path, LEGACY_FILE, 2)
    name = F.substring_index(path, "/", -1)
    version = F.nullif(F.regexp_extract(path, VERSION, 1), F.lit("")).try_cast("int")
    of = lambda i, local: F.struct(i.alias("paper_id"), version.alias("version"), local.alias("local_path"))
    return F.when(new != "", of(new, name)).when(number != "", of(F.concat(subject, F.lit("/"), number), F.concat(subject, F.lit("_"), name)))


def manifest_entry(line: Column) -> Column:
    """struct(arxiv_id, url) of a line of the object listing, else null: a PDF below /pdf/ with six parts or more."""
    s = strip(line)
    parts = F.split(s, "/")
    name = F.regexp_replace(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), "v[0-9]+$", "")
    category = F.try_element_at(parts, F.lit(5))
    ident = F.when(category == "arxiv", name).otherwise(F.concat(category, F.lit("/"), name))
    return F.when(s.contains("/pdf/") & s.endswith(".pdf") & (F.size(parts) >= 6), F.struct(ident.alias("arxiv_id"), s.alias("url")))


def store_path(c: Column) -> Column:
    """struct(bucket, key) of an s3:// path, else null."""
    bucket = F.regexp_extract(c, "^s3://([^/]+)/(.+)$", 1)
    return F.when(bucket != "", F.struct(bucket.alias("bucket"), F.regexp_extract(c, "^s3://([^/]+)/(.+)$", 2).alias("key")))


def tokens(c: Column) -> Column:
    """Parts between commas and white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)[,\s]+"), lambda x: x != "")


def directory_name(c: Column) -> Column:
    """A repository id as a folder name."""
    return F.replace(c, F.lit("/"), F.lit("_"))


def source_of(c: Column) -> Column:
    """Last part of a source's id."""
    return F.substring_index(c, "/", -1)


def plain_doi(c: Column) -> Column:
    """A DOI in lower case without its resolver."""
    return F.regexp_replace(F.lower(strip(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", "")
