"""The package's queries over the test tables, each with its SQL equivalent where SQL has one.

The tables hold no author records, so each operator runs on a table of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import jsonfix
from ..functions.metrics import image_scale, ratio, render_zoom, scores
from ..functions.similarity import indel_ratio, normalize, with_normalized
from ..operators import catalog, documents, matching, profile, stages
from . import evaluation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Reads tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(sql: str | None = None):
    """Registers a function of (table reader) under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _works(t):
    """Orders as works of a snapshot, their lines as authors; a line that isn't flagged N has an institution."""
    place = F.when(F.col("l_returnflag") != "N", F.array("l_linestatus")).otherwise(F.expr("cast(array() as array<string>)"))
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(place.alias("institutions"))).alias("authorships"))
    source = F.concat(F.lit("https://example.org/S"), (F.col("o_orderkey") % 3).cast("string"))
    works = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return works.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(None).cast("string").alias("doi"), F.struct(F.struct(source.alias("id")).alias("source")).alias("primary_location"), "authorships")


_WORKS_SQL = """
  SELECT o_orderkey, count(l_orderkey) AS authors, count(*) FILTER (WHERE l_returnflag <> 'N') AS affiliated
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
"""


@query(f"""
SELECT CASE WHEN authors = 0 THEN 'no_authors' WHEN affiliated = authors THEN 'all_affiliations'
            WHEN affiliated > 0 THEN 'partial_affiliations' ELSE 'no_affiliations' END AS category,
       count(*)::BIGINT AS works, sum(authors)::BIGINT AS authors
FROM ({_WORKS_SQL}) GROUP BY 1
""")
def completeness_categories(t):
    return profile.classify_works(_works(t)).groupBy("category").agg(F.count("*").alias("works"), F.sum("authors").alias("authors"))


@query(f"""
SELECT median(affiliated * 100.0::DOUBLE / authors) FILTER (WHERE authors > 0) AS median_pct, count(*)::BIGINT AS works_found,
       count(*) FILTER (WHERE authors > 0 AND affiliated = authors)::BIGINT AS all_affiliations, count(*) FILTER (WHERE affiliated > 0 AND affiliated < authors)::BIGINT AS partial_affiliations
FROM ({_WORKS_SQL}) WHERE o_orderkey % 3 = 1
""")
def completeness_median(t):
    """The summary of the works of one source."""
    return profile.completeness_summary(profile.classify_works(_works(t), "S1")).select("median_pct", "works_found", "all_affiliations", "partial_affiliations")


@query("SELECT page_id, split_part(url, '/', 3) AS host FROM pages WHERE split_part(url, '/', -1) LIKE '%1'")
def source_works(t):
    rows = t("pages").where(ids.source_of(F.col("url")).endswith("1"))
    return rows.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))


@query("""
SELECT conv_id AS document_id, count(*)::BIGINT AS page_count, bool_and(role <> 'system') AS success, min_by(role, turn) AS first_role,
       sum(length(text))::BIGINT AS n_chars,
       string_agg(CASE WHEN regexp_replace(text, '\\s+$', '') <> '' THEN regexp_replace(text, '\\s+$', '') END, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def merge_pages(t):
    none = F.lit(None)
    pages = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.col("turn").alias("page_index"), none.cast("string").alias("pdf_path"), F.col("role").alias("model"), (F.col("role") != "system").alias("success"), F.lit(0.0).alias("latency"), none.cast("int").alias("rotation_applied"), F.length("text").cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), none.cast("long").alias("total_tokens"), F.col("text").alias("content"), F.col("turn").alias("src_pos"))
    return documents.merge_pages(pages).select("document_id", "page_count", "success", F.col("model").alias("first_role"), F.col("total_tokens").alias("n_chars"), "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def page_head_n(t):
    return documents.head_pages(t("conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("""
SELECT conv_id AS document_id, count(*)::BIGINT AS page_count,
  '# Document: ' || conv_id || chr(10) || chr(10) || '*Processed from ' || count(*) || ' pages*' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
  string_agg('<!-- Page ' || turn || ' -->' || chr(10) || chr(10) ||
    CASE WHEN trim(text) = '' THEN '' WHEN role = 'system' THEN '# ' || trim(text) || chr(10) || chr(10)
         WHEN role = 'user' THEN '## ' || trim(text) || chr(10) || chr(10) ELSE trim(text) || chr(10) || chr(10) END, '' ORDER BY turn) AS markdown
FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations) GROUP BY conv_id
""")
def markdown_assembly(t):
    kind = F.when(F.col("role") == "system", "Title").when(F.col("role") == "user", "Section-header").otherwise("Text")
    pages = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), F.col("turn").alias("src_pos"), F.array(F.struct(kind.alias("category"), "text")).alias("elements"))
    return documents.assemble_markdown(pages)


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_version(t):
    return catalog.best_per(t("events"), "user_id", F.desc("ts"), F.col("event_id")).select("user_id", "event_id", "ts", "event_type")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(t):
    return catalog.last_wins(t("events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_pending(t):
    return catalog.not_present(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_semi(t):
    return catalog.pending(t("documents").select("doc_id", "source"), t("labels"), "doc_id")


@query("""
WITH r AS (
  SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((o_custkey % 100000)::VARCHAR, 5, '0')
                       WHEN o_orderkey % 3 = 1 THEN 'cat' || (o_orderkey % 7) || '/' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0')
                       ELSE 'x' || o_orderkey END AS arxiv_id, o_custkey FROM orders
), m AS (SELECT arxiv_id, arxiv_id || 'v' || (o_custkey % 3 + 1) || '.pdf' AS url FROM r WHERE o_custkey % 2 = 0),
b AS (SELECT arxiv_id, min(url) FILTER (WHERE v = mv) AS url FROM (SELECT *, regexp_extract(url, 'v([0-9]+)\\.pdf$', 1)::INT AS v, max(regexp_extract(url, 'v([0-9]+)\\.pdf$', 1)::INT) OVER (PARTITION BY arxiv_id) AS mv FROM m) GROUP BY arxiv_id)
SELECT i.arxiv_id, CASE WHEN b.url IS NOT NULL THEN b.url WHEN p.arxiv_id IS NOT NULL THEN p.url END AS url,
       CASE WHEN b.url IS NOT NULL THEN 'manifest' WHEN p.arxiv_id IS NOT NULL THEN 'constructed' ELSE 'not_found' END AS status
FROM (SELECT DISTINCT arxiv_id FROM r) i LEFT JOIN b USING (arxiv_id)
LEFT JOIN (SELECT DISTINCT arxiv_id, CASE WHEN arxiv_id LIKE 'cat%' THEN 'gs://arxiv-dataset/arxiv/' || split_part(arxiv_id, '/', 1) || '/pdf/' || substr(split_part(arxiv_id, '/', 2), 1, 4) || '/' || split_part(arxiv_id, '/', 2)
                                      ELSE 'gs://arxiv-dataset/arxiv/arxiv/pdf/' || substr(arxiv_id, 1, 4) || '/' || arxiv_id END || 'v4.pdf' AS url
           FROM r WHERE o_custkey % 5 = 1 AND arxiv_id NOT LIKE 'x%') p USING (arxiv_id)
""")
def resolve_status(t):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ident = F.when(o % 3 == 0, F.concat(pad(o % 10000, 4), F.lit("."), pad(c % 100000, 5))).when(o % 3 == 1, F.concat(F.lit("cat"), (o % 7).cast("string"), F.lit("/"), pad(c % 10000000, 7))).otherwise(F.concat(F.lit("x"), o.cast("string")))
    rows = t("orders").select(ident.alias("arxiv_id"), "o_custkey").distinct()
    manifest = rows.where("o_custkey % 2 = 0").select("arxiv_id", F.concat("arxiv_id", F.lit("v"), (c % 3 + 1).cast("string"), F.lit(".pdf")).alias("url"))
    listing = rows.where("o_custkey % 5 = 1").select(ids.paper_url(F.col("arxiv_id"), 4).alias("url")).where("url is not null").distinct()
    return catalog.resolve(rows, manifest, listing)


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // 300 + 1)::BIGINT AS batch FROM part")
def batch_assign(t):
    return catalog.batches(t("part").select("p_partkey"), "p_partkey", size=300)


@query("SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) // CAST(ceil((SELECT count(*) FROM part) / 7.0) AS BIGINT) + 1)::BIGINT AS batch FROM part")
def batch_by_count(t):
    return catalog.batches(t("part").select("p_partkey"), "p_partkey", count=7)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'error' WHEN l.toxic = 1 THEN 'null_prediction' ELSE 'success' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def tri_state_join(t):
    pred = t("labels").select("doc_id", F.when(F.col("toxic") == 0, F.parse_json(F.lit("[]"))).alias("entities"))
    return evaluation.statuses(t("documents"), pred)


@query("""
SELECT n_nationkey, coalesce(r.r_name, lower(trim(x.spelled))) AS region FROM
  (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '  ' || lower(r_name) || ' ' WHEN n_nationkey % 4 = 1 THEN r_name ELSE 'zone ' || n_regionkey END AS spelled FROM nation JOIN region ON n_regionkey = r_regionkey) x
  LEFT JOIN region r ON lower(trim(r.r_name)) = lower(trim(x.spelled))
""")
def id_lookup(t):
    k = F.col("n_nationkey")
    spelled = F.when(k % 4 == 0, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" "))).when(k % 4 == 1, F.col("r_name")).otherwise(F.concat(F.lit("zone "), F.col("n_regionkey").cast("string")))
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", spelled.alias("region"))
    return matching.canonical_ids(rows, t("region").select(F.col("r_name").alias("region")), "region", lambda c: F.lower(F.trim(c))).select("n_nationkey", "region")


def _keyed(t):
    g = t("customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("idx"), (F.floor(F.col("c_acctbal") / 500)).cast("long").alias("norm"))
    p = t("supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("idx"), (F.floor(F.col("s_acctbal") / 500)).cast("long").alias("norm"))
    return g, p


_KEYED_SQL = """
WITH g AS (SELECT c_nationkey AS doc_id, c_custkey AS idx, floor(c_acctbal / 500)::BIGINT AS norm, row_number() OVER (PARTITION BY c_nationkey, floor(c_acctbal / 500) ORDER BY c_custkey) AS occ FROM customer),
     p AS (SELECT s_nationkey AS doc_id, s_suppkey AS idx, floor(s_acctbal / 500)::BIGINT AS norm, row_number() OVER (PARTITION BY s_nationkey, floor(s_acctbal / 500) ORDER BY s_suppkey) AS occ FROM supplier)
"""


@query(_KEYED_SQL + "SELECT g.doc_id, g.norm, g.idx AS gt_idx, p.idx AS pred_idx FROM g JOIN p USING (doc_id, norm, occ)")
def strict_match_pairs(t):
    return matching.strict_pairs(*_keyed(t), ["doc_id", "norm"])[0].select("doc_id", "norm", "gt_idx", "pred_idx")


@query(_KEYED_SQL + """
SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, count(*) FILTER (WHERE g.idx IS NOT NULL AND p.idx IS NOT NULL)::BIGINT AS tp,
       count(*) FILTER (WHERE g.idx IS NULL)::BIGINT AS fp, count(*) FILTER (WHERE p.idx IS NULL)::BIGINT AS fn
FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.norm = p.norm AND g.occ = p.occ GROUP BY 1
""")
def strict_match_counts(t):
    return matching.strict_counts(*_keyed(t), "doc_id", "norm")


@query("""
WITH d AS (SELECT conv_id, list_distinct(list_filter(string_split(lower(string_agg(text, ' ') FILTER (WHERE role = 'user')), ' '), lambda w: w <> '')) AS g,
                  list_distinct(list_filter(string_split(lower(string_agg(text, ' ') FILTER (WHERE role = 'assistant')), ' '), lambda w: w <> '')) AS p FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_filter(coalesce(g, []), lambda x: list_contains(coalesce(p, []), x)))::BIGINT AS matched, len(list_filter(coalesce(g, []), lambda x: NOT list_contains(coalesce(p, []), x)))::BIGINT AS missing, len(list_filter(coalesce(p, []), lambda x: NOT list_contains(coalesce(g, []), x)))::BIGINT AS extra FROM d
""")
def array_set_match(t):
    words = lambda role: F.filter(F.split(F.lower(F.array_join(F.collect_list(F.when(F.col("role") == role, F.col("text"))), " ")), " "), lambda w: w != "")
    d = t("conversations").groupBy("conv_id").agg(words("user").alias("g"), words("assistant").alias("p"))
    got = matching.compare_values(F.col("g"), F.col("p"))
    return d.select("conv_id", *(F.size(c).cast("long").alias(k) for k, c in got.items()))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name)::BIGINT AS edits FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def edit_similarity(t):
    return matching.edit_pairs(t("part"), "p_partkey", "p_name", "p_brand", "p_size")


@query("""
WITH RECURSIVE w AS (SELECT DISTINCT c_mktsegment AS a, o_orderpriority AS b FROM customer JOIN orders ON o_custkey = c_custkey),
lcs(a, b, i, l) AS (
  SELECT a, b, 0, [0 FOR j IN range(length(b) + 1)] FROM w
  UNION ALL
  SELECT a, b, i + 1, [list_max([greatest(l[k + 1], CASE WHEN k > 0 AND a[i + 1] = b[k] THEN l[k] + 1 ELSE 0 END) FOR k IN range(j + 1)]) FOR j IN range(length(b) + 1)] FROM lcs WHERE i < length(a)
)
SELECT o_orderkey, 2.0::DOUBLE * l[length(b) + 1] / (length(a) + length(b)) AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lcs ON a = c_mktsegment AND b = o_orderpriority AND i = length(a)
""")
def indel_similarity(t):
    """Similarity of each order's priority to its customer's segment."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", indel_ratio("c_mktsegment", "o_orderpriority").alias("score"))


def _numbered(t):
    """Customers and suppliers by the nine digits of their names, in groups of fifty keys."""
    side = lambda name, key, text: t(name).select(F.floor(F.col(key) / 50).cast("long").alias("doc_id"), F.col(key).alias("idx"), F.regexp_extract(text, "([0-9]+)$", 1).alias("text"))
    return side("customer", "c_custkey", "c_name"), side("supplier", "s_suppkey", "s_name")


_NUMBERED_SQL = """
WITH g AS (SELECT c_custkey // 50 AS doc_id, c_custkey AS idx, regexp_extract(c_name, '([0-9]+)$', 1) AS text FROM customer),
     p AS (SELECT s_suppkey // 50 AS doc_id, s_suppkey AS idx, regexp_extract(s_name, '([0-9]+)$', 1) AS text FROM supplier)
"""


@query(_NUMBERED_SQL + "SELECT g.doc_id, g.idx AS gt_idx, p.idx AS pred_idx, 1.0::DOUBLE AS score FROM g JOIN p ON g.doc_id = p.doc_id AND g.text = p.text")
def fuzzy_assignment(t):
    """Customers and suppliers with similar numbers, one to one, among fifty of each.

    Numbers that differ in a digit are similar too, but the whole is largest where equals pair off.
    """
    return matching.fuzzy_pairs(*_numbered(t), "doc_id", "text", 0.85)


@query(_NUMBERED_SQL + "SELECT g.doc_id, g.idx AS src_idx, p.idx AS tgt_idx, 100.0::DOUBLE AS score FROM g JOIN p ON g.doc_id = p.doc_id AND g.text = p.text")
def greedy_map(t):
    """Customers to suppliers by number, among fifty of each. Numbers that differ in one of nine digits stay under 90."""
    return matching.greedy_map(*_numbered(t), "doc_id", "text")


#: Similarities of the pairs w(a, b), by the longest common subsequence, one character of a at a time.
_LCS_SQL = """
lcs(a, b, i, l) AS (
  SELECT a, b, 0, [0 FOR j IN range(length(b) + 1)] FROM w
  UNION ALL
  SELECT a, b, i + 1, [list_max([greatest(l[k + 1], CASE WHEN k > 0 AND a[i + 1] = b[k] THEN l[k] + 1 ELSE 0 END) FOR k IN range(j + 1)]) FOR j IN range(length(b) + 1)] FROM lcs WHERE i < length(a)
), s AS (SELECT a, b, 2.0::DOUBLE * l[length(b) + 1] / (length(a) + length(b)) AS score FROM lcs WHERE i = length(a))
"""


@query(_NUMBERED_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", w AS (SELECT DISTINCT g.text AS a, p.text AS b FROM g JOIN p USING (doc_id)), " + _LCS_SQL + """
SELECT doc_id::VARCHAR AS doc_id, a, b, score FROM (SELECT DISTINCT doc_id, g.text AS a, p.text AS b FROM g JOIN p USING (doc_id)) JOIN s USING (a, b) WHERE score >= 0.85
""")
def near_pairs(t):
    """All similar numbers of customers and suppliers among fifty keys, equal or not, by the index of rare grams."""
    from ..operators.near import near_pairs as pairs

    return pairs(*_numbered(t), "doc_id", "text", 0.85).withColumnRenamed("group", "doc_id")


_HEX_SQL = """
WITH RECURSIVE g AS (SELECT c_custkey // 2 AS doc_id, c_custkey % 2 AS i, left(md5(c_custkey::VARCHAR), 8) AS text FROM customer),
     p AS (SELECT s_suppkey // 2 AS doc_id, s_suppkey % 2 AS j, left(md5('s' || s_suppkey), 8) AS text FROM supplier),
     w AS (SELECT DISTINCT g.text AS a, p.text AS b FROM g JOIN p USING (doc_id)),
"""


def _hexes(t):
    """Customers and suppliers by eight random digits each, in groups of two keys."""
    side = lambda name, key, mark: t(name).select(F.floor(F.col(key) / 2).cast("long").alias("doc_id"), F.col(key).alias("idx"), F.substring(F.md5(F.concat(F.lit(mark), F.col(key).cast("string")).cast("binary")), 1, 8).alias("text"))
    return side("customer", "c_custkey", ""), side("supplier", "s_suppkey", "s")


@query(_HEX_SQL + _LCS_SQL + """, c AS (
  SELECT doc_id, coalesce(max(score) FILTER (WHERE i = 0 AND j = 0), 0) AS s00, coalesce(max(score) FILTER (WHERE i = 0 AND j = 1), 0) AS s01,
         coalesce(max(score) FILTER (WHERE i = 1 AND j = 0), 0) AS s10, coalesce(max(score) FILTER (WHERE i = 1 AND j = 1), 0) AS s11
  FROM g JOIN p USING (doc_id) JOIN s ON s.a = g.text AND s.b = p.text WHERE score >= 0.5 GROUP BY doc_id
)
SELECT doc_id, greatest(s00 + s11, s01 + s10) AS total, CASE WHEN s00 + s11 >= s01 + s10 THEN (s00 > 0)::BIGINT + (s11 > 0)::BIGINT ELSE (s01 > 0)::BIGINT + (s10 > 0)::BIGINT END AS pairs FROM c
""")
def fuzzy_totals(t):
    """What the best assignment of two customers to two suppliers by random digits comes to, where it isn't the same for all."""
    found = matching.fuzzy_pairs(*_hexes(t), "doc_id", "text", 0.5, cells=2)
    return found.groupBy("doc_id").agg(F.sum("score").alias("total"), F.count("*").alias("pairs"))


@query(_NUMBERED_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", q AS (SELECT * FROM p WHERE idx % 2 = 0), w AS (SELECT DISTINCT g.text AS a, q.text AS b FROM g JOIN q USING (doc_id)), " + _LCS_SQL + """
SELECT doc_id, g.idx AS src_idx, q.idx AS tgt_idx, score * 100 AS score FROM g JOIN q USING (doc_id) JOIN s ON s.a = g.text AND s.b = q.text WHERE score * 100 >= 70
QUALIFY row_number() OVER (PARTITION BY doc_id, g.idx ORDER BY score DESC, q.idx) = 1
""")
def greedy_similar(t):
    """Each customer's most similar supplier with an even key, by number; those with odd keys have only similar ones. By the index of rare grams."""
    left, right = _numbered(t)
    return matching.greedy_map(left, right.where("idx % 2 = 0"), "doc_id", "text", 70.0, cells=100)


def same_signs(a: str, b: str) -> float:
    return float(sorted(a) == sorted(b))


@query("""
WITH c AS (SELECT regexp_extract(c_name, '([0-9]+)$', 1) AS a FROM customer), s AS (SELECT regexp_extract(s_name, '([0-9]+)$', 1) AS b FROM supplier)
SELECT DISTINCT a, b, 1.0::DOUBLE AS score FROM c JOIN s ON list_sort(string_split(a, '')) = list_sort(string_split(b, ''))
""")
def match_type_pairs(t):
    """Customers and suppliers whose numbers have the same digits in any order: a registered match type with keys of its own, in one group."""
    from ..functions.similarity import MATCH_TYPES, register_match_type
    from ..operators.near import near_pairs as pairs

    register_match_type("same_signs", same_signs, lambda c: F.array(F.array_join(F.array_sort(F.split(c, "")), "")), lambda a, b, least: F.length(a) == F.length(b))
    left, right = (df.withColumn("doc_id", F.lit("all")) for df in _numbered(t))
    return pairs(left, right, "doc_id", "text", 1.0, MATCH_TYPES["same_signs"]).drop("group")


@query("SELECT event_type AS server, max(event_id % 100)::INTEGER AS peak_running, max(user_id % 50)::INTEGER AS peak_waiting FROM events GROUP BY event_type")
def stream_peaks(t):
    """The last of the peaks that a stream of log lines, made of the events, tells of for each of their types."""
    from ..shared import shared_dir
    from ..streaming import ingest, monitor

    events = t("events")
    work = shared_dir(events.sparkSession)
    stream = ingest.drop_folder(events.sparkSession, t.path("events"), events.schema)
    line = F.concat(F.lit("Running: "), F.col("event_id") % 100, F.lit(" reqs, Waiting: "), F.col("user_id") % 50, F.lit(" reqs"))
    peaks = monitor.running_peaks(stream.select("event_type", line.alias("value")), "event_type")
    peaks.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start(f"{work}/out").awaitTermination()
    told = events.sparkSession.read.schema(peaks.schema).parquet(f"{work}/out")
    # peaks only rise
    return told.groupBy("server").agg(F.max("peak_running").alias("peak_running"), F.max("peak_waiting").alias("peak_waiting"))


_RULE_SQL = "SELECT lang, count(*) FILTER (WHERE n_chars {op} {n} AND quality = 1)::BIGINT AS tp, count(*) FILTER (WHERE n_chars {op} {n} AND quality = 0)::BIGINT AS fp, count(*) FILTER (WHERE NOT n_chars {op} {n} AND quality = 1)::BIGINT AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang"
_PRF_SQL = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall"


def _rule(t, least):
    said, true = F.col("n_chars") >= least, F.col("quality") == 1
    return t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))


@query(f"SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (1.0::DOUBLE * precision + recall) ELSE 0 END AS f1_score FROM (SELECT *, {_PRF_SQL} FROM ({_RULE_SQL.format(op='>=', n=500)}))")
def prf_by_lang(t):
    s = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return _rule(t, 500).withColumns({k: s[k] for k in ("precision", "recall", "f1_score")})


@query("""
WITH c AS (SELECT lang, (n_chars >= 500)::INT = quality AS a, (n_chars >= 300)::INT = 1 - toxic AS b FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE a AND b)::BIGINT AS tp, count(*) FILTER (WHERE NOT (a AND b))::BIGINT AS fp, count(*) FILTER (WHERE NOT (a AND b))::BIGINT AS fn FROM c GROUP BY lang
""")
def combined_penalty(t):
    """Documents with one entity each, whose two fields are guessed from the length: partial matches count against both sides."""
    from ..schema import EntitySchema, EvalConfig

    config = EvalConfig(EntitySchema({"name": "string", "long": "string", "clean": "string"}, "Document"))
    rows = t("documents").join(t("labels"), "doc_id")
    entity = lambda long, clean: F.parse_json(F.to_json(F.array(F.struct(F.col("source").alias("name"), long.cast("int").cast("string").alias("long"), clean.cast("int").cast("string").alias("clean")))))
    gt = rows.select("doc_id", entity(F.col("quality"), 1 - F.col("toxic")).alias("entities"))
    pred = rows.select("doc_id", entity(F.col("n_chars") >= 500, F.col("n_chars") >= 300).alias("entities"))
    counts = evaluation.evaluate(gt, pred, config).counts.where("category = 'combined' and mode = 'strict'")
    return counts.join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _long(t, least):
    rows = _rule(t, least).select(F.col("lang").alias("category"), F.lit("strict").alias("mode"), "tp", "fp", "fn")
    return evaluation.long_metrics(evaluation.with_scores(rows)).where(F.col("metric").isin("precision", "recall", "true_positives"))


@query(f"""
WITH a AS (SELECT *, {_PRF_SQL} FROM ({_RULE_SQL.format(op='>=', n=500)})), b AS (SELECT *, {_PRF_SQL} FROM ({_RULE_SQL.format(op='>=', n=900)})),
la AS (SELECT lang, 'precision' AS metric, precision AS v FROM a UNION ALL SELECT lang, 'recall', recall FROM a UNION ALL SELECT lang, 'true_positives', tp::DOUBLE FROM a),
lb AS (SELECT lang, 'precision' AS metric, precision AS v FROM b UNION ALL SELECT lang, 'recall', recall FROM b UNION ALL SELECT lang, 'true_positives', tp::DOUBLE FROM b)
SELECT 'strict' AS mode, lang AS category, metric, la.v AS baseline, lb.v AS candidate, lb.v - la.v AS delta FROM la JOIN lb USING (lang, metric)
""")
def metric_delta(t):
    return evaluation.compare_reports(_long(t, 500), _long(t, 900))


@query(f"""
WITH r AS ({_RULE_SQL.format(op='>=', n=500)}), c AS (
  SELECT CASE lang WHEN 'en' THEN 'entity:author' WHEN 'de' THEN 'combined' ELSE 'field:' || lang END AS category, tp, fp, fn FROM r)
SELECT category, CASE WHEN category LIKE 'entity:%' THEN 'author_identification' WHEN category LIKE 'field:%' THEN split_part(category, ':', 2) || '_matching' ELSE 'combined_authors' END AS label,
       sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, (CASE WHEN category LIKE 'entity:%' THEN 0 WHEN category LIKE 'field:%' THEN 1 ELSE 2 END)::INT AS rank FROM c GROUP BY category
""")
def category_report(t):
    c = F.when(F.col("lang") == "en", "entity:author").when(F.col("lang") == "de", "combined").otherwise(F.concat(F.lit("field:"), "lang"))
    rep = evaluation.report(_rule(t, 500).select(c.alias("category"), F.lit("strict").alias("mode"), "tp", "fp", "fn"))
    return rep.select("category", "label", "tp", "fp", "fn", evaluation.category_rank(F.col("category")).alias("rank"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS w, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) AS v FROM lineitem GROUP BY l_orderkey),
     w AS (SELECT coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(v, 0) AS v FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
     s AS (SELECT *, CASE WHEN n = 0 THEN 'no' WHEN w = 0 THEN 'all' WHEN w < n THEN 'some' ELSE 'none' END AS s FROM w),
     a AS (SELECT count(*) AS t, count(*) FILTER (WHERE s = 'all') AS al, count(*) FILTER (WHERE s = 'some') AS so, count(*) FILTER (WHERE s = 'none') AS nn, count(*) FILTER (WHERE s = 'no') AS no, sum(n) AS n, sum(w) AS w, sum(n) AS e, sum(v) AS v FROM s)
SELECT * FROM (
  SELECT 'works_all_authors_missing_affiliations' AS category, al::BIGINT AS "count", al * 100.0::DOUBLE / t AS pct FROM a UNION ALL
  SELECT 'works_some_authors_missing_affiliations', so::BIGINT, so * 100.0::DOUBLE / t FROM a UNION ALL SELECT 'works_all_authors_have_affiliations', nn::BIGINT, nn * 100.0::DOUBLE / t FROM a UNION ALL
  SELECT 'works_no_authors', no::BIGINT, no * 100.0::DOUBLE / t FROM a UNION ALL SELECT 'total_works', t::BIGINT, 100.0::DOUBLE FROM a UNION ALL SELECT 'total_authors', n::BIGINT, NULL FROM a UNION ALL
  SELECT 'authors_with_affiliations', w::BIGINT, w * 100.0::DOUBLE / n FROM a UNION ALL SELECT 'authors_without_affiliations', (n - w)::BIGINT, (n - w) * 100.0::DOUBLE / n FROM a UNION ALL
  SELECT 'total_affiliations', e::BIGINT, NULL FROM a UNION ALL SELECT 'valid_affiliations', v::BIGINT, v * 100.0::DOUBLE / e FROM a)
""")
def null_profile(t):
    name = F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_linestatus"))
    people = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array(F.struct(name.alias("affiliation"))).alias("affiliations"))).alias("prediction"))
    works = t("orders").select("o_orderkey").join(people, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return profile.null_profile(works)


@query("""SELECT event_type, count(*)::BIGINT AS "count", count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM events GROUP BY event_type""")
def share_table(t):
    return profile.share_table(t("events"), "event_type")


@query("SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'no_doi' WHEN lower(url) LIKE '%utm%' THEN 'arxiv' ELSE 'other' END AS kind FROM pages")
def doi_split(t):
    doi = F.when(F.col("page_id") % 11 == 0, "  ").otherwise(F.replace(F.lower("url"), F.lit("utm"), F.lit("10.48550/ARXIV.")))
    return t("pages").select("page_id", ids.doi_class(doi).alias("kind"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def text_normalize(t):
    return t("documents").select("doc_id", normalize("text").alias("norm"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(source)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def normalize_distinct(t):
    return with_normalized(t("documents").select("doc_id", "source"), "source", "norm").select("doc_id", "norm")


@query("""
SELECT page_id, 'arXiv:' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '.' || lpad((page_id * 7 % 100000)::VARCHAR, 5, '0') || 'v' || (page_id % 4 + 1) AS ident, (page_id % 4 + 1)::INT AS version FROM pages
""")
def id_normalize(t):
    k = F.col("page_id")
    core = F.concat(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k * 7 % 100000).cast("string"), 5, "0"), F.lit("v"), (k % 4 + 1).cast("string"))
    spelled = F.when(k % 3 == 0, F.concat(F.lit(" ARXIV: "), core)).when(k % 3 == 1, F.concat(F.lit("see "), core, F.lit(" for more"))).otherwise(core)
    return t("pages").select("page_id", ids.paper_id(spelled).alias("ident"), ids.file_version(F.concat(core, F.lit(".pdf"))).alias("version"))


@query("SELECT c_custkey, coalesce(nullif(lower(trim(regexp_replace(c_name, '[^0-9a-zA-Z]+', '_', 'g'), '_')), ''), 'entity') AS slug FROM customer")
def identifier_slug(t):
    return t("customer").select("c_custkey", ids.slug(F.col("c_name")).alias("slug"))


@query("""SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS base, len(list_filter(regexp_split_to_array(url, '[,\\s]+'), lambda x: x <> ''))::INT AS parts FROM pages""")
def url_parts(t):
    return t("pages").select("page_id", ids.base_name(F.col("url")).alias("base"), F.size(ids.tokens(F.col("url"))).alias("parts"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(t):
    v = jsonfix.parse_list(F.col("props"))
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""
SELECT user_id, sum(p)::BIGINT AS prompt_tokens, sum(CASE WHEN tot <> 0 THEN tot ELSE p + c END)::BIGINT AS total_tokens FROM (
  SELECT user_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS p, (event_id % 5) AS c, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 100 END AS tot FROM events) GROUP BY user_id
""")
def token_usage(t):
    k = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(0))
    none = F.lit(None)
    pages = t("events").select(F.col("user_id").alias("document_id"), F.lit(0).alias("page"), F.lit(0).alias("page_index"), none.cast("string").alias("pdf_path"), none.cast("string").alias("model"), F.lit(True).alias("success"), F.lit(0.0).alias("latency"), none.cast("int").alias("rotation_applied"), k.alias("prompt_tokens"), (F.col("event_id") % 5).alias("completion_tokens"), F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("event_id") % 100).alias("total_tokens"), F.lit("").alias("content"), F.col("event_id").alias("src_pos"))
    return documents.merge_pages(pages).select(F.col("document_id").alias("user_id"), "prompt_tokens", "total_tokens")


@query("SELECT 'arXiv:' || o_custkey AS arxiv_id, count(DISTINCT o_orderkey)::BIGINT AS orders, count(DISTINCT (o_orderkey, l_suppkey))::BIGINT AS suppliers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def nested_group(t):
    """Customers as publications, their orders as authors, the orders' suppliers as affiliations."""
    from ..operators.predictions import annotations

    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    text = lambda c: F.col(c).cast("string")
    rows = rows.select(F.concat(text("o_custkey"), F.lit(".pdf")).alias("link"), F.lit("T").alias("title"), F.lit("en").alias("title_lang"), text("o_orderkey").alias("author"), text("l_suppkey").alias("affiliation"), F.col("l_linenumber").alias("src_pos"))
    return annotations(rows).select("arxiv_id", F.size("authors").cast("long").alias("orders"), F.aggregate("authors", F.lit(0).cast("long"), lambda a, x: a + F.size(x.affiliations)).alias("suppliers"))


@query("SELECT source || '/' || (doc_id // 100) AS document_id, count(*)::BIGINT AS failed, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id::VARCHAR) AS pages FROM documents WHERE n_chars < 300 GROUP BY ALL")
def failed_pages(t):
    return documents.page_failures(t("documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string")).alias("document_id"), F.col("doc_id").alias("page"), (F.col("n_chars") >= 300).alias("success")))


@query("SELECT doc_id, source FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def sample_hash(t):
    return profile.sample_rows(t("documents").select("doc_id", "source"), 100, 7, "doc_id")


@query()
def sample_random(t):
    return profile.sample_random(t("documents").select("doc_id"), 100, 7)


@query("""
SELECT coalesce(l.k, n.k) AS k, CASE WHEN l.k IS NULL THEN 'right' WHEN n.k IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT l_linenumber AS k FROM lineitem) l FULL JOIN (SELECT DISTINCT n_regionkey AS k FROM nation) n ON l.k = n.k
""")
def distinct_sets(t):
    return catalog.set_sides(t("lineitem").select(F.col("l_linenumber").cast("int").alias("k")), t("nation").select(F.col("n_regionkey").cast("int").alias("k")), "k")


@query("""
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, length(text) AS n FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT conv_id, seq::BIGINT AS seq, u.n::BIGINT AS asked, a.n::BIGINT AS answered FROM u JOIN a USING (conv_id, seq)
""")
def zip_details(t):
    side = lambda role, name: matching.occurrence(t("conversations").where(F.col("role") == role), ["conv_id"], "turn", "seq").select("conv_id", F.col("seq").cast("long").alias("seq"), F.length("text").cast("long").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "seq"])


@query("""
SELECT event_type, count(*)::BIGINT AS total, count(*) FILTER (WHERE value >= 10)::BIGINT AS succeeded, count(*) FILTER (WHERE NOT coalesce(value >= 10, false))::BIGINT AS failed, avg(value) AS avg_seconds FROM events GROUP BY event_type
""")
def run_summary(t):
    return profile.run_summary(t("events").withColumn("result", F.when(F.col("value") >= 10, F.col("props"))), "result", "value", "event_type")


@query("""
SELECT p_partkey, least(1.0::DOUBLE, 2000.0::DOUBLE / greatest(p_size * 100, p_retailprice), sqrt(3500000.0::DOUBLE / (p_size * 100 * p_retailprice))) AS scale,
       CASE WHEN p_size * p_retailprice * (200 / 72.0::DOUBLE) * (200 / 72.0::DOUBLE) > 50000.0 THEN 200 / 72.0::DOUBLE * sqrt(50000.0::DOUBLE / (p_size * p_retailprice * (200 / 72.0::DOUBLE) * (200 / 72.0::DOUBLE))) ELSE 200 / 72.0::DOUBLE END AS zoom FROM part
""")
def page_geometry(t):
    w, h = F.col("p_size") * 100, F.col("p_retailprice")
    return t("part").select("p_partkey", image_scale(w, h).alias("scale"), render_zoom(F.col("p_size"), h, 200, 50000.0).alias("zoom"))


@query("SELECT lang, CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE n_chars > 1000)::DOUBLE / count(*) ELSE 0 END AS long_share FROM documents GROUP BY lang")
def guarded_ratio(t):
    return t("documents").groupBy("lang").agg(ratio(F.count_if(F.col("n_chars") > 1000), F.count("*")).alias("long_share"))


@query()
def evaluate_entities(t):
    """The whole evaluation: sentences of user turns as authors, of the next answers as predictions.

    Each user turn is a document; one that the user's next turn or the end follows has no prediction.
    """
    from ..schema import EntitySchema, EvalConfig, Rule

    rules = {"name": Rule("fuzzy", True, 0.8), "affiliations": Rule("fuzzy", True, 0.6)}
    config = EvalConfig(EntitySchema({"name": "string", "affiliations": "array[string]"}, "Author"), rules, "name", ("strict", "fuzzy"))
    return evaluation.evaluate(*_sentences(t), config).report()


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[{"a": "say ' || chr(92) || '"hi' || chr(92) || '" now"}, ' || props || ']' WHEN 1 THEN NULL ELSE '[' || props || ']' END AS json, event_id % 4 = 1 AS failed FROM events
""")
def repair_json(t):
    """Event properties as one-element lists, some with stray quotes or cut short, mended."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit('[{"a":"say "hi" now"},'), "props", F.lit("]"))).when(k == 1, F.concat(F.lit("["), "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return t("events").select("event_id", jsonfix.repair(text).alias("r")).select("event_id", "r.json", F.col("r.error").isNotNull().alias("failed"))


@query("SELECT conv_id::VARCHAR AS document_id, turn::INT AS page, true AS success, md5(coalesce(text, '')) AS content, 1 AS attempts FROM conversations")
def model_stage(t):
    """A deterministic stand-in for a model, called with the whole text of every conversation turn."""
    import hashlib

    pages = t("conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text")
    return stages.call_model(pages, lambda row: hashlib.md5((row["text"] or "").encode()).hexdigest(), wait=0.0).select("document_id", "page", "success", "content", "attempts")


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type")
def stream_ingest(t):
    """Events through a file stream that ends when it has caught up, appended once and then summed up."""
    from ..shared import shared_dir
    from ..streaming import ingest

    events = t("events")
    spark = events.sparkSession
    work = shared_dir(spark)
    stream = ingest.drop_folder(spark, t.path("events"), events.schema)
    ingest.append_new(stream, f"{work}/out", f"{work}/state", key="event_id").awaitTermination()
    return ingest.landed(spark, f"{work}/out", events.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT o_orderkey, bool_and(coalesce(l_returnflag, 'N') = 'N') AS missing_all FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def missing_all(t):
    affs = F.when(F.col("l_returnflag") == "N", F.array().cast("array<string>")).otherwise(F.array("l_returnflag"))
    people = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(affs.alias("affiliations"))).alias("authors"))
    works = t("orders").select("o_orderkey").join(people, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return works.select("o_orderkey", profile.missing_all(F.col("authors")).alias("missing_all"))


@query("SELECT event_id, user_id, event_type, greatest((SELECT count(*) FROM events) - 25, 0)::BIGINT AS remaining FROM events ORDER BY event_id LIMIT 25")
def head_of_input(t):
    """The first events, with how many more there are."""
    return profile.preview(t("events").select("event_id", "user_id", "event_type"), 25, "event_id")


@query("""
WITH r AS (SELECT o_custkey % 50 AS link, o_orderpriority AS author, o_orderstatus AS aff, min(o_orderkey) AS p FROM orders GROUP BY ALL),
     a AS (SELECT link, author, min(p) AS p, string_agg(aff, ',' ORDER BY p) AS affs FROM r GROUP BY link, author)
SELECT 'arXiv:' || link AS arxiv_id, string_agg(author || ':' || affs, ';' ORDER BY p) AS people FROM a GROUP BY link
""")
def annotation_documents(t):
    """Orders as annotation rows: link, author, affiliation in first-seen order."""
    from ..operators.predictions import annotations

    rows = t("orders").select(F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(".pdf")).alias("link"), F.lit("T").alias("title"), F.lit("en").alias("title_lang"), F.col("o_orderpriority").alias("author"), F.col("o_orderstatus").alias("affiliation"), F.col("o_orderkey").alias("src_pos"))
    people = F.array_join(F.transform("authors", lambda a: F.concat(a["name"], F.lit(":"), F.array_join(a.affiliations, ","))), ";")
    return annotations(rows).select("arxiv_id", people.alias("people"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'U' || user_id ELSE 'U1,U2' END AS affs, (event_id % 5 <> 0)::INT AS n FROM events
""")
def clean_predictions(t):
    """Answers of several shapes to author lists."""
    from ..operators.predictions import clean_authors

    k = F.col("event_id") % 5
    user = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    text = F.when(k == 0, F.lit('[{"name":""},3]')).when(k == 1, F.concat(F.lit('[{"name":"A","affiliations":"'), user, F.lit('"},"x"]'))).otherwise(F.lit('[{"name":"A","affiliations":["U1","U2"]}]'))
    rows = clean_authors(t("events").select("event_id", F.try_parse_json(text).alias("v")), "v")
    return rows.select("event_id", F.nullif(F.array_join(F.flatten(F.col("authors.affiliations")), ","), F.lit("")).alias("affs"), F.size("authors").alias("n"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'valid' WHEN 2 THEN 'password_protected' WHEN 3 THEN 'zero_pages' ELSE 'corrupted' END AS status FROM pages")
def pdf_classes(t):
    from ..sources.readers import pdf_status

    k = F.col("page_id") % 5
    text = lambda head: F.concat(F.lit(f"%PDF-1.7 {head} "), F.col("url"), F.lit("\n%%EOF"))
    body = F.when(k == 0, text("/Type /Page ")).when(k == 1, F.col("url")).when(k == 2, text("/Encrypt 1 /Type /Page ")).when(k == 3, text("")).otherwise(F.lit("")).cast("binary")
    return t("pages").select("page_id", pdf_status(F.length(body), body).alias("status"))


@query("SELECT o_orderkey, (o_orderkey % 3 <> 0)::INT AS format_reward, CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS answer_reward FROM orders")
def completion_rewards(t):
    """Format and answer rewards of made-up completions for each order."""
    from ..operators.rewards import rewards

    name = F.concat(F.lit("Person "), F.col("o_custkey").cast("string"))
    person = F.struct(name.alias("name"), F.array("o_orderpriority").alias("affiliations"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("</think> "), F.to_json(F.array(person))))
    rows = t("orders").select("o_orderkey", said.alias("said"), F.array(person).alias("want"))
    return rewards(rows, "o_orderkey", "said", "want")


@query(r"SELECT regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1), '\.[^.]*$', '') AS document_id, url AS pdf_path FROM pages")
def input_manifest(t):
    return catalog.input_manifest(t("pages").select("url"), "url")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents f WHERE f.doc_id = d.doc_id AND octet_length(encode(f.text)) > 4096)")
def resume_by_size(t):
    """Documents whose text, taken as a file, is too small to be a whole download."""
    docs = t("documents")
    return catalog.not_downloaded(docs.select("doc_id", "source"), docs.select("doc_id", F.octet_length("text").alias("length")), "doc_id")


@query("SELECT count(source)::BIGINT AS lookups, count(DISTINCT source)::BIGINT AS misses, (count(source) - count(DISTINCT source))::BIGINT AS hits FROM documents")
def normalize_stats(t):
    return profile.normalize_stats(t("documents"), "source")


@query("SELECT doc_id, source, len(text) > 1000 AS cut, substr(text, 1, 1000) AS said, lang AS answer FROM documents")
def training_rows(t):
    rows = t("documents").select("doc_id", "source", "lang", "n_chars", F.col("text").alias("pdf_content"), (F.length("text") > 1000).alias("cut"))
    out = stages.training_rows(rows, "Name the language.", answer="lang", drop=("n_chars",), most_chars=1000)
    return out.select("doc_id", "source", "cut", F.element_at("prompt", 2).content.alias("said"), "answer")


_SENTENCES_SQL = r"""
WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id || ':' || turn AS doc_id, text, answer FROM t WHERE role = 'user' AND next_role = 'assistant'),
s AS (SELECT doc_id, 1 AS g, 0 AS p, unnest(regexp_split_to_array(text, '[.\n]+')) AS x FROM q UNION ALL SELECT doc_id, 0, 1, unnest(regexp_split_to_array(answer, '[.\n]+')) FROM q),
n AS (SELECT doc_id, sum(g) AS g, sum(p) AS p FROM (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(x)), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS y FROM s WHERE trim(x) <> '') GROUP BY doc_id, y)
"""


def _sentences(t):
    """Sentences of user turns as authors, of the next answers as predictions; a turn without an answer has none."""
    parts = F.filter(F.split("text", r"[.\n]+"), lambda s: F.trim(s) != "")
    people = F.transform(parts, lambda s: F.struct(F.trim(s).alias("name"), F.slice(F.split(F.trim(s), " "), 1, 3).alias("affiliations")))
    turns = t("conversations").where("role in ('user', 'assistant')").select("conv_id", "turn", "role", F.to_json(people).alias("said"))
    after = Window.partitionBy("conv_id").orderBy("turn")
    asked = turns.withColumns({"next_role": F.lead("role").over(after), "answer": F.lead("said").over(after)}).where("role = 'user'")
    asked = asked.withColumn("doc_id", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")))
    return asked.select("doc_id", F.parse_json("said").alias("entities")), asked.where("next_role = 'assistant'").select("doc_id", F.parse_json("answer").alias("entities"))


@query(_SENTENCES_SQL + """
SELECT 'entity:author' AS category, 'strict' AS mode, sum(least(g, p))::BIGINT AS tp, sum(p - least(g, p))::BIGINT AS fp, sum(g - least(g, p))::BIGINT AS fn FROM n
""")
def evaluate_strict(t):
    """Every user turn with its answer by equal normalised sentences."""
    from ..schema import EntitySchema, EvalConfig

    report = evaluation.evaluate(*_sentences(t), EvalConfig(EntitySchema({"name": "string"}, "Author"))).report()
    return report.where("category like 'entity:%'").select("category", "mode", "tp", "fp", "fn")


@query(_SENTENCES_SQL + """
, d AS (SELECT doc_id, sum(g - least(g, p)) AS missing, sum(p - least(g, p)) AS extra FROM n GROUP BY doc_id)
SELECT t.conv_id || ':' || t.turn AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'error' ELSE 'success' END AS status, coalesce(missing, 0)::BIGINT AS missing_author, coalesce(extra, 0)::BIGINT AS extra_author, (d.doc_id IS NULL)::INT::BIGINT AS document_error
FROM t LEFT JOIN d ON d.doc_id = t.conv_id || ':' || t.turn WHERE t.role = 'user' AND (d.doc_id IS NULL OR missing > 0 OR extra > 0)
""")
def error_details(t):
    """Errors of every user turn that its answer doesn't repeat, counted by kind from the exported rows."""
    from ..schema import EntitySchema, EvalConfig
    from . import export

    e = evaluation.evaluate(*_sentences(t), EvalConfig(EntitySchema({"name": "string"}, "Author")))
    kinds = ("missing_author", "extra_author", "document_error")
    return export.error_details(export.document_results(e)).groupBy("doc_id", "status").agg(*(F.count_if(F.col("issue_type") == k).alias(k) for k in kinds))
