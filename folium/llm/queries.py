"""Queries that apply the training-data operators to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .centroids import cluster_vectors
from .chat_format import collapse_conversations
from .embedding_dedup import near_vectors
from .graph_search import nearest
from .language_id import identify_language
from .line_dedup import remove_shared_lines
from .lm_score import score_texts
from .minhash_dedup import near_documents
from .mixing import mix_sources
from .packing import pack_documents
from .prefix_trie import prefix_trie, spliced
from .substring_dedup import dedup_substrings
from .toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_read(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_read(spark, sf_dir, "documents"), percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_shared_lines(_read(spark, sf_dir, "documents"), min_sites=10)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), length=1024, end_id=0)


#: Target shares of tokens; sources are flattened to the power 0.7, and half of all tokens are kept.
MIX_TARGETS = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": {f"t{k}": 0.125 for k in range(8)}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_read(spark, sf_dir, "documents"), targets=MIX_TARGETS, temperature=0.7, keep=0.5)
    return out.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_tokens"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_conversations(_read(spark, sf_dir, "conversations"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_read(spark, sf_dir, "conversations"), rebuild=spliced)


#: Strength of smoothing of two-word sequences.
LM_STRENGTH = (100.0,)


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_texts(_read(spark, sf_dir, "documents"), learn, order=2, strength=LM_STRENGTH)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings"), k=16, rounds=3)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lm_score": op12_lm_score,
    "op13_centroids": op13_centroids,
}

#: Where SQL can express the query.
ORACLES = {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT doc_id, p, list_slice(words, p, p + 12) AS gram FROM d, unnest(generate_series(1, len(words) - 12)) AS t(p)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY gram) AS first FROM w) WHERE doc_id > first
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM late, unnest(generate_series(0, 12)) AS t(k)
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []::BIGINT[]), i::BIGINT)) AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list('<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, r, x) AS l FROM t GROUP BY conv_id
), kept AS (
  SELECT a.conv_id, a.l FROM c a WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE list_slice(b.l, 1, len(a.l)) = a.l AND (len(b.l) > len(a.l) OR b.conv_id < a.conv_id))
)
SELECT k.conv_id, len(k.l)::BIGINT AS n_turns,
       (SELECT count(*) - 1 FROM c b WHERE list_slice(k.l, 1, len(b.l)) = b.l)::BIGINT AS n_prefixes,
       array_to_string(k.l, '') AS rendered
FROM kept k
""",
    "op5_line_dedup": r"""
WITH d AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents
), e AS (
  SELECT doc_id, source, trim(unnest(l), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM d
), b AS (
  SELECT line FROM e WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), s AS (
  SELECT list(line) AS bad FROM b
), k AS (
  SELECT doc_id, l, list_filter(l, lambda x: NOT coalesce(list_contains(bad, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), false)) AS kept FROM d, s
)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept), 0)::BIGINT AS n_removed, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k
""",
    "op3_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON len(a.e) = len(b.e) WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (
  SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
    "op4_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), u AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM d
), q AS (
  SELECT doc_id, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT DISTINCT doc_id, concat_ws(' ', x, x1, x2, x3, x4) AS x FROM q WHERE x4 IS NOT NULL
  UNION ALL SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), g AS (
  SELECT doc_id, count(s.x) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x WHERE a.doc_id < b.doc_id GROUP BY ALL
), near AS (
  SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE 100 * c >= 85 * (ga.n + gb.n - c)
), l AS (
  SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), r(a, b) AS (
  SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM g LEFT JOIN c ON c.a = doc_id
""",
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op13_centroids": oracles.centroids(),
}
