"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import toxicity as tox
from folium.llm.common import table
from folium.llm.line_dedup import remove_shared_lines
from folium.llm.minhash_dedup import near_documents
from folium.llm.mixing import mix_sources
from folium.llm.packing import pack_documents
from folium.llm.queries import tokenizer_path
from folium.operators.catalog import best_per
from folium.shared import drop_tables, scope


#: Target shares of tokens by language; sources and topics are flattened to the power MIX_TEMPERATURE.
MIX_TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}
MIX_TEMPERATURE = 0.7
#: Share of all tokens that mixing keeps.
MIX_KEEP = 0.7


def _aside(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """The table with other names for columns that an operator adds, and the columns that give it its own names back."""
    name = {}
    for c in docs.columns:
        other = c
        while other in added or (other != c and other in docs.columns):
            other += "_"
        name[c] = other
    return docs.withColumnsRenamed(name), [F.col(f"`{name[c]}`").alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.7 or more, by a model of all labelled ids outside the held-out third.

    Null and empty texts stay, texts of any length are scored whole, and rows that repeat, or have
    no id, are judged each by their own text; a score of just 0.7 goes. An empty table stays empty.
    Further columns are passed on.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = tox.fit(tox.training_sample(docs, labels, "doc_id", "text", "toxic"))
    return tox.drop_toxic(docs, model, threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that ten or more sources share out of the texts; n_chars is counted anew.

    No row goes: a null text stays null, with a null n_chars, and a text may become empty. A null
    source is no source. Equal rows get equal texts. Further columns are passed on, whatever their
    names.
    """
    own, back = _aside(docs, ("_n_lines", "_n_removed"))
    out = remove_shared_lines(own, min_sites=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (similarity of 0.8 or more), as one row.

    Of rows with one id the longest text stays, of equal lengths the first in the order of the
    columns. A row without an id gets one made of its columns, from 2^62 on, so that its copies go
    too. Texts that are null or without words are near nothing and stay, once for each id. Long
    texts are compared whole. Further columns are passed on, whatever their names.
    """
    made = F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})), 2) + F.lit(2**62)
    # the row travels as one struct, so that none of its columns can clash with those added
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), made).alias("_id"), F.col("text").alias("_text"), F.struct(*docs.columns).alias("row"))
    near = near_documents(rows, "_id", "_text", percent=80).where("kept")
    # rows without words are kept beside others with their id, which may be copies
    kept = near.groupBy("_id").agg(F.count("*").alias("_c"), F.max(F.col("n_shingles") > 0).alias("_words"))
    stay = rows.join(kept, "_id").where(F.coalesce(F.col("_text").rlike(r"[^\t-\r ]"), F.lit(False)) == F.col("_words"))
    first = best_per(stay.where("_c > 1"), "_id", F.desc(F.length("_text")), *(F.col(f"row.`{c}`") for c in docs.columns))
    return stay.where("_c = 1").select("row").unionByName(first.select("row")).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens have the languages' target shares, and sources and topics are evener than they are.

    Null sources and languages are values of their own; a null text is one token. Rows that repeat
    are sampled alike. Further columns are passed on, whatever their names.
    """
    own, back = _aside(docs, ("_topic", "_tokens", "_probability", "_sampled"))
    return mix_sources(own, targets=MIX_TARGETS, temperature=MIX_TEMPERATURE, keep=MIX_KEEP).where("_sampled").select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens.

    Null and empty texts are a single end token; long texts take several sequences. Rows with a null
    id, and rows that repeat, are packed like others. No documents give no pieces.
    """
    return pack_documents(docs, tokenizer_path(), length=1024, end_id=0)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the learned scores nor the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again by the next.

    A stage's table is deleted once the next one is there, as is all that the stage itself has
    written, but for the last one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        before = docs
        with scope() as own:
            docs = own.keep(table(stage(spark, docs, sf_dir)))
        drop_tables(before)
