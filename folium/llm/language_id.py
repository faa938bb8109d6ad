"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

_GAP = re.compile(r"[\W\d_]+")
PIECE = 8192
#: Lower levels look for too few short matches in the dictionaries.
LEVEL = 6
#: A sample document gives at most this much of its middle to a dictionary.
SHARE = 2048
DICTIONARY_BYTES = 112 << 10
#: A shorter dictionary is filled up with blanks.
LEAST_BYTES = 16


def letters(text: str | None) -> bytes:
    """Lower-case letters with single spaces for all else; signs that are neither letters nor digits by their class, as fractions are, count as else."""
    t = _GAP.sub(" ", (text or "").lower())
    if not t.isascii():
        odd = {c for c in set(t) if c != " " and not c.isalpha() and not unicodedata.combining(c)}
        if odd:
            t = " ".join("".join(" " if c in odd else c for c in t).split())
    return t.strip().encode("utf-8", "surrogatepass") if any(map(str.isalpha, t)) else b""


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 120, most_docs: int = 24_000) -> dict[str, bytes]:
    """Raw-content dictionaries of every language, from at most docs_per_lang different texts of each.

    Documents whose crc32(id as text) mod 3 is 1 are held out. The others are taken in the order of
    a hash; equal texts count once, under whatever ids, and each task passes on no more of a
    language than are needed. Very many languages get fewer documents each, so that all together
    are at most most_docs, or one a language. Only the middle SHARE bytes of letters of a sample
    document are used; if those of a language exceed DICTIONARY_BYTES, the longest are cut alike.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null and lang is not null and text is not null").where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    named = rows.withColumn("t", F.xxhash64("text"))
    once = named.groupBy("lang", "t").agg(F.min(F.xxhash64("id")).alias("h"))
    once = table(once)
    langs = once.select("lang").distinct().count()
    each = max(1, min(docs_per_lang, most_docs // max(1, langs)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    some = once.withColumn("r", rank).where(F.col("r") <= each).select("lang", "t")  # at most each * langs rows

    def middle(batches):
        for batch in batches:
            cut = []
            for t in batch.column("text").to_pylist():
                t = letters(t)
                a = max(0, (len(t) - SHARE) // 2)
                cut.append(t[a : a + SHARE])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("t"), pa.array(cut, pa.binary())], names=["lang", "t", "piece"])

    # copies of a sample text become one before anything is collected
    sampled = F.broadcast(some) if langs <= most_docs else some  # a broadcast side has at most most_docs rows
    got = named.join(sampled, ["lang", "t"]).select("lang", "t", "text").mapInArrow(middle, "lang string, t long, piece binary").groupBy("lang", "t").agg(F.max("piece").alias("piece")).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["t"])):
        out.setdefault(r["lang"], []).append(bytes(r["piece"]))
    return {k: _filled(v) for k, v in out.items()}


def _filled(pieces: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """The pieces one after the other; the longest are cut to a common length if they don't all fit."""
    left, each = most, 0
    for k, size in enumerate(sorted(len(p) + 1 for p in pieces)):
        each = left // (len(pieces) - k)
        if size > each:
            break
        each, left = size, left - size
    return b"".join(p[: each - 1] + b" " for p in pieces)


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = 0.01, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """Predicts the language of every whole text: the dictionary with which it compresses best.

    Returns id_col, held_out, lang_pred, score, margin, rejected. A text is compressed in pieces of
    8 KB, all of them, with each language's dictionary, and the sizes are added. score is a soft
    minimum of the sizes; margin is how much smaller the best total is than the next, as a share;
    rejected says that it is under `margin`, so that a caller may discard the answer. Null texts
    and those without a letter, or with nothing learned, get `und`, score 0 and are rejected. Ties
    go to the first language in order. Texts of any length are compressed whole. Repeated rows are
    answered each; a null id is not held out; an empty table gives an empty result; other columns,
    whatever their names, aren't used. The dictionaries are those of fit().
    """
    if dictionaries is None:
        dictionaries = fit(df, id_col, text_col, lang_col)
    names, raw = list(dictionaries), list(dictionaries.values())

    def run(batches):
        import zstandard as z

        def compressor(content: bytes):
            if len(content) < LEAST_BYTES:  # the library takes no shorter dictionary
                content = content.ljust(LEAST_BYTES)
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        tools = [compressor(x) for x in raw]
        for batch in batches:
            best, score, gap = [], [], []
            for text in batch.column("text").to_pylist():
                t = letters(text)
                if not t or not tools:
                    best.append("und")
                    score.append(0.0)
                    gap.append(0.0)
                    continue
                size = np.zeros(len(tools))
                for a in range(0, len(t), PIECE):
                    piece = t[a : a + PIECE]
                    for i, c in enumerate(tools):
                        size[i] += len(c.compress(piece)) - 8
                size = np.maximum(size, 1.0)
                i = int(size.argmin())
                rest = np.delete(size, i)
                gap.append(float((rest.min() - size[i]) / rest.min()) if len(rest) else 1.0)
                # each per cent of the text's bytes saved doubles the odds about six times
                p = np.exp(-40.0 * (size - size[i]) / max(len(t), 16))
                best.append(names[i])
                score.append(float(p[i] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64())], names=["id", "lang_pred", "score", "margin"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = docs.mapInArrow(run, "id long, lang_pred string, score double, margin double")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "margin", (F.col("margin") < margin).alias("rejected"))
