"""Packing of tokenised documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partition_count, table
from .tokens import encoder, text_slices

DIMS, BITS = 4, 15
#: Sequences that a range partition fills at least, if there are several partitions.
SEQUENCES = 64
_U = np.uint64


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows, dims), each coordinate of that many bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the curve's reflections and exchanges, level by level
        low = level - 1
        for i in range(dims):
            flip = (x[i] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        carry ^= np.where(x[-1] & level, level - 1, 0)
        level >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hilbert key of each text from the hashes of its pieces: a hashed count vector, projected at random."""
    n = np.diff(first)
    bytes_ = mix(hashes).view(np.uint8).reshape(-1, 8)[:, :DIMS].astype(np.float32) - 127.5
    run = np.zeros((len(hashes) + 1, DIMS))
    np.cumsum(bytes_, axis=0, dtype=np.float64, out=run[1:])
    mean = (run[first[1:]] - run[first[:-1]]) / (74.0 * np.sqrt(np.maximum(n, 1)))[:, None]
    unit = 0.5 + np.arctan(mean / 2) / np.pi
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs the ids of every whole text, each followed by end_id, into sequences of `length` ids.

    Returns a row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, ids (little-endian 16-bit). A document's leading full sequences are its own;
    what is left of it is laid behind its neighbours along the curve and cut where a sequence is
    full, so only the last sequence of each range partition is short. There are as many partitions
    as the ids left over fill SEQUENCES sequences each, up to the session's number or, for large
    inputs, that of their blocks; so under one per cent is padding, but for a single short sequence.

    Null and empty texts are the single end_id. Texts of any length are encoded whole. Rows with a
    null id and repeated rows are packed like any other; an empty table gives no pieces. Equal curve
    keys are ordered by id and by place, so that many copies spread over partitions, even of one row. Other columns, whatever
    their names, aren't used. The ids left over are kept in a table in the shared folder, since the
    range sort reads its input twice.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def tokenize(batches):
        tool = encoder(tokenizer_path)
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                ids, off, hashes, first = tool.encode(texts, end_id)
                keys = curve_keys(hashes, first)
                crcs, bodies, tails = [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    full = (b - a) // length * length
                    crcs.append([_crc(ids[x : x + length]) for x in range(a, a + full, length)])
                    bodies.append(ids[a : a + full].astype("<u2").tobytes() if with_ids else None)
                    tails.append(ids[a + full : b].astype("<u2").tobytes())
                columns = [batch.column("id").slice(at, len(texts)), pa.array(np.diff(off), pa.int64()), pa.array(keys, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(bodies, pa.binary()), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "doc_tokens", "key", "crcs", "body", "tail"])

    def pack(batches):
        from pyspark import TaskContext

        sequence, fill = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = []
            for doc, tokens, tail in zip(*(batch.column(c).to_pylist() for c in ("id", "doc_tokens", "tail")), strict=True):
                ids = np.frombuffer(tail, "<u2")
                start, a = tokens - len(ids), 0
                while a < len(ids):
                    take = min(length - fill, len(ids) - a)
                    piece = ids[a : a + take]
                    rows.append((doc, start + a, take, _crc(piece), tokens, 2 * sequence, fill, piece.tobytes() if with_ids else None))
                    a, fill = a + take, fill + take
                    if fill == length:
                        sequence, fill = sequence + 1, 0
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = table(docs.mapInArrow(tokenize, "id long, doc_tokens long, key long, crcs array<long>, body binary, tail binary"))
    # rows that are equal in all else are told apart by their place in the table that was written
    rest = kept.select("id", "doc_tokens", "key", "tail", F.monotonically_increasing_id().alias("place")).where(F.length("tail") > 0)
    left = rest.agg(F.sum(F.length("tail") / 2)).first()[0] or 0
    parts = max(1, min(partition_count(df), int(left) // (SEQUENCES * length)))
    rest = rest.repartitionByRange(parts, "key", "id", "place").sortWithinPartitions("key", "id", "place")
    tails = rest.mapInArrow(pack, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    full = kept.select("id", "doc_tokens", "body", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "id", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.expr(f"substring(body, k * {2 * length} + 1, {2 * length})").alias("ids"),
    )
    out = full.unionByName(tails).withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")
