"""Helpers shared by the operators: word hashing over Arrow buffers, blob rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graphs import components  # noqa: F401
from ..shared import drop_tables, table  # noqa: F401

_U = np.uint64
BLOCK_BYTES = 1 << 20
#: First value and odd multiplier of each of two independent hashes.
HASH_SEEDS = ((0x9AE16A3B2F90404F, 0xD6E8FEB86659FD93), (0xC3A5C85C97CB3127, 0xA0761D6478BD642F))
#: Spans of more bytes than that are hashed one by one.
LONG_SPAN = 64
_powers: dict[str, np.ndarray] = {}

#: The white space that separates words: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, at least n of each. For sums that are compared exactly afterwards."""
    if len(_powers.get("p", ())) < n:
        n, base = max(n, BLOCK_BYTES + 1), HASH_SEEDS[0][1]
        for key, factor in (("p", base), ("i", pow(base, -1, 2**64))):
            a = np.full(n, factor, dtype=_U)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends), by one of two independent functions.

    Each eight bytes are mixed into what stands before them, so no arrangement of letters cancels
    out; spans of more than LONG_SPAN bytes get a BLAKE2b digest.
    """
    first, factor = (_U(x) for x in HASH_SEEDS[which])
    size = ends - starts
    out = mix(size.astype(_U) * factor + first)
    if not len(size):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    masks = (_U(1) << (np.arange(8, dtype=_U) * _U(8))) - _U(1)
    masks = np.r_[masks, ~_U(0)]
    todo = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(todo):
        some = eight[starts[todo] + at] & masks[np.minimum(size[todo] - at, 8)]
        out[todo] = mix((out[todo] ^ some) * factor + first)
        at += 8
        todo = todo[size[todo] > at]
    key = bytes([which])
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: none), one after the other, and where each begins, with the end."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the words of all texts in order, and the number of the first word of each text, with the end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~space[buf]
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[off] = True
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1] | cut[1:-1]
    tail[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, off)


def slices(off: np.ndarray, most: int = 2 * BLOCK_BYTES):
    """Runs of whole texts of about that many bytes; a longer text is alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b
        a = b


def partition_count(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Shuffle partitions: the session's number, or more if the planned input is large for it."""
    spark = df.sparkSession
    # what the plan reads: estimates of joins are products
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a source without an estimate has one that no table reaches
    estimate = sum(size for size in sizes if size < 2**60) // bytes_each
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(estimate))


def part_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The partition of integer ids; part_column is the same in SQL."""
    ids = ids.astype(np.int64)
    return np.mod(ids ^ (ids >> 17) ^ (ids >> 31), n).astype(np.int32)


def part_column(column: str, n: int):
    c = F.col(column).cast("long")
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 17)).bitwiseXOR(F.shiftright(c, 31)), F.lit(n)).cast("int")


#: Blocks that a filter of ids has at most, and words of 64 bits in each: 8 MB.
FILTER_BLOCKS, BLOCK_WORDS = 1 << 12, 1 << 8


def _filter_place(column: str):
    """The block of an id, its word there and its bit in that."""
    h, part = F.xxhash64(F.col(column).cast("long")), lambda x, n: (x % F.lit(n).cast("long"))
    block = part(F.shiftrightunsigned(h, 20), FILTER_BLOCKS)
    word = part(F.shiftrightunsigned(h, 6), BLOCK_WORDS).cast("int")
    return block, word, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashed ids, (_block, _bits): of one size at most, however many ids there are."""
    block, word, bit = _filter_place(column)
    words = ids.select(block.alias("_block"), word.alias("_word"), bit.alias("_bits")).groupBy("_block", "_word").agg(F.bit_or("_bits").alias("_bits"))

    def fill(batches):
        batches = list(batches)
        if batches:
            block, word, bits = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(3))
            blocks, row = np.unique(block, return_inverse=True)
            out = np.zeros((len(blocks), BLOCK_WORDS), np.int64)
            out[row, word] = bits
            cuts = pa.array(np.arange(len(blocks) + 1) * BLOCK_WORDS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(out.reshape(-1)))], names=["_block", "_bits"])

    return words.repartition("_block").mapInArrow(fill, "_block long, _bits array<long>")


def by_filter(df: DataFrame, column: str, bitmap: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose id an id_filter may have, all of those that were put in among them; or the rows whose id surely isn't in it.

    The bitmap is broadcast, so rows stay where they are. Of the ids that weren't put in, about as many
    in a hundred are taken for known as there are bits set; with far more ids than bits nearly all are.
    """
    block, word, bit = _filter_place(column)
    some = F.broadcast(bitmap.select("_block", "_bits"))
    return df.join(some, (block == some["_block"]) & (bit.bitwiseAND(F.get(some["_bits"], word)) != 0), "left_semi" if known else "left_anti")


def by_key(key: np.ndarray, *columns: np.ndarray):
    """Yields (key, columns of it) for each distinct key; rows of a key keep their order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(key[a]), [c[order[a:b]] for c in columns]
