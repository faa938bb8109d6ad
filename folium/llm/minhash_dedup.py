"""Near-duplicate documents by one-permutation hashing with optimal densification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, partition_count, slices, span_hashes, table, text_buffer, word_spans

_U = np.uint64
ROWS, BANDS = 6, 32
BINS = ROWS * BANDS
#: Shingles, and documents on either side, of a block that is compared at once.
BLOCK_SHINGLES, BLOCK_DOCS, BLOCK_LESS = 1_000_000, 1024, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For each bin the places of all bins in its order of donors.
_RANK = np.random.default_rng(1234567).permuted(np.tile(np.arange(BINS, dtype=np.uint8), (BINS, 1)), axis=1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, in order, and where each text's begin, with the end."""
    buf = _LOWER[buf]
    starts, ends, first = word_spans(buf, off)
    words = span_hashes(buf, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(first[1:][doc] - np.arange(len(words)) >= size)
    h = np.zeros(len(at), dtype=_U)
    for j in range(size):
        h = h * _U(0xD1342543DE82EF95) + words[at + j]
    h = mix(h)
    short = np.flatnonzero((count > 0) & (count < size))
    number = np.maximum(count - size + 1, 0)
    number[short] = 1
    start = np.r_[0, np.cumsum(number)]
    out = np.empty(int(start[-1]), dtype=_U)
    long = np.ones(len(out), dtype=bool)
    if len(short):
        whole = np.zeros(len(short), dtype=_U)
        for j in range(size - 1):
            has = count[short] > j
            whole[has] = whole[has] * _U(0xD1342543DE82EF95) + words[first[short[has]] + j]
        out[start[short]] = mix(whole ^ mix(count[short].astype(_U)))
        long[start[short]] = False
    out[long] = h
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[start[:-1][number > 0]] = True
    return out[fresh], np.r_[0, np.cumsum(fresh)][start]


def one_permutation(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum of each bin for each set (ordered hashes; no set is empty).

    An empty bin copies a full one: of its own fixed random order of all bins, the first that is full.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    # hashes are in order, so those of a bin are next to each other
    cell = owner * BINS + (((h >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    out = np.zeros(n * BINS, dtype=_U)
    full = np.zeros(n * BINS, dtype=bool)
    out[cell[head]] = np.minimum.reduceat(mix(h ^ _U(0x243F6A8885A308D3)), head) if len(head) else out[:0]
    full[cell[head]] = True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    for i in np.flatnonzero(~full.all(axis=1)):
        empty, able = np.flatnonzero(~full[i]), np.flatnonzero(full[i])
        out[i, empty] = out[i, able[_RANK[empty][:, able].argmin(axis=1)]]
    return out


def band_keys(signatures: np.ndarray, salt: int) -> np.ndarray:
    key = np.full((len(signatures), BANDS), salt, dtype=_U) + np.arange(BANDS, dtype=_U)
    for r in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) ^ signatures[:, r::ROWS])
    return key


def _signed(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The band keys of each set; none of an empty one."""
    some = np.flatnonzero(np.diff(first))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(first) - 1)
    if len(some):
        for i, row in zip(some.tolist(), band_keys(one_permutation(h, first[np.r_[some, len(first) - 1]]), 97).view(np.int64), strict=True):
            out[i] = row
    return out


def _enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    both = both.astype(np.int64)
    return (both > 0) & (100 * both >= percent * (a + b - both))


def near_centres(h: np.ndarray, first: np.ndarray, member: np.ndarray, centre: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets, a member and the centre of its star each, are near. Time and memory follow the members' sizes."""
    size = np.diff(first)
    tag = mix(np.arange(len(size)).astype(_U) + _U(0x1F123BB5))
    heads = np.unique(centre)
    within = lambda some: np.repeat(first[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    known = np.sort(mix(h[within(heads)] ^ np.repeat(tag[heads], size[heads])))
    out = np.zeros(len(member), dtype=bool)
    # so many pairs at once that their shingles fit a block
    run = np.cumsum(size[member])
    a = 0
    while a < len(member):
        b = max(a + 1, int(np.searchsorted(run, (run[a - 1] if a else 0) + BLOCK_SHINGLES, "right")))
        some, of = member[a:b], centre[a:b]
        asked = mix(h[within(some)] ^ np.repeat(tag[of], size[some]))
        hit = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        both = np.r_[0, np.cumsum(hit)][np.r_[0, np.cumsum(size[some])]]
        out[a:b] = _enough(np.diff(both), size[some], size[of], percent)
        a = b
    return out


def near_cross(h: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of the left are near which of the right. Counted over shingles that both sides have."""
    size = np.diff(first)
    which, number = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    side = np.zeros((2, len(size)), dtype=np.int64)
    side[0, left], side[1, right] = np.arange(1, len(left) + 1), np.arange(1, len(right) + 1)
    rows = [side[k][owner] for k in (0, 1)]
    seen = [np.bincount(number[r > 0], minlength=len(which)) > 0 for r in rows]
    columns = np.cumsum(seen[0] & seen[1]) - 1
    used = (seen[0] & seen[1])[number]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    at, wide = columns[number], int(columns[-1]) + 1 if len(columns) else 0
    for a in range(0, wide, 4096):
        some = np.flatnonzero(used & (at >= a) & (at < a + 4096))
        part = []
        for r, n in zip(rows, (len(left), len(right)), strict=True):
            m = np.zeros((n, min(4096, wide - a)), dtype=np.float32)
            own = some[r[some] > 0]
            m[r[own] - 1, at[own] - a] = 1
            part.append(m)
        common += part[0] @ part[1].T
    return _enough(common, size[left][:, None], size[right][None, :], percent)


def near_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, shingle: int = 5) -> DataFrame:
    """Links documents whose shingle sets have 100 * intersection >= percent * union (percent >= 80).

    Returns a row per input row: id_col, n_shingles, component_id (smallest id reachable), kept.
    Text is lower-cased in A to Z only; words are separated by 0x20 and 0x09 to 0x0D; a text of
    fewer words is one shingle, and one without words or null has none and is linked with nothing.
    Long texts are taken whole: one that exceeds a block is a block by itself.

    Equal sets are one. Sets of all sizes have one-permutation signatures of BINS bins with optimal
    densification, banded; of pairs just at 0.85 all 4,400 tried shared a bucket, at 0.8 all but 2
    of 4,800. Each bucket adds a star of edges from its smallest document, so candidates follow the
    number of documents, whatever a bucket's size; buckets with the same sets count once. Stars are
    confirmed on full sets. Buckets that the confirmed links join are settled, however large. In the
    others each document outside the bucket's largest component so far is compared with the whole
    bucket, in blocks of bounded size, so no link between sets that share a bucket is lost.

    Rows with a null id are linked with nothing and kept, with a null component. Rows that repeat an
    id are one document with several sets; it is linked through each of them. Ties go to the
    smallest id. An empty table gives an empty result. Other columns of df, whatever their names,
    aren't used.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is 80 to 100: below, pairs may share no bucket")
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))

    def sign(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for a, b in slices(off):
                h, first = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
                run = np.zeros((2, len(h) + 1), dtype=_U)
                np.cumsum(mix(h), out=run[0, 1:])
                np.cumsum(mix(h ^ _U(0x452821E638D01377)), out=run[1, 1:])
                sums = (run[:, first[1:]] - run[:, first[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("doc", "t")] + [pa.array(np.diff(first), pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(_signed(h, first), pa.list_(pa.int64()))], names=["doc", "t", "n", "d1", "d2", "keys"])

    signed = table(docs.select("doc", "t", "text").mapInArrow(sign, "doc long, t long, n long, d1 long, d2 long, keys array<long>"))
    able = signed.where("n > 0 and doc is not null")
    # a set goes by one text of its smallest document; equal sets have equal keys
    sets = table(able.groupBy("d1", "d2").agg(F.min("doc").alias("doc"), F.min_by("t", "doc").alias("t"), F.max("n").alias("n"), F.first("keys").alias("keys")))
    entries = sets.select("doc", "t", "n", F.explode("keys").alias("key"))
    digest = [F.bit_xor(F.xxhash64(*order)).alias(c) for c, order in (("x1", ("doc", "t")), ("x2", ("t", "doc")))]
    buckets = entries.groupBy("key").agg(F.min("doc").alias("centre"), F.min_by("t", "doc").alias("centre_t"), F.count("*").alias("c"), *digest).where("c > 1")
    buckets = buckets.groupBy("centre", "c", "x1", "x2").agg(F.min("key").alias("key"), F.min_by("centre_t", "key").alias("centre_t"))
    # sides that grow with the input are merged at every size, never broadcast
    shared = table(entries.join(buckets.select("key", "centre", "centre_t", "c").hint("merge"), "key"))
    star = shared.where("doc <> centre").select("doc", "t", "n", "centre", "centre_t").distinct()

    star = table(star)

    # a bin has some members with all their stars, and each set that it needs once, whatever stars name it
    size = star.agg(F.sum("n"), F.count("*")).first()
    bins = 4 * partition_count(df)
    count = max(bins, (size[0] or 0) // BLOCK_SHINGLES + 1, (size[1] or 0) // (BANDS * BLOCK_DOCS) + 1)
    star = star.withColumn("bin", F.pmod(F.xxhash64("doc", "t"), F.lit(count)))
    need = star.select("bin", "doc", "t").unionByName(star.select("bin", F.col("centre").alias("doc"), F.col("centre_t").alias("t"))).distinct()
    need = table(need)
    named = docs.where("doc is not null and text is not null")
    # one text of rows that repeat; kept for the second comparison
    texts = table(named.join(need.select("doc", "t").distinct().hint("merge"), ["doc", "t"]).groupBy("doc", "t").agg(F.first("text").alias("text")))

    def confirm(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        place = {k: i for i, k in enumerate(zip(right.column("doc").to_pylist(), right.column("t").to_pylist(), strict=True))}
        buf, off = text_buffer(right.column("text"))
        doc, centre = left.column("doc").to_numpy(), left.column("centre").to_numpy()
        member = np.array([place[k] for k in zip(doc.tolist(), left.column("t").to_pylist(), strict=True)])
        head = np.array([place[k] for k in zip(centre.tolist(), left.column("centre_t").to_pylist(), strict=True)])
        near = near_centres(*shingle_sets(buf, off, shingle), member, head, percent)
        return pa.table([pa.array(doc[near], pa.int64()), pa.array(centre[near], pa.int64())], names=["a", "b"])

    confirmed = star.groupBy("bin").cogroup(need.join(texts.hint("merge"), ["doc", "t"]).groupBy("bin")).applyInArrow(confirm, "a long, b long")
    # an id with several sets, each of which may go by another document's id
    several = able.groupBy("doc").agg(F.min("d1").alias("lo1"), F.max("d1").alias("hi1"), F.min("d2").alias("lo2"), F.max("d2").alias("hi2")).where("lo1 <> hi1 or lo2 <> hi2").select("doc")
    several = table(several)
    if not several.isEmpty():
        ties = able.join(several, "doc", "left_semi").select(F.col("doc").alias("a"), "d1", "d2").join(sets.select("d1", "d2", F.col("doc").alias("b")), ["d1", "d2"]).select("a", "b")
        confirmed = confirmed.unionByName(ties)
    first_links = components(confirmed)
    first_links = first_links.select(F.col("v").alias("doc"), F.col("component").alias("part"))

    # buckets of three and more that hold several components still
    parts = shared.where("c > 2").join(first_links, "doc", "left").withColumn("part", F.coalesce("part", "doc")).select("key", "doc", "t", "n", "part")
    counted = parts.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    open_ = counted.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("largest"), F.count("*").alias("parts"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.max(F.struct("c", "part", "n")).alias("most")).where("parts > 1")
    blocks = lambda n, docs_, each: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK_SHINGLES, docs_ / each))).cast("int")
    open_ = open_.select("key", "largest", blocks(F.col("n") - F.col("most.n"), F.col("c") - F.col("most.c"), BLOCK_LESS).alias("gi"), blocks(F.col("n"), F.col("c"), BLOCK_DOCS).alias("gj"), "n")
    open_ = table(open_)
    if open_.isEmpty():
        return _answer(signed, sets, first_links.withColumnRenamed("part", "component"), id_col)
    rows = parts.join(open_.drop("n"), "key").withColumn("less", F.col("part") != F.col("largest"))
    deal = lambda salt, g: F.pmod(F.xxhash64("doc", "t", F.lit(salt)), F.col(g)).cast("int")
    less = rows.where("less").withColumn("i", deal(1, "gi")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("gj") - 1))).withColumn("left", F.lit(True))
    full = rows.withColumn("j", deal(2, "gj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("gi") - 1))).withColumn("left", F.lit(False))
    tiles = less.unionByName(full).select("key", "i", "j", "doc", "t", "part", "left")

    def compare(rows: pa.Table) -> pa.Table:
        keys = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        _, of = np.unique(keys, axis=0, return_inverse=True)
        order = np.argsort(of.reshape(-1), kind="stable")
        cuts = np.flatnonzero(np.diff(of.reshape(-1)[order])) + 1
        found = [np.zeros((0, 2), np.int64)]
        for some in np.split(order, cuts):
            tile = rows.take(pa.array(some))
            part, left = tile.column("part").to_numpy(), tile.column("left").to_numpy()
            buf, off = text_buffer(tile.column("text"))
            i, j = np.flatnonzero(left), np.flatnonzero(~left)
            if len(i) and len(j):
                x, y = np.nonzero(near_cross(*shingle_sets(buf, off, shingle), i, j, percent))
                pairs = np.stack([part[i[x]], part[j[y]]], axis=1)
                found.append(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
        links = np.concatenate(found)
        return pa.table([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], names=["a", "b"])

    whole = open_.agg(F.sum(F.col("n") * (F.col("gi") + F.col("gj")))).first()[0] or 0
    dealt = tiles.join(texts, ["doc", "t"]).withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(bins, whole // BLOCK_SHINGLES + 1))))
    later = components(dealt.groupBy("bin").applyInArrow(compare, "a long, b long"))

    final = first_links.join(later.select(F.col("v").alias("part"), "component"), "part", "full").select(F.coalesce("doc", "part").alias("doc"), F.coalesce("component", "part").alias("component"))
    return _answer(signed, sets, final, id_col)


def _answer(signed: DataFrame, sets: DataFrame, final: DataFrame, id_col: str) -> DataFrame:
    """A row for each row, by the component of the document that its set goes by."""
    found = sets.join(final, "doc", "left").select("d1", "d2", F.coalesce("component", "doc").alias("component_id"))
    # a document with several sets has them all in one component
    out = signed.drop("keys", "t").join(found, ["d1", "d2"], "left")
    own = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc") == own, F.lit(True)).alias("kept"))
