"""Near-duplicate vectors by spherical-cap filters of structured random product codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partition_count, table
from .vectors import distinct, marked, matrix

#: Independent product codes, expected filters of a vector in each, and vectors expected in a filter.
CODES, LIST, LOAD = 5, 12, 32
#: Vectors that one task compares with each other; larger groups are dealt out in pairs of such blocks.
TILE = 2048
SEED = 90210
#: Vectors are padded to a power of two, this at least, so that directions are made of halves in few dimensions too.
LEAST_DIMS = 32
#: Scores that are held at once.
BLOCK_SCORES = 1 << 21


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    rows, dims = x.shape
    step = 1
    while step < dims:
        pairs = x.reshape(rows, dims // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, dims)
        step *= 2
    return x / np.sqrt(dims)


class ProductCode:
    """Random unit directions made of one of m parts for each half of the rotated space.

    The rotation is three rounds of random sign flips and a Hadamard transform. The threshold lets a
    vector exceed LIST of the m * m directions on average, but a cap is never narrower than the
    angle of the vectors that are to be found.
    """

    def __init__(self, dims: int, vectors: int, cosine: float, seed: int):
        rng = np.random.default_rng(seed)
        self.dims = max(LEAST_DIMS, 1 << max(0, dims - 1).bit_length())
        self.half = self.dims // 2
        self.signs = rng.integers(0, 2, (3, self.dims)) * 2.0 - 1
        self.m = code_size(vectors)
        self.parts = [rng.standard_normal((self.m, self.half)) for _ in range(2)]
        self.parts = [p / np.linalg.norm(p, axis=1, keepdims=True) for p in self.parts]
        # the share of directions that random vectors exceed settles the threshold
        x = rng.standard_normal((256, dims))
        a, b = self._scores(x / np.linalg.norm(x, axis=1, keepdims=True))
        some = rng.integers(0, self.m, (2, 1 << 14))
        share = min(0.5, LIST / self.m**2)
        self.threshold = min(float(np.quantile(a[:, some[0]] + b[:, some[1]], 1 - share)), cosine * math.sqrt(2))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        x = np.zeros((len(unit), self.dims))
        x[:, : unit.shape[1]] = unit
        for signs in self.signs:
            x = hadamard(x * signs)
        return [x[:, : self.half] @ self.parts[0].T, x[:, self.half :] @ self.parts[1].T]

    def decode(self, unit: np.ndarray):
        """For each vector the numbers of all directions whose inner product with it exceeds the threshold."""
        each = max(1, BLOCK_SCORES // self.m)
        for start in range(0, len(unit), each):
            scores = self._scores(unit[start : start + each])
            for first, second in zip(*scores, strict=True):
                order = np.argsort(-second)
                ranked = second[order]
                able = np.flatnonzero(first + ranked[0] >= self.threshold)
                # the second parts that go with a first part are the best ones, so many of them
                count = np.searchsorted(-ranked, first[able] - self.threshold, "right")
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(able, count) * self.m + order[within]


def code_size(vectors: int) -> int:
    """Parts of each half, so that a filter holds some LOAD unrelated vectors."""
    return int(np.clip(math.ceil(math.sqrt(LIST * vectors / LOAD)), 32, 8192))


_codes: dict[tuple, list[ProductCode]] = {}


def codes_for(dims: int, vectors: int, cosine: float) -> list[ProductCode]:
    """This worker's codes for vectors of a length, of which there are so many."""
    key = (dims, code_size(vectors), cosine)
    if key not in _codes:
        if len(_codes) >= 16:
            _codes.clear()
        _codes[key] = [ProductCode(dims, vectors, cosine, SEED + c) for c in range(CODES)]
    return _codes[key]


def _spread(near: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(axis=1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tiled(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Adds (i, j): groups of `keys` over TILE rows are cut into blocks and each pair of blocks is a group."""
    big = df.groupBy(*keys).count().where(F.col("count") > TILE).select(*keys, F.ceil(F.col("count") / TILE).cast("int").alias("g"))
    cut = df.join(big, keys, "left").withColumn("g", F.coalesce("g", F.lit(1)))
    cut = cut.withColumn("b", F.pmod(F.xxhash64(by), F.col("g")).cast("int"))
    cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return cut.select("*", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).drop("o", "g")


def _groups(rows: pa.Table, *keys: str):
    """The row numbers of each group of two and more."""
    columns = [rows.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns)
    if len(order):
        cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]), True])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                yield order[a:b]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Links vectors whose cosine, in double precision, is at least `threshold` (0.9 to 1).

    Returns a row per input row: id_col, n_links (other rows linked directly), component_id
    (smallest id reachable) and kept (it is the smallest).

    Exact copies become one vector first. Each vector is list-decoded to the filter directions that
    it exceeds, in CODES product codes whose size follows the number of vectors of its length, so
    that a filter holds a constant number of unrelated ones. In a filter, 8-bit sketches with an
    error bound propose links, of which a spanning forest goes on; then the vectors of each
    candidate component are compared exactly. Of pairs just at the threshold more than 99.5 in 100
    share a filter, of nearer ones practically all, whatever the number of dimensions. Groups of any
    size are compared in tiles of bounded size.

    Vectors that are null, zero or hold null or non-finite components are linked with nothing, and
    vectors of different lengths not with each other; so are rows with a null id, whose component is
    null and which are kept. Rows that repeat an id are separate vectors, each with its own answer.
    Ties go to the smallest id; an empty table gives an empty result. Other columns of df, whatever
    their names, aren't used.
    """
    if not 0.9 <= threshold <= 1:
        raise ValueError("threshold is 0.9 to 1: below, pairs may share no filter")
    every = marked(df, id_col, vector_col)
    rows = every.where("ok").select("id", "v")
    named = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2")]
    reps = distinct(rows).withColumn("dims", F.size("v"))
    # numbered once, in a written table
    reps = table(reps.select("*", *named, F.monotonically_increasing_id().alias("node")))
    peers = reps.groupBy("dims").agg(F.count("*").alias("peers"))

    def filters(batches):
        for whole in batches:
            for dims, vectors in {*zip(whole.column("dims").to_pylist(), whole.column("peers").to_pylist(), strict=True)}:
                batch = whole.filter(pa.compute.equal(whole.column("dims"), dims))
                x = matrix(batch.column("v"))
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                step = np.abs(unit).max(axis=1, keepdims=True) / 127
                small = np.rint(unit / step).astype(np.int8)
                error = np.linalg.norm(unit - small * step, axis=1)
                found = [np.concatenate(lists) for lists in zip(*([f * CODES + c for f in code.decode(unit)] for c, code in enumerate(codes_for(dims, vectors, threshold))), strict=True)]
                at = np.repeat(np.arange(len(x)), [len(f) for f in found])
                sketches = [s.tobytes() for s in small]
                for a in range(0, len(at), 50_000):
                    i = at[a : a + 50_000]
                    columns = [pa.array(np.full(len(i), dims), pa.int32()), pa.array(np.concatenate(found)[a : a + 50_000], pa.int64()), batch.column("node").take(pa.array(i)), pa.array([sketches[k] for k in i], pa.binary()), pa.array(step[i, 0], pa.float32()), pa.array(error[i], pa.float32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["dims", "filter", "node", "sketch", "step", "error"])

    def candidates(rows: pa.Table) -> pa.Table:
        sketch, node = rows.column("sketch").to_pylist(), rows.column("node").to_numpy()
        step, error = rows.column("step").to_numpy(), rows.column("error").to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for g in _groups(rows, "dims", "filter", "i", "j"):
            x = np.frombuffer(b"".join(sketch[k] for k in g), np.int8).reshape(len(g), -1).astype(np.float32) * step[g, None]
            e = error[g]
            # |x.y - x'.y'| is at most the two errors plus their product
            slack = e[:, None] + e[None, :] + e[:, None] * e[None, :] + 1e-4
            label = _spread(x @ x.T + slack >= threshold)
            part = np.flatnonzero(label != np.arange(len(label)))
            out.append(np.stack([node[g[part]], node[g[label[part]]]], axis=1))
        pairs = np.concatenate(out)
        return pa.table([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

    entries = reps.join(peers, "dims").select("node", "v", "dims", "peers").mapInArrow(filters, "dims int, filter long, node long, sketch binary, step float, error float")
    # many filters go to one call; its rows are bounded, as their number is known
    bins = lambda rows, each: max(4 * partition_count(df), rows // each + 1)
    n = bins(reps.count() * CODES * LIST, 10 * TILE)
    tiles = _tiled(entries, ["dims", "filter"], "node").withColumn("bin", F.pmod(F.xxhash64("dims", "filter", "i", "j"), F.lit(n)))
    proposed = tiles.groupBy("bin").applyInArrow(candidates, "a long, b long")
    group = components(proposed)
    members = table(reps.join(group.select(F.col("v").alias("node"), "component"), "node").select("node", "v", "copies", "component"))

    def links(rows: pa.Table) -> pa.Table:
        node, copies, block = (rows.column(c).to_numpy() for c in ("node", "copies", "b"))
        i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
        parts = []
        for g in _groups(rows, "component", "i", "j"):
            x = matrix(rows.column("v").take(pa.array(g)))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            label = _spread(near)
            # pairs within a block are counted in its own tile only
            counted = near if i[g[0]] == j[g[0]] else near & (block[g][:, None] != block[g][None, :])
            parts.append((node[g], counted @ copies[g], node[g[label]]))
        own, links_, root = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(own, pa.int64()), pa.array(links_, pa.int64()), pa.array(root, pa.int64())], names=["node", "links", "root"])

    tiles = _tiled(members, ["component"], "node").withColumn("bin", F.pmod(F.xxhash64("component", "i", "j"), F.lit(bins(members.count(), 2 * TILE))))
    found = table(tiles.groupBy("bin").applyInArrow(links, "node long, links long, root long"))
    final = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "node")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    out = reps.select("node", "rep", "copies", "h1", "h2").join(counts, "node", "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = out.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = out.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # rows of one vector share its answer, found by 128 bits of hash; hot vectors are split by adaptive execution
    answered = rows.select("id", *named).join(out, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = every.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = answered.unionByName(alone)
    return both.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
