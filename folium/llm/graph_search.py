"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partition_count, table
from .vectors import distinct, matrix, usable

#: Vectors of a shard, out-degree, build beam, query beam, slack of the distance pruning, nodes opened a step.
SHARD, DEGREE, BUILD_BEAM, QUERY_BEAM, RELAX, WIDTH = 8192, 32, 64, 128, 1.2, 4
BATCH = 256


class Graph:
    """A directed graph over vectors, grown in batches: greedy searches propose, pruning keeps diverse edges."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self._level(x)
        n = len(x)
        self.room = DEGREE * 3 // 2
        self.edges = np.full((n, self.room), -1, dtype=np.int32)
        self.degree = np.zeros(n, dtype=np.int64)
        self.entry = int((self.x**2).sum(axis=1).argmin()) if n else 0
        order = np.random.default_rng(seed).permutation(n)
        order = np.r_[self.entry, order[order != self.entry]].astype(np.int64) if n else order
        grown = min(n, DEGREE + 1)
        self._join(order[:grown], np.broadcast_to(order[:grown], (grown, grown)))
        while grown < n:
            # batches grow with the graph, so that early nodes find near ones
            some = order[grown : grown + min(BATCH, max(16, grown // 2))]
            found, _ = self._search(self.x[some], BUILD_BEAM)
            self._join(some, found)
            grown += len(some)

    @classmethod
    def restored(cls, x: np.ndarray, edges: list[list[int]], entry: int) -> Graph:
        """A graph that was built before, to be searched."""
        self = cls.__new__(cls)
        self._level(x)
        self.entry = entry
        self.edges = np.full((len(x), max(1, max(map(len, edges)))), -1, dtype=np.int32)
        for i, e in enumerate(edges):
            self.edges[i, : len(e)] = e
        return self

    def _level(self, x: np.ndarray) -> None:
        """Takes the vectors about their mean and at a scale of one, so that neither an offset nor a size costs accuracy."""
        x = np.asarray(x, dtype=np.float64)
        self.size = float(np.abs(x).max()) or 1.0 if x.size else 1.0
        x = x / self.size
        self.middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        x = x - self.middle
        self.spread = float(np.abs(x).max()) or 1.0 if x.size else 1.0
        self.x = np.ascontiguousarray(x / self.spread)

    def _near(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of ids, from differences: near copies are told apart too."""
        gap = self.x[ids] - q[:, None, :]
        return np.einsum("ijk,ijk->ij", gap, gap)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query, a vector as those given, the ids (-1: none) that a beam search finds, nearest first, and squared distances at the graph's scale."""
        with np.errstate(over="ignore"):
            q = (np.asarray(q, dtype=np.float64) / self.size - self.middle) / self.spread
        return self._search(np.clip(q, -1e100, 1e100), beam)

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the entry: for each query up to `beam` ids (-1: none) and squared distances, nearest first."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x)), dtype=bool)
        ids = np.full((n, beam), -1, dtype=np.int64)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), dtype=bool)
        ids[:, 0], done[:, 0] = self.entry, False
        dist[:, 0] = self._near(q, ids[:, :1])[:, 0]
        seen[:, self.entry] = True
        while True:
            rank = np.where(done, np.inf, dist)
            open_ = np.argpartition(rank, WIDTH - 1, axis=1)[:, :WIDTH]
            able = np.isfinite(rank[rows, open_])
            if not able.any():
                return ids, dist
            done[rows, open_] = True
            new = self.edges[np.where(able, ids[rows, open_], 0)]
            new = np.where(able[:, :, None], new, -1).reshape(n, -1).astype(np.int64)
            fresh = (new >= 0) & ~seen[rows, np.maximum(new, 0)]
            new = np.where(fresh, new, -1)
            new = np.sort(new, axis=1)[:, ::-1]
            new = new[:, : max(1, int((new >= 0).sum(axis=1).max()))]
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            ok = new >= 0
            seen[rows, np.where(ok, new, self.entry)] = True
            d = np.where(ok, self._near(q, np.maximum(new, 0)), np.inf)
            ids, dist, done = np.c_[ids, new], np.c_[dist, d], np.c_[done, ~ok]
            best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
            best = best[rows, np.argsort(dist[rows, best], axis=1, kind="stable")]
            ids, dist, done = ids[rows, best], dist[rows, best], done[rows, best]

    def prune(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each node's candidates (-1: none), those kept: nearest first, without any that a kept one is nearer to, by RELAX."""
        near = np.where(near == nodes[:, None], -1, near)
        d = np.where(near >= 0, self._near(self.x[nodes], np.maximum(near, 0)), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        rows = np.arange(len(nodes))
        near, d = near[rows[:, None], order], d[rows[:, None], order]
        # about the node itself, so that the products are as small as the distances
        v = self.x[np.maximum(near, 0)] - self.x[nodes][:, None, :]
        sq = np.einsum("ijk,ijk->ij", v, v)
        apart = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        # the same candidate twice is at no distance from itself
        alive = np.isfinite(d)
        kept = np.full((len(nodes), DEGREE), -1, dtype=np.int32)
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[some, k] = near[rows, pick][some]
            shadow = RELAX * RELAX * apart[rows, pick] <= d
            alive &= ~(shadow & some[:, None])
            alive[rows, pick] = False
        return kept

    def _set(self, nodes: np.ndarray, kept: np.ndarray) -> None:
        self.edges[nodes] = -1
        self.edges[nodes, : kept.shape[1]] = kept
        self.degree[nodes] = (kept >= 0).sum(axis=1)

    def _join(self, nodes: np.ndarray, found: np.ndarray) -> None:
        kept = self.prune(nodes, np.asarray(found))
        self._set(nodes, kept)
        source = np.repeat(nodes, (kept >= 0).sum(axis=1))
        target = kept[kept >= 0].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        head = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(target)])
        place = np.arange(len(target)) - np.repeat(head, count)
        fits = self.degree[target] + np.repeat(count, count) <= self.room
        slot = self.degree[target] + place
        self.edges[target[fits], slot[fits]] = source[fits]
        easy = np.unique(target[fits])
        self.degree[easy] += np.bincount(target[fits], minlength=len(self.x))[easy]
        full, start = np.unique(target[~fits], return_index=True)
        if len(full):
            mine, size = source[~fits], np.diff(np.r_[start, (~fits).sum()])
            more = np.full((len(full), int(size.max())), -1, dtype=np.int64)
            more[np.repeat(np.arange(len(full)), size), np.arange(len(mine)) - np.repeat(start, size)] = mine
            self._set(full, self.prune(full, np.c_[self.edges[full], more]))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q; also where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        gap = x - q
        d = np.sqrt((gap**2).sum(axis=1))
        for i in np.flatnonzero(~((d > 1e-140) & (d < 1e150))):
            most = np.abs(gap[i]).max()
            d[i] = most * np.sqrt(((gap[i] / most) ** 2).sum()) if 0 < most < np.inf else most
    return d


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_rows: int = SHARD, query_block: int = BATCH) -> DataFrame:
    """The k nearest rows found for each query row, by Euclidean distance in double precision.

    df holds all rows; queries some of them. Returns query_id, rank (from 1), vec_id, score, ties to
    the smaller id; a query is not its own neighbour. Exact copies are one node of the index and
    answer with their smallest ids. Rows are dealt to shards of about shard_rows distinct vectors
    by a hash of the id; each shard's graph is built once and written to the shared folder. Every
    query is searched in every shard: a shard's index is read once by one task, and queries stream
    past it, however many they are, query_block at a time. Graphs are built and searched in doubles about the shard's mean
    and at its scale, with a beam of at least 2k.

    Vectors that are null, zero, or hold null or non-finite components take no part, as queries or
    candidates, nor do rows with a null id; vectors of different lengths aren't compared. A query
    with fewer than k candidates returns all of them. A repeated id counts once, with its nearest
    vector. An empty table, or no query, gives an empty result; other columns aren't used.
    """
    rows = usable(df, id_col, vector_col).dropDuplicates(["id", "v"])
    asked = table(usable(queries, id_col, vector_col).dropDuplicates(["id", "v"]))
    reps = table(distinct(rows, k + 1).withColumn("dims", F.size("v")))
    shards = max(1, math.ceil(reps.count() / shard_rows))
    beam = max(QUERY_BEAM, 2 * k)

    def build(part: pa.Table) -> pa.Table:
        graph = Graph(matrix(part.column("v")))
        edges = pa.array([e[e >= 0].tolist() for e in graph.edges], pa.list_(pa.int32()))
        entry = np.arange(part.num_rows) == graph.entry
        return pa.table([part.column(c) for c in ("dims", "shard", "v", "ids")] + [pa.array(np.arange(part.num_rows), pa.int32()), edges, pa.array(entry)], names=["dims", "shard", "v", "ids", "node", "edges", "entry"])

    dealt = reps.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")).select("dims", "shard", "v", "ids")
    index = table(dealt.groupBy("dims", "shard").applyInArrow(build, "dims int, shard int, v array<double>, ids array<long>, node int, edges array<int>, entry boolean"))
    index = index.withColumn("id", F.lit(None).cast("long"))
    spread = asked.select(F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("node"), F.lit(None).cast("array<int>").alias("edges"), F.lit(False).alias("entry"), "id")

    def answers(graph: Graph, x: np.ndarray, ids: list, own: list, q: np.ndarray) -> pa.RecordBatch:
        out = ([], [], [])
        for a in range(0, len(q), query_block):
            block = q[a : a + query_block]
            for i, near in enumerate(graph.search(block, beam)[0]):
                near = near[near >= 0]
                d = distances(x[near], block[i])
                best: dict[int, float] = {}  # of an id with several vectors the nearest counts
                for dist, other in sorted((dist, other) for dist, node in zip(d.tolist(), near.tolist(), strict=True) for other in ids[node]):
                    if other != own[a + i] and len(best) < k:
                        best.setdefault(other, dist)
                out[0].extend([own[a + i]] * len(best))
                out[1].extend(best)
                out[2].extend(best.values())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    def search(batches):
        # a shard's nodes come in order, then the queries
        at, held, graph = None, [], None
        for batch in batches:
            key = list(zip(batch.column("dims").to_pylist(), batch.column("shard").to_pylist(), batch.column("node").is_valid().to_pylist(), strict=True))
            cuts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]] + [len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some, own = batch.slice(a, b - a), key[a][:2]
                if own != at:
                    at, held, graph = own, [], None
                if key[a][2]:
                    held.append(some)
                elif held or graph:
                    if graph is None:
                        part = pa.Table.from_batches(held)
                        x, ids = matrix(part.column("v")), part.column("ids").to_pylist()
                        graph, held = Graph.restored(x, part.column("edges").to_pylist(), part.column("entry").to_pylist().index(True)), []
                    yield answers(graph, x, ids, some.column("id").to_pylist(), matrix(some.column("v")))

    both = index.unionByName(spread).repartition(max(shards, partition_count(df)), "dims", "shard").sortWithinPartitions("dims", "shard", F.asc_nulls_last("node"))
    found = both.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
