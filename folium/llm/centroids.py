"""Clustering of integer vectors around centroids, by partial-distance search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_tables, table
from .common import by_key, partition_count
from .vectors import matrix

#: Dimensions that are added at once before centroids are abandoned.
STEP = 8
#: Components beyond this count as this, so that distances of 64 dimensions fit 63 bits.
LARGEST = 1 << 27
#: Rows that are searched at once.
BLOCK_ROWS = 4096


def search(x: np.ndarray, centres: np.ndarray, order: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its squared distance, exactly; of equal distances the smaller number.

    Dimensions are added in the given order, STEP at a time. A centre is abandoned for a row once
    its partial sum is strictly above the row's best; only what survives gets its other
    dimensions. `seen` collects how many differences were added.
    """
    x, centres = x[:, order], centres[:, order]
    n, dims = x.shape
    best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    for k, c in enumerate(centres):
        rows, part = np.arange(n), np.zeros(n, np.int64)
        for d in range(0, dims, STEP):
            # most are abandoned early; while all are there, no rows need to be gathered
            some = x[:, d : d + STEP] if len(rows) == n else x[rows, d : d + STEP]
            gap = some - c[d : d + STEP]
            part = part + np.einsum("ij,ij->i", gap, gap)
            if seen is not None:
                seen.append(gap.size)
            stay = part <= best[rows]
            if not stay.all():
                rows, part = rows[stay], part[stay]
            if not len(rows):
                break
        # a centre with a larger number must be nearer, not as near
        nearer = part < best[rows]
        best[rows[nearer]], which[rows[nearer]] = part[nearer], k
    return which, best


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """Assigns every vector to one of k integer centroids.

    Returns a row per kept vector: id_col, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256 (of the final centroid's components as decimal integers joined by a comma).
    Kept are vectors of `dims` components, none null or not finite; a component x becomes
    floor(scale * x), and beyond LARGEST in absolute value it counts as LARGEST. Centroids start as
    the k vectors with the smallest SHA-256 of `<seed>:<id>`; a round assigns every vector to its
    nearest centroid and moves every centroid that has vectors to the componentwise floor of their
    mean. After the last round vectors are assigned once more.

    A round is one pass over a table of the integer vectors: tasks search by partial distances,
    dimensions of high variance first, and send a sum for each centroid, so a cluster that holds most
    rows costs no more than any other. Only k centroids pass the driver.

    Ties of distance go to the smaller cluster number; rows that repeat an id are vectors of their
    own, and among the starts the one with the smaller vector comes first. Rows with a null id are
    assigned and counted like others but are no start. With fewer than k vectors there are that many
    centroids; an empty table gives no rows. Other columns of df, whatever their names, aren't used.
    """
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    whole = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST))), F.lit(LARGEST)), F.lit(-LARGEST))
    ints = table(rows.select("id", F.transform("v", whole).cast("array<int>").alias("v")).repartition(partition_count(df)))

    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = ints.where("id is not null").select(first.alias("h"), "id", "v").orderBy("h", "id", "v").limit(k).collect()
    centres = np.array([r.v for r in starts], np.int64).reshape(-1, dims)
    result = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centres):
        return df.sparkSession.createDataFrame([], result)

    spread = [f"cast(variance(v[{d}]) as double)" for d in range(dims)]
    order = np.argsort([-(x or 0.0) for x in ints.selectExpr(*spread).first()], kind="stable")

    def sums(centres):
        def run(batches):
            count, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dims), object)
            for batch in batches:
                x = matrix(batch.column("v")).astype(np.int64)
                for a in range(0, len(x), BLOCK_ROWS):
                    own = x[a : a + BLOCK_ROWS]
                    which, _ = search(own, centres, order)
                    for c, (mine,) in by_key(which, own):
                        count[c] += len(mine)
                        total[c] += mine.sum(axis=0)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array([[str(x) for x in total[c]] for c in some], pa.list_(pa.string()))], names=["c", "n", "t"])

        return run

    for _ in range(rounds):
        got = ints.select("v").mapInArrow(sums(centres), "c long, n long, t array<string>")
        wide = got.select("c", "n", *(F.col("t")[d].cast("decimal(38,0)").alias(f"t{d}") for d in range(dims)))
        for r in wide.groupBy("c").agg(F.sum("n").alias("n"), *(F.sum(f"t{d}").alias(f"t{d}") for d in range(dims))).collect():
            centres[r.c] = [int(r[f"t{d}"]) // r.n for d in range(dims)]

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("v")).astype(np.int64)
            got = [search(x[a : a + BLOCK_ROWS], centres, order) for a in range(0, len(x), BLOCK_ROWS)]
            which, far = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(which, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    found = table(ints.mapInArrow(assign, "id long, cluster int, distance long"))
    drop_tables(ints)
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    per = {r.cluster: int(r.d) for r in each}
    text = [",".join(map(str, c)) for c in centres.tolist()]
    known = [(c, min(per.get(c, 0), 2**63 - 1), hashlib.sha256(t.encode()).hexdigest()) for c, t in enumerate(text)]
    # k rows, so a broadcast of known size
    facts = df.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = F.least(F.lit(str(sum(per.values()))).cast("decimal(38,0)"), top).cast("long")
    out = found.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", inertia.alias("inertia"), "centroid_sha256")
    return out
