"""Prefix trie of conversations, by radix partitioning from the first turn on."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop_tables, table
from .common import partition_count

#: A bucket of at most so many distinct sequences and turns is finished by one task.
LOCAL_ROWS, LOCAL_TURNS = 4096, 65_536
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"


def encoded_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv long, seq array<struct<id, b>>): each conversation's turns in order as dictionary ids, with the UTF-8 bytes of their texts.

    Turns of a conversation are ordered by turn (null first), then role, then text. Equal (role,
    text) have equal ids and no others; they are told by SHA-256.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    # repeated turn numbers are put in order without gathering a conversation's texts
    rows = rows.withColumn("tie", F.expr("row_number() over (partition by conv, turn order by role, text)"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    turns = table(rows.select("conv", "turn", "tie", digest.alias("digest"), F.octet_length("text").alias("b")))
    known = table(turns.groupBy("digest").agg(F.first("b").alias("b")).withColumn("id", F.monotonically_increasing_id()))
    # grows with the input, so merged at every size; a turn that very many begin with is dealt out by adaptive execution
    named = turns.drop("b").join(known.hint("merge"), "digest")
    listed = named.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "tie", "id", "b"))).alias("s"))
    out = table(listed.select("conv", F.transform("s", lambda x: F.struct(x.id.alias("id"), x.b.alias("b"))).alias("seq")))
    drop_tables(turns, known)
    return out


def spliced(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    none = F.slice("seq", 1, 0)
    heads = seqs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = seqs.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", h)
    both = own.join(heads.hint("merge"), "base", "left")
    return both.select("conv", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


def _common(lo: Column, hi: Column) -> Column:
    """How many turns the first and the last of some ordered sequences share, and so all of them."""
    at = F.array_position(F.zip_with(lo, hi, lambda a, b: a.id.eqNullSafe(b.id)), F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(lo)).cast("int")


def _facts(depth: Column) -> list[Column]:
    """What is known of a bucket from its sequences; depth turns are shared by all."""
    return [F.min("m").alias("cm"), F.sum("n").alias("nn"), F.count("*").alias("rows"), F.sum(F.size("seq") - depth).alias("turns"), F.min("seq").alias("lo"), F.max("seq").alias("hi")]


def local_nodes(bucket: np.ndarray, depth: list, parent: list, m: list, n: list, ids: np.ndarray, sizes: np.ndarray, off: np.ndarray) -> tuple[list, np.ndarray]:
    """All nodes of whole buckets, whose rows stand together: the columns of _NODE, and which nodes are a bucket's top.

    depth and parent: turns that a row's bucket shares, and the conversation that the node above goes
    by; m and n: smallest conversation and number of conversations with a row's sequence; ids, sizes
    and off: turns of all rows, their bytes, and where each row's begin.

    Multikey quicksort: rows of a node are parted in three by a pivot's turn; those equal to it share
    one more turn and are the next node, the others are parted on. A row that is alone gets its rest
    as a chain, without comparisons.
    """
    words, first = ids.tolist(), off.tolist()
    sums = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    conv, deep, up, above, convs, kids, leaves, saved, end = ([] for _ in range(9))
    chains: list[tuple[int, int, int | None, int]] = []  # row, depth of its first node, what is above it: conversation and node
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist() if len(bucket) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        node0, chain0 = len(conv), len(chains)
        stack = [(list(range(a, b)), depth[a], -1)]
        while stack:
            rows, d, p = stack.pop()
            if len(rows) == 1:
                chains.append((rows[0], d, parent[a] if p < 0 else conv[p], p))
                continue
            me = len(conv)
            number = sum(n[r] for r in rows)
            conv.append(min(m[r] for r in rows))
            deep.append(d)
            up.append(parent[a] if p < 0 else conv[p])
            above.append(p)
            convs.append(number)
            kids.append(0)
            leaves.append(0)
            saved.append((number - 1) * int(sizes[first[rows[0]] + d - 1]) if d else 0)
            end.append(None)
            if p >= 0:
                kids[p] += 1
            going = []
            for r in rows:
                if first[r + 1] - first[r] == d:
                    end[me] = m[r]
                else:
                    going.append(r)
            parts = [going]
            while parts:
                some = parts.pop()
                if not some:
                    continue
                pivot = words[first[some[len(some) // 2]] + d]
                same = [r for r in some if words[first[r] + d] == pivot]
                stack.append((same, d + 1, me))
                if len(same) < len(some):
                    parts += [[r for r in some if words[first[r] + d] > pivot], [r for r in some if words[first[r] + d] < pivot]]
        for r, d, _, p in chains[chain0:]:
            if p >= 0:
                kids[p] += 1
                leaves[p] += 1
                saved[p] += (n[r] - 1) * int(sums[first[r + 1]] - sums[first[r] + d - 1])
        for k in range(len(conv) - 1, node0 - 1, -1):  # nodes stand after those above them
            if above[k] >= 0:
                leaves[above[k]] += leaves[k]
                saved[above[k]] += saved[k]
    out = [pa.array(c, pa.int64()) for c in (conv, deep, up, convs, kids, leaves, saved, end)]
    top = np.array(above, np.int64) < 0
    if chains:
        row, d0 = (np.array([c[k] for c in chains], np.int64) for k in (0, 1))
        count = np.diff(off)[row] - d0 + 1
        begin = np.repeat(np.cumsum(count) - count, count)
        d = np.arange(len(begin)) - begin + np.repeat(d0, count)
        which = np.repeat(row, count)
        own, each = np.array(m, np.int64)[which], np.array(n, np.int64)[which]
        head, last = np.arange(len(d)) == begin, d == np.diff(off)[which]
        higher = np.array([0 if c[2] is None else c[2] for c in chains], np.int64)
        no_parent = np.zeros(len(d), bool)
        no_parent[head] = [c[2] is None for c in chains]
        left = (each - 1) * (sums[off[which + 1]] - sums[off[which] + np.maximum(d, 1) - 1])
        more = [
            pa.array(own), pa.array(d), pa.array(np.where(head, np.repeat(higher, count), own), mask=no_parent), pa.array(each),
            pa.array((~last).astype(np.int64)), pa.array(np.ones(len(d), np.int64)), pa.array(left), pa.array(own, mask=~last),
        ]
        out = [pa.concat_arrays([x, y]) for x, y in zip(out, more, strict=True)]
        top = np.r_[top, head & np.repeat(np.array([c[3] < 0 for c in chains]), count)]
    return out, top


def _local(batches):
    """local_nodes of a partition's buckets, whole ones of each batch at a time; a bucket's rows stand together."""
    held = None
    names = [x.split()[0] for x in _NODE.split(", ")] + ["top", "round"]

    def finish(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        col = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        off = col["ids"].offsets.to_numpy().astype(np.int64)
        ids, sizes = col["ids"].flatten().to_numpy(), col["sizes"].flatten().to_numpy()
        bucket = np.cumsum(np.r_[True, _turns_over(rows)]) if rows.num_rows else np.zeros(0, np.int64)
        out, top = local_nodes(bucket, col["bd"].to_pylist(), col["bp"].to_pylist(), col["m"].to_pylist(), col["n"].to_pylist(), ids, sizes, off - off[0])
        # a bucket's top stands in the order of buckets within branching nodes and within chains, so its round goes by its conversation
        rounds = dict(zip(zip(col["bm"].to_pylist(), col["bd"].to_pylist(), strict=True), col["round"].to_pylist(), strict=True))
        own = [rounds.get((c, d), -1) if t else -1 for c, d, t in zip(out[0].to_pylist(), out[1].to_pylist(), top.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*out, pa.array(top), pa.array(own, pa.int32())], names=names)

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        edges = np.flatnonzero(_turns_over(held))
        if len(edges):
            stop = int(edges[-1]) + 1
            yield finish(held.slice(0, stop))
            held = held.slice(stop)
    if held is not None and held.num_rows:
        yield finish(held)


def _turns_over(rows: pa.Table) -> np.ndarray:
    """Where a row's bucket isn't that of the row before."""
    bm, bd = rows.column("bm").to_numpy(), rows.column("bd").to_numpy()
    return (bm[1:] != bm[:-1]) | (bd[1:] != bd[:-1])


def _hashed(batches):
    """(smallest conversation, SHA-256 of all, joined by a comma) of runs of rows of one key, which come in order."""
    key = low = digest = None
    for batch in batches:
        lows, texts = [], []
        for k, first, some in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "some")), strict=True):
            if k != key:
                if digest is not None:
                    lows.append(low)
                    texts.append(digest.hexdigest())
                key, low, digest = k, first, hashlib.sha256(some.encode())
            else:
                digest.update(b"," + some.encode())
        yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(texts, pa.string())], names=["end", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([digest.hexdigest()])], names=["end", "ends_sha256"])


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild=None, local_rows: int = LOCAL_ROWS, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of all conversations' beginnings: a row for each distinct sequence of first turns, the empty one included.

    Returns conv_id (smallest conversation that begins so), depth (turns), parent_conv_id (that of
    the node above; the root has none), n_convs, n_children, n_leaves (nodes without children in its
    subtree, itself included), saved_tokens (over its subtree: conversations but one, times the
    UTF-8 bytes of a node's last text) and ends_sha256 (of the decimal ids, in order and joined by a
    comma, of the conversations that have just these turns). `rebuild` may change the encoded
    conversations, (conv, seq), before the trie is built.

    Turns become dictionary ids; equal sequences are one row with a count. Radix partitioning from
    the first turn on: Spark groups a bucket's sequences by their next turn, one round for all buckets
    that hold more than local_rows sequences or local_turns turns; turns that a whole bucket shares
    are passed over in one step. A smaller bucket goes to one task, which finishes it by multikey
    quicksort. A round's groupings are combined in tasks first and its join splits hot buckets, so
    a first turn that a third of all conversations have costs a row for each task. What the large
    buckets' nodes sum up comes from the tops below them, round by round, deepest first. Ids that end
    in a node are joined in runs of at most 1,024 before they meet, and hashed as they pass by.

    A null role or text is empty; a null turn comes first; rows of equal turns are ordered by role,
    then text, and repeated rows are turns of their own. Rows with a null conv_id are left out. A
    conversation's ids are one row, its texts are not. An empty table has no node, not even a root.
    Other columns of df, whatever their names, aren't used.
    """
    seqs = encoded_turns(df, conv_col, turn_col, role_col, text_col)
    big = (F.col("rows") > 1) & ((F.col("rows") > local_rows) | (F.col("turns") > local_turns))
    key = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda x: x.id.cast("string")), ",").cast("binary"), 256))
    whole = table((rebuild(seqs) if rebuild else seqs).withColumn("key", key))
    drop_tables(seqs)
    distinct = table(whole.groupBy("key").agg(F.min("conv").alias("m"), F.count("*").alias("n"), F.first("seq").alias("seq")).drop("key"))

    root = distinct.agg(*_facts(F.lit(0))).where("rows > 0").withColumn("big", big).withColumn("sd", _common(F.col("lo"), F.col("hi")))
    root = table(root.select(F.col("cm").alias("bm"), F.lit(0).alias("bd"), F.lit(None).cast("long").alias("bp"), "nn", "lo", "big", "sd"))
    at = root.select("bm", "big", "sd").first()
    if at is None:
        return df.sparkSession.createDataFrame([], _NODE.rpartition(", ")[0] + ", ends_sha256 string")
    tag = lambda df, bp, bd, number: df.withColumns({"bp": bp, "bd": bd, "round": F.lit(number)})
    rows = distinct.withColumns({"bm": F.lit(at.bm), "sd": F.lit(at.sd)})
    small = [] if at.big else [tag(rows, F.lit(None).cast("long"), F.lit(0), -1)]
    levels, buckets = [], root
    while at is not None and at.big:
        # one more turn: (bucket, turn) is a bucket of the next round
        parted = rows.withColumn("digit", F.element_at(F.col("seq.id"), F.col("sd") + 1))
        going = parted.where(F.size("seq") > F.col("sd"))
        below = table(going.groupBy("bm", "digit", "sd").agg(*_facts(F.col("sd"))).withColumn("big", big).withColumn("csd", _common(F.col("lo"), F.col("hi"))))
        ended = parted.where(F.size("seq") == F.col("sd")).select("bm", F.col("m").alias("end"))
        kids = below.groupBy("bm").agg(F.count("*").alias("kids"))
        levels.append(table(buckets.where("big").join(kids.hint("merge"), "bm").join(ended.hint("merge"), "bm", "left")))
        named = going.drop("sd").join(below.select("bm", "digit", "cm", "big", (F.col("sd") + 1).alias("bd"), F.col("csd")).hint("merge"), ["bm", "digit"])
        new = table(named.select(F.col("cm").alias("bm"), F.col("bm").alias("bp"), "bd", F.col("csd").alias("sd"), "big", "seq", "m", "n"))
        small.append(tag(new.where("not big"), F.col("bp"), F.col("bd"), len(levels) - 1))
        buckets = below.select(F.col("cm").alias("bm"), (F.col("sd") + 1).alias("bd"), F.col("bm").alias("bp"), "nn", "lo", "big", F.col("csd").alias("sd"))
        rows = new.where("big").select("bm", "sd", "seq", "m", "n")
        at = below.where("big").select("big").first()

    columns = ["bm", "bd", "bp", "round", "m", "n", F.col("seq.id").alias("ids"), F.col("seq.b").alias("sizes")]
    piled = small[0].select(*columns)
    for more in small[1:]:
        piled = piled.unionByName(more.select(*columns))
    piled = piled.repartition(partition_count(distinct), "bm", "bd").sortWithinPartitions("bm", "bd")
    nodes = table(piled.mapInArrow(_local, f"{_NODE}, top boolean, round int"))

    # the large buckets, deepest round first: sums of the tops below, then the turns that the bucket shares
    parts, tops = [nodes.drop("top", "round")], None
    for number in range(len(levels) - 1, -1, -1):
        low = nodes.where(f"top and round = {number}").select(F.col("parent_conv_id").alias("bm"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        low = low if tops is None else low.unionByName(tops)
        sums = low.groupBy("bm").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        level = levels[number].join(sums.hint("merge"), "bm")
        size = lambda d: F.when(d > 0, F.element_at(F.col("lo.b"), F.greatest(d, F.lit(1)))).otherwise(0).cast("long")
        path = level.withColumn("d", F.sequence("bd", "sd"))
        down = F.transform("d", lambda d: (F.col("nn") - 1) * size(d))
        # from the deepest up, what a node saves adds to what is saved below it
        run = F.aggregate(F.reverse(down), F.array(F.col("saved").cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x), lambda acc: F.reverse(F.slice(acc, F.lit(2), F.size(acc) - 1)))
        level = table(path.withColumn("run", run))
        tops = level.select(F.col("bp").alias("bm"), "leaves", F.element_at("run", 1).alias("saved"))
        each = level.select("*", F.posexplode("d").alias("_k", "depth"))
        parts.append(each.select(
            F.col("bm").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("_k") > 0, F.col("bm")).otherwise(F.col("bp")).alias("parent_conv_id"), F.col("nn").alias("n_convs"),
            F.when(F.col("depth") == F.col("sd"), F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.element_at("run", F.col("_k") + 1).alias("saved_tokens"), F.when(F.col("depth") == F.col("sd"), F.col("end")).alias("end"),
        ))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)

    runs = whole.groupBy("key", F.shiftright("conv", 10).alias("run")).agg(F.min("conv").alias("low"), F.sort_array(F.collect_list("conv")).alias("some"))
    runs = runs.select("key", "low", F.array_join(F.transform("some", lambda c: c.cast("string")), ",").alias("some"))
    hashed = runs.repartition(partition_count(whole), "key").sortWithinPartitions("key", "low").mapInArrow(_hashed, "end long, ends_sha256 string")
    # nodes that nothing ends in don't take part in the join
    none = out.where("end is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.where("end is not null").join(hashed.hint("merge"), "end").select(*none.columns).unionByName(none).drop("end")
