"""The prefix trie against a plain one, with small buckets so that both ways of splitting are used."""

import hashlib
import zlib

import numpy as np
import pytest

from folium.llm.prefix_trie import prefix_trie, spliced

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, rebuild):
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
        seqs = {c: seqs.get(c - c % 5, [])[: h[c]] + s[h[c] :] for c, s in seqs.items()}
    members: dict = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for path, some in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in some if len(seqs[c]) == len(path))))
        out.append((min(some), len(path), min(members[path[:-1]]) if path else None, len(some), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    return sorted((tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA), **more).select(*COLUMNS).collect()), key=str)


def sample(rng, n, hot=0.4):
    rows = []
    for c in range(n):
        c = int(c * 3 + rng.integers(0, 3))
        texts = ["start"] * 3 if rng.random() < hot else []
        texts += [str(x) for x in rng.integers(0, 3, rng.integers(0, 6))]
        rows += [(c, k if k else None, None if k % 3 else "user", t) for k, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("rebuild, local", [(None, (4096, 65_536)), (None, (6, 60)), (spliced, (1, 10**6)), (spliced, (3, 9))])
def test_against_plain_trie(spark, local, rebuild):
    rows = sample(np.random.default_rng(local[0]), 60)
    assert got(spark, rows, rebuild=rebuild, local_rows=local[0], local_turns=local[1]) == plain(rows, rebuild)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 0, "user", "a"),  # null is empty, and first
        (3, 5, "b", "x"), (3, 5, "a", "y"), (3, 5, "a", "y"),  # repeated turns go by role and text
        (None, 1, "user", "lost"), (4, 1, "user", "é" * 50_000), (5, 1, "user", "é" * 50_000), (5, 2, "user", "ab"), (6, 1, "use", "rab"),
    ]
    assert got(spark, rows) == plain(rows, None)
    assert got(spark, []) == []
    more = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, seq int")
    assert sorted((tuple(r) for r in prefix_trie(more).select(*COLUMNS).collect()), key=str) == plain(rows, None)


def test_conversations_that_end_up_without_turns(spark):
    # nothing stands at their bases, and they are shorter than what they would take over
    rows = [(c, 1, "user", "t") for c in (1, 2, 3, 4, 6, 7, 8, 9, 11)]
    assert got(spark, rows, rebuild=spliced) == plain(rows, spliced)
    assert any(d == 0 and n > 0 for _, d, _, n, *_ in got(spark, rows, rebuild=spliced))


def test_many_copies_and_long_shared_beginnings(spark):
    rows = [(c, k, "user", "same") for c in range(2500) for k in range(3)]  # copies, over three runs of ids
    rows += [(c, k, "user", f"s{k}" if k < 40 else f"{c}-{k}") for c in range(3000, 3060) for k in range(42)]
    assert got(spark, rows, local_rows=20) == plain(rows, None)
