"""The language model against a plain one that recurses over dictionaries."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm import lm_score
from folium.llm.lm_score import score_texts

SCHEMA = "doc_id long, text string, learn boolean"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    out, own = [], ""
    for ch in (text or "").translate(LOWER):
        if ch in " \t\n\v\f\r":
            out += [own] if own else []
            own = ""
        else:
            own += ch
    return [*out, *([own] if own else []), None]


class Plain:
    def __init__(self, texts, order, strength):
        self.order, self.strength = order, strength
        self.count = Counter()
        for t in texts:
            seq = ["<begin>", *words(t)]
            for i in range(len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0 and (i or k == 1):
                        self.count[tuple(seq[i - k + 1 : i + 1])] += 1
        own = {g: c for g, c in self.count.items() if len(g) == 1 and g != ("<begin>",)}
        self.n, self.v = sum(own.values()), len(own)

    def chance(self, history, w):
        if not history:
            return (self.count[(w,)] + 1) / (self.n + self.v + 1)
        s, of = self.strength[len(history) - 1], self.count[history]
        lower = self.chance(history[1:], w)
        return (self.count[(*history, w)] + s * lower) / (of + s) if of else lower

    def score(self, text):
        seq = ["<begin>", *words(text)]
        return sum(math.log10(self.chance(tuple(seq[max(0, i - self.order + 1) : i]), seq[i])) for i in range(1, len(seq)))

    def base(self, text):
        return sum(math.log10(self.chance((), w)) for w in words(text))


def compare(spark, rows, order, strength=(2.0, 0.5), df=None):
    model = Plain([t for i, t, learn in rows if learn and i is not None], order, strength)
    got = score_texts(df or spark.createDataFrame(rows, SCHEMA), F.col("learn"), order=order, strength=strength)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], round(r[5], 6), str(r))
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(((i, not (learn and i is not None), len(words(t)), sum(model.count[(w,)] > 0 for w in words(t)), model.n, model.base(t), model.score(t)) for i, t, learn in rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-10, atol=1e-9)
    return model


def texts(rng, n):
    return [" ".join(rng.choice(["the", "The", "cat", "dog", "sat", "on", "mat", "é", "x1"], rng.integers(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "PIECE", 7)
    rng = np.random.default_rng(order)
    rows = [(i, t, bool(i % 4)) for i, t in enumerate(texts(rng, 120))]
    rows += [(500, " ".join(rng.choice(["a", "b", "cat", "on"], 5000)), True), (501, "quite unseen words here", False)]
    model = compare(spark, rows, order)
    # what a state gives all known words and an unknown one sums to 1
    known = [g[0] for g in model.count if len(g) == 1 and g != ("<begin>",)]
    for history in [(), ("the",), ("<begin>",), ("the", "cat"), ("<begin>", "the")][: 5 if order == 3 else 3 if order == 2 else 1]:
        assert abs(sum(model.chance(history, w) for w in [*known, "never seen"]) - 1) < 1e-9


def test_awkward_rows(spark):
    long = "word " * 40_000 + "w" * 100_000
    rows = [(1, None, True), (2, "", True), (3, " \t\n", False), (4, long, True), (5, long, False), (None, "the cat", True), (6, "A a", True), (6, "A a", True), (6, "A a", False), (7, "a b İ", True)]
    compare(spark, rows, 2)
    compare(spark, [(1, "only held out", False), (2, None, False)], 3)
    assert score_texts(spark.createDataFrame([], SCHEMA), F.col("learn")).collect() == []
    more = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", block int, bucket string, score double")
    compare(spark, rows, 2, df=more)
    with pytest.raises(ValueError):
        score_texts(more, F.col("learn"), order=4)


def test_pieces_and_slices_do_not_change_a_score(monkeypatch):
    rng = np.random.default_rng(5)
    some = pa.array([" ".join(rng.choice(list("abcdef"), n)) for n in (3000, 1, 0, 511, 512, 513, 1024)])
    levels = lm_score._block_grams(some, np.ones(len(some), bool), 3, True)
    model = lm_score.Automaton(levels, 100, 10, (1.0, 1.0))
    buf, off = lm_score.text_buffer(some)
    seq, begin = lm_score.token_keys(buf, off)
    whole = model.score(seq, begin)
    for piece in (5, 100, 10**6):
        monkeypatch.setattr(lm_score, "PIECE", piece)
        assert np.allclose(model.score(seq, begin), whole, rtol=1e-12)


def test_blobs():
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm_score.unpack_keys(lm_score.pack_keys(keys)) == keys).all()
    assert len(lm_score.unpack_keys(lm_score.pack_keys(keys[:0]))) == 0
    sent = lm_score._send(keys, np.arange(len(keys)), 3, 7)
    assert (np.concatenate([lm_score.unpack_keys(s[2]) for s in sent]) == keys).all() and [s[0] for s in sent] == sorted({s[0] for s in sent})
