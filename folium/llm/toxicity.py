"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_filter, drop_tables, id_filter, table

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ⅼ": "l", "ı": "i"}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Insults that count even where the labels don't show them, and phrases that are harmless.
SEEDS = "idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb imbecile jerk vermin filth garbage scumbag dimwit lowlife degenerate".split()
EXCEPTIONS = ("trash can", "trash bin", "garbage can", "garbage collection", "garbage collector", "clown fish", "idiot proof", "pond scum", "stupid simple", "circus clown", "worthless cheque", "sore loser rule")
SEED_WEIGHT = 1.5

#: Lengths of word beginnings that may become lexicon entries, written with a star.
STEMS = range(4, 10)


def _fold_table() -> dict[int, str]:
    t = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
    t |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    t |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD), "")
    return t


_FOLD = _fold_table()
# a sign before a letter, or after one; an exclamation mark after one only inside a word
_MARK = re.compile(r"[0-9@$!|](?:(?=[^\W\d_])|(?<=[^\W\d_][0-9@$|])|(?<=[^\W\d_]!)(?=[^\W_]))")
_GAP = re.compile(r"[\W_]+")
_ASCII_GAPS = {i: " " for i in range(128) if _GAP.match(chr(i))}


def fold(text: str) -> str:
    """Lower-case words between single spaces, with look-alikes and digit substitutions undone.

    l is written as i, since 1 and | stand for either; lexicon entries are folded alike. Accented
    letters are letters of their own.
    """
    t = text.lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    t = _MARK.sub(lambda m: SUBSTITUTES.get(m[0], m[0]), t)
    t = " ".join(t.translate(_ASCII_GAPS).split()) if t.isascii() else _GAP.sub(" ", t).strip()
    return f" {t} ".replace("l", "i")


@dataclass
class Model:
    """Weights of folded lexicon words and the logistic curve over the normalised sum."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 1.0
    intercept: float = 0.0

    def automaton(self):
        """Entries and phrases with their lengths; a phrase has no weight of its own."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            w = f" {w[:-1]}" if w[-1] == "*" else f" {w} "
            a.add_word(w, (len(w), x))
        for e in map(fold, self.exceptions):
            a.add_word(e, (len(e), None))
        a.make_automaton()
        return a

    def score(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * feature + self.intercept, -50, 50)))


def feature(automaton, text: str | None) -> tuple[float, int]:
    """Sum of the weights of matched words over the logarithm of the length in words, and the number of such words.

    A word counts once, with the largest weight of the entries it matches. Words inside an exception
    phrase don't count, whichever entries they match.
    """
    return _folded_feature(automaton, fold(text or ""))


def _folded_feature(automaton, t: str) -> tuple[float, int]:
    words: dict[int, float] = {}
    spans = []
    for end, (size, x) in automaton.iter(t):
        start = end - size + 1
        if x is None:
            spans.append((start, end))
        else:
            words[start] = max(words.get(start, x), x)
    for a, b in spans:
        for start in [s for s in words if a <= s < b]:
            del words[start]
    return sum(words.values()) / math.log2(8 + t.count(" ")), len(words)


def training_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int | None = None) -> DataFrame:
    """(id, text, y) of all labelled ids whose crc32(id as text) mod 3 is not 1, or with `rows` of the first ones in the order of a hash; of a repeated id one text."""
    learned = (F.crc32(F.col("id").cast("string").cast("binary")) % 3) != 1
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(learned)
    some = marked.groupBy("id").agg(F.max("y").alias("y"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").where(learned)
    if rows is not None:
        some = F.broadcast(some.orderBy(F.xxhash64("id"), "id").limit(rows))
    else:
        # texts without a label aren't shuffled for the join, but for a few
        docs = by_filter(docs, "id", id_filter(marked, "id"))
    # one text of a repeated id, so that an id counts once
    return docs.join(some, "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))


def fit(sample: DataFrame, least_share: float = 0.005, most_words: int = 5000) -> Model:
    """Learns lexicon weights (log odds of the document frequencies of words and stems) and the curve, from all rows of (id, text, y).

    Copies count once: of texts with the same smallest 63-bit hash of six words in a row, one
    is used. Only words of 3 to 30 letters are learned. Words with too few toxic documents or odds under 8 aren't taken; at most most_words are.
    """

    def words(batches, rows_each: int = 200):
        for whole in batches:
            for start in range(0, whole.num_rows, rows_each):
                batch = whole.slice(start, rows_each)
                folded, keys = [fold(t) for t in batch.column("text").to_pylist()], []
                for w in map(str.split, folded):
                    keys.append(min((hash63(" ".join(w[i : i + 6])) for i in range(max(1, len(w) - 5))), default=0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(keys, pa.int64()), pa.array(folded, pa.string())], names=["id", "y", "k", "folded"])

    sample = table(sample.mapInArrow(words, "id long, y int, k long, folded string"))
    # of copies the toxic one with the smallest id, or if there is none the smallest
    first = table(sample.groupBy("k").agg(F.min(F.struct((-F.col("y")).alias("y"), "id")).alias("m")).select("m.id"))
    # only texts that may be further copies are shuffled to be compared with those ids
    again = table(id_filter(sample.select("id").join(first, "id", "left_anti"), "id"))
    unsure = table(by_filter(sample, "id", again).join(first, "id").select("y", "folded"))
    once = by_filter(sample, "id", again, known=False).select("y", "folded").unionByName(unsure)
    total = once.agg(F.sum("y"), F.count("*")).first()
    toxic, rows = int(total[0] or 0), int(total[1])
    learned: dict[str, float] = {}
    if 0 < toxic < rows:
        often = once.where("y = 1").mapInArrow(_count, "w string, n long").groupBy("w").agg(F.sum("n").alias("t")).where(F.col("t") >= max(5, math.ceil(least_share * toxic)))
        # at most 200 times as many as a toxic text has on average, however many texts there are
        often = {r["w"]: r["t"] for r in often.collect()}
        among = frozenset(often)
        counts = once.mapInArrow(lambda b: _count(b, among), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        counts = {r["w"]: r["n"] for r in counts.collect()}
        clean = rows - toxic + 1.0
        for w, t in sorted(often.items(), key=lambda i: (-i[1], i[0])):
            # two standard errors below the estimate must still be odds of 8
            odds = math.log((t + 0.5) / (toxic + 1.0)) - math.log((counts[w] - t + 0.5) / clean) - math.sqrt(1 / (t + 0.5) + 1 / clean)
            if odds >= math.log(8) and len(learned) < most_words:
                learned[w] = min(odds, 6.0)
    # an entry says nothing new beside a stem of it that is nearly as telling
    told = lambda w: any(learned.get(w[:k] + "*", 0.0) >= 0.75 * learned[w] for k in STEMS if k < len(w.rstrip("*")))
    weights = {fold(s).strip(): SEED_WEIGHT for s in SEEDS} | {w: x for w, x in learned.items() if not told(w)}
    model = Model(weights, EXCEPTIONS)

    def sums(batches):
        a = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([_folded_feature(a, t.as_py())[0] for t in batch.column("folded")], pa.float64())], names=["y", "x"])

    seen = table(sample.select("y", "folded").mapInArrow(sums, "y int, x double").groupBy("x").agg(F.sum("y").alias("t"), F.count("*").alias("n")))
    _calibrate(model, seen)
    drop_tables(sample, first, again, unsure, seen)
    return model


def _count(batches, among: frozenset[str] | None = None, most: int = 100_000):
    """Document frequencies of words and stems (of those in among), given out whenever there are many, to bound memory."""
    from collections import Counter

    def found(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["w", "n"])

    rows = Counter()
    for batch in batches:
        for text in batch.column("folded"):
            words = {w for w in text.as_py().split() if 3 <= len(w) <= 30}
            own = {*words, *(w[:k] + "*" for w in words for k in STEMS if k < len(w))}
            rows.update(own if among is None else own & among)
            if len(rows) >= most:
                yield found(rows)
                rows = Counter()
    yield found(rows)


def hash63(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def _calibrate(model: Model, seen: DataFrame) -> None:
    """Two-parameter logistic regression by Newton steps with a small ridge, each a pass over (x, t, n): n texts of a sum x, t of them toxic."""
    toxic, rows = seen.agg(F.sum("t"), F.sum("n")).first()
    if not toxic or toxic == rows:
        model.slope, model.intercept = 2.0, -2.0
        return
    b, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    x, n = F.col("x"), F.col("n")
    for _ in range(50):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x * F.lit(float(b[0])) + F.lit(float(b[1]))))
        p = 1 / (1 + F.exp(-z))
        miss, w = F.col("t") - n * p, n * (p * (1 - p) + F.lit(1e-9))
        # sums of decimals are the same in any order
        sums = seen.agg(*(F.sum(c.cast("decimal(38,18)")) for c in (miss * x, miss, w * x * x, w * x, w))).first()
        gx, g, hxx, hx, h = map(float, sums)
        step = np.linalg.solve(np.array([[hxx, hx], [hx, h]]) + ridge, np.array([gx, g]) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.intercept = max(float(b[0]), 1e-6), float(b[1])


def _features(batches, model: Model):
    a = model.automaton()
    for batch in batches:
        got = [feature(a, t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([x for x, _ in got], pa.float64()), pa.array([h for _, h in got], pa.int32())], names=["id", "y", "x", "hits"])


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int | None = None) -> DataFrame:
    """Scores every whole text. Returns id_col, held_out, score, hits (lexicon matches).

    The model is fitted on all labelled rows outside the held-out third (crc32(id as text) mod 3 = 1),
    or on sample_rows of them. Null and empty texts have no matches and get the lowest score.
    Rows with a null id are scored and not held out. Repeated rows are scored each, by their own
    texts; of a labelled id with several texts one is learned from, and it is toxic if any of its
    labels says so. Texts of any length are matched whole. With no usable labels, or an empty table,
    the seed words alone decide. Other columns, whatever their names, are not looked at.
    """
    model = fit(training_sample(df, labels, id_col, text_col, label_col, sample_rows))
    return apply(df, model, id_col, text_col)


def apply(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores with a fitted model: id_col, held_out, score, hits."""

    def run(batches):
        for b in _features(batches, model):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column("x").to_numpy()), pa.float64()), b.column("hits")], names=["id", "score", "hits"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.lit(0).alias("y"), F.col(text_col).cast("string").alias("text"))
    out = docs.mapInArrow(run, "id long, score double, hits int")
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "hits")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of df, all columns, whose text scores below threshold. Null texts stay."""

    def run(batches):
        a = model.automaton()
        for batch in batches:
            x = np.array([feature(a, t.as_py())[0] for t in batch.column(text_col)], dtype=float)
            yield batch.filter(pa.array(model.score(x) < threshold, pa.bool_()))

    return df.mapInArrow(run, df.schema)
