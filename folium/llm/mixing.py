"""Sampling of documents so that sources, languages and topics meet target shares of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_tables, mix, slices, span_hashes, table, text_buffer, word_spans

NULL, RARE = "\u0000null", "\u0000rare"
#: Languages that have a factor of their own.
MOST_LANGS = 1024
#: Topics, and hashed word counts that describe a text.
TOPICS, FEATURES = 8, 128
#: Parts of one in features that are kept, and in standardised ones that are summed.
UNIT, Z_UNIT = 32767, 1 << 20
#: Texts that are tried as each topic's first centre.
SEEDS = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: one for every four bytes, and one for an end mark."""
    return (F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4) + 1).cast("double")


def text_features(texts: pa.Array) -> np.ndarray:
    """Signed hashed word counts of whole texts, as unit rows; zero for a text without words."""
    buf, off = text_buffer(texts)
    out = np.zeros((len(texts), FEATURES))
    for a, b in slices(off):
        part = _LOWER[buf[off[a] : off[b]]]
        starts, ends, first = word_spans(part, off[a : b + 1] - off[a])
        h = mix(span_hashes(part, starts, ends))
        owner = np.repeat(np.arange(b - a), np.diff(first))
        sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
        out[a:b] = np.bincount(owner * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64), weights=sign, minlength=(b - a) * FEATURES).reshape(b - a, FEATURES)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-12)


class Topics:
    """Clusters of texts by their words, on features of equal spread.

    Features are taken from their language's mean first, so that topics aren't languages; a language
    that isn't in means has the mean of all.
    """

    def __init__(self, mean: np.ndarray, means: dict[str, np.ndarray], spread: np.ndarray, centres: np.ndarray):
        self.mean, self.means, self.spread, self.centres = mean, means, spread, centres

    def centred(self, x: np.ndarray, langs: pa.Array) -> np.ndarray:
        at = pc.index_in(langs, pa.array(list(self.means), pa.string())).fill_null(len(self.means)).to_numpy(zero_copy_only=False)
        return (x - np.stack([*self.means.values(), self.mean])[at]) / self.spread

    def distances(self, z: np.ndarray) -> np.ndarray:
        """Squared distances to each centre; a row's don't depend on what rows are beside it."""
        return np.stack([((z - c) ** 2).sum(axis=1) for c in self.centres])

    def nearest(self, z: np.ndarray) -> np.ndarray:
        return self.distances(z).argmin(axis=0)

    def names(self, texts: pa.Array, langs: list[str]) -> list[str]:
        """The topic of each text: t0 (the largest among those fitted on), t1, ..., or none for a text without words."""
        x = np.rint(text_features(texts) * UNIT) / UNIT
        empty = ~x.any(axis=1) | (len(self.centres) == 0)
        own = self.nearest(self.centred(x, pa.array(langs, pa.string()))) if len(self.centres) and len(x) else np.zeros(len(x), int)
        return ["none" if e else f"t{k}" for e, k in zip(empty, own, strict=True)]


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


def _described(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(t, lang, x) of each different text that has words: its hash, the smallest of its languages, and its features as 16-bit numbers."""
    named = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), _value(lang_col).alias("lang")).withColumn("t", F.xxhash64("text"))

    def describe(batches):
        for batch in batches:
            x = np.rint(text_features(batch.column("text")) * UNIT).astype("<i2")
            some = np.flatnonzero(x.any(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(some)), batch.column("lang").take(pa.array(some)), pa.array([r.tobytes() for r in x[some]], pa.binary())], names=["t", "lang", "x"])

    return table(named.mapInArrow(describe, "t long, lang string, x binary").groupBy("t").agg(F.min("lang").alias("lang"), F.first("x").alias("x")))


def _features(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i2").reshape(-1, FEATURES)


def _spreads(rows: DataFrame) -> Topics:
    """Means by language (of the MOST_LANGS with most texts), the mean of all, and spreads about them; without centres."""
    heavy = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS + 1).collect()]
    lang = F.when(F.col("lang").isin(heavy[:MOST_LANGS]), F.col("lang")) if len(heavy) > MOST_LANGS else F.col("lang")

    def run(batches):
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            x, codes = _features(batch.column("x")).astype(np.int64), batch.column("lang").dictionary_encode("encode")
            for k, own in enumerate(codes.dictionary.to_pylist()):
                some = x[codes.indices.to_numpy() == k]
                sums[own] = sums.get(own, 0) + np.stack([np.full(FEATURES, len(some)), some.sum(axis=0), (some**2).sum(axis=0)])
        for own, (n, s, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([own] * FEATURES, pa.string()), pa.array(range(FEATURES), pa.int32()), pa.array(n), pa.array(s), pa.array(q)], names=["lang", "k", "n", "s", "q"])

    # sums of whole numbers, so that they are the same in any order; a row for each language and feature
    totals = rows.select(lang.alias("lang"), "x").mapInArrow(run, "lang string, k int, n long, s long, q long").groupBy("lang", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    totals.sort(key=lambda r: (r["lang"] is not None, r["lang"] or "", r["k"]))
    if not totals:
        return Topics(np.zeros(FEATURES), {}, np.ones(FEATURES), np.zeros((0, FEATURES)))
    n, s, q = (np.array([float(r[c]) for r in totals]).reshape(-1, FEATURES) / f for c, f in (("n", 1), ("s", UNIT), ("q", UNIT**2)))
    own, whole, mean = [r["lang"] for r in totals[::FEATURES]], n.sum(axis=0), s.sum(axis=0) / n.sum(axis=0)
    m = np.stack([mean if v is None else s[k] / n[k] for k, v in enumerate(own)])
    spread = (q - 2 * m * s + n * m**2).sum(axis=0) / whole - ((s - n * m).sum(axis=0) / whole) ** 2
    return Topics(mean, {v: m[k] for k, v in enumerate(own) if v is not None}, np.maximum(np.sqrt(np.maximum(spread, 0)), 1e-6), np.zeros((0, FEATURES)))


def _seed(rows: DataFrame, model: Topics) -> np.ndarray:
    """A text as a further centre: of some texts, from near the centres to far from them, the one that leaves all texts nearest to a centre."""
    near = lambda z: model.distances(z).min(axis=0) if len(model.centres) else (z**2).sum(axis=1)

    def run(batches):
        seen: dict[int, tuple] = {}
        for batch in batches:
            far = near(model.centred(_features(batch.column("x")) / UNIT, batch.column("lang")))
            t, bins = batch.column("t").to_numpy(), np.floor(np.log2(1 + far) * 32).astype(int)
            for b in np.unique(bins).tolist():
                some = np.flatnonzero(bins == b)
                k = int(some[t[some].argmin()])
                new = (int(t[k]), batch.column("lang")[k].as_py(), batch.column("x")[k].as_py())
                n, old = seen.get(b, (0, new))
                seen[b] = n + len(some), min(old, new)
        found = [{"b": b, "n": n, "t": t, "lang": lang, "x": x} for b, (n, (t, lang, x)) in seen.items()]
        yield pa.RecordBatch.from_pylist(found, pa.schema([("b", pa.int32()), ("n", pa.int64()), ("t", pa.int64()), ("lang", pa.string()), ("x", pa.binary())]))

    # a row for each thirty-second power of two that a distance has, so two thousand at most
    bins = rows.mapInArrow(run, "b int, n long, t long, lang string, x binary").groupBy("b").agg(F.sum("n").alias("n"), F.min(F.struct("t", "lang", "x")).alias("first")).collect()
    bins.sort(key=lambda r: r["b"])
    below = np.cumsum([r["n"] for r in bins])
    at = np.unique(np.searchsorted(below, (2 * np.arange(SEEDS) + 1) * below[-1] // (2 * SEEDS), "right"))
    first = [bins[k]["first"] for k in at]
    tried = Topics(model.mean, model.means, model.spread, model.centred(_features(pa.array([bytes(r["x"]) for r in first])) / UNIT, pa.array([r["lang"] for r in first])))

    def left(batches):
        total = np.zeros(len(tried.centres), np.int64)
        for batch in batches:
            z = tried.centred(_features(batch.column("x")) / UNIT, batch.column("lang"))
            d = tried.distances(z)
            total += np.rint((np.minimum(d, near(z)) if len(model.centres) else d) * UNIT).astype(np.int64).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["d"])

    # a row for each task
    sums = [np.frombuffer(r["d"], np.int64) for r in rows.select("lang", "x").mapInArrow(left, "d binary").collect()]
    return tried.centres[int(np.sum(sums, axis=0).argmin())]


def _moved(rows: DataFrame, model: Topics) -> tuple[np.ndarray, np.ndarray]:
    """The means of the texts nearest to each centre (its own place, if there are none), and their number."""
    shape = model.centres.shape

    def run(batches):
        sums, size = np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
        for batch in batches:
            z = model.centred(_features(batch.column("x")) / UNIT, batch.column("lang"))
            near, whole = model.nearest(z), np.rint(z * Z_UNIT).astype(np.int64)
            for k in range(shape[0]):
                sums[k] += whole[near == k].sum(axis=0)
            size += np.bincount(near, minlength=shape[0])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([size.tobytes()], pa.binary())], names=["s", "n"])

    # a row for each task; whole numbers again
    got = rows.select("lang", "x").mapInArrow(run, "s binary, n binary").collect()
    sums, size = (sum((np.frombuffer(r[c], np.int64) for r in got), np.zeros(length, np.int64)) for c, length in (("s", shape[0] * shape[1]), ("n", shape[0])))
    return np.where(size[:, None] > 0, sums.reshape(shape) / Z_UNIT / np.maximum(size, 1)[:, None], model.centres), size


def fit_topics(df: DataFrame, text_col: str = "text", lang_col: str = "lang", topics: int = TOPICS, rounds: int = 25) -> Topics:
    """Topics of all different texts: k-means, each round a pass over their features.

    Features are written once, 256 bytes a text. Tasks send sums of whole numbers, so the topics
    don't depend on how rows are dealt. No texts with words give no topics.
    """
    rows = _described(df, text_col, lang_col)
    model = _spreads(rows)
    for _ in range(min(topics, rows.count())):
        model.centres = np.vstack([model.centres, _seed(rows, model)])
    for k in range(rounds + 1 if len(model.centres) else 0):
        new, size = _moved(rows, model)
        if k == rounds or np.allclose(new, model.centres):
            model.centres = model.centres[np.argsort(-size, kind="stable")]
            break
        model.centres = new
    drop_tables(rows)
    return model


def rake(cells: DataFrame, dims: tuple[str, ...], targets: dict[str, dict[str, float]] | None = None, temperature: float = 0.7, tolerance: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Iterative proportional fitting of cells (dims..., w): adds x, whose sums by each dimension meet its targets.

    targets: share of each value by dimension; values that a dimension's targets don't name keep
    their own share, and shares are scaled to sum to one over the values present. A dimension
    without targets gets its own shares to the power of temperature. Cells without weight stay so.
    Ends when no marginal is off by more than tolerance, as a share, when rounds bring it no nearer,
    as with targets that contradict each other or need cells that don't exist, or after `rounds`.
    No cells give no rows.

    The first dimension may have any number of values: each is a row with its cells, which tasks
    scale to its target. The others' factors are kept on the driver, to which each task sends one
    sum for each combination of their values; these are few (languages and topics).
    """
    head, *rest = dims
    named = lambda d, own: [float((targets or {})[d].get(v, o)) for v, o in own.items()] if (targets or {}).get(d) is not None else [o**temperature for o in own.values()]
    rows = table(cells.groupBy(head).agg(F.collect_list(F.struct(*rest, "w")).alias("cells"), F.sum("w").alias("own")))
    sums = rows.select(F.explode("cells").alias("c")).select("c.*").groupBy(*rest).agg(F.sum("w").alias("w")).collect()  # a row for each combination
    whole = sum(r["w"] for r in sums) or 1.0
    values = [sorted({r[d] for r in sums}) for d in rest]
    own = [{v: sum(r["w"] for r in sums if r[d] == v) / whole for v in vs} for d, vs in zip(rest, values, strict=True)]
    wanted = [np.array(named(d, o)) for d, o in zip(rest, own, strict=True)]
    wanted = [t / (t.sum() or 1.0) for t in wanted]
    share = F.col("own") / F.lit(whole)
    if (targets or {}).get(head) is None:
        want = F.pow(share, F.lit(temperature))
    else:
        pairs = [F.lit(v) for item in targets[head].items() for v in (item[0], float(item[1]))]
        want = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(head)), share) if pairs else share
    rows = rows.select(head, "cells", want.alias("t"))
    scale = rows.agg(F.sum("t")).first()[0] or 1.0
    shape = tuple(map(len, values))

    def fitted(batch, factors):
        """The batch's cells: row, position in each other dimension, weight and fitted weight."""
        lists = batch.column("cells")
        flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = [pc.index_in(flat.field(k), pa.array(vs, pa.string())).to_numpy(zero_copy_only=False) for k, vs in enumerate(values)]
        w = flat.field(len(rest)).to_numpy(zero_copy_only=False)
        x = w.copy()
        for f, i in zip(factors, at, strict=True):
            x = x * f[i]
        size = np.bincount(row, x, minlength=len(lists))
        x = x * np.divide(batch.column("t").to_numpy() / scale, size, out=np.zeros(len(size)), where=size > 0)[row]
        return flat, row, at, w, x

    def step(factors):
        def run(batches):
            out = np.zeros(shape)
            for batch in batches:
                *_, at, _, x = fitted(batch, factors)
                np.add.at(out, tuple(at), x)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1))], names=["x"]) if out.size else pa.RecordBatch.from_arrays([pa.array([], pa.float64())], names=["x"])

        got = np.array([r["x"] for r in rows.select("cells", "t").mapInArrow(run, "x double").collect()])
        return got.reshape(-1, *shape).sum(axis=0) if got.size else np.zeros(shape)

    factors, before = [np.ones(n) for n in shape], float("inf")
    for k in range(rounds if sums else 0):
        m = step(factors)
        others = lambda d, m=m: tuple(i for i in range(len(shape)) if i != d)
        now = max(float(np.abs(m.sum(axis=others(d)) - t).max()) for d, t in enumerate(wanted))
        if now <= tolerance or (k > 5 and now > 0.98 * before):
            break
        before = now
        for d, t in enumerate(wanted):
            have = m.sum(axis=others(d))
            ratio = np.divide(t, have, out=np.zeros(len(t)), where=have > 0)
            factors[d] = factors[d] * ratio
            m = m * ratio.reshape([-1 if i == d else 1 for i in range(len(shape))])

    def final(batches):
        for batch in batches:
            flat, row, _, w, x = fitted(batch, factors)
            yield pa.RecordBatch.from_arrays([batch.column(head).take(pa.array(row)), *(flat.field(k) for k in range(len(rest))), pa.array(w), pa.array(x)], names=[*dims, "w", "x"])

    return rows.mapInArrow(final, ", ".join(f"{d} string" for d in dims) + ", w double, x double")


def _rate(raked: DataFrame, keep: float | None) -> float:
    """The factor from ratios to probabilities; for `keep`, solved on sums of cells of nearly equal ratio."""
    if keep is None:
        return 1.0 / (raked.agg(F.max("ratio")).first()[0] or 1.0)
    # a row for each sixteenth power of two that occurs, so a few thousand at most
    bins = raked.where("ratio > 0 and w > 0").groupBy(F.floor(F.log2("ratio") * 16).alias("b")).agg(F.sum("w").alias("w"), F.sum("x").alias("x")).collect()
    bins.sort(key=lambda r: -r["x"] / r["w"])
    wanted, free, rate = keep * sum(r["w"] for r in bins), sum(r["x"] for r in bins), 1.0
    for r in bins:  # while the bin of the largest ratio is needed whole, take it so
        rate = wanted / free if free > 0 else rate
        if rate * r["x"] < r["w"]:
            break
        wanted, free = wanted - r["w"], free - r["x"]
    return rate


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, temperature: float = 0.7, seed: int = 17, topics: Topics | None = None, keep: float | None = None) -> DataFrame:
    """Samples documents with probabilities whose expected tokens have the target marginals.

    Returns all columns of df and _topic, _tokens, _probability, _sampled, which replace columns of
    those names. targets has the dimensions source, lang and topic (see rake). The topic is a
    cluster of the whole text's words, as against others of its language, fitted on all texts
    unless topics are given,
    and named t0, t1, ... A document's probability is its cell's raked weight over its tokens, scaled
    so that the largest is 1. With `keep`, it is scaled so that about that share of all tokens is
    expected instead; cells that would be needed more than once are then kept whole, and the
    marginals are missed by what they lack. A document is sampled if a hash of its id (or, without
    one, of its text) falls below its probability, so a rerun samples the same. Null sources and languages are values of their
    own, named "\\u0000null" in targets; null, empty and blank texts have the topic none, and null
    texts count one token. Of more than MOST_LANGS languages only those with most tokens, and those
    that targets name, are languages of their own; the others are one, named "\\u0000rare". Texts of any length are read whole. Repeated rows are sampled alike. An
    empty table gives an empty result. The totals of the cells, never documents, are what is raked.
    """
    added = ("_topic", "_tokens", "_probability", "_sampled")
    own = [c for c in df.columns if c not in added]
    model = topics or fit_topics(df, text_col, lang_col)

    def name(batches, lang):
        for batch in batches:
            langs = batch.column(lang).cast(pa.string()).fill_null(NULL).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.names(batch.column(text_col).cast(pa.string()), langs), pa.string())], names=[*batch.schema.names, "_topic"])

    rows = df.select(*(F.col(f"`{c}`") for c in own))
    dims = ("source", "lang", "topic")
    cells = rows.select(F.col(text_col), _value(source_col).alias("_source"), _value(lang_col).alias("_lang"), tokens(F.col(text_col)).alias("_n"))
    cells = cells.mapInArrow(lambda b: name(b, "_lang"), T.StructType([*cells.schema.fields, T.StructField("_topic", T.StringType())]))
    cells = cells.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_n").alias("w"))
    # factors of languages are kept on the driver, so there is a bound to how many have one of their own
    cells = table(cells)
    heavy = cells.groupBy("lang").agg(F.sum("w").alias("w")).orderBy(F.desc("w"), "lang").limit(MOST_LANGS + 1).collect()
    common = sorted({r["lang"] for r in heavy[:MOST_LANGS]} | set((targets or {}).get("lang") or {}))
    folded = (lambda c: F.when(c.isin(common), c).otherwise(RARE)) if len(heavy) > MOST_LANGS else (lambda c: c)
    if len(heavy) > MOST_LANGS:
        cells = cells.groupBy("source", folded(F.col("lang")).alias("lang"), "topic").agg(F.sum("w").alias("w"))
    raked = rake(cells, dims, targets, temperature, tolerance=1e-5).withColumn("ratio", F.col("x") / F.col("w"))
    rate = _rate(raked, keep)
    # sums of floating-point numbers depend on their order in the last digits
    chance = raked.select(*dims, F.round(F.least(F.lit(1.0), F.col("ratio") * F.lit(rate)), 10).alias("p"))
    # the row travels as one struct, so that none of its columns can clash with those added
    out = rows.mapInArrow(lambda b: name(b, lang_col), T.StructType([*rows.schema.fields, T.StructField("_topic", T.StringType())]))
    out = out.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), _value(source_col).alias("source"), folded(_value(lang_col)).alias("lang"), F.col("_topic").alias("topic"), tokens(F.col(text_col)).alias("n"))
    out = out.join(chance, list(dims), "left")
    ident = F.col(f"row.`{id_col}`")
    mark = F.when(ident.isNotNull(), F.xxhash64(F.lit(seed), ident)).otherwise(F.xxhash64(F.lit(seed), F.col(f"row.`{text_col}`")))
    unit = F.shiftrightunsigned(mark, 11) / F.lit(float(1 << 53))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in own), F.col("topic").alias("_topic"), F.col("n").alias("_tokens"), F.col("p").alias("_probability"), (unit < F.col("p")).alias("_sampled"))
