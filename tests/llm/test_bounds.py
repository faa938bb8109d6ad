"""Parameters out of bounds, columns of a user's own, rows without an id, and copies in learning."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm.embedding_dedup import near_vectors
from folium.llm.minhash_dedup import near_documents
from folium.llm.substring_dedup import dedup_substrings
from folium.llm.toxicity import hash63


def test_parameters_that_would_lose_links_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c", [1.0])], "doc_id long, text string, v array<double>")
    for percent in (0, 79, 101):
        with pytest.raises(ValueError):
            near_documents(df, percent=percent)
    for threshold in (0.5, 0.89, 1.01):
        with pytest.raises(ValueError):
            near_vectors(df, "doc_id", "v", threshold)


def test_rows_without_an_id_keep_all_words_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text)] + [(None, text)] * 5 + [(None, None), (None, " ")]
    got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == sorted([("1", 30, 0, text), ("2", 30, 30, ""), *[("None", 30, 0, text)] * 5, ("None", 0, 0, ""), ("None", 0, 0, "")])


def test_unlike_texts_have_unlike_smallest_hashes():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(2000)]
    least = set()
    for _ in range(300):
        w = rng.choice(words, 1000)
        least.add(min(hash63(" ".join(w[i : i + 6])) for i in range(995)))
    assert len(least) == 300


def test_stages_keep_own_columns_of_any_name(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"some words of document {i}\nline", "en", f"s{i % 3}", 10, f"mine {i}", i, 0.5, f"x{i}", i * 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _topic string, _n_lines int, _probability double, _topic_ string, _tokens int")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.mixing):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.join(docs, [c for c in docs.columns if c not in ("text", "n_chars")], "left_anti").count() == 0
    assert corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).where(F.col("_topic") == F.concat(F.lit("mine "), "doc_id")).count() == 30


def test_partitions_follow_the_input(spark, tmp_path):
    from folium.llm.common import partition_count

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(100_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert partition_count(df, 100_000) == size // 100_000 > few
    assert partition_count(df, 1 << 40) == few == partition_count(spark.range(10))


def test_topics_are_fitted_on_all_texts(spark):
    """Means, spreads and centres are those of every different text, however many there are and however rows are dealt."""
    from folium.llm import mixing

    rng = np.random.default_rng(5)
    rows = [(" ".join(f"{'abc'[i % 3]}{rng.integers(40)}" for _ in range(30)), ["en", "de"][i % 2]) for i in range(2600)]
    df = spark.createDataFrame(rows + rows[:500] + [(" ", "en"), (None, "de")], "text string, lang string")
    model, again = mixing.fit_topics(df, topics=3), mixing.fit_topics(df.repartition(7), topics=3)
    assert (model.centres == again.centres).all() and (model.mean == again.mean).all() and (model.spread == again.spread).all()
    x, lang = mixing.text_features(pa.array([t for t, _ in rows])), np.array([k for _, k in rows])
    z = x - np.stack([x[lang == k].mean(axis=0) for k in lang])
    assert abs(model.mean - x.mean(axis=0)).max() < 1e-5 and abs(model.means["de"] - x[lang == "de"].mean(axis=0)).max() < 1e-5
    spread = np.maximum(z.std(axis=0), 1e-6)
    assert abs(model.spread / spread - 1).max() < 1e-3
    names = np.array(model.names(pa.array([t for t, _ in rows]), lang.tolist()))
    z = z / spread
    for k in range(3):
        assert abs(model.centres[k] - z[names == f"t{k}"].mean(axis=0)).max() < 1e-2
    assert len({(n, t[0]) for n, (t, _) in zip(names, rows, strict=True)}) == 3
    assert mixing.fit_topics(df.limit(0)).names(pa.array(["a"]), ["en"]) == ["none"]


def test_very_many_languages_share_factors(spark, monkeypatch):
    from folium.llm import mixing

    monkeypatch.setattr(mixing, "MOST_LANGS", 3)
    rows = [(i, "some words of a text", f"s{i % 2}", f"l{i % 3}" if i < 300 else f"junk{i}") for i in range(340)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"lang": {"l0": 0.5, "junk300": 0.01}}
    out = mixing.mix_sources(df, targets=targets, topics=mixing.fit_topics(df), keep=0.5).collect()
    assert len(out) == 340 and all(r._probability is not None and 0 < r._probability <= 1 for r in out)
    # rare ones are one language, a named one is its own
    rare = {(r.source, r._topic, r._probability) for r in out if r.lang.startswith("junk") and r.lang != "junk300"}
    assert len(rare) == len({(s, t) for s, t, _ in rare})
    expected = sum(r._probability * r._tokens for r in out)
    assert abs(expected - 0.5 * sum(r._tokens for r in out)) < 0.05 * expected


def test_toxicity_is_learned_from_all_labelled_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    ids = spark.range(31_500).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 3).alias("third"))
    learned = [r["doc_id"] for r in ids.where("third != 1").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    late = learned[20_000:]
    assert len(late) > 500
    # the only toxic ids with labels come after twenty thousand others in the order of a hash
    toxic = sorted(late[::2]) + [r["doc_id"] for r in ids.where("third = 1").limit(50).collect()]
    bad = F.col("doc_id").isin(toxic)
    docs = ids.select("doc_id", F.concat(F.lit("q"), F.col("doc_id"), F.when(bad, " zorkel").otherwise(" plain")).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    ids.select("doc_id", bad.cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.count() == 31_500 - len(toxic) and kept.where(F.col("text").contains("zorkel")).count() == 0


def test_toxicity_shuffles_few_texts(spark, tmp_path):
    from folium.llm import toxicity as tox

    # texts that don't compress; every eighth has a label, and a few of those are copies
    ids = spark.range(8000).select(F.col("id").alias("doc_id"))
    some = F.when(F.col("doc_id") % 400 == 0, F.lit(0)).otherwise(F.col("doc_id"))
    text = F.concat_ws(" ", *(F.sha2(F.concat(some.cast("string"), F.lit(f"/{k}")).cast("binary"), 512) for k in range(10)), F.when(F.col("doc_id") % 3 == 0, "zorkel"))
    ids.select("doc_id", text.alias("text")).write.parquet(str(tmp_path / "docs"))
    ids.where("doc_id % 8 = 0").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).write.parquet(str(tmp_path / "labels"))
    docs, labels = (spark.read.parquet(str(tmp_path / name)) for name in ("docs", "labels"))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, usual = sent(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = tox.fit(tox.training_sample(docs, labels, "doc_id", "text", "toxic"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert any(w.startswith("zork") for w in model.weights)
    # two in three of the texts stand outside the held-out third, one in twelve has a label besides
    assert sent() - before < 0.25 * docs.agg(F.sum(F.length("text"))).first()[0]


def test_id_filter(spark, monkeypatch):
    from folium.llm import common, toxicity as tox

    rows, ids = spark.range(-3000, 3000), spark.range(-3000, 3000, 3)
    bitmap = common.id_filter(ids, "id")
    some, rest = common.by_filter(rows, "id", bitmap), common.by_filter(rows, "id", bitmap, known=False)
    assert some.join(ids, "id", "left_anti").count() < 10 and ids.join(some, "id", "left_anti").count() == 0
    assert some.count() + rest.count() == 6000 and some.join(rest, "id").count() == 0
    assert common.by_filter(rows, "id", common.id_filter(ids.limit(0), "id"), known=False).count() == 6000
    # copies, some of them toxic, repeated ids, and labels without texts
    docs = spark.range(1200).select("id", F.concat(F.lit("one two three four five six "), (F.col("id") % 300).cast("string"), F.when(F.col("id") % 5 == 0, " grumpf").otherwise(" plain")).alias("text"))
    docs = docs.unionByName(docs.where("id < 50").withColumn("text", F.lit("another")))
    labels = spark.range(0, 2400, 2).select("id", (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    fitted = lambda: tox.fit(tox.training_sample(docs, labels, "id", "text", "toxic"))
    model = fitted()
    # a filter that knows everything changes nothing
    monkeypatch.setattr(common, "FILTER_BLOCKS", 1)
    monkeypatch.setattr(common, "BLOCK_WORDS", 1)
    assert common.by_filter(rows, "id", common.id_filter(ids, "id")).count() == 6000
    assert fitted() == model and any(w.startswith("grum") for w in model.weights)
