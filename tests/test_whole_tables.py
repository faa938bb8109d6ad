"""Queries over the whole of small tables, against SQL or plain versions."""

import json
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folium.functions.similarity import indel, pair_up, plain
from folium.operators import matching
from folium.plans import catalogue


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(df, columns):
    return sorted(tuple(shown(r[c]) for c in columns) for r in df.select(*columns).collect())


@pytest.mark.parametrize("files", [1, 5])
def test_stream_ingest_reads_every_file(spark, tmp_path, files):
    events = [(i, f"u{i % 7}", f"t{i % 3}", float(i), "{}") for i in range(60)]
    df = spark.createDataFrame(events, "event_id long, user_id string, event_type string, value double, props string")
    df.repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLES["stream_ingest"]).fetchall()
    got = rows(catalogue.QUERIES["stream_ingest"](spark, str(tmp_path)), ["event_type", "n", "users"])
    assert got == sorted(tuple(shown(x) for x in r) for r in want) and sum(int(r[1]) for r in got) == 60


def test_edit_similarity_deals_pairs_not_rows(spark, tmp_path):
    """A group of a small table has millions of pairs: they are made by several tasks, in tiles, and are those of the SQL."""
    rows = [(k, None if k == 7 else f"name {k * k % 97}", "b", 1) for k in range(4000)] + [(k, "x", f"c{k}", k % 3) for k in range(4000, 4100)] + [(None, "y", "b", 1), (5000, "z", None, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["edit_similarity"](spark, str(tmp_path))
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 1 and sum(tasks) == 4000 * 3999 // 2
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    summed = "count(*), count(edits), sum(edits), sum(edits * ((a * 7 + b * 31) % 1009))"
    want = con.execute(f"select {summed} from ({catalogue.ORACLES['edit_similarity']})").fetchone()
    tiled = matching.edit_pairs(spark.read.parquet(f"{tmp_path}/part.parquet"), "p_partkey", "p_name", "p_brand", "p_size", tile=100, task_pairs=1_000_000)
    for df in (got, tiled):
        assert tuple(df.selectExpr(*(x + f" as c{i}" for i, x in enumerate(summed.split(", ")))).first()) == tuple(map(int, want))
        assert df.where("a >= b").isEmpty()


def test_split_sinks_with_over_a_thousand_batches(spark, tmp_path):
    """Numbers of four digits: folders of their own, counted as the SQL counts them."""
    from folium.plans import roundtrips  # noqa: F401  adds its queries

    docs = spark.range(70 * 1001 + 5).selectExpr("id as doc_id", "if(id % 3 = 0, 'en', 'de') as lang", "concat('s', id % 5) as source", "'t' as text", "1L as n_chars")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0,)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalogue.ORACLES["split_sinks"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["split_sinks"](spark, str(tmp_path)).collect())
    # batches 100, 1000, 1001 and the rest
    assert got == want and ("batches", "batch_100", 3 * 70 + 5) in got


def plain_iou(source, target):
    """IoU of two lists of texts, and each source's nearest target from 90 per cent on."""
    near = {}
    for i, a in enumerate(source):
        score, j = max(((indel(a, b), -j) for j, b in enumerate(target)), default=(0, 0))
        if score >= 0.9:
            near[i] = -j
    whole = len(source) + len(target) - len(set(near.values()))
    return (len(near) / whole if whole else None), near


def test_completion_rewards_scores_every_order(spark, tmp_path):
    orders = [(k, 1000 + 37 * k % 11, ["1-URGENT", "5-LOW"][k % 2]) for k in range(1, 101)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for key, cust, priority in orders:
        answer = [{"name": f"Person {cust}", "affiliations": [priority]}]
        said = "no answer" if key % 3 == 0 else "</think> " + json.dumps(answer)
        if "</think>" not in said:
            want.append((key, 0, 0.0))
            continue
        got = json.loads(said.split("</think> ")[1])
        total, near = plain_iou([a["name"] for a in got], [a["name"] for a in answer])
        total += sum(plain_iou(got[i]["affiliations"], answer[j]["affiliations"])[0] for i, j in near.items())
        want.append((key, 1, total))
    df = catalogue.QUERIES["completion_rewards"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == want


def test_evaluate_entities_takes_every_user_turn(spark, tmp_path):
    turns = []
    for c in range(10):
        for k in range(3 + c % 4):
            said = f"The same words {c} {k // 2}. Only {'user asks' if k % 2 == 0 else 'model says'} this {k}.\nNearly equal sentence numbr{'' if k % 2 else 's'} {k // 2}"
            turns.append((c, 2 * k + 1, "assistant" if k % 2 else "user", said))
        turns.append((c, 0, "system", "Be brief."))
    turns += [(3, 50, "user", "Asked twice. Once"), (3, 51, "user", "Asked twice"), (3, 52, "tool", "Asked twice"), (3, 53, "assistant", "Asked twice.")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sentences = lambda s: [plain(x) for x in re.split(r"[.\n]+", s) if x.strip()]
    want = {"strict": Counter(), "fuzzy": Counter()}
    talk = sorted(x for x in turns if x[2] in ("user", "assistant"))
    for (c, _, role, said), (d, _, next_role, answer) in zip(talk, talk[1:], strict=False):
        if c != d or (role, next_role) != ("user", "assistant"):
            continue
        g, p = Counter(sentences(said)), Counter(sentences(answer))
        n = {"strict": (g & p).total()}
        n["fuzzy"] = n["strict"] + len(pair_up(sorted((g - p).elements()), sorted((p - g).elements()), 0.8))
        for mode, tp in n.items():
            want[mode].update(tp=tp, fp=p.total() - tp, fn=g.total() - tp)
    got = catalogue.QUERIES["evaluate_entities"](spark, str(tmp_path)).where("category like 'entity:%'").collect()
    assert {r["mode"]: {k: r[k] for k in ("tp", "fp", "fn")} for r in got} == {mode: dict(n) for mode, n in want.items()}
    assert want["fuzzy"]["tp"] > want["strict"]["tp"] > 10
