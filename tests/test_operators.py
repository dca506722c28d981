"""Operators whose results SQL doesn't express, and their edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon import services
from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import extraction as X
from quillon.operators import gates, graph, packing, retrieval, runs, sections
from quillon.sources import files
from quillon.streaming import sinks, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_empty_texts(spark):
    null = F.lit(None).cast("string")
    assert one(spark, T.answer_tokens(null)) == [] and one(spark, T.kgrams(null, 8)) == [] and one(spark, T.sentences(null)) == []
    assert one(spark, T.first_sentence(F.lit(""))) == "" and one(spark, T.query_terms(null)) == [] and one(spark, T.token_estimate(null)) == 1
    assert one(spark, S.token_f1(null, F.lit("the"))) == 1.0 and one(spark, S.token_f1(F.lit("x"), null)) == 0.0
    assert one(spark, T.in_domains(null, ("a.b",))) is False


def test_search_expression(spark):
    keywords = F.array(F.lit("heart attack"), F.lit("BRCA-1"), F.lit("--"), F.lit("x"))
    assert one(spark, T.search_expression(keywords)) == "(heart <-> attack) | (brca <-> 1) | x"
    assert one(spark, T.search_expression(keywords, all_of=True)) == "(heart <-> attack) & (brca <-> 1) & x"


def test_dense_topk_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, vector array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, vector array<double>")
    got = [(r["query_id"], r["id"], r["rank"], r["score"]) for r in retrieval.dense_topk(c, q, 4).orderBy("rank").collect()]
    assert got == [(9, 1, 1, 1.0), (9, 4, 2, 1.0), (9, 2, 3, 0.0), (9, 3, 4, 0.0)]
    assert retrieval.dense_topk(c.where("false"), q, 4).count() == 0 and retrieval.dense_topk(c, q.where("false"), 4).count() == 0
    assert one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_every_preset_runs(spark):
    rng = random.Random(0)
    c = spark.createDataFrame([(k, [rng.random(), rng.random()]) for k in range(40)], "id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.2])], "query_id long, vector array<double>")
    for s in retrieval.STRATEGIES.values():
        got = retrieval.hybrid(s, c, q, c.where("id < 20"), c.where("id % 2 = 0"), fused=12, k=5).collect()
        assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_greedy_pack_takes_an_oversize_first_unit(spark):
    u = spark.createDataFrame([(1, 10, 1, 1, 500), (1, 11, 1, 2, 5), (2, 20, 1, 1, 50), (2, 21, 1, 2, 500), (2, 22, 1, 3, 1), (2, 23, 1, 4, 1)], "query_id long, unit_id long, paper_id long, rank long, cost long")
    got = {(r["query_id"], r["unit_id"]) for r in packing.greedy_pack(u, 100, cap=2, overhead=0).collect()}
    assert got == {(1, 10), (2, 20), (2, 22)}


def test_context_is_numbered(spark):
    u = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank long, text string")
    assert packing.assembled(u).first()["context"] == "[1] a\n\n[2] b"


def test_budgets(spark):
    u = spark.createDataFrame([(1, "community", 1, 30), (1, "entity", 1, 30), (1, "entity", 2, 30), (1, "relation", 1, 99)], "query_id long, kind string, rank long, cost long")
    assert {(r["kind"], r["rank"]) for r in packing.mixed_budget(u, 120).collect()} == {("community", 1), ("entity", 1)}
    p = spark.createDataFrame([("positive",), ("neutral",)], "polarity string")
    assert sorted(r["part"] for r in packing.polarity_budgets(p, 100, "yesno").collect()) == [8, 46]


def test_paths_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "source string, target string")
    node = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    found = {tuple(r["nodes"]) for r in graph.paths(e, node("a"), node("c"), 3).collect()}
    assert found == {("a", "c"), ("a", "b", "c")}
    assert {r["node"]: r["component"] for r in graph.components(e, node("a", "z")).collect()} == {"a": "a", "z": "z"}
    assert {r["node"]: r["hop"] for r in graph.neighbours(e, node("a"), 2, "out").collect()} == {"a": 0, "b": 1, "c": 1}
    scored = graph.path_weights(graph.paths(e, node("d"), node("e"), 2), e)
    assert [(r["nodes"], r["score"]) for r in scored.collect()] == [(["d", "e"], 0.8)]


def test_communities(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a in "abc" for b in "abc" if a < b] + [("x", "y", 1.0), ("c", "x", 0.1)], "source string, target string, weight double")
    labels = {r["node"]: r["community"] for r in graph.label_communities(e).collect()}
    assert len({labels[v] for v in "abc"}) == 1 and labels["x"] == labels["y"] != labels["a"]


def test_evidence_units_join_the_next_chunk(spark):
    c = spark.createDataFrame([(1, 1, "positive", 0, "first", 0.1), (1, 1, "positive", 1, "best", 0.9), (1, 2, "neutral", 5, "alone", 0.5)], "paper_id long, section_id long, polarity string, place long, text string, score double")
    assert {r["text"] for r in sections.evidence_units(c).collect()} == {"first best", "alone"}


@pytest.mark.parametrize("text, want", [("There was no significant difference", "negative"), ("It is not effective here; x", "negative"), ("Treatment significantly improved survival", "positive"), ("never confirmed", "neutral"), ("", "neutral")])
def test_polarity(spark, text, want):
    assert one(spark, sections.polarity(F.lit(text))) == want


@pytest.mark.parametrize("text, options, want", [("Is it so?", None, "yesno"), ("List the genes", None, "list"), ("Describe it", None, "summary"), ("Where is X expressed?", None, "expression"), ("Who?", None, "factoid"), ("Who?", {"A": "x"}, "mcq")])
def test_question_types(spark, text, options, want):
    o = F.create_map(F.lit("A"), F.lit("x")) if options else F.lit(None).cast("map<string,string>")
    assert one(spark, gates.question_type(F.lit(text), o)) == want


def test_intents(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.2), (1, "b", 0.5), (2, "a", 0.6), (2, "b", 0.58), (3, "a", 0.1)], "query_id long, intent string, score double")
    assert {r["query_id"]: (r["intent"], r["sure"]) for r in gates.intents(df).collect()} == {1: ("a", True), 2: ("a", False), 3: ("a", False)}


@pytest.mark.parametrize("text, want", [("x FINAL(1) then FINAL('a (b) c') end", "a (b) c"), ("FINAL(open", "open"), ("none", "none"), (None, None)])
def test_final_block(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.final_block(F.col("t")).alias("x")).first()["x"] == want


def test_repaired_json(spark):
    rows = [('```json\n{"a": 1}\n```',), ("so: [1, 2] ok",), ("nothing",), (None,)]
    got = [r["x"] for r in spark.createDataFrame(rows, "t string").select(X.repaired_json(F.col("t")).alias("x")).collect()]
    assert [json.loads(x) if x else None for x in got] == [{"a": 1}, [1, 2], None, None]


def test_rouge():
    assert X.rouge("the cat sat", "the cat sat") == (1.0, 1.0, 1.0)
    assert X.rouge("", "x") == (0.0, 0.0, 0.0)
    r1, r2, rl = X.rouge("a b c d", "a c b d")
    assert (r1, r2, rl) == (1.0, 0.0, 0.75)


def test_bootstrap_holds_the_mean(spark):
    df = spark.createDataFrame([(k, "a", float(k % 10)) for k in range(500)], "id long, g string, v double")
    r = runs.bootstrap(df, "g", "v", "id").first()
    assert runs.bootstrap(df.repartition(3), "g", "v", "id").first() == r
    assert r["n"] == 500 and r["mean"] == 4.5 and r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 1


def test_files(spark, tmp_path):
    good = tmp_path / "items.jsonl"
    good.write_text(json.dumps({"id": "1", "question_type": "yesno", "options": {"A": "x"}}) + "\n" + json.dumps({"id": "2", "question_type": "mcq"}) + "\n")
    assert files.read_items(spark, str(good), types=("mcq",)).select("id").collect()[0]["id"] == "2"
    log = tmp_path / "run.jsonl"
    log.write_text('{"type": "item", "item_id": "1", "score": 1}\nbroken\n{"type": "run_end"}\n')
    assert files.read_log(spark, str(log)).count() == 1
    side = tmp_path / "side.jsonl"
    side.write_text('{"item_id": "1", "score": 0.1}\n{"item_id": "1", "score": 0.7}\n')
    assert [tuple(r) for r in files.read_sidecar(spark, str(side)).collect()] == [("1", 0.7)]
    assert files.datasets(spark, str(tmp_path), ["side", "none", "items"]) == ["items", "side"]
    assert files.latest_run(spark, str(tmp_path / "*.jsonl")).endswith("jsonl")
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_items(spark, str(tmp_path / "bad.jsonl")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.123456, 12.34)], "name string, score double, ms double")
    files.write_report(df, str(tmp_path / "r"), latency="ms")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().asDict() == {"name": "a", "score": "0.1235", "ms": "12.3"}
    assert [r["line"] for r in files.markdown(df.select("name")).collect()] == ["| name |", "| --- |", "| a |"]
    files.write_log(spark.createDataFrame([("1", 1.0)], "item_id string, score double"), str(tmp_path / "log"), "m")
    assert files.read_log(spark, str(tmp_path / "log")).count() == 1
    cache = spark.createDataFrame([("s", "q", [1, 2, 3], [1])], "strategy string, question string, ids array<long>, gold array<long>")
    files.store_cache(cache, str(tmp_path / "cache"), ["strategy"])
    files.store_cache(cache.withColumn("ids", F.array(F.lit(9).cast("long"), F.lit(8).cast("long"))), str(tmp_path / "cache"), ["strategy"])
    got = files.load_cache(spark, str(tmp_path / "cache"), ["question"], most=1)
    assert got.first()["ids"] == [9] and files.cache_stats(got, ["question"]).first()["with_gold"] == 1
    hit, miss = files.split_cached(spark.createDataFrame([("q",), ("r",)], "question string"), got, ["question"])
    assert hit.count() == 1 and miss.first()["question"] == "r"


def test_patches(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(tuple(r) for r in files.patched(t, spark.createDataFrame([("b", 5)], "k string, v int"), ["k"]).collect()) == [("a", 1), ("b", 5)]
    with pytest.raises(ValueError):
        files.patched(t, spark.createDataFrame([("z", 5)], "k string, v int"), ["k"])
    assert files.absent(t.union(t), t.where("k = 'a'"), "k").count() == 1


def test_passages(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps([{"id": "p", "passages": [{"offset": 0, "infons": {"type": "title_1"}, "text": "Intro"}, {"offset": 5, "infons": {}, "text": "body"}]}]))
    got = sections.carried_headers(files.read_passages(spark, str(tmp_path / "doc.json"))).orderBy("place").collect()
    assert [(r["kind"], r["header"]) for r in got] == [("title_1", "Intro"), ("paragraph", "Intro")]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for run in range(2):
        sinks.append_once(stream(), str(tmp_path / "out"), str(tmp_path / f"c{run}"), "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()
    q = windows.tumbling(stream(), "1 hour", delay="3650 days").writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbling").withColumn("start", F.col("start").cast("timestamp_ntz")).collect())) == sorted(map(tuple, windows.tumbling(events, "1 hour").collect()))


def test_stand_ins(spark):
    df = spark.createDataFrame([("red ring of power", "yesno"), (None, "factoid")], "t string, k string")
    e = services.HashEmbedder(16)
    rows = df.select(e(F.col("t")).alias("v"), services.LexicalScorer()(F.col("t"), F.lit("the red ring")).alias("s"), services.FirstSentenceGenerator()(F.col("t"), F.col("k"), F.lit("A b. C.")).alias("g")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-9 and rows[1]["v"] == [0.0] * 16
    assert rows[0]["s"] == 2 / 3 and [r["g"] for r in rows] == ["yes", "A b."]


def test_every_method_answers_every_item(spark):
    from quillon import methods

    items = spark.createDataFrame([(1, "Is the ring red?", "yesno", ["given text. more."], 0.9), (2, "Who holds the ring", "factoid", None, 0.1), (3, None, "summary", [], None)], "query_id long, question string, question_type string, context array<string>, confidence double")
    passages = spark.createDataFrame([(1, "The ring is red. It is so."), (2, "Nobody holds it. No."), (3, None)], "id long, text string")
    assert len(methods.METHODS) > 30
    for name in ("no-context", "golden-context", "hyde-mixed", "ircot-rerank", "chain-of-note", "self-rag-13b", "ircot", "v14-cascade-type-rewrite", "v14-no-rejudge", "pipeline"):
        got = {r["query_id"]: r for r in methods.run(items, passages, name).collect()}
        assert sorted(got) == [1, 2, 3] and got[1]["predicted"] == "yes"
    assert methods.sweep(items, passages, methods.METHODS["dense"], (1, 2), (1,)).count() == 6
