"""Parsing, chunking and searches that SQL doesn't express alike, against brute force or the cases of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.operators import chunking, evidence, overlap, retrieval
from quillon.plans import registry

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('["liver", "fat"]', ["liver", "fat"]),
        ('Here: ["Liver", "heart", "liver"]', ["liver", "heart"]),
        ("liver\nbrain", ["liver", "brain"]),
        ("liver; brain, spleen", ["liver", "brain", "spleen"]),
        ('["liver", "moon"]', ["liver"]),
        ('{"tissue_list": ["skin", "lung"]}', ["skin", "lung"]),
        ("low expression", ["low expression"]),
        ("", []),
        ("[liver, brain", ["liver", "brain"]),
        (None, []),
    ],
)
def test_tissues(spark, answer, want):
    assert one(spark, P.tissues(F.lit(answer).cast("string"))) == want


def test_synonym_groups(spark):
    assert one(spark, P.synonym_groups(F.lit('[["A", "b "], "C", [" "], ""]'))) == [["a", "b"], ["c"]]
    assert one(spark, P.synonym_groups(F.lit("none"))) == []


def test_masked_sentence(spark):
    mask = lambda t, p: one(spark, P.masked_sentence(F.array(*[F.lit(x) for x in t]).cast("array<string>"), F.array(*[F.lit(x) for x in p]).cast("array<double>"), 0.4))
    assert mask(["Ga", " is", " it.", " More."], [0.9, 0.1, 0.8, 0.9]) == "Ga  it."
    assert mask(["A.", " b", " c."], [0.1, 0.1, 0.1]) == "A. b c."
    assert mask([], []) == ""


def test_sentence_pieces():
    pieces = chunking.sentence_pieces("A short one. " + "x" * 600 + ". Tail here. " + "y" * 290, 280, 30)
    assert [len(x) for x in pieces] == [280, 280, 52, 280] and pieces[2].endswith(" Tail here.")
    assert chunking.sentence_pieces(None) == [] and chunking.sentence_pieces(" \n ") == []


def test_token_pieces_cover_the_text():
    rng = random.Random(1)
    count = lambda t: len(t.split())
    for _ in range(50):
        text = "\n\n".join(" ".join("w" * rng.randrange(1, 6) for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(0, 9)))
        found = chunking.token_pieces(text, count, 20)
        assert all(n <= 20 and n == count(c) and text[a:b].strip(chunking.SPACE) == c for c, n, a, b in found)
        assert "".join("".join(c.split()) for c, *_ in found) == "".join(text.split())
        assert all(x[3] <= y[2] for x, y in zip(found, found[1:]))


def test_capitalised_phrases(spark):
    got = {r["item_id"]: r["phrases"] for r in registry.QUERIES["capitalised_phrases"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        assert got[r["item_id"]] == "|".join(sorted(set(re.findall(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b", r["text"]))))


def test_search_goes_on_from_what_it_found(spark):
    docs = [(k, f"Text {'Alpha' if k < 3 else 'beta'} {'gamma Alpha' if k == 7 else ''}") for k in range(9)]

    def search(asked):
        frame = spark.createDataFrame(docs, "id long, text string")
        hits = asked.join(frame, F.exists(F.split("question", " "), lambda w: F.contains(F.col("text"), w)))
        return retrieval.ranked(hits.select("query_id", "id", "text", (-F.col("id")).cast("double").alias("score"))).join(frame, "id")

    asked = spark.createDataFrame([(1, "beta")], "query_id long, question string")
    got = {(r["id"], r["round"]) for r in evidence.searched_again(search, asked, rounds=2, per_round=20, top=9).collect()}
    assert got == {(k, 0) for k in range(3, 9)} | {(k, 1) for k in range(3)}


def test_kgrams_and_containment_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij"])
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(30)] + [None, "", "ab"]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 20)))) for k in range(12)] + [(12, texts[0]), (13, "ab")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, least):
        w = (t or "").split()
        return set() if not w else {" ".join(w)} if len(w) < least else {" ".join(w[i : i + 8]) for i in range(len(w) - 7)}

    want = {(d, i): n for d, t in enumerate(texts) for i, x in items if (n := len(grams(t, 8) & grams(x, 12)))}
    assert {(r["doc_id"], r["item_id"]): r["grams"] for r in overlap.shared_kgrams(docs, frame, 8).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in overlap.contained(docs, frame).collect()} == {(d, i) for d, t in enumerate(texts) if t is not None for i, x in items if x in t}


def test_places_over_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 100_003).alias("v"))
    got = [r["place"] for r in retrieval.numbered(df, "v").orderBy("v").collect()]
    assert got == list(range(1000))


def test_components_of_all_line_items(spark, tmp_path):
    lines = [(2 * k + 1, 1, k // 2) for k in range(20)] + [(101 + k, 1, 50 + k) for k in range(4)] + [(101, 1, 51)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {}
    for o, _, p in lines:
        for n in (f"o{o}", f"p{p}"):
            label.setdefault(n, n)
    for _ in range(30):
        for o, _, p in lines:
            label[f"o{o}"] = label[f"p{p}"] = min(label[f"o{o}"], label[f"p{p}"])
    assert {r["node"]: r["component"] for r in registry.QUERIES["connected_components"](spark, str(tmp_path)).collect()} == label
