"""Near-duplicates of documents and lines against brute force, large groups included."""

import random

import numpy as np
import pytest

from quillon.llm import linededup, links, minhash, neardup
from quillon.llm.common import Bounded

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def union(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def near_texts(seed, n=60, length=40):
    """Copies of one text with more and more words changed, unlike texts that share one long passage, and odd cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    base = [word() for _ in range(length)]
    passage = [word() for _ in range(25)]
    texts = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(length)] = word()
        texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(rng.randrange(10, 30))] + passage) for _ in range(n)]
    texts += [None, "", "  \n", "one two", "One TWO", "one two three", texts[0], texts[0].upper()]
    return texts


def brute(texts, ids):
    of = Bounded(minhash.word_hash)
    sets = [frozenset(minhash.word_shingles(neardup.word_list(t), of).tolist()) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = union(len(texts), pairs)
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[x]) for i, x in enumerate(label)}


@pytest.mark.parametrize("few", [32, 1])
def test_near_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(links, "FEW", few)
    texts = near_texts(few)
    ids = [1000 - 3 * k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string")
    rows, _ = neardup.near_duplicates(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}
    assert got == brute(texts, ids)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.collect())


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty)[0].count() == 0
    t = "a b c d e f g h"
    odd = spark.createDataFrame([(None, t), (7, t), (7, t), (None, None), (3, "")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(odd)[0].collect())
    assert rows == [("3", 0, "3", True), ("7", 4, "7", True), ("7", 4, "7", True), ("None", 0, "None", True), ("None", 4, "7", False)]


def test_one_of_each_component_stays(spark):
    t = "a b c d e f g h i j"
    docs = spark.createDataFrame([(5, t, "x"), (5, t, "x"), (9, t + " ", "y"), (4, "z", "y"), (None, None, None)], "doc_id long, text string, near_key string")
    kept = neardup.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "None"]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    edges = [(a, b) for a, b in edges if a != b]
    label = union(400, edges)
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "left long, right long"), "t").collect()}
    least = {}
    for i, x in enumerate(label):
        least[x] = min(least.get(x, i), i)
    assert got == {v: least[label[v]] for e in edges for v in e}


def line_brute(texts):
    """Places of lines that go, by document, of texts in order of their ids."""
    lines = [(d, k, linededup.normal(x)) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if t and linededup.normal(x)]
    names = list(dict.fromkeys(x for *_, x in lines))
    sets = [frozenset(linededup._set(x).tolist()) for x in names]
    label = union(len(names), [(a, b) for a in range(len(names)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    seen, gone = set(), {}
    for d, k, x in lines:
        c = label[names.index(x)]
        if c in seen:
            gone.setdefault(d, set()).add(k)
        seen.add(c)
    return gone


@pytest.mark.parametrize("few", [32, 1])
def test_line_dedup(spark, monkeypatch, few):
    monkeypatch.setattr(links, "FEW", few)
    rng = random.Random(few)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    base = line(20)

    def near():
        w = base.split(" ")
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = line(1)
        return " ".join(w)

    texts = ["\n".join(rng.choice([near, lambda: line(12), lambda: "  Short", lambda: "", lambda: "ab"])() for _ in range(6)) for _ in range(30)] + [None, "", "only\nonly\n\nONLY "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dropped, _ = linededup.with_dropped(docs)
    keys = {r["k"]: r["doc_id"] for r in docs.select("doc_id", neardup.doc_key().alias("k")).collect()}
    got = {keys[r["doc_key"]]: set(r["lines"]) for r in dropped.collect()}
    assert got == line_brute(texts)
    out, gone = linededup.deduped(docs)
    for r in out.collect():
        each = (texts[r["doc_id"]] or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(each) if k not in got.get(r["doc_id"], set()))
        assert r["text"] == (None if texts[r["doc_id"]] is None else kept)


def test_line_stage_keeps_columns_and_drops_emptied_documents(spark):
    docs = spark.createDataFrame([(1, "a line that is long\nb", "en", "s", 21), (2, "A line that is long", "en", "s", 19), (3, None, None, None, None), (4, "", "en", "s", 0)], SCHEMA)
    out = linededup.drop_lines(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"]) == [(1, "a line that is long\nb", 21)]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4]
    empty = spark.createDataFrame([], SCHEMA)
    assert linededup.drop_lines(spark, empty, "").count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    f, o = minhash.functions(512, 1, 64)
    m = minhash.minima(np.concatenate([a, b]), np.array([0, 400]), f, o)
    assert abs((m[0] == m[1]).mean() - 300 / 500) < 0.08


def test_line_shingles_end_with_their_line():
    h, starts = linededup.shingle_hashes(["abcdefgh", "xy", "abcdefgh"])
    assert starts.tolist() == [0, 2, 3]
    assert h[:2].tolist() == h[3:].tolist()
    assert len(np.unique(h)) == 3
