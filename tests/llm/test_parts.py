"""A benchmark that is indexed in parts finds what one index finds."""

import random

from quillon.llm import decontaminate


def test_parts_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words[: 10 + k], k=rng.randrange(8, 20 + 10 * k)))) for k in range(12)]
    docs = []
    for k in range(200):
        text = rng.choice(items)[1].split()
        kept = [w if rng.random() < 0.8 else "other" for w in text]
        docs.append((k, " ".join(rng.choices(words, k=30) + kept + ["tail"] * rng.randrange(100))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r["doc_id"], m["item_id"], round(m["score"], 9)) for r in decontaminate.matches(d, b).collect() for m in r["found"]}
    whole = found()
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 3)
    assert whole and found() == whole
