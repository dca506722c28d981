"""Toxicity: multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its distinct words, each the sum over
the word and its character n-grams; a document is toxic unless every sentence is clean (noisy-or). Document labels alone train
the weights, by stochastic gradient descent; the sentence probabilities then locate what offends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, fitted, held_out, labelled_texts, table

#: Labelled documents that a fit reads at most, and features that the model knows at most.
FIT_ROWS, MOST_FEATURES = 4000, 100_000
EPOCHS, RATE, DECAY, BIAS, SIZES = 12, 0.5, 0.02, -9.0, (4, 5)
#: A feature needs so many toxic documents, and so many times the rate among clean ones, to be weighed.
LEAST_DOCS, LEAST_LIFT = 3, 2.5
SENTENCE, WORDS = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word and its distinct character n-grams, ends marked."""
    marked = f"<{word}>"
    return list(dict.fromkeys([marked, *(marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1))]))


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has any."""
    return [(m.start(), m.end(), words) for m in SENTENCE.finditer(text or "") if (words := set(WORDS.findall(m[0].lower())))]


def fit(rows: list[tuple[str, int]], seed: int = 11) -> dict[str, float]:
    """Weights of features, the bias under "". Without labels of both kinds, only the bias.

    A bag of clean sentences says nothing beyond the bias, so only features that lean to toxic bags are weighed."""
    rng = np.random.default_rng(seed)
    of_word = Bounded(features)
    bags = [([w for *_, w in sentences(text)], int(y > 0)) for text, y in rows]
    seen = [Counter(), Counter()]
    for bag, y in bags:
        seen[y].update({f for words in bag for w in words for f in of_word[w]})
    n_toxic = sum(y for _, y in bags)
    n_clean = len(bags) - n_toxic
    if not n_toxic or not n_clean:
        return {"": BIAS}
    lift = {f: (n / n_toxic) / ((seen[0][f] + 0.5) / n_clean) for f, n in seen[1].items() if n >= LEAST_DOCS}
    known = {f: i for i, f in enumerate(sorted((f for f, x in lift.items() if x >= LEAST_LIFT), key=lambda f: (-seen[1][f], f))[:MOST_FEATURES])}
    weights = np.zeros(len(known))
    packed = []
    for bag, y in bags:
        ids = [np.array([i for w in sorted(words) for f in of_word[w] if (i := known.get(f)) is not None], np.int64) for words in bag]
        if ids:
            packed.append((np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), len(ids), y))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(packed)):
            ids, sentence, n, y = packed[k]
            if not len(ids):
                continue
            p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, weights[ids], n) + BIAS, -40, 40)))
            clean = math.exp(float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
            back = p * (clean / max(1e-9, 1 - clean)) if y else -p
            np.add.at(weights, ids, rate * back[sentence])
        weights -= np.clip(weights, -DECAY * rate, DECAY * rate)
    return {f: float(weights[i]) for f, i in known.items() if abs(weights[i]) > 1e-3} | {"": BIAS}


def word_weights(weights: dict[str, float]) -> Bounded:
    """The sum of a word's weights, by word."""
    get = weights.get
    return Bounded(lambda word: sum(get(f, 0.0) for f in features(word)))


def sentence_scores(text: str | None, of_word: dict[str, float], bias: float = BIAS) -> list[tuple[int, int, float]]:
    """Start, end and probability of each sentence with a word."""
    weight = of_word.__getitem__
    return [(a, b, 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + sum(map(weight, words))))))) for a, b, words in sentences(text)]


def noisy_or(found: list[tuple[int, int, float]]) -> float:
    """That any sentence offends; 0 without sentences."""
    return 1 - math.exp(sum(math.log1p(-min(p, 1 - 1e-12)) for *_, p in found))


def with_score(docs: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """docs with a struct: score, and the spans start, end, p of sentences with p >= 0.5, which offend."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # MOST_FEATURES entries at most

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,p:double>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of_word = word_weights(sent.value)
        for texts in batches:
            out = []
            for text in texts:
                found = sentence_scores(text, of_word)
                out.append((noisy_or(found), [x for x in found if x[2] >= 0.5]))
            yield pd.DataFrame(out, columns=["score", "offending"])

    return docs.withColumn(name, apply(F.col("text")))


def train(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    return fitted(labelled_texts(docs, labels, "toxic", FIT_ROWS, 5, 0, "toxic"), fit)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending of all documents. Null and empty texts score 0; a null id is held out; repeated rows are scored each."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", "text"), weights, "found")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.size("found.offending").cast("long").alias("n_offending"))
