"""Quality classifier: supervised subword embeddings.

Each word has the mean of the learned vectors of its hashed features: the word, its character n-grams, and whether it repeats
the word before. A document has the mean over its words; a softmax gives the two classes. All is trained by stochastic
gradient descent in numpy on at most FIT_ROWS labelled documents, whole texts of them.

As the output layer is linear in the mean, the trained model folds without loss to one number a feature: what the feature's
vector adds to the difference of the two classes. Scoring is then a mean of such numbers, and 1 MB goes to the executors.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, fitted, fresh, held_out, labelled_texts, table

#: Labelled documents that a fit reads at most.
FIT_ROWS = 2500
BUCKETS, DIM, EPOCHS, RATE, SIZES = 1 << 18, 8, 8, 3.0, (3, 4)
THRESHOLD = 0.3
_REPEAT = crc32(b"word bigram: same again") % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, ends marked."""
    marked = f"<{word}>"
    found = [crc32(marked.encode("utf-8", "surrogatepass")) % BUCKETS]
    for n in SIZES:
        found += [crc32(marked[i : i + n].encode("utf-8", "surrogatepass"), n) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


def _weights(text: str, of_word: dict) -> tuple[np.ndarray, np.ndarray]:
    """The features of a document and their shares in its mean."""
    words = text.split()
    total: dict[int, float] = {_REPEAT: sum(map(operator.eq, words, words[1:])) / max(1, len(words))}
    for word, n in Counter(words).items():
        ids = of_word[word]
        share = n / len(words) / len(ids)
        for i in ids:
            total[i] = total.get(i, 0.0) + share
    return np.fromiter(total, np.int64, len(total)), np.fromiter(total.values(), np.float32, len(total))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> dict:
    """The folded model: `add`, what each bucket adds to the log-odds of label 1, and `bias`. No rows, or one label only: the share of label 1, smoothed."""
    rng = np.random.default_rng(seed)
    of_word = Bounded(features)
    docs = [(*_weights(text, of_word), int(y > 0)) for text, y in rows]
    share = (sum(y for *_, y in docs) + 1) / (len(docs) + 2)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.array([0.0, math.log(share / (1 - share))], np.float32)
    step, steps = 0, max(1, EPOCHS * len(docs))
    for _ in range(EPOCHS if 0 < sum(y for *_, y in docs) < len(docs) else 0):
        for k in rng.permutation(len(docs)):
            ids, share_of, y = docs[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share_of @ vectors[ids]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * 0.1 * np.outer(p, hidden)
            bias -= rate * 0.01 * p
            vectors[ids] -= (rate * 10) * share_of[:, None] * back
    return {"add": vectors @ (out[1] - out[0]), "bias": float(bias[1] - bias[0])}


def scorer(model: dict):
    """A function from a text (null: empty) to the probability of label 1; a text without words gets that of the bias."""
    add, bias = model["add"], model["bias"]
    of_gram = [Bounded(lambda g, n=n: float(add[crc32(g.encode("utf-8", "surrogatepass"), n) % BUCKETS])) for n in SIZES]

    def word_value(word: str) -> float:  # the mean of add over features(word), n-grams by a table
        marked = f"<{word}>"
        total, count = float(add[crc32(marked.encode("utf-8", "surrogatepass")) % BUCKETS]), 1
        for n, table_of in zip(SIZES, of_gram, strict=True):
            grams = [marked[i : i + n] for i in range(len(marked) - n + 1)]
            total += sum(map(table_of.__getitem__, grams))
            count += len(grams)
        return total / count

    of_word = Bounded(word_value)
    repeat = float(add[_REPEAT])

    def score(text: str | None) -> float:
        words = text.split() if text else ()
        logit = bias
        if words:
            logit += (sum(map(of_word.__getitem__, words)) + repeat * sum(map(operator.eq, words, words[1:]))) / len(words)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))

    return score


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with the score of its column text; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(sent.value)
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, apply(F.col("text")))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fitted(labelled_texts(docs, labels, "quality", FIT_ROWS, 5, 0, "quality"), fit)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents. Null and empty texts get the score of an empty mean; a null id is held out; repeated rows are scored each."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: docs whose score reaches THRESHOLD, all columns. The model learns from the rows of docs that have labels."""
    name = fresh(docs, "quality_score")
    return with_score(docs, train(docs, table(spark, sf_dir, "labels")), name).where(F.col(name) >= THRESHOLD).drop(name)
