"""Overlap of whole texts: multisets of words, k-grams, containment. The stated items are held against all documents in blocks; what is shuffled is hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Items that are sent at a time.
ITEM_BLOCK = 20_000


def multiset_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, shared: the words, counted, that two texts of the same id (id, text) share; ids that share none are gone."""
    count = lambda df, n: df.select("id", F.explode(F.filter(F.split(T.alnum(F.col("text")), " "), lambda w: w != "")).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias(n))
    return count(left, "n").join(count(right, "m"), ["id", "w"]).groupBy("id").agg(F.sum(F.least("n", "m")).alias("shared"))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated items (item_id, text), ITEM_BLOCK at a time; null texts are empty."""
    block = []
    for r in items.select("item_id", "text").distinct().toLocalIterator():
        block.append((r[0], r[1] or ""))
        if len(block) == ITEM_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _against(docs: DataFrame, items: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Each block of items goes to the executors, which pass over docs (doc_id, text) with it."""
    out = None
    for block in _blocks(items):
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run(block), schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _words(text: str | None) -> list[str]:
    """As T.alnum has them."""
    return re.findall("[a-z0-9]+", (text or "").lower())


def _grams(words: list[str], k: int, least: int) -> list[str]:
    """As T.kgrams has them."""
    if not words:
        return []
    return [" ".join(words)] if len(words) < least else [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def shared_kgrams(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """doc_id, item_id, grams: how many of an item's k-grams (item_id, text) a document has. Only grams that an item has leave the executors."""

    def run(block: list[tuple[int, str]]):
        of: dict[str, set[int]] = {}
        for i, text in block:
            for gram in _grams(_words(text), k, 12):
                of.setdefault(gram, set()).add(i)
        first = {gram.split(" ", 1)[0] for gram in of}

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    words = _words(text)
                    grams = [" ".join(words)] if len(words) < k else (" ".join(words[i : i + k]) for i, w in enumerate(words[: len(words) - k + 1]) if w in first)
                    found += [(doc, i, gram) for gram in set(grams) & of.keys() for i in of[gram]]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "gram"])

        return find

    hits = _against(docs, items, run, "doc_id long, item_id long, gram string")
    return hits.groupBy("doc_id", "item_id").agg(F.count_distinct("gram").alias("grams"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of documents whose text has an item's text in it; an empty item is in every text.

    Candidates share the 8-gram that begins at an item's second word, as its first and last may be parts of words of the document; only these are compared in
    full. Items of fewer than ten words are compared with all."""

    def run(block: list[tuple[int, str]]):
        short, of = [], {}
        for i, text in block:
            words = _words(text)
            if len(words) < 10:
                short.append((i, text))
            else:
                of.setdefault(" ".join(words[1:9]), []).append((i, text))
        first = {gram.split(" ", 1)[0] for gram in of}

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    if text is None:
                        continue
                    words = _words(text)
                    grams = {" ".join(words[k : k + 8]) for k, w in enumerate(words) if w in first}
                    found += [(doc, i) for i, item in [*short, *(x for g in grams & of.keys() for x in of[g])] if item in text]
                yield pd.DataFrame(found, columns=["doc_id", "item_id"])

        return find

    return _against(docs, items, run, "doc_id long, item_id long").distinct()
