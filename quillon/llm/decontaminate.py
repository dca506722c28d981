"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every passage of the corpus.

A passage is a window of a document's words; windows overlap by half and are so wide that one of them holds any run of words as
long as the longest item. An item's BM25 weights are divided by their sum, so that a score is the share of the item's weight
that the passage has, and one threshold suits all items. Each term has a list of postings, sorted by item, and the greatest share in
each block of items. A search adds up these maxima for all blocks at once and passes over the blocks that fall short; in a live block
it moves one cursor for each term of the passage: the pivot is the first item that the maxima of the cursors up to it let reach the
threshold, the cursors before it jump to it, and it is scored in full where they meet. All items above the threshold are then
verified: the shares of the five-word shingles of the item's question and of its answer that the document has.

As the threshold is fixed, an item can reach it only with one of its heaviest terms, those without which the rest falls short.
A passage without any item's such term is not searched.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .links import bounded, counted
from .neardup import doc_key

#: BM25's constants, the share of an item's weight that a passage must have, least overlap, words of a shingle.
K1, B, THRESHOLD, OVERLAP, SHINGLE = 1.2, 0.75, 0.7, 0.75, 5
#: Items of a block, least words of a stride, items that are searched in one pass over the documents.
BLOCK_ITEMS, STRIDE, PASS_ITEMS = 8, 64, 20_000
WORD = re.compile(r"\w+")
LAST_SENTENCE = re.compile(r"(?<=[.!?\n])\s*(?=[^.!?\n]*\w[^.!?\n]*[.!?\s]*\Z)")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; an item of one sentence has none."""
    m = None
    for m in LAST_SENTENCE.finditer(text):
        break
    return (text[: m.start()], text[m.end() :]) if m and WORD.search(text[: m.start()]) else (text, "")


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    """Runs of SHINGLE words; of fewer words, all of them as one run."""
    n = min(SHINGLE, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


@dataclass
class Postings:
    """Of one term: items in order; the blocks of BLOCK_ITEMS items that any of them is in, with the greatest share in each, and where its items begin in the list."""

    items: list[int]
    blocks: np.ndarray
    most: np.ndarray
    starts: list[int]


def postings(items: list[int], shares: list[float]) -> Postings:
    blocks, starts = np.unique(np.array(items) // BLOCK_ITEMS, return_index=True)
    return Postings(items, blocks, np.maximum.reduceat(np.array(shares), starts), [*starts.tolist(), len(items)])


@dataclass
class Index:
    items: list[int] = field(default_factory=list)  # item ids
    weights: list[dict[int, float]] = field(default_factory=list)  # of each item, its share by term
    parts: list[tuple[set, set]] = field(default_factory=list)  # shingles of question and answer
    term: dict[str, int] = field(default_factory=dict)
    heavy: set[int] = field(default_factory=set)  # terms without which some item stays below the threshold
    lists: list[Postings] = field(default_factory=list)  # by term
    offsets: np.ndarray | None = None  # of each term, where its blocks begin in `blocks` and their maxima in `most`
    blocks: np.ndarray | None = None
    most: np.ndarray | None = None
    stride: int = STRIDE

    def packed(self) -> None:
        """Puts the blocks and maxima of all lists behind each other, where search finds those of many terms at once."""
        self.offsets = np.cumsum([0, *(len(x.blocks) for x in self.lists)])
        self.blocks = np.concatenate([x.blocks for x in self.lists]) if self.lists else np.empty(0, np.int64)
        self.most = np.concatenate([x.most for x in self.lists]) if self.lists else np.empty(0)

    def search(self, terms: np.ndarray, counts: Counter | None = None) -> list[tuple[int, float]]:
        """Items with a score of THRESHOLD or more for distinct terms, in order, and their scores. counts: gets how many blocks were passed over and items scored."""
        if not len(terms):
            return []
        sizes = self.offsets[terms + 1] - self.offsets[terms]
        at = np.arange(sizes.sum()) + np.repeat(self.offsets[terms] - np.cumsum(sizes) + sizes, sizes)
        bounds = np.bincount(self.blocks[at], self.most[at])
        live = np.flatnonzero(bounds >= THRESHOLD - 1e-9).tolist()
        if counts is not None:
            counts["passed over"] += int((bounds > 0).sum()) - len(live)
        if not live:
            return []
        lists, among = [self.lists[t] for t in terms.tolist()], set(terms.tolist())
        return [found for block in live for found in self._within(block, among, lists, counts)]

    def _within(self, block: int, terms: set[int], lists: list[Postings], counts: Counter | None) -> Iterator[tuple[int, float]]:
        least, cursors = THRESHOLD - 1e-9, []
        for n, x in enumerate(lists):
            k = int(np.searchsorted(x.blocks, block))
            if k < len(x.blocks) and x.blocks[k] == block:
                cursors.append([x.items[x.starts[k]], n, x.starts[k], x.starts[k + 1], float(x.most[k]), x.items])  # the item that it is at, list, place, end, maximum
        while cursors:
            cursors.sort(key=itemgetter(0, 1))
            bound, pivot = 0.0, -1
            for c in cursors:
                bound += c[4]
                if bound >= least:
                    pivot = c[0]
                    break
            if pivot < 0:
                return
            to = pivot
            if cursors[0][0] == pivot:
                score = sum(w for t, w in self.weights[pivot].items() if t in terms)
                if score >= least:
                    yield pivot, score
                to = pivot + 1
                if counts is not None:
                    counts["scored"] += 1
            for c in cursors:
                if c[0] >= to:
                    break
                c[2] = bisect_left(c[5], to, c[2], c[3])
                c[0] = c[5][c[2]] if c[2] < c[3] else -1
            cursors = [c for c in cursors if c[0] >= 0]


@dataclass
class Statistics:
    """Of all items that have a word: how many they are, the items of each word, the mean and the greatest number of words."""

    count: int
    df: Counter
    mean: float
    longest: int


def statistics(items: Iterable[tuple[int, str]]) -> Statistics:
    count, total, longest, df = 0, 0, 0, Counter()
    for _, text in items:
        if ws := words(text):
            count, total, longest = count + 1, total + len(ws), max(longest, len(ws))
            df.update(set(ws))
    return Statistics(count, df, total / max(1, count), longest)


def build(items: list[tuple[int, str]], of_all: Statistics | None = None) -> Index:
    """The index of (item_id, text), which may be a part of the items that of_all is about. Items without a word are left out."""
    index = Index()
    found = [(i, text, Counter(ws)) for i, text in sorted(items) if (ws := words(text))]
    of_all = of_all or statistics(items)
    df, mean = of_all.df, of_all.mean
    index.term = {w: k for k, w in enumerate(sorted({w for *_, c in found for w in c}))}
    index.stride = max(STRIDE, of_all.longest)
    lists: list[tuple[list[int], list[float]]] = [([], []) for _ in index.term]
    for n, (i, text, c) in enumerate(found):
        norm = K1 * (1 - B + B * sum(c.values()) / mean)
        raw = {index.term[w]: math.log(1 + (of_all.count - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in c.items()}
        total = sum(raw.values())
        shares = {t: w / total for t, w in raw.items()}
        index.items.append(i)
        index.weights.append(shares)
        question, answer = question_and_answer(text)
        index.parts.append((shingles(words(question)), shingles(words(answer))))
        rest = 0.0
        for t, w in sorted(shares.items(), key=lambda x: (x[1], x[0])):
            rest += w
            if rest >= THRESHOLD - 1e-9:  # without this term and the heavier ones an item stays below
                index.heavy.add(t)
        for t, w in shares.items():
            lists[t][0].append(n)
            lists[t][1].append(w)
    index.lists = [postings(*x) for x in lists]
    index.packed()
    return index


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.is_heavy = np.zeros(len(index.term) + 1, bool)  # the last is for words that no item has
        self.is_heavy[list(index.heavy)] = True

    def retrieve(self, found: list[str]) -> tuple[dict[int, float], int]:
        """Of a document's words: the best score by item of all (passage, item) above the threshold, and how many passages there are."""
        index, get, none = self.index, self.index.term.get, len(self.index.term)
        if not found:
            return {}, 0
        ids = np.fromiter((get(w, none) for w in found), np.int64, len(found))
        n_passages = max(1, -(-len(found) // index.stride) - 1)
        halves = np.flatnonzero(np.bincount(np.flatnonzero(self.is_heavy[ids]) // index.stride)).tolist()
        best: dict[int, float] = {}
        for k in sorted({k for half in halves for k in (half - 1, half) if 0 <= k < n_passages}):
            terms = np.unique(ids[k * index.stride : (k + 2) * index.stride])
            for i, score in index.search(terms[:-1] if terms[-1] == none else terms):
                best[i] = max(score, best.get(i, 0.0))
        return best, n_passages

    def verify(self, found: list[str], i: int, at: dict[int, set] | None = None) -> tuple[float, float, bool]:
        """Shares of the question's and the answer's shingles that the document has; whether both, or the two together, reach OVERLAP.

        at: the document's runs of words by their number, filled here; to be handed on from item to item."""
        question, answer = self.index.parts[i]
        at = {} if at is None else at

        def has(part: set) -> int:
            for n in {len(s) for s in part} - at.keys():
                at[n] = {tuple(found[k : k + n]) for k in range(len(found) - n + 1)}
            return sum(s in at[len(s)] for s in part)

        q, a = has(question), has(answer)
        q_share, a_share = q / max(1, len(question)), a / len(answer) if answer else 1.0
        return q_share, a_share, min(q_share, a_share) >= OVERLAP or (q + a) / max(1, len(question) + len(answer)) >= OVERLAP


FOUND = "item_id long, score double, question_overlap double, answer_overlap double, verified boolean"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of docs but text, and an array `found` of FOUND: the items above the threshold, by id, with their verification.

    Null texts have no passages; null items and items without a word match nothing. The benchmark, which is the stated query set, is read to the driver
    and indexed PASS_ITEMS items at a time, with the statistics of all; each such part is one pass over docs, and a row of docs is returned once for each part."""
    items = sorted({(r[0], r[1]) for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator()})
    of_all, out = statistics(items), None
    for at in range(0, max(1, len(items)), PASS_ITEMS):
        found = _search(docs.sparkSession.sparkContext.broadcast(build(items[at : at + PASS_ITEMS], of_all)))
        part = docs.select(*[c for c in docs.columns if c != "text"], found(F.col("text")).alias("found"))
        out = part if out is None else out.unionAll(part)
    return out


def _search(sent):
    """A column of text -> array of FOUND, by the index that was sent."""

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':') for x in FOUND.split(', '))}>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher, names = Searcher(sent.value), [x.split()[0] for x in FOUND.split(", ")]

        def of(found: list[str]) -> list[dict]:
            (best, _), at = searcher.retrieve(found), {}
            return [dict(zip(names, (sent.value.items[i], score, *searcher.verify(found, i, at)), strict=True)) for i, score in sorted(best.items())]

        for texts in batches:
            yield pd.Series([of(words(text)) for text in texts])

    return search


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and each benchmark item that it holds; clean documents have none.

    Null and empty texts and items match nothing; a null doc_id is carried as it is; a repeated row of documents has its rows again, a repeated item has not."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode(F.filter("found", lambda x: x["verified"])).alias("m")).select("doc_id", "m.item_id", "m.score", "m.question_overlap", "m.answer_overlap")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: docs that hold no benchmark item."""
    found = matches(docs.select(doc_key().alias("doc_key"), "text"), table(spark, sf_dir, "benchmark"))
    gone, n = counted(found.where(F.exists("found", lambda x: x["verified"])).select("doc_key").distinct(), "leaks")
    name = fresh(docs, "leak_key")
    return docs.withColumn(name, doc_key()).join(bounded(gone.withColumnRenamed("doc_key", name), n), name, "left_anti").select(*docs.columns)
