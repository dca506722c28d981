"""Language identification: segmentation-marginalised unigrams.

The pieces of a public tokenizer's vocabulary have a probability for each language. A word's probability in a language is the
sum over all of its segmentations into pieces, which a forward pass gives; a text's is the product over its words. Piece
probabilities are learned by expectation-maximisation over a bounded sample: the forward and backward passes give the expected
number of times that each piece is used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

#: The vocabulary, whose path is a parameter of all that reads it.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of each language that a fit reads at most, and distinct words of each that it learns from at most (the most frequent).
FIT_DOCS, FIT_WORDS = 400, 40_000
ROUNDS, SMOOTHING, LONGEST = 3, 0.05, 30
UNKNOWN = 1e-7
#: A letter and what follows of letters and combining marks; numerals that aren't digits are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
OF_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
START = "▁"


def pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces, without control symbols and bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@dataclass
class Model:
    langs: list[str]
    ids: dict[str, int]  # piece -> row of p, for pieces of letters only
    p: np.ndarray  # pieces + 1 rows, a column a language; the last row is for a single unknown letter

    @property
    def widest(self) -> int:
        return max(map(len, self.ids), default=1)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Pieces:
    """Looks up all substrings of many words at once: by 64-bit hashes, in tables of 2**20 places where a piece that finds its place taken goes to the next table."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ids: dict[str, int]):
        self.count, self.widest = len(ids), max(map(len, ids), default=1)
        self.hash = np.zeros(len(ids) + 1, np.uint64)
        for v, i in ids.items():
            self.hash[i] = self._hash(v)
        self.tables = []
        left = np.arange(len(ids))
        while len(left):
            at = self._place(self.hash[left])
            _, first = np.unique(at, return_index=True)
            table_ = np.full(1 << 20, len(ids), np.int32)  # the place past all pieces, of hash 0
            table_[at[first]] = left[first]
            self.tables.append(table_)
            left = np.delete(left, first)

    def _hash(self, piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(self.FACTOR) + ord(c) + 1) & ((1 << 64) - 1)
        return np.uint64(h)

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, self.count where there is none."""
        at, out = self._place(h), None
        for table_ in self.tables:
            ids = table_[at]
            ids = np.where(self.hash[ids] == h, ids, self.count)
            out = ids if out is None else np.minimum(out, ids)
        return out if out is not None else np.full(h.shape, self.count, np.int32)


@dataclass
class Lattice:
    """Where pieces fit in a batch of words: for each begin and end, by end, the words and the pieces (the last one for a letter that isn't a piece)."""

    size: np.ndarray  # letters of each word, START included
    steps: list[tuple[int, int, np.ndarray, np.ndarray]]


def lattice(batch: list[str], known: Pieces) -> Lattice:
    size = np.array([len(w) + 1 for w in batch])
    longest = int(size.max())
    letters = np.frombuffer("".join((START + w).ljust(longest, "\0") for w in batch).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(batch), longest).T.astype(np.uint64) + np.uint64(1)
    steps, h = {}, np.zeros_like(letters)
    for n in range(1, min(known.widest, longest) + 1):
        h = h[: longest - n + 1] * known.FACTOR + letters[n - 1 :]
        ids = known.find(h)
        for begin in range(longest - n + 1):
            fits = ids[begin] < known.count
            if n == 1:
                fits = size > begin
            rows = np.flatnonzero(fits)
            if len(rows):
                steps[begin + n, begin] = (begin, begin + n, rows, ids[begin, rows])
    return Lattice(size, [steps[k] for k in sorted(steps)])


def forward(x: Lattice, p: np.ndarray) -> np.ndarray:
    """alpha[i, w, lang]: the sum over all segmentations of the first i letters."""
    alpha = np.zeros((int(x.size.max()) + 1, len(x.size), p.shape[1]))
    alpha[0] = 1
    for begin, end, rows, ids in x.steps:
        alpha[end, rows] += alpha[begin, rows] * p[ids]
    return alpha


def backward(x: Lattice, p: np.ndarray) -> np.ndarray:
    """beta[i, w]: the sum over all segmentations from letter i to the end, in one language."""
    beta = np.zeros((int(x.size.max()) + 1, len(x.size)))
    beta[x.size, np.arange(len(x.size))] = 1
    for begin, end, rows, ids in reversed(x.steps):
        beta[begin, rows] += p[ids, 0] * beta[end, rows]
    return beta


def log_likelihoods(batch: list[str], model: Model, known: Pieces) -> np.ndarray:
    """log P(word) in each language, by word. Words over LONGEST letters are taken letter by letter in logs, as their probability would underflow."""
    out = np.zeros((len(batch), len(model.langs)))
    short = sorted((k for k, w in enumerate(batch) if len(w) <= LONGEST), key=lambda k: len(batch[k]))
    for at in range(0, len(short), 2048):
        rows = short[at : at + 2048]
        x = lattice([batch[k] for k in rows], known)
        out[rows] = np.log(forward(x, model.p)[x.size, np.arange(len(rows))])
    widest = model.widest
    for k, w in enumerate(batch):
        if len(w) > LONGEST:
            out[k] = _long_word(START + w, model, widest)
    return out


def _long_word(word: str, model: Model, widest: int) -> np.ndarray:
    """The forward pass with the last `widest` sums only, scaled to 1 at each letter."""
    recent, scale = [np.ones(len(model.langs))], np.zeros(len(model.langs))
    for end in range(1, len(word) + 1):
        total = np.zeros(len(model.langs))
        for n in range(1, min(widest, end) + 1):
            i = model.ids.get(word[end - n : end], len(model.ids) if n == 1 else None)
            if i is not None:
                total += recent[-n] * model.p[i]
        scale += np.log(total)
        recent = [*(x / total for x in recent[-widest + 1 :]), np.ones(len(total))] if widest > 1 else [np.ones(len(total))]
    return scale


def fit(counts: dict[str, Counter], vocabulary: list[str]) -> Model:
    """counts: words of each language with how often they occur."""
    langs = sorted(counts)
    letters = [v for v in dict.fromkeys(x.lower() for x in vocabulary) if OF_LETTERS.fullmatch(v.removeprefix(START) or "a")]
    ids = {v: i for i, v in enumerate(letters)}
    known = Pieces(ids)
    model = Model(langs, ids, np.zeros((len(ids) + 1, len(langs))))
    for k, lang in enumerate(langs):
        found = sorted(((w, n) for w, n in counts[lang].items() if len(w) <= LONGEST), key=lambda x: (-x[1], x[0]))[:FIT_WORDS]
        p = None
        blocks = [(lattice([w for w, _ in found[at : at + 2048]], known), np.array([n for _, n in found[at : at + 2048]], float)) for at in range(0, len(found), 2048)]
        for _ in range(ROUNDS + 1):
            used = np.zeros(len(ids) + 1)
            for x, n in blocks:
                if p is not None:
                    alpha, beta = forward(x, p)[:, :, 0], backward(x, p)
                    n = n / alpha[x.size, np.arange(len(n))]
                for begin, end, rows, pieces_ in x.steps:  # at first each piece counts wherever it occurs
                    share = n[rows] if p is None else n[rows] * alpha[begin, rows] * p[pieces_, 0] * beta[end, rows]
                    np.add.at(used, pieces_, share)
            used += SMOOTHING
            used[-1] = 0
            p = (used / used.sum())[:, None]
            p[-1] = UNKNOWN
        model.p[:, k] = p[:, 0]
    return model


def train(docs: DataFrame, path: str = VOCABULARY) -> Model:
    """Learns from at most FIT_DOCS whole documents of each language outside the held-out fold, drawn by md5 of their ids."""
    usable = docs.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("lang"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long")
    n_of = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    wanted = F.lit(False)
    for lang, n in n_of.items():
        wanted |= (F.col("lang") == lang) & (drawn < math.ceil(min(1, FIT_DOCS / n) * (1 << 32)))
    counts = {lang: Counter() for lang in n_of}
    for r in usable.where(wanted).select("lang", "text").toLocalIterator():
        counts[r["lang"]].update(words(r["text"]))
    return fit(counts, pieces(path))


class Identifier:
    """Lists of words -> (language, probability). Without words `und` with 0; of equals the first by name is taken."""

    MOST = 300_000

    def __init__(self, model: Model):
        self.model, self.known = model, Pieces(model.ids)
        self.row: dict[str, int] = {}
        self.table = np.zeros((self.MOST, len(model.langs)))

    def batch(self, docs: list[list[str]]) -> list[tuple[str, float]]:
        """Words new to the table of words are scored together; those over LONGEST letters, or beyond its MOST rows, without a place in it."""
        every = {w for found in docs for w in found}
        kept = {w for w in every if len(w) <= LONGEST}
        if len(self.row) + len(kept - self.row.keys()) > self.MOST:
            self.row.clear()
        new = sorted(kept - self.row.keys())[: self.MOST - len(self.row)]
        if new:
            self.table[len(self.row) : len(self.row) + len(new)] = log_likelihoods(new, self.model, self.known)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        other = sorted(every - self.row.keys())
        rest = dict(zip(other, log_likelihoods(other, self.model, self.known), strict=True)) if other else {}
        return [self._best(found, rest) for found in docs]

    def _best(self, found: list[str], rest: dict[str, np.ndarray]) -> tuple[str, float]:
        if not found or not self.model.langs:
            return "und", 0.0
        plain = [w for w in found if w not in rest] if rest else found
        total = self.table[np.fromiter(map(self.row.__getitem__, plain), np.int64, len(plain))].sum(axis=0)
        for w in found if rest else ():
            if w in rest:
                total = total + rest[w]
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """docs with a struct lang_pred, score of their column text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a row for each piece of the vocabulary

    @F.pandas_udf("lang_pred string, score double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        identify = Identifier(sent.value)
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                out += identify.batch([words(t) for t in texts.iloc[at : at + 256]])
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn(name, apply(F.col("text")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents. Null and letterless texts are `und`, as are all where nothing could be learned."""
    docs = table(spark, sf_dir, "documents")
    found = with_language(docs.select("doc_id", "text"), train(docs), "found")
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "found.lang_pred", "found.score")
