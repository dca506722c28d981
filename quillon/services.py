"""Model calls as batch interfaces. Each takes and returns columns; the ones here are deterministic stand-ins that need no network."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column:
        """array<double> of a text."""


class Scorer(Protocol):
    def __call__(self, query: Column, document: Column) -> Column:
        """double: how well a document answers a query."""


class Generator(Protocol):
    def __call__(self, question: Column, kind: Column, context: Column) -> Column:
        """string: an answer."""


class HashEmbedder:
    """Signed counts of hashed words, of length 1. Equal texts have equal vectors, texts with common words near ones."""

    def __init__(self, size: int = 256):
        self.size = size

    def __call__(self, text: Column) -> Column:
        size = self.size

        def apply(texts: pd.Series) -> pd.Series:
            from zlib import crc32

            out = []
            for t in texts:
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    h = crc32(w.encode("utf-8", "surrogatepass"))
                    v[h % size] += 1 if h >> 31 else -1
                n = np.sqrt(v @ v)
                out.append(v / n if n else v)
            return pd.Series(out)

        return F.pandas_udf(apply, "array<double>")(text)


class LexicalScorer:
    """The share of a query's terms that a document has."""

    def __call__(self, query: Column, document: Column) -> Column:
        terms, low = T.query_terms(query, None), F.concat(F.lit(" "), T.alnum(document), F.lit(" "))
        hit = F.size(F.filter(terms, lambda t: F.contains(low, F.concat(F.lit(" "), t, F.lit(" ")))))
        return hit / F.greatest(F.size(terms), F.lit(1))


class FirstSentenceGenerator:
    """yes for yes/no questions, A for choices, else the first sentence of the context."""

    def __call__(self, question: Column, kind: Column, context: Column) -> Column:
        return F.when(kind == "yesno", "yes").when(kind.isin("mcq", "mcq_multi"), "A").otherwise(T.first_sentence(context))
