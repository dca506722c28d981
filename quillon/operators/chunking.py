"""Chunks of texts: by sentences, and by a count of tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+")
SPACE = " \t\n\r\f\v"


def sentence_pieces(text: str | None, longest: int = 280, short: int = 30) -> list[str]:
    """Sentences as chunks: a short one joins the chunk before it where both fit, a long one is cut; chunks under half of `short` go."""
    out: list[str] = []
    for sentence in BREAK.split((text or "").strip(SPACE)):
        sentence = sentence.strip(SPACE)
        if len(sentence) < short and out and len(out[-1]) + 1 + len(sentence) <= longest:
            out[-1] = f"{out[-1]} {sentence}".strip(SPACE)
        else:
            out += [sentence[at : at + longest] for at in range(0, len(sentence), longest)]
    return [x for x in out if len(x) >= short // 2]


def token_pieces(text: str | None, count: Callable[[str], int], most: int = 512) -> list[tuple[str, int, int, int]]:
    """text, tokens, start and end of chunks of whole paragraphs with at most so many tokens. A longer paragraph is cut where the count is reached.

    count must not fall when a text gets longer."""
    out, begin, end = [], 0, 0

    def put(a: int, b: int) -> None:
        if found := text[a:b].strip(SPACE):
            out.append((found, count(found), a, b))

    text = text or ""
    at = 0
    for paragraph in text.split("\n\n"):
        stop = min(len(text), at + len(paragraph) + 2)
        if count(text[begin:stop]) <= most:
            end = stop
        else:
            put(begin, end)
            begin = end = at
            while count(text[begin:stop]) > most:
                low, high = begin + 1, stop  # the longest piece that fits, one character at least
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if count(text[begin:mid]) <= most else (low, mid - 1)
                put(begin, low)
                begin = end = low
            end = stop
        at = stop
    put(begin, end)
    return out


def sentence_chunks(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, place, chunk"""

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sentence_pieces(t) for t in batch])

    return docs.select(key, F.posexplode(pieces(column)).alias("place", "chunk"))


def token_chunks(docs: DataFrame, key: str, column: str = "text", count: Callable[[str], int] = lambda t: len(t.split()), most: int = 512) -> DataFrame:
    """key, place, chunk, tokens, start, end. count: tokens of a text; it goes to the executors."""

    @F.pandas_udf("array<struct<chunk:string,tokens:long,start:long,end:long>>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(("chunk", "tokens", "start", "end"), x, strict=True)) for x in token_pieces(t, count, most)] for t in batch])

    return docs.select(key, F.posexplode(pieces(column)).alias("place", "c")).select(key, "place", "c.*")
