"""Answers out of generated text: final blocks, letters, lists, yes/no, JSON; ROUGE. Regular parts are expressions, the others Arrow-batched."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as T


def yesno_answer(column: Column) -> Column:
    """yes, no or maybe: the first of them that stands as a word; empty if none does."""
    return F.regexp_extract(F.lower(F.coalesce(column, F.lit(""))), r"\b(yes|no|maybe)\b", 1)


def letter_answer(column: Column, letters: str = "A-E") -> Column:
    """The letter of `answer is X`, else of a leading X, else the first that stands alone; empty if none does."""
    text = F.coalesce(column, F.lit(""))
    tries = (rf"(?i:answer(?: is)?)\s*:?\s*\(?([{letters}])\b", rf"^\s*\(?([{letters}])[).:\s]", rf"\b([{letters}])\b")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in tries], F.lit(""))


def letters_answer(column: Column, letters: str = "A-E") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(rf"\b([{letters}])\b"), 1)))


def list_answer(column: Column) -> Column:
    """A JSON list, else the parts between commas, semicolons and lines, without quotes, brackets, bullets and a leading `and`; distinct."""
    parsed = F.from_json(column, "array<string>")
    clean = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"^(?:[-*•\[\"'(]+|\d+[.)])\s*|[\]\"').]+$", ""), r"^(?i:and)\s+", ""))
    parts = F.transform(F.split(F.coalesce(column, F.lit("")), r"[,;\n]"), clean)
    return F.array_distinct(F.filter(F.when(parsed.isNotNull(), F.transform(parsed, lambda p: F.trim(p))).otherwise(parts), lambda p: p != ""))


def short_answer(column: Column) -> Column:
    """The first line behind `answer:`, or the first sentence."""
    said = F.regexp_extract(F.coalesce(column, F.lit("")), r"(?i)answer\s*:\s*([^\n]+)", 1)
    return F.trim(F.when(said != "", said).otherwise(T.first_sentence(column)))


def extracted(column: Column, kind: Column) -> Column:
    """The answer of a response by the question's type, as text; lists are joined by |."""
    return (
        F.when(kind == "yesno", yesno_answer(column)).when(kind == "mcq", letter_answer(column)).when(kind == "mcq_multi", F.array_join(letters_answer(column), "|"))
        .when(kind.isin("list", "expression"), F.array_join(list_answer(column), "|")).when(kind == "factoid", short_answer(column)).otherwise(T.collapse(column))
    )


def _final(text: str | None) -> str | None:
    at = (text or "").rfind("FINAL(")
    if at < 0:
        return text
    depth, begin = 0, at + len("FINAL(")
    for k in range(begin - 1, len(text)):
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        if not depth:
            return text[begin:k].strip().strip("\"'")
    return text[begin:].strip().strip("\"'")


def _json(text: str | None) -> str | None:
    for found in [*re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.DOTALL), text or "", *re.findall(r"[\[{].*[\]}]", text or "", re.DOTALL)]:
        try:
            return json.dumps(json.loads(found), ensure_ascii=False)
        except ValueError:
            continue
    return None


def final_block(column: Column) -> Column:
    """What the last FINAL(...) holds, parentheses balanced; a text without one stays."""
    return _mapped(_final)(column)


def repaired_json(column: Column) -> Column:
    """The first of a fenced block, the whole text, or its widest bracketed part that is JSON; null if none is."""
    return _mapped(_json)(column)


def _mapped(f):
    def apply(s: pd.Series) -> pd.Series:
        return pd.Series([f(x) for x in s], dtype="object")

    return F.pandas_udf(apply, "string")


def _grams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _f(hit: float, a: int, b: int) -> float:
    return 2 * hit / (a + b) if a and b else 0.0


def rouge(left: str | None, right: str | None) -> tuple[float, float, float]:
    """ROUGE-1, -2 and -L F scores of words of letters and digits, in lower case."""
    a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (left, right))
    out = []
    for n in (1, 2):
        x, y = _grams(a, n), _grams(b, n)
        out.append(_f(sum((x & y).values()), sum(x.values()), sum(y.values())))
    row = [0] * (len(b) + 1)  # longest common subsequence
    for w in a:
        last = 0
        for k, v in enumerate(b, 1):
            keep, row[k] = row[k], last + 1 if w == v else max(row[k], row[k - 1])
            last = keep
    return out[0], out[1], _f(row[-1], len(a), len(b))


def rouge_scores(left: Column, right: Column) -> Column:
    def apply(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge(x, y) for x, y in zip(a, b, strict=True)], columns=["rouge1", "rouge2", "rougeL"])

    return F.pandas_udf(apply, "rouge1 double, rouge2 double, rougeL double")(left, right)
