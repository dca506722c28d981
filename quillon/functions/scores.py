"""Scores of answers: exact matches, sets, multisets of tokens, probabilities. Lists are short here; for whole texts see operators.overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_tokens, once


def rounded(column: Column, decimals: int) -> Column:
    """A double to some decimals as the SQL rounds it: scaled as a double, then to a whole number, half away from zero. F.round goes by the shortest decimal form instead,
    and so takes a product such as 0.144165 * 0.9 for a tie."""
    scale = F.lit(10.0**decimals)
    return F.round(column * scale) / scale


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def set_scores(predicted: Column, gold: Column) -> Column:
    """precision, recall, f1 of two lists as sets. No gold: all 1."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) > 0, both / F.size(p)).otherwise(F.lit(0.0))
    recall = F.when(F.size(g) > 0, both / F.size(g)).otherwise(F.lit(0.0))
    one = F.size(g) == 0
    return F.struct(*[F.when(one, F.lit(1.0)).otherwise(x).alias(n) for n, x in (("precision", precision), ("recall", recall), ("f1", f1(precision, recall)))])


def shared_count(a: Column, b: Column) -> Column:
    """The size of the intersection of two lists as multisets."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda total, t: total + F.least(count(a, t), count(b, t)))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of answer tokens as multisets: both empty 1, one empty 0."""

    def of(x: Column) -> Column:
        p, g, both = x["p"], x["g"], shared_count(x["p"], x["g"])
        value = F.when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(p) + F.size(g)))  # the harmonic mean of both / |p| and both / |g|
        return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(value)

    return once(F.struct(answer_tokens(predicted).alias("p"), answer_tokens(gold).alias("g")), of)


def best_token_f1(predicted: Column, variants: Column) -> Column:
    """The best token F1 over the gold's variants; 0 without any."""
    return F.coalesce(F.array_max(F.transform(variants, lambda v: token_f1(predicted, v))), F.lit(0.0))


def gold_variants(gold: Column) -> Column:
    """A JSON list of strings as its items, anything else as itself."""
    parsed = F.from_json(gold, "array<string>")
    return F.when(F.startswith(F.ltrim(gold), F.lit("[")) & parsed.isNotNull(), parsed).otherwise(F.array(gold))


def yesno(predicted: Column, gold: Column) -> Column:
    same = F.lower(F.trim(F.coalesce(predicted, F.lit("")))) == F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    return same.cast("double")


def choice(predicted: Column, options: Column) -> Column:
    """The letter of a predicted option: the letter itself, else the one option with that text, else the first option that holds it or that it holds, else the prediction."""
    said = F.trim(F.coalesce(predicted, F.lit("")))
    entries = F.array_sort(F.map_entries(options))
    same = F.filter(entries, lambda e: F.lower(F.trim(e["value"])) == F.lower(said))
    part = F.filter(entries, lambda e: (said != "") & (F.contains(F.lower(said), F.lower(e["value"])) | F.contains(F.lower(e["value"]), F.lower(said))))
    return (
        F.when(F.array_contains(F.map_keys(options), F.upper(said)), F.upper(said))
        .when(F.size(same) == 1, F.get(same, F.lit(0))["key"]).when(F.size(part) > 0, F.get(part, F.lit(0))["key"]).otherwise(said)
    )


def choices(predicted: Column) -> Column:
    """The letters of several options: a JSON list, else the capital letters A to E that stand alone."""
    parsed = F.from_json(predicted, "array<string>")
    letters = F.regexp_extract_all(F.upper(F.coalesce(predicted, F.lit(""))), F.lit(r"\b([A-E])\b"), 1)
    return F.array_sort(F.array_distinct(F.when(parsed.isNotNull(), F.transform(parsed, lambda x: F.upper(F.trim(x)))).otherwise(letters)))


def groups_matched(predicted: Column, groups: Column) -> Column:
    """How many synonym groups some prediction hits, without regard to case."""
    said = F.transform(predicted, lambda p: F.lower(F.trim(p)))
    return F.size(F.filter(groups, lambda g: F.arrays_overlap(F.transform(g, lambda s: F.lower(F.trim(s))), said)))


def group_f1(predicted: Column, groups: Column) -> Column:
    """F1 of a list against synonym groups, true positives being the groups that are hit. No groups: 1."""
    hit = groups_matched(predicted, groups)
    n = F.size(F.array_distinct(F.transform(predicted, lambda p: F.lower(F.trim(p)))))
    value = f1(F.when(n > 0, F.least(hit, n) / n).otherwise(F.lit(0.0)), hit / F.size(groups))
    return F.when(F.size(groups) == 0, F.lit(1.0)).otherwise(value)


def probability(logprob: Column, missing: float = 0.0) -> Column:
    return F.coalesce(F.exp(logprob), F.lit(missing))


def yes_probability(yes: Column, no: Column, missing: float = -10.0) -> Column:
    """exp(yes) / (exp(yes) + exp(no)) of log-probabilities."""
    y, n = F.exp(F.coalesce(yes, F.lit(missing))), F.exp(F.coalesce(no, F.lit(missing)))
    return y / (y + n)


def reflection_score(relevant: Column, full: Column, partial: Column, usefulness: Column, weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> Column:
    """Weighted reflection tokens: relevance, support (partial counts half), and usefulness, whose five grades count from -1 to 1."""
    grades = F.array(*[F.lit(x) for x in (-1.0, -0.5, 0.0, 0.5, 1.0)])
    use = F.aggregate(F.zip_with(usefulness, grades, lambda p, w: p * w), F.lit(0.0), lambda a, x: a + x)
    return weights[0] * relevant + weights[1] * (full + 0.5 * partial) + weights[2] * use


def error_class(correct: Column, error: Column, gold_found: Column, gold_in_answer: Column) -> Column:
    """What went wrong: null if nothing did."""
    low = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(correct, F.lit(None).cast("string")).when(low.rlike("timeout|timed out"), "timeout").when(low.rlike("kg|tool"), "kg_tool_error")
        .when(~gold_found, "retrieval_miss").when(gold_in_answer, "wrong_extraction").otherwise("reasoning_error")
    )
