"""Predicates that decide what a question needs: escalation, groundedness, full text, rewriting, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

#: Below this confidence an answer is asked for again.
CONFIDENCE = 0.7


def grounded(answer: Column, passages: Column, kind: Column, options: Column | None = None) -> Column:
    """Whether an answer stands in some passage: answers of three letters and fewer always do; of a choice letter, its option's text is looked for."""
    said = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    if options is not None:
        said = F.when((kind == "mcq") & (F.length(said) == 1), F.lower(F.coalesce(F.try_element_at(options, F.upper(said)), said))).otherwise(said)
    within = F.exists(passages, lambda p: F.contains(F.lower(p), said))
    return (F.length(said) <= 3) | F.coalesce(within, F.lit(False))


def grounded_by_tokens(answer: Column, context: Column, share: float = 0.5) -> Column:
    """Whether an answer, or half of its tokens of three letters and more, stands in the context."""
    said, low = F.lower(F.trim(F.coalesce(answer, F.lit("")))), F.lower(F.coalesce(context, F.lit("")))
    tokens = F.filter(F.split(T.alnum(said), " "), lambda t: F.length(t) > 2)
    found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return (F.contains(low, said) & (said != "")) | ((F.size(tokens) > 0) & (found / F.greatest(F.size(tokens), F.lit(1)) >= share))


def escalates(kind: Column, confidence: Column, answer: Column, is_grounded: Column, force: Column | None = None) -> Column:
    """Whether a first answer goes on: forced, unsure, empty, or a factoid or list without ground; yes/no and expression questions never do."""
    unsure = F.coalesce(confidence, F.lit(0.0)) < CONFIDENCE
    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    wanted = unsure | empty | (kind.isin("factoid", "list") & ~is_grounded)
    return (F.lit(False) if force is None else F.coalesce(force, F.lit(False))) | (wanted & ~kind.isin("yesno", "expression"))


def escalates_research(kind: Column, confidence: Column, answer: Column, is_grounded: Column, abstained: Column) -> Column:
    empty = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return ((F.coalesce(confidence, F.lit(0.5)) < CONFIDENCE) | empty | ~is_grounded | abstained) & (kind != "yesno")


def needs_full_text(question: Column, kind: Column, n_full: Column, least: int = 2) -> Column:
    """use, reason, mode: whether full texts are worth reading for a question."""
    low = F.lower(F.coalesce(question, F.lit("")))
    deep = low.rlike(r"\b(mechanism|method|dose|dosage|how many|percentage|table|figure|subgroup|adverse)\b")
    pair = lambda use, reason, mode: F.struct(F.lit(use).alias("use"), F.lit(reason).alias("reason"), F.lit(mode).alias("mode"))
    return (
        F.when(kind.isin("mcq", "mcq_multi", "expression"), pair(False, "type", "none")).when(n_full < least, pair(False, "coverage", "none"))
        .when(deep, pair(True, "depth", "full")).when(kind == "yesno", pair(True, "polarity", "balanced")).otherwise(pair(False, "shallow", "none"))
    )


def wants_rewrite(question: Column) -> Column:
    """Whether a question is worth rewriting into a search query: long, or with a vignette's words."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return (F.length(low) > 300) | low.rlike(r"\b(year-old|presents with|history of|which of the following)\b")


def question_type(question: Column, options: Column) -> Column:
    """The type of a question by ordered rules."""
    low = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return (
        F.when(F.coalesce(F.size(options), F.lit(0)) > 0, "mcq").when(low.rlike(r"^(is|are|does|do|did|can|could|was|were|has|have|should|will)\b"), "yesno")
        .when(low.rlike(r"^(list|name|which .*s\b|what are)"), "list").when(low.rlike(r"^(describe|summari[sz]e|explain|discuss)"), "summary")
        .when(low.rlike(r"\b(expressed|expression)\b"), "expression").otherwise("factoid")
    )


def no_data(response: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(response, F.lit(""))))
    return (low == "") | low.rlike("no data|not found|no results|no information")


def transient(error: Column) -> Column:
    """Whether an error is worth another try."""
    return F.lower(F.coalesce(error, F.lit(""))).rlike("timeout|timed out|connection|temporarily|rate limit|429|502|503|504")


def routes(question: Column, kind: Column, groups: dict[str, str], always: tuple[str, ...] = ("SEARCH",)) -> Column:
    """Tool groups of a question: those that are always on, those whose pattern fits, KEYWORD for list and factoid, FULLTEXT for summary; sorted, distinct."""
    low = F.lower(F.coalesce(question, F.lit("")))
    picked = [F.lit(g) for g in always] + [F.when(low.rlike(p), F.lit(g)) for g, p in groups.items()]
    picked += [F.when(kind.isin("list", "factoid"), F.lit("KEYWORD")), F.when(kind == "summary", F.lit("FULLTEXT"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*picked))))


def intents(scored: DataFrame, least: float = 0.5, margin: float = 0.05) -> DataFrame:
    """query_id, intent, score, sure: of (query_id, intent, score) the best by its nearest prototype; unsure below `least` or within `margin` of the next."""
    best = scored.groupBy("query_id", "intent").agg(F.max("score").alias("score"))
    listed = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "intent")), asc=False).alias("l"))
    second = F.coalesce(F.get("l", F.lit(1))["score"], F.lit(-1.0))
    top = F.get("l", F.lit(0))
    return listed.select("query_id", top["intent"].alias("intent"), top["score"].alias("score"), ((top["score"] >= least) & (top["score"] - second >= margin)).alias("sure"))
