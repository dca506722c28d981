"""Parsing of what models and services answer, and small decisions over it. Built-in expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _text, once

#: The tissues that an expression answer may name, and what stands for none.
TISSUES = (
    "adrenal", "appendix", "bone marrow", "brain", "colon", "duodenum", "endometrium", "esophagus", "fat", "gall bladder", "heart", "kidney", "liver", "lung", "lymph node", "ovary", "pancreas",
    "placenta", "prostate", "salivary gland", "skin", "small intestine", "spleen", "stomach", "testis", "thyroid", "urinary bladder",
)
NO_TISSUE = "low expression"
#: The types of entities, and other names of them.
ENTITY_TYPES = ("gene", "protein", "disease", "drug", "chemical", "pathway", "cell_type", "organism", "anatomy", "biological_process", "concept", "method", "other")
ENTITY_ALIASES = {
    "genes": "gene", "proteins": "protein", "diseases": "disease", "drugs": "drug", "medications": "drug", "chemicals": "chemical", "compounds": "chemical", "pathways": "pathway", "cells": "cell_type",
    "cell_types": "cell_type", "organisms": "organism", "species": "organism", "anatomies": "anatomy", "processes": "biological_process", "biological_processes": "biological_process",
    "methods": "method", "techniques": "method", "concepts": "concept",
}
#: Roles of sections that carry no findings.
LOW_SIGNAL_ROLES = ("introduction", "background", "methods", "other")

_SPACE = r"[ \t\n\r\f\x0B]"


def strip(column: Column) -> Column:
    return F.regexp_replace(_text(column), rf"^{_SPACE}+|{_SPACE}+$", "")


def list_after(response: Column, name: str) -> Column:
    """The comma-separated values on a line `NAME: ...` of a response, in any case; none for NONE or without that line."""
    line = strip(F.regexp_extract(_text(response), rf"(?i){name}:[ \t\n\r\f\x0B]*([^\n]+)", 1))
    values = F.filter(F.transform(F.split(line, ","), strip), lambda v: v != "")
    return F.when(F.upper(line) == "NONE", F.array().cast("array<string>")).otherwise(values)


def route_flag(response: Column, name: str = "ROUTE") -> Column:
    return F.upper(F.regexp_extract(_text(response), rf"(?i){name}:[ \t\n\r\f\x0B]*(YES|NO)", 1)) == "YES"


def json_strings(column: Column) -> Column:
    """The items of a JSON list as texts, null for anything else."""
    return F.when(strip(column).rlike(r"(?s)^\[.*\]$"), F.from_json(strip(column), "array<string>"))


def tissues(answer: Column) -> Column:
    """Distinct tissues of the vocabulary that an answer names: a JSON list, behind prose as well, an object with `tissue_list`, or a list with commas, semicolons or line ends."""
    whole = strip(answer)

    def of(text: Column) -> Column:
        listed = json_strings(F.regexp_extract(text, r"(?s)(\[.*\])", 1))
        named = F.get_json_object(text, "$.tissue_list")
        parts = F.split(F.regexp_replace(text, r'[\[\]"{}]', " "), r"[,\n;]+")
        found = F.coalesce(F.when(F.size(listed) > 0, listed), json_strings(named), parts)
        lowered = F.transform(found, lambda t: strip(F.lower(t)))
        return F.array_distinct(F.filter(lowered, lambda t: t.isin(*TISSUES, NO_TISSUE)))

    return once(whole, of)


def synonym_groups(gold: Column) -> Column:
    """Groups of lower-case synonyms of a JSON list of lists and texts; a text is a group by itself, blank ones go."""
    items = F.coalesce(json_strings(gold), F.array().cast("array<string>"))
    group = lambda item: F.coalesce(json_strings(item), F.array(item))
    cleaned = F.transform(items, lambda x: F.filter(F.transform(group(x), lambda s: strip(F.lower(s))), lambda s: s != ""))
    return F.filter(cleaned, lambda g: F.size(g) > 0)


def entity_type(raw: Column) -> Column:
    """One of ENTITY_TYPES, by name or alias; else other."""
    low = strip(F.lower(_text(raw)))
    names = F.create_map(*[F.lit(x) for k, v in ENTITY_ALIASES.items() for x in (k, v)])
    return F.when(low.isin(*ENTITY_TYPES), low).otherwise(F.coalesce(F.try_element_at(names, low), F.lit("other")))


def path_string(nodes: Column, edges: Column) -> Column:
    """a --[r]--> b --[s]--> c"""
    steps = F.zip_with(edges, F.slice(nodes, 2, F.greatest(F.lit(0), F.size(nodes) - 1)), lambda e, n: F.concat(F.lit(" --["), e, F.lit("]--> "), n))
    return F.concat(F.coalesce(F.get(nodes, F.lit(0)), F.lit("")), F.array_join(steps, ""))


def expression_gene(question: Column) -> Column:
    """The gene of `expression pattern of G gene`, null without one."""
    return F.nullif(F.regexp_extract(_text(question), r"(?i)expression pattern of ([A-Za-z0-9._-]+) gene", 1), F.lit(""))


def parameter_hash(**named: Column) -> Column:
    """A hash of parameters that doesn't depend on the order in which they are given: of their JSON with names in order."""
    return F.sha2(F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)])), 256)


def freshness(days: Column) -> Column:
    """The least of a day, week, month or year that has so many days; null without a bound."""
    return F.when(days.isNotNull(), F.when(days <= 1, "d").when(days <= 7, "w").when(days <= 31, "m").otherwise("y"))


def vector_query(question: Column, entities: Column, keywords: Column, kind: str = "entity") -> Column:
    """What is embedded of a question: its first entities, else keywords, else itself; `keyword`: keywords first; `full`: itself."""
    some = lambda words, n: F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, n), " "))
    return {"entity": F.coalesce(some(entities, 5), some(keywords, 3), question), "keyword": F.coalesce(some(keywords, 5), question), "full": question}[kind]


def nli_decision(yes_label: Column, no_label: Column, confidence: Column, yes_quote: Column, no_quote: Column, evidence: Column, reasoning: Column, negation: tuple[str, ...]) -> Column:
    """yes, no or maybe of two hypotheses that evidence entails, contradicts or leaves open.

    A contradiction of one alone decides for the other. An entailment counts with a quote, or with confidence above low; if both count, `no` unless
    confidence is low and nothing is negated. A negating phrase in the quote for `no` counts as entailment of it, and in any text as the last resort."""
    quoted = lambda q: ~F.lower(_text(q)).isin("null", "none", "")
    says_no = lambda *texts: F.lower(F.concat_ws(" ", *map(_text, texts))).rlike("|".join(negation))
    sure = confidence.isin("high", "medium")
    turned = quoted(no_quote) & says_no(no_quote)
    no_entailed, no_denied = turned | (no_label == "entails"), ~turned & (no_label == "contradicts")
    for_yes, for_no = (yes_label == "entails") & (quoted(yes_quote) | sure), no_entailed & (quoted(no_quote) | sure)
    return (
        F.when((yes_label == "contradicts") & ~no_denied, "no").when(no_denied & (yes_label != "contradicts"), "yes")
        .when(for_yes & ~for_no, "yes").when(for_no & ~for_yes, "no")
        .when(for_yes & for_no, F.when(says_no(evidence, no_quote, reasoning) | (confidence != "low"), "no").otherwise("maybe"))
        .when(says_no(evidence, yes_quote, no_quote, reasoning) | F.lower(_text(reasoning)).rlike("not |no |lack|fail|insufficient|contradict"), "no").otherwise("maybe")
    )


def masked_sentence(tokens: Column, probabilities: Column, least: Column | float) -> Column:
    """The tokens of the first sentence, joined, with a space for each whose probability is not above `least`; all of the tokens' text if nothing is left.

    The sentence ends with the first token at which the text so far, five characters at least, ends with . ! or ?"""
    size = F.size(tokens)

    def of(joined: Column) -> Column:
        so_far = lambda i: strip(F.array_join(F.slice(tokens, 1, i), ""))
        ends = F.filter(F.sequence(F.lit(1), size), lambda i: F.get(tokens, i - 1).rlike(rf"[.!?]{_SPACE}*$") & (F.length(so_far(i)) >= 5))
        last = F.coalesce(F.get(ends, F.lit(0)), size)
        kept = F.zip_with(F.slice(tokens, 1, last), F.slice(probabilities, 1, last), lambda t, p: F.when(p > least, t).otherwise(" "))
        return F.coalesce(F.nullif(strip(F.array_join(kept, "")), F.lit("")), joined)

    return F.when(size > 0, once(F.array_join(tokens, ""), of)).otherwise("")


def gate_after_reading(kind: Column, mode: Column, roles: Column, units: Column, supporting: Column, refuting: Column, papers: Column, least_papers: int = 2) -> Column:
    """Why assembled full-text evidence is used or not: the reason, which ends with ready or begins with balanced if it is."""
    few = papers < least_papers
    low = (F.size(roles) > 0) & (F.size(F.array_except(roles, F.array(*[F.lit(r) for r in LOW_SIGNAL_ROLES]))) == 0)
    return (
        F.when(mode.isin("abstract_fallback", "coverage_miss", "retrieval_miss"), F.concat(F.lit("assembly_"), mode)).when(low, "low_signal_sections_only")
        .when(kind == "yesno", F.when((supporting <= 0) | (refuting <= 0), "missing_polarity_balance").when(few, "insufficient_cross_paper_support").otherwise("balanced_yesno_fulltext"))
        .when(kind.isin("list", "summary"), F.when(units < 3, "too_few_evidence_units").when(few, "insufficient_cross_paper_support").otherwise("synthesis_fulltext_ready"))
        .when(kind.isin("factoid", "expression"), F.when(units < 2, "too_few_evidence_units").otherwise("detail_fulltext_ready"))
        .otherwise("question_type_not_eligible")
    )
