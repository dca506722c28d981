"""Sectioned full texts: filters, weights, expansion, trees, data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

#: How much a chunk's score counts by the role of its section.
ROLE_WEIGHTS = {"results": 1.15, "discussion": 1.1, "conclusion": 1.1, "abstract": 1.0, "methods": 0.9, "intro": 0.85, "raw": 0.8}
PREFERRED_BONUS = 0.05


def adjusted(chunks: DataFrame, preferred: tuple[str, ...] = ()) -> DataFrame:
    """chunks (score, role) with score times the role's weight, and a little more for preferred roles."""
    weight = F.lit(ROLE_WEIGHTS["raw"])
    for role, w in ROLE_WEIGHTS.items():
        weight = F.when(F.col("role") == role, w).otherwise(weight)
    bonus = F.when(F.col("role").isin(*preferred), PREFERRED_BONUS).otherwise(0.0) if preferred else F.lit(0.0)
    return chunks.withColumn("adjusted", F.round(F.col("score") * weight + bonus, 6))


def best_chunks(chunks: DataFrame) -> DataFrame:
    """Of equal chunk_ids the one of the highest adjusted score, on ties the first by rank."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*rest), F.struct(-F.col("adjusted"), F.col("rank"))).alias("r")).select("chunk_id", "r.*")


def listing(sections: DataFrame, focus: str | None = None, roles: tuple[str, ...] = (), limit: int | None = None, preview: int = 500) -> DataFrame:
    """Sections whose title or text has `focus`, of these roles, in order of level and place, with the first characters of their text."""
    out = sections
    if focus:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.lit(focus.lower())))
    if roles:
        out = out.where(F.col("role").isin(*roles))
    out = out.withColumn("preview", F.substring("text", 1, preview)).orderBy("paper_id", "level", "place")
    return out if limit is None else out.limit(limit)


def expand(sections: DataFrame, seeds: DataFrame, preferred: tuple[str, ...], neutral: tuple[str, ...] = ("abstract", "raw")) -> DataFrame:
    """For each paper of seeds (paper_id, section_id): its preferred sections, else its neutral ones, else the seeds."""
    tier = F.when(F.col("role").isin(*preferred), 0).when(F.col("role").isin(*neutral), 1).when(F.col("seed"), 2)
    marked = sections.join(seeds.select("paper_id").distinct(), "paper_id", "left_semi").join(seeds.select("paper_id", "section_id").distinct().withColumn("seed", F.lit(True)), ["paper_id", "section_id"], "left")
    marked = marked.withColumn("seed", F.coalesce("seed", F.lit(False))).withColumn("tier", tier).where("tier is not null")
    return marked.withColumn("least", F.min("tier").over(Window.partitionBy("paper_id"))).where("tier = least").drop("least", "seed")


def carried_headers(passages: DataFrame) -> DataFrame:
    """passages (paper_id, place, kind, text) with the title passage that each belongs to: the last one of kind title* before it."""
    title = F.when(F.startswith("kind", F.lit("title")), F.col("text"))
    return passages.withColumn("header", F.last(title, ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))


def tree(sections: DataFrame) -> DataFrame:
    """parent_id, children: of (section_id, parent_id, level, place), the children in order; a null parent is the root."""
    return sections.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "place", "section_id"))), lambda s: s["section_id"]).alias("children"))


def numbered(chunks: DataFrame, by: str = "section_id", order: str = "begin") -> DataFrame:
    return chunks.withColumn("chunk_order", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def chunk_faults(chunks: DataFrame, most_tokens: int = 512) -> DataFrame:
    """Chunks that break a rule: no text, no token or too many, one offset without the other, an end not behind its begin."""
    rules = {
        "text": F.col("text").isNull(), "tokens": ~F.col("tokens").between(1, most_tokens) | F.col("tokens").isNull(),
        "offsets": F.col("begin").isNull() != F.col("end").isNull(), "order": F.coalesce(F.col("end") <= F.col("begin"), F.lit(False)),
    }
    return chunks.withColumn("faults", F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())).where(F.size("faults") > 0)


def evidence_units(chunks: DataFrame) -> DataFrame:
    """paper_id, section_id, polarity: the best chunk of each, joined with the first chunk next to it in the same section."""
    best = chunks.groupBy("paper_id", "section_id", "polarity").agg(F.max_by(F.struct("place", "text", "score"), F.struct("score", -F.col("place"))).alias("b")).select("paper_id", "section_id", "polarity", "b.*")
    near = chunks.select("section_id", F.col("place").alias("near"), F.col("text").alias("near_text")).dropDuplicates(["section_id", "near"])
    joined = best.join(near, "section_id", "left").where(F.col("near").isNull() | (F.abs(F.col("near") - F.col("place")) <= 1))
    picked = joined.groupBy("paper_id", "section_id", "polarity", "place", "text", "score").agg(F.min_by(F.when(F.col("near") != F.col("place"), F.struct("near", "near_text")), F.when(F.col("near") != F.col("place"), F.col("near"))).alias("n"))
    text = F.when(F.col("n").isNull(), F.col("text")).when(F.col("n.near") < F.col("place"), F.concat_ws(" ", "n.near_text", "text")).otherwise(F.concat_ws(" ", "text", "n.near_text"))
    return picked.select("paper_id", "section_id", "polarity", "place", "score", text.alias("text"))


def polarity(column: Column) -> Column:
    """negative, positive or neutral, by phrases; a positive phrase that a negation stands before doesn't count."""
    low = F.lower(T.collapse(column))
    negative = low.rlike(r"\b(no (significant )?(difference|effect|association|evidence|benefit)|not (significantly )?(associated|different|effective)|did not|failed to|does not|lack of)\b")
    cleared = F.regexp_replace(low, r"\b(not|no|without|never|cannot|neither|nor)\b.{0,30}", " ")
    positive = cleared.rlike(r"\b(significantly (improved|increased|reduced|associated)|is (associated|effective)|was (associated|effective)|improves?|demonstrated|confirmed)\b")
    return F.when(negative, "negative").when(positive, "positive").otherwise("neutral")
