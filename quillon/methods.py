"""Question answering methods as flags of one pipeline: pools of passages, merged, reranked, packed, answered, checked, answered again.

All of a run's items go through each step together; model calls are the interfaces of services. An iterative method runs a fixed
number of rounds over all items.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import services
from quillon.functions import text as T
from quillon.operators import extraction as X
from quillon.operators import gates as G
from quillon.operators import packing as K
from quillon.operators import retrieval as R
from quillon.operators.graph import keep

#: What is added to a yes/no question to look for evidence against it.
AGAINST = " no effect OR not associated OR contradictory evidence"


@dataclass(frozen=True)
class Method:
    """pools: queries whose results are merged, of question, hypothesis, mixed (mean of both vectors), against (yes/no only), given (the item's own context)."""

    pools: tuple[str, ...] = ()
    wide: int = 20  # passages a pool
    rerank: int | None = None  # passages that reranking leaves
    rounds: int = 1  # further rounds search with what the last answer says
    gate: str | None = None  # which answers are asked for again: package, research, forced, never
    grounded: bool = False  # the gate asks for ground too
    rewrite: str | None = None  # which questions are rewritten: all, long, type
    again: str = "generate"  # what asks again: generate with all passages, or keep
    notes: bool = False  # one note a passage instead of its text
    best_passage: bool = False  # the answer of the best passage alone
    budget: int = 3000


_cascade = Method(pools=("question", "hypothesis"), rerank=20, gate="research")
_dual = replace(_cascade, pools=("question", "hypothesis", "against"), wide=30)
_dense = Method(pools=("question",))
_v14 = Method(pools=("question", "against"), rerank=20, gate="forced")

#: The methods that these flags tell apart, by their ids; abl-RC-gt and v14-forced-agent are settings under a second name. README lists the methods that are not built.
METHODS: dict[str, Method] = {
    "no-context": Method(), "no-context-frontier": Method(), "golden-context": Method(pools=("given",)),
    "dense": _dense, "dual-dense": replace(_dense, pools=("question", "against")), "hyde": replace(_dense, pools=("hypothesis",)), "hyde-mixed": replace(_dense, pools=("mixed",)),
    "rankrag": replace(_dense, wide=100, rerank=10), "chain-of-note": replace(_dense, notes=True),
    "ircot": replace(_dense, rounds=3), "ircot-rerank": replace(_dense, rounds=3, rerank=10), "self-rag-13b": replace(_dense, best_passage=True),
    "biomedrag": replace(_dense, wide=50, rerank=25),
    "v14": _v14, "v14.1": replace(_v14, wide=30), "v14.2": replace(_v14, wide=40), "v14.3": replace(_v14, wide=50), "v14-dh": replace(_v14, pools=("question", "hypothesis")),
    "v14-cascade": _cascade, "v14-cascade-rewrite": replace(_cascade, rewrite="all"), "v14-cascade-selective-rewrite": replace(_cascade, rewrite="long"), "v14-cascade-type-rewrite": replace(_cascade, rewrite="type"),
    "v14-forced-agent-trw": replace(_cascade, rewrite="type", gate="forced"), "v14-cascade-dual-rerank": _dual, "v14-forced-agent-dual-rerank": replace(_dual, gate="forced"),
    "v14-cascade-dual-rerank-grounded": replace(_dual, grounded=True),
    "abl-C-gt": replace(_cascade, grounded=True), "abl-R-gt": replace(_dual, gate="never"), "abl-RC-gt": replace(_dual, grounded=True), "abl-A-gt": replace(_dual, gate="forced"),
    "v14-cascade-grounded": replace(_cascade, grounded=True),
    "v14-cascade-dual-rerank-grounded-forcedfast": replace(_dual, grounded=True, gate="never"), "v14-forced-fast": replace(_v14, gate="never"), "v14-forced-agent": _v14, "v14-no-rejudge": replace(_v14, again="keep"),
    "pipeline": replace(_dual, gate="package", grounded=True),
}


@dataclass
class Services:
    embed: services.Embedder = field(default_factory=services.HashEmbedder)
    score: services.Scorer = field(default_factory=services.LexicalScorer)
    generate: services.Generator = field(default_factory=services.FirstSentenceGenerator)


def questions(items: DataFrame, method: Method) -> DataFrame:
    """items with the text that is searched for: rewritten to its terms if the method says so."""
    terms = F.array_join(T.query_terms(F.col("question")), " ")
    wanted = {"all": F.lit(True), "long": G.wants_rewrite(F.col("question")), "type": F.col("question_type").isin("factoid", "list")}.get(method.rewrite, F.lit(False))
    return items.withColumn("search", F.when(wanted & (terms != ""), terms).otherwise(F.col("question")))


def pool(items: DataFrame, passages: DataFrame, kind: str, method: Method, s: Services) -> DataFrame:
    """query_id, id, rank, score of one pool. passages: id, text, vector."""
    draft = s.generate(F.col("search"), F.col("question_type"), F.col("search"))
    ask = {
        "question": s.embed(F.col("search")), "hypothesis": s.embed(F.concat_ws(" ", F.col("search"), draft)), "against": s.embed(F.concat(F.col("search"), F.lit(AGAINST))),
        "mixed": F.zip_with(s.embed(F.col("search")), s.embed(F.concat_ws(" ", F.col("search"), draft)), lambda a, b: (a + b) / 2),
    }[kind]
    asked = items.where(F.col("question_type") == "yesno") if kind == "against" else items
    return R.dense_topk(passages.select("id", "vector"), asked.select("query_id", ask.alias("vector")), method.wide)


def evidence(items: DataFrame, passages: DataFrame, method: Method, s: Services) -> DataFrame:
    """query_id, id, rank, score, text: the method's passages."""
    runs = None
    for n, kind in enumerate(k for k in method.pools if k != "given"):
        run = pool(items, passages, kind, method, s).withColumn("pool", F.lit(n))
        runs = run if runs is None else runs.unionByName(run)
    merged = R.hydrate(R.merge_best(runs), passages, ["text"])
    if method.rerank:
        scored = merged.join(items.select("query_id", "search"), "query_id").withColumn("score", F.round(s.score(F.col("search"), F.substring("text", 1, 1500)), 6))
        merged = R.hydrate(R.ranked(scored, method.rerank), passages, ["text"])
    return merged


def run(items: DataFrame, passages: DataFrame, method: Method | str, s: Services | None = None) -> DataFrame:
    """query_id, question_type, predicted, context, escalated of items (query_id, question, question_type, context array<string>, confidence double).

    passages: id, text. Items without a passage have an empty context. Null questions are empty."""
    method, s = METHODS[method] if isinstance(method, str) else method, s or Services()
    asked = questions(items.withColumn("question", F.coalesce("question", F.lit(""))), method)
    held = keep(passages.withColumn("vector", s.embed(F.col("text")))) if method.pools and method.pools != ("given",) else None  # embedded once for all pools and rounds
    pooled = None
    for n in range(method.rounds if method.pools and method.pools != ("given",) else 1):
        if method.pools == ("given",):
            context = asked.select("query_id", F.array_join(F.coalesce("context", F.array()), "\n\n").alias("found"))
        elif method.pools:
            new = evidence(asked, held, method, s).select("query_id", F.lit(n).alias("pool"), "id", "rank", "score", "text")
            pooled = keep(new if pooled is None else pooled.unionByName(new)) if method.rounds > 1 else new  # a round adds to what the others found
            found = new if pooled is new else R.hydrate(R.merge_best(pooled), held, ["text"])
            text = T.first_sentence(F.col("text")) if method.notes else F.col("text")
            found = found.withColumn("text", text).withColumn("cost", T.token_estimate(F.col("text")))
            found = found.where("rank = 1") if method.best_passage else K.largest_prefix(found, method.budget)
            context = K.assembled(found).withColumnRenamed("context", "found")
        else:
            context = asked.select("query_id", F.lit("").alias("found"))
        answered = asked.join(context, "query_id", "left").withColumn("found", F.coalesce("found", F.lit("")))
        answered = answered.withColumn("predicted", X.extracted(s.generate(F.col("question"), F.col("question_type"), F.col("found")), F.col("question_type")))
        if n + 1 < method.rounds:
            asked = answered.withColumn("search", F.trim(F.concat_ws(" ", "question", "predicted"))).drop("found", "predicted")
    kind, said = F.col("question_type"), F.col("predicted")
    ground = G.grounded(said, F.array("found"), kind) if method.grounded else F.lit(True)
    confidence = F.col("confidence") if "confidence" in items.columns else F.lit(None).cast("double")
    wanted = {
        None: F.lit(False), "never": F.lit(False), "forced": F.lit(True), "package": G.escalates(kind, confidence, said, ground),
        "research": G.escalates_research(kind, confidence, said, ground, G.no_data(said)),
    }[method.gate]
    again = X.extracted(s.generate(F.col("question"), kind, F.concat_ws("\n\n", "found", "question")), kind)
    out = answered.withColumn("escalated", F.coalesce(wanted, F.lit(False)))
    if method.again == "generate":
        out = out.withColumn("predicted", F.when(F.col("escalated") & (again != ""), again).otherwise(said))
    return out.select("query_id", "question_type", "predicted", F.col("found").alias("context"), "escalated")


def sweep(items: DataFrame, passages: DataFrame, base: Method, rounds: tuple[int, ...], wide: tuple[int, ...]) -> DataFrame:
    """rounds, wide, and the run's columns, for each of a grid of settings."""
    out = None
    for r in rounds:
        for w in wide:
            part = run(items, passages, replace(base, rounds=r, wide=w)).select(F.lit(r).alias("rounds"), F.lit(w).alias("wide"), "*")
            out = part if out is None else out.unionByName(part)
    return out
