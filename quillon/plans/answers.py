"""Answer scoring, gates and lookups, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import services as V
from quillon.functions import scores as S
from quillon.functions import text as T
from quillon.operators import gates as G
from quillon.operators import extraction as X
from quillon.operators import lookups as L
from quillon.operators import retrieval as R

from .registry import query, table

TOKENS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\[-`{{-~]', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("predicted"), F.concat(F.lit("The "), F.lower("p_type"), F.lit(" "), F.element_at(F.split("p_name", " "), 2)).alias("gold"))


PAIRS = "SELECT p_partkey, p_name AS predicted, 'The ' || lower(p_type) || ' ' || string_split(p_name, ' ')[2] AS gold FROM part"


def f1_sql(p: str, g: str) -> str:
    both = f"CAST(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))) AS DOUBLE)"
    return f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 OR {both} = 0 THEN 0.0 ELSE 2 * {both} / (len({p}) + len({g})) END"


@query("token_f1", f"WITH t AS (SELECT p_partkey, {TOKENS.format('predicted')} AS p, {TOKENS.format('gold')} AS g FROM ({PAIRS})) SELECT p_partkey, round({f1_sql('p', 'g')}, 6) AS f1 FROM t")
def token_f1(spark, sf_dir):
    return pairs(spark, sf_dir).select("p_partkey", F.round(S.token_f1(F.col("predicted"), F.col("gold")), 6).alias("f1"))


@query("token_f1_max_variants", f"""
WITH v AS (SELECT p_partkey, predicted, unnest([gold, predicted || ' extra words', 'none']) AS gold FROM ({PAIRS})), t AS (SELECT p_partkey, {TOKENS.format('predicted')} AS p, {TOKENS.format('gold')} AS g FROM v)
SELECT p_partkey, round(max({f1_sql('p', 'g')}), 6) AS f1 FROM t GROUP BY p_partkey""")
def token_f1_max_variants(spark, sf_dir):
    variants = F.to_json(F.array(F.col("gold"), F.concat("predicted", F.lit(" extra words")), F.lit("none")))
    return pairs(spark, sf_dir).select("p_partkey", F.round(S.best_token_f1(F.col("predicted"), S.gold_variants(variants)), 6).alias("f1"))


@query("answer_tokens", f"SELECT item_id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM benchmark")
def answer_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.answer_tokens(F.col("text")), " ").alias("tokens"))


SETS = "SELECT o_orderkey, list_distinct(list(l_partkey % 50) FILTER (WHERE l_linenumber <= 3)) AS p, list_distinct(list(l_partkey % 50) FILTER (WHERE l_linenumber >= 2)) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderkey"


@query("set_f1", f"""
WITH s AS (SELECT o_orderkey, coalesce(p, []) AS p, coalesce(g, []) AS g FROM ({SETS})), n AS (SELECT *, len(list_intersect(p, g)) AS shared FROM s)
SELECT o_orderkey, round(CASE WHEN len(g) = 0 THEN 1.0 WHEN len(p) = 0 THEN 0.0 ELSE shared / CAST(len(p) AS DOUBLE) END, 6) AS precision, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE shared / CAST(len(g) AS DOUBLE) END, 6) AS recall,
round(CASE WHEN len(g) = 0 THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE 2.0 * shared / (len(p) + len(g)) END, 6) AS f1 FROM n""")
def set_f1(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    key = F.col("l_partkey") % 50
    sets = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, key)).alias("p"), F.collect_set(F.when(F.col("l_linenumber") >= 2, key)).alias("g"))
    s = sets.withColumn("s", S.set_scores(F.col("p"), F.col("g")))
    return s.select("o_orderkey", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query("yesno_exact", "SELECT doc_id, CAST(CASE WHEN (CASE WHEN quality = 1 THEN ' Yes' ELSE 'no' END) ILIKE '%yes%' = (toxic = 0) THEN 1 ELSE 0 END AS DOUBLE) AS score FROM labels")
def yesno_exact(spark, sf_dir):
    said, gold = F.when(F.col("quality") == 1, " Yes").otherwise("no"), F.when(F.col("toxic") == 0, "YES ").otherwise("no")
    return table(spark, sf_dir, "labels").select("doc_id", S.yesno(said, gold).alias("score"))


@query("mcq_score", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'nothing' END AS letter FROM part""")
def mcq_score(spark, sf_dir):
    options = F.create_map(F.lit("A"), F.lit("red ring"), F.lit("B"), F.lit("blue bolt"), F.lit("C"), F.lit("green gear"))
    said = F.element_at(F.array(F.lit("b"), F.lit("Red Ring "), F.lit("the blue bolt"), F.lit("green"), F.lit("nothing")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.choice(said, options).alias("letter"))


@query("mcq_multi_letters", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A,C' WHEN 1 THEN 'B,D' ELSE '' END AS letters FROM part")
def mcq_multi_letters(spark, sf_dir):
    said = F.element_at(F.array(F.lit('["c", "A", "A"]'), F.lit("Answers: D and B."), F.lit("none of them")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.choices(said), ",").alias("letters"))


@query("synonym_group_match", """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS matched,
round(CASE WHEN p_partkey % 6 = 0 THEN 1.0 WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 0.5 ELSE 0.0 END, 6) AS f1 FROM part""")
def synonym_group_match(spark, sf_dir):
    said = F.array(F.when(F.col("p_partkey") % 2 == 0, " TP53").otherwise("x"), F.when(F.col("p_partkey") % 3 == 0, "her2").otherwise("y"))
    groups = F.array(F.array(F.lit("tp53"), F.lit("p53")), F.array(F.lit("ERBB2"), F.lit("HER2")))
    return table(spark, sf_dir, "part").select("p_partkey", S.groups_matched(said, groups).alias("matched"), F.round(S.group_f1(said, groups), 6).alias("f1"))


@query("probabilities", "SELECT event_id, round(exp(-value), 6) AS p, round(exp(-value) / (exp(-value) + exp(-value / 2)), 6) AS yes FROM events")
def probabilities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(S.probability(-F.col("value")), 6).alias("p"), F.round(S.yes_probability(-F.col("value"), -F.col("value") / 2), 6).alias("yes"))


@query("escalation_predicate", """
SELECT event_id, (value / 100 < 0.7 OR event_type = 'error' OR (event_id % 5 = 0 AND event_id % 2 = 1)) AND event_id % 7 <> 0 AS escalate FROM events""")
def escalation_predicate(spark, sf_dir):
    kind = F.when(F.col("event_id") % 7 == 0, "yesno").when(F.col("event_id") % 5 == 0, "factoid").otherwise("mcq")
    answer = F.when(F.col("event_type") == "error", " ").otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", G.escalates(kind, F.col("value") / 100, answer, F.col("event_id") % 2 == 0).alias("escalate"))


@query("groundedness", """
SELECT d.doc_id, contains(lower(coalesce(d.text, '')), lower(b.text)) OR length(b.text) <= 3 AS grounded FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def groundedness(spark, sf_dir):
    benchmark = table(spark, sf_dir, "benchmark")
    items = benchmark.select("item_id", F.col("text").alias("answer"))
    docs = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % benchmark.count()).join(items, "item_id")
    return docs.select("doc_id", G.grounded(F.col("answer"), F.array("text"), F.lit("factoid")).alias("grounded"))


@query("gate_precheck", """
SELECT c_custkey, c_custkey % 5 >= 2 AND c_custkey % 3 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 3 = 1) AS use,
CASE WHEN c_custkey % 3 = 0 THEN 'type' WHEN c_custkey % 5 < 2 THEN 'coverage' WHEN c_custkey % 2 = 0 THEN 'depth' WHEN c_custkey % 3 = 1 THEN 'polarity' ELSE 'shallow' END AS reason FROM customer""")
def gate_precheck(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "mcq").when(k % 3 == 1, "yesno").otherwise("factoid")
    question = F.when(k % 2 == 0, "What is the mechanism of it?").otherwise("Is it so?")
    return table(spark, sf_dir, "customer").select("c_custkey", G.needs_full_text(question, kind, (k % 5).cast("int")).alias("g")).select("c_custkey", "g.use", "g.reason")


@query("tool_routing", """
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(['SEARCH'], CASE WHEN c_custkey % 4 = 0 THEN ['GENE'] ELSE [] END, CASE WHEN c_custkey % 3 = 1 THEN ['KEYWORD'] WHEN c_custkey % 3 = 2 THEN ['FULLTEXT'] ELSE [] END))), ',') AS groups FROM customer""")
def tool_routing(spark, sf_dir):
    k = F.col("c_custkey")
    question = F.when(k % 4 == 0, "Which gene is it?").otherwise("What is it?")
    kind = F.when(k % 3 == 1, "factoid").when(k % 3 == 2, "summary").otherwise("yesno")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(G.routes(question, kind, {"GENE": r"\bgene\b"}), ",").alias("groups"))


@query("alias_resolve", """
WITH n AS (SELECT p_name AS name, p_partkey AS id, 1 AS p FROM part UNION ALL SELECT p_brand, p_partkey, 0 FROM part WHERE p_partkey % 10 = 0), q AS (SELECT DISTINCT p_name AS query FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT query, id, CASE p WHEN 0 THEN 'symbol' ELSE 'alias' END AS how FROM q JOIN n ON lower(trim(q.query)) = lower(trim(n.name)) QUALIFY row_number() OVER (PARTITION BY query ORDER BY p, id) = 1""")
def alias_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("alias").alias("kind")).union(part.where("p_partkey % 10 = 0").select("p_partkey", "p_brand", F.lit("symbol")))
    asked = part.select(F.col("p_name").alias("query")).union(part.select("p_brand")).distinct()
    return L.resolve_alias(asked, names)


@query("sequence_hash_lookup", "SELECT a.doc_id AS query, b.doc_id AS id FROM documents a JOIN documents b ON trim(a.text) = trim(b.text) WHERE a.doc_id % 50 = 0")
def sequence_hash_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), F.col("text").alias("sequence"))  # the stated queries
    return L.by_sequence(asked, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("sequence")))


TIERS = """
WITH n AS (SELECT p_partkey AS id, p_name AS name, 'name' AS kind FROM part UNION ALL SELECT p_partkey, p_brand, 'synonym' FROM part), q AS (SELECT unnest(['red ring', 'Brand#3', 'bolt']) AS query),
h AS (SELECT query, id, CASE WHEN kind = 'name' AND lower(name) = lower(query) THEN 0 WHEN kind = 'synonym' AND lower(name) = lower(query) THEN 1 WHEN kind = 'name' AND contains(lower(name), lower(query)) THEN 2 END AS tier, name FROM n, q),
b AS (SELECT query, id, tier, name FROM h WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY tier, name) = 1)
SELECT query, id, CAST(tier AS INT) AS tier, name FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, id) <= 20"""


@query("drug_lookup_tiers", TIERS)
def drug_lookup_tiers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("name").alias("kind")).union(part.select("p_partkey", "p_brand", F.lit("synonym")))
    return L.by_tiers(spark.createDataFrame([("red ring",), ("Brand#3",), ("bolt",)], "query string"), names, 20)


@query("vocabulary_max", "SELECT p_brand, CASE lower(trim(p_type)) WHEN 'economy' THEN 'standard' ELSE lower(trim(p_type)) END AS p_type, max(p_retailprice) AS p_retailprice FROM part GROUP BY ALL")
def vocabulary_max(spark, sf_dir):
    return L.vocabulary_max(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_retailprice", {"economy": "standard"})


@query("term_resolve", """
WITH q AS (SELECT unnest(['ASIA', 'nation#3', '7', 'zzz']) AS query), t AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation),
h AS (SELECT query, id, CASE WHEN lower(id) = lower(query) THEN 1 WHEN lower(name) = lower(query) THEN 2 WHEN contains(lower(name), lower(query)) OR contains(lower(query), lower(name)) THEN 3 END AS how FROM q, t)
SELECT query, id, (['id', 'name', 'part'])[how] AS how FROM h WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY how, id) = 1""")
def term_resolve(spark, sf_dir):
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return L.resolve_term(spark.createDataFrame([("ASIA",), ("nation#3",), ("7",), ("zzz",)], "query string"), terms)


SAID = """SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'I think Yes, it does.' WHEN 1 THEN 'The answer is (B) because' WHEN 2 THEN 'no way' ELSE 'C) it is' END AS said FROM conversations"""


@query("answer_extract_yesno", rf"SELECT conv_id, turn, regexp_extract(lower(said), '\b(yes|no|maybe)\b', 1) AS answer FROM ({SAID})")
def answer_extract_yesno(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", X.yesno_answer(F.col("said")).alias("answer"))


@query("answer_extract_mcq", f"SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'B' WHEN 2 THEN '' ELSE 'C' END AS answer FROM ({SAID})")
def answer_extract_mcq(spark, sf_dir):
    return said(spark, sf_dir).select("conv_id", "turn", X.letter_answer(F.col("said")).alias("answer"))


@query("answer_extract_list", "SELECT p_partkey, p_name || '|' || p_brand || '|last' AS answer FROM part")
def answer_extract_list(spark, sf_dir):
    text = F.concat(F.lit("1. "), F.col("p_name"), F.lit(",\n - "), F.col("p_brand"), F.lit("; and last."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.list_answer(text), "|").alias("answer"))


def said(spark, sf_dir):
    k = F.col("conv_id") % 4
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(k == 0, "I think Yes, it does.").when(k == 1, "The answer is (B) because").when(k == 2, "no way").otherwise("C) it is").alias("said"))


@query("rouge_l")
def rouge_l(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turn = lambda n, name: c.where(F.col("turn") == n).select("conv_id", F.col("text").alias(name))
    return turn(0, "a").join(turn(1, "b"), "conv_id").select("conv_id", X.rouge_scores(F.col("a"), F.col("b")).alias("r")).select("conv_id", *[F.round(f"r.{x}", 6).alias(x) for x in ("rouge1", "rouge2", "rougeL")])


@query("embed_and_rerank")
def embed_and_rerank(spark, sf_dir):
    """Benchmark items as questions, documents as articles: hashed embeddings, dense top 10, lexical score."""
    embed, score = V.HashEmbedder(), V.LexicalScorer()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    top = R.dense_topk(docs.select("id", embed(F.col("text")).alias("vector")), items.select("query_id", embed(F.col("question")).alias("vector")), 10)
    return R.hydrate(top, docs, ["text"]).join(items, "query_id").select("query_id", "id", "rank", F.round(score(F.col("question"), F.col("text")), 6).alias("lexical"))
