"""Parsing, decision, chunking and evidence queries. Answers in a model's or a service's format are made of the tables' own columns, which the SQL parses with its own functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import parsing as P
from quillon.functions import text as T
from quillon.operators import chunking as C
from quillon.operators import evidence as E

from .registry import query, table

SPACE = r"[ \t\n\r\f\x0B]"
STRIP = rf"regexp_replace(coalesce({{0}}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')"


@query("sentence_chunks", rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_transform(string_split(regexp_replace({STRIP.format('text')}, '([.!?]){SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}) AS parts FROM documents),
f AS (
  SELECT doc_id, parts, 0 AS n, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS last FROM s
  UNION ALL
  SELECT doc_id, parts, n + 1,
    CASE WHEN length(x) < 30 AND last IS NOT NULL AND length(last) + 1 + length(x) <= 280 THEN [] WHEN x = '' OR last IS NULL THEN [] ELSE [last] END
      || CASE WHEN length(x) > 280 THEN list_transform(range(0, (length(x) - 1) // 280), lambda i: substr(x, i * 280 + 1, 280)) ELSE [] END,
    CASE WHEN length(x) < 30 AND last IS NOT NULL AND length(last) + 1 + length(x) <= 280 THEN {STRIP.format("last || ' ' || x")} WHEN x = '' THEN last ELSE substr(x, (length(x) - 1) // 280 * 280 + 1, 280) END
  FROM (SELECT *, parts[n + 1] AS x FROM f WHERE n < len(parts))),
c AS (
  SELECT doc_id, n, unnest(done) AS chunk, generate_subscripts(done, 1) AS k FROM f
  UNION ALL SELECT doc_id, n + 1, last, 0 FROM f WHERE n = len(parts) AND last IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INT) AS place, chunk FROM c WHERE length(chunk) >= 15""")
def sentence_chunks(spark, sf_dir):
    return C.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query("token_chunks")
def token_chunks(spark, sf_dir):
    return C.token_chunks(table(spark, sf_dir, "documents"), "doc_id")


RESPONSE = "'Route: ' || CASE WHEN lang = 'en' THEN 'Yes' ELSE 'no' END || chr(10) || 'GENES: ' || CASE WHEN lang = 'de' THEN 'none' ELSE source || ', , ' || upper(lang) END || chr(10) || 'tissues:' || coalesce(text, '')"


@query("router_response", rf"""
WITH r AS (SELECT doc_id, {RESPONSE} AS a FROM documents),
l AS (SELECT doc_id, upper(regexp_extract(a, 'ROUTE:{SPACE}*(YES|NO)', 1, 'i')) = 'YES' AS route, {STRIP.format(f"regexp_extract(a, 'GENES:{SPACE}*([^\n]+)', 1, 'i')")} AS g, {STRIP.format(f"regexp_extract(a, 'TISSUES:{SPACE}*([^\n]+)', 1, 'i')")} AS t FROM r)
SELECT doc_id, route, CASE WHEN upper(g) = 'NONE' THEN '' ELSE array_to_string(list_filter(list_transform(string_split(g, ','), lambda x: {STRIP.format('x')}), lambda x: x <> ''), '|') END AS genes,
CASE WHEN upper(t) = 'NONE' THEN 0 ELSE len(list_filter(list_transform(string_split(t, ','), lambda x: {STRIP.format('x')}), lambda x: x <> '')) END AS n_tissues FROM l""")
def router_response(spark, sf_dir):
    c = F.col
    genes = F.when(c("lang") == "de", "none").otherwise(F.concat(c("source"), F.lit(", , "), F.upper("lang")))
    answer = F.concat(F.lit("Route: "), F.when(c("lang") == "en", "Yes").otherwise("no"), F.lit("\nGENES: "), genes, F.lit("\ntissues:"), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", answer.alias("a"))
    return docs.select("doc_id", P.route_flag(c("a")).alias("route"), F.array_join(P.list_after(c("a"), "GENES"), "|").alias("genes"), F.size(P.list_after(c("a"), "TISSUES")).cast("long").alias("n_tissues"))


TISSUE_LIST = ", ".join(f"'{t}'" for t in (*P.TISSUES, P.NO_TISSUE))


@query("tissue_list", rf"""
WITH t AS (SELECT doc_id, doc_id % 5 AS k, ([{TISSUE_LIST}])[1 + doc_id % 28] AS a, ([{TISSUE_LIST}])[1 + doc_id * 7 % 28] AS b, source FROM documents),
l AS (SELECT doc_id, CASE WHEN k = 2 THEN [lower(a), lower(b)] ELSE [a, source, b, a] END AS found FROM t)
SELECT doc_id, array_to_string(list_filter(found, lambda x, i: list_contains([{TISSUE_LIST}], x) AND NOT list_contains(found[1 : i - 1], x)), '|') AS tissues FROM l""")
def tissue_list(spark, sf_dir):
    """Five formats: a JSON list behind prose, a list with line ends, an object, a bare JSON list, and one with commas and semicolons."""
    names = F.array(*[F.lit(t) for t in (*P.TISSUES, P.NO_TISSUE)])
    docs = table(spark, sf_dir, "documents")
    a, b, s, k = F.get(names, (F.col("doc_id") % 28).cast("int")), F.get(names, (F.col("doc_id") * 7 % 28).cast("int")), F.col("source"), F.col("doc_id") % 5
    listed = F.format_string('["%s", "%s", " %s", "%s"]', F.initcap(a), s, b, a)
    answer = F.when(k == 0, F.concat(F.lit("Here they are: "), listed, F.lit("."))).when(k == 1, F.concat_ws("\n", a, s, F.upper(b), a)).when(k == 2, F.format_string('{"tissue_list": ["%s", "%s"]}', a, b)).when(k == 3, listed)
    answer = answer.otherwise(F.format_string("%s, %s; %s,%s", a, s, b, a))
    return docs.select("doc_id", F.array_join(P.tissues(answer), "|").alias("tissues"))


@query("synonym_groups", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 2 END AS n_groups, lower(source) || CASE WHEN doc_id % 3 = 0 THEN '|' || lower(lang) ELSE '' END AS first FROM documents""")
def synonym_groups(spark, sf_dir):
    """Gold answers as JSON: a list of lists, of texts, and of both with blanks."""
    k, s, lang = F.col("doc_id") % 3, F.col("source"), F.col("lang")
    gold = F.when(k == 0, F.format_string('[["%s", " %s "], ["x"]]', F.upper(s), F.upper(lang))).when(k == 1, F.format_string('["%s", "%s"]', s, lang)).otherwise(F.format_string('[["", "%s"], "", []]', s))
    groups = table(spark, sf_dir, "documents").select("doc_id", P.synonym_groups(gold).alias("g"))
    return groups.select("doc_id", F.size("g").alias("n_groups"), F.array_join(F.get("g", F.lit(0)), "|").alias("first"))


#: Phrases that deny, in these examples.
NEGATION = ("not associated", "no significant", "did not", "stupid")


@query("nli_decision", """
WITH t AS (
  SELECT doc_id, (['entails', 'contradicts', 'neutral'])[1 + doc_id % 3] AS y, (['neutral', 'entails', 'contradicts'])[1 + doc_id // 3 % 3] AS n, (['low', 'medium', 'high'])[1 + doc_id // 9 % 3] AS c,
         CASE WHEN doc_id // 27 % 2 = 0 THEN 'null' ELSE source END AS yq, CASE WHEN doc_id // 54 % 2 = 0 THEN '' ELSE coalesce(text, '') END AS nq, lang AS e, CASE WHEN doc_id // 5 % 2 = 0 THEN coalesce(text, '') ELSE '' END AS r FROM documents),
q AS (SELECT *, nq <> '' AND regexp_matches(lower(nq), 'not associated|no significant|did not|stupid') AS turned FROM t),
p AS (SELECT *, turned OR n = 'entails' AS ne, NOT turned AND n = 'contradicts' AS nc, y = 'entails' AND (yq <> 'null' OR c <> 'low') AS fy,
      (turned OR n = 'entails') AND (nq <> '' OR c <> 'low') AS fn, regexp_matches(lower(concat_ws(' ', e, nq, r)), 'not associated|no significant|did not|stupid') AS denied FROM q)
SELECT doc_id, CASE WHEN y = 'contradicts' AND NOT nc THEN 'no' WHEN nc AND y <> 'contradicts' THEN 'yes' WHEN fy AND NOT fn THEN 'yes' WHEN fn AND NOT fy THEN 'no'
  WHEN fy AND fn THEN CASE WHEN denied OR c <> 'low' THEN 'no' ELSE 'maybe' END
  WHEN denied OR regexp_matches(lower(yq), 'not associated|no significant|did not|stupid') OR regexp_matches(lower(r), 'not |no |lack|fail|insufficient|contradict') THEN 'no' ELSE 'maybe' END AS decision FROM p""")
def nli_decision(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda names, at: F.get(F.array(*[F.lit(x) for x in names]), (at % 3).cast("int"))
    third, ninth = F.floor(i / 3), F.floor(i / 9)
    decision = P.nli_decision(
        pick(("entails", "contradicts", "neutral"), i), pick(("neutral", "entails", "contradicts"), third), pick(("low", "medium", "high"), ninth),
        F.when(F.floor(i / 27) % 2 == 0, "null").otherwise(F.col("source")), F.when(F.floor(i / 54) % 2 == 0, "").otherwise(F.col("text")), F.col("lang"), F.when(F.floor(i / 5) % 2 == 0, F.col("text")).otherwise(""), NEGATION,
    )
    return table(spark, sf_dir, "documents").select("doc_id", decision.alias("decision"))


@query("masked_sentence", rf"""
WITH w AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END) AS t FROM benchmark),
e AS (SELECT item_id, t, coalesce(list_min(list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '[.!?]{SPACE}*$') AND length({STRIP.format("array_to_string(t[1:i], '')")}) >= 5)), len(t)) AS n FROM w),
k AS (SELECT item_id, t, {STRIP.format("array_to_string(list_transform(t[1:n], lambda x, i: CASE WHEN (length(x) * 7 + i) % 10 / 10.0 > 0.4 THEN x ELSE ' ' END), '')")} AS kept FROM e)
SELECT item_id, CASE WHEN kept = '' THEN array_to_string(t, '') ELSE kept END AS query FROM k""")
def masked_sentence(spark, sf_dir):
    """Words as tokens, with a probability by length and place."""
    tokens = F.transform(F.split("text", " "), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(" "), x)))
    held = table(spark, sf_dir, "benchmark").select("item_id", tokens.alias("t")).withColumn("p", F.transform("t", lambda x, i: (F.length(x) * 7 + i + 1) % 10 / 10.0))
    return held.select("item_id", P.masked_sentence(F.col("t"), F.col("p"), 0.4).alias("query"))


RANKED_DOCS = "SELECT source AS query_id, doc_id, lang, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents"


def ranked_docs(spark, sf_dir, most=20):
    """The longest documents of a source, as its results. The bound on the rank is applied before the shuffle too, so a large source is no large group; the texts join afterwards."""
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    places = docs.select(F.col("source").alias("query_id"), "doc_id", rank.alias("rank")).where(F.col("rank") <= most)
    return places.join(docs.select("doc_id", "lang", "text", "n_chars"), "doc_id")


@query("evidence_block", f"""
SELECT query_id, 'PubMed Evidence:' || chr(10) || string_agg('[' || rank || '] PMID ' || doc_id || chr(10) || 'Title: ' || lang || chr(10) || 'Abstract: ' || substr(coalesce(text, ''), 1, 1200), chr(10) || chr(10) ORDER BY rank) AS evidence
FROM ({RANKED_DOCS}) WHERE rank <= 5 GROUP BY query_id""")
def evidence_block(spark, sf_dir):
    c = F.col
    return E.blocks(ranked_docs(spark, sf_dir), E.article_block(c("rank"), c("doc_id"), c("lang"), c("text")), most=5, head="PubMed Evidence:\n")


@query("section_evidence", rf"""
SELECT query_id, string_agg('[Chunk ' || rank || ' | PMID:' || doc_id || ' | role:' || CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE lang END || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' | title:' || lang END || ' | stage:seed]' || chr(10) || {STRIP.format('text')},
  chr(10) || chr(10) ORDER BY rank) AS evidence FROM ({RANKED_DOCS}) WHERE rank <= 20 AND {STRIP.format('text')} <> '' GROUP BY query_id""")
def section_evidence(spark, sf_dir):
    c = F.col
    block = E.section_block(c("rank"), c("doc_id"), F.when(c("doc_id") % 3 != 0, c("lang")), F.when(c("doc_id") % 2 != 0, c("lang")), F.lit(""), c("text"))
    return E.blocks(ranked_docs(spark, sf_dir), block, most=20)


@query("token_truncated", f"""
WITH u AS (SELECT *, CAST(greatest(1, ceil(n_chars / 4.0)) AS BIGINT) AS cost FROM ({RANKED_DOCS}) WHERE rank <= 20),
b AS (SELECT *, coalesce(CAST(sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM u)
SELECT query_id, doc_id, before + cost <= 9000 AS fits, length(CASE WHEN before + cost <= 9000 THEN text ELSE substr(text, 1, 4 * (9000 - before)) END) AS n FROM b WHERE before <= 9000 AND (before + cost <= 9000 OR 9000 - before > 50)""")
def token_truncated(spark, sf_dir):
    rows = ranked_docs(spark, sf_dir).withColumn("cost", T.token_estimate(F.col("text")))
    return E.token_truncated(rows, 9000).select("query_id", "doc_id", "fits", F.length("text").cast("long").alias("n"))


KINDS = ("yesno", "list", "factoid", "mcq", "summary")


@query("gate_postcheck", """
WITH g AS (
  SELECT user_id, event_type, count(*) AS units, count(*) FILTER (WHERE value > 300) AS s, count(*) FILTER (WHERE value < 30) AS r, count(DISTINCT CAST(floor(value / 100) AS BIGINT)) AS papers,
         list_distinct(list(CASE WHEN value < 250 THEN 'methods' WHEN user_id % 3 = 0 THEN 'results' ELSE 'background' END)) AS roles,
         CASE WHEN user_id % 11 = 0 THEN 'coverage_miss' ELSE 'section_aware' END AS mode, (['yesno', 'list', 'factoid', 'mcq', 'summary'])[1 + user_id % 5] AS kind FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, CASE WHEN mode = 'coverage_miss' THEN 'assembly_coverage_miss' WHEN NOT list_contains(roles, 'results') THEN 'low_signal_sections_only'
  WHEN kind = 'yesno' THEN CASE WHEN s <= 0 OR r <= 0 THEN 'missing_polarity_balance' WHEN papers < 2 THEN 'insufficient_cross_paper_support' ELSE 'balanced_yesno_fulltext' END
  WHEN kind IN ('list', 'summary') THEN CASE WHEN units < 3 THEN 'too_few_evidence_units' WHEN papers < 2 THEN 'insufficient_cross_paper_support' ELSE 'synthesis_fulltext_ready' END
  WHEN kind = 'factoid' THEN CASE WHEN units < 2 THEN 'too_few_evidence_units' ELSE 'detail_fulltext_ready' END ELSE 'question_type_not_eligible' END AS reason FROM g""")
def gate_postcheck(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    roles = F.when(v < 250, "methods").when(u % 3 == 0, "results").otherwise("background")
    groups = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("units"), F.count_if(v > 300).alias("s"), F.count_if(v < 30).alias("r"), F.count_distinct(F.floor(v / 100)).alias("papers"), F.collect_set(roles).alias("roles"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (u % 5).cast("int"))
    mode = F.when(u % 11 == 0, "coverage_miss").otherwise("section_aware")
    c = F.col
    return groups.select("user_id", "event_type", P.gate_after_reading(kind, mode, c("roles"), c("units"), c("s"), c("r"), c("papers")).alias("reason"))


@query("trace_filters", """
WITH t AS (SELECT event_id, event_type, value / 490 AS score, CAST(floor(value / 100) AS BIGINT) AS iterations FROM events)
SELECT 'hard' AS kind, event_type, count(*) AS n FROM t WHERE score < 0.5 GROUP BY event_type UNION ALL SELECT 'timeout', event_type, count(*) FROM t WHERE iterations >= 4 GROUP BY event_type""")
def trace_filters(spark, sf_dir):
    traces = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 490).alias("score"), F.floor(F.col("value") / 100).alias("iterations"), F.lit(4).alias("max_iterations"))
    count = lambda df, kind: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "event_type", "n")
    return count(E.hard_cases(traces), "hard").unionByName(count(E.timed_out(traces), "timeout"))


@query("subtask_scores", """
WITH t AS (SELECT event_type, (['yesno', 'list', 'factoid', 'mcq', 'summary'])[1 + user_id % 5] AS question_type, value > 100 AS correct, CASE WHEN event_id % 7 > 0 THEN value / 500 END AS f1, CASE WHEN event_id % 5 > 0 THEN value / 1000 END AS rouge_l FROM events)
SELECT event_type, question_type, count(*) AS total, count(*) FILTER (WHERE correct) AS correct,
  round(coalesce(avg(CASE WHEN question_type IN ('yesno', 'mcq') THEN CAST(correct AS DOUBLE) WHEN question_type = 'list' THEN f1 ELSE rouge_l END), 0), 6) AS score FROM t GROUP BY event_type, question_type""")
def subtask_scores(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("user_id") % 5).cast("int"))
    results = table(spark, sf_dir, "events").select("event_type", kind.alias("question_type"), (v > 100).alias("correct"), F.when(i % 7 > 0, v / 500).alias("f1"), F.when(i % 5 > 0, v / 1000).alias("rouge_l"))
    return E.subtask_scores(results, ["event_type", "question_type"])


@query("option_histogram", "SELECT n_options, count(*) AS n FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_options FROM lineitem GROUP BY l_orderkey) GROUP BY n_options")
def option_histogram(spark, sf_dir):
    options = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.size(F.collect_set("l_partkey")).cast("long").alias("n_options"))
    return options.groupBy("n_options").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, len(list(DISTINCT n_chars)) AS n_sizes FROM documents GROUP BY source")
def distinct_sets(spark, sf_dir):
    return E.distinct_sets(table(spark, sf_dir, "documents"), "source", ["lang", "n_chars"]).select("source", F.array_join("langs", ",").alias("langs"), F.size("n_charss").cast("long").alias("n_sizes"))


@query("extraction_stats", """
WITH o AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS e, count(DISTINCT l_suppkey) AS r FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, (['success', 'error', 'empty'])[1 + l_orderkey % 3] AS status FROM o)
SELECT count(*) AS total_documents, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'empty') AS empty,
CAST(sum(e) FILTER (WHERE status = 'success') AS BIGINT) AS total_entities, CAST(sum(r) FILTER (WHERE status = 'success') AS BIGINT) AS total_relations FROM s""")
def extraction_stats(spark, sf_dir):
    status = F.get(F.array(F.lit("success"), F.lit("error"), F.lit("empty")), (F.col("l_orderkey") % 3).cast("int"))
    cache = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("entities"), F.collect_set("l_suppkey").alias("relations"))
    return E.extraction_stats(cache.withColumn("status", status))


@query("entity_types", "SELECT p_partkey, CASE WHEN lower(p_type) IN ('gene', 'protein', 'drug') THEN lower(p_type) ELSE 'other' END AS of_type, CASE p_partkey % 4 WHEN 0 THEN 'gene' WHEN 1 THEN 'organism' WHEN 2 THEN 'biological_process' ELSE 'other' END AS of_alias FROM part")
def entity_types(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in (" Genes", "SPECIES ", "processes", "tools")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", P.entity_type(F.col("p_type")).alias("of_type"), P.entity_type(raw).alias("of_alias"))


@query("path_strings", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey || ' --[' || l_returnflag || ']--> ' || l_partkey || ' --[by]--> ' || l_suppkey AS path FROM lineitem")
def path_strings(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    path = P.path_string(F.array(s("l_orderkey"), s("l_partkey"), s("l_suppkey")), F.array(F.col("l_returnflag"), F.lit("by")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", path.alias("path"))


@query("parameter_hash", """SELECT doc_id, sha256('{"k":' || n_chars || ',"lang":"' || lang || '","source":"' || source || '"}') AS hash FROM documents""")
def parameter_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.parameter_hash(source=F.col("source"), lang=F.col("lang"), k=F.col("n_chars")).alias("hash"))


@query("freshness", "SELECT o_orderkey, CASE WHEN d <= 1 THEN 'd' WHEN d <= 7 THEN 'w' WHEN d <= 31 THEN 'm' ELSE 'y' END AS bound FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) AS d FROM orders)")
def freshness(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    last = F.lit(orders.agg(F.max("day")).first()[0])
    return orders.select("o_orderkey", P.freshness(F.date_diff(last, "day")).alias("bound"))


@query("expression_genes", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') END AS gene FROM part")
def expression_genes(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    question = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("What is the Expression pattern of "), name, F.lit(" gene in tissues?"))).otherwise(F.concat(F.lit("What is "), name))
    return table(spark, sf_dir, "part").select("p_partkey", P.expression_gene(question).alias("gene"))


@query("vector_queries", """
WITH t AS (SELECT item_id, text, list_distinct(regexp_extract_all(coalesce(text, ''), '\\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\\b', 1)) AS e, string_split(text, ' ') AS w FROM benchmark)
SELECT item_id, array_to_string(w[1:3], ' ') AS keyword_fallback, array_to_string(w[1:5], ' ') AS keyword, text AS full_text FROM t""")
def vector_queries(spark, sf_dir):
    none, words, text = F.array().cast("array<string>"), F.split("text", " "), F.col("text")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", P.vector_query(text, none, words).alias("keyword_fallback"), P.vector_query(text, none, words, "keyword").alias("keyword"), P.vector_query(text, none, words, "full").alias("full_text"))


@query("missing_text", "SELECT doc_id, length(coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, '') || ' ' || coalesce(text, '')) AS n FROM documents")
def missing_text(spark, sf_dir):
    both = F.concat(F.coalesce(F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(both).cast("long").alias("n"))


@query("forbidden_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents)
SELECT doc_id, place, line FROM l WHERE regexp_matches(lower(line), 'all rights reserved|api_?key') AND NOT contains(line, 'noqa')""")
def forbidden_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    found = lines.where(F.lower("line").rlike("all rights reserved|api_?key") & ~F.contains("line", F.lit("noqa")))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("place"), "line")


@query("relations_by_weight", """
WITH e AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)
SELECT l_suppkey, l_partkey, weight, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS place FROM e QUALIFY place <= 10""")
def relations_by_weight(spark, sf_dir):
    weighted = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    from quillon.operators import retrieval as R

    top = R.ranked(weighted.select("l_suppkey", F.col("l_partkey").alias("id"), F.col("weight").alias("score")), 10, by="l_suppkey")
    return top.select("l_suppkey", F.col("id").alias("l_partkey"), F.col("score").alias("weight"), F.col("rank").cast("long").alias("place"))


@query("ordered_distinct", "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: NOT list_contains(w[1 : i - 1], x)), ' ') AS words FROM (SELECT item_id AS doc_id, string_split(text, ' ') AS w FROM benchmark)")
def ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("iterative_search")
def iterative_search(spark, sf_dir):
    """The stand-in search takes every third document of the question's source, beginning by the question's length; the first round knows the question alone."""
    docs = ranked_docs(spark, sf_dir, 20)

    def search(asked):
        hits = docs.join(asked, "query_id").where(F.col("rank") % 3 == F.length("question") % 3)
        return hits.select("query_id", F.col("doc_id").alias("id"), "rank", F.coalesce("text", F.lit("")).alias("text"))

    questions = docs.select("query_id").distinct().withColumn("question", F.col("query_id"))
    return E.searched_again(search, questions)
