"""Retrieval queries: embeddings are the collection, line items the headings (order = paper, part = term), documents the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.functions import vectors as V
from quillon.operators import packing as K
from quillon.operators import retrieval as R

from .registry import query, table

#: The queries that these examples ask: the vectors whose id this divides.
ASKED = 50

SCORED = """
  SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"""
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def top(spark: SparkSession, sf_dir: str, k: int, where: str = "true") -> DataFrame:
    return R.dense_topk(collection(spark, sf_dir).where(where), asked(spark, sf_dir), k)


@query("dense_topk", f"SELECT query_id, id, {RANKED} AS rank, score FROM ({SCORED}) QUALIFY {RANKED} <= 20")
def dense_topk(spark, sf_dir):
    return top(spark, sf_dir, 20)


@query("dense_topk_filtered", f"SELECT query_id, id, {RANKED} AS rank, score FROM ({SCORED}) WHERE label = 1 QUALIFY {RANKED} <= 20")
def dense_topk_filtered(spark, sf_dir):
    return top(spark, sf_dir, 20, "label = 1")


@query("dense_topk_by_ids", f"SELECT query_id, id, {RANKED} AS rank, score FROM ({SCORED}) WHERE id BETWEEN 10 AND 60 QUALIFY {RANKED} <= 20")
def dense_topk_by_ids(spark, sf_dir):
    ids = spark.range(10, 61)
    return R.dense_topk(collection(spark, sf_dir).join(F.broadcast(ids), "id", "left_semi"), asked(spark, sf_dir), 20)  # a stated list of ids


@query("cosine_pairs", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("mean_vector_norm", """
SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: ((x[1] + x[2]) / 2) ** 2))), 6) AS norm
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mean_vector_norm(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    m = V.mean(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").withColumn("m", m).select("vec_id", F.round(F.sqrt(V.dot(F.col("m"), F.col("m"))), 6).alias("norm"))


PATHS = f"""
  SELECT query_id, 'dense' AS path, id, {RANKED} AS rank, score FROM ({SCORED}) QUALIFY {RANKED} <= 50
  UNION ALL SELECT query_id, 'typed', id, {RANKED}, score FROM ({SCORED}) WHERE label = 1 QUALIFY {RANKED} <= 50"""
FUSED = f"SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({PATHS}) GROUP BY query_id, id"


def two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda df, path: df.select("query_id", F.lit(path).alias("path"), "id", "rank", "score")
    return name(top(spark, sf_dir, 50), "dense").unionByName(name(top(spark, sf_dir, 50, "label = 1"), "typed"))


@query("rrf_fusion", f"SELECT query_id, id, {RANKED} AS rank, score FROM ({FUSED}) QUALIFY {RANKED} <= 20")
def rrf_fusion(spark, sf_dir):
    return R.fuse(two_paths(spark, sf_dir), limit=20)


@query("rrf_single_path", f"SELECT query_id, id, {RANKED} AS rank, round(score, 9) AS score FROM ({SCORED}) QUALIFY {RANKED} <= 20")
def rrf_single_path(spark, sf_dir):
    return R.fuse(two_paths(spark, sf_dir).where("path = 'dense'"), limit=20)


PARTS = {
    "vector": {name: f"SELECT query_id, '{name}' AS path, id, {RANKED} AS rank, score FROM ({SCORED}) WHERE {where} QUALIFY {RANKED} <= 100" for name, where in (("mesh", "label = 1"), ("keyword", "id % 3 = 0"))},
    "filter": {
        name: f"SELECT vec_id AS query_id, '{name}' AS path, id, place AS rank, round(1 - (place - 1) / CAST(n AS DOUBLE), 9) AS score FROM embeddings, (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () AS n FROM (SELECT vec_id AS id FROM embeddings WHERE {where} ORDER BY id LIMIT 100)) WHERE vec_id % 50 = 0"
        for name, where in (("mesh", "label = 1"), ("keyword", "vec_id % 3 = 0"))
    },
}
DENSE = f"SELECT query_id, 'dense' AS path, id, {RANKED} AS rank, score FROM ({SCORED}) QUALIFY {RANKED} <= 100"


def preset_sql(s: R.Strategy) -> str:
    of = PARTS["vector" if s.vector_within else "filter"]
    paths = " UNION ALL ".join([*([of["mesh"]] if s.mesh else []), *([of["keyword"]] if s.keyword else []), *([DENSE] if s.dense else [])])
    fused = "SELECT query_id, id, round(CASE WHEN max(n) = 1 THEN max(score) ELSE sum(1.0 / (60 + rank)) END, 9) AS score FROM (SELECT p.*, n FROM paths p JOIN (SELECT query_id, count(DISTINCT path) AS n FROM paths GROUP BY query_id) USING (query_id)) GROUP BY query_id, id"
    again = f"SELECT c.query_id, c.id, s.score FROM cut c JOIN ({SCORED}) s USING (query_id, id)" if s.rerank else "SELECT query_id, id, score FROM cut"
    return f"WITH paths AS ({paths}), fused AS ({fused}), cut AS (SELECT query_id, id, score FROM fused QUALIFY {RANKED} <= 200), again AS ({again}) SELECT query_id, id, {RANKED} AS rank, score FROM again QUALIFY {RANKED} <= 50"


def _preset(name: str) -> None:
    @query(f"hybrid_preset_{name.lower()}", preset_sql(R.STRATEGIES[name]))
    def run(spark, sf_dir):
        c = collection(spark, sf_dir)
        return R.hybrid(R.STRATEGIES[name], c, asked(spark, sf_dir), c.where("label = 1"), c.where("id % 3 = 0"))


for _name in R.STRATEGIES:
    _preset(_name)


@query("term_threshold_dedup", f"""
WITH hits AS (SELECT query_id AS term, label AS id, score FROM ({SCORED}) WHERE score >= 0.2),
best AS (SELECT 0 AS query_id, id, score FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY term, score DESC) = 1)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, {RANKED} AS rank, score FROM best""")
def term_threshold_dedup(spark, sf_dir):
    c = collection(spark, sf_dir)
    hits = R.dense_above(c, asked(spark, sf_dir), 0.2).join(c.select("id", "label"), "id")
    hits = hits.select(F.lit(0).cast("long").alias("query_id"), F.col("query_id").alias("term"), F.col("label").cast("long").alias("id"), "score")
    return R.vocabulary_matches(hits, 0.2)


HEADINGS = "SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("term"))


@query("mesh_match_rank", f"""
WITH h AS ({HEADINGS}), use AS (SELECT * FROM h WHERE term < 40 AND term NOT IN (SELECT term FROM h WHERE term < 40 GROUP BY term HAVING count(*) > 34)),
c AS (SELECT id, count(DISTINCT term) AS matches FROM use GROUP BY id)
SELECT id, matches, row_number() OVER (ORDER BY matches DESC, CAST(id AS VARCHAR) DESC) AS rank FROM c ORDER BY rank LIMIT 100""")
def mesh_match_rank(spark, sf_dir):
    return R.heading_rank(headings(spark, sf_dir), spark.range(40).toDF("term"), 100, broad_above=34)


@query("broad_terms", "SELECT l_partkey AS term FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 34")
def broad_terms(spark, sf_dir):
    return R.broad_terms(headings(spark, sf_dir), 34)


@query("mesh_weighted_hops", """
WITH t AS (SELECT p_partkey AS term, min(CASE WHEN p_partkey < 10 THEN 0 ELSE 1 END) AS hop FROM part
           WHERE p_partkey < 10 OR p_brand IN (SELECT p_brand FROM part WHERE p_partkey < 10) GROUP BY 1),
h AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem)
SELECT id, round(sum(1.0 / (1 + hop)), 6) AS score, count(*) AS matches FROM h JOIN t USING (term) GROUP BY id ORDER BY score DESC, matches DESC, CAST(id AS VARCHAR) DESC LIMIT 100""")
def mesh_weighted_hops(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    seeds = part.where("p_partkey < 10")
    near = part.join(F.broadcast(seeds.select("p_brand").distinct()), "p_brand")  # the brands of ten terms
    weighted = seeds.select(F.col("p_partkey").alias("term"), F.lit(0).alias("hop")).union(near.select("p_partkey", F.lit(1)))
    return R.heading_weights(headings(spark, sf_dir), weighted, 100)


NORMAL = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("keyword_any", f"SELECT doc_id FROM documents WHERE contains({NORMAL}, ' license ') OR contains({NORMAL}, ' stupid ')")
def keyword_any(spark, sf_dir):
    return R.keyword_filter(table(spark, sf_dir, "documents"), ["license", "stupid"]).select("doc_id")


@query("keyword_all", f"SELECT doc_id FROM documents WHERE contains({NORMAL}, ' the ') AND contains({NORMAL}, ' license ')")
def keyword_all(spark, sf_dir):
    return R.keyword_filter(table(spark, sf_dir, "documents"), ["the", "license"], all_of=True).select("doc_id")


@query("keyword_phrase", f"SELECT doc_id FROM documents WHERE contains({NORMAL}, ' apache license ')")
def keyword_phrase(spark, sf_dir):
    return R.keyword_filter(table(spark, sf_dir, "documents"), ["Apache-License"]).select("doc_id")


@query("ilike_fallback", "SELECT doc_id FROM documents WHERE contains(lower(text), 'licens') OR contains(lower(text), 'idiot') OR contains(lower(text), 'rights') OR contains(lower(source), 'licens') OR contains(lower(source), 'idiot') OR contains(lower(source), 'rights')")
def ilike_fallback(spark, sf_dir):
    return R.substring_filter(table(spark, sf_dir, "documents"), ["licens", "Idiot", "rights", "unused"], ["text", "source"]).select("doc_id")


@query("lexical_rerank", f"""
WITH s AS (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 50)
SELECT s.query_id, s.id, round(10 * (CAST(contains({NORMAL}, ' the ') AS INT) + CAST(contains({NORMAL}, ' license ') AS INT)) + s.score, 6) AS score
FROM s JOIN documents d ON d.doc_id = s.id""")
def lexical_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    hydrated = R.hydrate(top(spark, sf_dir, 50), docs, ["text"])
    return R.lexical_rerank(hydrated, ["the", "license"]).select("query_id", "id", "score")


@query("lookup_by_ids", f"SELECT s.query_id, s.id, s.rank, d.lang, d.source FROM (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 20) s JOIN documents d ON d.doc_id = s.id")
def lookup_by_ids(spark, sf_dir):
    return R.hydrate(top(spark, sf_dir, 20), table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), ["lang", "source"]).select("query_id", "id", "rank", "lang", "source")


@query("lookup_pseudo_score", "SELECT doc_id, round(1 - 0.01 * (row_number() OVER (ORDER BY doc_id) - 1), 6) AS score FROM documents WHERE text IS NOT NULL AND text <> ''")
def lookup_pseudo_score(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id"), "doc_id").select("doc_id", F.round(1 - 0.01 * F.col("place"), 6).alias("score"))


@query("tiered_hydration", f"""
WITH s AS (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 50),
t AS (SELECT s.query_id, s.id, s.score, s.rank, CASE WHEN d.n_chars > 1500 THEN 0 ELSE 1 END AS tier FROM s JOIN documents d ON d.doc_id = s.id)
SELECT query_id, id, CAST(tier AS INT) AS tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, rank) AS place FROM t QUALIFY place <= 20""")
def tiered_hydration(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 1500, F.col("text")).alias("text"), F.col("source").alias("title"))
    return R.tiered(R.hydrate(top(spark, sf_dir, 50), docs, ["text", "title"]), 20).select("query_id", "id", "tier", "place")


@query("filter_only_scores", f"""
WITH h AS (SELECT DISTINCT l_partkey AS query_id, l_orderkey AS id FROM lineitem WHERE l_partkey < 20)
SELECT query_id, id, round(1 - (row_number() OVER (PARTITION BY query_id ORDER BY id) - 1) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE), 9) AS score FROM h""")
def filter_only_scores(spark, sf_dir):
    found = headings(spark, sf_dir).where("term < 20").select(F.col("term").alias("query_id"), "id").distinct()
    return R.rank_score(found, order="id")


@query("filter_modes", """
WITH v AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey < 20), k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey < 3)
SELECT 'MESH' AS mode, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v UNION ALL SELECT 'KEYWORD', count(*), CAST(sum(id) AS BIGINT) FROM k
UNION ALL SELECT 'OR', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM v UNION SELECT id FROM k)
UNION ALL SELECT 'AND', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM v INTERSECT SELECT id FROM k)""")
def filter_modes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey")
    v, k = lines.where("l_partkey < 20"), lines.where("l_suppkey < 3")
    out = None
    for mode in ("MESH", "KEYWORD", "OR", "AND"):
        part = R.filter_ids(mode, v, k).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit(mode).alias("mode"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


POOLS = f"""
  SELECT query_id, 0 AS pool, id, score, {RANKED} AS rank FROM ({SCORED}) WHERE id % 2 = 0 QUALIFY {RANKED} <= 30
  UNION ALL SELECT query_id, 1, id, round(score * 0.9, 6), {RANKED} FROM ({SCORED}) WHERE id % 3 = 0 QUALIFY {RANKED} <= 30"""


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = top(spark, sf_dir, 30, "id % 2 = 0"), top(spark, sf_dir, 30, "id % 3 = 0")
    return a.select("query_id", F.lit(0).alias("pool"), "id", "score", "rank").unionByName(b.select("query_id", F.lit(1).alias("pool"), "id", S.rounded(F.col("score") * 0.9, 6).alias("score"), "rank"))


@query("pool_merge_max", f"WITH p AS ({POOLS}), b AS (SELECT query_id, id, max(score) AS score FROM p GROUP BY query_id, id) SELECT query_id, id, {RANKED} AS rank, score FROM b QUALIFY {RANKED} <= 20")
def pool_merge_max(spark, sf_dir):
    return R.merge_best(pools(spark, sf_dir), 20)


@query("pool_merge_first", f"""
WITH p AS ({POOLS}), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY pool, rank) = 1)
SELECT query_id, id, score, pool, row_number() OVER (PARTITION BY query_id ORDER BY pool, rank, id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pool, rank, id) <= 40""")
def pool_merge_first(spark, sf_dir):
    return R.merge_first(pools(spark, sf_dir), 40)


@query("round_robin_merge", f"""
WITH p AS ({POOLS}), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank, pool) = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pool) AS place, pool FROM f QUALIFY place <= 20""")
def round_robin_merge(spark, sf_dir):
    return R.round_robin(pools(spark, sf_dir), 20)


GOLD = "SELECT vec_id AS query_id, v AS id FROM embeddings, (SELECT unnest([3, 77, 140]) AS v) WHERE vec_id % 50 = 0"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 77, 140)])).alias("id"))


@query("oracle_inject", f"""
WITH g AS ({GOLD}), r AS (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 20),
b AS (SELECT query_id, id, 0 AS kind, 0 AS rank FROM g UNION ALL SELECT query_id, id, 1, rank FROM r WHERE (query_id, id) NOT IN (SELECT query_id, id FROM g))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank, id) AS place, kind = 0 AS gold FROM b QUALIFY place <= 20""")
def oracle_inject(spark, sf_dir):
    return R.inject_gold(top(spark, sf_dir, 20), gold(spark, sf_dir), 20)


GOLD_RANKS = f"""
  SELECT g.query_id, coalesce(min(r.rank), -1) AS gold_rank FROM (SELECT DISTINCT query_id, id FROM ({GOLD})) g
  LEFT JOIN (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 50) r USING (query_id, id) GROUP BY g.query_id"""


@query("gold_ranks", GOLD_RANKS)
def gold_ranks(spark, sf_dir):
    return R.gold_ranks(top(spark, sf_dir, 50), gold(spark, sf_dir))


@query("retrieval_metrics", f"""
SELECT count(*) AS n_queries, round(avg(CAST(gold_rank BETWEEN 1 AND 1 AS DOUBLE)), 6) AS recall_1, round(avg(CAST(gold_rank BETWEEN 1 AND 10 AS DOUBLE)), 6) AS recall_10,
round(avg(CAST(gold_rank >= 1 AS DOUBLE)), 6) AS ceiling FROM ({GOLD_RANKS})""")
def retrieval_metrics(spark, sf_dir):
    return R.recall_at(R.gold_ranks(top(spark, sf_dir, 50), gold(spark, sf_dir)), (1, 10))


@query("widening_limits", f"""
WITH r AS (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 200),
n AS (SELECT query_id, count(*) FILTER (WHERE label = 1 AND rank <= 20) AS a, count(*) FILTER (WHERE label = 1 AND rank <= 100) AS b FROM r GROUP BY query_id),
u AS (SELECT r.*, CASE WHEN a >= 10 THEN 20 WHEN b >= 10 THEN 100 ELSE 200 END AS bound FROM r JOIN n USING (query_id))
SELECT query_id, id, CAST(bound AS INT) AS bound, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM u WHERE label = 1 AND rank <= bound QUALIFY place <= 10""")
def widening_limits(spark, sf_dir):
    run = top(spark, sf_dir, 200).join(collection(spark, sf_dir).select("id", "label"), "id")
    return R.widen(run, F.col("label") == 1, 10, (20, 100, 200)).select("query_id", "id", "bound", "place")


@query("fallback_scores", f"SELECT query_id, id, round(1 - (rank - 1) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE), 9) AS score FROM (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 20)")
def fallback_scores(spark, sf_dir):
    return R.rank_score(top(spark, sf_dir, 20)).select("query_id", "id", "score")


UNITS = f"SELECT s.query_id, s.id, s.rank, CAST(greatest(1, ceil(d.n_chars / 4.0)) AS BIGINT) AS cost FROM (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 30) s JOIN documents d ON d.doc_id = s.id"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4)).cast("long").alias("cost"))
    return R.hydrate(top(spark, sf_dir, 30), docs, ["cost"])


TOTAL = "CAST(sum(cost) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT)"


@query("evidence_prefix_budget", f"SELECT query_id, id, rank, {TOTAL} AS total FROM ({UNITS}) QUALIFY {TOTAL} <= 3000")
def evidence_prefix_budget(spark, sf_dir):
    return K.prefix_budget(units(spark, sf_dir), 3000).select("query_id", "id", "rank", "total")


@query("largest_prefix", f"SELECT query_id, id, rank, least(cost, 800) AS cost FROM ({UNITS}) QUALIFY {TOTAL} <= 800 OR row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1")
def largest_prefix(spark, sf_dir):
    return K.largest_prefix(units(spark, sf_dir), 800).select("query_id", "id", "rank", "cost")


@query("per_paper_cap", f"SELECT query_id, id, rank FROM ({UNITS}) QUALIFY row_number() OVER (PARTITION BY query_id, id % 7 ORDER BY rank) <= 2")
def per_paper_cap(spark, sf_dir):
    return K.per_key_cap(units(spark, sf_dir).withColumn("paper_id", F.col("id") % 7), "paper_id", 2).select("query_id", "id", "rank")


@query("greedy_budget_pack", f"""
WITH RECURSIVE u AS (SELECT *, id % 7 AS paper, cost + 18 AS c, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM ({UNITS})),
f AS (
  SELECT query_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS taken, CAST([] AS BIGINT[]) AS papers, false AS over FROM (SELECT DISTINCT query_id FROM u)
  UNION ALL
  SELECT query_id, n, CASE WHEN take THEN used + c ELSE used END, CASE WHEN take THEN list_append(taken, id) ELSE taken END, CASE WHEN take THEN list_append(papers, paper) ELSE papers END, over OR big
  FROM (SELECT u.*, f.used, f.taken, f.papers, f.over, len(f.taken) = 0 AND u.c > 2500 AS big,
        NOT f.over AND ((len(f.taken) = 0 AND u.c > 2500) OR (f.used + u.c <= 2500 AND len(list_filter(f.papers, lambda x: x = u.paper)) < 2)) AS take
        FROM f JOIN u ON u.query_id = f.query_id AND u.n = f.n + 1)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)
SELECT query_id, unnest(taken) AS unit_id, CAST(generate_subscripts(taken, 1) AS INT) AS place, used FROM l""")
def greedy_budget_pack(spark, sf_dir):
    return K.greedy_pack(units(spark, sf_dir).withColumn("paper_id", F.col("id") % 7).withColumnRenamed("id", "unit_id"), 2500)


@query("chunk_section_paper", """
SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, c.c_mktsegment FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey """)
def chunk_section_paper(spark, sf_dir):
    """Chunk, section and paper as a three-way join: line item, order, customer."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return lines.join(orders, "l_orderkey").join(customers, "o_custkey").select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment")


@query("candidate_coverage", f"""
WITH r AS (SELECT *, {RANKED} AS rank FROM ({SCORED}) QUALIFY {RANKED} <= 30)
SELECT query_id, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT doc_id FROM documents WHERE n_chars > 1500)) AS n_full, count(*) FILTER (WHERE id IN (SELECT doc_id FROM labels)) AS n_labelled FROM r GROUP BY query_id""")
def candidate_coverage(spark, sf_dir):
    run = top(spark, sf_dir, 30).select("query_id", "id")
    full = table(spark, sf_dir, "documents").where("n_chars > 1500").select(F.col("doc_id").alias("id"), F.lit(1).alias("full")).distinct()
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("labelled")).distinct()
    return run.join(full, "id", "left").join(labelled, "id", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("full").alias("n_full"), F.count("labelled").alias("n_labelled"))


@query("negative_pool_union", f"""
WITH p AS ({POOLS}), f AS (SELECT query_id, id, arg_min(score, pool) AS score FROM p GROUP BY query_id, id)
SELECT query_id, id, {RANKED} AS rank, score FROM f QUALIFY {RANKED} <= 25""")
def negative_pool_union(spark, sf_dir):
    """Positive and negative pools: what the first has not is appended, then all is ranked by score."""
    kept = R.first_by(pools(spark, sf_dir), ["query_id", "id"], F.col("pool"))
    return R.ranked(kept, 25)


@query("cached_split", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey < 200) AS cached FROM orders")
def cached_split(spark, sf_dir):
    from quillon.sources.files import split_cached

    asked = table(spark, sf_dir, "orders").select("o_orderkey")
    cached = table(spark, sf_dir, "lineitem").where("l_partkey < 200").select(F.col("l_orderkey").alias("o_orderkey"))
    hit, miss = split_cached(asked, cached, ["o_orderkey"])
    return hit.withColumn("cached", F.lit(True)).unionByName(miss.withColumn("cached", F.lit(False)))


@query("evidence_polarity", r"""
WITH t AS (SELECT doc_id, (['There was no significant difference.', 'It significantly improved survival.', 'Nothing is said.', 'The drug is not effective.'])[1 + doc_id % 4] AS t FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' ELSE 'negative' END AS polarity FROM t""")
def evidence_polarity(spark, sf_dir):
    from quillon.operators import sections as X

    texts = F.array(*[F.lit(x) for x in ("There was no significant difference.", "It significantly improved survival.", "Nothing is said.", "The drug is not effective.")])
    return table(spark, sf_dir, "documents").select("doc_id", X.polarity(F.element_at(texts, (F.col("doc_id") % 4 + 1).cast("int"))).alias("polarity"))
