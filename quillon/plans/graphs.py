"""Graph queries: suppliers and parts are a bipartite graph, customers below nations below regions a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import hashing as H
from quillon.functions import text as T
from quillon.operators import graph as G
from quillon.operators import sections as X

from .registry import query, table

EDGES = "SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS source, 'p' || CAST(l_partkey AS VARCHAR) AS target FROM lineitem"


def edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()


@query("entity_merge", """
WITH m AS (SELECT substr(sha256(lower(trim(p_name)) || ':' || lower(p_type)), 1, 16) AS entity_id, p_name AS name, p_type AS kind, p_brand AS description, p_size AS mentions, 'c' || CAST(p_partkey % 5 AS VARCHAR) AS chunk, p_partkey AS seq FROM part)
SELECT entity_id, arg_min(name, seq) AS name, CAST(sum(mentions) AS BIGINT) AS mentions, array_to_string(list_sort(list_distinct(list(chunk))), ',') AS chunks,
(list(description ORDER BY length(description) DESC, seq))[1] AS description FROM m GROUP BY entity_id""")
def entity_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mentions = p.select(
        H.entity_id(F.col("p_name"), F.col("p_type")).alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("description"),
        F.col("p_size").alias("mentions"), F.concat(F.lit("c"), (F.col("p_partkey") % 5).cast("string")).alias("chunk"), F.col("p_partkey").alias("seq"),
    )
    return G.merge_entities(mentions).select("entity_id", "name", "mentions", F.array_join("chunks", ",").alias("chunks"), "description")


@query("relation_merge", """
SELECT l_suppkey AS source, l_partkey AS target, round(sum(l_quantity), 6) AS weight, array_to_string(list_sort(list_distinct(list(l_returnflag)))[1:10], ',') AS keywords, len(list_distinct(list(l_orderkey))) AS n_chunks FROM lineitem GROUP BY 1, 2""")
def relation_merge(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("supplies").alias("kind"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("chunk"),
        F.col("l_returnflag").alias("keyword"), F.col("l_linestatus").alias("description"), F.col("l_orderkey").alias("seq"),
    )
    return G.merge_relations(m).select("source", "target", "weight", F.array_join("keywords", ",").alias("keywords"), F.size("chunks").cast("long").alias("n_chunks"))


@query("graph_stats", """
WITH e AS (SELECT p_partkey AS id, p_type AS kind FROM part), r AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag AS kind FROM lineitem)
SELECT (SELECT count(*) FROM e) AS n_entities, (SELECT count(DISTINCT kind) FROM e) AS n_entity_kinds, (SELECT count(*) FROM r) AS n_relations, (SELECT count(DISTINCT kind) FROM r) AS n_relation_kinds,
round((SELECT count(*) FROM r) / CAST((SELECT count(*) FROM e) AS DOUBLE), 6) AS avg_degree""")
def graph_stats(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"))
    return G.stats(entities, table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_returnflag").alias("kind")).distinct())


@query("subgraph", f"SELECT * FROM ({EDGES}) WHERE source IN ('s1', 's2', 's3') AND CAST(substr(target, 2) AS BIGINT) % 2 = 0")
def subgraph(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("target").alias("node")).where(F.substring("node", 2, 20).cast("long") % 2 == 0).union(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "node string"))
    return G.subgraph(e, nodes)


@query("incident_relations", f"SELECT * FROM ({EDGES}) WHERE source = 's1' OR target IN ('p5', 'p7')")
def incident_relations(spark, sf_dir):
    return G.incident(edges(spark, sf_dir), spark.createDataFrame([("s1",), ("p5",), ("p7",)], "node string"))


BOTH = f"SELECT source AS node, target AS near FROM ({EDGES}) UNION SELECT target, source FROM ({EDGES})"


@query("khop_neighbors", f"""
WITH b AS ({BOTH}), h0 AS (SELECT 's1' AS node), h1 AS (SELECT DISTINCT near AS node FROM b WHERE node = 's1'),
h2 AS (SELECT DISTINCT near AS node FROM b JOIN h1 USING (node) WHERE near NOT IN (SELECT node FROM h1) AND near <> 's1')
SELECT node, CAST(0 AS INT) AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def khop_neighbors(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 2)


@query("bounded_paths", f"""
WITH b AS ({BOTH}), p1 AS (SELECT 's1' AS s, near AS a FROM b WHERE node = 's1'), p2 AS (SELECT p1.*, near AS c FROM p1 JOIN b ON node = a WHERE near <> 's1')
SELECT s AS start, c AS "end", s || '>' || a || '>' || c AS path, CAST(2 AS INT) AS length FROM p2 WHERE c IN ('s2', 's3')""")
def bounded_paths(spark, sf_dir):
    """Paths of up to two steps over all line items; of up to four there are more than line items by the power of the degree."""
    found = G.paths(edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), spark.createDataFrame([("s2",), ("s3",)], "node string"), 2)
    return found.select("start", "end", F.array_join("nodes", ">").alias("path"), "length")


TREE = "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS source, 'r' || CAST(n_regionkey AS VARCHAR) AS target FROM nation UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer"


def tree(spark, sf_dir):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))
    return nations.union(table(spark, sf_dir, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey")))


CLOSURE = f"WITH RECURSIVE t AS ({TREE}), r(node, reached, distance) AS (SELECT source, target, 1 FROM t UNION ALL SELECT r.node, t.target, r.distance + 1 FROM r JOIN t ON t.source = r.reached)"


@query("dag_ancestors", f"{CLOSURE} SELECT node, reached, CAST(distance AS INT) AS distance FROM r")
def dag_ancestors(spark, sf_dir):
    return G.closure(tree(spark, sf_dir))


@query("dag_descendants", f"{CLOSURE} SELECT reached AS node, count(*) AS n_descendants FROM r GROUP BY 1")
def dag_descendants(spark, sf_dir):
    return G.closure(tree(spark, sf_dir)).groupBy(F.col("reached").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))


@query("siblings", "SELECT 'n' || CAST(a.n_nationkey AS VARCHAR) AS node, 'n' || CAST(b.n_nationkey AS VARCHAR) AS sibling FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def siblings(spark, sf_dir):
    return G.siblings(tree(spark, sf_dir).where(F.startswith("source", F.lit("n"))))


def incidence(spark, sf_dir):
    """Orders and their parts, repeated as they are in line items."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))


def sparse(spark, sf_dir):
    return incidence(spark, sf_dir).distinct()


@query("connected_components")
def connected_components(spark, sf_dir):
    return G.components(sparse(spark, sf_dir))


@query("largest_component")
def largest_component(spark, sf_dir):
    return G.largest_component(sparse(spark, sf_dir))


@query("community_overlap_rank", "SELECT p_brand AS community, count(*) FILTER (WHERE p_partkey % 7 = 0) AS overlap, count(*) AS size FROM part GROUP BY 1 HAVING overlap > 0 ORDER BY overlap DESC, size DESC, community LIMIT 10")
def community_overlap_rank(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("entity"))
    return G.rank_communities(members, members.where("entity % 7 = 0"), 10)


@query("parent_communities", "SELECT * FROM (SELECT c.p_brand AS community, p.p_type AS parent, count(*) AS overlap FROM part c JOIN part p USING (p_partkey) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community ORDER BY overlap DESC, parent) = 1")
def parent_communities(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return G.parent_communities(part.select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("entity")), part.select(F.col("p_type").alias("community"), F.col("p_partkey").alias("entity")))


@query("label_communities")
def label_communities(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return G.assemble_communities(G.label_communities(e), e).select("community", F.size("members").alias("size"), "n_relations")


@query("weighted_paths")
def weighted_paths(spark, sf_dir):
    e = incidence(spark, sf_dir)
    found = G.flow_paths(e, e.select(F.col("source").alias("node")), 3)
    return G.best_paths(found).select("start", "end", F.array_join("nodes", ">").alias("path"), "score", "place")


@query("hierarchy_parents", r"SELECT p_partkey, regexp_replace('D' || CAST(p_partkey % 10 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) || '.7', '(^[^.]*$|\.[^.]*$)', '') AS parent FROM part")
def hierarchy_parents(spark, sf_dir):
    tree_number = F.concat(F.lit("D"), (F.col("p_partkey") % 10).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit(".7"))
    return table(spark, sf_dir, "part").select("p_partkey", T.tree_parent(tree_number).alias("parent"))


CHUNKS = """
  SELECT doc_id AS chunk_id, doc_id % 60 AS paper_id, doc_id % 200 AS section_id, doc_id // 200 AS place, (['results', 'methods', 'abstract', 'raw'])[1 + doc_id % 4] AS role, round(n_chars / 20000.0, 6) AS score, doc_id AS rank FROM documents"""


def chunks(spark, sf_dir):
    d = F.col("doc_id")
    role = F.element_at(F.array(F.lit("results"), F.lit("methods"), F.lit("abstract"), F.lit("raw")), (d % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(d.alias("chunk_id"), (d % 60).alias("paper_id"), (d % 200).alias("section_id"), F.floor(d / 200).alias("place"), role.alias("role"), F.round(F.col("n_chars") / 20000.0, 6).alias("score"), d.alias("rank"), "text")


ADJUSTED = f"SELECT *, round(score * CASE role WHEN 'results' THEN 1.15 WHEN 'methods' THEN 0.9 WHEN 'abstract' THEN 1.0 ELSE 0.8 END + CASE WHEN role = 'results' THEN 0.05 ELSE 0 END, 6) AS adjusted FROM ({CHUNKS})"


@query("section_weighted_best", f"SELECT section_id AS chunk_id, role, adjusted, rank FROM ({ADJUSTED}) QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY adjusted DESC, rank) = 1")
def section_weighted_best(spark, sf_dir):
    c = X.adjusted(chunks(spark, sf_dir), ("results",)).withColumn("chunk_id", F.col("section_id"))
    return X.best_chunks(c).select("chunk_id", "role", "adjusted", "rank")


@query("section_expansion", f"""
WITH c AS (SELECT DISTINCT paper_id, section_id, role, section_id < 40 AS seed FROM ({CHUNKS})), s AS (SELECT *, CASE WHEN role = 'results' THEN 0 WHEN role IN ('abstract', 'raw') THEN 1 WHEN seed THEN 2 END AS tier FROM c WHERE paper_id IN (SELECT paper_id FROM c WHERE seed))
SELECT paper_id, section_id, role, CAST(tier AS INT) AS tier FROM s WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY paper_id)""")
def section_expansion(spark, sf_dir):
    s = chunks(spark, sf_dir).select("paper_id", "section_id", "role").distinct()
    return X.expand(s, s.where("section_id < 40"), ("results",)).select("paper_id", "section_id", "role", "tier")


@query("section_tree", "SELECT n_regionkey AS parent_id, array_to_string(list(n_nationkey ORDER BY n_nationkey % 2, n_name, n_nationkey), ',') AS children FROM nation GROUP BY 1")
def section_tree(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 2).alias("level"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("section_id"))
    return X.tree(n).select("parent_id", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query("carried_headers", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def carried_headers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("place"), F.when(F.col("role") == "user", "title_1").otherwise("paragraph").alias("kind"), F.md5(F.col("text").cast("binary")).alias("text"))
    return X.carried_headers(c).select(F.col("paper_id").alias("conv_id"), F.col("place").alias("turn"), "header")


@query("chunk_faults", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars // 4 NOT BETWEEN 1 AND 512 THEN 'tokens' END, CASE WHEN n_chars % 3 = 0 THEN 'order' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents WHERE n_chars // 4 NOT BETWEEN 1 AND 512 OR n_chars % 3 = 0")
def chunk_faults(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("n_chars") / 4).alias("tokens"), F.lit(0).alias("begin"), F.when(F.col("n_chars") % 3 == 0, 0).otherwise(F.col("n_chars")).alias("end"))
    return X.chunk_faults(c).select("doc_id", F.array_join("faults", ",").alias("faults"))
