"""Entity graphs as tables: merges, neighbourhoods, paths, components, closures, communities.

Edges are rows (source, target, ...). Iterations are joins; each round is written to the shared folder by the caller's `keep`,
so that no plan grows with the number of rounds and lost executors cost one round at most.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sizes import sent

_own: list[str] = []

#: Paths that a task of flow_paths lists, about.
PATHS = 500_000


def keep(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir (a folder of this machine where it is unset, as in tests on a local master) and read back."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='quillon-graph-')}")
        folder = _own[0]
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes a kept table that nothing reads any more, and lets Spark delete the shuffle files of plans that are done."""
    context = kept.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    release(kept.sparkSession)


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def merge_entities(mentions: DataFrame) -> DataFrame:
    """One row an entity_id of (entity_id, name, kind, description, mentions, chunk, seq): mentions summed, chunks united, the longest description (the first of
    equals), name and kind of the first."""
    return mentions.groupBy("entity_id").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("kind", "seq").alias("kind"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
        F.sum("mentions").alias("mentions"), F.array_sort(F.collect_set("chunk")).alias("chunks"),
    )


def merge_relations(mentions: DataFrame, most_keywords: int = 10) -> DataFrame:
    """One row a (source, target, kind): weights summed, chunks united, distinct keywords (the first by name), the longest description."""
    return mentions.groupBy("source", "target", "kind").agg(
        F.round(F.sum("weight"), 6).alias("weight"), F.array_sort(F.collect_set("chunk")).alias("chunks"),
        F.slice(F.array_sort(F.collect_set("keyword")), 1, most_keywords).alias("keywords"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
    )


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: entities, relations, their kinds, and relations an entity."""
    e = entities.agg(F.count(F.lit(1)).alias("n_entities"), F.count_distinct("kind").alias("n_entity_kinds"))
    r = relations.agg(F.count(F.lit(1)).alias("n_relations"), F.count_distinct("kind").alias("n_relation_kinds"))
    return e.crossJoin(r).withColumn("avg_degree", F.when(F.col("n_entities") > 0, F.round(F.col("n_relations") / F.col("n_entities"), 6)).otherwise(F.lit(0.0)))  # one row each


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among nodes (node)."""
    wanted = nodes.select("node").distinct()
    a = edges.join(wanted.withColumnRenamed("node", "source"), "source", "left_semi").select(*edges.columns)
    b = edges.join(wanted.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)
    return a.union(b).distinct()


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    wanted = nodes.select("node").distinct()
    return edges.join(wanted.withColumnRenamed("node", "source"), "source", "left_semi").join(wanted.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """node, near: along edges (out), against them (in), or both ways."""
    out, in_ = edges.select(F.col("source").alias("node"), F.col("target").alias("near")), edges.select(F.col("target").alias("node"), F.col("source").alias("near"))
    return {"out": out, "in": in_, "both": out.union(in_)}[direction].distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """node, hop: what is reached from seeds (node) in up to `hops` steps, with the least number; seeds have 0."""
    steps = directed(edges, direction)
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        new = front.join(steps, "node").select(F.col("near").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        front = keep(new)
        seen = seen.union(front)
    return seen


def closure(edges: DataFrame, most: int = 100) -> DataFrame:
    """node, reached, distance of all pairs that directed, acyclic edges (child -> parent as source -> target) connect, themselves excluded.

    Each round doubles the length that is covered, so that the rounds are the logarithm of the depth."""
    known = keep(edges.select(F.col("source").alias("node"), F.col("target").alias("reached"), F.lit(1).alias("distance")).where("node <> reached").distinct())
    while most > 0:
        most -= 1
        longer = known.alias("x").join(known.alias("y"), F.col("x.reached") == F.col("y.node")).select("x.node", "y.reached", (F.col("x.distance") + F.col("y.distance")).alias("distance"))
        grown = keep(known.union(longer).where("node <> reached").groupBy("node", "reached").agg(F.min("distance").alias("distance")))
        if grown.count() == known.count():
            return grown
        known = grown
    return known


def siblings(edges: DataFrame) -> DataFrame:
    """node, sibling: distinct pairs that share a parent, of (source child, target parent)."""
    a, b = edges.select(F.col("source").alias("node"), "target"), edges.select(F.col("source").alias("sibling"), "target")
    return a.join(b, "target").where("node <> sibling").select("node", "sibling").distinct()


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """start, end, nodes, length: all simple paths from starts to ends (node) of up to `hops` edges. They go no further than the end."""
    steps = directed(edges, direction)
    goal = ends.select(F.col("node").alias("end")).distinct()
    front = starts.select(F.col("node").alias("start"), F.array("node").alias("nodes"), F.col("node").alias("at")).distinct()
    found = None
    for length in range(1, hops + 1):
        front = keep(front.join(steps, F.col("at") == F.col("node")).where(~F.array_contains("nodes", F.col("near"))).select("start", F.concat("nodes", F.array("near")).alias("nodes"), F.col("near").alias("at")))
        done = front.join(sent(goal), F.col("at") == F.col("end")).select("start", "end", "nodes", F.lit(length).alias("length"))  # a stated set of ends
        found = done if found is None else found.union(done)
        front = front.join(sent(goal), F.col("at") == F.col("end"), "left_anti")
    return found


def flow_paths(edges: DataFrame, starts: DataFrame, hops: int, alpha: float = 0.8, least: float = 0.3) -> DataFrame:
    """start, end, nodes, length, score: all simple paths from starts (node) to any node, of up to `hops` edges, that path_weights leaves for their flow, with its score.
    edges may be repeated.

    Flow and score are carried along. The last step of paths that differ in nothing else is held as one list of ends, which is what is kept and shuffled, by start;
    so the grouping of best_paths needs no further shuffle. A node's neighbours are one list."""
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("near")).union(edges.select("target", "source")).where("node is not null")
    near = ways.groupBy("node").agg(F.array_sort(F.collect_set("near")).alias("nears"), F.max(F.col("near").isNull().cast("int")).alias("unknown"))
    steps = keep(near.select("node", "nears", (F.size("nears") + F.col("unknown")).alias("degree")))
    front = starts.select("node").distinct().select(F.array("node").alias("nodes"), F.col("node").alias("at"), F.lit(1.0).alias("flow"), F.lit(0.0).alias("total"))
    found = None
    for length in range(1, hops + 1):
        flow = F.col("flow") * (F.lit(alpha) / F.col("degree"))
        ends = F.filter("nears", lambda x: ~F.array_contains("nodes", x))
        fans = keep(front.join(steps, F.col("at") == F.col("node")).select("nodes", ends.alias("ends"), flow.alias("flow"), (F.col("total") + flow).alias("total")))
        release(fans.sparkSession)
        done = fans.select(F.col("nodes")[0].alias("start"), "nodes", "ends", F.lit(length).alias("length"), F.round(F.col("total") / length, 6).alias("score"))
        found = done if found is None else found.union(done)
        front = fans.where(F.col("flow") > least).select("nodes", F.explode("ends").alias("at"), "flow", "total").withColumn("nodes", F.concat("nodes", F.array("at")))
        if front.isEmpty():
            break
    discard(steps)
    count = found.agg(F.sum(F.size("ends"))).first()[0] or 0
    each = found.repartition(1 + count // PATHS, "start").withColumn("end", F.explode("ends"))
    return each.select("start", "end", F.concat("nodes", F.array("end")).alias("nodes"), "length", "score")


def path_weights(found: DataFrame, edges: DataFrame, alpha: float = 0.8, least: float = 0.3) -> DataFrame:
    """Paths with a score: each step shares what flows into its node evenly among the node's successors, times alpha; the mean over the steps. A path whose flow
    falls to `least` or below before its last step is gone."""
    degree = directed(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    steps = found.withColumn("path", F.monotonically_increasing_id())
    steps = keep(steps)
    each = steps.select("path", F.posexplode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("step", "node")).join(degree, "node")
    per = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    flow = each.withColumn("flow", F.exp(F.sum(F.log(F.lit(alpha) / F.col("degree"))).over(per)))
    last = F.max("step").over(Window.partitionBy("path"))
    kept = flow.withColumn("fails", (F.col("flow") <= least) & (F.col("step") < last)).groupBy("path").agg(F.round(F.avg("flow"), 6).alias("score"), F.max("fails").alias("fails")).where(~F.col("fails"))
    return steps.join(kept.select("path", "score"), "path").drop("path")


def best_paths(scored: DataFrame, quota: int = 15) -> DataFrame:
    """Of paths with the same nodes the best, by score; no more than the quota for each pair of ends."""
    unique = scored.withColumn("set", F.array_sort("nodes")).groupBy("start", "end", "set").agg(F.max_by(F.struct("nodes", "length", "score"), F.struct("score", "nodes")).alias("p")).select("start", "end", "p.*")
    place = F.row_number().over(Window.partitionBy("start", "end").orderBy(F.col("score").desc(), "nodes"))
    return unique.withColumn("place", place).where(F.col("place") <= quota)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node): least labels spread along edges, then each node takes its label's label."""
    both = keep(directed(edges))
    labels = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component"))
    labels = keep(labels)
    while True:
        heard = both.join(labels.toDF("near", "other"), "near").groupBy("node").agg(F.min("other").alias("other"))
        stepped = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "other").alias("to"))
        new = keep(stepped.join(labels.toDF("to", "further"), "to").select("node", "was", F.least("to", "further").alias("component")))
        labels = new.select("node", "component")
        if not new.where("was <> component").limit(1).count():
            break
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Its nodes: by size, then the least node."""
    labels = keep(components(edges))
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), "component").limit(1)
    return labels.join(sent(best), "component").select("node", "component", "size")


def rank_communities(members: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """community, overlap, size: by shared entities (entity), then size, then id."""
    hit = members.join(entities.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left")
    out = hit.groupBy("community").agg(F.count("hit").alias("overlap"), F.count_distinct("entity").alias("size"))
    return out.where("overlap > 0").orderBy(F.col("overlap").desc(), F.col("size").desc(), "community").limit(limit)


def parent_communities(children: DataFrame, parents: DataFrame) -> DataFrame:
    """community, parent: the parent (community, entity) that shares most entities; ties by id."""
    shared = children.alias("c").join(parents.alias("p"), "entity").groupBy(F.col("c.community").alias("community"), F.col("p.community").alias("parent")).agg(F.count(F.lit(1)).alias("overlap"))
    return shared.groupBy("community").agg(F.min_by(F.struct("parent", "overlap"), F.struct(-F.col("overlap"), F.col("parent"))).alias("best")).select("community", "best.parent", "best.overlap")


def label_communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community: each node takes the label that weighs most among its neighbours (source, target, weight), ties to the least label, in synchronous rounds. A node's own label weighs as much as its heaviest edge, so that two nodes don't swap labels forever."""
    both = keep(edges.select(F.col("source").alias("node"), F.col("target").alias("near"), "weight").union(edges.select("target", "source", "weight")).where("node <> near"))
    self_ = keep(both.groupBy("node").agg(F.max("weight").alias("weight")))
    labels = self_.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = both.join(labels.toDF("near", "label"), "near").groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        own = labels.join(self_, "node").select("node", F.col("community").alias("label"), "weight")
        votes = votes.union(own).groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        labels = keep(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.round("weight", 9), F.col("label"))).alias("community")))
    return labels


def assemble_communities(labels: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """community, members, n_relations of communities of `least` nodes and more."""
    inner = edges.join(labels.toDF("source", "a"), "source").join(labels.toDF("target", "b"), "target").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count(F.lit(1)).alias("n_relations"))
    out = labels.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("members")).where(F.size("members") >= least)
    return out.join(inner, "community", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))
