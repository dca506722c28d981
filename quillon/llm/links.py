"""Linking similar sets: candidates of banded keys, exact verification, distributed union-find.

Nodes are distinct sets. Within a bucket (the nodes of one band table's key) no pairs are listed: every node is held against the
bucket's hub, the node that shares most buckets, and what is similar is united. Buckets of one hub are one group from then on.

What is left apart from its hub is looked at more closely, once for each hub. A node differs from the hub by the items that
either has alone. Sets x, y are similar enough if they differ in at most (1 - t) / (1 + t) of the sum of their sizes; as they differ
where just one of them differs from the hub, a node that is apart from its hub is similar to another node of the group only if
both differ from the hub in common items, and then also in one of the rarest of these of each. In a group of at most FEW nodes
those that are apart are held against the others, where the counts leave it possible. Of a group of at most TASK nodes and TASK_ITEMS such items a task counts,
by lists of the nodes that differ in an item, how many items each that is apart shares with the others, which tells exactly what is
similar. A larger group falls apart into one for each rare item that nodes of two components, one of them apart, both differ in. Where at most FEW_RARE nodes meet, pairs are verified that
can have enough in common behind that item; larger groups get a hub of their own, the next in one order of all nodes, and are treated
alike. No pair that meets in a bucket is lost, and a group of n near copies, or of n sets that share one large part and nothing
else, costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, release

#: Rows of two or three numbers up to which a side of a join is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Nodes of a hub's group up to which those that are apart are held against the others; nodes, and items in which they differ from the hub, up to which one task counts what they
#: share; nodes of a group by a rare item up to which pairs are verified. The latter are few: places tell most that can't be similar.
FEW, TASK, TASK_ITEMS, FEW_RARE = 32, 8192, 2_000_000, 512


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, which has that many rows, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    kept = keep(df, name)
    return kept, kept.count()


@dataclass(frozen=True)
class Form:
    """How the sets of a table node, items are held: what two of them share, as a struct both, n_left, n_right of longs, and the items that one of two has alone, as array<long>."""

    compare: Callable[[Column, Column], Column]
    differ: Callable[[Column, Column], Column]


def _size(column: Column) -> Column:
    return F.size(column).cast("long")


#: Sets as arrays of distinct 64-bit numbers.
ARRAYS = Form(
    lambda l, r: F.struct(_size(F.array_intersect(l, r)).alias("both"), _size(l).alias("n_left"), _size(r).alias("n_right")),
    lambda l, r: F.concat(F.array_except(l, r), F.array_except(r, l)),
)


def _shared(nodes: DataFrame, side: str, name: str) -> tuple[DataFrame, int]:
    """node, <side>: the nodes' keys that another node has too, as a list; nodes without any are gone."""
    rows = nodes.select("node", F.explode(side).alias("key"))
    keys, n = counted(rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key"), f"{name}-{side}-keys")
    return counted(rows.join(bounded(keys, n), "key").groupBy("node").agg(F.collect_set("key").alias(side)), f"{name}-{side}")


def distinct_buckets(rows: DataFrame, name: str, same: Column | None = None, n: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """rows (bucket, node, ...; a node once in a bucket) with n, by default how many nodes the bucket has, of buckets of two nodes or more; of equal buckets one stays.

    same: a hash of what equal buckets have in common of each row, by default of the node. n, wanted: aggregates of a bucket, the second a further test of it."""
    same = F.xxhash64("node") if same is None else same
    members = F.count(F.lit(1))
    summed = rows.groupBy("bucket").agg(members.alias("members"), (members if n is None else n).alias("n"), F.bit_xor(same).alias("x"), F.bit_xor(F.xxhash64(same, F.lit(1))).alias("y"), (F.lit(True) if wanted is None else wanted).alias("_wanted"))
    chosen, count = counted(summed.where("members > 1 and _wanted").groupBy("members", "x", "y").agg(F.min(F.struct("bucket", "n")).alias("b")).select("b.*"), f"{name}-chosen")
    found = keep(rows.join(bounded(chosen, count), "bucket"), f"{name}-buckets")
    discard(chosen)
    return found


def tensored(nodes: DataFrame, name: str) -> DataFrame:
    """bucket, node, n: of each key of tensored bands that two nodes or more have, its nodes, and how many these are.

    nodes: node long, a and b array<long>, the keys of the two collections; a node may be repeated."""
    a, n = _shared(nodes.select("node", "a"), "a", name)
    b, n = _shared(nodes.select("node", "b").join(bounded(a.select("node"), n), "node", "left_semi"), "b", name)
    tables = (
        a.join(bounded(b.select("node"), n), "node", "left_semi").join(b, "node")
        .select("node", F.explode("a").alias("ka"), "b").select("node", "ka", F.explode("b").alias("kb"))
        .select("node", F.xxhash64("ka", "kb").alias("bucket"))
    )
    tables = keep(tables, f"{name}-tables")
    found = distinct_buckets(tables, name)
    discard(a, b, tables)
    release(nodes.sparkSession)
    return found


def verified(pairs: DataFrame, sets: DataFrame, percent: int, form: Form = ARRAYS) -> DataFrame:
    """left, right, both, n_left, n_right, linked of the pairs: the shared items, those of each, and whether these are enough. sets: node, items."""
    left = sets.select(F.col("node").alias("left"), F.col("items").alias("_l"))
    right = sets.select(F.col("node").alias("right"), F.col("items").alias("_r"))
    return (
        pairs.join(right, "right").join(left, "left").select("left", "right", form.compare(F.col("_l"), F.col("_r")).alias("_c")).select("left", "right", "_c.*")
        .withColumn("linked", F.col("both") * (100 + percent) >= percent * (F.col("n_left") + F.col("n_right")))
    )


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, component (its least node) of all nodes of the edges left, right.

    Each round, a node takes the least label of its neighbours, then the label of its label; every round is kept in the shared folder, and the one before it goes."""
    both = keep(edges.select("left", "right").union(edges.select("right", "left")).toDF("node", "near").distinct(), f"{name}-edges")
    labels = keep(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("component")), f"{name}-labels")
    while True:
        found = both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("other")), "near").groupBy("node").agg(F.min("other").alias("other"))
        stepped = labels.join(found, "node").select("node", F.col("component").alias("was"), F.least("component", "other").alias("to"))
        jumped = stepped.join(labels.select(F.col("node").alias("to"), F.col("component").alias("further")), "to").select("node", "was", F.least("to", "further").alias("component"))
        kept = keep(jumped, f"{name}-labels")
        discard(labels)
        labels = kept
        if not kept.where("was <> component").limit(1).count():
            discard(both)
            return labels


def linked(found: DataFrame, sets_of: Callable[[DataFrame, int], DataFrame], percent: int, name: str, form: Form = ARRAYS) -> tuple[DataFrame, DataFrame]:
    """(components, links): node, component of each node that is linked with another; left, right of verified links, enough of them to join each component.

    found: bucket, node, n, of tensored or distinct_buckets. sets_of: from node, and the number of such rows, to node, items of those nodes. Links join sets
    with 100 * intersection >= percent * union."""
    wanted, n = counted(found.select("node").distinct(), f"{name}-wanted")
    sets, n_sets = counted(sets_of(wanted, n), f"{name}-sets")
    if n_sets > n:  # rows that repeat an id and its text
        sets = keep(sets.dropDuplicates(["node"]), f"{name}-sets")
    weights = keep(found.groupBy("node").agg(F.sum("n").alias("weight")), f"{name}-weights")
    links, labels = None, None
    while True:
        stars = keep(_stars(found, weights), f"{name}-stars")
        tested = keep(verified(stars.select(F.col("hub").alias("left"), F.col("node").alias("right")).distinct(), sets, percent, form), f"{name}-tested")
        links, labels = _unite(tested, links, labels, name)
        groups, n_rows, n_large, n_huge = _open_groups(stars, tested, labels, name)
        discard(found, stars, tested)
        release(sets.sparkSession)
        if not n_rows:
            break
        pairs, n_open = _possible(groups.where("tier = 0"), percent), 0
        if n_large:
            counted_ = keep(_counted(groups.where("tier = 1"), sets, percent, form), f"{name}-tested")
            links, labels = _unite(counted_, links, labels, name)
            discard(counted_)
        if n_huge:
            rare = _smaller(groups.where("tier = 2"), sets, percent, name, form)
            pairs = pairs.union(_possible(rare.where(F.col("n") <= FEW_RARE), percent)).distinct()
            found, n_open = counted(rare.where(F.col("n") > FEW_RARE).select("bucket", "node", "n"), f"{name}-found")
        pairs, n_pairs = counted(pairs, f"{name}-pairs")
        if n_pairs:
            tested = keep(verified(pairs, sets, percent, form), f"{name}-tested")
            links, labels = _unite(tested, links, labels, name)
            discard(tested)
        discard(groups, pairs, *([rare] if n_huge else []))
        release(sets.sparkSession)
        if not n_open:
            break
    discard(wanted, sets, weights)
    return labels, links


def _stars(found: DataFrame, weights: DataFrame) -> DataFrame:
    """bucket, hub, node: the nodes of each bucket beside its hub, the one of the greatest weight, ties to the least; buckets of a hub are one. A node is below its hub in that order."""
    hubs = found.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("hub"))
    return found.select("bucket", "node").join(hubs, "bucket").where("node <> hub").select(F.col("hub").alias("bucket"), "hub", "node").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the components of nodes in some columns, under the names given; a node that is linked with none is its own."""
    for column, name in columns.items():
        rows = rows.join(labels.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))
    return rows


def _unite(tested: DataFrame, links: DataFrame | None, labels: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame]:
    """links and labels with those that were tested. Links within a component are not needed and left out; union-find is over components, not nodes."""
    more = tested.where("linked").select("left", "right")
    if labels is None:
        more = keep(more, f"{name}-links")
        return more, components(more, name)
    more, n = counted(_labelled(more, labels, {"left": "_l", "right": "_r"}).where("_l <> _r"), f"{name}-links")
    links = links.union(more.select("left", "right"))
    if n:
        joined = components(more.select(F.col("_l").alias("left"), F.col("_r").alias("right")), name)  # over labels; a node that had none is its own
        moved = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        added = joined.join(labels.select("node"), "node", "left_anti").select("node", "component")
        before, labels = labels, keep(moved.union(added), f"{name}-labels")
        discard(before, joined)
    return links, labels


def _open_groups(stars: DataFrame, tested: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, int, int, int]:
    """stars with component, apart (from the hub's), both, size, hub_size, beside (false), behind (how many items differ), n (the group's nodes without the hub) and tier,
    of groups where, the hub left aside, there are two components or more, one of them apart; how many rows these are, and how many of them of tier 1 and 2. Tier 0 are
    groups of at most FEW, tier 1 those that a task can hold."""
    known = _labelled(stars, labels, {"node": "component", "hub": "_hub"}).withColumn("apart", F.col("component") != F.col("_hub")).drop("_hub")
    sizes = tested.select(F.col("left").alias("hub"), F.col("right").alias("node"), "both", F.col("n_left").alias("hub_size"), F.col("n_right").alias("size"))
    known = keep(known.join(sizes, ["hub", "node"]).withColumn("behind", F.col("size") + F.col("hub_size") - 2 * F.col("both")), f"{name}-known")
    n, items = F.count(F.lit(1)), F.sum("behind")
    tier = F.when(n <= FEW, 0).when((n <= TASK) & (items <= TASK_ITEMS), 1).otherwise(2)
    groups = known.groupBy("bucket").agg(n.alias("n"), tier.alias("tier"), F.max("apart").alias("apart"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_, count = counted(groups.where("apart and low <> high").select("bucket", "n", "tier"), f"{name}-open")
    found = keep(known.join(bounded(open_, count), "bucket").withColumn("beside", F.lit(False)), f"{name}-groups")
    rows, large, huge = found.agg(n, F.count_if(F.col("tier") == 1), F.count_if(F.col("tier") == 2)).first()
    discard(known, open_)
    return found, rows, large, huge


def _excess(percent: int, of: str = "") -> Column:
    """What a set adds to 2 * (100 + percent) * r, with r the items in which two sets that are similar enough both differ from the hub, at least."""
    size, hub_size, both = (F.col(of + c) for c in ("size", "hub_size", "both"))
    return (100 + percent) * (size + hub_size - 2 * both) - (100 - percent) * size


def _possible(groups: DataFrame, percent: int) -> DataFrame:
    """left, right: pairs of groups, one of them apart, that could join two components: what both may have of the hub, and beyond it, is enough for the threshold, and so are
    the items behind the one that they meet in. In groups that are beside, one is apart and one isn't."""
    x, y = groups.where("apart").alias("x"), groups.alias("y")
    most = F.least("x.both", "y.both") + F.least(F.col("x.size") - F.col("x.both"), F.col("y.size") - F.col("y.both"))
    possible = (
        (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.apart") | (F.col("x.node") < F.col("y.node")) & ~F.col("x.beside"))
        & (most * (100 + percent) >= percent * (F.col("x.size") + F.col("y.size")))
        & (2 * (100 + percent) * F.least("x.behind", "y.behind") >= _excess(percent, "x.") + _excess(percent, "y."))
    )
    return x.join(y, possible).select(F.least("x.node", "y.node").alias("left"), F.greatest("x.node", "y.node").alias("right")).distinct()


def _differing(groups: DataFrame, sets: DataFrame, form: Form) -> DataFrame:
    """groups with the items in which a node differs from its hub."""
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items"))
    return groups.join(sets, "node").join(hub_sets, "hub").withColumn("items", form.differ(F.col("hub_items"), F.col("items"))).drop("hub_items")


def _counted(groups: DataFrame, sets: DataFrame, percent: int, form: Form) -> DataFrame:
    """left, right, linked (true): of similar pairs of groups of tier 1, one of them apart, enough to join all components that such pairs join: fewer than nodes."""
    rows = _differing(groups, sets, form).select("bucket", "node", "component", "apart", _excess(percent).alias("excess"), "items")
    return rows.groupBy("bucket").applyInArrow(_similar_in(percent), "left long, right long, linked boolean")


def _similar_in(percent: int):
    def of(group: pa.Table) -> pa.Table:
        nodes, parts, apart, excess = (group[c].to_numpy().copy() for c in ("node", "component", "apart", "excess"))
        lists = group["items"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        _, item = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        item, owner = item.astype(np.int32), np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
        wanted = (np.bincount(item) > 1)[item]  # an item of one node alone is shared with none
        item, owner = item[wanted], owner[wanted]
        of_node = np.cumsum([0, *np.bincount(owner, minlength=len(nodes))])
        order = np.argsort(item, kind="stable")
        by_item = owner[order]
        begins = np.searchsorted(item[order], np.arange(item.max() + 2 if len(item) else 1))
        left, right = [], []
        for x in np.flatnonzero(apart):
            mine = item[of_node[x] : of_node[x + 1]]
            if not len(mine):
                continue
            counts = begins[mine + 1] - begins[mine]
            at = np.arange(counts.sum()) + np.repeat(begins[mine] - np.cumsum(counts) + counts, counts)
            shared = np.bincount(by_item[at], minlength=len(nodes))
            found = np.flatnonzero((shared > 0) & (parts != parts[x]) & (2 * (100 + percent) * shared >= excess + excess[x]))
            others, first = np.unique(parts[found], return_index=True)
            left += [nodes[x]] * len(others)
            right += nodes[found[first]].tolist()
            parts[np.isin(parts, others)] = parts[x]
        return pa.table({"left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()), "linked": pa.array([True] * len(left), pa.bool_())})

    return of


def _smaller(groups: DataFrame, sets: DataFrame, percent: int, name: str, form: Form) -> DataFrame:
    """groups, each as smaller ones, for each item in which its nodes differ from the hub, of the nodes that have it among the rarest such items: one of nodes that are
    apart, for pairs of these, and one, called beside, for pairs of a node that is apart and one that isn't. n is the number of partners of a node, the fewer;
    behind, how many items, from that one on, a node may share with another.

    With d the items in which a set differs from the hub, and s its size, sets x, y that are similar enough share r items of these at least,
    2 * (100 + percent) * r >= (100 + percent) * (d(x) + d(y)) - (100 - percent) * (s(x) + s(y)), and one at least if x is apart. In one order of items, both
    have one that they share among the first d - r + 1. Items that can't join two components come first in that order: only how many they are is needed."""
    excess = _excess(percent)
    least = groups.groupBy("bucket").agg(F.min(F.when(F.col("apart"), excess)).alias("of_apart"), F.min(F.when(~F.col("apart"), excess)).alias("of_near"))
    held = keep(_differing(groups.drop("n", "tier", "beside", "behind"), sets, form).join(least, "bucket"), f"{name}-held")
    kinds = F.when(F.col("apart") & F.col("of_near").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(~F.col("apart")))
    kinds = held.withColumn("beside", F.explode(kinds)).withColumn("row", F.xxhash64("bucket", "beside", "node"))
    each = kinds.select("row", "component", "apart", "beside", "bucket", F.explode("items").alias("item")).withColumn("key", F.xxhash64("bucket", "beside", "item")).drop("bucket", "item")
    times = each.groupBy("key", "beside").agg(F.count(F.lit(1)).alias("times"), F.min("apart").alias("all_apart"), F.max("apart").alias("apart"), F.min("component").alias("low"), F.max("component").alias("high"))
    times, n_times = counted(times.where("apart and low <> high and beside <> all_apart").select("key", "times"), f"{name}-times")
    rest = each.select("key", "row").join(bounded(times, n_times), "key").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("rest"))
    other = F.when(F.col("apart") & F.col("beside"), F.col("of_near")).otherwise(F.col("of_apart"))
    needed = F.ceil((excess + other) / (2 * (100 + percent)))
    count = F.size("rest") - F.greatest(F.lit(1), needed) + 1  # of those that come first there are size(items) - size(rest)
    first = F.slice("rest", F.lit(1), F.greatest(F.lit(0), count).cast("int"))
    rare = kinds.drop("items").join(rest, "row")
    rare = rare.select(*[c for c in rare.columns if c not in ("bucket", "row", "of_apart", "of_near", "rest")], _size(F.col("rest")).alias("n_rest"), F.posexplode(first).alias("at", "rest"))
    rare = rare.withColumn("behind", F.col("n_rest") - F.col("at")).withColumn("bucket", F.col("rest.key")).drop("n_rest", "at", "rest")
    rare = keep(rare, f"{name}-rare")
    members, apart = F.count(F.lit(1)), F.sum(F.col("apart").cast("long"))
    found = distinct_buckets(
        rare, name, F.xxhash64("node", "apart", "beside"), F.when(F.max("beside"), F.least(apart, members - apart)).otherwise(members),
        F.max("apart") & (F.min("component") != F.max("component")) & (F.max("beside") != F.min("apart")),
    )
    discard(held, times, rare)
    release(sets.sparkSession)
    return found
