"""Structured lookups over dimension tables: aliases, sequences, tiers of names, vocabularies, 1:N details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.hashing import sequence_key

from .sizes import sent


def resolve_alias(asked: DataFrame, names: DataFrame) -> DataFrame:
    """query, id, how: the id of a name of (id, name, kind): its symbol, else an alias; ties by id. Names without an id are gone.

    The names' side is joined on its lower-case name; nothing is broadcast."""
    priority = F.when(F.col("kind") == "symbol", 0).when(F.col("kind") == "alias", 1).otherwise(2)
    joined = asked.select("query", F.lower(F.trim("query")).alias("name")).distinct().join(names.select(F.lower(F.trim("name")).alias("name"), "id", "kind"), "name")
    best = joined.groupBy("query").agg(F.min(F.struct(priority.alias("p"), "id", "kind")).alias("b"))
    return best.select("query", "b.id", F.col("b.kind").alias("how"))


def by_sequence(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of known (sequence, ...) whose trimmed sequence hashes like that of asked (query, sequence)."""
    k = known.withColumn("key", sequence_key(F.col("sequence"))).drop("sequence")
    return asked.select("query", sequence_key(F.col("sequence")).alias("key")).join(k, "key").drop("key")


def by_tiers(asked: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """query, id, tier, name: ids by their exact name, then an exact synonym, then a name that holds the query, in any case; each id once, up to the limit.

    names: id, name, kind (name or synonym). asked is a stated query set, which is broadcast while it is small."""
    q = sent(asked.select("query", F.lower(F.trim("query")).alias("q")).distinct())
    low = F.lower(F.col("name"))
    tier = F.when((F.col("kind") == "name") & (low == F.col("q")), 0).when((F.col("kind") == "synonym") & (low == F.col("q")), 1).when((F.col("kind") == "name") & F.contains(low, F.col("q")), 2)
    hits = names.join(q, F.contains(low, F.col("q"))).withColumn("tier", tier).where("tier is not null")
    best = hits.groupBy("query", "id").agg(F.min(F.struct("tier", "name")).alias("b")).select("query", "id", "b.*")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("tier", "id"))).where(F.col("place") <= limit).drop("place")


def canonical(column: Column, aliases: dict[str, str]) -> Column:
    """A name by its alias, else itself, in lower case, trimmed."""
    low = F.lower(F.trim(column))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return low if table is None else F.coalesce(F.try_element_at(table, low), low)


def vocabulary_max(values: DataFrame, key: str, name: str, value: str, aliases: dict[str, str]) -> DataFrame:
    """The greatest value by key and canonical name."""
    return values.withColumn(name, canonical(F.col(name), aliases)).groupBy(key, name).agg(F.max(value).alias(value))


def resolve_term(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """query, id, how: of terms (id, name) the one with that id, else that name, else the least whose name holds the query or is held by it.

    asked is a stated query set, which is broadcast while it is small."""
    q = sent(asked.select("query", F.lower(F.trim("query")).alias("q")).distinct())
    low = F.lower(F.col("name"))
    how = F.when(F.lower(F.col("id")) == F.col("q"), 0).when(low == F.col("q"), 1).when(F.contains(low, F.col("q")) | F.contains(F.col("q"), low), 2)
    best = terms.join(q, F.contains(low, F.col("q")) | F.contains(F.col("q"), low) | (F.lower(F.col("id")) == F.col("q"))).withColumn("how", how)
    return best.groupBy("query").agg(F.min(F.struct("how", "id")).alias("b")).select("query", "b.id", F.element_at(F.array(*[F.lit(x) for x in ("id", "name", "part")]), F.col("b.how") + 1).alias("how"))


def split_cells(values: DataFrame, column: str) -> DataFrame:
    """tissue::cell as two columns; without ::, the cell is null."""
    parts = F.split(F.col(column), "::", 2)
    return values.withColumn("tissue", F.element_at(parts, 1)).withColumn("cell", F.get(parts, F.lit(1)))
