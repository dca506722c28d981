"""Deterministic ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse


def _name(column: Column) -> Column:
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def entity_id(name: Column, kind: Column) -> Column:
    """16 digits of the sha256 of name:kind, both trimmed, in lower case."""
    return F.substring(F.sha2(F.concat_ws(":", _name(name), F.lower(F.coalesce(kind, F.lit("")))).cast("binary"), 256), 1, 16)


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat_ws(":", source, target, kind)


def community_id(level: Column, place: Column, members: Column) -> Column:
    """L<level>_<place>_<the first five members>."""
    return F.concat(F.lit("L"), level.cast("string"), F.lit("_"), place.cast("string"), F.lit("_"), F.array_join(F.slice(F.array_sort(members), 1, 5), "_"))


def document_hash(text: Column) -> Column:
    """sha256 of a text in lower case with single spaces: equal for copies that differ in these only."""
    return F.sha2(F.lower(collapse(text)).cast("binary"), 256)


def chunk_key(article: Column, title: Column, text: Column) -> Column:
    """The cache key of a chunk: its article, _ft, and 12 digits of the sha1 of title, blank line, text."""
    return F.concat(article.cast("string"), F.lit("_ft"), F.substring(F.sha1(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))).cast("binary")), 1, 12))


def sequence_key(sequence: Column) -> Column:
    """16 digits of the sha1 of a trimmed sequence."""
    return F.substring(F.sha1(F.trim(F.coalesce(sequence, F.lit(""))).cast("binary")), 1, 16)
