"""Fuzzy line dedup: near-equal lines of all documents are found by MinHash, and one line of each component stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import discard, fresh, keep, release, table
from .links import Form, bounded, counted, distinct_buckets, linked
from .neardup import doc_key

#: Characters of a shingle, least similarity in hundredths, bands, hashes of a band. Lines of similarity s meet in a band with probability
#: 1 - (1 - s ** ROWS) ** BANDS: 0.9995 at 0.75, 0.99997 at 0.8, and 2e-7 at the 0.01 that unlike lines have.
CHARS, PERCENT, BANDS, ROWS = 7, 75, 20, 4
#: Characters that numpy works on at a time, about: enough for a function's calls to cost little beside their work, and few enough to stay in a core's cache.
CHUNK = 100_000
#: Distinct lines, and characters of them, that a task gathers before it sends their keys on; keys that meet in one part of the search for equal keys, about; parts at least.
GATHER_LINES, GATHER_CHARS, PART_KEYS, PARTS = 25_000, 4_000_000, 2_000_000, 64
#: Pairs that are compared at a time, few enough to stay in a core's cache, and characters of them, about; bits for the place of a line among those of these pairs, two a pair.
PAIRS, PAIR_CHARS, PLACE_BITS = 100, 1_000_000, 10
LINES = pa.schema([("doc_id", pa.int64()), ("doc_key", pa.int64()), ("line", pa.int32()), ("node", pa.int64())])
LINES_SQL = "doc_id long, doc_key long, line int, node long"
PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("many", pa.binary())])
PACKED_SQL = "part int, keys binary, nodes binary, many binary"


def normal(line: str) -> str:
    """Lines are compared without white space at their ends, in lower case."""
    return line.strip().lower()


def normals(text: str | None) -> list[str]:
    """The normal lines of a text; its case is changed at once, which tells no line from another."""
    return [line.strip() for line in text.lower().split("\n")] if text else []


def node_of(line: str) -> int:
    """A signed 64-bit id of a normal line."""
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _runs(code: np.ndarray, size: int, factor: int, bits: int) -> np.ndarray:
    """The polynomials in factor of each run of `size` codes, made of those of runs half as long."""
    if size == 1:
        return code
    half = _runs(code, size // 2, factor, bits)
    h = half[: len(half) - size // 2] * code.dtype.type(pow(factor, size // 2, 1 << bits))
    h += half[size // 2 :]
    if size % 2:
        h = h[:-1] * code.dtype.type(factor)
        h += code[size - 1 :]
    return h


def shingle_hashes(lines: list[str], bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of CHARS characters within a line, line after line, and where each line begins. A shorter line is filled up to one run."""
    kind = np.uint32 if bits == 32 else np.uint64
    filled = [line.ljust(CHARS, "\0") for line in lines]
    code = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(kind)
    sizes = np.array([len(x) for x in filled])
    h = _runs(code, CHARS, 0x01000193 if bits == 32 else 0x100000001B3, bits)
    count = len(h)
    if bits == 32:
        h ^= h >> kind(16)
        h *= kind(0x7FEB352D)
        h ^= h >> kind(15)
    else:
        h = minhash.mixed(h)
    ends = np.cumsum(sizes)
    inside = np.ones(count, bool)
    for k in range(1, CHARS):  # the last places of each line but the last begin runs that cross into the next
        inside[ends[:-1] - k] = False
    runs = sizes - CHARS + 1
    return h[inside], np.cumsum(runs) - runs


def line_keys(lines: list[str]) -> np.ndarray:
    """The band keys of normal lines, a row a line: half of the bands are of least hashes, half of greatest ones."""
    factors, offsets = minhash.functions(BANDS * ROWS // 2, 6, 32)
    out, at = np.empty((BANDS, len(lines)), np.int64), 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= CHUNK):
            size += len(lines[end])
            end += 1
        out[:, at:end] = minhash.halves(minhash.extremes(*shingle_hashes(lines[at:end]), factors, offsets), ROWS).T
        at = end
    return out.T


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that isn't blank."""
    for batch in batches:
        nodes: dict[str, int] = {}
        owner, lines, found = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            before = len(lines)
            for line, content in enumerate(normals(text)):
                if content:
                    node = nodes.get(content)
                    if node is None:
                        node = nodes[content] = node_of(content)
                    lines.append(line)
                    found.append(node)
            owner.append(len(lines) - before)
        owner = pa.array(np.repeat(np.arange(len(owner)), owner))
        columns = batch.column("doc_id").take(owner), batch.column("doc_key").take(owner), pa.array(lines, pa.int32()), pa.array(found, pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns), schema=LINES)


def packer(parts: int):
    """Batches of text -> rows of PACKED: the band keys of the lines, in parts by key, each with a node that has it, and whether several of those gathered have it.

    The others of these nodes follow in rows of parts from `parts` on: their keys are known to be shared already. So a key that very many nodes have comes to
    its part once from each task's gathering."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        chars = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in normals(text):
                    if line and line not in seen:
                        seen.add(line)
                        chars += len(line)
                if len(seen) >= GATHER_LINES or chars >= GATHER_CHARS:
                    yield _packed(sorted(seen), parts)
                    seen, chars = set(), 0
        if seen:
            yield _packed(sorted(seen), parts)

    return of


def _packed(lines: list[str], parts: int) -> pa.RecordBatch:
    nodes = np.array([node_of(x) for x in lines], np.int64)
    keys = line_keys(lines).T.ravel()
    nodes = np.tile(nodes, BANDS)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    first = np.append(True, keys[1:] != keys[:-1])
    many = np.diff(np.append(np.flatnonzero(first), len(keys))) > 1
    rows = []
    for keys_, nodes_, many_, beyond in ((keys[first], nodes[first], many, 0), (keys[~first], nodes[~first], np.ones(int((~first).sum()), bool), parts)):
        part = (keys_.view(np.uint64) % np.uint64(parts)).astype(np.int64) if not beyond else (np.arange(len(keys_)) // 65_536 + int(keys[0] % parts)) % parts
        order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")  # of up to 16 bits, by radix
        at = np.append(np.flatnonzero(np.append(True, np.diff(part[order]) != 0)), len(part)) if len(part) else [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            some = order[a:b]
            rows.append((int(part[some[0]]) + beyond, keys_[some].tobytes(), nodes_[some].tobytes(), many_[some].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED)


def shared(parts: int):
    """The rows of PACKED of one part -> bucket, node: of each key that two nodes or more have, those that came with it."""

    def of(table_: pa.Table) -> pa.Table:
        keys, nodes, many = (np.frombuffer(b"".join(table_[c].to_pylist()), kind) for c, kind in (("keys", np.int64), ("nodes", np.int64), ("many", bool)))
        if table_["part"][0].as_py() < parts:
            order = np.argsort(keys)
            keys, nodes, many = keys[order], nodes[order], many[order]
            alike = keys[1:] == keys[:-1]
            some = many | np.append(alike, False) | np.append(False, alike)  # a key that comes once, and that one has, is left out before all else
            keys, nodes, many = keys[some], nodes[some], many[some]
        if len(keys) and table_["part"][0].as_py() < parts:
            order = np.lexsort((nodes, keys))
            keys, nodes, many = keys[order], nodes[order], many[order]
            fresh_key = np.append(True, keys[1:] != keys[:-1])
            fresh_pair = fresh_key | np.append(True, nodes[1:] != nodes[:-1])
            starts = np.flatnonzero(fresh_key)
            wanted = (np.add.reduceat(fresh_pair, starts, dtype=np.int64) > 1) | np.logical_or.reduceat(many, starts)
            some = fresh_pair & np.repeat(wanted, np.diff(np.append(starts, len(keys))))
            keys, nodes = keys[some], nodes[some]
        return pa.table({"bucket": keys, "node": nodes})

    return of


def banded(docs: DataFrame, n_lines: int) -> DataFrame:
    """bucket, node, n: of each band key that two lines or more of docs (text) have, their nodes, and how many these are."""
    parts = max(PARTS, -(-n_lines * BANDS // PART_KEYS))
    packed = docs.select("text").mapInArrow(packer(parts), PACKED_SQL)
    rows = keep(packed.groupBy("part").applyInArrow(shared(parts), "bucket long, node long").distinct(), "lines-bands")
    release(docs.sparkSession)
    found = distinct_buckets(rows, "lines")
    discard(rows)
    return found


def line_texts(docs: DataFrame, where: DataFrame, n: int) -> DataFrame:
    """node, items: the normal lines of the nodes in `where` (node, doc_key, line: a place that has it), which has n rows."""

    @F.pandas_udf("array<struct<node:long,items:string>>")
    def items(texts: pd.Series, lines: pd.Series) -> pd.Series:
        def of(text, wanted):
            every = text.split("\n")
            return [{"node": node_of(x), "items": x} for x in (normal(every[k]) for k in wanted)]

        return pd.Series([of(t, w) for t, w in zip(texts, lines, strict=True)])

    places = where.groupBy("doc_key").agg(F.collect_list("line").alias("lines"))
    rows = docs.select("doc_key", "text").join(bounded(places, n), "doc_key")
    return rows.select(F.explode(items("text", "lines")).alias("s")).select("s.*")


def _set(line: str) -> np.ndarray:
    return np.unique(shingle_hashes([line], 64)[0])


def _pairs_at_a_time(left: pd.Series, right: pd.Series) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Of PAIRS pairs at most, of PAIR_CHARS characters or little more: their different lines, the place among these of each left and right line, the hashes of all shingles, where each line's begin."""
    left, right = left.tolist(), right.tolist()
    at = 0
    while at < len(left):
        number: dict[str, int] = {}
        end, size = at, 0
        while end < len(left) and end - at < PAIRS and (end == at or size < PAIR_CHARS):
            for x in (left[end], right[end]):
                if x not in number:
                    number[x] = len(number)
                size += len(x)
            end += 1
        lines = list(number)
        yield lines, np.array([number[x] for x in left[at:end]]), np.array([number[x] for x in right[at:end]]), *shingle_hashes(lines, 64)
        at = end


def _sorted(each: np.ndarray, beside: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    if beside is None:
        return np.sort(each), None
    order = np.argsort(each)
    return each[order], beside[order]


def _met(left: pd.Series, right: pd.Series, hashed: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Of some pairs at a time: how many shingles the left and right lines have; of the shingles of both lines of each pair, pair by pair and in order, the pair's place,
    whether the next one is the same, and the hash, if hashed.

    Place and hash are sorted as one number, the hash without its last PLACE_BITS bits: two lines of 1000 shingles have two of these alike by chance once in 10^10 pairs."""
    place, rest = np.uint64(64 - PLACE_BITS), np.uint64((1 << (64 - PLACE_BITS)) - 1)
    for lines, l, r, hashes, starts in _pairs_at_a_time(left, right):
        owner = np.repeat(np.arange(len(lines), dtype=np.uint64) << place, np.diff(np.append(starts, len(hashes))))
        each = owner | hashes >> np.uint64(PLACE_BITS)
        each, hashes = _sorted(each, hashes if hashed else None)
        once = np.append(True, each[1:] != each[:-1])
        each, hashes = each[once], hashes[once] if hashed else None
        n = np.bincount((each >> place).astype(np.int64), minlength=len(lines))
        taken, begins = np.append(n[l], n[r]), (np.cumsum(n) - n)[np.append(l, r)]
        at = np.arange(taken.sum()) + np.repeat(begins - np.cumsum(taken) + taken, taken)
        pairs = np.arange(len(l), dtype=np.uint64) << place
        each = np.repeat(np.append(pairs, pairs), taken) | each[at] & rest
        each, hashes = _sorted(each, hashes[at] if hashed else None)
        yield n[l], n[r], (each >> place).astype(np.int64), np.append(each[1:] == each[:-1], False), hashes


def _compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    found = [np.column_stack([np.bincount(pair[same], minlength=len(n)), n, m]) for n, m, pair, same, _ in _met(left, right, False)]
    return pd.DataFrame(np.concatenate(found) if found else np.empty((0, 3)), columns=["both", "n_left", "n_right"], dtype="int64")


def _differ(left: pd.Series, right: pd.Series) -> pd.Series:
    found = []
    for n, _, pair, same, hashes in _met(left, right, True):
        alone = ~(same | np.append(False, same[:-1]))
        found += np.split(hashes[alone].view(np.int64), np.cumsum(np.bincount(pair[alone], minlength=len(n)))[:-1])
    return pd.Series(found, dtype="object")


#: Sets of shingles as the lines that they are of: an eighth of the bytes to shuffle.
LINE_FORM = Form(
    lambda left, right: F.pandas_udf(_compare, "both long, n_left long, n_right long")(left, right),
    lambda left, right: F.pandas_udf(_differ, "array<long>")(left, right),
)


def with_dropped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dropped, links): doc_key, lines (places of the lines that go, of documents that lose any); left, right of linked lines.

    Of each component of linked lines, and of each line that occurs again, the first by doc_id (null first), place and doc_key stays; rows that repeat an
    id and its text count as one. Blank lines always stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc_key"), "text")
    lines = keep(docs.mapInArrow(_rows, LINES_SQL), "lines")
    at = F.struct("doc_id", "line", "doc_key").alias("at")

    def sets_of(wanted: DataFrame, n: int) -> DataFrame:
        some = lines.select("node", at).join(bounded(wanted, n), "node").groupBy("node").agg(F.min("at").alias("at"))
        return line_texts(docs, keep(some.select("node", "at.doc_key", "at.line"), "lines-where"), n)

    united, links = linked(banded(docs, lines.count()), sets_of, PERCENT, "lines", LINE_FORM)
    # Only lines that occur again or are linked need a look.
    again = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    nodes, n = counted(again.join(united, "node", "full").select("node", F.coalesce("component", "node").alias("component")), "lines-nodes")
    places = keep(lines.select("node", at).join(bounded(nodes, n), "node").select("component", "at"), "lines-places")
    stays, n = counted(places.groupBy("component").agg(F.min("at").alias("stays")), "lines-stays")
    gone = places.join(bounded(stays, 2 * n), "component").where(F.col("at") != F.col("stays"))
    dropped = keep(gone.groupBy("at.doc_key").agg(F.collect_set("at.line").alias("lines")), "lines-dropped")
    discard(lines, nodes, places, stays, united)
    release(docs.sparkSession)
    return dropped, links


def _cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines at the places that go; null where none goes."""

    def of(text, lines):
        if lines is None:
            return None
        out = set(lines.tolist())
        return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in out)

    return pd.Series([of(t, g) for t, g in zip(texts, gone, strict=True)], dtype="object")


def deduped(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the lines that go taken out of text, and the name of a further column, which has the places of these lines, null where none goes.

    n_chars, if there is such a column, is counted anew where lines went."""
    dropped, _ = with_dropped(docs.select("doc_id", "text"))
    key, gone = fresh(docs, "line_key"), fresh(docs, "lines_gone")
    each = dropped.select(F.col("doc_key").alias(key), F.col("lines").alias(gone))
    docs_, lines_ = dropped.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    joined = docs.withColumn(key, doc_key()).join(bounded(each, docs_ + lines_ // 4), key, "left")
    once = F.pandas_udf(_cut, "string").asNondeterministic()  # else a filter on text cuts again, in a second Python worker of each task
    cut = once(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, gone), gone


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of all documents, lines that near-equal an earlier one taken out."""
    found, gone = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    # A document all of whose lines went has an empty text, which splits into one line.
    lines = F.when((F.col("text") == "") & (dropped > 0), dropped).otherwise(left + dropped)
    return found.select("doc_id", lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), "text")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the pipeline: docs without repeated lines; a document of which nothing but white space is left by that goes."""
    found, gone = deduped(docs)
    return found.where(F.col(gone).isNull() | F.regexp_like("text", F.lit(r"\S"))).select(*docs.columns)
