"""Secret scans: grammar inference.

Three fixed patterns find credentials; a bounded sample of what they find labels the formats. For each format, and for ordinary
tokens, a prefix tree of the sample is folded into a probabilistic automaton: states whose outgoing frequencies, by symbol and
by class of symbols, don't differ significantly (Hoeffding's bound) are merged, in order, until none is left to merge. Every other token is then scored by its
likelihood under each format, and told from ordinary tokens by the ratio.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bounded, discard, keep, table

#: The patterns of the contract, and the fewest characters of group 2 (assign) or of the match.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: As above with the fewest characters in the pattern. A run of a class either has them or no part of it has, so the matches are the same.
FAST = BASE | {"access": (re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20), "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24)}
LEARNED = "learned"
#: Tokens that are scored: whole runs of these characters, as long at least as the shortest credential that a format learned from.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
LEAST = min(least for *_, least in BASE.values())
SYMBOLS = 66

#: Documents whose credentials and tokens are looked at for the fit, about, strings that an automaton learns from at most, and their most characters.
FIT_DOCS, FIT_STRINGS, FIT_LENGTH = 20_000, 400, 256
ALPHA, UNSEEN, MARGIN = 0.05, 1e-3, 6.0


@dataclass
class Automaton:
    """Deterministic: next[state][symbol] = (state, log p); stop[state] = log p of ending there."""

    next: list[dict[str, tuple[int, float]]]
    stop: list[float]
    floor: float  # the least likelihood by character of what it learned from

    def likelihood(self, text: str) -> float:
        """log p of the text by this format; a symbol unknown in a state costs log(UNSEEN / SYMBOLS) and leads back to the start."""
        state, total, miss = 0, 0.0, math.log(UNSEEN / SYMBOLS)
        for symbol in text:
            step = self.next[state].get(symbol)
            if step is None:
                state, total = 0, total + miss
            else:
                state, total = step[0], total + step[1]
        return total + self.stop[state]


def _classes(edges: dict[str, list[int]]) -> Counter:
    """How often each class of symbols goes out of a state: single symbols may all be rare where the classes differ."""
    found: Counter = Counter()
    for c, (_, n) in edges.items():
        found["digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other"] += n
    return found


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton | None:
    """The automaton that state merging makes of the strings; none of none.

    Red states are settled, blue ones are their children. A blue state joins the first red one that it agrees with, all the way
    down both subtrees, or turns red."""
    if not strings:
        return None
    edges: list[dict[str, list[int]]] = [{}]  # of each state: symbol -> [state, strings that went that way]
    ended = [0]
    for s in sorted(strings):
        state = 0
        for c in s:
            if c not in edges[state]:
                edges[state][c] = [len(edges), 0]
                edges.append({})
                ended.append(0)
            step = edges[state][c]
            step[1] += 1
            state = step[0]
        ended[state] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))
    size = lambda x: ended[x] + sum(n for _, n in edges[x].values())

    def agree(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = size(a), size(b)
            if not n or not m:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(ended[a] / n - ended[b] / m) > bound:
                return False
            left, right = _classes(edges[a]), _classes(edges[b])
            if any(abs(left[k] / n - right[k] / m) > bound for k in left.keys() | right.keys()):
                return False
            for c in edges[a].keys() | edges[b].keys():
                x, y = edges[a].get(c), edges[b].get(c)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the subtree of b, which is still a tree, to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ended[a] += ended[b]
            for c, (y, n) in edges[b].items():
                if c in edges[a]:
                    edges[a][c][1] += n
                    todo.append((edges[a][c][0], y))
                else:
                    edges[a][c] = [y, n]

    red, settled = [0], {0}
    while True:
        blue = min(((-n, i, c, y) for i, x in enumerate(red) for c, (y, n) in edges[x].items() if y not in settled), default=None)
        if blue is None:
            break
        _, i, c, y = blue
        for x in red:
            if agree(x, y):
                edges[red[i]][c][0] = x
                fold(x, y)
                break
        else:
            red.append(y)
            settled.add(y)
    place = {x: i for i, x in enumerate(red)}
    share = lambda n, x: math.log((1 - UNSEEN) * max(n, 0.5) / max(1, size(x)))
    out = Automaton([{c: (place[y], share(n, x)) for c, (y, n) in edges[x].items()} for x in red], [share(ended[x], x) for x in red], 0.0)
    out.floor = min(out.likelihood(s) / (len(s) + 1) for s in strings)
    return out


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and credential of the base matches, by start, then kind as listed."""
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(FAST.items()):
        found += [(m.start(), k, m.end(), kind, m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(a, b, kind, what) for a, _, b, kind, what in sorted(found)]


def _tokens(text: str, base: list[tuple[int, int, str, str]], least: int) -> Iterator[tuple[int, int, str, bool, bool]]:
    """start, end, token of `least` characters and more, whether a base span covers it whole, and whether one touches it. Both lists are in order: one pass."""
    covers, before, last, touching = 0, 0, 0, 0  # base spans that begin by the token's start, and by its end; the furthest ends of them
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if end - start < least:
            continue
        while covers < len(base) and base[covers][0] <= start:
            last = max(last, base[covers][1])
            covers += 1
        while before < len(base) and base[before][0] < end:
            touching = max(touching, base[before][1])
            before += 1
        yield start, end, m[0], last >= end, touching > start


def tokens(text: str, base: list[tuple[int, int, str, str]], least: int = LEAST) -> Iterator[tuple[int, int, str]]:
    """The tokens to score: those of `least` characters and more that no base span covers whole."""
    for a, b, what, covered, _ in _tokens(text, base, least):
        if not covered:
            yield a, b, what


def ordinary(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[str]:
    """The tokens that no base span touches, to learn from."""
    for _, _, what, _, touched in _tokens(text, base, LEAST):
        if not touched:
            yield what


@dataclass
class Model:
    formats: dict[str, Automaton]
    plain: Automaton | None
    least: int = LEAST  # characters of the shortest string that a format learned from

    def is_secret(self, token: str) -> bool:
        """Whether some format is as likely as for its own samples, and MARGIN nats likelier than for ordinary tokens."""
        for a in self.formats.values():
            like = a.likelihood(token)
            if like / (len(token) + 1) >= a.floor and (self.plain is None or like >= self.plain.likelihood(token) + MARGIN):
                return True
        return False


def fit(docs: DataFrame) -> Model:
    """Learns from about FIT_DOCS documents, drawn by their ids, at most FIT_STRINGS strings of each kind, in order of their sha256."""
    count = max(1, docs.count())
    part = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), F.col("doc_id")), F.lit(1 << 30)) < F.lit(math.ceil(FIT_DOCS / count * (1 << 30)))) if count > FIT_DOCS else docs

    @F.pandas_udf("array<struct<kind:string,what:string>>")
    def strings(texts: pd.Series) -> pd.Series:
        def of(text):
            base = base_spans(text or "")
            found = {(kind, what) for *_, kind, what in base} | {("", what) for what in ordinary(text or "", base)}
            return [{"kind": k, "what": w} for k, w in sorted(found) if len(w) <= FIT_LENGTH]

        return pd.Series([of(t) for t in texts])

    found = keep(part.select(F.explode(strings("text")).alias("s")).select("s.kind", "s.what").distinct(), "secrets-strings")
    rows = _least(found)
    discard(found)
    by = {kind: [what for k, what in rows if k == kind] for kind in ("", *BASE)}
    formats = {kind: infer(by[kind]) for kind in BASE}
    return Model({k: a for k, a in formats.items() if a}, infer(by[""]), min((len(w) for kind in BASE for w in by[kind]), default=LEAST))


def _least(found: DataFrame) -> list[tuple[str, str]]:
    """FIT_STRINGS strings of each kind: their sha256 below a bound by kind, then the least."""
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}  # as many rows as kinds
    drawn = F.conv(F.substring(F.sha2("what", 256), 1, 8), 16, 10).cast("long")
    wanted = F.lit(False)
    for kind, n in counts.items():
        wanted |= (F.col("kind") == kind) & (drawn < math.ceil(min(1, 1.5 * FIT_STRINGS / n) * (1 << 32)))
    rows = sorted((hashlib.sha256(r["what"].encode()).hexdigest(), r["kind"], r["what"]) for r in found.where(wanted).collect())
    return [(kind, what) for kind in counts for what in [w for _, k, w in rows if k == kind][:FIT_STRINGS]]


def spans_udf(spark: SparkSession, model: Model):
    """A column of text -> array of kind, start, end: all spans by start, then kind as listed, `learned` last."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        secret = Bounded(sent.value.is_secret)
        for texts in batches:
            yield pd.Series([all_spans(t or "", secret, sent.value.least) for t in texts])

    return apply


def all_spans(text: str, secret: dict[str, bool], least: int = LEAST) -> list[dict]:
    base = base_spans(text)
    found = [(a, i, b, kind) for i, (a, b, kind, _) in enumerate(base)] + [(a, len(base), b, LEARNED) for a, b, token in tokens(text, base, least) if secret[token]]
    return [{"kind": kind, "start": a, "end": b} for a, _, b, kind in sorted(found)]


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. Null texts are empty and have none; ids are carried as they are; repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", spans_udf(spark, fit(docs))("text").alias("s"))
    joined = lambda column: F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(joined(F.filter("s", lambda x: x["kind"] != LEARNED)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"), count(LEARNED).alias(f"n_{LEARNED}"),
    )
