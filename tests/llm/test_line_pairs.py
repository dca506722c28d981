"""Pairs of lines are compared many at a time, in arrays."""

import random

import numpy as np
import pandas as pd
import pytest

from quillon.llm import linededup


@pytest.mark.parametrize(("pairs", "chars"), [(500, 1_000_000), (7, 1_000_000), (500, 300)])
def test_pairs_against_sets(monkeypatch, pairs, chars):
    monkeypatch.setattr(linededup, "PAIRS", pairs)
    monkeypatch.setattr(linededup, "PAIR_CHARS", chars)
    rng = random.Random(3)
    lines = ["a", "abc", "aaaaaaaaaaaa", "aaaaaaaaaaaaaaaaa", "\ud800 surrogate", "é" * 9] + [" ".join(rng.choices(["one", "two", "three", "four"], k=rng.randint(1, 30))) for _ in range(80)]
    left, right = (pd.Series([rng.choice(lines) for _ in range(1203)]) for _ in range(2))
    sets = [(set(linededup._set(x).tolist()), set(linededup._set(y).tolist())) for x, y in zip(left, right, strict=True)]
    assert list(linededup._compare(left, right).itertuples(index=False, name=None)) == [(len(x & y), len(x), len(y)) for x, y in sets]
    assert [sorted(d.view(np.uint64).tolist()) for d in linededup._differ(left, right)] == [sorted(x ^ y) for x, y in sets]


def test_no_pairs():
    none = pd.Series([], dtype="object")
    assert len(linededup._compare(none, none)) == 0 and len(linededup._differ(none, none)) == 0


def test_pairs_at_a_time_are_bounded_by_characters():
    """500 pairs of long lines were hashed at once before."""
    long = pd.Series([chr(97 + k) * 400_000 for k in range(6)])
    sizes = [sum(map(len, lines)) for lines, *_ in linededup._pairs_at_a_time(long, long)]
    assert len(sizes) == 3 and max(sizes) == 800_000
    assert linededup._compare(long, long)["both"].tolist() == [1] * 6


def test_keys_of_a_part_that_one_node_has_alone():
    import pyarrow as pa

    table = lambda keys, nodes, many, part=0: pa.table({"part": pa.array([part], pa.int32()), "keys": [np.array(keys, np.int64).tobytes()], "nodes": [np.array(nodes, np.int64).tobytes()], "many": [np.array(many, bool).tobytes()]})
    shared = linededup.shared(64)
    rows = lambda t: sorted(zip(t["bucket"].to_pylist(), t["node"].to_pylist(), strict=True))
    assert rows(shared(table([5, 3, 9], [1, 2, 3], [False] * 3))) == []
    assert rows(shared(table([5, 3, 5, 3, 9, 9, 8], [1, 2, 1, 4, 6, 6, 7], [False] * 4 + [False, True, True]))) == [(3, 2), (3, 4), (8, 7), (9, 6)]
    assert rows(shared(table([5, 3], [1, 2], [True] * 2, 64))) == [(3, 2), (5, 1)]
