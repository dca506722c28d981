"""Graph queries without SQL, over all line items, against brute force."""

from collections import Counter, defaultdict

import pytest

from quillon.plans import registry

#: (order, supplier, part): no order is a round number, and there are more than twenty.
LINES = [(2 * k + 1, k % 4, k // 3) for k in range(30)] + [(2 * k + 1, k % 3, 20 + k) for k in range(30)] + [(101, 1, 60), (103, 1, 60), (105, 2, 61), (107, 2, 62), (107, 2, 61)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(LINES, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def near(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def test_weighted_paths(spark, folder):
    steps = near((f"o{o}", f"p{p}") for o, _, p in LINES)
    want = {}

    def walk(nodes, flows):
        if flows:
            want[">".join(nodes)] = round(sum(flows) / len(flows), 6)
        if len(flows) < 3 and (not flows or flows[-1] > 0.3):
            for n in steps[nodes[-1]] - set(nodes):
                walk((*nodes, n), (*flows, (flows[-1] if flows else 1) * 0.8 / len(steps[nodes[-1]])))

    for n in list(steps):
        if n[0] == "o":
            walk((n,), ())
    got = registry.QUERIES["weighted_paths"](spark, folder).collect()
    assert {r["path"]: r["score"] for r in got} == pytest.approx(want)
    assert any(r["path"].count(">") > 1 for r in got) and len({r["start"] for r in got}) > 20


def test_label_communities(spark, folder):
    pairs = {(f"s{s}", f"p{p}") for _, s, p in LINES}
    steps = near(pairs)
    labels = {n: n for n in steps}
    for _ in range(5):
        votes = {n: Counter([labels[x] for x in steps[n]] + [labels[n]]) for n in steps}
        labels = {n: min(votes[n], key=lambda x: (-votes[n][x], x)) for n in steps}
    sizes, inner = Counter(labels.values()), Counter(labels[a] for a, b in pairs if labels[a] == labels[b])
    got = {(r["community"], r["size"], r["n_relations"]) for r in registry.QUERIES["label_communities"](spark, folder).collect()}
    assert got == {(c, n, inner[c]) for c, n in sizes.items() if n > 1}


def test_paths_are_kept_as_lists_of_ends(spark, monkeypatch):
    from quillon.operators import graph

    kept, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    pairs = [("a", "hub"), ("a", "hub"), ("hub", None), *[(f"x{k}", "hub") for k in range(40)], ("a", "a")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    found = graph.flow_paths(edges, spark.createDataFrame([("a",), ("x1",), (None,)], "node string"), 3)
    got = {">".join(r["nodes"]): r["score"] for r in found.collect()}
    degree = {"a": 2, "hub": 42, "x1": 1}
    want = {f"{s}>hub": round(0.8 / degree[s], 6) for s in ("a", "x1")}
    want |= {f"{s}>hub>{e}": round((0.8 / degree[s] + 0.64 / degree[s] / 42) / 2, 6) for s in ("a", "x1") for e in ["a", *(f"x{k}" for k in range(40))] if s != e}
    assert got == want and found.count() == len(got)
    assert sum(len(df.take(100)) for df in kept[1:]) < 10  # a row for each path without its last step
