"""Hand-checked graphs."""

import os
import random

import pytest

from granary.operators import graph as G


def edges(spark, text, schema="src long, dst long"):
    return spark.createDataFrame([tuple(map(int, line.split())) for line in text.split(",")], schema)


def as_map(df, *names):
    return {r[names[0]]: r[names[1]] for r in df.collect()}


def test_lineage(spark):
    e = edges(spark, "1 2,2 3,1 4")
    assert as_map(G.lineage(e, 1), "node", "depth") == {1: 0, 2: 1, 4: 1, 3: 2}
    assert as_map(G.lineage(e, 1, max_depth=1), "node", "depth") == {1: 0, 2: 1, 4: 1}
    assert as_map(G.lineage(e, 3, upstream=True), "node", "depth") == {3: 0, 2: 1, 1: 2}
    assert G.lineage(e, 99).count() == 0


def test_distance_and_reach(spark):
    e = edges(spark, "0 1,1 2,3 4")
    assert as_map(G.distances(e, 0), "node", "distance") == {0: 0, 1: 1, 2: 2, 3: -1, 4: -1}
    assert G.reachable(e, 0, 2).first()[0] is True
    assert G.reachable(e, 0, 4).first()[0] is False


def test_components(spark):
    got = as_map(G.components(edges(spark, "1 2,2 3,5 6")), "node", "component")
    assert got[1] == got[3] and got[2] != got[5]
    got = as_map(G.components(edges(spark, "1 2,2 3,5 6,1 6")), "node", "component")
    assert set(got.values()) == {1}


def test_components_random(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = as_map(G.components(spark.createDataFrame(pairs, "src long, dst long")), "node", "component")
    assert got == {x: find(x) for x in parent}


def test_bipartite(spark):
    even = "1 0,1 4,1 2,0 3,3 4"
    assert [r.is_bipartite for r in G.bipartite(edges(spark, even)).collect()] == [True]
    assert [r.is_bipartite for r in G.bipartite(edges(spark, even + ",0 4")).collect()] == [False]


def test_topological_levels(spark):
    pairs = "4 1,4 6,4 2,1 6,1 3,6 7,2 7,2 5,7 0,3 0,3 7,0 5"
    level = as_map(G.topological_levels(edges(spark, pairs)), "node", "level")
    assert all(level[int(a)] < level[int(b)] for a, b in (p.split() for p in pairs.split(",")))
    assert level[4] == 0 and level[5] == 5
    with pytest.raises(ValueError):
        G.topological_levels(edges(spark, "1 2,2 1"))


def test_shortest_paths(spark):
    e = edges(spark, "0 1 3,0 2 5,1 3 12,1 2 4,2 3 9,2 4 4,3 5 2,4 3 7,4 5 8", "src long, dst long, weight long")
    assert as_map(G.shortest_paths(e, 0), "node", "distance") == {0: 0, 1: 3, 2: 5, 3: 14, 4: 9, 5: 16}
    loop = edges(spark, "0 1 1,1 2 -3,2 1 1", "src long, dst long, weight long")
    assert as_map(G.shortest_paths(loop, 0), "node", "negative_cycle") == {0: False, 1: True, 2: True}


def test_negative_cycle_spoils_only_what_it_reaches(spark):
    e = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (3, 4, 1), (4, 3, -2), (4, 5, 7)], "src long, dst long, weight long")
    found = G.shortest_paths(e, 1)
    assert as_map(found, "node", "distance") == {1: 0, 2: 1, 3: None, 4: None, 5: None}
    assert as_map(found, "node", "negative_cycle") == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_spanning_tree(spark):
    rng = random.Random(2)
    weights = {}
    for _ in range(150):
        a, b = rng.sample(range(40), 2)
        weights[min(a, b), max(a, b)] = rng.randrange(20)
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for w, a, b in sorted((w, a, b) for (a, b), w in weights.items()):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b, w))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src long, dst long, weight long")
    assert {tuple(r) for r in G.minimum_spanning_tree(df).collect()} == want


def test_tree(spark):
    e = edges(spark, "0 1,1 2,1 3,2 4,0 5,5 6,6 7,6 8,5 9,9 10,9 11,0 12,12 13,12 14")
    got = {r.node: (r.depth, r.size) for r in G.tree_stats(e, 0).collect()}
    assert got[0] == (0, 15) and got[1] == (1, 4) and got[5] == (1, 7) and got[4] == (3, 1) and got[9] == (2, 3)


def test_adjacency(spark):
    got = {(r.src, r.block): r.neighbours for r in G.adjacency(edges(spark, "0 1,0 7,0 3,1 0"), width=5).collect()}
    assert got == {(0, 0): [1, 3], (0, 1): [7], (1, 0): [0]}


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.checkpoint(eager=True)

    monkeypatch.setattr(G, "cut_lineage", spy)
    monkeypatch.setattr(G, "SMALL", 0, raising=False)
    e = spark.range(1, 16).selectExpr("id div 2 as src", "id as dst", "1 as weight")
    assert as_map(G.lineage(e, 1), "node", "depth")[15] == 3
    assert as_map(G.topological_levels(e), "node", "level")[15] == 4
    assert as_map(G.shortest_paths(e, 1), "node", "distance")[15] == 3
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_bipartite_far_nodes_and_plan(spark, monkeypatch):
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.checkpoint(eager=True)

    monkeypatch.setattr(G, "cut_lineage", spy)
    near = spark.createDataFrame([(-5, 3), (3, 4), (4, -5), (8, 9)], "src long, dst long")
    assert as_map(G.bipartite(near), "component", "is_bipartite") == {-5: False, 8: True}
    assert not [p for p in plans if "SortAggregate" in p]
    far = spark.createDataFrame([(-(2**63), 2**63 - 1), (2**63 - 1, 1), (1, -(2**63)), (8, 9)], "src long, dst long")
    assert as_map(G.bipartite(far), "component", "is_bipartite") == {-(2**63): False, 8: True}


def two_coloured(pairs):
    """(smallest node -> can be coloured) by walking; None is a node before all others."""
    key, ahead, seen, out = lambda x: (x is not None, x or 0), {}, {}, {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, []).append(a)
    for start in sorted(ahead, key=key):
        if start in seen:
            continue
        seen[start], out[start], todo = 0, True, [start]
        while todo:
            a = todo.pop()
            for b in ahead[a]:
                if b not in seen:
                    seen[b] = 1 - seen[a]
                    todo.append(b)
                elif seen[b] == seen[a]:
                    out[start] = False
    return out


def test_bipartite_random_nulls_and_loops(spark):
    rng = random.Random(4)
    pairs = [(1, 1), (2, 3), (3, 2), (2, 3), (None, 7), (7, 8), (8, None), (5, None)]
    for base, odd in ((100, False), (200, True), (300, False), (400, True)):
        pairs += [(base + a, base + a + rng.choice((1, 3, 5)) + (odd and i == 20)) for i, a in enumerate(rng.randrange(60) for _ in range(45))]
    pairs += [(500 + i, 501 + i) for i in range(40)] + [(600 + i, 601 + i) for i in range(40)] + [(640, 600), (700, 700), (700, 701)]
    for given in (pairs, [p for p in pairs if None not in p]):
        assert as_map(G.bipartite(spark.createDataFrame(given, "src long, dst long")), "component", "is_bipartite") == two_coloured(given)
    words = [(f"n{a}", f"n{b}") for a, b in [(1, 2), (2, 3), (3, 1), (5, 6), (9, 9)]]
    assert as_map(G.bipartite(spark.createDataFrame(words, "src string, dst string")), "component", "is_bipartite") == {"n1": False, "n5": True, "n9": False}
    assert G.bipartite(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_bipartite_keeps_few_files(spark):
    """20,000 edges: what stays stored is less than 16 bytes each, not several copies of all of them."""
    def stored():
        root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names)

    rng, before = random.Random(5), stored()
    e = spark.createDataFrame([(rng.randrange(500), 1000 + rng.randrange(300)) for _ in range(20_000)], "src long, dst long")
    assert as_map(G.bipartite(e), "component", "is_bipartite") == {0: True}
    assert stored() - before < 16 * 20_000


def test_spanning_forest_of_ties_hashes(spark, monkeypatch):
    """Several trees, equal weights, edges given twice and loops; every round's aggregates hash and need not sort structs."""
    plans = []
    for name in ("cut_lineage", "materialise"):
        if hasattr(G, name):
            monkeypatch.setattr(G, name, lambda df, *rest, of=getattr(G, name): (plans.append(df._jdf.queryExecution().executedPlan().toString()), of(df, *rest))[1])
    pairs = [(i, i + 1, 1) for i in range(40)] + [(i + 1, i, 2) for i in range(40)] + [(100, 101, 5), (101, 102, 5), (102, 100, 5), (7, 7, 0)]
    got = {tuple(r) for r in G.minimum_spanning_tree(spark.createDataFrame(pairs, "src long, dst long, weight long")).collect()}
    assert got == {(i, i + 1, 1) for i in range(40)} | {(100, 101, 5), (100, 102, 5)}
    assert plans and not any("SortAggregate" in p for p in plans)
    none = G.minimum_spanning_tree(spark.createDataFrame([(7, 7, 0)], "src long, dst long, weight long"))
    assert none.columns == ["src", "dst", "weight"] and none.isEmpty()
