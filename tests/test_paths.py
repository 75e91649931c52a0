import random

from matchspark.operators import paths
from matchspark.operators.paths import largest_component, shortest_distances


def test_largest_component_ties_and_lone_nodes(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(1, 8)] + [(2, 5)], "g int, node long")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 5), (1, 5, 6)], "g int, src long, dst long")
    got = {tuple(r) for r in largest_component(nodes, edges, "g").collect()}
    assert got == {(1, 1, 1, 3), (1, 2, 1, 3), (1, 3, 1, 3), (2, 5, 5, 1)}
    assert largest_component(nodes.limit(0), edges.limit(0), "g").count() == 0


def test_shortest_distances_take_a_cheaper_detour(spark):
    edges = spark.createDataFrame([(1, 1, 2, 9.0), (1, 1, 3, 2.0), (1, 3, 2, 3.0), (1, 2, 4, 1.0), (1, 8, 9, 1.0), (2, 1, 2, 4.0)], "g int, src long, dst long, weight double")
    sources = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "g int, node long")
    got = {tuple(r) for r in shortest_distances(sources, edges, "g").collect()}
    assert got == {(1, 1, 0.0), (1, 2, 5.0), (1, 3, 2.0), (1, 4, 6.0), (2, 2, 0.0), (2, 1, 4.0)}
    assert shortest_distances(sources.limit(0), edges, "g").count() == 0


def test_small_graphs_give_paths_without_tables_of_distances(spark, monkeypatch):
    rng = random.Random(3)
    links = {(g, min(a, b), max(a, b)): float(rng.choice([0, 1, 1, 2])) for g in (1, 2) for a, b in (rng.sample(range(14), 2) for _ in range(24))}
    edges = spark.createDataFrame([(*k, w) for k, w in links.items()], "g int, src long, dst long, weight double")
    pairs = spark.createDataFrame([(g, s, t) for g in (1, 2, 3) for s in (0, 5) for t in (0, 5, 9, 13, 99)] + [(1, 0, None), (1, 0, 9)], "g int, source long, target long")
    want = sorted(map(tuple, paths.shortest_paths(pairs, edges, "g", work=0).collect()))
    assert any(r[3] > 1 for r in want)
    monkeypatch.setattr(paths, "shortest_distances", None)
    assert sorted(map(tuple, paths.shortest_paths(pairs, edges, "g").collect())) == want
