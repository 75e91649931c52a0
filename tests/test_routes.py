import math

import pytest

from matchspark.operators import forks, life_features, paths, routes

TOUCH = "touch_id long, match_id int, player_id int, segment_idx int, t int, map_id int, wool_id int, team string, wx double, wz double, sx double, sz double"


def touch(i, team="red"):
    return (i, 1, i, 0, 100, 1, 0, team, 100.0, 0.0, 0.0, 0.0)


def walked(points, i):
    return [(1, i, 0, t, 1000 * i + t, x, z) for t, (x, z) in enumerate(points)]


SAMPLES = "match_id int, player_id int, segment_idx int, t int, row_id long, x int, z int"


def test_reached_starts_before_the_last_sample_outside(spark):
    ways = {1: [(0, 0), (50, 0), (90, 0), (60, 0), (80, 0), (100, 0)], 2: [(0, 0), (10, 0), (20, 0), (30, 0)], 3: [(99, 0)] * 5, 4: [(0, 0), (100, 0)]}
    samples = spark.createDataFrame([r for i, way in ways.items() for r in walked(way, i)], SAMPLES)
    touches = spark.createDataFrame([touch(i) for i in ways], TOUCH)
    got = sorted(tuple(r) for r in routes.reached(touches, samples, 30, 1).collect())
    assert got == [(1, 3, 90, 0), (1, 4, 60, 0), (1, 5, 80, 0), (1, 6, 100, 0)]


def test_bundles_split_where_two_routes_run(spark):
    touches = spark.createDataFrame([touch(i) for i in range(12)], TOUCH)
    rows = [(i, k, 30 + 10 * k, (20 if i % 2 else -20) if k < 3 else 0) for i in range(12) for k in range(8)]
    found = routes.bundles(spark.createDataFrame(rows, "touch_id long, idx int, x int, z int"), touches, ["map_id", "wool_id", "team"], 10, 5)
    profile = routes.split_profile(found, ["map_id", "wool_id", "team"])
    first = profile.where("k = 0").first()
    assert first.n == 12 and first.gap == pytest.approx(40) and first.minority == pytest.approx(0.5)
    (row,) = routes.route_splits(profile, ["map_id", "wool_id", "team"]).collect()
    assert row.two_lanes and not row.two_approaches
    assert routes.bundles(spark.createDataFrame(rows, "touch_id long, idx int, x int, z int"), touches, ["map_id", "wool_id", "team"], 13, 5).count() == 0


def test_void_sides_count_both_ways_round_and_leave_out_passes(spark):
    around = lambda side: [(10, 0), (40, side), (50, side), (60, side), (95, 0)]
    ways = [around(14)] * 3 + [around(-14)] + [[(10, 90), (50, 90), (95, 90)]] + [[(70, 5), (80, 0), (95, 0)]]
    touches = spark.createDataFrame([touch(i) for i in range(len(ways))], TOUCH)
    points = spark.createDataFrame([(i, k, x, z) for i, way in enumerate(ways) for k, (x, z) in enumerate(way)], "touch_id long, idx int, x int, z int")
    voids = spark.createDataFrame([(1, 3, 50.0, 0.0, 10.0), (2, 3, 50.0, 0.0, 10.0)], "map_id int, void_id int, x double, z double, half double")
    assert [tuple(r) for r in routes.void_sides(points, touches, voids, 2).collect()] == [(1, 3, 0, "red", 4, 1, 0.25)]
    assert routes.void_sides(points, touches, voids, 5).count() == 0


def grid_graph(spark):
    """A stem of three nodes, then an arm to each side."""
    spots = {0: (0, 0), 1: (5, 0), 2: (10, 0), 3: (10, 5), 4: (10, 10), 5: (10, -5), 6: (10, -10), 7: (10, -15), 9: (90, 90)}
    nodes = spark.createDataFrame([(g, n, float(x), float(z), n == 2) for g in (1, 2) for n, (x, z) in spots.items()], "g int, node long, x double, z double, junction boolean")
    edges = spark.createDataFrame([(g, a, b, 5.0) for g in (1, 2) for a, b in ((0, 1), (1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (6, 7))], "g int, src long, dst long, weight double")
    return nodes, edges


def test_fork_metrics(spark):
    nodes, edges = grid_graph(spark)
    ends = spark.createDataFrame([(1, "red", 2, 0, 4, 7), (2, "red", 2, 0, 4, 9), (2, "blue", 2, None, 4, 7)], "g int, team string, rows int, spawn long, first long, second long")
    metrics = forks.fork_metrics(ends, nodes, edges, "g")
    (row,) = metrics.collect()
    assert (row.g, row.d_first, row.d_second, row.j_first, row.j_second, row.d_fork, row.shared) == (1, 20.0, 25.0, 1, 1, 10.0, 0.5)
    assert row.asymmetry == pytest.approx(0.2) and row.e_second == pytest.approx(math.hypot(10, 15)) and row.offset == pytest.approx(10)
    assert row.angle == pytest.approx(45 + math.degrees(math.atan2(15, 10)))
    more = ends.unionByName(spark.createDataFrame([(7, "red", 2, 0, 4, 7), (8, "red", 1, 0, None, None)], ends.schema))
    assert {tuple(r) for r in forks.fork_study(more, metrics, nodes, "g").collect()} == {("analysed", 1, 1), ("other", 2, 1), ("no_graph", 1, 1), ("wrong_count", 1, 1)}


def test_eligible_halves_and_their_ends(spark):
    spawns = spark.createDataFrame([(g, t, x, 0.0) for g in (1, 2, 3) for t, x in (("red", -1.0), ("red", 1.0), ("blue", 50.0))] + [(4, "red", 0.0, 0.0)], "g int, team string, x double, z double")
    wools = spark.createDataFrame([(g, t, w, 10.0, z) for g in (1, 2, 3, 4) for t, w, z in (("red", 0, 11.0), ("red", 1, -16.0), ("blue", 2, 11.0), ("blue", 3, 12.0)) if (g, w) != (2, 3)] + [(3, "red", 5, 0.0, 0.0)], "g int, team string, wool_id int, x double, z double")
    halves = forks.eligible_halves(spawns, wools, "g")
    assert {(r.g, r.team, r.wool_id, r.spawn_x) for r in halves.collect()} == {(1, "red", 0, 0.0), (1, "red", 1, 0.0), (1, "blue", 2, 50.0), (1, "blue", 3, 50.0)}
    nodes, _ = grid_graph(spark)
    assert {tuple(r) for r in forks.fork_ends(halves, nodes, nodes, "g", 45).collect()} == {(1, "red", 2, 0, 4, 7), (1, "blue", 2, 2, None, None)}


@pytest.mark.parametrize("work", [0, 30, 10**6])
def test_paths_walked_locally_and_in_rounds_agree(spark, work):
    _, edges = grid_graph(spark)
    sources = spark.createDataFrame([(1, 0), (1, 7), (2, 4), (3, 1)], "g int, node long")
    got = {tuple(r) for r in paths.shortest_distances(sources, edges, "g", True, work=work).collect()}
    assert (1, 0, 7, 25.0) in got and (1, 7, 0, 25.0) in got and (2, 4, 0, 20.0) in got and (3, 1, 1, 0.0) in got and len(got) == 8 * 3 + 1
    pairs = spark.createDataFrame([(1, 0, 7), (2, 4, 7), (1, 0, 9)], "g int, source long, target long")
    rows = sorted(tuple(r) for r in paths.shortest_paths(pairs, edges, "g", work=work).collect())
    assert [r[4] for r in rows if r[0] == 1] == [0, 1, 2, 5, 6, 7] and [r[4] for r in rows if r[0] == 2] == [4, 3, 2, 5, 6, 7]


def test_snapped_features(spark):
    _, edges = grid_graph(spark)
    table = life_features.objective_table(spark.createDataFrame([(1, 7, "blue"), (1, 0, "red")], "match_id int, node long, team string"), edges.withColumnRenamed("g", "match_id"), "match_id")
    depths = life_features.attack_depths(table, spark.createDataFrame([(1, "red"), (1, "blue")], "match_id int, team string"), "match_id")
    rows = [(1, 5, 0, "red", t, t, y, n, "island", 3 if t < 4 else 8) for t, (n, y) in enumerate([(0, 5), (2, 5), (6, 5), (5, 5), (6, 0)])]
    rows += [(1, 6, 0, "blue", t, t, 5, 9, "build_region", None) for t in range(4)] + [(1, 7, 0, "red", 0, 0, 5, 2, "void", None)] + [(1, 7, None, "red", 0, 0, 5, 2, "void", None)]
    samples = spark.createDataFrame(rows, "match_id int, player_id int, segment_idx int, team string, t int, row_id long, y int, node_id long, location_type string, island_id int")
    homes = spark.createDataFrame([(1, "red", 8)], "match_id int, team string, island_id int")
    got = {tuple(r) for r in life_features.snapped_features(samples, depths, homes, "match_id").collect()}
    assert got == {(1, 5, 0, 4, "0,2,6,5", 5.0, 2, 7, "home_island"), (1, 6, 0, 4, "9,9,9,9", None, None, None, "bridge")}
