import pytest

from matchspark.operators import cluster_graph, team_shapes

CELLS = "map_id int, team string, x int, z int"


def test_halves_of_a_team_and_a_middle_row(spark):
    both = [(x, z) for x in (0, 1, 2, 6, 7, 8) for z in range(3)]
    rows = [(1, "red", x, z) for x, z in both] + [(1, "red", 4, z) for z in range(9)] + [(1, "blue", 0, z) for z in range(5)] + [(1, "green", x, 0) for x in (3, 5, 0)]
    axes = spark.createDataFrame([(1, t, "mirror_x") for t in ("red", "blue", "green", "none")], "map_id int, team string, axis string")
    middles = spark.createDataFrame([(1, 8, 8)], "map_id int, sx int, sz int")
    got = {r.team: (r.overlap, r.symmetric) for r in team_shapes.team_symmetry(spark.createDataFrame(rows, CELLS), axes, middles).collect()}
    assert got == {"red": (1.0, True), "blue": (0.0, False), "green": (0.5, False), "none": (0.0, False)}


def test_axes_cross_the_way_that_parts_the_teams(spark):
    homes = spark.createDataFrame([(m, "red", x, z) for m in range(1, 6) for x, z in [(10.0, 3.0)]] + [(6, "red", 1.0, 9.0)], "map_id int, team string, x double, z double")
    symmetry = spark.createDataFrame([(1, "mirror_z"), (2, "mirror_x"), (3, "point"), (4, "rotation"), (5, "none"), (6, "point")], "map_id int, symmetry string")
    middles = spark.createDataFrame([(m, 0, 0) for m in range(1, 7)], "map_id int, sx int, sz int")
    got = {r.map_id: r.axis for r in team_shapes.inner_axes(homes, symmetry, middles).collect()}
    assert got == {1: "mirror_x", 2: "mirror_z", 3: "mirror_z", 4: "mirror_z", 6: "mirror_x"}


def test_coverage_of_turned_shapes(spark):
    rows = [(1, 0, "a", "s"), (1, 1, "b", "s"), (1, 2, "a", "t"), (1, 3, "b", "t"), (1, 4, "b", "t"), (1, 5, None, "u")]
    got = {tuple(r) for r in team_shapes.canonical_coverage(spark.createDataFrame(rows, "map_id int, island_id int, team string, shape string")).collect()}
    assert got == {(1, "a", 2, 2, True), (1, "b", 2, 1, False)}


def test_unplayable_islands(spark):
    cells = spark.createDataFrame([(1, 4, 10, 10), (1, 5, 8, 12), (1, 6, 9, 8), (2, 1, 0, 0)], "map_id int, island_id int, x int, z int")
    observers = spark.createDataFrame([(1, 10.5, 10.0), (2, 9.0, 9.0)], "map_id int, x double, z double")
    seen = team_shapes.observer_islands(observers, cells)
    assert [tuple(r) for r in seen.collect()] == [(1, 4)]
    moved = team_shapes.observer_islands(spark.createDataFrame([(1, 10.0, 11.0)], "map_id int, x double, z double"), cells.where("island_id <> 4"))
    assert [tuple(r) for r in moved.collect()] == [(1, 5)]
    figures = spark.createDataFrame([(1, i, x, 5.0) for i, x in ((4, 0.0), (5, 99.0), (6, 99.0), (7, 5.0))] + [(2, 1, 99.0, 0.0)], "map_id int, island_id int, center_x double, center_z double")
    boxes = spark.createDataFrame([(1, 0, 10, 0, 10)], "map_id int, min_x int, max_x int, min_z int, max_z int")
    out = team_shapes.unplayable(figures, seen, figures.where("island_id = 5"), boxes)
    assert {tuple(r) for r in out.collect()} == {(1, 4, "observer"), (1, 5, "listed"), (1, 6, "outside")}


def test_centres_settle_on_groups_of_places(spark):
    groups = [(0, 0), (40, 0), (0, 40)]
    places = [(m, gx + dx, gz + dz, 1 + (dx == 0)) for m in (1, 2) for gx, gz in groups for dx in (-1, 0, 1) for dz in (0, 1)]
    rows = spark.createDataFrame(places, "map_id int, x int, z int, n long")
    start = cluster_graph.first_centres(rows, 3, 3)
    assert start.groupBy("map_id").count().collect()[0][1] == 3
    ends = {(r.map_id, round(r.x, 6), round(r.z, 6)) for r in cluster_graph.lloyd(rows, start, 6).collect()}
    assert ends == {(m, float(gx), gz + 0.5) for m in (1, 2) for gx, gz in groups}
    assert cluster_graph.first_centres(rows).groupBy("map_id").count().collect()[0][1] == 18


def test_cluster_edges_and_voids(spark):
    centres = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 20.0, 0.0), (1, 2, 40.0, 0.0)], "map_id int, node_id long, x double, z double")
    xs = [0, 21, 1, 19, 41, 40, 0]
    samples = spark.createDataFrame([(1, 7, 10 * k + (100 if k == 6 else 0), k, x, 0) for k, x in enumerate(xs)], "map_id int, life int, t int, row_id long, x int, z int")
    valid = spark.createDataFrame([(1, 0, 0), (1, 20, 0)], "map_id int, cx int, cz int")
    nodes, edges = cluster_graph.cluster_graph(samples, centres, valid, ["life"], 2, 1)
    assert {(r.node_id, r.occupation) for r in nodes.collect()} == {(0, 3), (1, 2)} and [tuple(r) for r in edges.collect()] == [(1, 0, 1, 3)]
    table = cluster_graph.compared({"a": (nodes, edges), "b": (nodes, edges.limit(0))})
    assert {tuple(r) for r in table.collect()} == {("a", 1, 2, 1, 3), ("b", 1, 2, 0, 0)}
    with pytest.raises(IndexError):
        cluster_graph.compared({})
