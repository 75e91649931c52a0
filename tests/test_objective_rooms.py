from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from matchspark.functions import scalars
from matchspark.operators import objective_rooms as rooms
from matchspark.operators import points_of_interest as points
from matchspark.operators.spatial import held_by, smallest_region

BOX = "map_id int, region_id string, min_x double, max_x double, min_z double, max_z double"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def test_rectangles_hold_points_over_bucket_edges(spark):
    inf = float("inf")
    rects = [(1, "all", -1000.0, 1000.0, -1000.0, 1000.0), (1, "line", 5.0, 5.0, -3.0, 3.0), (1, "small", -1.0, 6.0, -1.0, 6.0), (1, "twin", -1.0, 6.0, -1.0, 6.0), (1, "endless", -inf, inf, 0.0, 1.0), (2, "other", 0.0, 9.0, 0.0, 9.0)]
    pts = [(1, i, float(x), float(z)) for i, (x, z) in enumerate([(5, 0), (-1, 6), (7, 0), (1000, -1000), (1001, 0)])]
    rows = spark.createDataFrame(pts, "map_id int, point_id int, x double, z double")
    got = {(r.point_id, r.region_id) for r in held_by(rows, boxes(spark, rects)).collect()}
    want = {(i, n) for _, i, x, z in pts for m, n, a, b, c, d in rects if m == 1 and n != "endless" and a <= x <= b and c <= z <= d}
    assert got == want
    assert {(r.point_id, r.region_id) for r in smallest_region(rows, boxes(spark, rects)).collect()} == {(0, "line"), (1, "small"), (2, "all"), (3, "all")}


def room_case(spark):
    regions = boxes(spark, [(1, "room-a", 0.0, 10.0, 0.0, 10.0), (1, "room-b", 20.0, 30.0, 0.0, 10.0), (1, "hall", -50.0, 50.0, -50.0, 50.0)])
    wools = spark.createDataFrame([(1, 0, 7, 4, 500.0, 0.0), (1, 1, 8, 5, 25.0, 5.0), (1, 2, 9, 5, 25.04, 5.0), (1, 3, None, 6, 400.0, 400.0), (1, 4, 3, 2, 5.0, 5.0)], "map_id int, idx int, wool_id int, damage int, x double, z double")
    spawners = spark.createDataFrame([(1, 5, "late", 4), (1, 2, "room-b", 4), (1, 1, "", 4)], "map_id int, idx int, region_id string, damage int")
    chests = spark.createDataFrame([(1, 0, 999.0, 0.0, 2), (1, 1, 3.0, 3.0, 2), (1, 2, 25.0, 3.0, 2), (1, 3, 3.0, 3.0, 4)], "map_id int, idx int, x double, z double, damage int")
    return wools, regions, spawners, chests


def test_rooms_in_three_passes(spark):
    wools, regions, spawners, chests = room_case(spark)
    found = rooms.room_regions(wools, regions, spawners, chests)
    got = {r.idx: (r.region_id, r.found_by) for r in found.collect()}
    assert got == {0: ("room-b", "spawner"), 1: ("room-b", "location"), 2: ("room-b", "shared"), 3: (None, None), 4: ("room-a", "chest")}
    assert {(r.wool_id, r.min_x, r.max_x) for r in rooms.room_rectangles(found, regions).collect()} == {(7, 20.0, 30.0), (8, 20.0, 30.0), (9, 20.0, 30.0), (3, 0.0, 10.0)}
    turned = boxes(spark, [(1, "room-a", 10.0, 0.0, 9.0, 1.0)])
    assert {tuple(r) for r in rooms.room_rectangles(found, turned).collect()} == {(1, 3, 0.0, 10.0, 1.0, 9.0)}


def test_contents_and_respawns(spark):
    wools, regions, spawners, chests = room_case(spark)
    coloured = lambda rows: spark.createDataFrame(rows, "map_id int, x double, z double, colour string")
    mobs = spark.createDataFrame([(1, 4.0, 9, 4.0), (1, 5.0, 9, 5.0), (2, 1.0, 1, 1.0)], "map_id int, x double, y int, z double")
    entities = spark.createDataFrame([(1, 4.0, 9, 4.0, True), (1, 5.0, 9, 5.0, False)], "map_id int, x double, y int, z double, spawns_wool boolean")
    known = rooms.wool_spawners(mobs, entities)
    assert {tuple(r) for r in known.collect()} == {(1, 4.0, 9, 4.0), (2, 1.0, 1, 1.0)}
    blocks = coloured([(1, 25.0, 5.0, "red"), (1, 26.0, 5.0, "red"), (1, 5.0, 5.0, "blue")])
    renewables = boxes(spark, [(1, "r", 20.0, 25.0, 0.0, 9.0), (1, "again", 24.0, 25.0, 0.0, 9.0)])
    held = rooms.wool_in_rooms(regions, coloured([(1, 21.0, 1.0, "lime"), (1, 21.0, 1.0, "lime")]), blocks, known, renewables)
    got = {r.region_id: (r.chest_wool, r.block_wool, r.mob_spawners, r.colours) for r in held.collect()}
    assert got == {"room-a": (0, 0, 1, []), "room-b": (2, 1, 0, ["lime", "red"]), "hall": (2, 1, 1, ["lime", "red"])}
    none = rooms.wool_in_rooms(regions, coloured([]), blocks, known, renewables.limit(0))
    assert {r.block_wool for r in none.collect()} == {0}
    found = rooms.room_regions(wools, regions, spawners, chests)
    back = {r.idx: (r.spawner_idx, r.respawn) for r in rooms.wool_respawns(found, spawners.where("idx = 5"), held).collect()}
    assert back == {0: (5, "pgm_spawner"), 1: (None, "renewable"), 2: (None, "renewable"), 3: (None, "unknown"), 4: (None, "mob_spawner")}


def test_team_names_in_order_of_rules(spark):
    teams = spark.createDataFrame([(1, 0, "red", "blue", "Crimson"), (1, 1, "blue-team", "azure", None), (1, 2, "x", "gold", "")], "map_id int, ord int, team string, colour string, name string")
    ids = {"BLUE-TEAM-spawn": "blue-team", "blue-spawn": "red", "azure": "blue-team", "crimson-a": "red", "none": None, "golden": "x"}
    regions = spark.createDataFrame([(1, n) for n in ids] + [(2, "red")], "map_id int, region_id string")
    assert {r.region_id: r.team for r in points.teams_of_regions(regions, teams).where("map_id = 1").collect()} == ids
    assert points.teams_of_regions(regions, teams).where("map_id = 2").first().team is None


def test_spawn_points_inline_first(spark):
    teams = spark.createDataFrame([(m, 0, "red", "red", "Red") for m in (1, 2)], "map_id int, ord int, team string, colour string, name string")
    own = spark.createDataFrame([(1, "red", 0.0, 2.0, 0.0, 4.0), (1, None, 9.0, 9.0, 9.0, 9.0), (2, "red", None, None, None, None)], "map_id int, team string, min_x double, max_x double, min_z double, max_z double")
    regions = spark.createDataFrame([(m, n, k, 2.0, 4.0, 0.0, 0.0) for m in (1, 2) for n, k in (("red-SPAWN", "cuboid"), ("not-spawn", "cuboid"), ("obs-spawn", "cuboid"), ("wool-spawn", "cuboid"), ("spawns", "union"), ("mid", "cuboid"))], BOX.replace("min_x", "kind string, min_x", 1))
    got = {tuple(r) for r in points.spawn_points(own, regions, teams).select("map_id", "region_id", "x", "z", "team", "team_colour").collect()}
    assert got == {(1, "red-spawn (inline)", 1.0, 2.0, "red", "red"), (2, "red-SPAWN", 3.0, 0.0, "red", "red")}
    table = points.spawn_table(points.spawn_points(own, regions, teams), spark.createDataFrame([(1,)], "map_id int"))
    assert [(r.map_id, r.spawn_idx) for r in table.collect()] == [(1, 0)]


def test_binomial_tails_equal_exact_fractions(spark):
    cases = [(t, n) for n in (0, 1, 7, 40, 1000) for t in sorted({0, n // 2, n // 2 + 1, n - 1, n, n + 1}) if t >= 0] + [(650, 1000), (900, 1000)]
    rows = spark.createDataFrame(cases, "top int, n int").withColumn("tail", scalars.binomial_tails(F.col("top"), F.col("n")))
    for top, n, tail in rows.collect():
        exact = float(Fraction(2 * sum(comb(n, k) for k in range(top, n + 1)), 2**n))
        assert tail == pytest.approx(exact, rel=1e-9, abs=0)
