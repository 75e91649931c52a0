"""Operators on small literal inputs whose results follow from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from matchspark.functions import scalars
from matchspark.operators import blocks, chests, graph, intervals, matchstats, objectives, paths, sessions, shapes, spatial, trajectories

LOG = "match_id int, player_id int, row_id long, t int, event_type int, x int, y int, z int, victim_id int, wool_id int"


def log(spark, rows):
    """Events (player, t, type, x, y, z, wool) of match 1."""
    filled = [(1, p, n, t, k, *rest[:3], None, rest[3] if len(rest) > 3 else None) for n, (p, t, k, *rest) in enumerate(rows)]
    return spark.createDataFrame(filled, LOG)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_lives_of_one_player(spark):
    events = log(spark, [(7, 0, 2, 0, 0, 0), (7, 2, 5, 0, 0, 0), (7, 3, 3, 0, 0, 0), (7, 5, 4, 0, 0, 0), (7, 7, 5, 0, 0, 0), (7, 9, 2, 0, 0, 0), (7, 11, 6, 0, 0, 0, 1)])
    got = rows_of(sessions.life_segments(events), "start_timestamp", "end_timestamp", "outcome", "kill_count", "position_count", "wool_touches")
    assert got == [(0, 5, "death", 1, 2, 0), (9, 11, "match_end", 0, 0, 1)]
    inside = sessions.interval_lookup(events.where("event_type = 5"), sessions.closed_spans(events))
    assert rows_of(inside, "t", "segment_idx") == [(2, 0), (7, None)]


def test_waves_split_after_the_limit(spark):
    touches = log(spark, [(1, t, 6, 0, 0, 0, 3) for t in (0, 120, 241)])
    assert rows_of(sessions.wool_waves(touches), "wave_idx", "touches") == [(0, 2), (1, 1)]


def test_carry_chain_outcomes(spark):
    events = log(spark, [(1, 0, 5, 0, 30, 0), (1, 10, 6, 1, 2, 3, 0), (2, 20, 6, 4, 5, 6, 0), (2, 25, 4, 0, -3, 0), (1, 300, 6, 1, 1, 1, 0), (1, 320, 7, 9, 9, 9, 0), (3, 10, 6, 7, 7, 7, 1), (4, 10, 6, 7, 7, 7, 2), (4, 50, 4, 0, -1, 0)])
    teams = spark.createDataFrame([(1, 1, "red", 0, None), (1, 4, "blue", 11, None)], "match_id int, player_id int, team string, start_timestamp int, end_timestamp int")
    got = rows_of(sessions.carry_chains(events, teams), "wool_id", "wave_idx", "attacking_team", "n_carriers", "n_handoffs", "end_timestamp", "outcome", "final_x", "approach_type")
    assert got == [(0, 0, "red", 2, 1, 320, "captured", 9, "skybridge"), (0, 1, "red", 1, 0, 320, "captured", 9, None), (1, 0, None, 1, 0, 10, "incomplete", 7, None), (2, 0, None, 1, 0, 50, "dropped_void", 7, None)]


def test_interval_joins_by_their_right_end(spark):
    teams = spark.createDataFrame([(1, 1, 1, "a", 0, 10), (1, 1, 2, "b", 10, None)], "match_id int, player_id int, team_segment_id int, team string, start_timestamp int, end_timestamp int")
    events = log(spark, [(1, 10, 4, 0, 0, 0)])
    assert rows_of(intervals.with_team(events, teams, right_closed=True), "team") == [("a",), ("b",)]
    assert rows_of(intervals.with_team(events, teams), "team") == [("b",)]
    assert rows_of(intervals.team_at(events, teams), "team") == [("a",)]
    assert rows_of(intervals.team_at(log(spark, [(1, 99, 4, 0, 0, 0)]), teams.where("team = 'a'")), "team") == [("a",)]


def test_line_cells_equal_the_stepped_line(spark):
    rng = random.Random(2)
    pairs = [tuple(rng.randint(-9, 9) * 5 for _ in range(4)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a int, b int, c int, d int")
    got = df.select("a", "b", "c", "d", graph.line_cells(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 5).alias("line")).collect()

    def stepped(x, z, x1, z1):
        dx, dz, sx, sz = abs(x1 - x) // 5, abs(z1 - z) // 5, 5 if x1 > x else -5, 5 if z1 > z else -5
        out, err = [(x, z)], (dx if dx >= dz else dz) // 2
        while (x, z) != (x1, z1):
            if dx >= dz:
                x, err = x + sx, err - dz
                if err < 0:
                    z, err = z + sz, err + dx
            else:
                z, err = z + sz, err - dx
                if err < 0:
                    x, err = x + sx, err + dz
            out.append((x, z))
        return out

    for r in got:
        line = [(c["x"], c["z"]) for c in r["line"]]
        assert line[0] == (r.a, r.b) and line[-1] == (r.c, r.d) and line == stepped(r.a, r.b, r.c, r.d)


def test_paths_take_the_cheaper_way_and_the_lower_node(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 4, 1.0), (1, 1, 3, 1.0), (1, 3, 4, 1.0), (1, 1, 4, 5.0), (1, 8, 9, 1.0)], "g int, src long, dst long, weight double")
    pairs = spark.createDataFrame([(1, 1, 4), (1, 4, 4), (1, 1, 9)], "g int, source long, target long")
    assert rows_of(paths.shortest_paths(pairs, edges, "g"), "source", "target", "seq", "node") == [(1, 4, 0, 1), (1, 4, 1, 2), (1, 4, 2, 4), (4, 4, 0, 4)]
    sources = spark.createDataFrame([(1, 1), (1, 8)], "g int, node long")
    far = {(r.source, r.node): r.distance for r in paths.shortest_distances(sources, edges, "g", by_source=True, fold=1).collect()}
    assert far == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 1.0, (1, 4): 2.0, (8, 8): 0.0, (8, 9): 1.0}


SQUARE = [(x, z) for x in range(3) for z in range(3)]
SHAPES = {"L": [(0, 0), (0, 1), (0, 2), (1, 0)], "J": [(6, 5), (6, 6), (6, 7), (5, 5)], "S": [(1, 0), (2, 0), (0, 1), (1, 1)], "ring": [p for p in SQUARE if p != (1, 1)]}


def island(spark, **named):
    return spark.createDataFrame([(1, n, x, z) for n, cells in enumerate(named.values()) for x, z in cells], "map_id int, island_id int, x int, z int")


def test_islands_by_area_and_corners(spark):
    cells = spark.createDataFrame([(1, x, z) for x, z in [*SQUARE, (3, 3), (8, 8), (8, 9)]], "map_id int, x int, z int")
    assert rows_of(shapes.islands(cells, corners=True, least=2).groupBy("island_id").count(), "island_id", "count") == [(0, 10), (1, 2)]
    assert rows_of(shapes.islands(cells, corners=False, least=1).groupBy("island_id").count(), "island_id", "count") == [(0, 9), (1, 2), (2, 1)]
    assert shapes.islands(cells.limit(0)).count() == 0


def test_shapes_of_small_islands(spark):
    cells = island(spark, **SHAPES)
    keys = [r.canonical_key for r in shapes.canonical_keys(cells).orderBy("island_id").collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3
    plain = [r.canonical_key for r in shapes.canonical_keys(cells, mirror=False).orderBy("island_id").collect()]
    assert plain[0] != plain[1]
    figures = rows_of(shapes.island_figures(cells), "island_id", "area", "perimeter", "aspect", "center_x")
    assert figures[3] == (3, 8, 16, 1.0, 1.5) and figures[0][:4] == (0, 4, 10, 1.5)
    exact = {(r.island_id, r.symmetry) for r in shapes.symmetries(cells).where("exact").collect()}
    assert exact == {(2, "point")} | {(3, s) for s in shapes.SYMMETRIES}
    holes = rows_of(shapes.holes(cells, shapes.ISLAND, 1), "island_id", "area", "z", "x0", "x1")
    assert holes == [(3, 1, 1, 1, 1)] and shapes.holes(cells, shapes.ISLAND, 2).count() == 0


@pytest.mark.parametrize("box, want", [((0, 0, 0, 0), "single_block"), ((-1, 0, 0, 0), "2x1"), ((0, 0, -2, -1), "1x2"), ((-1, 0, 4, 7), "2x2")])
def test_centre_classes(spark, box, want):
    assert spark.range(1).select(shapes.centre_class(*map(F.lit, box)).alias("c")).first().c == want


def test_points_in_rings_with_holes(spark):
    ring = lambda *p: [{"x": float(x), "z": float(z)} for x, z in p]
    areas = spark.createDataFrame([
        (1, 3, "island", [ring((0, 0), (0, 6), (6, 6), (6, 0)), ring((2, 2), (2, 4), (4, 4), (4, 2))]), (1, 5, "island", [ring((5, 5), (5, 9), (9, 9), (9, 5))]), (1, 9, "build_region", [ring((-20, -20), (-20, 20), (20, 20), (20, -20))])],
        "map_id int, polygon_id int, kind string, rings array<array<struct<x:double,z:double>>>")
    points = spark.createDataFrame([(1, 0, 0), (1, 2, 2), (1, 5, 5), (1, 8, 8), (1, 30, 0), (1, 0, 0), (2, 0, 0)], "map_id int, x int, z int")
    got = rows_of(spatial.classify(points, areas), "map_id", "x", "location_type", "island_id")
    assert got == sorted([(1, 0, "island", 3)] * 2 + [(1, 2, "build_region", None), (1, 5, "island", 3), (1, 8, "island", 5), (1, 30, "void", None), (2, 0, "void", None)], key=str)


def test_nearest_nodes_equal_brute_force(spark):
    rng = random.Random(4)
    nodes = [(m, n, float(rng.randint(-90, 90)), float(rng.randint(-90, 90))) for m in (1, 2) for n in range(12)]
    cells = {(m, rng.randint(-100, 100), rng.randint(-100, 100)) for m in (1, 2, 3) for _ in range(60)}
    got = spatial.nearest_nodes(spark.createDataFrame(list(cells), "map_id int, x int, z int"), spark.createDataFrame(nodes, "map_id int, node_id long, x double, z double"), 3)
    want = set()
    for m, x, z in cells:
        best = sorted((((x - a) ** 2 + (z - b) ** 2) ** 0.5, n) for k, n, a, b in nodes if k == m)[:3]
        want |= {(m, x, z, r, n) for r, (_, n) in enumerate(best, 1)}
    assert {(r.map_id, r.x, r.z, r["rank"], r.node_id) for r in got.collect()} == want


def test_double_chests_equal_the_greedy_rule(spark):
    rng = random.Random(6)
    places = {(m, rng.randint(0, 7), rng.randint(0, 7), y) for m in (1, 2) for y in (3, 4) for _ in range(22)}
    got = {(r.map_id, r.x, r.z, r.y): (r.is_double, r.group_x, r.group_z) for r in chests.double_chests(spark.createDataFrame(list(places), "map_id int, x int, z int, y int")).collect()}
    named = {}
    for m, x, z, y in sorted(places):
        if (m, x, z, y) not in named:
            partner = next(((m, a, b, y) for a, b in ((x + 1, z), (x - 1, z), (x, z + 1), (x, z - 1)) if (m, a, b, y) in places), None)
            both = [(m, x, z, y), partner] if partner and partner not in named else [(m, x, z, y)]
            named |= {p: (len(both) == 2, x, z) for p in both}
    assert got == named


def test_chest_categories_by_priority(spark):
    rows = [(1, 1, "minecraft:wool", 14), (1, 2, "minecraft:wool", 3), (1, 3, "iron_helmet", 0), (1, 3, "minecraft:wool", 3), (1, 4, "sword", 0), (1, 4, "minecraft:bread", 0), (1, 4, "stone_pickaxe", 0), (1, 5, "minecraft:bow", 0), (1, 6, "322", 0), (1, 7, "planks", 0), (2, 8, "35", 3)]
    contents = spark.createDataFrame(rows, "map_id int, chest_id int, item_id string, item_damage int")
    all_ = spark.createDataFrame([(1, n) for n in range(1, 8)] + [(2, 8), (2, 9)], "map_id int, chest_id int")
    got = [r.content_category for r in chests.categories(contents, all_, spark.createDataFrame([(1, 14)], "map_id int, wool_id int")).orderBy("chest_id").collect()]
    assert got == ["wool", "defense", "combat", "kit", "weapon", "supply", "defense", "wool", "empty"]


def test_wool_locations_fall_back(spark):
    touches = spark.createDataFrame([(1, 0, 10, 10), (1, 0, 11, 10), (1, 0, 60, 60), (1, 1, 0, 0), (1, 1, 9, 9)], "map_id int, wool_id int, x int, z int")
    declared = spark.createDataFrame([(1, 0, 5, 5), (1, 2, 7, 8)], "map_id int, wool_id int, x int, z int")
    got = rows_of(objectives.wool_locations(touches, declared), "wool_id", "x", "z", "source", "first_touch_count")
    assert got == [(0, 10.5, 10.0, "touches", 2), (1, 4.5, 4.5, "touches", 2), (2, 7.0, 8.0, "declared", None)]


def test_names_and_durations(spark):
    names = spark.createDataFrame([("Fairy Tales 2: A Tale or Two",), ("Feel Good Inc.",), ("  Éa__b ",)], "n string")
    assert [r.s for r in names.select(scalars.normal_name(F.col("n")).alias("s")).collect()] == ["fairy_tales_2_a_tale_or_two", "feel_good_inc", "ea_b"]
    row = spark.range(1).select(scalars.short_duration(F.lit(4800)).alias("a"), scalars.short_duration(F.lit(2856)).alias("b"), matchstats.span_text(F.lit(3661)).alias("c"), scalars.base_name(F.lit("a\\b/c.x")).alias("d"), scalars.message_name(F.lit("**#12 - Some Map - 3m**")).alias("e")).first()
    assert tuple(row) == ("1h20m", "47m36s", "1h 1m 1s", "c.x", "Some Map")


def test_runs_climbs_and_shares(spark):
    events = log(spark, [(1, 0, 2, 0, 0, 0), *((1, t, 5, 0, y, 0) for t, y in ((1, 5), (2, 45), (3, 50), (4, 10), (200, 45)))])
    samples = trajectories.life_samples(events)
    assert rows_of(trajectories.climbs(samples), "t", "low_t") == [(2, 1)]
    runs = trajectories.runs(events.where("event_type = 5").withColumn("high", (F.col("y") > 40).cast("int")), sessions.PLAYER, "high")
    assert rows_of(runs, "run", "high", "ticks") == [(1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 1, 1)]


def test_runs_of_blocks_and_layers(spark):
    cells = spark.createDataFrame([(1, 0, y, 0, b) for y, b in ((0, 7), (1, 7), (2, 1), (5, 7), (6, 36))], "map_id int, x int, y int, z int, block_id int")
    assert rows_of(blocks.vertical_segments(cells), "y_start", "y_end") == [(0, 2), (5, 6)]
    assert rows_of(blocks.bedrock_ceiling(cells), "y", "bedrock_ceiling_y") == [(0, 1)]
    assert rows_of(blocks.top_surface(cells, 5), "y", "block_id") == [(5, 7)]


def test_carry_chain_takes_the_first_of_teams_that_start_at_once(spark):
    schema = "match_id int, player_id int, team_segment_id int, team string, start_timestamp int, end_timestamp int"
    for rows in ([(1, 1, 3, "red", 5, 5), (1, 1, 4, "blue", 5, None)], [(1, 1, 4, "red", 5, None), (1, 1, 3, "blue", 5, 5)]):
        got = sessions.carry_chains(log(spark, [(1, 5, 6, 0, 0, 0, 0)]), spark.createDataFrame(rows, schema))
        assert [r.attacking_team for r in got.collect()] == [min(rows, key=lambda r: r[2])[3]]


def test_attack_relations_straight_behind(spark):
    import duckdb

    centres = [(m, team, x, 0.0) for m, far in ((1, 10.0), (2, -10.0)) for team, x in (("red", 0.0), ("blue", far))]
    wools = [(1, 0, -5.0, 0.0), (2, 0, 5.0, 0.0), (1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0), (1, 2, -5.0, 1.0)]
    place = lambda rows, key, kind: spark.createDataFrame(rows, f"map_id int, {key} {kind}, x double, z double")
    owners = spark.createDataFrame([(m, w, "red") for m, w, *_ in wools], "map_id int, wool_id int, team string")
    got = {(r.map_id, r.wool_id): (round(r.angle, 6), r.side) for r in objectives.attack_relations(place(centres, "team", "string"), place(wools, "wool_id", "int"), owners).collect()}
    con = duckdb.connect()
    for m, w, x, z in wools:
        ux, turn, ahead = {1: 10.0, 2: -10.0}[m], "uz * vx - ux * vz", "ux * vx + uz * vz"
        want = con.execute(f"SELECT round(degrees(atan2({turn}, {ahead})), 6), CASE WHEN abs(degrees(atan2({turn}, {ahead}))) <= 5 THEN 'centre' WHEN {turn} > 0 THEN 'left' ELSE 'right' END FROM (SELECT CAST(? AS DOUBLE) AS ux, CAST(0 AS DOUBLE) AS uz, CAST(? AS DOUBLE) AS vx, CAST(? AS DOUBLE) AS vz) v", [ux, x, z]).fetchone()
        assert got[m, w] == want
