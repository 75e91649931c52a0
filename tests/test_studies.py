import pytest
from pyspark.sql import functions as F

from matchspark.functions import scalars
from matchspark.operators import spatial, studies
from matchspark.sources import map_rules

LIVES = "k int, positions int, span double, nodes int, tortuosity double, kills int, touched boolean, high_share double, bow_share double, builder_share double, enemy_min double, home_mean double"


def test_representatives_give_way_in_turn(spark):
    rows = [
        (1, 9, 90.0, 20, 3.0, 9, False, 0.9, 0.9, 0.0, 1.0, 1.0),  # nearest to the enemy, longest, most winding
        (2, 9, 50.0, 3, 1.0, 8, False, 0.8, 0.8, 0.0, 9.0, 2.0),  # then the defender
        (3, 9, 10.0, 3, 1.0, 7, True, 0.7, 0.7, 0.0, 9.0, 0.5),  # touched; the most kills of the rest
        (4, 9, 30.0, 3, 1.0, 0, False, 0.6, 0.6, 0.0, None, None),
        (5, 9, 10.0, 3, 1.0, 0, False, 0.0, 0.5, 0.05, None, None),
        (6, 2, 10.0, 3, 1.0, 99, False, 1.0, 1.0, 1.0, None, None),  # too few samples
    ]
    got = {r.category: (r.k, r.metric) for r in studies.representatives(spark.createDataFrame(rows, LIVES), "k").collect()}
    roamer = got.pop("roamer")
    assert roamer[0] == 1 and roamer[1] == pytest.approx(9.133567)
    assert got == {"deep_attacker": (1, -1.0), "defender": (2, -2.0), "traversal": (1, 90.0), "high_killer": (3, 7.0), "skybridge": (4, 0.6), "bow_archer": (5, 0.5)}
    assert studies.representatives(spark.createDataFrame([], LIVES), "k").count() == 0


def test_defence_pick_and_ties(spark):
    rows = spark.createDataFrame([(2, 9, 10.0, 3, 0.5), (1, 9, 10.0, 3, 0.9), (3, 9, 10.0, None, 0.4), (4, 9, 99.0, 0, 1.0)], "k int, positions int, wool_distance double, min_y_near int, trap_share double")
    assert {tuple(r) for r in studies.defence_representatives(rows, "k").collect()} == {("early_digger", 1, -3.0), ("early_builder", 2, 0.5)}


def test_overview_of_a_match_without_walls(spark):
    rows = spark.createDataFrame([(1, 7, 3, 10.0, "dig"), (1, 7, 40, 14.0, "guard"), (2, 8, 9, 14.9, "trap"), (2, 8, 99, 15.0, "wall")], "match_id int, player_id int, y int, wool_distance double, activity string")
    got = {tuple(r) for r in studies.defence_overview(rows, ["match_id"]).collect()}
    assert got == {(1, 2, 1, 3, None, 10, 1, 0, 1, 0, 0), (2, 2, 1, None, 9, 15, 0, 1, 0, 1, 0)}


def test_names_of_other_scripts_lose_what_has_no_letter(spark):
    names = {"Fairy Tales 2: A Tale or Two": "fairy_tales_2_a_tale_or_two", "Feel Good Inc.": "feel_good_inc", "Čeněk  Žluť": "cenek_zlut", "ﬁne ½": "fine_12", "漢字": "", "_a__b_": "a_b"}
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    assert {r.name: r.slug for r in rows.withColumn("slug", scalars.normal_name(F.col("name"))).collect()} == {**names, None: None}


def test_structures_deaths_and_respawns(spark):
    row = spark.range(1)
    kind = lambda *x: scalars.structure_class(*(F.lit(float(v)) for v in x))
    ends = [(F.lit("island"), 3, 3), (F.lit("island"), 4, 3), (F.lit("island"), 4, None), (F.lit("build_region"), None, 3), (F.lit(None).cast("string"), None, 3)]
    got = row.select(kind(0.45, 2.5, 14, 1, 99), kind(0.45, 2.5, 15, 1, 99), kind(0.35, 1.9, 12, 8, 25), kind(0.35, 2.0, 12, 8, 25), *(scalars.death_region(a, F.lit(b).cast("int"), F.lit(c).cast("int")) for a, b, c in ends)).first()
    assert list(got) == ["stair", None, "wall", None, "home_island", "enemy_island", "enemy_island", "bridge", "void"]


def test_grid_frames_of_whole_and_half_middles(spark):
    maps = spark.createDataFrame([(1, 10.0, -4.0), (2, 10.5, -4.5), (3, 10.5, 3.0)], "map_id int, x double, z double")
    assert {tuple(r) for r in spatial.grid_frame(maps, 4).collect()} == {(1, 4, 10, -4), (2, 5, 8, -7), (3, 5, 8, 3)}
    assert {tuple(r) for r in spatial.grid_frame(maps, 5).where("map_id = 1").collect()} == {(1, 5, 10, -4)}
    islands = spark.createDataFrame([(1, 0, "maze"), (1, 1, "L"), (1, 2, None)], "map_id int, island_id int, archetype string")
    grids = spark.createDataFrame([(1, 5)], "map_id int, grid_size int")
    assert {(r.island_id, r.grid_size) for r in spatial.island_grids(islands, grids).collect()} == {(0, 2), (1, 5), (2, 5)}


RULES = """<map slug="m1"><teams><team id="red" color="dark red" max="12"/><team id="blue" color="blue"/></teams>
<wools><wool team="red" color="lime" location="1.5,9,-3"/></wools>
<spawns><spawn team="red" kit="main"/><spawn team="blue" kit="main"/><spawn team="red" kit="main"/></spawns>
<regions><cuboid id="base" min="5,0,7" max="-5,oo,oo"/></regions>
<kits><kit id="main"><item slot="0" material="log" amount="64"/><item slot="1"/><armor slot="helmet" material="leather" team-color="true"/></kit><kit id="spare"><item slot="0" material="bow" damage="3" unbreakable="true"/></kit></kits></map>"""


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RULES)
    rules = map_rules.read_rules(spark, str(tmp_path))
    assert {tuple(r) for r in map_rules.teams(rules).collect()} == {("m1", "red", "dark red", 12), ("m1", "blue", "blue", None)}
    assert [tuple(r) for r in map_rules.wools(rules).collect()] == [("m1", "red", "lime", 1.5, 9.0, -3.0)]
    assert [tuple(r) for r in map_rules.regions(rules).collect()] == [("m1", "base", -5.0, 5.0, 7.0, 7.0)]
    items = {tuple(r)[1:9] for r in map_rules.kit_rows(rules).collect()}
    assert items == {("main", "red", "0", "log", 64, 0, False, False), ("main", "blue", "0", "log", 64, 0, False, False), ("spare", "", "0", "bow", 1, 3, True, False)}
    armour = map_rules.kit_rows(rules, "armor")
    assert {(r.team, r.slot, r.team_colour) for r in armour.collect()} == {("red", "helmet", True), ("blue", "helmet", True)}
    assert map_rules.known_maps(armour, spark.createDataFrame([("m2", 4)], "map_slug string, map_id int")).count() == 0


def test_lives_of_late_matches_are_picked(spark):
    from matchspark.plans import route_queries
    from matchspark.plans.inputs import Inputs

    early, late = Inputs(spark, "/root/testdata/sf0.001"), Inputs(spark, "/root/testdata/sf0.001")
    late.log = early.log.withColumn("match_id", F.col("match_id") + 20_000).withColumn("player_id", F.col("player_id") + 4_000_000)
    for pick in (route_queries.t4_representatives, route_queries.t5_defence_representatives):
        assert {(r.category, r.k + 24_000_000_000, r.metric) for r in pick(early).collect()} == {tuple(r) for r in pick(late).collect()}


def test_names_of_a_batch_of_long_texts_hold_little_memory():
    import subprocess
    import sys

    code = "import resource, pyarrow as pa; from matchspark.functions import scalars; used = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; rows = pa.array(['\u00e9' + '\u6f22a' * 5000] * 5000); before = used(); assert scalars.ascii_of(rows)[4999].as_py() == 'e' + 'a' * 5000; print((used() - before) * 1024 / rows.nbytes)"
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 1
