import pytest

from matchspark.operators import structures


def height_cells(spark, height, key=1):
    """A field of cells 5 blocks wide with this height."""
    rows = [(key, 5 * x, 5 * z, 20, float(height(5 * x, 5 * z)), 90) for x in range(12) for z in range(4)]
    return spark.createDataFrame(rows, "map_id int, cx int, cz int, n long, h double, cap long")


def test_slopes_of_a_plane_a_line_and_a_lone_cell(spark):
    plane = {(r.cx, r.cz): r for r in structures.local_slopes(height_cells(spark, lambda x, z: 0.3 * x + 0.4 * z), "map_id", 5).collect()}
    assert all(r.gradient == pytest.approx(0.5) and r.residual == pytest.approx(0, abs=1e-6) for k, r in plane.items() if 0 < k[0] < 55)
    line = spark.createDataFrame([(1, 4 * k, 4 * k, 20, 2.0 * k, 90) for k in range(7)] + [(1, 400, 0, 20, 5.0, 90)], "map_id int, cx int, cz int, n long, h double, cap long")
    got = {r.cx: (r.gradient, r.residual) for r in structures.local_slopes(line, "map_id", 4, 20).collect()}
    assert got[12][0] == pytest.approx(2 / (4 * 2**0.5)) and got[12][1] == pytest.approx(0, abs=1e-6) and got[400] == (0.0, 9.0)


def test_runs_of_a_stair_and_a_wall(spark):
    cells = structures.local_slopes(height_cells(spark, lambda x, z: 5 + 0.6 * x), "map_id", 5)
    ramps = structures.ramp_cells(cells, "map_id", 5)
    (run,) = structures.ramp_runs(ramps, "map_id").collect()
    assert run.cells == 44 and run.length == pytest.approx(55) and run.width == pytest.approx(15) and run.samples == 880 and run.g_long == pytest.approx(0.6) and run.ratio == pytest.approx(30)
    assert structures.ramp_cells(structures.local_slopes(height_cells(spark, lambda x, z: 40), "map_id", 5), "map_id", 5).count() == 0


def test_standing_cells_need_enough_cells_and_a_height(spark):
    rows = [(1, 0, 0, 5.0)] * 3 + [(1, 5, 0, None)] * 3 + [(1, 10, 0, 1.0)] * 3 + [(2, 0, 0, 9.0)]
    samples = spark.createDataFrame(rows, "map_id int, cx int, cz int, rel double")
    assert [tuple(r) for r in structures.standing_cells(samples, "map_id", 3, 2, 1).collect()] == [(1, 0, 0, 3, 5.0, 5)]
    assert structures.standing_cells(samples, "map_id", 3, 2, 2).count() == 0


def test_owner_role_and_sweep(spark):
    runs = spark.createDataFrame([(1, 7, 8, 500, 0.0, 0.0, 4.0, 20.0, 6.0, 0.1, 0.1, 1.0), (1, 8, 9, 400, 50.0, 0.0, 9.0, 20.0, 6.0, 0.6, 0.1, 6.0), (1, 9, 9, 300, 90.0, 0.0, 9.0, 5.0, 6.0, 0.6, 0.1, 1.0)],
                                 "map_id int, run long, cells long, samples long, x double, z double, rise double, length double, width double, g_long double, g_across double, ratio double")
    cells = spark.createDataFrame([(1, 7, 0, 0), (1, 8, 50, 0), (1, 9, 90, 0)], "map_id int, run long, cx int, cz int")
    samples = spark.createDataFrame([(1, 0, 0, "red", 1)] * 3 + [(1, 0, 0, "blue", 2)] + [(1, 50, 0, "blue", None)] * 4 + [(1, 90, 0, "blue", 1)] * 4, "map_id int, cx int, cz int, team string, held_item int")
    rooms = spark.createDataFrame([(1, 4, 10.0, 12.0, -1.0, 1.0), (1, 5, 300.0, 310.0, 0.0, 9.0)], "map_id int, wool_id int, min_x double, max_x double, min_z double, max_z double")
    spawns = spark.createDataFrame([(1, "blue", 60.0, 70.0, 0.0, 1.0), (1, "red", -300.0, -290.0, 0.0, 1.0)], "map_id int, spawn_team string, min_x double, max_x double, min_z double, max_z double")
    attackers = spark.createDataFrame([(1, 4, "blue")], "map_id int, wool_id int, attacker string")
    found = structures.structures(runs, cells, samples, rooms, spawns, attackers, "map_id", 1, [2], least=4)
    got = {r.run: (r.kind, r.wool_id, r.room_distance, r.owner, r.owner_share, r.bow, r.detail, r.role, r.spawn_team, r.spawn_distance) for r in found.collect()}
    assert got == {7: ("wall", 4, 10.0, "red", 0.75, 0.75, 0.25, "defender", "blue", 60.0), 8: ("stair", 4, 38.0, "blue", 1.0, 0.0, 0.0, "attacker", "blue", 10.0)}
    assert tuple(structures.structure_sweep(found).first()) == (1, 1, 10.0, 1, 1, 0.6)
    assert tuple(structures.structure_sweep(found.limit(0)).first()) == (0, 0, None, 0, 0, None)
