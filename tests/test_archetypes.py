import math

import pytest

from matchspark.operators import archetypes

SCHEMA = "map_id int, island_id int, area long, wide int, deep int, aspect double, fill double, convexity double, rugosity double, holes long, circle_residual double, ellipse_residual double, tilt double, turned_fill double, half_turn boolean, flush double, cuts long, coverage double, corners string, min_side double"
PLAIN = {"area": 100, "wide": 14, "deep": 12, "aspect": 1.1667, "fill": 0.6, "convexity": 0.8, "rugosity": 1.15, "holes": 0, "circle_residual": 0.2, "ellipse_residual": 0.2, "tilt": 5.0, "turned_fill": None, "half_turn": False, "flush": 0.3, "cuts": 0, "coverage": 0.0, "corners": "", "min_side": 0.0}
NONE = {"junctions": None, "endpoints": None, "topology": None, "min_arm_angle": None}
ALL = "BL,BR,TL,TR"
#: What differs from PLAIN, the skeleton, and the type.
CASES = [
    ({}, {}, "amoeba"),
    ({"fill": 1.0, "convexity": 1.0}, {}, "rectangle"),
    ({"cuts": 4, "corners": ALL, "coverage": 0.99, "min_side": 0.6}, {}, "rectangle"),
    ({"cuts": 4, "corners": ALL, "coverage": 0.99, "min_side": 0.59}, {}, "amoeba"),
    ({"fill": 0.95, "convexity": 0.95}, {}, "rectangle"),
    ({"fill": 0.95, "convexity": 0.95, "holes": 1, "rugosity": 1.3}, {}, "amoeba_rugged"),
    ({"tilt": 45.0, "turned_fill": 0.92}, {}, "rectangle_staircase"),
    ({"tilt": 45.0, "turned_fill": 0.91}, {}, "amoeba"),
    ({"fill": 0.88, "convexity": 0.88, "rugosity": 1.08}, {}, "rectangle_noisy"),
    ({"fill": 0.88, "convexity": 0.88, "rugosity": 1.13}, {"junctions": 2, "endpoints": 0}, "amoeba"),
    ({"holes": 1, "convexity": 0.92, "rugosity": 1.1}, {}, "ring"),
    ({"holes": 1, "convexity": 0.92, "rugosity": 1.1, "area": 29}, {}, "amoeba"),
    ({"holes": 1, "convexity": 0.85, "rugosity": 1.25}, {}, "ring_rugged"),
    ({"convexity": 0.88, "half_turn": True, "circle_residual": 0.11, "rugosity": 1.0}, {}, "circle"),
    ({"convexity": 0.88, "half_turn": True, "circle_residual": 0.11, "rugosity": 1.05}, {}, "circle_rugged"),
    ({"convexity": 0.88, "half_turn": True, "aspect": 1.5, "ellipse_residual": 0.09, "fill": 0.72, "rugosity": 1.0}, {}, "circle"),
    ({"convexity": 0.88, "half_turn": True, "circle_residual": 0.12}, {}, "amoeba"),
    ({"cuts": 1, "coverage": 0.9, "corners": "TL"}, {}, "L"),
    ({"cuts": 2, "coverage": 0.9, "corners": "BR,TL"}, {}, "Z"),
    ({"cuts": 2, "coverage": 0.9, "corners": "TL,TR"}, {}, "T"),
    ({"cuts": 1, "coverage": 0.7, "corners": "TL"}, {}, "L_noisy"),
    ({"cuts": 2, "coverage": 0.7, "corners": "BL,TR"}, {}, "Z_noisy"),
    ({"cuts": 2, "coverage": 0.7, "corners": "BR,TR"}, {}, "T_noisy"),
    ({"cuts": 1, "coverage": 0.7, "corners": "TL", "convexity": 0.59}, {}, "amoeba"),
    ({"cuts": 1, "coverage": 0.7, "corners": "TL"}, {"junctions": 2, "endpoints": 0}, "amoeba"),
    ({"convexity": 0.87}, {"topology": "line"}, "shard"),
    ({"convexity": 0.87, "fill": 0.85}, {"topology": "line"}, "amoeba"),
    ({"convexity": 0.87, "aspect": 1.3, "fill": 0.71, "ellipse_residual": 0.05}, {"topology": "line"}, "shard"),
    ({"flush": 0.8, "fill": 0.65, "convexity": 0.82, "rugosity": 1.12}, {}, "rectangle_chopped"),
    ({"holes": 2}, {}, "maze"),
    ({"holes": 2, "rugosity": 1.2}, {}, "maze_rugged"),
    ({}, {"junctions": 1, "endpoints": 4, "min_arm_angle": 60.0}, "plus"),
    ({}, {"junctions": 1, "endpoints": 4, "min_arm_angle": 59.9}, "amoeba"),
    ({"convexity": 0.79}, {"junctions": 1, "endpoints": 3}, "fork"),
    ({"convexity": 0.69}, {"junctions": 2, "endpoints": 2}, "fork"),
    ({"convexity": 0.89, "rugosity": 1.3}, {"junctions": 2, "endpoints": 3}, "fork"),
    ({"convexity": 0.9, "rugosity": 1.3}, {"junctions": 2, "endpoints": 3}, "amoeba_rugged"),
    ({"aspect": 2.5}, {}, "linear"),
]


def test_rules_on_both_sides_of_their_thresholds(spark):
    features = spark.createDataFrame([(1, n, *(PLAIN | f).values()) for n, (f, _, _) in enumerate(CASES)], SCHEMA)
    skeletons = spark.createDataFrame([(1, n, *(NONE | s).values()) for n, (_, s, _) in enumerate(CASES) if s], "map_id int, island_id int, junctions int, endpoints int, topology string, min_arm_angle double")
    got = {r.island_id: r.island_type for r in archetypes.archetypes(features, skeletons).collect()}
    assert [got[n] for n in range(len(CASES))] == [kind for _, _, kind in CASES]


def drawn(text):
    return [(x, z) for z, line in enumerate(text.split()) for x, sign in enumerate(line) if sign == "#"]


DISC = [(x, z) for x in range(16) for z in range(16) if (x - 7.5) ** 2 + (z - 7.5) ** 2 <= 62]
RING = [(x, z) for x in range(8) for z in range(8) if not (2 <= x <= 5 and 2 <= z <= 5)]
SHAPES = {
    "square": (drawn("#### #### #### ####"), "rectangle"),
    "L": (drawn("####.. ####.. ###### ######"), "L"),
    "Z": (drawn("####.. ####.. ..#### ..####"), "Z"),
    "T": (drawn(".####. .####. ###### ######"), "T"),
    "ring": (RING, "ring"),
    "disc": (DISC, "circle"),
    "maze": (drawn("####### #.###.# ####### #######"), "maze"),
    "bar": (drawn("########## #########. #.#.#.#.#."), "amoeba_rugged"),
}


def test_figures_and_types_of_drawn_shapes(spark):
    cells = spark.createDataFrame([(1, n, x + 100 * n, z - 7) for n, (shape, _) in enumerate(SHAPES.values()) for x, z in shape], "map_id int, island_id int, x int, z int")
    found = {list(SHAPES)[r.island_id]: r for r in archetypes.archetypes(archetypes.island_features(cells)).collect()}
    assert {name: r.island_type for name, r in found.items()} == {name: kind for name, (_, kind) in SHAPES.items()}
    square, ell, ring, disc = (found[n] for n in ("square", "L", "ring", "disc"))
    assert (square.is_square, square.fill, square.rugosity, square.half_turn, square.flush) == (True, 1.0, 1.0, True, 1.0)
    assert square.circle_residual == 0 and square.ellipse_residual == 0  # four corners lie on a circle
    assert (ell.cuts, ell.coverage, ell.corners, ell.convexity) == (1, 1.0, "TR", round(20 / 22, 4)) and not ell.is_square
    assert (found["Z"].corners, found["T"].corners) == ("BL,TR", "TL,TR")
    assert (ring.holes, ring.convexity, ring.fill, ring.rugosity) == (1, 1.0, 0.75, 1.0)
    assert disc.half_turn and disc.circle_residual < 0.12 and disc.cuts == 0 and found["maze"].holes == 2


def test_tilted_rectangle_and_touching_corners(spark):
    tilted = [(x, z) for x in range(-40, 40) for z in range(-40, 40) if abs(x + z) <= 40 and abs(x - z) <= 12]
    cells = spark.createDataFrame([(1, 0, x, z) for x, z in tilted] + [(1, 1, 0, 0), (1, 1, 1, 1)], "map_id int, island_id int, x int, z int")
    rows = {r.island_id: r for r in archetypes.archetypes(archetypes.island_features(cells)).collect()}
    assert rows[0].island_type == "rectangle_staircase" and math.isclose(rows[0].tilt, 45, abs_tol=0.1) and rows[0].turned_fill >= 0.92
    assert rows[1].rugosity == 1.0 and rows[1].area == 2 and rows[1].convexity == pytest.approx(2 / 3, abs=1e-4)


def test_skeleton_topologies(spark):
    star = [("junction", 0, 0)] + [("endpoint", x, z) for x, z in ((9, 0), (0, 9), (-9, 0), (0, -9))]
    kinds = {1: (star, 4), 2: ([("endpoint", 0, 0), ("endpoint", 5, 0)], 1), 3: ([("path", 0, 0)], 0), 4: (star, 6), 5: ([("junction", 0, 0), ("endpoint", 5, 0), ("endpoint", 5, 5)], 2)}
    nodes = spark.createDataFrame([(1, i, kind, x, z) for i, (rows, _) in kinds.items() for kind, x, z in rows], "map_id int, island_id int, kind string, x int, z int")
    edges = spark.createDataFrame([(1, i) for i, (_, n) in kinds.items() for _ in range(n)], "map_id int, island_id int")
    features = archetypes.skeleton_features(nodes, edges)
    got = {r.island_id: (r.topology, r.min_arm_angle) for r in features.collect()}
    assert got == {1: ("tree", 90.0), 2: ("line", None), 3: ("none", None), 4: ("mesh", 90.0), 5: ("tree", 45.0)}
    assert tuple(archetypes.skeleton_totals(features, nodes).first()) == (1, 16, 13, 12, 3)
    assert archetypes.island_features(spark.createDataFrame([], "map_id int, island_id int, x int, z int")).count() == 0
