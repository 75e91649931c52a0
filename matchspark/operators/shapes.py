"""Islands and their shapes, from cells ``map_id, x, z``; rows of cells are handled as runs.

A run is a stretch of neighbouring x in one z; connected components link runs instead of
cells, so a map of a hundred thousand cells has some thousand nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.components import connected_components
from matchspark.session import cut

ISLAND = ["map_id", "island_id"]


def cell_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Runs ``keys, z, x0, x1, node``; ``node`` orders runs by their first cell (z, then x)."""
    rows = cells.select(*keys, "x", "z").distinct().withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy(*keys, "z").orderBy("x")))
    runs = rows.groupBy(*keys, "z", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")
    return runs.withColumn("node", F.struct("z", F.col("x0").alias("x")))


def linked_runs(runs: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Components of runs that touch in neighbouring rows: along a side (``reach`` 0) or a corner too (1)."""
    below = runs.select(*keys, (F.col("z") - 1).alias("z"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("node").alias("dst"))
    edges = runs.join(below, [*keys, "z"]).where((F.col("y0") <= F.col("x1") + reach) & (F.col("y1") >= F.col("x0") - reach))
    labels = connected_components(edges.select(*keys, F.col("node").alias("src"), "dst"), keys)
    return runs.join(labels, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def islands(cells: DataFrame, corners: bool = True, least: int = 10) -> DataFrame:
    """Cells ``map_id, x, z`` with ``island_id``: components of ``least`` cells, numbered by area, the largest first.

    Of equal areas the one whose first cell (by z, then x) is smaller comes first.
    """
    runs = cut(linked_runs(cut(cell_runs(cells, ["map_id"])), ["map_id"], int(corners)))
    sizes = runs.groupBy("map_id", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where(F.col("area") >= least)
    order = Window.partitionBy("map_id").orderBy(F.desc("area"), "component")
    numbered = sizes.withColumn("island_id", (F.row_number().over(order) - 1).cast("int"))
    kept = runs.join(numbered, ["map_id", "component"])
    return kept.select(*ISLAND, "z", F.explode(F.sequence("x0", "x1")).alias("x")).select(*ISLAND, "x", "z")


def bounds(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def empty_parts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The empty cells of each key's bounding box as runs ``keys, z, x0, x1, component, open``; parts meet along sides.

    ``open`` runs touch the box; a part without any is enclosed.
    """
    runs = cell_runs(cells, keys).drop("node")
    boxed = runs.join(bounds(cells, keys).drop("area"), keys)
    order = Window.partitionBy(*keys, "z").orderBy("x0")
    gaps = boxed.withColumn("next", F.lead("x0").over(order)).withColumn("first", F.row_number().over(order) == 1)
    before = gaps.where("first and x0 > min_x").select(*keys, "z", F.col("min_x").alias("x0"), (F.col("x0") - 1).alias("x1"), F.lit(True).alias("open"))
    after = gaps.where("x1 + 1 <= coalesce(next - 1, max_x)").select(*keys, "z", (F.col("x1") + 1).alias("x0"), F.coalesce(F.col("next") - 1, F.col("max_x")).alias("x1"), (F.col("next").isNull() | (F.col("z") == F.col("min_z")) | (F.col("z") == F.col("max_z"))).alias("open"))
    empty = before.unionByName(after)
    rows = boxed.select(*keys, "min_x", "max_x", "min_z", "max_z").distinct().withColumn("z", F.explode(F.sequence("min_z", "max_z")))
    bare = rows.join(runs.select(*keys, "z").distinct(), [*keys, "z"], "left_anti").select(*keys, "z", F.col("min_x").alias("x0"), F.col("max_x").alias("x1"), F.lit(True).alias("open"))
    empty = empty.unionByName(bare).withColumn("node", F.struct("z", F.col("x0").alias("x")))
    return cut(linked_runs(empty, keys, 0))


def holes(cells: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Enclosed empty cells of each key: ``keys, hole_id, x0, x1, z`` runs and the ``area`` of their hole.

    Empty means within the key's bounding box; a hole touches the box nowhere, and its
    cells meet along sides. Holes are numbered by their first cell.
    """
    labelled = empty_parts(cells, keys)
    closed = labelled.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.bool_or("open").alias("open")).where(~F.col("open") & (F.col("area") >= least))
    closed = closed.withColumn("hole_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("component")) - 1).cast("int"))
    return labelled.drop("open").join(closed.drop("open"), [*keys, "component"]).select(*keys, "hole_id", "area", "z", "x0", "x1")


def void_classes(holes_: DataFrame, cells: DataFrame) -> DataFrame:
    """Each hole of a map ``map_id, hole_id`` by the teams at its border: middle (none), encased (one), frontline (more).

    ``cells``: ``map_id, x, z, team`` (null: of no team).
    """
    spots = holes_.select("map_id", "hole_id", "z", F.explode(F.sequence("x0", "x1")).alias("x"))
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z")) for dx, dz in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    near = spots.select("map_id", "hole_id", F.explode(steps).alias("s")).select("map_id", "hole_id", "s.x", "s.z").distinct()
    teams = near.join(cells, ["map_id", "x", "z"]).groupBy("map_id", "hole_id").agg(F.count_distinct("team").alias("teams"))
    return teams.select("map_id", "hole_id", F.when(F.col("teams") == 0, "middle").when(F.col("teams") == 1, "encased").otherwise("frontline").alias("void_class"))


def island_figures(cells: DataFrame) -> DataFrame:
    """Area, box, centre, perimeter (exposed sides), aspect, fill, compactness, elongation of each island.

    Extents are of blocks, so a single block is 1 by 1 and its centre half a block in.
    """
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z")) for dx, dz in ((1, 0), (0, 1))))
    inner = cells.select(*ISLAND, F.explode(steps).alias("s")).select(*ISLAND, "s.x", "s.z").join(cells, [*ISLAND, "x", "z"], "left_semi").groupBy(*ISLAND).agg(F.count("*").alias("joints"))
    rows = cells.groupBy(*ISLAND).agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), (F.avg("x") + 0.5).alias("center_x"), (F.avg("z") + 0.5).alias("center_z"),
        F.var_pop("x").alias("vx"), F.var_pop("z").alias("vz"), F.covar_pop("x", "z").alias("vxz"))
    rows = rows.join(inner, ISLAND, "left")
    width, depth = F.col("max_x") - F.col("min_x") + 1, F.col("max_z") - F.col("min_z") + 1
    perimeter = 4 * F.col("area") - 2 * F.coalesce("joints", F.lit(0))
    mid, half = (F.col("vx") + F.col("vz")) / 2, F.hypot((F.col("vx") - F.col("vz")) / 2, F.col("vxz"))
    return rows.select(
        *ISLAND, "area", "min_x", "max_x", "min_z", "max_z", "center_x", "center_z", perimeter.alias("perimeter"), (F.greatest(width, depth) / F.least(width, depth)).alias("aspect"), (F.col("area") / (width * depth)).alias("fill"),
        (4 * F.pi() * F.col("area") / (perimeter * perimeter)).alias("compactness"), F.when(mid - half > 1e-9, F.sqrt((mid + half) / (mid - half))).alias("elongation"))


def map_figures(figures: DataFrame) -> DataFrame:
    """Islands of each map: number, total, largest, smallest, mean and median area, middle of centres, mean distance to it."""
    middle = figures.groupBy("map_id").agg(F.avg("center_x").alias("mx"), F.avg("center_z").alias("mz"))
    far = F.hypot(F.col("center_x") - F.col("mx"), F.col("center_z") - F.col("mz"))
    return figures.join(middle, "map_id").groupBy("map_id", "mx", "mz").agg(F.count("*").alias("islands"), F.sum("area").alias("total"), F.max("area").alias("largest"), F.min("area").alias("smallest"), F.avg("area").alias("mean_area"), F.median("area").alias("median_area"), F.avg(far).alias("mean_distance"))


def island_roles(figures: DataFrame, small: int = 50) -> DataFrame:
    """Role of each island: the two largest are ``spawn`` (from two islands on), the one nearest the middle ``center``.

    The middle is the mean of the centres; ties go to the lower id. An island may be both;
    ``spawn`` is told then, with ``is_center``. Others are ``small`` or ``peripheral``.
    """
    middle = figures.groupBy("map_id").agg(F.avg("center_x").alias("mx"), F.avg("center_z").alias("mz"), F.count("*").alias("n"))
    far = F.hypot(F.col("center_x") - F.col("mx"), F.col("center_z") - F.col("mz"))
    rows = figures.join(middle, "map_id").withColumn("far", F.round(far, 9))
    by_area, by_far = (F.row_number().over(Window.partitionBy("map_id").orderBy(o, "island_id")) for o in (F.desc("area"), F.asc("far")))
    rows = rows.withColumn("by_area", by_area).withColumn("by_far", by_far)
    role = F.when((F.col("n") >= 2) & (F.col("by_area") <= 2), "spawn").when(F.col("by_far") == 1, "center").when(F.col("area") < small, "small").otherwise("peripheral")
    return rows.select(*ISLAND, "area", role.alias("role"), (F.col("by_far") == 1).alias("is_center"))


#: The eight rotations and mirrorings of the square grid, as matrices (x from x, x from z, z from x, z from z).
D4 = [(1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0), (-1, 0, 0, 1), (0, 1, 1, 0), (1, 0, 0, -1), (0, -1, -1, 0)]


def transformed(cells: DataFrame, keys: list[str], matrices: list[tuple[int, int, int, int]] = D4) -> DataFrame:
    """The cells of each key under each matrix ``turn``, moved so that their least x and z are 0."""
    turns = F.array(*(F.struct(F.lit(n).alias("turn"), (a * F.col("x") + b * F.col("z")).alias("x"), (c * F.col("x") + d * F.col("z")).alias("z")) for n, (a, b, c, d) in enumerate(matrices)))
    moved = cells.select(*keys, F.explode(turns).alias("t")).select(*keys, "t.turn", "t.x", "t.z")
    corner = moved.groupBy(*keys, "turn").agg(F.min("x").alias("x0"), F.min("z").alias("z0"))
    return moved.join(corner, [*keys, "turn"]).select(*keys, "turn", (F.col("x") - F.col("x0")).alias("x"), (F.col("z") - F.col("z0")).alias("z"))


def canonical_keys(cells: DataFrame, mirror: bool = True) -> DataFrame:
    """``map_id, island_id, canonical_key``: equal for islands of one shape up to rotation (and mirroring).

    Of the transformed cells, sorted by x and z, the least list is hashed. A list is as
    long as one island.
    """
    turned = transformed(cells, ISLAND, D4 if mirror else D4[:4])
    lists = turned.groupBy(*ISLAND, "turn").agg(F.sort_array(F.collect_list(F.struct("x", "z"))).alias("cells"))
    least = lists.groupBy(*ISLAND).agg(F.min("cells").alias("cells"))
    text = F.array_join(F.transform("cells", lambda c: F.concat(c["x"].cast("string"), F.lit(","), c["z"].cast("string"))), ";")
    return least.select(*ISLAND, F.substring(F.sha2(text, 256), 1, 16).alias("canonical_key"))


def canonical_groups(keys: DataFrame) -> DataFrame:
    """Instances of each shape and the maps that hold it."""
    return keys.groupBy("canonical_key").agg(F.count("*").alias("instances"), F.count_distinct("map_id").alias("maps"))


SYMMETRIES = {"point": (-1, 0, 0, -1), "mirror_x": (-1, 0, 0, 1), "mirror_z": (1, 0, 0, -1), "diagonal": (0, 1, 1, 0), "rotation": (0, -1, 1, 0)}


def symmetries(cells: DataFrame, near: float = 0.03) -> DataFrame:
    """Share of each island's cells that a transform of its box moves out of the island, for each kind of symmetry.

    An island is symmetric where the share is 0 and nearly so up to ``near``; transforms
    that turn a box need a square one, else the share is 1.
    """
    boxes = bounds(cells, ISLAND)
    moved = transformed(cells, ISLAND, [(1, 0, 0, 1), *SYMMETRIES.values()])
    own = moved.where("turn = 0").drop("turn")
    hits = moved.where("turn > 0").join(own, [*ISLAND, "x", "z"], "left_semi").groupBy(*ISLAND, "turn").agg(F.count("*").alias("same"))
    kinds = boxes.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("turn"), F.lit(name).alias("symmetry")) for n, name in enumerate(SYMMETRIES, 1)))).alias("k")).select(*boxes.columns, "k.turn", "k.symmetry")
    rows = kinds.join(hits, [*ISLAND, "turn"], "left")
    square = (F.col("max_x") - F.col("min_x")) == (F.col("max_z") - F.col("min_z"))
    share = F.when(F.col("symmetry").isin("diagonal", "rotation") & ~square, 1.0).otherwise(1 - F.coalesce("same", F.lit(0)) / F.col("area"))
    return rows.withColumn("mismatch", share).select(*ISLAND, "symmetry", "mismatch", (F.col("mismatch") <= 1e-12).alias("exact"), (F.col("mismatch") <= near).alias("nearly"))


def map_symmetry(cells: DataFrame, names: tuple[str, ...] = ("point", "mirror_x", "mirror_z"), least: float = 0.6) -> DataFrame:
    """Symmetry of each whole map: overlap (shared cells over all cells) with its image about the middle of its box.

    The best kind of at least ``least`` is the map's; of equal overlaps the first name.
    """
    box = cells.groupBy("map_id").agg((F.min("x") + F.max("x")).alias("sx"), (F.min("z") + F.max("z")).alias("sz"), F.count("*").alias("n"))
    parts = []
    for name in names:
        a, _, _, d = SYMMETRIES[name]
        image = cells.join(box, "map_id").select("map_id", (F.col("sx") - F.col("x") if a < 0 else F.col("x")).alias("x"), (F.col("sz") - F.col("z") if d < 0 else F.col("z")).alias("z"))
        both = image.join(cells, ["map_id", "x", "z"], "left_semi").groupBy("map_id").agg(F.count("*").alias("same"))
        parts.append(box.join(both, "map_id", "left").select("map_id", F.lit(name).alias("symmetry"), (F.coalesce("same", F.lit(0)) / (2 * F.col("n") - F.coalesce("same", F.lit(0)))).alias("overlap")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    best = rows.groupBy("map_id").agg(F.max(F.round("overlap", 9)).alias("overlap"), F.min_by("symmetry", F.struct(-F.round("overlap", 9), "symmetry")).alias("symmetry"))
    return best.select("map_id", F.when(F.col("overlap") >= least, F.col("symmetry")).otherwise("none").alias("symmetry"), "overlap")


def centre_class(min_x: Column, max_x: Column, min_z: Column, max_z: Column) -> Column:
    """Blocks in the middle of a box: one where an extent is odd, two where it is even."""
    wide, deep = (max_x - min_x + 1) % 2 == 0, (max_z - min_z + 1) % 2 == 0
    return F.when(wide & deep, "2x2").when(wide, "2x1").when(deep, "1x2").otherwise("single_block")


def island_of(points: DataFrame, figures: DataFrame, margin: int = 5) -> DataFrame:
    """The first island whose box, widened by ``margin``, holds each point ``map_id, point_id, x, z``."""
    from matchspark.operators.spatial import held_by

    wide = figures.select("map_id", F.col("island_id").alias("region_id"), *((F.col(f"{e}_{c}") + s * margin).alias(f"{e}_{c}") for c in ("x", "z") for e, s in (("min", -1), ("max", 1))))
    return held_by(points.select("map_id", "point_id", "x", "z"), wide).groupBy("map_id", "point_id").agg(F.min("region_id").alias("island_id"))


def island_teams(figures: DataFrame, spawns: DataFrame, axis: str = "x", neutral: float = 0.03) -> DataFrame:
    """Team of each island: of three teams or more the nearest spawn's; of two the side of the map's middle.

    ``spawns``: ``map_id, team, x, z``, one a team. Islands within ``max(2, neutral of the
    map's extent)`` of the middle are neutral; ties go to the smaller team name.
    """
    counts = spawns.groupBy("map_id").agg(F.count_distinct("team").alias("teams"), F.avg(axis).alias("middle"))
    extent = figures.groupBy("map_id").agg((F.max(f"max_{axis}") - F.min(f"min_{axis}") + 1).alias("extent"))
    s = spawns.select("map_id", "team", F.col("x").alias("sx"), F.col("z").alias("sz"))
    far = F.round(F.hypot(F.col("center_x") - F.col("sx"), F.col("center_z") - F.col("sz")), 9)
    own = F.round(F.abs(F.col(f"center_{axis}") - F.col(f"s{axis}")), 9)
    rows = figures.join(s, "map_id").join(counts, "map_id").join(extent, "map_id")
    best = rows.groupBy(*ISLAND, "teams", "middle", "extent", f"center_{axis}").agg(F.min_by("team", F.struct(far, "team")).alias("nearest"), F.min_by("team", F.struct(own, "team")).alias("side"))
    inside = F.abs(F.col(f"center_{axis}") - F.col("middle")) <= F.greatest(F.lit(2.0), neutral * F.col("extent"))
    return best.select(*ISLAND, F.when(F.col("teams") >= 3, F.col("nearest")).when(inside, "neutral").otherwise(F.col("side")).alias("team"))
