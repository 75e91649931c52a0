"""Archetypes of islands: figures of their outline, box, empty corners and skeleton, and the rules that name a shape by them.

Figures come from cells ``map_id, island_id, x, z`` by grouped sums; an island's cells are
never gathered, but for the ends of its rows where its hull is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.rooms import hull_areas
from matchspark.operators.shapes import ISLAND, bounds, empty_parts
from matchspark.session import cut

#: The pairs of corners that lie opposite each other.
DIAGONAL = ("BL,TR", "BR,TL")


def filled(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """The cells and those of the holes in them."""
    inner = parts.groupBy(*ISLAND, "component").agg(F.bool_or("open").alias("open")).where("not open").select(*ISLAND, "component")
    more = parts.join(inner, [*ISLAND, "component"]).select(*ISLAND, F.explode(F.sequence("x0", "x1")).alias("x"), "z")
    return cells.select(*ISLAND, "x", "z").unionByName(more).distinct()


def outline(cells: DataFrame) -> DataFrame:
    """Lattice points on the outline of cells: ``map_id, island_id, px, pz, turns, sides``.

    ``turns``: how often the outline turns there (twice where two cells touch by a corner);
    ``sides``: unit sides that end there. Each cell names its four corners; which of the
    four cells around a point are there tells the rest.
    """
    corners = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("px"), (F.col("z") + dz).alias("pz"), F.lit(1 << (2 * dz + dx)).alias("bit")) for dx in (0, 1) for dz in (0, 1))))
    around = cells.select(*ISLAND, corners.alias("c")).groupBy(*ISLAND, F.col("c.px").alias("px"), F.col("c.pz").alias("pz")).agg(F.sum("c.bit").alias("around"), F.count("*").alias("n"))
    diagonal = F.col("around").isin(6, 9)
    turns = F.when(F.col("n").isin(1, 3), 1).when(diagonal, 2).otherwise(0)
    sides = F.when(F.col("n") == 4, 0).when(diagonal, 4).otherwise(2)
    return around.select(*ISLAND, "px", "pz", turns.alias("turns"), sides.alias("sides")).where("sides > 0")


def outline_figures(points: DataFrame) -> DataFrame:
    """Perimeter, direction of the main axis in degrees, roundness of the turning points, and the box along the main axis.

    ``circle_residual``: their deviation from the algebraic circle fit by its radius;
    ``ellipse_residual``: that of their distances measured by their own covariance.
    """
    sides = points.groupBy(*ISLAND).agg((F.sum("sides") / 2).alias("perimeter"))
    turning = points.where("turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns")))).select(*ISLAND, F.col("px").cast("double").alias("x"), F.col("pz").cast("double").alias("z"))
    q = F.col("x") * F.col("x") + F.col("z") * F.col("z")
    m = turning.withColumn("q", q).groupBy(*ISLAND).agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"), F.avg("q").alias("mq"), F.covar_samp("x", "x").alias("xx"), F.covar_samp("z", "z").alias("zz"), F.covar_samp("x", "z").alias("xz"), F.covar_samp("x", "q").alias("xq"), F.covar_samp("z", "q").alias("zq"))
    det = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    m = m.withColumn("det", det).withColumn("ox", (F.col("xq") * F.col("zz") - F.col("zq") * F.col("xz")) / F.col("det") / 2).withColumn("oz", (F.col("zq") * F.col("xx") - F.col("xq") * F.col("xz")) / F.col("det") / 2)
    m = m.withColumn("r2", F.col("mq") - 2 * F.col("ox") * F.col("mx") - 2 * F.col("oz") * F.col("mz") + F.col("ox") ** 2 + F.col("oz") ** 2)
    m = m.withColumn("axis", 0.5 * F.atan2(2 * F.col("xz"), F.col("xx") - F.col("zz")))
    dx, dz = F.col("x") - F.col("mx"), F.col("z") - F.col("mz")
    rows = turning.join(m, ISLAND).withColumn("round", F.hypot(F.col("x") - F.col("ox"), F.col("z") - F.col("oz"))).withColumn("own", F.sqrt(F.greatest(F.lit(0.0), (F.col("zz") * dx * dx - 2 * F.col("xz") * dx * dz + F.col("xx") * dz * dz) / F.col("det"))))
    rows = rows.withColumn("along", dx * F.cos("axis") + dz * F.sin("axis")).withColumn("across", dz * F.cos("axis") - dx * F.sin("axis"))
    r = F.sqrt(F.greatest(F.first("r2"), F.lit(1e-12)))
    circle = F.when(F.first("r2") > 0, F.sqrt(F.avg((F.col("round") - F.sqrt(F.greatest("r2", F.lit(1e-12)))) ** 2)) / r)
    figures = rows.groupBy(*ISLAND).agg(circle.alias("c"), (F.stddev_pop("own") / F.nullif(F.avg("own"), F.lit(0.0))).alias("e"), F.degrees(F.first("axis")).alias("axis"), ((F.max("along") - F.min("along")) * (F.max("across") - F.min("across"))).alias("turned_box"))
    return sides.join(figures, ISLAND).select(*ISLAND, "perimeter", F.coalesce("c", F.lit(1.0)).alias("circle_residual"), F.coalesce("e", F.lit(1.0)).alias("ellipse_residual"), "axis", "turned_box")


def corner_cuts(parts: DataFrame, box: DataFrame, least_fill: float = 0.95) -> DataFrame:
    """Rectangular cuts at the corners of each island's box: ``cuts, coverage, corners, min_side``.

    A cut is an empty part that touches two sides of the box that meet (within 2 % of the
    shorter side, half a block at least) and fills ``least_fill`` of its own box.
    ``coverage``: their share of all empty cells; ``corners``: TL, TR, BL, BR in order;
    ``min_side``: the least share of a side that four cuts leave, else 0. Islands without
    a cut give no row.
    """
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    part = parts.groupBy(*ISLAND, "component").agg(size.alias("cells"), F.min("x0").alias("a"), F.max("x1").alias("b"), F.min("z").alias("c"), F.max("z").alias("d")).join(box, ISLAND)
    wide, deep = F.col("max_x") - F.col("min_x") + 1, F.col("max_z") - F.col("min_z") + 1
    eps = F.greatest(F.lit(0.5), 0.02 * F.least(wide, deep))
    left, right, top, bottom = F.col("a") <= F.col("min_x") + eps, F.col("b") >= F.col("max_x") - eps, F.col("c") <= F.col("min_z") + eps, F.col("d") >= F.col("max_z") - eps
    full = F.col("cells") >= least_fill * (F.col("b") - F.col("a") + 1) * (F.col("d") - F.col("c") + 1)
    corner = F.when(full & (left != right) & (top != bottom), F.concat(F.when(top, "T").otherwise("B"), F.when(left, "L").otherwise("R")))
    marked = part.select("*", corner.alias("corner"), (F.col("b") - F.col("a") + 1).alias("cut_x"), (F.col("d") - F.col("c") + 1).alias("cut_z"), wide.alias("wide"), deep.alias("deep"))
    of = lambda side, c: F.sum(F.when(F.col("corner").contains(side), F.col(c)))
    rows = marked.groupBy(*ISLAND).agg(
        F.count("corner").alias("cuts"), (F.sum(F.when(F.col("corner").isNotNull(), F.col("cells"))) / F.sum("cells")).alias("coverage"), F.array_join(F.sort_array(F.collect_set("corner")), ",").alias("corners"),
        F.least(*(F.greatest(F.lit(0.0), 1 - F.coalesce(of(side, c), F.lit(0)) / F.first(whole)) for side, c, whole in (("T", "cut_x", "wide"), ("B", "cut_x", "wide"), ("L", "cut_z", "deep"), ("R", "cut_z", "deep")))).alias("least"),
    )
    return rows.where("cuts > 0").select(*ISLAND, "cuts", F.round("coverage", 4).alias("coverage"), "corners", F.when(F.col("corners") == "BL,BR,TL,TR", F.round("least", 4)).otherwise(0.0).alias("min_side"))


def turned_half(cells: DataFrame, box: DataFrame) -> DataFrame:
    """Islands whose cells are the same after half a turn around their box's centre."""
    placed = cells.join(box, ISLAND)
    turned = placed.select(*ISLAND, (F.col("min_x") + F.col("max_x") - F.col("x")).alias("x"), (F.col("min_z") + F.col("max_z") - F.col("z")).alias("z"))
    odd = turned.join(cells, [*ISLAND, "x", "z"], "left_anti").select(*ISLAND).distinct()
    return box.select(*ISLAND).join(odd, ISLAND, "left_anti")


def island_features(cells: DataFrame) -> DataFrame:
    """The figures that ``archetype`` reads, but for those of a skeleton, one row an island; shares have four decimals.

    Holes are empty parts that do not touch the box; the outline and the hull are those of
    the island with its holes filled.
    """
    cells = cut(cells.select(*ISLAND, "x", "z").distinct())
    box = bounds(cells, ISLAND)
    parts = empty_parts(cells, ISLAND)
    whole = cut(filled(cells, parts))
    enclosed = parts.groupBy(*ISLAND, "component").agg(F.bool_or("open").alias("open")).groupBy(*ISLAND).agg(F.count_if(~F.col("open")).alias("holes"))
    side = whole.join(box.drop("area"), ISLAND).groupBy(*ISLAND).agg(F.first(F.col("max_x") - F.col("min_x") + 1).alias("wide"), F.first(F.col("max_z") - F.col("min_z") + 1).alias("deep"), F.count("*").alias("outer_area"), *(F.count_if(F.col(c) == F.col(e)).alias(e[:3] + c) for c, e in (("x", "min_x"), ("x", "max_x"), ("z", "min_z"), ("z", "max_z"))))
    flush = F.greatest(F.greatest("minx", "maxx") / F.col("deep"), F.greatest("minz", "maxz") / F.col("wide"))
    rows = box.select(*ISLAND, "area").join(side, ISLAND).join(enclosed, ISLAND, "left").join(outline_figures(outline(whole)), ISLAND)
    rows = rows.join(hull_areas(whole).select(*ISLAND, "hull_area"), ISLAND).join(corner_cuts(parts, box.drop("area")), ISLAND, "left")
    symmetric = turned_half(whole, box.drop("area")).withColumn("half_turn", F.lit(True))
    rows = rows.join(symmetric, ISLAND, "left")
    tilt = F.pmod(F.round("axis", 2), F.lit(90.0))
    turned_fill = F.when(tilt.between(20, 70) & (F.col("turned_box") > 0), F.round(F.least(F.lit(1.0), F.col("outer_area") / F.col("turned_box")), 4))
    r4 = lambda c: F.round(c, 4)
    return rows.select(
        *ISLAND, "area", "wide", "deep", r4(F.greatest("wide", "deep") / F.least("wide", "deep")).alias("aspect"), r4(F.col("area") / (F.col("wide") * F.col("deep"))).alias("fill"), r4(F.least(F.lit(1.0), F.col("outer_area") / F.col("hull_area"))).alias("convexity"),
        r4(F.col("perimeter") / (2 * (F.col("wide") + F.col("deep")))).alias("rugosity"), F.coalesce("holes", F.lit(0)).alias("holes"), r4("circle_residual").alias("circle_residual"), r4("ellipse_residual").alias("ellipse_residual"), tilt.alias("tilt"), turned_fill.alias("turned_fill"),
        F.coalesce("half_turn", F.lit(False)).alias("half_turn"), r4(flush).alias("flush"), F.coalesce("cuts", F.lit(0)).alias("cuts"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("corners", F.lit("")).alias("corners"), F.coalesce("min_side", F.lit(0.0)).alias("min_side"),
    )


def skeleton_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``map_id, island_id, junctions, endpoints, edges, topology, min_arm_angle`` of each island's skeleton.

    ``nodes``: an island, ``kind`` (junction, endpoint or other), ``x, z``; ``edges``: an
    island, a row each. ``min_arm_angle``: with one junction and two ends or more, the
    least angle between neighbouring ends seen from it, to a tenth; else null.
    """
    counts = nodes.groupBy(*ISLAND).agg(F.count_if(F.col("kind") == "junction").alias("junctions"), F.count_if(F.col("kind") == "endpoint").alias("endpoints"), F.max(F.when(F.col("kind") == "junction", F.struct("x", "z"))).alias("j"))
    counts = counts.join(edges.groupBy(*ISLAND).agg(F.count("*").alias("edges")), ISLAND, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    j, e = F.col("junctions"), F.col("endpoints")
    topology = F.when((j == 0) & (e == 0), "none").when((j == 0) & (e == 2), "line").when(F.col("edges") > j + e - 1, "mesh").otherwise("tree")
    ends = nodes.where("kind = 'endpoint'").join(counts.where("junctions = 1 and endpoints >= 2").select(*ISLAND, "j"), ISLAND)
    turn = ends.withColumn("angle", F.degrees(F.atan2(F.col("z") - F.col("j.z"), F.col("x") - F.col("j.x"))))
    order = Window.partitionBy(*ISLAND).orderBy("angle")
    gaps = turn.withColumn("gap", F.col("angle") - F.lag("angle").over(order))
    least = gaps.groupBy(*ISLAND).agg(F.round(F.least(F.min("gap"), 360 - F.max("angle") + F.min("angle")), 1).alias("min_arm_angle"))
    return counts.withColumn("topology", topology).drop("j").join(least, ISLAND, "left")


def skeleton_totals(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, endpoints and junctions of all skeletons of a map."""
    n = nodes.groupBy("map_id").agg(F.count("*").alias("nodes"))
    sums = features.groupBy("map_id").agg(*(F.sum(c).alias(c) for c in ("edges", "endpoints", "junctions")))
    return n.join(sums, "map_id")


def archetype_rules() -> list[tuple[str, str, Column]]:
    """Rules in order as (archetype, boundary, condition); the first that holds names the shape, else it is an amoeba.

    Thresholds are fixed values. Columns of ``skeleton_features`` are null without a skeleton.
    """
    c = F.col
    fill, convex, rough, cuts, coverage, whole = c("fill"), c("convexity"), c("rugosity"), c("cuts"), c("coverage"), c("holes") == 0
    uncut, simple = cuts == 0, F.coalesce("junctions", F.lit(0)) <= 1
    two = cuts == 2
    opposite = c("corners").isin(*DIAGONAL)
    shaped = (convex >= 0.60) & simple
    long = c("aspect") > 1.2
    circular = F.when(long, (c("ellipse_residual") < 0.10) & (fill >= 0.72)).otherwise(c("circle_residual") < 0.12)
    angular = F.when(long, (fill < 0.88) & ((c("ellipse_residual") >= 0.10) | (fill < 0.72))).otherwise((fill < 0.85) & (c("circle_residual") >= 0.12))
    round_ = (convex >= 0.88) & whole & c("half_turn") & circular
    annular = (c("holes") == 1) & (c("area") >= 30) & (fill >= 0.25)
    comb = (c("endpoints") >= 3) & (rough >= 1.3) & (convex < 0.90)
    return [
        ("rectangle", "clean", fill == 1),
        ("rectangle", "clean", (cuts == 4) & (c("corners") == "BL,BR,TL,TR") & (coverage >= 0.99) & (c("min_side") >= 0.60)),
        ("rectangle", "clean", (fill >= 0.95) & (convex >= 0.95) & whole & uncut),
        ("rectangle", "staircase", c("tilt").between(20, 70) & (c("turned_fill") >= 0.92)),
        ("rectangle", "noisy", (fill >= 0.88) & (convex >= 0.88) & whole & uncut & (rough >= 1.08) & simple),
        ("ring", "clean", annular & (convex >= 0.92) & (rough <= 1.1)),
        ("ring", "rugged", annular & (convex >= 0.85) & (rough <= 1.25)),
        ("circle", "rugged", round_ & (rough >= 1.05)),
        ("circle", "clean", round_),
        ("L", "clean", (cuts == 1) & (coverage >= 0.90)),
        ("Z", "clean", two & (coverage >= 0.90) & opposite),
        ("T", "clean", two & (coverage >= 0.90) & ~opposite),
        ("L", "noisy", shaped & (cuts == 1) & (coverage >= 0.70)),
        ("Z", "noisy", shaped & two & (coverage >= 0.70) & opposite),
        ("T", "noisy", shaped & two & (coverage >= 0.70) & ~opposite),
        ("shard", "clean", (c("topology") == "line") & (convex >= 0.87) & uncut & angular),
        ("rectangle", "chopped", (c("flush") >= 0.80) & (fill >= 0.65) & (convex >= 0.82) & (rough <= 1.12) & whole & uncut & simple),
        ("maze", "rugged", (c("holes") >= 2) & (rough >= 1.2)),
        ("maze", "clean", c("holes") >= 2),
        ("plus", "clean", (c("junctions") == 1) & (c("endpoints") == 4) & (c("min_arm_angle") >= 60)),
        ("fork", "clean", (c("junctions") == 1) & (c("endpoints") == 3) & (convex < 0.80)),
        ("fork", "clean", (c("junctions") >= 2) & ((convex < 0.70) | comb)),
        ("amoeba", "rugged", rough >= 1.2),
        ("linear", "clean", c("aspect") >= 2.5),
    ]


def archetypes(features: DataFrame, skeletons: DataFrame | None = None) -> DataFrame:
    """``features`` with ``archetype``, ``boundary``, ``is_square`` and ``island_type`` (the archetype, with the boundary unless clean).

    ``skeletons``: rows of ``skeleton_features``; islands without one are judged by the
    rules that need none.
    """
    names = ["junctions", "endpoints", "topology", "min_arm_angle"]
    if skeletons is not None:
        rows = features.join(skeletons.select(*ISLAND, *names), ISLAND, "left")
    else:
        rows = features.withColumns({n: F.lit(None).cast("string" if n == "topology" else "double") for n in names})
    chosen = None
    for name, boundary, holds in archetype_rules():
        value = F.struct(F.lit(name).alias("archetype"), F.lit(boundary).alias("boundary"))
        chosen = F.when(holds, value) if chosen is None else chosen.when(holds, value)
    named = rows.withColumn("named", chosen.otherwise(F.struct(F.lit("amoeba").alias("archetype"), F.lit("clean").alias("boundary"))))
    square = (F.col("named.archetype") == "rectangle") & (F.col("named.boundary") == "clean") & (F.col("wide") == F.col("deep")) & (F.col("cuts") == 0)
    kind = F.when(F.col("named.boundary") == "clean", F.col("named.archetype")).otherwise(F.concat_ws("_", "named.archetype", "named.boundary"))
    return named.select(*rows.columns, "named.archetype", "named.boundary", square.alias("is_square"), kind.alias("island_type"))
