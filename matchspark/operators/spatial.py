"""Spatial joins: points to polygons, rectangles and nearest nodes, over a grid of buckets.

Points are block cells ``map_id, x, z``; a block's centre is half a block further. Joins
meet in grid buckets of a map and are done once for each distinct cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.operators.trajectories import grid_floor
from matchspark.session import cut

CELL = ["map_id", "x", "z"]


def rectangle_distance(x: Column, z: Column, min_x: Column, max_x: Column, min_z: Column, max_z: Column) -> Column:
    """Distance to a rectangle, 0 inside."""
    return F.hypot(F.greatest(min_x - x, x - max_x, F.lit(0)), F.greatest(min_z - z, z - max_z, F.lit(0)))


def inside_ring(x: Column, z: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses the ring's edges an odd number of times.

    ``ring`` is an array of structs ``x, z``; the last point joins the first. An edge
    holds its lower end.
    """
    after = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))

    def crossed(a: Column, b: Column) -> Column:
        return ((a["z"] > z) != (b["z"] > z)) & (x < a["x"] + (z - a["z"]) * (b["x"] - a["x"]) / F.when(b["z"] != a["z"], b["z"] - a["z"]))

    return F.aggregate(F.zip_with(ring, after, lambda a, b: F.coalesce(crossed(a, b), F.lit(False)).cast("int")), F.lit(0), lambda n, c: n + c) % 2 == 1


def classify(points: DataFrame, polygons: DataFrame, bucket: int = 16) -> DataFrame:
    """``points`` with ``location_type`` and ``island_id``: the first island that holds the block's centre, else a build region, else void.

    ``polygons``: ``map_id, polygon_id, kind (island or build_region), rings`` (ring 0
    outside, the others holes). Of several islands the smallest id wins.
    """
    rings = F.col("rings")
    ends = lambda c, f: f(F.transform(rings[0], lambda p: p[c]))
    boxed = polygons.where(F.size("rings") > 0).select("map_id", "polygon_id", "kind", "rings", ends("x", F.array_min).alias("x0"), ends("x", F.array_max).alias("x1"), ends("z", F.array_min).alias("z0"), ends("z", F.array_max).alias("z1"))
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    posted = boxed.withColumn("bx", spread("x0", "x1")).withColumn("bz", spread("z0", "z1"))
    cells = points.select(*CELL).distinct().withColumn("bx", F.floor(F.col("x") / bucket)).withColumn("bz", F.floor(F.col("z") / bucket))
    x, z = F.col("x") + 0.5, F.col("z") + 0.5
    met = cells.join(posted, ["map_id", "bx", "bz"]).where(x.between(F.col("x0"), F.col("x1")) & z.between(F.col("z0"), F.col("z1")))
    holes = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: inside_ring(x, z, r))
    held = met.where(inside_ring(x, z, rings[0]) & ~holes)
    best = held.groupBy(*CELL).agg(F.min(F.struct((F.col("kind") != "island").cast("int").alias("rank"), "polygon_id", "kind")).alias("b"))
    named = best.select(*CELL, F.col("b.kind").alias("location_type"), F.when(F.col("b.rank") == 0, F.col("b.polygon_id")).alias("island_id"))
    return points.join(named, CELL, "left").withColumn("location_type", F.coalesce("location_type", F.lit("void")))


def nearest_nodes(points: DataFrame, nodes: DataFrame, k: int = 1, bucket: int = 8, growth: int = 4) -> DataFrame:
    """The k nearest nodes of each distinct cell: ``map_id, x, z, rank, node_id, distance``; ties to the smaller id.

    ``nodes``: ``map_id, node_id, x, z``. A cell is compared with the nodes of its bucket
    and the eight around it; what lies closer than a bucket's side is then certain. Cells
    without k certain nodes go on with buckets ``growth`` times as wide, until the whole
    map is one bucket. Maps without nodes give no rows.
    """
    n = nodes.select("map_id", "node_id", F.col("x").cast("double").alias("nx"), F.col("z").cast("double").alias("nz"))
    there = n.groupBy("map_id").agg(F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("nz").alias("z0"), F.max("nz").alias("z1"), F.count("*").alias("all"))
    left = points.select(*CELL).distinct().join(there, "map_id")
    reach = F.greatest(*(F.abs(F.col(c) - F.col(e)) for c, es in (("x", ("x0", "x1")), ("z", ("z0", "z1"))) for e in es)) + 1
    left = cut(left.withColumn("reach", reach))
    widest = left.agg(F.max("reach")).first()[0]
    done = None
    while widest is not None:
        around = F.explode(F.array(*(F.lit(d) for d in (-1, 0, 1))))
        asked = left.withColumn("dx", around).withColumn("dz", around)
        asked = asked.withColumn("bx", F.floor(F.col("x") / bucket) + F.col("dx")).withColumn("bz", F.floor(F.col("z") / bucket) + F.col("dz"))
        there = n.withColumn("bx", F.floor(F.col("nx") / bucket)).withColumn("bz", F.floor(F.col("nz") / bucket))
        far = F.hypot(F.col("x") - F.col("nx"), F.col("z") - F.col("nz"))
        met = asked.join(there, ["map_id", "bx", "bz"]).groupBy(*CELL, "reach", "all").agg(F.slice(F.array_sort(F.collect_list(F.struct(far.alias("distance"), "node_id"))), 1, k).alias("best"))
        certain = (F.size("best") == F.least(F.lit(k), F.col("all"))) & ((F.element_at("best", -1)["distance"] <= bucket) | (F.col("reach") <= bucket))
        met = cut(met.withColumn("certain", certain))
        found = met.where("certain").select(*CELL, F.posexplode("best").alias("rank", "b")).select(*CELL, (F.col("rank") + 1).alias("rank"), "b.node_id", "b.distance")
        done = found if done is None else done.unionByName(found)
        if bucket >= widest:
            break
        left = cut(left.join(met.where("certain").select(*CELL), CELL, "left_anti"))
        if left.isEmpty():
            break
        bucket *= growth
    return done if done is not None else points.where("false").select(*CELL, F.lit(1).alias("rank"), F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("distance"))


def snapped(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` with their nearest node and its distance."""
    return points.join(nearest_nodes(points, nodes).drop("rank"), CELL, "left")


def held_by(points: DataFrame, rectangles: DataFrame) -> DataFrame:
    """``points (map_id, point_id, x, z)`` with each rectangle ``map_id, region_id, min_x, max_x, min_z, max_z`` that holds them, ends included.

    A rectangle is posted in grid buckets as wide as its longer side, rounded up to a power
    of two: four at most. A point looks in one bucket of each width that its map's
    rectangles have. Rectangles without an end (or without area) hold nothing.
    """
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"), F.lit(1.0))
    finite = rectangles.where((F.col("max_x") >= F.col("min_x")) & (F.col("max_z") >= F.col("min_z")) & (F.abs("min_x") < float("inf")) & (F.abs("min_z") < float("inf")) & (side < float("inf")))
    sized = finite.withColumn("__w", F.pow(F.lit(2.0), F.ceil(F.log2(side))))
    spread = lambda c: F.explode(F.sequence(F.floor(F.col(f"min_{c}") / F.col("__w")), F.floor(F.col(f"max_{c}") / F.col("__w"))))
    posted = sized.withColumn("__bx", spread("x")).withColumn("__bz", spread("z"))
    widths = sized.select("map_id", "__w").distinct()
    asked = points.join(widths, "map_id").withColumn("__bx", F.floor(F.col("x") / F.col("__w"))).withColumn("__bz", F.floor(F.col("z") / F.col("__w")))
    met = asked.join(posted, ["map_id", "__w", "__bx", "__bz"]).where("x between min_x and max_x and z between min_z and max_z")
    return met.drop("__w", "__bx", "__bz")


def smallest_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The smallest rectangle that holds each point ``map_id, point_id, x, z`` (ends included); ties to the smaller id.

    ``regions``: ``map_id, region_id, min_x, max_x, min_z, max_z``; endless ones never win.
    """
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_z") - F.col("min_z"))
    held = held_by(points.select("map_id", "point_id", "x", "z"), regions.select("map_id", "region_id", "min_x", "max_x", "min_z", "max_z"))
    return held.withColumn("__area", area).groupBy("map_id", "point_id").agg(F.min_by("region_id", F.struct("__area", "region_id")).alias("region_id"))


def rasterised(polygons: DataFrame, size: int) -> DataFrame:
    """Grid cells whose centre lies in a polygon of the map: ``map_id, cx, cz, kind, polygon_id``; islands come first."""
    ring = F.col("rings")[0]
    low = lambda c: grid_floor(F.array_min(F.transform(ring, lambda p: p[c])), size)
    high = lambda c: grid_floor(F.array_max(F.transform(ring, lambda p: p[c])), size)
    cells = polygons.select("map_id", "polygon_id", "kind", "rings", F.explode(F.sequence(low("x"), high("x"), F.lit(size))).alias("cx"), low("z").alias("z0"), high("z").alias("z1"))
    cells = cells.withColumn("cz", F.explode(F.sequence("z0", "z1", F.lit(size))))
    held = cells.where(inside_ring(F.col("cx") + size / 2, F.col("cz") + size / 2, F.col("rings")[0]))
    best = held.groupBy("map_id", "cx", "cz").agg(F.min(F.struct((F.col("kind") != "island").cast("int").alias("rank"), "polygon_id", "kind")).alias("b"))
    return best.select("map_id", "cx", "cz", "b.kind", "b.polygon_id")


def grid_frame(maps: DataFrame, size: int) -> DataFrame:
    """``map_id, grid_size, origin_x, origin_z`` of maps with their middle ``map_id, x, z``: a grid that lies evenly on both sides of it.

    A middle between two blocks asks for an odd size, so an even one grows by one; along
    such an axis the origin is half a cell before it, so that a cell straddles it. Other
    origins are the middle rounded to the even number.
    """
    half = lambda c: F.pmod(F.col(c), F.lit(1.0)) == 0.5
    grown = size + (1 if size % 2 == 0 else 0)
    grid = F.when(half("x") | half("z"), grown).otherwise(size)
    origin = lambda c: F.when(half(c) & (grid % 2 == 1), (F.col(c) - grid / 2).cast("int")).otherwise(F.bround(c).cast("int"))
    return maps.select("map_id", grid.cast("int").alias("grid_size"), origin("x").alias("origin_x"), origin("z").alias("origin_z"))


def island_grids(islands: DataFrame, grids: DataFrame, fine: tuple[str, ...] = ("fork", "maze", "amoeba")) -> DataFrame:
    """``islands`` with ``grid_size``: half their map's (2 at least) for winding archetypes, else their map's (``map_id, grid_size``)."""
    rows = islands.join(grids.select("map_id", F.col("grid_size").alias("__base")), "map_id")
    override = F.when(F.col("archetype").isin(*fine), F.greatest(F.lit(2), F.floor(F.col("__base") / 2).cast("int")))
    return rows.withColumn("grid_size", F.coalesce(override, "__base")).drop("__base")
