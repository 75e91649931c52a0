"""Details of maps: rooms, anchors of islands, layers, columns of bedrock, corner shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.shapes import ISLAND, bounds


def flagged_islands(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Per island, whether a spawn or an objective of ``points (map_id, kind, team, x, z)`` lies on it, and the first team of its spawns."""
    on = points.join(cells, ["map_id", "x", "z"]).groupBy(*ISLAND).agg(
        F.bool_or(F.col("kind") == "spawn").alias("has_spawn"), F.bool_or(F.col("kind") == "wool").alias("has_wool"), F.min(F.when(F.col("kind") == "spawn", F.col("team"))).alias("team"))
    rows = cells.select(*ISLAND).distinct().join(on, ISLAND, "left")
    return rows.select(*ISLAND, F.coalesce("has_spawn", F.lit(False)).alias("has_spawn"), F.coalesce("has_wool", F.lit(False)).alias("has_wool"), "team")


def baselines(spawns: DataFrame, wools: DataFrame) -> DataFrame:
    """Distance from each team's spawn to each objective of the map (few of both)."""
    s = spawns.select("map_id", "team", F.col("x").alias("sx"), F.col("z").alias("sz"))
    return wools.join(s, "map_id").select("map_id", "wool_id", F.col("team"), F.hypot(F.col("x") - F.col("sx"), F.col("z") - F.col("sz")).alias("distance"))


def target_objective(samples: DataFrame, wools: DataFrame, low: int = 5, radius: float = 40.0) -> DataFrame:
    """Objective that each match and team defends: the one with most low samples near it, else with most samples near it."""
    w = wools.select("map_id", "wool_id", F.col("x").alias("wx"), F.col("z").alias("wz"))
    near = samples.select("map_id", "match_id", "team", "x", "y", "z").join(w, "map_id").where(F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz")) <= radius)
    counts = near.groupBy("match_id", "team", "wool_id").agg(F.count_if(F.col("y") < low).alias("deep"), F.count("*").alias("n"))
    return counts.groupBy("match_id", "team").agg(F.max_by("wool_id", F.struct("deep", "n", -F.col("wool_id"))).alias("wool_id"), F.max("deep").alias("deep"))


def defence_metrics(samples: DataFrame, wools: DataFrame, keys: list[str], radius: float = 40.0) -> DataFrame:
    """Per key: samples near any objective of the map, least height of them and mean distance to the nearest one."""
    w = wools.select("map_id", F.col("x").alias("wx"), F.col("z").alias("wz"))
    far = samples.join(w, "map_id").groupBy(*keys, "row_id", "y").agg(F.min(F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz"))).alias("d"))
    near = F.col("d") <= radius
    return far.groupBy(*keys).agg(F.count_if(near).alias("near_samples"), F.min(F.when(near, F.col("y"))).alias("min_y"), F.avg("d").alias("mean_distance"))


def layer_summary(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Extents of each map's blocks, their kinds, and how many have a name in ``names (block_id, name)``; others are called ``Block n``."""
    kinds = blocks.select("map_id", "block_id").distinct().join(F.broadcast(names), "block_id", "left")
    told = F.coalesce("name", F.concat(F.lit("Block "), F.col("block_id")))
    listed = kinds.groupBy("map_id").agg(F.count("*").alias("kinds"), F.count("name").alias("named"), F.min(told).alias("first_name"))
    box = blocks.groupBy("map_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    return box.join(listed, "map_id")


def ranked(rows: DataFrame, kind: str, metrics: dict[str, str], other: str, tie: str) -> DataFrame:
    """Rows by kind, the most characteristic first: each kind has a metric of its own, others ``other``."""
    metric = F.col(other).cast("double")
    for name, column in metrics.items():
        metric = F.when(F.col(kind) == name, F.col(column).cast("double")).otherwise(metric)
    order = Window.partitionBy(kind).orderBy(F.desc("metric"), tie)
    return rows.withColumn("metric", metric).withColumn("place", F.row_number().over(order))


def overridden(rows: DataFrame, manual: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``column`` replaced where ``manual`` has a value, with the automatic one beside it as ``auto_``."""
    m = manual.select(*keys, F.col(column).alias("__manual"))
    return rows.join(m, keys, "left").withColumn(f"auto_{column}", F.col(column)).withColumn(column, F.coalesce("__manual", column)).drop("__manual")


def high_bedrock(columns: DataFrame, boxes: DataFrame, percentile: float = 0.9, above: int = 3) -> DataFrame:
    """Columns ``map_id, x, z, y`` of bedrock that rise ``above`` blocks over a high percentile of their box's.

    ``boxes``: ``map_id, box_id, min_x, max_x, min_z, max_z`` (few a map).
    """
    held = columns.join(boxes, "map_id").where("x between min_x and max_x and z between min_z and max_z")
    floor = held.groupBy("map_id", "box_id").agg((F.percentile("y", percentile) + above).alias("floor"))
    return held.join(floor, ["map_id", "box_id"]).where("y > floor").select("map_id", "box_id", "x", "z", "y")


def lines_of(columns: DataFrame, least: int = 8, bin_size: int = 3) -> DataFrame:
    """Longest run of neighbouring x in each band of z, of boxes' columns; bands with ``least`` in a row."""
    rows = columns.select("map_id", "box_id", (F.floor(F.col("z") / bin_size) * bin_size).cast("int").alias("band"), "x").distinct()
    rows = rows.withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("map_id", "box_id", "band").orderBy("x")))
    runs = rows.groupBy("map_id", "box_id", "band", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("map_id", "box_id", "band").agg(F.max("n").alias("longest")).where(F.col("longest") >= least)


def corner_cutouts(cells: DataFrame, corners: tuple[str, ...] = ("nw", "ne", "sw", "se")) -> DataFrame:
    """Which corners of its box an island leaves empty, by the corner cells themselves, and how many."""
    box = bounds(cells, ISLAND)
    at = {"nw": ("min_x", "min_z"), "ne": ("max_x", "min_z"), "sw": ("min_x", "max_z"), "se": ("max_x", "max_z")}
    spots = box.select(*ISLAND, F.explode(F.array(*(F.struct(F.lit(n).alias("corner"), F.col(at[n][0]).alias("x"), F.col(at[n][1]).alias("z")) for n in corners))).alias("c")).select(*ISLAND, "c.*")
    cut = spots.join(cells, [*ISLAND, "x", "z"], "left_anti").groupBy(*ISLAND).agg(F.count("*").alias("cutouts"), F.array_join(F.sort_array(F.collect_set("corner")), ",").alias("corners"))
    return box.select(*ISLAND).join(cut, ISLAND, "left").select(*ISLAND, F.coalesce("cutouts", F.lit(0)).alias("cutouts"), F.coalesce("corners", F.lit("")).alias("corners"))


def flush_sides(cells: DataFrame) -> DataFrame:
    """Share of each side of its box that an island covers."""
    box = bounds(cells, ISLAND).drop("area")
    rows = cells.join(box, ISLAND)
    wide, deep = F.first("max_x") - F.first("min_x") + 1, F.first("max_z") - F.first("min_z") + 1
    side = lambda c, e, whole: (F.count_if(F.col(c) == F.col(e)) / whole)
    return rows.groupBy(*ISLAND).agg(side("x", "min_x", deep).alias("west"), side("x", "max_x", deep).alias("east"), side("z", "min_z", wide).alias("north"), side("z", "max_z", wide).alias("south"))


def hull_areas(cells: DataFrame) -> DataFrame:
    """Area of each island's convex hull over its blocks' corners, and the island's share of it.

    Only the outermost cells of each row go to the hull, so a group is as long as an
    island has rows.
    """
    ends = cells.groupBy(*ISLAND, "z").agg(F.min("x").alias("a"), (F.max("x") + 1).alias("b"), F.count("*").alias("n"))

    def hull(rows):
        points = sorted({(x, z + d) for a, b, z in zip(rows["a"].tolist(), rows["b"].tolist(), rows["z"].tolist(), strict=True) for x in (a, b) for d in (0, 1)})

        def half(some):
            out = []
            for p in some:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = half(points) + half(points[::-1])
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        first = rows.iloc[0]
        return rows.iloc[:1][ISLAND].assign(hull_area=float(area), convexity=float(rows["n"].sum() / area)) if len(first) else rows

    return ends.groupBy(*ISLAND).applyInPandas(hull, "map_id int, island_id int, hull_area double, convexity double")


def region_kinds(regions: DataFrame, words: dict[str, str], other: str = "other") -> DataFrame:
    """Kind of each region by the first keyword (a pattern) in its name."""
    kind = None
    for name, pattern in words.items():
        hit = F.lower("region_id").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return regions.withColumn("category", kind.otherwise(other))


def overlap_share(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells of each map and how many of them lie in ``area (map_id, x, z)``."""
    inside = area.select("map_id", "x", "z", F.lit(1).alias("hit")).distinct()
    return cells.select("map_id", "x", "z").distinct().join(inside, ["map_id", "x", "z"], "left").groupBy("map_id").agg(F.count("*").alias("cells"), F.count("hit").alias("inside"))


def map_documents(maps: DataFrame, islands: DataFrame) -> DataFrame:
    """One nested row a map: its figures and its islands in order."""
    nested = islands.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("island_id", "area"))).alias("islands"))
    return maps.join(nested, "map_id", "left").withColumn("islands", F.coalesce("islands", F.array().cast("array<struct<island_id:int,area:bigint>>")))


def placeable(kits: DataFrame, materials: DataFrame, most: int = 197, least: int = 16) -> DataFrame:
    """Materials of each map's kits that can be placed: a known ordinal of at most ``most`` in stacks of ``least``."""
    return kits.where(F.col("amount") >= least).join(materials, "material").where(F.col("ordinal") <= most).select("map_id", "material", "ordinal").distinct()


def artefacts(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Which artefacts each map has: ``map_id`` and a column of each kind, told by ``kind=`` in the path ``source`` of its rows."""
    kind = F.regexp_extract("source", "kind=([^/]+)", 1)
    return found.groupBy("map_id").agg(*(F.bool_or(kind == name).alias(out) for name, out in kinds.items()))
