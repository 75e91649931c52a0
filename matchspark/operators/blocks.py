"""Block columns of maps: layers, runs, inventories, terrain.

Blocks are rows ``map_id, x, y, z, block_id``; a column is a pair of x and z. Every
operator groups by map and column, so no map is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ["map_id", "x", "z"]
AIR, BEDROCK, MARKER = 0, 7, 36
#: The block ids that count as resources and their names.
RESOURCES = {35: "wool", 41: "gold_block", 42: "iron_block", 52: "mob_spawner", 57: "diamond_block"}


def ground_layer(blocks: DataFrame) -> DataFrame:
    """Blocks at height 0 other than air."""
    return blocks.where((F.col("y") == 0) & (F.col("block_id") != AIR)).select(*COLUMN, "block_id")


def top_surface(blocks: DataFrame, max_height: int | None = None, exclude: tuple[int, ...] = (AIR, MARKER)) -> DataFrame:
    """Highest block of each column that is not excluded, at ``max_height`` or below."""
    rows = blocks.where(~F.col("block_id").isin(*exclude))
    if max_height is not None:
        rows = rows.where(F.col("y") <= max_height)
    return rows.groupBy(*COLUMN).agg(F.max("y").alias("y"), F.max_by("block_id", "y").alias("block_id"))


def lowest_solid(blocks: DataFrame, exclude: tuple[int, ...] = (AIR, MARKER)) -> DataFrame:
    """Lowest block of each column that is not excluded."""
    return blocks.where(~F.col("block_id").isin(*exclude)).groupBy(*COLUMN).agg(F.min("y").alias("y"), F.min_by("block_id", "y").alias("block_id"))


def lowest_bedrock(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_id") == BEDROCK).groupBy(*COLUMN).agg(F.min("y").alias("y"))


def bedrock_ceiling(blocks: DataFrame) -> DataFrame:
    """Lowest bedrock of each column and the top of the unbroken bedrock that starts there."""
    first = vertical_runs(blocks.where(F.col("block_id") == BEDROCK), 1)
    return first.groupBy(*COLUMN).agg(F.min("y_start").alias("y"), F.min_by("y_end", "y_start").alias("bedrock_ceiling_y"))


def vertical_runs(blocks: DataFrame, least: int = 1) -> DataFrame:
    """Unbroken runs of blocks in a column: ``y_start, y_end``, from ``least`` blocks on."""
    order = Window.partitionBy(*COLUMN).orderBy("y")
    rows = blocks.select(*COLUMN, "y").distinct().withColumn("run", F.col("y") - F.row_number().over(order))
    return rows.groupBy(*COLUMN, "run").agg(F.min("y").alias("y_start"), F.max("y").alias("y_end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run", "n")


def vertical_segments(blocks: DataFrame, least: int = 2) -> DataFrame:
    return vertical_runs(blocks.where(F.col("block_id") != AIR), least)


def longest_column_runs(blocks: DataFrame) -> DataFrame:
    """Length of the longest unbroken run of each column, without air."""
    return vertical_segments(blocks, 1).groupBy(*COLUMN).agg(F.max(F.col("y_end") - F.col("y_start") + 1).alias("longest"))


def vertical_density(blocks: DataFrame, threshold: int = 0, by_run: bool = False) -> DataFrame:
    """Columns whose longest run, or number of blocks, is at least ``threshold``, as ``metric``."""
    if by_run:
        return longest_column_runs(blocks).withColumnRenamed("longest", "metric").where(F.col("metric") >= threshold)
    rows = blocks.where(F.col("block_id") != AIR).groupBy(*COLUMN).agg(F.count("*").alias("metric"))
    return rows.where(F.col("metric") >= threshold)


def column_fill(blocks: DataFrame) -> DataFrame:
    """Blocks of each column, its height from the lowest to the highest, and their ratio."""
    height = F.max("y") - F.min("y") + 1
    return blocks.where(F.col("block_id") != AIR).groupBy(*COLUMN).agg(F.count("*").alias("n_blocks"), height.alias("height"), (F.count("*") / height).alias("density"))


def longest_row_runs(cells: DataFrame) -> DataFrame:
    """Longest run of neighbouring x in each row (map and z) of distinct cells."""
    rows = cells.select("map_id", "z", "x").distinct()
    rows = rows.withColumn("run", F.col("x") - F.row_number().over(Window.partitionBy("map_id", "z").orderBy("x")))
    return rows.groupBy("map_id", "z", "run").agg(F.count("*").alias("n")).groupBy("map_id", "z").agg(F.max("n").alias("longest"))


def resource_blocks(blocks: DataFrame, names: dict[int, str] = RESOURCES) -> DataFrame:
    """Blocks that count as resources, with their name."""
    name = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("block_id")]
    return blocks.where(F.col("block_id").isin(*names)).select("map_id", "x", "y", "z", name.alias("resource_type"))


def region_resources(resources: DataFrame, regions: DataFrame) -> DataFrame:
    """Resource blocks and their kinds in each region ``map_id, region_id, min_x, max_x, min_z, max_z`` (ends included; few a map)."""
    held = resources.join(regions, "map_id").where("x between min_x and max_x and z between min_z and max_z")
    return held.groupBy("map_id", "region_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("resource_type")), ",").alias("types"))


def block_inventory(blocks: DataFrame) -> DataFrame:
    """Blocks of each map and id, and the heights between which they lie."""
    return blocks.groupBy("map_id", "block_id").agg(F.count("*").alias("n"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def layer_stats(layers: dict[str, DataFrame]) -> DataFrame:
    """Blocks, heights and kinds of each map and layer; layers without heights have null ones."""
    out = None
    for name, rows in layers.items():
        y = F.col("y") if "y" in rows.columns else F.lit(None).cast("int")
        part = rows.groupBy("map_id").agg(F.lit(name).alias("layer"), F.count("*").alias("block_count"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))
        out = part if out is None else out.unionByName(part)
    return out


def chosen_layers(layers: DataFrame, wanted: DataFrame, order: tuple[str, ...] = ("configured", "bedrock", "y0")) -> DataFrame:
    """The layer that each map is clustered on: the first that it has, in this order; the configured one comes first.

    ``layers``: ``map_id, layer``; ``wanted``: ``map_id, layer`` (at most one a map).
    """
    rank = F.when(F.col("layer") == F.col("configured"), 0)
    for n, name in enumerate(order[1:], 1):
        rank = rank.when(F.col("layer") == name, n)
    rows = layers.join(wanted.select("map_id", F.col("layer").alias("configured")), "map_id", "left").withColumn("rank", rank)
    return rows.where("rank is not null").groupBy("map_id").agg(F.min_by("layer", "rank").alias("layer"))


def marker_share(blocks: DataFrame, marker: int = MARKER) -> DataFrame:
    """Blocks of the ground row of each map, and the percentage of markers in it."""
    return blocks.where(F.col("y") == 0).groupBy("map_id").agg(F.count("*").alias("n"), (100.0 * F.count_if(F.col("block_id") == marker) / F.count("*")).alias("pct"))


def surface_counts(blocks: DataFrame) -> DataFrame:
    """Columns of each map with a block other than air and markers."""
    return blocks.where(~F.col("block_id").isin(AIR, MARKER)).groupBy("map_id").agg(F.count_distinct("x", "z").alias("surface_blocks"))


def terrain(island_cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """``map_id, x, z, surface_y, lowest_y, bedrock_ceiling_y`` of the island cells that have a surface."""
    cells = island_cells.select(*COLUMN).distinct()
    surface = top_surface(blocks).select(*COLUMN, F.col("y").alias("surface_y"))
    lowest = lowest_solid(blocks).select(*COLUMN, F.col("y").alias("lowest_y"))
    ceiling = bedrock_ceiling(blocks).select(*COLUMN, "bedrock_ceiling_y")
    return cells.join(surface, COLUMN).join(lowest, COLUMN, "left").join(ceiling, COLUMN, "left")


def over_terrain(positions: DataFrame, terrain_: DataFrame) -> DataFrame:
    """Positions with their height over the surface block's top; null over the void; no row is lost."""
    return positions.join(terrain_.select(*COLUMN, "surface_y"), COLUMN, "left").withColumn("rel", F.col("y") - (F.col("surface_y") + 1))


def clearance(positions: DataFrame, surface: DataFrame) -> DataFrame:
    """Least and greatest height over the surface, and samples, of each column that has one."""
    rows = over_terrain(positions, surface).where("rel is not null")
    return rows.groupBy(*COLUMN).agg(F.max("rel").alias("max_clearance"), F.min("rel").alias("min_clearance"), F.count("*").alias("n"))


def build_cells(blocks: DataFrame, island_cells: DataFrame, marker: int = MARKER) -> DataFrame:
    """Marked cells of the ground row that belong to no island: where players may build."""
    marked = blocks.where((F.col("y") == 0) & (F.col("block_id") == marker)).select(*COLUMN).distinct()
    return marked.join(island_cells.select(*COLUMN).distinct(), COLUMN, "left_anti")


def build_ceiling(maps: DataFrame, positions: DataFrame, below: int = 4, percentile: float = 0.99) -> DataFrame:
    """Height up to which players build: ``max_build_height``, or a high percentile of heights, less ``below``."""
    high = positions.groupBy("map_id").agg(F.percentile("y", percentile).alias("p"))
    return maps.join(high, "map_id", "left").select("map_id", (F.coalesce("max_build_height", "p") - below).alias("ceiling"))
