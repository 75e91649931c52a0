"""Symmetry within the territory of each team, and islands that nobody plays on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.operators.shapes import ISLAND


def inner_axes(homes: DataFrame, symmetry: DataFrame, middles: DataFrame) -> DataFrame:
    """``map_id, team, axis``: the mirror that runs through a team's territory, across the one that parts the teams.

    ``homes``: ``map_id, team, x, z`` (its spawn island's centre); ``symmetry``: ``map_id,
    symmetry`` of the map; ``middles``: ``map_id, sx, sz``, twice the map's middle. Maps
    that are turned are parted along the longer way from the middle to the team (along x
    where both are as long); maps without a symmetry give no rows.
    """
    rows = homes.join(symmetry, "map_id").join(middles, "map_id")
    dx, dz = F.abs(2 * F.col("x") - F.col("sx")), F.abs(2 * F.col("z") - F.col("sz"))
    turned = F.when(dz > dx, "mirror_x").otherwise("mirror_z")
    axis = F.when(F.col("symmetry") == "mirror_z", "mirror_x").when(F.col("symmetry") == "mirror_x", "mirror_z").when(F.col("symmetry").isin("point", "rotation"), turned)
    return rows.select("map_id", "team", axis.alias("axis")).where("axis is not null")


def team_symmetry(cells: DataFrame, axes: DataFrame, middles: DataFrame, least: float = 0.60) -> DataFrame:
    """``map_id, team, axis, overlap, symmetric``: how far one half of a team's cells is the mirror image of the other.

    ``cells``: ``map_id, team, x, z``. The overlap is that of shared cells to all cells of
    both halves, laid on each other; cells in the middle row belong to neither. Teams with
    an empty half have overlap 0.
    """
    rows = cells.join(axes, ["map_id", "team"]).join(middles, "map_id")
    across, along = F.when(F.col("axis") == "mirror_x", F.col("x")).otherwise(F.col("z")), F.when(F.col("axis") == "mirror_x", F.col("z")).otherwise(F.col("x"))
    off = 2 * across - F.when(F.col("axis") == "mirror_x", F.col("sx")).otherwise(F.col("sz"))
    laid = rows.where(off != 0).select("map_id", "team", "axis", F.abs(off).alias("off"), along.alias("along"), (off > 0).alias("side"))
    met = laid.groupBy("map_id", "team", "axis", "off", "along").agg(F.count_distinct("side").alias("sides"))
    found = met.groupBy("map_id", "team", "axis").agg((F.count_if(F.col("sides") == 2) / F.count("*")).alias("overlap"))
    return axes.join(found, ["map_id", "team", "axis"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0))).withColumn("symmetric", F.col("overlap") >= least)


def canonical_coverage(islands: DataFrame) -> DataFrame:
    """``map_id, team, groups, covered, symmetric`` of maps turned by a quarter: shapes of which a team has exactly one island.

    ``islands``: ``map_id, island_id, team, shape``; islands without a team count for nobody.
    """
    shapes = islands.where("team is not null").groupBy("map_id", "shape").agg(F.count("*").alias("all"))
    groups = shapes.groupBy("map_id").agg(F.count("*").alias("groups"))
    own = islands.where("team is not null").groupBy("map_id", "team", "shape").agg(F.count("*").alias("n"))
    rows = own.groupBy("map_id", "team").agg(F.count_if(F.col("n") == 1).alias("covered")).join(groups, "map_id")
    return rows.select("map_id", "team", "groups", "covered", (F.col("groups") == F.col("covered")).alias("symmetric"))


def observer_islands(observers: DataFrame, cells: DataFrame, reach: int = 2) -> DataFrame:
    """``map_id, island_id`` of the island under each map's observers ``map_id, x, z`` (the middle of their spawn).

    The block at the rounded place counts, else the first one within ``reach``, in order of
    x and then z. Maps without one give no rows.
    """
    around = range(-reach, reach + 1)
    steps = F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("dx"), F.lit(0).alias("dz")), *(F.struct(F.lit(1 + n).alias("rank"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for n, (dx, dz) in enumerate((dx, dz) for dx in around for dz in around)))
    asked = observers.select("map_id", F.bround("x").cast("int").alias("bx"), F.bround("z").cast("int").alias("bz"), F.explode(steps).alias("s")).select("map_id", "s.rank", (F.col("bx") + F.col("s.dx")).alias("x"), (F.col("bz") + F.col("s.dz")).alias("z"))
    return asked.join(cells, ["map_id", "x", "z"]).groupBy("map_id").agg(F.min_by("island_id", "rank").alias("island_id"))


def unplayable(figures: DataFrame, observers: DataFrame, listed: DataFrame, boxes: DataFrame) -> DataFrame:
    """``map_id, island_id, reason`` of islands left out: observer, listed, or outside of the map's box by their centre.

    ``figures``: an island with ``center_x, center_z``; ``observers``, ``listed``: islands;
    ``boxes``: ``map_id, min_x, max_x, min_z, max_z`` of maps that have one. What is left
    is the islands without a row here, whose symmetry can be taken anew.
    """
    mark = lambda rows, name: rows.select(*ISLAND).distinct().withColumn(name, F.lit(True))
    rows = figures.select(*ISLAND, "center_x", "center_z").join(mark(observers, "seen"), ISLAND, "left").join(mark(listed, "told"), ISLAND, "left").join(boxes, "map_id", "left")
    out = ~(F.col("center_x").between(F.col("min_x"), F.col("max_x")) & F.col("center_z").between(F.col("min_z"), F.col("max_z")))
    reason = F.when(F.col("seen"), "observer").when(F.col("told"), "listed").when(out, "outside")
    return rows.select(*ISLAND, reason.alias("reason")).where("reason is not null")
