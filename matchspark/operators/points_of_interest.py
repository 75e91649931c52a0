"""Points of interest of maps: spawns named inline or by pattern, their teams, and wools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that stand for spawns, and those that do not.
SPAWN, OTHER = "spawn", "wool|not-|obs"


def teams_of_regions(regions: DataFrame, teams: DataFrame) -> DataFrame:
    """``map_id, region_id, team``: the team that a region's name tells, null if none.

    A team whose whole id stands in the name comes before all others; then the first team,
    in order, whose colour or name does. Case does not count; an empty colour is in every
    name, as an empty or null ``name`` is in none. ``teams``: ``map_id, ord, team, colour, name``.
    """
    low = F.lower("region_id")
    has = lambda c: F.contains(low, F.lower(c))
    rule = F.when(has("team"), 0).when(has("colour") | F.coalesce((F.col("name") != "") & has("name"), F.lit(False)), 1)
    met = regions.select("map_id", "region_id").distinct().join(teams, "map_id", "left").withColumn("rule", rule)
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct("rule", "ord", "team")))
    return met.groupBy("map_id", "region_id").agg(best.alias("b")).select("map_id", "region_id", F.col("b.team").alias("team"))


def spawn_points(spawns: DataFrame, regions: DataFrame, teams: DataFrame) -> DataFrame:
    """``map_id, region_id, x, z, min_x, max_x, min_z, max_z, team, team_colour`` of every map's spawns.

    Maps with spawns of a team that carry a rectangle of their own (``spawns``: ``map_id,
    team``, rectangle) have those. Others take the regions (``map_id, region_id, kind``,
    rectangle) whose name says spawn and nothing that excludes it, unions left out, with
    the team that the name tells (null if none). Points are centres of rectangles.
    """
    colours = teams.select("map_id", "team", F.col("colour").alias("team_colour"))
    box = ["min_x", "max_x", "min_z", "max_z"]
    own = spawns.where("team is not null and team <> '' and min_x is not null").select("map_id", F.concat("team", F.lit("-spawn (inline)")).alias("region_id"), *box, "team")
    low = F.lower("region_id")
    named = regions.where(F.contains(low, F.lit(SPAWN)) & ~low.rlike(OTHER) & (F.col("kind") != "union") & F.col("min_x").isNotNull()).join(own.select("map_id").distinct(), "map_id", "left_anti")
    named = named.select("map_id", "region_id", *box).join(teams_of_regions(named, teams), ["map_id", "region_id"])
    rows = own.unionByName(named).join(colours, ["map_id", "team"], "left")
    middle = lambda c: ((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(c)
    return rows.select("map_id", "region_id", middle("x"), middle("z"), *box, "team", "team_colour")


def spawn_table(points: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows of the spawn table of known maps: ``map_id, spawn_idx`` (by team and name, from 0) and the points; to be written in place of the map's rows."""
    from pyspark.sql import Window

    order = Window.partitionBy("map_id").orderBy(F.col("team").asc_nulls_last(), "region_id", "x", "z")
    return points.join(maps.select("map_id").distinct(), "map_id", "left_semi").withColumn("spawn_idx", F.row_number().over(order) - 1)
