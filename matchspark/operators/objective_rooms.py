"""Rooms of objectives: which region is a wool's room, and how its wool comes back there.

Rectangles and points meet in grid buckets as wide as the rectangle, so a point of a map is
not compared with every region of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.scalars import respawn_label
from matchspark.operators.spatial import held_by, smallest_region
from matchspark.session import cut


def room_regions(wools: DataFrame, regions: DataFrame, spawners: DataFrame, chests: DataFrame) -> DataFrame:
    """``wools`` with ``region_id`` and ``found_by``: spawner, chest, location, shared, or null.

    ``wools``: ``map_id, idx`` (order), ``damage`` (its colour's number), ``x, z``;
    ``regions``: rectangles ``map_id, region_id, ...``; ``spawners``: ``map_id, idx,
    region_id`` (of its players), ``damage``, a row an item; ``chests``: ``map_id, idx, x,
    z, damage``, a row a chest with wool.

    Of wools at one place (to a tenth of a block) the first is looked up and the others
    share what it finds: the region of the first spawner of its colour; if none, the
    smallest region around the first chest of its colour that has one; if none, the smallest
    region around the wool itself. A pass sees only what those before it left.
    """
    place = F.struct(F.round("x", 1).alias("x"), F.round("z", 1).alias("z"))
    rows = cut(wools.withColumn("__place", place))
    lead = rows.groupBy("map_id", "__place").agg(F.min_by(F.struct("idx", "damage", "x", "z"), "idx").alias("l")).select("map_id", "__place", "l.*")
    by_colour = spawners.where("region_id is not null and region_id <> ''").groupBy("map_id", "damage").agg(F.min_by("region_id", "idx").alias("region_id"))
    first = cut(lead.join(by_colour, ["map_id", "damage"], "left"))
    left = first.where("region_id is null").select("map_id", "damage").distinct()
    asked = chests.join(left, ["map_id", "damage"], "left_semi").withColumn("point_id", F.struct("damage", "idx", "x", "z"))
    met = smallest_region(asked, regions).groupBy("map_id", F.col("point_id.damage").alias("damage")).agg(F.min_by("region_id", "point_id").alias("by_chest"))
    second = cut(first.join(met, ["map_id", "damage"], "left"))
    third = second.where("region_id is null and by_chest is null").withColumn("point_id", F.col("idx"))
    around = smallest_region(third, regions).select("map_id", F.col("point_id").alias("idx"), F.col("region_id").alias("by_place"))
    solved = second.join(around, ["map_id", "idx"], "left")
    how = F.when(F.col("region_id").isNotNull(), "spawner").when(F.col("by_chest").isNotNull(), "chest").when(F.col("by_place").isNotNull(), "location")
    solved = solved.select("map_id", "__place", F.col("idx").alias("__lead"), F.coalesce("region_id", "by_chest", "by_place").alias("region_id"), how.alias("found_by"))
    shared = F.when((F.col("idx") != F.col("__lead")) & F.col("found_by").isNotNull(), "shared").otherwise(F.col("found_by"))
    return rows.join(solved, ["map_id", "__place"]).withColumn("found_by", shared).drop("__place", "__lead")


def room_rectangles(wools: DataFrame, regions: DataFrame) -> DataFrame:
    """``map_id, wool_id, min_x, max_x, min_z, max_z`` of the wools with a room, corners sorted; of several rooms the smallest region_id; wools without a number are left out."""
    rows = wools.where("wool_id is not null and region_id is not null").groupBy("map_id", "wool_id").agg(F.min("region_id").alias("region_id")).join(regions, ["map_id", "region_id"])
    ends = [f(f"{a}_{c}", f"{b}_{c}").alias(f"{a if f is F.least else b}_{c}") for c in ("x", "z") for f, a, b in ((F.least, "min", "max"), (F.greatest, "min", "max"))]
    return rows.select("map_id", "wool_id", *ends)


def wool_spawners(spawners: DataFrame, entities: DataFrame) -> DataFrame:
    """Mob spawners ``map_id, x, y, z`` that are known to spawn wool; on maps without any tile entities all of them."""
    known = entities.select("map_id").distinct().withColumn("known", F.lit(True))
    told = entities.groupBy("map_id", "x", "y", "z").agg(F.bool_or("spawns_wool").alias("spawns_wool"))
    rows = spawners.join(known, "map_id", "left").join(told, ["map_id", "x", "y", "z"], "left")
    return rows.where(F.col("known").isNull() | F.coalesce("spawns_wool", F.lit(False))).select(*spawners.columns)


def wool_in_rooms(rooms: DataFrame, chest_wool: DataFrame, block_wool: DataFrame, spawners: DataFrame, renewables: DataFrame) -> DataFrame:
    """What each room ``map_id, region_id`` and rectangle holds: ``chest_wool, block_wool, mob_spawners`` (counts) and the ``colours`` of wool in chests and blocks, in order.

    ``chest_wool``, ``block_wool``: ``map_id, x, z, colour``. Blocks count only inside one
    of the map's ``renewables`` (rectangles): maps without any have none.
    """
    rules = renewables.withColumn("region_id", F.monotonically_increasing_id())
    renewed = block_wool.withColumn("point_id", F.monotonically_increasing_id())
    renewed = cut(renewed)
    inside = held_by(renewed.select("map_id", "point_id", "x", "z"), rules).select("map_id", "point_id").distinct()
    kinds = [("chest", chest_wool.select("map_id", "x", "z", "colour")), ("block", renewed.join(inside, ["map_id", "point_id"], "left_semi").select("map_id", "x", "z", "colour")), ("spawner", spawners.select("map_id", "x", "z", F.lit(None).cast("string").alias("colour")))]
    things = None
    for kind, rows in kinds:
        some = rows.withColumn("kind", F.lit(kind))
        things = some if things is None else things.unionByName(some)
    counted = things.groupBy("map_id", "x", "z", "kind", "colour").agg(F.count("*").alias("n"))
    met = held_by(counted.select("map_id", F.struct("kind", "colour", "n").alias("point_id"), "x", "z"), rooms)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("point_id.kind") == kind, F.col("point_id.n"))), F.lit(0))
    sums = met.groupBy("map_id", "region_id").agg(n("chest").alias("chest_wool"), n("block").alias("block_wool"), n("spawner").alias("mob_spawners"), F.sort_array(F.collect_set("point_id.colour")).alias("colours"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("chest_wool", "block_wool", "mob_spawners")}
    return rooms.select("map_id", "region_id").distinct().join(sums, ["map_id", "region_id"], "left").withColumns(zero).withColumn("colours", F.coalesce("colours", F.array().cast("array<string>")))


def wool_respawns(wools: DataFrame, spawners: DataFrame, contents: DataFrame) -> DataFrame:
    """``wools`` with ``spawner_idx`` and ``respawn``: how the wool comes back.

    The spawner is the first one for players in the wool's room or that gives its colour.
    ``respawn`` is the first of: that spawner, a mob spawner, renewable blocks, a chest in
    the room (``contents``, as ``wool_in_rooms`` gives them); else unknown.
    """
    pairs = spawners.select("map_id", F.col("idx").alias("s"), F.col("region_id").alias("s_region"), F.col("damage").alias("s_damage"))
    named = wools.where("region_id is not null").join(pairs, (wools["map_id"] == pairs["map_id"]) & (wools["region_id"] == pairs["s_region"])).select(wools["map_id"], wools["idx"], "s")
    coloured = wools.join(pairs, (wools["map_id"] == pairs["map_id"]) & (wools["damage"] == pairs["s_damage"])).select(wools["map_id"], wools["idx"], "s")
    first = named.unionByName(coloured).groupBy("map_id", "idx").agg(F.min("s").alias("spawner_idx"))
    rows = wools.join(first, ["map_id", "idx"], "left").join(contents.select("map_id", "region_id", "chest_wool", "block_wool", "mob_spawners"), ["map_id", "region_id"], "left")
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return rows.withColumn("respawn", respawn_label(F.col("spawner_idx").isNotNull(), some("mob_spawners"), some("block_wool"), some("chest_wool"))).select(*wools.columns, "spawner_idx", "respawn")
