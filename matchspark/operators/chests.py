"""Chests of maps: contents, categories, zones, double chests.

Contents are rows ``map_id, chest_id, slot, item_id, cnt``; a chest may carry ``zone``
and ``category``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHEST = ["map_id", "chest_id"]
#: Item names, or parts of them, that tell what a chest is for, in order of priority.
ARMOUR = ("helmet", "chestplate", "leggings", "boots")
WEAPONS, BOWS = ("sword",), ("minecraft:bow", "261", "minecraft:arrow", "262")
FOOD = ("minecraft:cooked_fish", "350", "minecraft:cooked_beef", "364", "minecraft:bread", "297", "minecraft:cooked_chicken", "366", "minecraft:cooked_porkchop", "320")
TOOLS, SUPPLY = ("axe", "shovel"), ("minecraft:golden_apple", "322", "minecraft:potion", "373")
WOOL = ("minecraft:wool", "35")


def share_of(rows: DataFrame, keys: list[str], kind: str, name: str = "pct") -> DataFrame:
    """Rows of each key and kind, and their percentage of the key's rows."""
    counts = rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    return counts.withColumn(name, 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def summary(rows: DataFrame, kind: str) -> DataFrame:
    """Rows and items of each kind and the percentage of all rows; the kinds are few."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("pct", 100.0 * F.col("n") / F.col("whole")).drop("whole")


def zone_items(contents: DataFrame, zone: str) -> DataFrame:
    """Items of each kind in the chests of a zone."""
    return contents.where(F.col("zone") == zone).groupBy("map_id", "item_id").agg(F.sum("cnt").alias("total_items"))


def defence_density(contents: DataFrame, defence: str, wool: str) -> DataFrame:
    """Defence chests and items of each map, its wool chests, and items per wool chest."""
    at = lambda zone, value: F.when(F.col("zone") == zone, value)
    rows = contents.groupBy("map_id").agg(
        F.count_distinct(at(defence, F.col("chest_id"))).alias("defence_chests"), F.sum(at(defence, F.col("cnt"))).alias("items"), F.count_distinct(at(wool, F.col("chest_id"))).alias("wool_chests"))
    return rows.select("map_id", "defence_chests", F.coalesce("items", F.lit(0)).alias("defence_items"), "wool_chests", F.when(F.col("wool_chests") > 0, F.col("items") / F.col("wool_chests")).alias("items_per_wool"))


def maps_without(contents: DataFrame, zone: str, category: str) -> DataFrame:
    """Maps that have chests, but none of this zone and category, and how many."""
    with_one = contents.where((F.col("zone") == zone) & (F.col("category") == category)).select("map_id").distinct()
    return contents.join(with_one, "map_id", "left_anti").groupBy("map_id").agg(F.count_distinct("chest_id").alias("total_chests"))


def flagged(contents: DataFrame, flags: dict[str, str], category: str | None = None) -> DataFrame:
    """Per chest, whether any of its items contains each text: 1 or 0."""
    rows = contents if category is None else contents.where(F.col("category") == category)
    return rows.groupBy(*CHEST).agg(*(F.max(F.contains("item_id", F.lit(text)).cast("int")).alias(name) for name, text in flags.items()))


def combinations(chests: DataFrame, flags: list[str]) -> DataFrame:
    """Chests and maps of each combination of flags, and the percentage of chests."""
    counts = chests.groupBy(*flags).agg(F.count("*").alias("chest_count"), F.count_distinct("map_id").alias("map_count"))
    whole = chests.agg(F.count("*").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("pct_chests", F.round(100.0 * F.col("chest_count") / F.col("whole"), 1)).drop("whole")


def map_coverage(chests: DataFrame, flags: list[str]) -> DataFrame:
    """Maps by what any of their chests holds: number, mean, least and most chests."""
    maps = chests.groupBy("map_id").agg(*(F.max(f).alias(f) for f in flags), F.count("*").alias("chests"))
    return maps.groupBy(*flags).agg(F.count("*").alias("map_count"), F.round(F.avg("chests"), 1).alias("avg_chests"), F.min("chests").alias("min_chests"), F.max("chests").alias("max_chests"))


def categories(contents: DataFrame, chests: DataFrame | None = None, objectives: DataFrame | None = None) -> DataFrame:
    """What each chest is for: wool, combat, kit, weapon, supply, defense; ``empty`` for ``chests`` without contents.

    Wool counts where its ``item_damage`` is an objective of the map, or the map has none
    in ``objectives (map_id, wool_id)``.
    """
    rows = contents.withColumn("valid", F.lit(True))
    if objectives is not None:
        valid = objectives.groupBy("map_id").agg(F.collect_set("wool_id").alias("wools"))
        rows = contents.join(valid, "map_id", "left").withColumn("valid", F.col("wools").isNull() | F.array_contains("wools", F.col("item_damage")))
    item = F.col("item_id")
    part = lambda words: F.greatest(*(F.contains(item, F.lit(w)) for w in words), F.lit(False))
    flags = {"wool": item.isin(*WOOL) & F.col("valid"), "armour": part(ARMOUR), "weapon": part(WEAPONS) | item.isin(*BOWS), "food": item.isin(*FOOD), "tool": part(TOOLS), "supply": item.isin(*SUPPLY)}
    found = rows.groupBy(*CHEST).agg(*(F.bool_or(c).alias(name) for name, c in flags.items()))
    kind = F.when(F.col("wool"), "wool").when(F.col("armour"), "combat").when(F.col("weapon") & F.col("food") & F.col("tool"), "kit").when(F.col("weapon"), "weapon").when(F.col("supply"), "supply").otherwise("defense")
    found = found.select(*CHEST, kind.alias("content_category"))
    return found if chests is None else chests.join(found, CHEST, "left").withColumn("content_category", F.coalesce("content_category", F.lit("empty")))


def first_match(contents: DataFrame, words: dict[str, str], other: str) -> DataFrame:
    """Category of each chest: the first of ``words`` (category -> text) that any of its items contains."""
    kind = None
    for name, text in words.items():
        hit = F.bool_or(F.contains("item_id", F.lit(text)))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return contents.groupBy(*CHEST).agg(kind.otherwise(other).alias("content_category"))


def double_chests(places: DataFrame) -> DataFrame:
    """Distinct places ``map_id, x, z, y`` with ``is_double`` and the place that names their pair.

    Places are paired greedily in the order of x and z, each with the first free neighbour
    among x+1, x-1, z+1, z-1; a place whose first neighbour is taken stays alone. Groups
    of neighbours in one map and height are resolved one at a time; they are as large as
    chests stand side by side.
    """
    from matchspark.operators.components import connected_components

    spots = places.select("map_id", "x", "z", "y").distinct().withColumn("node", F.struct("x", "z"))
    near = lambda dx, dz: spots.select("map_id", "y", F.col("node").alias("src"), F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z")).alias("node"))
    edges = near(1, 0).unionByName(near(0, 1)).join(spots.select("map_id", "y", "node"), ["map_id", "y", "node"]).withColumnRenamed("node", "dst")
    labels = connected_components(edges, ["map_id", "y"])
    grouped = spots.join(labels, ["map_id", "y", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    grouped = grouped.select("map_id", "x", "z", "y", F.col("component.x").alias("gx"), F.col("component.z").alias("gz"))

    def pair(rows):
        all_ = sorted(zip(rows["x"].tolist(), rows["z"].tolist(), strict=True))
        have, named, double = set(all_), {}, {}
        for x, z in all_:
            if (x, z) in named:
                continue
            partner = next((p for p in ((x + 1, z), (x - 1, z), (x, z + 1), (x, z - 1)) if p in have), None)
            both = [(x, z), partner] if partner and partner not in named else [(x, z)]
            for p in both:
                named[p], double[p] = (x, z), len(both) == 2
        key = list(zip(rows["x"], rows["z"], strict=True))
        return rows.assign(is_double=[double[k] for k in key], group_x=[named[k][0] for k in key], group_z=[named[k][1] for k in key]).drop(columns=["gx", "gz"])

    return grouped.groupBy("map_id", "y", "gx", "gz").applyInPandas(pair, "map_id int, x int, z int, y int, is_double boolean, group_x int, group_z int")


def zones(chests: DataFrame, rectangles: DataFrame, defence: float = 10.0, near: float = 15.0) -> DataFrame:
    """Zone and team of each chest ``map_id, chest_id, x, z``: spawn, wool_room, defense, near_spawn or field.

    ``rectangles``: ``map_id, kind (spawn or wool_room), team, min_x, max_x, min_z, max_z``
    (few a map). Inside is strict; defense lies within ``defence`` of a wool room,
    near_spawn within ``near`` of a spawn; of equal zones the smallest team name wins.
    """
    inside = (F.col("x") > F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("z") > F.col("min_z")) & (F.col("z") < F.col("max_z"))
    dx = F.greatest(F.col("min_x") - F.col("x"), F.col("x") - F.col("max_x"), F.lit(0))
    dz = F.greatest(F.col("min_z") - F.col("z"), F.col("z") - F.col("max_z"), F.lit(0))
    far = F.hypot(dx, dz)
    spawn = F.col("kind") == "spawn"
    rank = F.when(spawn & inside, 0).when(~spawn & inside, 1).when(~spawn & (far <= defence), 2).when(spawn & (far <= near), 3)
    found = chests.select(*CHEST, "x", "z").join(rectangles, "map_id").withColumn("rank", rank).where("rank is not null")
    best = found.groupBy(*CHEST).agg(F.min(F.struct("rank", "team")).alias("b"))
    zone = F.element_at(F.array(*(F.lit(z) for z in ("spawn", "wool_room", "defense", "near_spawn"))), F.col("b.rank") + 1)
    return chests.join(best.select(*CHEST, zone.alias("zone"), F.col("b.team").alias("zone_team")), CHEST, "left").withColumn("zone", F.coalesce("zone", F.lit("field")))
