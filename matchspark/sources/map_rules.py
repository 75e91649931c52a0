"""Rule files of maps (XML, one ``map`` element each) as tables: teams, wools, spawns, regions, kits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<_slot: string, _material: string, _amount: int, _damage: int, _unbreakable: boolean, `_team-color`: boolean, _enchantment: string>"
#: What is read of a rule file; attributes begin with ``_``.
SCHEMA = f"""_slug string, teams struct<team: array<struct<_id: string, _color: string, _max: int>>>,
 wools struct<wool: array<struct<_team: string, _color: string, _location: string>>>, spawns struct<spawn: array<struct<_team: string, _kit: string>>>,
 regions struct<cuboid: array<struct<_id: string, _min: string, _max: string>>>, kits struct<kit: array<struct<_id: string, item: array<{ITEM}>, armor: array<{ITEM}>>>>"""


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``map`` element below ``path``, with ``map_slug``."""
    rows = spark.read.format("xml").option("rowTag", "map").schema(SCHEMA).load(path)
    return rows.withColumnRenamed("_slug", "map_slug")


def _each(rules: DataFrame, column: str) -> DataFrame:
    return rules.select("map_slug", F.explode(column).alias("e"))


def _number(text: Column, at: int) -> Column:
    """One of the numbers between commas; null for words such as ``oo``."""
    return F.get(F.split(text, ","), F.lit(at)).try_cast("double")


def teams(rules: DataFrame) -> DataFrame:
    return _each(rules, "teams.team").select("map_slug", F.col("e._id").alias("team"), F.col("e._color").alias("colour"), F.col("e._max").alias("most"))


def wools(rules: DataFrame) -> DataFrame:
    """``map_slug, team, colour, x, y, z`` of every wool."""
    return _each(rules, "wools.wool").select("map_slug", F.col("e._team").alias("team"), F.col("e._color").alias("colour"), *(_number(F.col("e._location"), n).alias(c) for n, c in enumerate("xyz")))


def spawns(rules: DataFrame) -> DataFrame:
    return _each(rules, "spawns.spawn").select("map_slug", F.col("e._team").alias("team"), F.col("e._kit").alias("kit_id"))


def regions(rules: DataFrame) -> DataFrame:
    """``map_slug, region_id`` and the rectangle of every cuboid, corners sorted; sides without a number are null."""
    corner = lambda f, n: f(_number(F.col("e._min"), n), _number(F.col("e._max"), n))
    box = [corner(f, n).alias(f"{e}_{c}") for n, c in ((0, "x"), (2, "z")) for e, f in (("min", F.least), ("max", F.greatest))]
    return _each(rules, "regions.cuboid").select("map_slug", F.col("e._id").alias("region_id"), *box)


def kit_rows(rules: DataFrame, part: str = "item") -> DataFrame:
    """Items (or ``armor``) of kits, once for each team that spawns with the kit; kits of nobody's have the team ``''``.

    ``map_slug, kit_id, team, slot, material, amount, item_damage, unbreakable,
    team_colour, enchantment``; a missing amount is 1, a missing damage 0, missing flags
    are false; rows without a material are left out.
    """
    kits = rules.select("map_slug", F.explode("kits.kit").alias("k")).select("map_slug", F.col("k._id").alias("kit_id"), F.explode(f"k.{part}").alias("e"))
    owners = spawns(rules).where("kit_id is not null and team is not null").distinct()
    rows = kits.where("e._material is not null").join(owners, ["map_slug", "kit_id"], "left")
    flag = lambda c: F.coalesce(F.col(f"e.`{c}`"), F.lit(False))
    return rows.select("map_slug", "kit_id", F.coalesce("team", F.lit("")).alias("team"), F.col("e._slot").alias("slot"), F.col("e._material").alias("material"), F.coalesce("e._amount", F.lit(1)).alias("amount"), F.coalesce("e._damage", F.lit(0)).alias("item_damage"), flag("_unbreakable").alias("unbreakable"), flag("_team-color").alias("team_colour"), F.col("e._enchantment").alias("enchantment"))


def known_maps(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows with the ``map_id`` of their slug; rows of maps that the table lacks are left out."""
    return rows.join(maps.select("map_slug", "map_id"), "map_slug").drop("map_slug")
