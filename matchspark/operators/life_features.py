"""Features of lives snapped to a traffic graph: nodes in order, distances to the other side's objectives, where a life ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.scalars import death_region
from matchspark.operators.paths import shortest_distances
from matchspark.operators.sessions import LIFE, at_last


def objective_table(objectives: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, objective, team, node, distance``: the way from every objective to every node that it reaches, computed once for all lives.

    ``objectives``: key, ``node, team`` (whose objective it is, null for nobody's).
    """
    far = shortest_distances(objectives.select(key, "node"), edges, key, by_source=True)
    return far.join(objectives.select(key, F.col("node").alias("source"), "team").distinct(), [key, "source"]).withColumnRenamed("source", "objective")


def attack_depths(table: DataFrame, teams: DataFrame, key: str) -> DataFrame:
    """``key, team, node, depth, objective``: for each of ``teams (key, team)`` the nearest objective of another side (or nobody's); ties to the smaller node."""
    others = table.withColumnRenamed("team", "side").join(teams, key).where(F.col("side").isNull() | (F.col("side") != F.col("team")))
    best = others.groupBy(key, "team", "node").agg(F.min(F.struct("distance", "objective")).alias("b"))
    return best.select(key, "team", "node", F.col("b.distance").alias("depth"), F.col("b.objective").alias("objective"))


def snapped_features(samples: DataFrame, depths: DataFrame, homes: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Per life with ``least`` samples above height 0: ``node_sequence``, ``max_attack_depth``, ``first_reach``, ``target``, ``death_region``.

    ``samples``: a life, key, ``team, t, row_id, y, node_id, location_type, island_id``;
    lives without a number take no part. ``node_sequence`` lists every sample's node.
    ``max_attack_depth`` is the least way from any of them to another side's objective,
    null where none leads there; ``first_reach`` is the second of the first sample so near
    and ``target`` that objective. ``death_region`` comes from the last sample of any
    height: ``homes`` (key, ``team, island_id``) tells the home island.
    """
    rows = samples.where("segment_idx is not null")
    last = rows.groupBy(*LIFE).agg(*(at_last(c, "t", "row_id").alias(c) for c in (key, "team", "location_type", "island_id") if c not in LIFE))
    last = last.join(homes.select(key, "team", F.col("island_id").alias("home")), [key, "team"], "left")
    ended = last.select(*LIFE, death_region(F.col("location_type"), F.col("island_id"), F.col("home")).alias("death_region"))
    met = rows.where("y > 0").join(depths.select(key, "team", F.col("node").alias("node_id"), "depth", "objective"), [key, "team", "node_id"], "left")
    reach = F.when(F.col("depth").isNotNull(), F.struct("depth", "t", "row_id", "objective"))
    order = F.array_sort(F.collect_list(F.struct("t", "row_id", "node_id")))
    found = met.groupBy(*LIFE).agg(F.count("*").alias("samples"), order.alias("o"), F.min(reach).alias("r")).where(F.col("samples") >= least)
    sequence = F.array_join(F.transform("o", lambda s: s["node_id"].cast("string")), ",")
    return found.select(*LIFE, "samples", sequence.alias("node_sequence"), F.col("r.depth").alias("max_attack_depth"), F.col("r.t").alias("first_reach"), F.col("r.objective").alias("target")).join(ended, LIFE, "left")


def region_visits_of(visits: DataFrame, matches: list[int] | None = None, life: tuple[int, int, int] | None = None) -> DataFrame:
    """Visits of some matches or one life, with ``nodes``, their path as an array of numbers (empty without one)."""
    rows = visits if matches is None else visits.where(F.col("match_id").isin(matches))
    if life is not None:
        for name, value in zip(LIFE, life, strict=True):
            rows = rows.where(F.col(name) == value)
    nodes = F.coalesce(F.transform(F.filter(F.split("node_path", ","), lambda x: x != ""), lambda x: x.cast("int")), F.array().cast("array<int>"))
    return rows.withColumn("nodes", nodes)
