"""Valid-time joins: events to the team (or other state) that held at their second.

Intervals have ``match_id, player_id, team_segment_id, team, start_timestamp,
end_timestamp``; a null end is open. Joins carry equality on match and player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.sessions import PLAYER, SPAWN


def holds(t: Column, start: Column, end: Column, right_closed: bool = False) -> Column:
    """Whether an interval holds a second: from its start on, up to its end, which counts only if ``right_closed``."""
    return (t >= start) & (end.isNull() | ((t <= end) if right_closed else (t < end)))


def team_segments(spawns: DataFrame) -> DataFrame:
    """Intervals of equal teams from ``spawns (match_id, player_id, row_id, t, team)``; the last is open."""
    order = Window.partitionBy(*PLAYER).orderBy("t", "row_id")
    changed = spawns.withColumn("before", F.lag("team").over(order)).where(F.col("before").isNull() | (F.col("before") != F.col("team")))
    return changed.select(*PLAYER, F.col("row_id").alias("team_segment_id"), "team", F.col("t").alias("start_timestamp"), F.lead("t").over(order).alias("end_timestamp"))


def spawn_teams(log: DataFrame, team: Column) -> DataFrame:
    """Spawns of the log with ``team`` computed from their place."""
    return log.where(F.col("event_type") == SPAWN).select(*PLAYER, "row_id", "t", team.alias("team"))


def nearest_team(spawns: DataFrame, centres: DataFrame) -> DataFrame:
    """Team of each spawn ``(map_id, row_id, x, z)``: the first whose bounds hold it, else that of the nearest centre, else unknown.

    ``centres``: ``map_id, ord, team, x, z, min_x, max_x, min_z, max_z``; bounds may be
    null; of equal distances the lower ``ord`` wins. Centres of a map are few.
    """
    c = centres.select("map_id", "ord", "team", F.col("x").alias("cx"), F.col("z").alias("cz"), "min_x", "max_x", "min_z", "max_z")
    inside = F.coalesce(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("z").between(F.col("min_z"), F.col("max_z")), F.lit(False))
    far = F.when(inside, 0.0).otherwise(F.hypot(F.col("x") - F.col("cx"), F.col("z") - F.col("cz")))
    best = spawns.select("map_id", "row_id", "x", "z").join(c, "map_id").groupBy("map_id", "row_id").agg(F.min_by("team", F.struct((~inside).cast("int"), far, "ord")).alias("team"))
    return spawns.join(best, ["map_id", "row_id"], "left").withColumn("team", F.coalesce("team", F.lit("unknown")))


def with_team(events: DataFrame, teams: DataFrame, who: str = "player_id", right_closed: bool = False, how: str = "left", name: str = "team") -> DataFrame:
    """``events`` with the team of player ``who``: a row for each interval that holds the event's second."""
    s = teams.select(F.col("match_id").alias("__m"), F.col("player_id").alias("__p"), F.col("team").alias(name), F.col("start_timestamp").alias("__s"), F.col("end_timestamp").alias("__e"))
    held = (F.col("match_id") == F.col("__m")) & (F.col(who) == F.col("__p")) & holds(F.col("t"), F.col("__s"), F.col("__e"), right_closed)
    return events.join(s, held, how).drop("__m", "__p", "__s", "__e")


def team_at(events: DataFrame, teams: DataFrame) -> DataFrame:
    """``events (match_id, row_id, player_id, t)`` with one team: the first closed interval that holds, else the last that has started."""
    s = teams.select(*PLAYER, "team_segment_id", "team", F.col("start_timestamp").alias("s"), F.col("end_timestamp").alias("e"))
    begun = events.select("match_id", "row_id", "player_id", "t").join(s, PLAYER).where("s <= t")
    inside = F.when(F.col("e").isNull() | (F.col("t") <= F.col("e")), F.struct("s", "team_segment_id"))
    best = begun.groupBy("match_id", "row_id").agg(F.min_by("team", inside).alias("held"), F.max_by("team", F.struct("s", "team_segment_id")).alias("last"))
    return events.join(best, ["match_id", "row_id"], "left").withColumn("team", F.coalesce("held", "last")).drop("held", "last")


def first_teams(teams: DataFrame) -> DataFrame:
    """The first team of each player."""
    return teams.groupBy(*PLAYER).agg(F.min_by("team", F.struct("start_timestamp", "team_segment_id")).alias("team"))


def overlapping(teams: DataFrame) -> DataFrame:
    """Intervals that start before an earlier one of the same player has ended.

    A running maximum of ends instead of a self-join: linear in a player's intervals.
    """
    order = Window.partitionBy(*PLAYER).orderBy("start_timestamp", "team_segment_id")
    reach = F.max(F.coalesce("end_timestamp", F.lit(9_999_999_999))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return teams.withColumn("reach", reach).where("start_timestamp < reach").select(*PLAYER, "team_segment_id", "team")


def switchers(teams: DataFrame) -> DataFrame:
    """Players of two teams or more, with the list of their teams in order."""
    rows = F.array_sort(F.collect_list(F.struct("start_timestamp", "team_segment_id", "team")))
    grouped = teams.groupBy(*PLAYER).agg(F.count("*").alias("team_segments"), F.count_distinct("team").alias("n_teams"), F.min("start_timestamp").alias("first_start"), F.array_join(F.transform(rows, lambda r: r["team"]), ",").alias("team_sequence"))
    return grouped.where("n_teams > 1")


def friendly_fire(log: DataFrame, teams: DataFrame) -> DataFrame:
    """Kills whose killer and victim are of one known team at that second."""
    both = with_team(with_team(log.where("event_type = 3"), teams, how="inner"), teams, "victim_id", how="inner", name="victim_team")
    return both.where("team = victim_team and team <> 'unknown'").select("match_id", "row_id", F.col("player_id").alias("killer"), F.col("victim_id").alias("victim"), "team", "t")


def kills_deaths(events: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """Kills and deaths of each team within ``keys``; null for players without a team."""
    combat = with_team(events.where("event_type in (3, 4)"), teams)
    return combat.groupBy(*keys, "team").agg(F.count_if(F.col("event_type") == 3).alias("kills"), F.count_if(F.col("event_type") == 4).alias("deaths"))
