"""Lives and other sessions of a match log.

A log has a row for each event: ``match_id, player_id, row_id, t, event_type, x, y, z,
victim_id, wool_id``; ``t`` is in seconds, ``row_id`` breaks ties. Event types: 2 spawn,
3 kill, 4 death, 5 position, 6 touch, 7 capture. Players are known within a match only,
so each window is partitioned by match and player, or by match and objective.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLAYER = ["match_id", "player_id"]
LIFE = [*PLAYER, "segment_idx"]
SPAWN, KILL, DEATH, POSITION, TOUCH, CAPTURE = range(2, 8)


def asof_segment(log: DataFrame) -> DataFrame:
    """Number of the player's last spawn at or before each event; null before the first.

    Spawns of the same second come first. One window, one shuffle on the player's key.
    """
    order = Window.partitionBy(*PLAYER).orderBy("t", (F.col("event_type") != SPAWN).cast("int"), "row_id")
    spawned = F.sum((F.col("event_type") == SPAWN).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return log.withColumn("segment_idx", F.when(spawned >= 0, spawned).cast("int"))


def ordinals(log: DataFrame, kinds: list[int], name: str = "ordinal") -> DataFrame:
    """Events of these kinds with their number (from 0) among the player's events of the kind."""
    order = Window.partitionBy(*PLAYER, "event_type").orderBy("t", "row_id")
    return log.where(F.col("event_type").isin(kinds)).withColumn(name, (F.row_number().over(order) - 1).cast("int"))


def life_segments(log: DataFrame) -> DataFrame:
    """One row per spawn: the nth spawn pairs with the player's nth death, else its last event.

    Counts of a life are those of the events that fall to it by ``asof_segment``; missing
    counts are 0.
    """
    tagged = asof_segment(log)
    last = log.groupBy(*PLAYER).agg(F.max("t").alias("last_t"))
    nth = ordinals(log, [SPAWN, DEATH], "segment_idx")
    spawns = nth.where(F.col("event_type") == SPAWN).select(*LIFE, F.col("t").alias("start_timestamp"), F.col("x").alias("spawn_x"), F.col("z").alias("spawn_z"))
    deaths = nth.where(F.col("event_type") == DEATH).select(*LIFE, F.col("t").alias("death_t"))
    kinds = {"position_count": POSITION, "kill_count": KILL, "wool_touches": TOUCH, "wool_captures": CAPTURE}
    counts = tagged.where("event_type in (3, 5, 6, 7) and segment_idx is not null").groupBy(*LIFE).agg(*(F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()))
    end = F.coalesce("death_t", "last_t")
    return (
        spawns.join(deaths, LIFE, "left").join(last, PLAYER, "left").join(counts, LIFE, "left")
        .select(*LIFE, "start_timestamp", end.alias("end_timestamp"), (end - F.col("start_timestamp")).alias("duration"),
                F.when(F.col("death_t").isNull(), "match_end").otherwise("death").alias("outcome"), "spawn_x", "spawn_z", *(F.coalesce(n, F.lit(0)).alias(n) for n in kinds))
    )


def closed_spans(log: DataFrame) -> DataFrame:
    """``match_id, player_id, segment_idx, start_timestamp, end_timestamp`` of lives that end with a death."""
    nth = ordinals(log, [SPAWN, DEATH], "segment_idx")
    ends = nth.where(F.col("event_type") == DEATH).select(*LIFE, F.col("t").alias("end_timestamp"))
    return nth.where(F.col("event_type") == SPAWN).select(*LIFE, F.col("t").alias("start_timestamp")).join(ends, LIFE)


def interval_lookup(events: DataFrame, spans: DataFrame) -> DataFrame:
    """``events`` with the first of the player's spans that holds them, both ends included; null outside all.

    Differs from ``asof_segment`` between a death and the next spawn.
    """
    held = events.select(*PLAYER, "row_id", "t").join(spans, PLAYER).where(F.col("t").between(F.col("start_timestamp"), F.col("end_timestamp")))
    first = held.groupBy("match_id", "row_id").agg(F.min("segment_idx").alias("segment_idx"))
    return events.join(first, ["match_id", "row_id"], "left")


def sampling_gaps(log: DataFrame) -> DataFrame:
    """``match_id, gap``: seconds from each position of a player to the one before it."""
    order = Window.partitionBy(*PLAYER).orderBy("t", "row_id")
    return log.where(F.col("event_type") == POSITION).withColumn("gap", F.col("t") - F.lag("t").over(order)).select("match_id", "gap")


def median_gap(log: DataFrame, below: int = 30) -> DataFrame:
    """Median gap of each match over gaps between 0 and ``below`` seconds, both excluded."""
    return sampling_gaps(log).where((F.col("gap") > 0) & (F.col("gap") < below)).groupBy("match_id").agg(F.median("gap").alias("median_gap"))


def log_interval(log: DataFrame) -> DataFrame:
    """Sampling interval of each match: 5 s where the median positive gap is 4 or more, else 2 s."""
    gap = F.median(F.when(F.col("gap") > 0, F.col("gap")))
    return sampling_gaps(log).groupBy("match_id").agg(F.when(gap >= 4, 5).otherwise(2).alias("log_interval"))


def gap_sessions(rows: DataFrame, keys: list[str], time: str, limit: int, name: str, tie: str = "row_id") -> DataFrame:
    """``rows`` with the number of their session: a new one starts after more than ``limit`` seconds."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(order) > limit).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def wool_waves(log: DataFrame, limit: int = 120) -> DataFrame:
    """Waves of touches of one objective: first and last second, touches and distinct carriers."""
    waves = gap_sessions(log.where(F.col("event_type") == TOUCH), ["match_id", "wool_id"], "t", limit, "wave_idx")
    return waves.groupBy("match_id", "wool_id", "wave_idx").agg(F.min("t").alias("start_timestamp"), F.max("t").alias("end_timestamp"), F.count("*").alias("touches"), F.count_distinct("player_id").alias("n_carriers"))


def at_first(value: str | Column, *order: str) -> Column:
    return F.min_by(value, F.struct(*order))


def at_last(value: str | Column, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def carry_chains(log: DataFrame, teams: DataFrame, limit: int = 120, lead: int = 60, high: int = 22, void_below: int = 0) -> DataFrame:
    """One row per wave of touches: carriers, hand-offs, attacking team, outcome, first and final place, approach.

    ``teams`` are closed intervals ``match_id, player_id, team, start_timestamp,
    end_timestamp`` (open: null); of several that hold the first touch the earliest counts,
    of equal starts the smallest ``team_segment_id``, if there is one. A wave ends with the first capture of its objective at or
    after its first touch; else with the first death, from the first touch on, of its last
    carrier (``dropped_void`` below ``void_below``, else ``dropped_land``); else it is
    ``incomplete``. The approach is by the first carrier's greatest height in the ``lead``
    seconds before the first touch. Several waves may claim one capture.
    """
    wave = ["match_id", "wool_id", "wave_idx"]
    touches = gap_sessions(log.where(F.col("event_type") == TOUCH), ["match_id", "wool_id"], "t", limit, "wave_idx")
    order = Window.partitionBy(*wave).orderBy("t", "row_id")
    changed = touches.withColumn("change", (F.lag("player_id").over(order) != F.col("player_id")).cast("int"))
    rows = changed.groupBy(*wave).agg(
        F.count_distinct("player_id").alias("n_carriers"), F.coalesce(F.sum("change"), F.lit(0)).alias("n_handoffs"), F.min("t").alias("start_timestamp"), F.max("t").alias("last_touch"),
        at_first("player_id", "t", "row_id").alias("first_carrier"), at_last("player_id", "t", "row_id").alias("last_carrier"),
        *(at_first(c, "t", "row_id").alias(f"first_{c}") for c in "xyz"), *(at_last(c, "t", "row_id").alias(f"last_{c}") for c in "xyz"),
    )
    tie = [c for c in teams.columns if c == "team_segment_id"]
    side = rows.select(*wave, "start_timestamp", F.col("first_carrier").alias("player_id")).alias("w").join(teams.alias("s"), PLAYER)
    held = (F.col("s.start_timestamp") <= F.col("w.start_timestamp")) & (F.col("s.end_timestamp").isNull() | (F.col("s.end_timestamp") >= F.col("w.start_timestamp")))
    attackers = side.where(held).groupBy(*wave).agg(at_first("team", "s.start_timestamp", *tie).alias("attacking_team"))
    taken = log.where(F.col("event_type") == CAPTURE).select("match_id", "wool_id", F.col("t").alias("cap_t"), "row_id", *(F.col(c).alias(f"cap_{c}") for c in "xyz"))
    caught = rows.select(*wave, "start_timestamp").join(taken, ["match_id", "wool_id"]).where("cap_t >= start_timestamp")
    caught = caught.groupBy(*wave).agg(F.min(F.struct("cap_t", "row_id", "cap_x", "cap_y", "cap_z")).alias("cap"))
    deaths = log.where(F.col("event_type") == DEATH).select("match_id", F.col("player_id").alias("last_carrier"), F.col("t").alias("death_t"), "row_id", F.col("y").alias("death_y"))
    fell = rows.select(*wave, "start_timestamp", "last_carrier").join(deaths, ["match_id", "last_carrier"]).where("death_t >= start_timestamp")
    fell = fell.groupBy(*wave).agg(F.min(F.struct("death_t", "row_id", "death_y")).alias("fall"))
    seen = log.where(F.col("event_type") == POSITION).select("match_id", F.col("player_id").alias("first_carrier"), F.col("t").alias("seen_t"), F.col("y").alias("seen_y"))
    near = rows.select(*wave, "start_timestamp", "first_carrier").join(seen, ["match_id", "first_carrier"]).where(F.col("seen_t").between(F.greatest(F.lit(0), F.col("start_timestamp") - lead), F.col("start_timestamp")))
    near = near.groupBy(*wave).agg(F.max("seen_y").alias("max_y_before_touch"))
    joined = rows
    for more in (attackers, caught, fell, near):
        joined = joined.join(more, wave, "left")
    captured, dropped = F.col("cap").isNotNull(), F.col("fall").isNotNull()
    end = F.when(captured, F.col("cap.cap_t")).when(dropped, F.col("fall.death_t")).otherwise(F.col("last_touch"))
    return joined.select(
        *wave, "attacking_team", "n_carriers", "n_handoffs", "start_timestamp", end.alias("end_timestamp"), (end - F.col("start_timestamp")).cast("double").alias("duration_s"),
        F.when(captured, "captured").when(dropped & (F.col("fall.death_y") < void_below), "dropped_void").when(dropped, "dropped_land").otherwise("incomplete").alias("outcome"),
        "first_x", "first_y", "first_z", *(F.when(captured, F.col(f"cap.cap_{c}")).otherwise(F.col(f"last_{c}")).alias(f"final_{c}") for c in "xyz"), "max_y_before_touch",
        F.when(F.col("max_y_before_touch") >= high, "skybridge").when(F.col("max_y_before_touch").isNotNull(), "ground").alias("approach_type"),
    )


def kill_death_pairs(log: DataFrame) -> DataFrame:
    """Each kill with the victim's deaths in the same second; all of them, if there are several."""
    kills = log.where(F.col("event_type") == KILL).select("match_id", "t", F.col("player_id").alias("killer"), "victim_id", F.col("row_id").alias("kill_row"), F.col("x").alias("kill_x"), F.col("z").alias("kill_z"))
    deaths = log.where(F.col("event_type") == DEATH).select("match_id", "t", F.col("player_id").alias("victim_id"), F.col("row_id").alias("death_row"), F.col("x").alias("death_x"), F.col("z").alias("death_z"))
    return kills.join(deaths, ["match_id", "t", "victim_id"])


def kill_distances(log: DataFrame) -> DataFrame:
    """Pairs, mean and greatest distance between killer and victim of each match."""
    far = F.hypot(F.col("kill_x") - F.col("death_x"), F.col("kill_z") - F.col("death_z"))
    return kill_death_pairs(log).groupBy("match_id").agg(F.count("*").alias("pairs"), F.round(F.avg(far), 6).alias("mean_distance"), F.round(F.max(far), 6).alias("max_distance"))
