"""The registered queries over lives, teams, matches, chests and columns: operators on adapted inputs.

Each entry of ``QUERIES`` takes the inputs of a folder; its oracle of the same name is in
``plans/oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.operators import blocks, chests, graph, intervals, matchstats, objectives, paths, sessions, spatial, trajectories
from matchspark.plans.inputs import Inputs
from matchspark.session import cut


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name or c)


def busy_graph(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Cells of a match with two samples or more, and the links between those that touch along a side, 5 blocks long."""
    nodes = cut(trajectories.occupied_cells(i.samples).where("occupation >= 2"))
    edges = graph.adjacency(nodes, "match_id").withColumn("weight", F.lit(5.0))
    spell = lambda df, *names: df.select("*", *(F.col(n).cast("long").alias(f"_{n}") for n in names)).drop(*names).withColumnsRenamed({f"_{n}": n for n in names})
    return spell(nodes, "node_id").withColumnRenamed("node_id", "node"), spell(edges, "src", "dst")


def busy_component(i: Inputs) -> DataFrame:
    nodes, edges = busy_graph(i)
    return paths.largest_component(nodes.select("match_id", "node"), edges, "match_id")


def wool_distances(i: Inputs) -> DataFrame:
    """Distances in each match's graph from every node where an objective was captured."""
    nodes, edges = busy_graph(i)
    cell = lambda c: trajectories.grid_floor(c, 5).alias(f"c{c}")
    taken = i.log.where(F.col("event_type") == sessions.CAPTURE).select("match_id", cell("x"), cell("z")).distinct()
    sources = nodes.join(taken, ["match_id", "cx", "cz"]).select("match_id", "node")
    return paths.shortest_distances(sources, edges, "match_id", by_source=True).select("match_id", "source", "node", "distance")


def placed(i: Inputs, positions: DataFrame | None = None) -> DataFrame:
    """Events with ``map_id`` of five maps, ``location_type`` and ``island_id``."""
    rows = i.log if positions is None else positions
    return spatial.classify(rows.withColumn("map_id", F.col("match_id") % 5), i.areas)


def cell_occupation(i: Inputs) -> DataFrame:
    return trajectories.cell_occupation(placed(i, i.log.where("event_type = 5 and y > 0")), ["match_id"])


def dominant_location(i: Inputs) -> DataFrame:
    rows = placed(i, i.log.where("event_type = 5")).withColumn("cx", trajectories.grid_floor("x", 5)).withColumn("cz", trajectories.grid_floor("z", 5))
    return trajectories.dominant(rows, ["match_id", "cx", "cz"], "location_type")


def nearest_team_segments(i: Inputs) -> DataFrame:
    d = i.adapted("diamonds").where("kind = 'island'")
    centres = d.select("map_id", F.col("polygon_id").alias("ord"), F.concat(F.lit("team"), F.col("polygon_id")).alias("team"), F.col("cx").alias("x"), F.col("cz").alias("z"), *((F.col(c) + s * 3).alias(n) for c, s, n in (("cx", -1, "min_x"), ("cx", 1, "max_x"), ("cz", -1, "min_z"), ("cz", 1, "max_z"))))
    spawns = intervals.nearest_team(i.log.where("event_type = 2").withColumn("map_id", F.col("match_id") % 5), centres)
    return intervals.team_segments(spawns).drop("team_segment_id")


def wool_locations(i: Inputs) -> DataFrame:
    rows = objectives.wool_locations(i.firsts.withColumn("map_id", F.col("match_id") % 5), radius=20)
    return rows.select("map_id", "wool_id", *(r6(c) for c in ("x", "z")), "source", "first_touch_count", *(r6(c) for c in ("x_std", "z_std")))


def monuments(i: Inputs) -> DataFrame:
    return objectives.monuments(i.log, ["match_id"])


def cell_runs(i: Inputs) -> DataFrame:
    cell = (F.floor((F.col("x") + 32) / 16) * 100 + F.floor((F.col("z") + 32) / 16)).cast("int")
    return trajectories.runs(i.log.where("event_type = 5").withColumn("cell", cell), sessions.PLAYER, "cell")


def cell_transitions(i: Inputs) -> DataFrame:
    cell = (F.floor((F.col("x") + 32) / 5) * 100 + F.floor((F.col("z") + 32) / 5)).cast("int")
    return trajectories.transitions(i.log.where("event_type = 5 and y > 0").withColumn("cell", cell), ["match_id"], sessions.PLAYER, "cell")


def depth_series(i: Inputs) -> DataFrame:
    depth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.hypot("x", "z") / 45.0))
    return trajectories.depth_series(i.samples, i.log.where("event_type = 4"), depth).select("match_id", "minute", r6("mean_depth"), r6("sd_depth"), "deaths")


def map_gaps(i: Inputs) -> DataFrame:
    pauses = matchstats.pauses(i.matches, least_minutes=100)
    slug = lambda key, name: i.maps.select(F.col("map_id").alias(key), F.col("map_slug").alias(name))
    return pauses.join(slug("map_id", "before_slug"), "map_id").join(slug("next_map", "after_slug"), "next_map").select("match_id", "next_match", "before_slug", "after_slug", "gap_seconds", "duration", "gap_duration")


def clearance(i: Inputs) -> DataFrame:
    positions = i.log.where("event_type = 5").select((F.col("match_id") % 5).alias("map_id"), "x", "y", "z")
    surface = blocks.top_surface(i.blocks).select("map_id", "x", "z", F.col("y").alias("surface_y"))
    return blocks.clearance(positions, surface)


def staged_gap(i: Inputs) -> DataFrame:
    return sessions.median_gap(i.log).join(i.staged.select("match_id", "map_slug").distinct(), "match_id").select("map_slug", "match_id", "median_gap")


WOODS = {"combat": "STEEL", "weapon": "BRASS", "supply": "TIN"}

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "a1_life_segments": lambda i: sessions.life_segments(i.log),
    "q4a_life_outcomes": lambda i: sessions.life_segments(i.log).join(i.staged.select("match_id", "map_slug").distinct(), "match_id").groupBy("map_slug", "outcome").agg(F.count("*").alias("n")),
    "g2_largest_component": busy_component,
    "g6_shortest_distances": wool_distances,
    "q1a_maps_with_matches": lambda i: matchstats.maps_with_matches(i.maps, i.matches).withColumn("avg_duration", r6("avg_duration")),
    "q1d_processing_status": lambda i: i.matches.groupBy("processed").agg(F.count("*").alias("n")),
    "a18_match_statistics": lambda i: matchstats.statistics(i.matches),
    "w11_map_size_buckets": lambda i: matchstats.buckets_by_rank(i.maps.select("map_id", "total_blocks"), "total_blocks", "map_id", 5),
    "q7a_match_gaps": map_gaps,
    "j15_maps_without_matches": lambda i: matchstats.lacking(i.maps.select("map_id", "map_slug"), i.matches.where("processed"), ["map_id"]),
    "a40_match_coverage": lambda i: matchstats.match_coverage(i.matches),
    "w20_weekly_longest": lambda i: matchstats.weekly_longest(i.matches),
    "q9a_zone_category_share": lambda i: chests.share_of(i.chests, ["zone"], "category").withColumn("pct", r6("pct")),
    "q9d_category_summary": lambda i: chests.summary(i.chests, "category").withColumn("pct", r6("pct")),
    "l2_top_surface": lambda i: blocks.top_surface(i.blocks, 28),
    "l5_lowest_solid": lambda i: blocks.lowest_solid(i.blocks),
    "l6_vertical_segments": lambda i: blocks.vertical_segments(i.blocks),
    "a15_block_inventory": lambda i: blocks.block_inventory(i.blocks),
    "j8_kill_death_pairs": lambda i: sessions.kill_death_pairs(i.log).select("match_id", "t", "killer", "victim_id", "kill_row", "death_row"),
    "a12_wool_waves": lambda i: sessions.wool_waves(i.log, 12),
    "a10_wool_monuments": monuments,
    "w2_first_touch": lambda i: i.firsts.select("match_id", "wool_id", "player_id", "t"),
    "a4_cell_occupation": cell_occupation,
    "a24_population_curve": lambda i: objectives.population(i.log),
    "j4_events_with_team_closed": lambda i: intervals.with_team(i.log.where("event_type in (3, 4)"), i.teams, right_closed=True).select("match_id", "row_id", "player_id", "t", "team"),
    "q4b_events_with_team": lambda i: intervals.with_team(i.log.where("event_type in (3, 4)"), i.teams).select("match_id", "row_id", "player_id", "event_type", "t", "team", "victim_id"),
    "q4c_friendly_fire": lambda i: intervals.friendly_fire(i.log, i.teams),
    "q4d_team_kills_deaths": lambda i: intervals.kills_deaths(i.staged, i.teams, ["map_slug"]),
    "q2b_team_distribution": lambda i: i.teams.join(i.staged.select("match_id", "map_slug").distinct(), "match_id").groupBy("map_slug", "team").agg(F.count("*").alias("segments"), F.count_distinct("player_id").alias("players")),
    "q2c_overlapping_segments": lambda i: intervals.overlapping(i.teams.withColumn("end_timestamp", F.col("end_timestamp") + 40)),
    "q2d_team_switchers": lambda i: intervals.switchers(i.teams),
    "j7_first_team": lambda i: intervals.first_teams(i.teams),
    "q2e_matches_without_teams": lambda i: matchstats.lacking(i.matches.where("processed").select("match_id", "map_id", "player_count"), i.teams, ["match_id"]),
    "a11_wool_objectives": lambda i: objectives.capturing_teams(i.log, i.teams),
    "a32_attacking_team": lambda i: objectives.attacking_team(i.log, i.teams, ["match_id", "wool_id"]),
    "w14_first_capture": lambda i: objectives.first_captures(i.log, i.teams),
    "w13_objective_rank": lambda i: objectives.capture_ranks(i.log),
    "w9_sampling_gap": lambda i: sessions.median_gap(i.log).withColumn("median_gap", r6("median_gap")),
    "a2_log_interval": lambda i: sessions.log_interval(i.log),
    "a5_cell_transitions": cell_transitions,
    "w5_cell_runs": cell_runs,
    "a9_wool_locations": wool_locations,
    "a42_kill_distance": lambda i: sessions.kill_distances(i.log),
    "q5c_orphans": lambda i: matchstats.orphans({n: i.log.where(F.col("event_type").isin(k)) for n, k in (("combat_events", [3, 4]), ("position_events", [5]), ("wool_events", [6, 7]))}, i.matches.where("processed"), ["match_id"]),
    "q1e_unprocessed_matches": lambda i: i.matches.where("not processed").join(i.maps, "map_id").select("match_id", "map_slug"),
    "q5f_duplicate_matches": lambda i: matchstats.repeated(i.matches, ["map_id", "match_start"]),
    "q9b_zone_materials": lambda i: chests.zone_items(i.chests, "R"),
    "q9c_defence_density": lambda i: chests.defence_density(i.chests, "R", "A").withColumn("items_per_wool", r6("items_per_wool")),
    "q9e_maps_without_defence": lambda i: chests.maps_without(i.chests.select(F.col("chest_id").alias("map_id"), F.col("map_id").alias("chest_id"), "zone", "category"), "R", "Brand#11"),
    "a14_chest_categories": lambda i: chests.first_match(i.chests, WOODS, "defence"),
    "a41_match_thresholds": lambda i: matchstats.thresholds(i.maps, i.matches, ["size_tier", "team_count"]),
    "a39_daily_summary": lambda i: matchstats.daily_summary(i.matches),
    "l7_vertical_density": lambda i: blocks.column_fill(i.blocks).withColumn("density", r6("density")),
    "w18_longest_row_run": lambda i: blocks.longest_row_runs(i.blocks.where("block_id < 3")),
    "a22_terrain_clearance": clearance,
    "j2_interval_lookup": lambda i: sessions.interval_lookup(i.log.where("event_type in (3, 6, 7)"), sessions.closed_spans(i.log)).select("match_id", "row_id", "segment_idx"),
    "w1_player_ordinal": lambda i: sessions.ordinals(i.log, [2, 4]).select("match_id", "player_id", "row_id", "ordinal"),
    "w3_last_position": lambda i: trajectories.last_positions(i.samples),
    "w8_previous_cell": lambda i: i.samples.select(*sessions.LIFE, "row_id", "cx", "cz", "before_cx", "before_cz", (F.col("t") - F.col("before_t")).alias("dt")),
    "w22_deduplicated_cells": lambda i: trajectories.without_repeats(i.samples).select(*sessions.LIFE, "row_id", "cx", "cz"),
    "w12_event_share": lambda i: chests.share_of(i.log.withColumn("every", F.lit(1)), ["every"], "event_type").select("event_type", "n", r6("pct")),
    "w15_climbs": lambda i: trajectories.climbs(i.samples).select(*sessions.LIFE, "row_id", "t", "low_t"),
    "w21_cumulative_share": lambda i: trajectories.cumulative_share(trajectories.occupied_cells(i.samples), ["match_id"], "occupation", "node_id").select("match_id", "node_id", "occupation", r6("share", digits=9)),
    "a6_life_path": lambda i: trajectories.life_paths(i.samples).select(*sessions.LIFE, "samples", "unique_cells", *(r6(c) for c in ("path", "span", "tortuosity"))),
    "a8_life_height": lambda i: trajectories.life_heights(i.samples).select(*sessions.LIFE, *(r6(c, digits=9) for c in ("mean_y", "high_share"))),
    "a16_block_ids": lambda i: i.blocks.select("map_id", "block_id").distinct(),
    "a17_surface_blocks": lambda i: blocks.surface_counts(i.blocks),
    "a19_excavation": lambda i: trajectories.lowest_floors(i.staged.where("event_type = 5"), ["map_slug"]),
    "a23_dominant_location": dominant_location,
    "a29_sky_cells": lambda i: trajectories.sky_cells(i.samples),
    "a35_depth_series": depth_series,
    "a36_top_player": lambda i: trajectories.dominant(i.log.where("event_type = 3"), ["match_id"], "player_id").withColumnRenamed("n", "kills"),
    "l1_ground_layer": lambda i: blocks.ground_layer(i.blocks),
    "l4_lowest_bedrock": lambda i: blocks.lowest_bedrock(i.blocks),
    "l7_resource_blocks": lambda i: blocks.resource_blocks(i.blocks),
    "w19_longest_column_run": lambda i: blocks.longest_column_runs(i.blocks),
    "g11_cell_adjacency": lambda i: graph.adjacency(trajectories.occupied_cells(i.samples), "match_id"),
    "g17_team_distances": lambda i: objectives.team_distances(i.centres, "match_id").withColumn("distance", r6("distance")),
    "g21_team_segments": nearest_team_segments,
    "q0a_maps": lambda i: i.maps.select("map_id", "map_slug"),
    "q1b_map_sampling_gap": staged_gap,
    "q1c_matches": lambda i: i.matches.join(i.maps, "map_id").select("match_id", "map_id", "map_slug", "match_duration", "player_count", "processed"),
    "q1f_row_counts": lambda i: matchstats.row_counts({"match_log": i.log, "matches": i.matches, "maps": i.maps, "chests": i.chests}),
    "q1g_spawns": lambda i: i.staged.where("event_type = 2").groupBy("map_slug", "x", "z").agg(F.count("*").alias("n")),
    "q5g_maps_without_spawns": lambda i: matchstats.lacking(i.maps.select("map_id", "map_slug"), i.staged.where("event_type = 2"), ["map_id"]),
    "q6a_marker_share": lambda i: blocks.marker_share(i.blocks).withColumn("pct", r6("pct")),
}
