"""Registered queries over places, islands, graphs, visits and integrity, each beside its oracle.

``QUERIES``: name -> (operator on adapted inputs, names of oracle inputs, DuckDB SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators import blocks, chests, graph, intervals, matchstats, objectives, paths, sessions, shapes, spatial, trajectories
from matchspark.plans.inputs import Inputs
from matchspark.plans.match_queries import placed, r6
from matchspark.session import cut

LIFE = sessions.LIFE
QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], list[str], str]] = {}


def query(inputs: str, sql: str):
    """Register a function under its name with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = (f, inputs.split(), sql)
        return f

    return keep


POSITIONS = "event_type = 5"


@query("log diamonds placed", "SELECT match_id, row_id, location_type, island_id FROM placed WHERE event_type = 5")
def j9_point_classification(i: Inputs) -> DataFrame:
    return placed(i, i.log.where(POSITIONS)).select("match_id", "row_id", "location_type", "island_id")


NEAREST = """(SELECT d.polygon_id FROM diamonds d WHERE d.kind = 'island' AND d.map_id = e.match_id % 5 ORDER BY (e.x - d.cx) * (e.x - d.cx) + (e.z - d.cz) * (e.z - d.cz), d.polygon_id LIMIT 1)"""


@query("log diamonds", f"SELECT match_id, row_id, node_id, round(sqrt((x - d.cx) * (x - d.cx) + (z - d.cz) * (z - d.cz)), 6) AS distance FROM (SELECT e.*, {NEAREST} AS node_id FROM match_log e WHERE event_type = 5) p JOIN diamonds d ON p.node_id = d.polygon_id")
def j11_nearest_node(i: Inputs) -> DataFrame:
    nodes = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("polygon_id").alias("node_id"), F.col("cx").alias("x"), F.col("cz").alias("z"))
    return spatial.snapped(i.log.where(POSITIONS).withColumn("map_id", F.col("match_id") % 5), nodes).select("match_id", "row_id", "node_id", r6("distance"))


@query("log teams", """SELECT match_id, row_id, coalesce((SELECT team FROM teams s WHERE s.match_id = e.match_id AND s.player_id = e.player_id AND s.start_timestamp <= e.t AND (s.end_timestamp IS NULL OR e.t <= s.end_timestamp) ORDER BY s.start_timestamp, s.team_segment_id LIMIT 1),
  (SELECT team FROM teams s WHERE s.match_id = e.match_id AND s.player_id = e.player_id AND s.start_timestamp <= e.t ORDER BY s.start_timestamp DESC, s.team_segment_id DESC LIMIT 1)) AS team FROM match_log e WHERE event_type IN (3, 4)""")  # fmt: skip
def j6_team_at(i: Inputs) -> DataFrame:
    return intervals.team_at(i.log.where("event_type in (3, 4)"), i.teams).select("match_id", "row_id", "team")


TERRAIN = """surface AS (SELECT map_id, x, z, max(y) AS surface_y, min(y) AS lowest_y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3),
 rock AS (SELECT map_id, x, z, y, row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS n, y - row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS g FROM blocks WHERE block_id = 7),
 tops AS (SELECT r.map_id, r.x, r.z, max(r.y) AS bedrock_ceiling_y FROM rock r JOIN rock f ON r.map_id = f.map_id AND r.x = f.x AND r.z = f.z AND f.n = 1 AND r.g = f.g GROUP BY 1, 2, 3)"""


@query("blocks ground", f"{TERRAIN} SELECT g.map_id, g.x, g.z, surface_y, lowest_y, bedrock_ceiling_y FROM ground g JOIN surface s USING (map_id, x, z) LEFT JOIN tops t USING (map_id, x, z)".replace("surface AS", ", surface AS", 1))
def j12_terrain(i: Inputs) -> DataFrame:
    return blocks.terrain(i.cells, i.blocks)


@query("log blocks", ", s AS (SELECT map_id, x, z, max(y) AS surface_y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3) SELECT match_id, row_id, y - (surface_y + 1) AS rel FROM match_log e LEFT JOIN s ON s.map_id = e.match_id % 5 AND s.x = e.x AND s.z = e.z WHERE event_type = 5")
def j13_positions_over_terrain(i: Inputs) -> DataFrame:
    surface = blocks.top_surface(i.blocks).withColumnRenamed("y", "surface_y")
    return blocks.over_terrain(i.log.where(POSITIONS).withColumn("map_id", F.col("match_id") % 5), surface).select("match_id", "row_id", "rel")


@query("log teams", """, w AS (SELECT m.*, sum(new) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) - 1 AS wave_idx FROM (SELECT m.*, CASE WHEN t - lag(t) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) <= 12 THEN 0 ELSE 1 END AS new FROM match_log m WHERE event_type = 6) m),
 c AS (SELECT w.*, CASE WHEN lag(player_id) OVER (PARTITION BY match_id, wool_id, wave_idx ORDER BY t, row_id) <> player_id THEN 1 ELSE 0 END AS hand FROM w),
 v AS (SELECT match_id, wool_id, wave_idx, count(DISTINCT player_id) AS n_carriers, sum(hand) AS n_handoffs, min(t) AS s, max(t) AS last_t, first(player_id ORDER BY t, row_id) AS one, last(player_id ORDER BY t, row_id) AS other,
  first(x ORDER BY t, row_id) AS first_x, first(y ORDER BY t, row_id) AS first_y, first(z ORDER BY t, row_id) AS first_z, last(x ORDER BY t, row_id) AS lx, last(y ORDER BY t, row_id) AS ly, last(z ORDER BY t, row_id) AS lz FROM c GROUP BY 1, 2, 3),
 j AS (SELECT v.*, (SELECT team FROM teams k WHERE k.match_id = v.match_id AND k.player_id = v.one AND k.start_timestamp <= v.s AND (k.end_timestamp IS NULL OR k.end_timestamp >= v.s) ORDER BY k.start_timestamp LIMIT 1) AS attacking_team,
  (SELECT row_id FROM match_log e WHERE e.match_id = v.match_id AND e.wool_id = v.wool_id AND e.event_type = 7 AND e.t >= v.s ORDER BY e.t, e.row_id LIMIT 1) AS cap,
  (SELECT row_id FROM match_log e WHERE e.match_id = v.match_id AND e.player_id = v.other AND e.event_type = 4 AND e.t >= v.s ORDER BY e.t, e.row_id LIMIT 1) AS fall,
  (SELECT max(y) FROM match_log e WHERE e.match_id = v.match_id AND e.player_id = v.one AND e.event_type = 5 AND e.t BETWEEN greatest(0, v.s - 60) AND v.s) AS max_y_before_touch FROM v)
 SELECT j.match_id, j.wool_id, wave_idx, attacking_team, n_carriers, n_handoffs, s AS start_timestamp, coalesce(p.t, d.t, last_t) AS end_timestamp, CAST(coalesce(p.t, d.t, last_t) - s AS DOUBLE) AS duration_s,
  CASE WHEN p.t IS NOT NULL THEN 'captured' WHEN d.y < 10 THEN 'dropped_void' WHEN d.y IS NOT NULL THEN 'dropped_land' ELSE 'incomplete' END AS outcome, first_x, first_y, first_z,
  coalesce(p.x, lx) AS final_x, coalesce(p.y, ly) AS final_y, coalesce(p.z, lz) AS final_z, max_y_before_touch, CASE WHEN max_y_before_touch >= 22 THEN 'skybridge' WHEN max_y_before_touch IS NOT NULL THEN 'ground' END AS approach_type
 FROM j LEFT JOIN match_log p ON p.row_id = cap LEFT JOIN match_log d ON d.row_id = fall""")  # fmt: skip
def a12_carry_chains(i: Inputs) -> DataFrame:
    return sessions.carry_chains(i.log, i.teams, limit=12, void_below=10)


CURVE = ", curve AS (SELECT match_id, CAST(round(t / 60.0) AS INT) AS minute, count(DISTINCT player_id) AS players FROM match_log GROUP BY 1, 2)"


@query("log", f"{CURVE} SELECT match_id, coalesce(max(CASE WHEN minute IN (0, 1, 2) THEN players END), 0) AS early, max(players) AS peak, round(coalesce(max(CASE WHEN minute IN (0, 1, 2) THEN players END), 0) * 1.0 / max(players), 6) AS early_share FROM curve GROUP BY match_id HAVING max(players) >= 3")
def a24_early_share(i: Inputs) -> DataFrame:
    return objectives.early_share(objectives.population(i.log), 3).withColumn("early_share", r6("early_share"))


@query("log", f"{CURVE} SELECT CASE WHEN early < 4 THEN 'under 4' WHEN early < 5 THEN '4-4' ELSE '5 or more' END AS bucket, count(*) AS matches, round(median(t1 / 60.0), 6) AS median_minutes FROM (SELECT match_id, max(players) AS early FROM curve WHERE minute <= 2 GROUP BY 1) c JOIN (SELECT match_id, min(t) AS t1 FROM match_log WHERE event_type = 7 GROUP BY 1) f USING (match_id) WHERE t1 >= 2 AND early >= 2 GROUP BY 1")
def a24_first_capture_by_population(i: Inputs) -> DataFrame:
    return objectives.first_capture_by_population(i.log, objectives.population(i.log), 2, 2, (4, 5)).withColumn("median_minutes", r6("median_minutes"))


@query("log teams", f""", f AS (SELECT * FROM (SELECT e.*, s.team, row_number() OVER (PARTITION BY e.match_id, e.wool_id ORDER BY e.t, e.row_id) AS n FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.event_type = 7) r WHERE n = 1),
 p AS (SELECT e.match_id, e.player_id, e.t, e.x, e.z, s.team FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.{POSITIONS})
 SELECT f.match_id, f.wool_id, f.team, count(DISTINCT CASE WHEN p.team = f.team THEN p.player_id END) AS attackers, count(DISTINCT CASE WHEN p.team <> f.team THEN p.player_id END) AS defenders
 FROM f LEFT JOIN p ON p.match_id = f.match_id AND p.t BETWEEN f.t - 90 AND f.t AND (p.x - f.x) * (p.x - f.x) + (p.z - f.z) * (p.z - f.z) <= 1600 GROUP BY 1, 2, 3""")  # fmt: skip
def a25_reception(i: Inputs) -> DataFrame:
    caught = intervals.with_team(i.log.where("event_type = 7"), i.teams, how="inner")
    return objectives.reception(caught, intervals.with_team(i.log.where(POSITIONS), i.teams, how="inner"))


@query("matches", """, h AS (SELECT match_id, epoch(CAST(match_start AS TIMESTAMP)) AS s, epoch(CAST(match_start AS TIMESTAMP)) + match_duration AS e, unnest(range(CAST(epoch(CAST(match_start AS TIMESTAMP)) AS BIGINT) // 3600 * 3600, CAST(epoch(CAST(match_start AS TIMESTAMP)) AS BIGINT) + match_duration, 3600)) AS h FROM matches WHERE match_duration > 0),
 l AS (SELECT *, timezone('Europe/Berlin', timezone('UTC', to_timestamp(h) AT TIME ZONE 'UTC')) AS local FROM h)
 SELECT CAST(local AS DATE) AS day, CAST(hour(local) AS INT) AS hour, CAST(sum(least(e, h + 3600) - greatest(s, h)) AS BIGINT) AS seconds, count(DISTINCT match_id) AS matches FROM l GROUP BY 1, 2""")  # fmt: skip
def a37_activity(i: Inputs) -> DataFrame:
    return matchstats.activity(i.matches)


@query("matches maps", "SELECT CAST(match_start AS DATE) AS day, CASE min(CASE size_tier WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END) WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'MACHINERY' ELSE 'FURNITURE' END AS tier FROM matches JOIN maps USING (map_id) WHERE size_tier IN ('BUILDING', 'MACHINERY', 'FURNITURE') GROUP BY 1")
def a38_largest_tier(i: Inputs) -> DataFrame:
    return matchstats.largest_tier(i.matches.join(i.maps, "map_id"), ["BUILDING", "MACHINERY", "FURNITURE"])


@query("matches", "SELECT map_id, md5(string_agg(DISTINCT CAST(match_id AS VARCHAR), ',' ORDER BY match_id)) AS fingerprint FROM matches WHERE processed GROUP BY map_id".replace("string_agg(DISTINCT CAST(match_id AS VARCHAR), ',' ORDER BY match_id)", "string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY match_id)"))
def a51_match_set_fingerprint(i: Inputs) -> DataFrame:
    return matchstats.set_fingerprint(i.matches.where("processed"), ["map_id"], "match_id")


@query("chests", "SELECT zone, round(regr_slope(log10(greatest(items, 1)), log10(greatest(n, 1))), 6) AS slope, round(regr_intercept(log10(greatest(items, 1)), log10(greatest(n, 1))), 6) AS intercept FROM (SELECT zone, map_id, count(*) AS n, sum(cnt) AS items FROM chests GROUP BY 1, 2) c GROUP BY zone")
def a52_log_trend(i: Inputs) -> DataFrame:
    rows = i.chests.groupBy("zone", "map_id").agg(F.count("*").alias("n"), F.sum("cnt").alias("items"))
    return matchstats.log_trend(rows, ["zone"], "n", "items")


@query("log teams centres", "SELECT match_id, team, round(x, 6) AS x, round(z, 6) AS z FROM centres")
def a53_team_centres(i: Inputs) -> DataFrame:
    return i.centres.select("match_id", "team", r6("x"), r6("z"))


CLIMBS = """, climbs AS (SELECT h.*, (SELECT max(l.t) FROM samples l WHERE l.match_id = h.match_id AND l.player_id = h.player_id AND l.segment_idx = h.segment_idx AND l.y <= 20 AND (l.t, l.row_id) < (h.t, h.row_id)) AS low_t,
 (SELECT max(l.t) FROM samples l WHERE l.match_id = h.match_id AND l.player_id = h.player_id AND l.segment_idx = h.segment_idx AND l.y >= 40 AND (l.t, l.row_id) < (h.t, h.row_id)) AS high_t FROM samples h WHERE h.y >= 40),
 ups AS (SELECT * FROM climbs WHERE t - low_t <= 90 AND (high_t IS NULL OR high_t < low_t))"""


@query("log lived samples", f"{CLIMBS}, c AS (SELECT match_id, cx, cz, count(*) AS n, median(t - low_t) AS median_seconds FROM ups GROUP BY 1, 2, 3 HAVING count(*) >= 1) SELECT match_id, cx, cz, n, median_seconds, round(sum(n) OVER (PARTITION BY match_id ORDER BY n DESC, cx, cz ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n) OVER (PARTITION BY match_id), 6) AS share FROM c")
def a30_entry_points(i: Inputs) -> DataFrame:
    return trajectories.entry_points(trajectories.climbs(i.samples), 1).withColumn("share", r6("share"))


@query("log lived samples", f"{CLIMBS} SELECT match_id, count(*) AS climbs, median(t - low_t) AS median_seconds, round(avg(CASE WHEN sqrt(x * x + z * z) <= 20 THEN 1.0 ELSE 0 END), 6) AS near_share FROM ups GROUP BY match_id")
def a56_climb_summary(i: Inputs) -> DataFrame:
    near = (F.hypot("x", "z") <= 20).cast("int")
    return trajectories.climbs(i.samples).groupBy("match_id").agg(F.count("*").alias("climbs"), F.median(F.col("t") - F.col("low_t")).alias("median_seconds"), F.round(F.avg(near), 6).alias("near_share"))


@query("log lived samples", "SELECT match_id, cx, cz, count(*) AS n, round(count(*) * 1.0 / max(count(*)) OVER (PARTITION BY match_id), 6) AS density FROM samples GROUP BY match_id, cx, cz")
def a58_density(i: Inputs) -> DataFrame:
    return trajectories.density(i.samples, ["match_id"]).withColumn("density", r6("density"))


FLOORS = ", cells AS (SELECT map_id, x, z, min(low) AS lowest, max(low) - min(low) AS floor_range FROM (SELECT match_id % 5 AS map_id, match_id, x, z, min(y) AS low FROM match_log WHERE event_type = 5 GROUP BY 1, 2, 3, 4) f GROUP BY 1, 2, 3)"


@query("log diamonds", f"{FLOORS} SELECT map_id, CAST(floor(d / 5) * 5 AS INT) AS band, count(*) AS cells, CAST(median(floor_range) AS DOUBLE) AS median_range, round(avg(CASE WHEN floor_range = 0 THEN 1.0 ELSE 0 END), 6) AS static_share, round(avg(CASE WHEN floor_range >= 5 THEN 1.0 ELSE 0 END), 6) AS deep_share FROM (SELECT c.*, (SELECT min(sqrt((c.x - d.cx) * (c.x - d.cx) + (c.z - d.cz) * (c.z - d.cz))) FROM diamonds d WHERE d.kind = 'island' AND d.map_id = c.map_id) AS d FROM cells c) n GROUP BY 1, 2")
def a20_dug_profile(i: Inputs) -> DataFrame:
    cells = trajectories.lowest_floors(i.log.where(POSITIONS).withColumn("map_id", F.col("match_id") % 5), ["map_id"])
    rooms = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("cx").alias("x"), F.col("cz").alias("z"))
    return trajectories.dug_profile(cells, rooms).withColumns({c: r6(c) for c in ("static_share", "deep_share")})


@query("log teams", """, caught AS (SELECT DISTINCT e.match_id, s.team, e.wool_id FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.event_type = 7)
 SELECT best, worst, count(*) AS matches FROM (SELECT match_id, max(n) AS best, min(n) AS worst FROM (SELECT g.match_id, g.team, count(c.wool_id) AS n FROM (SELECT DISTINCT match_id, team FROM teams) g LEFT JOIN caught c USING (match_id, team) GROUP BY 1, 2) s GROUP BY 1) m GROUP BY 1, 2""")  # fmt: skip
def q14_domination(i: Inputs) -> DataFrame:
    caught = intervals.with_team(i.log.where("event_type = 7"), i.teams, how="inner")
    return matchstats.domination(caught, i.teams.select("match_id", "team"))


@query("log", ", r AS (SELECT match_id, wool_id, min(t) AS c FROM match_log WHERE event_type = 7 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY c, wool_id) AS n, count(*) OVER (PARTITION BY match_id) AS m FROM r), f AS (SELECT match_id % 5 AS map_id, wool_id, count(*) AS n FROM k WHERE n = 1 AND m >= 2 GROUP BY 1, 2) SELECT map_id, CAST(sum(n) AS BIGINT) AS matches, first(wool_id ORDER BY n DESC, wool_id) AS first_wool, round(max(n) * 1.0 / sum(n), 6) AS concordance FROM f GROUP BY map_id")
def a28_wool_order(i: Inputs) -> DataFrame:
    ranks = objectives.capture_ranks(i.log).withColumn("map_id", F.col("match_id") % 5)
    return objectives.order_concordance(ranks).withColumn("concordance", r6("concordance"))


@query("log teams", ", s AS (SELECT *, CASE WHEN x > 5 THEN 'red' WHEN x < -5 THEN 'blue' ELSE 'unknown' END AS side FROM match_log WHERE event_type = 2), c AS (SELECT *, lag(side) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS before FROM s) SELECT match_id, count(*) AS unknown_segments, count(DISTINCT player_id) AS affected_players FROM c WHERE side = 'unknown' AND (before IS NULL OR before <> side) GROUP BY match_id")
def q2a_unknown_teams(i: Inputs) -> DataFrame:
    side = F.when(F.col("x") > 5, "red").when(F.col("x") < -5, "blue").otherwise("unknown")
    rows = intervals.team_segments(intervals.spawn_teams(i.log, side)).where("team = 'unknown'")
    return rows.groupBy("match_id").agg(F.count("*").alias("unknown_segments"), F.count_distinct("player_id").alias("affected_players"))


@query("log diamonds placed", "SELECT map_id, count(*) AS total_positions, count(island_id) AS annotated, count(*) - count(island_id) AS unannotated, round(100.0 * count(island_id) / count(*), 1) AS pct_annotated FROM placed WHERE event_type = 5 GROUP BY map_id")
def q3a_annotation_coverage(i: Inputs) -> DataFrame:
    rows = placed(i, i.log.where(POSITIONS)).groupBy("map_id").agg(F.count("*").alias("total_positions"), F.count("island_id").alias("annotated"))
    return rows.select("*", (F.col("total_positions") - F.col("annotated")).alias("unannotated"), F.round(100.0 * F.col("annotated") / F.col("total_positions"), 1).alias("pct_annotated"))


@query("log diamonds placed", "SELECT map_id, location_type, count(*) AS positions FROM placed WHERE event_type = 5 GROUP BY 1, 2")
def q3b_location_types(i: Inputs) -> DataFrame:
    return placed(i, i.log.where(POSITIONS)).groupBy("map_id", "location_type").agg(F.count("*").alias("positions"))


@query("log diamonds placed", "SELECT map_id, match_id, count(*) AS void_positions FROM placed WHERE event_type = 5 AND location_type = 'void' GROUP BY 1, 2")
def q3c_void_positions(i: Inputs) -> DataFrame:
    return placed(i, i.log.where(POSITIONS)).where("location_type = 'void'").groupBy("map_id", "match_id").agg(F.count("*").alias("void_positions"))


@query("log diamonds placed", "SELECT map_id, island_id, location_type, count(*) AS visits FROM placed WHERE event_type = 5 AND island_id IS NOT NULL GROUP BY 1, 2, 3")
def q3d_island_usage(i: Inputs) -> DataFrame:
    return placed(i, i.log.where(POSITIONS)).where("island_id is not null").groupBy("map_id", "island_id", "location_type").agg(F.count("*").alias("visits"))


@query("log matches", "SELECT match_id, map_id FROM matches WHERE processed AND match_id NOT IN (SELECT match_id FROM match_log WHERE event_type = 2)")
def q5a_matches_without_lives(i: Inputs) -> DataFrame:
    return matchstats.lacking(i.matches.where("processed").select("match_id", "map_id"), sessions.life_segments(i.log), ["match_id"])


@query("log matches", "SELECT match_id, map_id FROM matches WHERE processed AND match_id NOT IN (SELECT match_id FROM match_log WHERE event_type = 5 AND y > 40)")
def q5b_matches_without_positions(i: Inputs) -> DataFrame:
    return matchstats.lacking(i.matches.where("processed").select("match_id", "map_id"), i.log.where("event_type = 5 and y > 40"), ["match_id"])


@query("maps matches", "SELECT map_id, map_slug, (SELECT count(*) FROM matches x WHERE x.map_id = m.map_id) AS match_count FROM maps m WHERE stub")
def q5e_stub_maps(i: Inputs) -> DataFrame:
    return matchstats.stub_maps(i.maps, i.matches)


@query("maps matches", "SELECT match_id, match_start, match_duration, map_slug FROM matches JOIN maps USING (map_id)")
def q8a_match_listing(i: Inputs) -> DataFrame:
    return i.matches.join(i.maps, "map_id").select("match_id", "match_start", "match_duration", "map_slug")


PIECES = {"has_helmet": "STEEL", "has_chestplate": "BRASS", "has_leggings": "TIN", "has_boots": "COPPER"}
ARMOUR = ", a AS (SELECT map_id, chest_id, " + ", ".join(f"max(CASE WHEN item_id LIKE '%{v}%' THEN 1 ELSE 0 END) AS {k}" for k, v in PIECES.items()) + " FROM chests WHERE category = 'Brand#11' GROUP BY 1, 2)"


@query("chests", f"{ARMOUR} SELECT {', '.join(PIECES)}, count(*) AS chest_count, count(DISTINCT map_id) AS map_count, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct_chests FROM a GROUP BY {', '.join(PIECES)}")
def q9f_armour_combinations(i: Inputs) -> DataFrame:
    return chests.combinations(chests.flagged(i.chests, PIECES, "Brand#11"), list(PIECES))


@query("chests", f"{ARMOUR}, m AS (SELECT map_id, {', '.join(f'max({p}) AS {p}' for p in PIECES)}, count(*) AS n FROM a GROUP BY 1) SELECT {', '.join(PIECES)}, count(*) AS map_count, round(avg(n), 1) AS avg_chests, min(n) AS min_chests, max(n) AS max_chests FROM m GROUP BY {', '.join(PIECES)}")
def q9g_armour_coverage(i: Inputs) -> DataFrame:
    return chests.map_coverage(chests.flagged(i.chests, PIECES, "Brand#11"), list(PIECES))


@query("blocks", "SELECT map_id, x, z, count(*) AS metric FROM blocks WHERE block_id <> 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def l3_vertical_density(i: Inputs) -> DataFrame:
    return blocks.vertical_density(i.blocks, 3)


@query("blocks", ", s AS (SELECT map_id, x, z, count(*) OVER (PARTITION BY map_id, x, z, y - n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS n FROM blocks WHERE block_id <> 0) r) SELECT map_id, x, z, max(c) AS metric FROM s GROUP BY 1, 2, 3 HAVING max(c) >= 2")
def l3_longest_runs(i: Inputs) -> DataFrame:
    return blocks.vertical_density(i.blocks, 2, by_run=True)


@query("blocks diamonds", ", r AS (SELECT map_id, x, y, z, CASE block_id WHEN 35 THEN 'wool' WHEN 41 THEN 'gold_block' WHEN 42 THEN 'iron_block' WHEN 52 THEN 'mob_spawner' WHEN 57 THEN 'diamond_block' END AS kind FROM blocks WHERE block_id IN (35, 41, 42, 52, 57)) SELECT r.map_id, d.polygon_id AS region_id, count(*) AS n, string_agg(DISTINCT r.kind, ',' ORDER BY r.kind) AS types FROM r JOIN diamonds d ON d.map_id = r.map_id AND abs(r.x - d.cx) <= d.r AND abs(r.z - d.cz) <= d.r GROUP BY 1, 2")
def l15_region_resources(i: Inputs) -> DataFrame:
    d = i.adapted("diamonds")
    regions = d.select("map_id", F.col("polygon_id").alias("region_id"), *((F.col(c) + s * F.col("r")).alias(n) for c, s, n in (("cx", -1, "min_x"), ("cx", 1, "max_x"), ("cz", -1, "min_z"), ("cz", 1, "max_z"))))
    return blocks.region_resources(blocks.resource_blocks(i.blocks), regions)


@query("log diamonds", """SELECT map_id, row_id AS point_id, (SELECT d.polygon_id FROM diamonds d WHERE d.map_id = p.map_id AND abs(p.x - d.cx) <= d.r AND abs(p.z - d.cz) <= d.r ORDER BY d.r, d.polygon_id LIMIT 1) AS region_id
 FROM (SELECT *, match_id % 5 AS map_id FROM match_log WHERE event_type = 7) p WHERE EXISTS (SELECT 1 FROM diamonds d WHERE d.map_id = p.map_id AND abs(p.x - d.cx) <= d.r AND abs(p.z - d.cz) <= d.r)""")  # fmt: skip
def l11_smallest_region(i: Inputs) -> DataFrame:
    d = i.adapted("diamonds")
    regions = d.select("map_id", F.col("polygon_id").alias("region_id"), *((F.col(c) + s * F.col("r")).alias(n) for c, s, n in (("cx", -1, "min_x"), ("cx", 1, "max_x"), ("cz", -1, "min_z"), ("cz", 1, "max_z"))))
    points = i.log.where("event_type = 7").select((F.col("match_id") % 5).alias("map_id"), F.col("row_id").alias("point_id"), "x", "z")
    return spatial.smallest_region(points, regions)


@query("ground diamonds", """, c AS (SELECT g.map_id, g.x, g.z, d.polygon_id, d.kind, CASE WHEN d.polygon_id % 2 = 0 THEN 'spawn' ELSE 'wool_room' END AS what, 'team' || (d.polygon_id % 3) AS team, greatest(d.cx - 4 - g.x, g.x - d.cx - 4, 0) AS dx, greatest(d.cz - 4 - g.z, g.z - d.cz - 4, 0) AS dz,
  g.x > d.cx - 4 AND g.x < d.cx + 4 AND g.z > d.cz - 4 AND g.z < d.cz + 4 AS held FROM ground g LEFT JOIN diamonds d ON d.map_id = g.map_id AND d.kind = 'island'),
 k AS (SELECT *, CASE WHEN what = 'spawn' AND held THEN 0 WHEN what = 'wool_room' AND held THEN 1 WHEN what = 'wool_room' AND dx * dx + dz * dz <= 100 THEN 2 WHEN what = 'spawn' AND dx * dx + dz * dz <= 225 THEN 3 ELSE 4 END AS rank FROM c)
 SELECT map_id, x, z, CASE rank WHEN 0 THEN 'spawn' WHEN 1 THEN 'wool_room' WHEN 2 THEN 'defense' WHEN 3 THEN 'near_spawn' ELSE 'field' END AS zone, CASE WHEN rank < 4 THEN team END AS zone_team FROM (SELECT *, row_number() OVER (PARTITION BY map_id, x, z ORDER BY rank, team) AS n FROM k) r WHERE n = 1""")  # fmt: skip
def l10_zones(i: Inputs) -> DataFrame:
    d = i.adapted("diamonds").where("kind = 'island'")
    rectangles = d.select("map_id", F.when(F.col("polygon_id") % 2 == 0, "spawn").otherwise("wool_room").alias("kind"), F.concat(F.lit("team"), F.col("polygon_id") % 3).alias("team"), *((F.col(c) + s * 4).alias(n) for c, s, n in (("cx", -1, "min_x"), ("cx", 1, "max_x"), ("cz", -1, "min_z"), ("cz", 1, "max_z"))))
    spots = i.cells.withColumn("chest_id", F.struct("x", "z"))
    return chests.zones(spots, rectangles).select("map_id", "x", "z", "zone", "zone_team")


def island_cells(i: Inputs) -> DataFrame:
    return cut(shapes.islands(i.cells, corners=True, least=4))


#: Islands in SQL: every cell walks to all that it reaches; the least (by z, then x) names its island.
WALK = """, walk AS (SELECT map_id, x, z, z * 1000 + x AS root FROM ground UNION SELECT g.map_id, g.x, g.z, w.root FROM walk w JOIN ground g ON g.map_id = w.map_id AND abs(g.x - w.x) <= 1 AND abs(g.z - w.z) <= 1),
 named AS MATERIALIZED (SELECT map_id, x, z, min(root) AS root FROM walk GROUP BY 1, 2, 3),
 sized AS (SELECT map_id, root, count(*) AS area, CAST(row_number() OVER (PARTITION BY map_id ORDER BY count(*) DESC, root) - 1 AS INT) AS island_id FROM named GROUP BY 1, 2 HAVING count(*) >= 4),
 islands AS MATERIALIZED (SELECT n.map_id, island_id, n.x, n.z FROM named n JOIN sized USING (map_id, root))"""


@query("ground", f"{WALK} SELECT * FROM islands")
def l19_islands(i: Inputs) -> DataFrame:
    return island_cells(i)


BOX = ", box AS MATERIALIZED (SELECT map_id, island_id, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z, avg(x) + 0.5 AS center_x, avg(z) + 0.5 AS center_z FROM islands GROUP BY 1, 2)"


@query("ground", f"""{WALK}{BOX}, empty AS MATERIALIZED (SELECT b.map_id, b.island_id, u.x, v.z, u.x IN (b.min_x, b.max_x) OR v.z IN (b.min_z, b.max_z) AS edge FROM box b, unnest(range(b.min_x, b.max_x + 1)) u(x), unnest(range(b.min_z, b.max_z + 1)) v(z) WHERE NOT EXISTS (SELECT 1 FROM islands k WHERE k.map_id = b.map_id AND k.island_id = b.island_id AND k.x = u.x AND k.z = v.z)),
 flow AS (SELECT map_id, island_id, x, z, z * 1000 + x AS root FROM empty UNION SELECT e.map_id, e.island_id, e.x, e.z, f.root FROM flow f JOIN empty e ON e.map_id = f.map_id AND e.island_id = f.island_id AND abs(e.x - f.x) + abs(e.z - f.z) = 1),
 parts AS (SELECT map_id, island_id, x, z, min(root) AS root FROM flow GROUP BY 1, 2, 3, 4)
 SELECT map_id, island_id, root AS first_cell, count(*) AS area FROM parts JOIN empty USING (map_id, island_id, x, z) GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND NOT bool_or(edge)""")  # fmt: skip
def l20_holes(i: Inputs) -> DataFrame:
    rows = shapes.holes(island_cells(i), shapes.ISLAND, 2)
    return rows.groupBy(*shapes.ISLAND, "hole_id", "area").agg(F.min(F.col("z") * 1000 + F.col("x0")).alias("first_cell")).drop("hole_id")


FIGURES = """, sides AS (SELECT map_id, island_id, sum(CASE WHEN NOT EXISTS (SELECT 1 FROM islands k WHERE k.map_id = i.map_id AND k.island_id = i.island_id AND k.x = i.x + dx AND k.z = i.z + dz) THEN 1 ELSE 0 END) AS perimeter FROM islands i, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dz) GROUP BY 1, 2)"""


@query("ground", f"""{WALK}{BOX}{FIGURES} SELECT map_id, island_id, area, min_x, max_x, min_z, max_z, round(center_x, 6) AS center_x, round(center_z, 6) AS center_z, CAST(perimeter AS BIGINT) AS perimeter,
 round(greatest(max_x - min_x + 1, max_z - min_z + 1) * 1.0 / least(max_x - min_x + 1, max_z - min_z + 1), 6) AS aspect, round(area * 1.0 / ((max_x - min_x + 1) * (max_z - min_z + 1)), 6) AS fill, round(4 * pi() * area / (perimeter * perimeter), 6) AS compactness FROM box JOIN sides USING (map_id, island_id)""")  # fmt: skip
def l25_island_figures(i: Inputs) -> DataFrame:
    rows = shapes.island_figures(island_cells(i)).drop("elongation")
    return rows.withColumns({c: r6(c) for c in ("center_x", "center_z", "aspect", "fill", "compactness")})


@query("ground", f"""{WALK}{BOX}, m AS (SELECT map_id, avg(center_x) AS mx, avg(center_z) AS mz, count(*) AS n FROM box GROUP BY 1), k AS (SELECT b.*, n, row_number() OVER (PARTITION BY b.map_id ORDER BY area DESC, island_id) AS a, row_number() OVER (PARTITION BY b.map_id ORDER BY round(sqrt((center_x - mx) * (center_x - mx) + (center_z - mz) * (center_z - mz)), 9), island_id) AS f FROM box b JOIN m USING (map_id))
 SELECT map_id, island_id, area, CASE WHEN n >= 2 AND a <= 2 THEN 'spawn' WHEN f = 1 THEN 'center' WHEN area < 6 THEN 'small' ELSE 'peripheral' END AS role, f = 1 AS is_center FROM k""")  # fmt: skip
def l21_island_roles(i: Inputs) -> DataFrame:
    return shapes.island_roles(shapes.island_figures(island_cells(i)), 6)


@query("ground", f"""{WALK}{BOX}, m AS (SELECT map_id, avg(center_x) AS mx, avg(center_z) AS mz FROM box GROUP BY 1) SELECT map_id, count(*) AS islands, CAST(sum(area) AS BIGINT) AS total, max(area) AS largest, min(area) AS smallest, round(avg(area), 6) AS mean_area, CAST(median(area) AS DOUBLE) AS median_area, round(avg(sqrt((center_x - mx) * (center_x - mx) + (center_z - mz) * (center_z - mz))), 6) AS mean_distance FROM box JOIN m USING (map_id) GROUP BY map_id""")
def a46_island_statistics(i: Inputs) -> DataFrame:
    rows = shapes.map_figures(shapes.island_figures(island_cells(i))).drop("mx", "mz")
    return rows.withColumns({c: r6(c) for c in ("mean_area", "mean_distance")})


TURNS = "(VALUES (0, 1, 0, 0, 1), (1, 0, -1, 1, 0), (2, -1, 0, 0, -1), (3, 0, 1, -1, 0), (4, -1, 0, 0, 1), (5, 0, 1, 1, 0), (6, 1, 0, 0, -1), (7, 0, -1, -1, 0)) t(turn, a, b, c, d)"
SHAPE_KEYS = f"""{WALK}, turned AS (SELECT map_id, island_id, turn, a * x + b * z AS u, c * x + d * z AS v FROM islands, {TURNS}), low AS (SELECT map_id, island_id, turn, min(u) AS u0, min(v) AS v0 FROM turned GROUP BY 1, 2, 3),
 lists AS (SELECT map_id, island_id, turn, list([u - u0, v - v0] ORDER BY u, v) AS l FROM turned JOIN low USING (map_id, island_id, turn) GROUP BY 1, 2, 3),
 keys AS (SELECT map_id, island_id, substr(sha256(array_to_string(list_transform(min(l), lambda p: CAST(p[1] AS VARCHAR) || ',' || CAST(p[2] AS VARCHAR)), ';')), 1, 16) AS canonical_key FROM lists GROUP BY 1, 2)"""


@query("ground", f"{SHAPE_KEYS} SELECT * FROM keys")
def l24_canonical_keys(i: Inputs) -> DataFrame:
    return shapes.canonical_keys(island_cells(i))


@query("ground", f"{SHAPE_KEYS} SELECT canonical_key, count(*) AS instances, count(DISTINCT map_id) AS maps FROM keys GROUP BY 1")
def a48_canonical_groups(i: Inputs) -> DataFrame:
    return shapes.canonical_groups(shapes.canonical_keys(island_cells(i)))


@query("ground", f"""{WALK}{BOX}, kinds(symmetry, sx, sz, swap) AS (VALUES ('point', -1, -1, false), ('mirror_x', -1, 1, false), ('mirror_z', 1, -1, false), ('diagonal', 1, 1, true), ('rotation', -1, 1, true)),
 moved AS (SELECT b.map_id, b.island_id, symmetry, b.area, swap AND max_x - min_x <> max_z - min_z AS uneven,
   CASE WHEN NOT swap THEN CASE WHEN sx < 0 THEN min_x + max_x - x ELSE x END WHEN symmetry = 'diagonal' THEN min_x + (z - min_z) ELSE min_x + (max_z - z) END AS u, CASE WHEN NOT swap THEN CASE WHEN sz < 0 THEN min_z + max_z - z ELSE z END ELSE min_z + (x - min_x) END AS v FROM islands JOIN box b USING (map_id, island_id), kinds)
 SELECT map_id, island_id, symmetry, round(mismatch, 6) AS mismatch, mismatch <= 1e-12 AS exact, mismatch <= 0.03 AS nearly FROM (SELECT m.map_id, m.island_id, symmetry, CASE WHEN uneven THEN 1.0 ELSE 1 - count(k.x) * 1.0 / area END AS mismatch FROM moved m LEFT JOIN islands k ON k.map_id = m.map_id AND k.island_id = m.island_id AND k.x = u AND k.z = v GROUP BY m.map_id, m.island_id, symmetry, area, uneven) s""")  # fmt: skip
def l29_symmetries(i: Inputs) -> DataFrame:
    return shapes.symmetries(island_cells(i)).withColumn("mismatch", r6("mismatch"))


@query("ground", """, box AS (SELECT map_id, min(x) + max(x) AS sx, min(z) + max(z) AS sz, count(*) AS n FROM ground GROUP BY 1), k(symmetry, fx, fz) AS (VALUES ('point', true, true), ('mirror_x', true, false), ('mirror_z', false, true)),
 s AS (SELECT g.map_id, symmetry, n, count(o.x) AS same FROM ground g JOIN box USING (map_id) CROSS JOIN k LEFT JOIN ground o ON o.map_id = g.map_id AND o.x = CASE WHEN fx THEN sx - g.x ELSE g.x END AND o.z = CASE WHEN fz THEN sz - g.z ELSE g.z END GROUP BY 1, 2, 3),
 r AS (SELECT *, round(same * 1.0 / (2 * n - same), 9) AS overlap, row_number() OVER (PARTITION BY map_id ORDER BY round(same * 1.0 / (2 * n - same), 9) DESC, symmetry) AS rn FROM s) SELECT map_id, CASE WHEN overlap >= 0.15 THEN symmetry ELSE 'none' END AS symmetry, round(overlap, 6) AS overlap FROM r WHERE rn = 1""")  # fmt: skip
def l32_map_symmetry(i: Inputs) -> DataFrame:
    return shapes.map_symmetry(i.cells, least=0.15).withColumn("overlap", r6("overlap"))


@query("ground", f"{WALK}{BOX} SELECT map_id, island_id, CASE WHEN (max_x - min_x) % 2 = 1 AND (max_z - min_z) % 2 = 1 THEN '2x2' WHEN (max_x - min_x) % 2 = 1 THEN '2x1' WHEN (max_z - min_z) % 2 = 1 THEN '1x2' ELSE 'single_block' END AS centre FROM box")
def l22_centre_classes(i: Inputs) -> DataFrame:
    return shapes.bounds(island_cells(i), shapes.ISLAND).select(*shapes.ISLAND, shapes.centre_class(*(F.col(c) for c in ("min_x", "max_x", "min_z", "max_z"))).alias("centre"))


@query("ground log", f"{WALK}{BOX} SELECT e.match_id % 5 AS map_id, e.row_id AS point_id, min(island_id) AS island_id FROM match_log e JOIN box b ON b.map_id = e.match_id % 5 AND e.x BETWEEN b.min_x - 1 AND b.max_x + 1 AND e.z BETWEEN b.min_z - 1 AND b.max_z + 1 WHERE e.event_type = 7 GROUP BY 1, 2")
def l23_island_of_point(i: Inputs) -> DataFrame:
    points = i.log.where("event_type = 7").select((F.col("match_id") % 5).alias("map_id"), F.col("row_id").alias("point_id"), "x", "z")
    return shapes.island_of(points, shapes.bounds(island_cells(i), shapes.ISLAND), 1)


@query("ground", f"""{WALK}{BOX}, s(team, x, z) AS (VALUES ('blue', 40, 24), ('red', 8, 24)), e AS (SELECT map_id, max(max_x) - min(min_x) + 1 AS extent FROM box GROUP BY 1)
 SELECT map_id, island_id, CASE WHEN abs(center_x - 24) <= greatest(2.0, 0.03 * extent) THEN 'neutral' WHEN abs(center_x - 40) < abs(center_x - 8) OR (abs(center_x - 40) = abs(center_x - 8)) THEN 'blue' ELSE 'red' END AS team FROM box JOIN e USING (map_id)""")  # fmt: skip
def l33_island_teams(i: Inputs) -> DataFrame:
    figures = shapes.island_figures(island_cells(i))
    sides = F.explode(F.array(*(F.struct(F.lit(t).alias("team"), F.lit(x).alias("x"), F.lit(24).alias("z")) for t, x in (("blue", 40), ("red", 8)))))
    spawns = figures.select("map_id").distinct().select("map_id", sides.alias("s")).select("map_id", "s.*")
    return shapes.island_teams(figures, spawns)


@query("blocks ground", "SELECT DISTINCT map_id, x, z FROM blocks b WHERE y = 0 AND block_id = 36 AND NOT EXISTS (SELECT 1 FROM ground g WHERE g.map_id = b.map_id AND g.x = b.x AND g.z = b.z)")
def l38_build_cells(i: Inputs) -> DataFrame:
    return blocks.build_cells(i.blocks, i.cells)


VOIDS = """, wide AS (SELECT DISTINCT map_id, x, z FROM blocks WHERE block_id < 8), b AS (SELECT map_id, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM wide GROUP BY 1),
 empty AS MATERIALIZED (SELECT b.map_id, u.x, v.z, u.x IN (x0, x1) OR v.z IN (z0, z1) AS edge FROM b, unnest(range(x0, x1 + 1)) u(x), unnest(range(z0, z1 + 1)) v(z) WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.map_id = b.map_id AND w.x = u.x AND w.z = v.z)),
 flow AS (SELECT map_id, x, z, z * 1000 + x AS root FROM empty UNION SELECT e.map_id, e.x, e.z, f.root FROM flow f JOIN empty e ON e.map_id = f.map_id AND abs(e.x - f.x) + abs(e.z - f.z) = 1),
 parts AS MATERIALIZED (SELECT map_id, x, z, min(root) AS root FROM flow GROUP BY 1, 2, 3),
 voids AS (SELECT map_id, root, count(*) AS area, CAST(row_number() OVER (PARTITION BY map_id ORDER BY root) - 1 AS INT) AS hole_id FROM parts JOIN empty USING (map_id, x, z) GROUP BY 1, 2 HAVING count(*) >= 2 AND NOT bool_or(edge))"""


@query("blocks", f"{VOIDS} SELECT map_id, hole_id, area FROM voids")
def l39_enclosed_voids(i: Inputs) -> DataFrame:
    cells = i.blocks.where("block_id < 8").select("map_id", "x", "z").distinct()
    return shapes.holes(cells, ["map_id"], 2).select("map_id", "hole_id", "area").distinct()


@query("blocks", f"""{VOIDS}, near AS (SELECT DISTINCT v.map_id, v.hole_id, w.x, w.z FROM voids v JOIN parts p ON p.map_id = v.map_id AND p.root = v.root JOIN wide w ON w.map_id = p.map_id AND abs(w.x - p.x) + abs(w.z - p.z) = 1)
 SELECT map_id, hole_id, CASE count(DISTINCT CASE WHEN x < 20 THEN 'red' WHEN x > 28 THEN 'blue' END) WHEN 0 THEN 'middle' WHEN 1 THEN 'encased' ELSE 'frontline' END AS void_class FROM near GROUP BY 1, 2""")  # fmt: skip
def l40_void_classes(i: Inputs) -> DataFrame:
    cells = i.blocks.where("block_id < 8").select("map_id", "x", "z").distinct()
    return shapes.void_classes(shapes.holes(cells, ["map_id"], 2), cells.withColumn("team", F.when(F.col("x") < 20, "red").when(F.col("x") > 28, "blue")))


@query("diamonds", "SELECT map_id, cx, cz, kind, polygon_id FROM (SELECT d.map_id, u.c AS cx, v.c AS cz, kind, polygon_id, row_number() OVER (PARTITION BY d.map_id, u.c, v.c ORDER BY kind <> 'island', polygon_id) AS n FROM diamonds d, (SELECT CAST(unnest(range(-100, 101, 4)) AS INT) AS c) u, (SELECT CAST(unnest(range(-100, 101, 4)) AS INT) AS c) v WHERE abs(u.c + 2 - d.cx) + abs(v.c + 2 - d.cz) < d.r) r WHERE n = 1")
def g12_rasterised_polygons(i: Inputs) -> DataFrame:
    return spatial.rasterised(i.areas, 4)


def traffic(i: Inputs) -> tuple[DataFrame, DataFrame]:
    return graph.traffic_graph(i.mapped, "map_id", 5, 2, 1)


#: The traffic graph in SQL: cells, hops along lines of cells, and the largest component of what is left.
TRAFFIC = """, s AS (SELECT match_id % 5 AS map_id, samples.* FROM samples), c AS MATERIALIZED (SELECT map_id, cx, cz, count(*) AS occupation FROM s GROUP BY 1, 2, 3),
 hops AS (SELECT map_id, before_cx AS x0, before_cz AS z0, CAST(abs(cx - before_cx) / 5 AS INT) AS dx, CAST(abs(cz - before_cz) / 5 AS INT) AS dz, sign(cx - before_cx) * 5 AS sx, sign(cz - before_cz) * 5 AS sz FROM s WHERE before_cx IS NOT NULL AND (cx <> before_cx OR cz <> before_cz) AND t - before_t <= 30),
 pts AS (SELECT *, CAST(floor((i * least(dx, dz) - greatest(dx, dz) // 2 + greatest(dx, dz) - 1) / greatest(dx, dz)) AS INT) AS minor FROM (SELECT row_number() OVER () AS hop, hops.*, unnest(range(0, greatest(dx, dz) + 1)) AS i FROM hops) r),
 line AS (SELECT map_id, hop, i, x0 + sx * CASE WHEN dx >= dz THEN i ELSE minor END AS x, z0 + sz * CASE WHEN dx >= dz THEN minor ELSE i END AS z FROM pts),
 steps AS (SELECT a.map_id, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM line a JOIN line b ON a.hop = b.hop AND b.i = a.i + 1),
 n AS MATERIALIZED (SELECT map_id, cx, cz, occupation, row_number() OVER (PARTITION BY map_id ORDER BY cx, cz) - 1 AS node_id FROM c WHERE occupation >= 2),
 e0 AS MATERIALIZED (SELECT a.map_id, least(a.node_id, b.node_id) AS src, greatest(a.node_id, b.node_id) AS dst, count(*) AS transitions FROM steps s JOIN n a ON a.map_id = s.map_id AND a.cx = s.ax AND a.cz = s.az JOIN n b ON b.map_id = s.map_id AND b.cx = s.bx AND b.cz = s.bz GROUP BY 1, 2, 3),
 walk AS (SELECT map_id, node_id, node_id AS root FROM n UNION SELECT w.map_id, CASE WHEN e.src = w.node_id THEN e.dst ELSE e.src END, w.root FROM walk w JOIN e0 e ON e.map_id = w.map_id AND w.node_id IN (e.src, e.dst)),
 named AS (SELECT map_id, node_id, min(root) AS root FROM walk GROUP BY 1, 2), best AS (SELECT map_id, first(root ORDER BY k DESC, root) AS root FROM (SELECT map_id, root, count(*) AS k FROM named GROUP BY 1, 2) z GROUP BY 1),
 nodes AS MATERIALIZED (SELECT n.* FROM n JOIN named USING (map_id, node_id) JOIN best USING (map_id, root)), edges AS MATERIALIZED (SELECT e.* FROM e0 e JOIN nodes a ON a.map_id = e.map_id AND a.node_id = e.src)"""


@query("log lived samples", f"{TRAFFIC} SELECT map_id, node_id, cx, cz, occupation FROM nodes")
def g1_traffic_nodes(i: Inputs) -> DataFrame:
    return traffic(i)[0].select("map_id", "node_id", "cx", "cz", "occupation")


@query("log lived samples", f"{TRAFFIC} SELECT map_id, src, dst, CAST(transitions AS BIGINT) AS transitions FROM edges")
def g1_traffic_edges(i: Inputs) -> DataFrame:
    return traffic(i)[1]


ANCHORS = """, w AS (SELECT map_id, polygon_id, CAST(cx AS DOUBLE) AS x, CAST(cz AS DOUBLE) AS z, CAST(floor(cx / 5.0) * 5 AS INT) AS ax, CAST(floor(cz / 5.0) * 5 AS INT) AS az, row_number() OVER (PARTITION BY map_id, floor(cx / 5.0), floor(cz / 5.0) ORDER BY polygon_id) AS k FROM diamonds WHERE kind = 'island'),
 lone AS (SELECT w.*, coalesce((SELECT max(node_id) FROM nodes n WHERE n.map_id = w.map_id), -1) + row_number() OVER (PARTITION BY map_id ORDER BY polygon_id) AS node_id FROM w WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.map_id = w.map_id AND n.cx = w.ax AND n.cz = w.az)),
 links AS (SELECT map_id, node_id AS dst, src FROM (SELECT l.map_id, l.node_id, n.node_id AS src, row_number() OVER (PARTITION BY l.map_id, l.node_id ORDER BY (n.cx + 2.5 - l.x) * (n.cx + 2.5 - l.x) + (n.cz + 2.5 - l.z) * (n.cz + 2.5 - l.z), n.node_id) AS r FROM lone l JOIN nodes n ON n.map_id = l.map_id) q WHERE r <= 3),
 every AS (SELECT map_id, src, dst, CAST(transitions AS BIGINT) AS transitions FROM edges UNION ALL SELECT map_id, src, dst, 1 FROM links)"""


def anchored(i: Inputs) -> tuple[DataFrame, DataFrame]:
    anchors = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("polygon_id").alias("anchor_id"), F.col("cx").cast("double").alias("x"), F.col("cz").cast("double").alias("z"), F.lit("wool").alias("poi_type"))
    return graph.with_anchors(*traffic(i), anchors, "map_id")


@query("log lived samples diamonds", f"{TRAFFIC}{ANCHORS} SELECT n.map_id, n.node_id, n.cx, n.cz, n.occupation, w.polygon_id IS NOT NULL AS fixed FROM nodes n LEFT JOIN w ON w.map_id = n.map_id AND w.ax = n.cx AND w.az = n.cz AND w.k = 1 UNION ALL SELECT map_id, node_id, ax, az, 0, true FROM lone")
def g3_anchored_nodes(i: Inputs) -> DataFrame:
    return anchored(i)[0].select("map_id", "node_id", "cx", "cz", "occupation", "fixed")


@query("log lived samples diamonds", f"{TRAFFIC}{ANCHORS} SELECT * FROM every")
def g3_anchored_edges(i: Inputs) -> DataFrame:
    return anchored(i)[1]


@query("log lived samples", f"""{TRAFFIC}, l AS (SELECT e.map_id, sum(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cz - b.cz) * (a.cz - b.cz))) AS length, count(*) AS n FROM edges e JOIN nodes a ON a.map_id = e.map_id AND a.node_id = e.src JOIN nodes b ON b.map_id = e.map_id AND b.node_id = e.dst GROUP BY 1)
 SELECT map_id, count(*) AS n_nodes, any_value(l.n) AS n_edges, round(any_value(length), 6) AS length, 0 AS n_fixed, 1 AS parts FROM nodes JOIN l USING (map_id) GROUP BY map_id""")  # fmt: skip
def g5_topology(i: Inputs) -> DataFrame:
    nodes, edges = traffic(i)
    return graph.topology(nodes.withColumn("fixed", F.lit(False)), edges, "map_id").withColumn("length", r6("length"))


@query("log lived samples cells", """, n AS MATERIALIZED (SELECT match_id, CAST(node_id AS BIGINT) AS node, cx, cz FROM cells WHERE occupation >= 2), e AS MATERIALIZED (SELECT a.match_id, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.match_id = b.match_id AND abs(a.cx - b.cx) + abs(a.cz - b.cz) = 5),
 far AS (SELECT match_id, node AS source, node, 0 AS hops FROM (SELECT match_id, min(node) AS node FROM n GROUP BY 1) f UNION SELECT e.match_id, f.source, e.dst, f.hops + 1 FROM far f JOIN e ON e.match_id = f.match_id AND e.src = f.node WHERE f.hops < 60),
 d AS MATERIALIZED (SELECT match_id, source, node, min(hops) AS hops FROM far GROUP BY 1, 2, 3), prev AS MATERIALIZED (SELECT d.match_id, d.node, min(e.src) AS previous FROM d JOIN e ON e.match_id = d.match_id AND e.dst = d.node JOIN d p ON p.match_id = d.match_id AND p.node = e.src AND p.hops = d.hops - 1 GROUP BY 1, 2),
 path AS (SELECT match_id, source, node AS target, hops AS seq, node FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY node DESC) AS k FROM d) t WHERE k = 1 UNION SELECT p.match_id, p.source, p.target, p.seq - 1, q.previous FROM path p JOIN prev q ON q.match_id = p.match_id AND q.node = p.node WHERE p.seq > 0)
 SELECT match_id, source, target, seq, node FROM path""")  # fmt: skip
def g7_shortest_paths(i: Inputs) -> DataFrame:
    """The path from each match's first node to the last that it reaches."""
    from matchspark.plans.match_queries import busy_graph

    nodes, edges = busy_graph(i)
    first = nodes.groupBy("match_id").agg(F.min("node").alias("node"))
    far = paths.shortest_distances(first, edges, "match_id")
    pairs = far.groupBy("match_id").agg(F.max("node").alias("target")).join(first.withColumnRenamed("node", "source"), "match_id")
    return paths.shortest_paths(pairs, edges, "match_id")


@query("log teams centres diamonds", """, own AS (SELECT DISTINCT e.match_id, e.wool_id, s.team FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t <= s.end_timestamp) WHERE e.event_type = 7),
 w AS (SELECT match_id, wool_id, median(x) AS x, median(z) AS z FROM match_log WHERE event_type = 7 GROUP BY 1, 2),
 v AS (SELECT w.match_id, w.wool_id, own.team, b.team AS defender, b.x - a.x AS ux, b.z - a.z AS uz, w.x - a.x AS vx, w.z - a.z AS vz FROM w JOIN own USING (match_id, wool_id) JOIN centres a ON a.match_id = w.match_id AND a.team = own.team JOIN centres b ON b.match_id = w.match_id AND b.team <> own.team)
 SELECT match_id AS map_id, wool_id, team, defender, round(sqrt(vx * vx + vz * vz), 6) AS distance, round(degrees(atan2(uz * vx - ux * vz, ux * vx + uz * vz)), 6) AS angle, CASE WHEN abs(degrees(atan2(uz * vx - ux * vz, ux * vx + uz * vz))) <= 5 THEN 'centre' WHEN uz * vx - ux * vz > 0 THEN 'left' ELSE 'right' END AS side FROM v""")  # fmt: skip
def g16_attack_relations(i: Inputs) -> DataFrame:
    wools = i.log.where("event_type = 7").groupBy(F.col("match_id").alias("map_id"), "wool_id").agg(F.median("x").alias("x"), F.median("z").alias("z"))
    key = lambda df: df.withColumnRenamed("match_id", "map_id")
    rows = objectives.attack_relations(key(i.centres), wools, key(objectives.capturing_teams(i.log, i.teams)))
    return rows.withColumns({c: r6(c) for c in ("distance", "angle")})


@query("ground", "SELECT map_id, x, z, degree, CASE WHEN degree = 1 THEN 'endpoint' WHEN degree >= 3 THEN 'junction' ELSE 'path' END AS kind FROM (SELECT g.map_id, g.x, g.z, (SELECT count(*) FROM ground o WHERE o.map_id = g.map_id AND abs(o.x - g.x) <= 1 AND abs(o.z - g.z) <= 1) - 1 AS degree FROM ground g) d")
def g22_skeleton_degrees(i: Inputs) -> DataFrame:
    return graph.degrees(i.cells)


SAMPLED = "samples_placed AS (SELECT s.*, location_type, island_id, ((s.cx + 35) // 5) * 100 + (s.cz + 35) // 5 AS node FROM samples s JOIN placed p USING (row_id))"


def visited(i: Inputs) -> DataFrame:
    """Samples with the diamond that holds them, the two of one pair at its sides, a node, and teams."""
    rows = spatial.classify(i.mapped, i.areas)
    node = ((F.floor((F.col("cx") + 35) / 5)) * 100 + F.floor((F.col("cz") + 35) / 5)).cast("int")
    return rows.select("*", (F.col("map_id") * 2).cast("int").alias("near_1"), F.lit(1).alias("near_2"), node.alias("node"), F.when(F.col("player_id") % 2 == 0, "red").otherwise("blue").alias("team"),
                       F.when(F.col("player_id") % 2 == 0, F.col("map_id")).otherwise(F.col("map_id") + 5).alias("home_island"), F.when(F.col("island_id").isNotNull(), F.when(F.col("island_id") % 2 == 0, "red").otherwise("blue")).alias("island_team"))


#: Visits in SQL: rows with their region as text, numbered by changes, and looked up one by one.
VISITS = f""", {SAMPLED}, r AS (SELECT p.*, match_id % 5 AS map_id, CASE WHEN location_type = 'island' THEN 'i' || island_id ELSE 'b' || least(match_id % 5 * 2, 1) || '-' || greatest(match_id % 5 * 2, 1) END AS region FROM samples_placed p WHERE location_type <> 'void'),
 ch AS (SELECT *, CASE WHEN region = lag(region) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id) THEN 0 ELSE 1 END AS new FROM r),
 nu AS (SELECT *, CAST(sum(new) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id) - 1 AS INT) AS visit_idx, lag(node) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id) AS node_before FROM ch),
 vi AS MATERIALIZED (SELECT match_id, player_id, segment_idx, visit_idx, any_value(map_id) AS map_id, any_value(location_type) AS location_type, any_value(island_id) AS island_id, min(t) AS entry_timestamp, max(t) AS exit_timestamp, count(*) AS ticks, first(node ORDER BY t, row_id) AS entry_node, last(node ORDER BY t, row_id) AS exit_node,
  string_agg(CAST(node AS VARCHAR), ',' ORDER BY t, row_id) FILTER (WHERE new = 1 OR node <> node_before) AS node_path FROM nu GROUP BY 1, 2, 3, 4),
 sp AS (SELECT match_id, player_id, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS segment_idx FROM match_log WHERE event_type = 4),
 out AS (SELECT v.match_id, v.player_id, v.segment_idx, v.visit_idx, location_type, CASE WHEN location_type = 'island' THEN island_id END AS island_id, CASE WHEN location_type <> 'island' THEN least(map_id * 2, 1) END AS bridge_island_1, CASE WHEN location_type <> 'island' THEN greatest(map_id * 2, 1) END AS bridge_island_2,
  entry_timestamp, exit_timestamp, exit_timestamp - entry_timestamp AS duration_s, ticks, CASE WHEN location_type = 'island' THEN island_id = CASE WHEN v.player_id % 2 = 0 THEN map_id ELSE map_id + 5 END END AS is_home_island, CASE WHEN location_type = 'island' THEN island_id % 2 <> v.player_id % 2 END AS is_enemy_island,
  (SELECT count(*) FROM lived k WHERE k.event_type = 3 AND k.match_id = v.match_id AND k.player_id = v.player_id AND k.segment_idx = v.segment_idx AND k.t BETWEEN entry_timestamp AND exit_timestamp) AS kill_count,
  visit_idx = max(visit_idx) OVER (PARTITION BY v.match_id, v.player_id, v.segment_idx) AND sp.segment_idx IS NOT NULL AS was_death, entry_node, exit_node,
  CASE WHEN location_type <> 'island' THEN (SELECT o.exit_node FROM vi o WHERE o.match_id = v.match_id AND o.player_id = v.player_id AND o.segment_idx = v.segment_idx AND o.visit_idx < v.visit_idx AND o.location_type = 'island' ORDER BY o.visit_idx DESC LIMIT 1) END AS bridge_node_1,
  CASE WHEN location_type <> 'island' THEN (SELECT o.entry_node FROM vi o WHERE o.match_id = v.match_id AND o.player_id = v.player_id AND o.segment_idx = v.segment_idx AND o.visit_idx > v.visit_idx AND o.location_type = 'island' ORDER BY o.visit_idx LIMIT 1) END AS bridge_node_2, node_path
  FROM vi v LEFT JOIN sp ON sp.match_id = v.match_id AND sp.player_id = v.player_id AND sp.segment_idx = v.segment_idx)"""


def visits(i: Inputs) -> DataFrame:
    return trajectories.region_visits(visited(i), trajectories.life_kills(i.log), sessions.life_segments(i.log))


@query("log lived samples diamonds placed", f"{VISITS} SELECT * FROM out")
def w6_region_visits(i: Inputs) -> DataFrame:
    return visits(i)


@query("log lived samples diamonds placed", f"""{VISITS} SELECT match_id, player_id, segment_idx, count(*) AS n_visits, count(DISTINCT island_id) AS islands_visited, count(*) - 1 AS transitions, CASE WHEN sum(duration_s) > 0 THEN round(sum(CASE WHEN is_home_island THEN duration_s ELSE 0 END) * 1.0 / sum(duration_s), 6) END AS frac_time_home,
 CASE WHEN sum(duration_s) > 0 THEN round(sum(CASE WHEN is_enemy_island THEN duration_s ELSE 0 END) * 1.0 / sum(duration_s), 6) END AS frac_time_enemy, CASE WHEN sum(duration_s) > 0 THEN round(sum(CASE WHEN location_type = 'build_region' THEN duration_s ELSE 0 END) * 1.0 / sum(duration_s), 6) END AS frac_time_build,
 min(CASE WHEN is_home_island IS NOT TRUE THEN entry_timestamp END) AS first_departure, CAST(sum(CASE WHEN location_type = 'build_region' THEN kill_count ELSE 0 END) AS BIGINT) AS kills_build, CAST(sum(CASE WHEN is_enemy_island THEN kill_count ELSE 0 END) AS BIGINT) AS kills_enemy FROM out GROUP BY 1, 2, 3""")  # fmt: skip
def x1_visit_summary(i: Inputs) -> DataFrame:
    return trajectories.visit_summary(visits(i))


@query("log lived samples diamonds placed", f"""{VISITS} SELECT match_id, player_id, segment_idx, string_agg(CAST(node AS VARCHAR), ',' ORDER BY t, row_id) FILTER (WHERE before IS NULL OR before <> node) AS node_sequence, round(min(depth), 6) AS max_attack_depth, last(node ORDER BY t, row_id) AS death_node
 FROM (SELECT *, lag(node) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id) AS before, sqrt(x * x + z * z) AS depth FROM samples_placed) s GROUP BY 1, 2, 3""")  # fmt: skip
def a7_node_sequences(i: Inputs) -> DataFrame:
    rows = trajectories.node_sequences(visited(i).withColumn("depth", F.hypot("x", "z")), "node", "depth")
    return rows.withColumn("max_attack_depth", r6("max_attack_depth"))


@query("log lived samples diamonds", """SELECT match_id, player_id, segment_idx, count(*) AS samples, round(min(enemy), 6) AS enemy_min, round(avg(home), 6) AS home_mean FROM (SELECT s.match_id, s.player_id, s.segment_idx, s.row_id, min(CASE WHEN d.polygon_id % 2 <> s.player_id % 2 THEN sqrt((s.x - d.cx) * (s.x - d.cx) + (s.z - d.cz) * (s.z - d.cz)) END) AS enemy,
 min(CASE WHEN d.polygon_id % 2 = s.player_id % 2 THEN sqrt((s.x - d.cx) * (s.x - d.cx) + (s.z - d.cz) * (s.z - d.cz)) END) AS home FROM samples s JOIN diamonds d ON d.map_id = s.match_id % 5 AND d.kind = 'island' GROUP BY 1, 2, 3, 4) e GROUP BY 1, 2, 3 HAVING count(*) >= 4""")  # fmt: skip
def a6_objective_distances(i: Inputs) -> DataFrame:
    side = lambda c: F.when(F.col(c) % 2 == 0, "red").otherwise("blue").alias("team")
    wools = i.adapted("diamonds").where("kind = 'island'").select("map_id", side("polygon_id"), F.col("cx").alias("x"), F.col("cz").alias("z"))
    rows = trajectories.objective_distances(i.mapped.select("*", side("player_id")), wools)
    return rows.withColumns({c: r6(c) for c in ("enemy_min", "home_mean")})


@query("maps log", "SELECT m.map_id, round(coalesce(CASE WHEN m.stub THEN NULL ELSE max_build_height END, p) - 4, 6) AS ceiling FROM maps m LEFT JOIN (SELECT match_id + 1 AS map_id, quantile_cont(y, 0.99) AS p FROM match_log WHERE event_type = 5 GROUP BY 1) q USING (map_id)")
def a31_build_ceiling(i: Inputs) -> DataFrame:
    maps = i.maps.withColumn("max_build_height", F.when(~F.col("stub"), F.col("max_build_height")))
    rows = blocks.build_ceiling(maps, i.staged.where(POSITIONS))
    return rows.withColumn("ceiling", r6("ceiling"))


@query("blocks ground", """, y0 AS (SELECT map_id, 'y0' AS layer, count(*) AS block_count, CAST(NULL AS INT) AS y_min, CAST(NULL AS INT) AS y_max FROM blocks WHERE y = 0 AND block_id <> 0 GROUP BY 1),
 top AS (SELECT map_id, x, z, max(y) AS y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3), rock AS (SELECT map_id, x, z, min(y) AS y FROM blocks WHERE block_id = 7 GROUP BY 1, 2, 3)
 SELECT * FROM y0 UNION ALL SELECT map_id, 'top_surface', count(*), min(y), max(y) FROM top GROUP BY 1 UNION ALL SELECT map_id, 'bedrock', count(*), min(y), max(y) FROM rock GROUP BY 1""")  # fmt: skip
def a15_layer_stats(i: Inputs) -> DataFrame:
    return blocks.layer_stats({"y0": blocks.ground_layer(i.blocks), "top_surface": blocks.top_surface(i.blocks), "bedrock": blocks.lowest_bedrock(i.blocks)})
