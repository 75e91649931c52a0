"""Oracles of the registered queries: hand-written SQL for DuckDB over the given tables.

``PROJECTIONS`` are the adapted inputs, which the queries share; all else is only run by
DuckDB. ``{ep}`` stands for epoch seconds.
"""

from __future__ import annotations

MATCH_LOG = """match_log AS (
 SELECT e.*, CASE WHEN event_type IN (6, 7) THEN k4 END AS wool_id, CASE WHEN event_type = 3 THEN mate END AS victim_id FROM (
 SELECT CAST(FLOOR(user_id / 5.0) AS INT) AS match_id, CAST(user_id AS INT) AS player_id, event_id AS row_id,
  CAST(FLOOR(({ep} - 1704067200) / 7200.0) AS INT) AS t,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 4
   WHEN 'purchase' THEN (CASE event_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 3 END) ELSE 5 END AS event_type,
  CAST(CAST(FLOOR(value) AS INT) % 64 - 32 AS INT) AS x,
  CAST(CAST(FLOOR(value * 100) AS BIGINT) % 48 AS INT) AS y,
  CAST((CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 7) % 64 - 32 AS INT) AS z,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS INT) AS k4,
  CAST(FLOOR(user_id / 5.0) * 5 + (user_id + 1) % 5 AS INT) AS mate FROM events) e)"""
MATCHES = """matches AS (SELECT o_orderkey AS match_id, CAST(o_custkey AS INT) AS map_id, o_orderdate AS match_start,
 CAST(FLOOR(o_totalprice / 100.0) AS INT) AS match_duration, CAST(o_orderkey % 60 AS INT) AS player_count,
 (o_orderstatus = 'F') AS processed FROM orders)"""
MAPS = """maps AS (SELECT CAST(c_custkey AS INT) AS map_id, c_name AS map_slug, 2 + c_nationkey % 3 AS team_count,
 CAST(FLOOR(ABS(c_acctbal)) AS INT) + 1 AS total_blocks, c_mktsegment AS size_tier,
 CAST(10 + c_nationkey AS INT) AS max_build_height, (c_acctbal < 0) AS stub FROM customer)"""
CHESTS = """chests AS (SELECT l_suppkey AS map_id, l_orderkey AS chest_id, l_linenumber AS slot, p_type AS item_id,
 CAST(FLOOR(l_quantity) AS INT) AS cnt, l_returnflag AS zone, p_brand AS category
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""
BLOCKS = """blocks AS (SELECT CAST(l_suppkey % 5 AS INT) AS map_id, CAST(l_partkey % 48 AS INT) AS x, CAST(l_orderkey % 48 AS INT) AS z,
 CAST((l_linenumber * 7 + CAST(FLOOR(l_quantity) AS INT)) % 32 AS INT) AS y, MAX(CAST(FLOOR(l_quantity) AS INT) % 40) AS block_id
 FROM lineitem GROUP BY 1, 2, 3, 4)"""
#: Cells of two kinds of block, thin enough for islands at small scale.
GROUND = """ground AS (SELECT DISTINCT CAST(l_suppkey % 5 AS INT) AS map_id, CAST(l_partkey % 48 AS INT) AS x, CAST(l_orderkey % 48 AS INT) AS z
 FROM lineitem WHERE CAST(FLOOR(l_quantity) AS INT) % 40 < 2)"""
#: Diamonds around a centre; their edges meet no block centre.
DIAMONDS = """diamonds AS (SELECT CAST(n_nationkey % 5 AS INT) AS map_id, CAST(n_nationkey AS INT) AS polygon_id, 'island' AS kind,
  CAST(n_nationkey * 7 % 64 - 32 AS INT) AS cx, CAST(n_nationkey * 11 % 64 - 32 AS INT) AS cz, CAST(6 + n_nationkey % 5 AS DOUBLE) + 0.25 AS r FROM nation
 UNION ALL SELECT CAST(r_regionkey AS INT), CAST(100 + r_regionkey AS INT), 'build_region', 0, 0, CAST(30.25 AS DOUBLE) FROM region)"""

PROJECTIONS = {"match_log": MATCH_LOG, "matches": MATCHES, "maps": MAPS, "chests": CHESTS, "blocks": BLOCKS, "ground": GROUND, "diamonds": DIAMONDS}

LIVES = """
spawns AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS segment_idx FROM match_log WHERE event_type = 2),
deaths AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS segment_idx FROM match_log WHERE event_type = 4),
lasts AS (SELECT match_id, player_id, max(t) AS last_t FROM match_log GROUP BY 1, 2),
placed AS (SELECT e.match_id, e.player_id, e.event_type, (SELECT max(s.segment_idx) FROM spawns s
  WHERE s.match_id = e.match_id AND s.player_id = e.player_id AND s.t <= e.t) AS segment_idx FROM match_log e WHERE e.event_type IN (3, 5, 6, 7)),
counts AS (SELECT match_id, player_id, segment_idx, count(*) FILTER (WHERE event_type = 5) AS position_count, count(*) FILTER (WHERE event_type = 3) AS kill_count,
  count(*) FILTER (WHERE event_type = 6) AS wool_touches, count(*) FILTER (WHERE event_type = 7) AS wool_captures FROM placed WHERE segment_idx IS NOT NULL GROUP BY 1, 2, 3),
lives AS (SELECT s.match_id, s.player_id, CAST(s.segment_idx AS INT) AS segment_idx, s.t AS start_timestamp, coalesce(d.t, l.last_t) AS end_timestamp,
  coalesce(d.t, l.last_t) - s.t AS duration, CASE WHEN d.t IS NULL THEN 'match_end' ELSE 'death' END AS outcome, s.x AS spawn_x, s.z AS spawn_z,
  coalesce(position_count, 0) AS position_count, coalesce(kill_count, 0) AS kill_count, coalesce(wool_touches, 0) AS wool_touches, coalesce(wool_captures, 0) AS wool_captures
  FROM spawns s LEFT JOIN deaths d USING (match_id, player_id, segment_idx) LEFT JOIN lasts l USING (match_id, player_id) LEFT JOIN counts c USING (match_id, player_id, segment_idx))"""

#: Team intervals ``match_id, player_id, team_segment_id, team, start_timestamp, end_timestamp`` (open at the end).
TEAMS = """teams AS (
 SELECT match_id, player_id, row_id AS team_segment_id, team, t AS start_timestamp,
  lead(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS end_timestamp
 FROM (SELECT s.*, lag(team) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS before FROM (
  SELECT match_id, player_id, row_id, t, CASE WHEN abs(x) % 2 = 0 THEN 'red' ELSE 'blue' END AS team FROM match_log WHERE event_type = 2) s) c
 WHERE before IS NULL OR before <> team)"""

#: A match of the log stands on a map of the map table.
STAGED = "staged AS (SELECT l.*, map_slug FROM match_log l JOIN maps m ON l.match_id + 1 = m.map_id)"

_HELD = "{e}.match_id = {s}.match_id AND {e}.{who} = {s}.player_id AND {e}.t >= {s}.start_timestamp AND ({s}.end_timestamp IS NULL OR {e}.t {op} {s}.end_timestamp)"


def held(e: str, s: str, who: str = "player_id", right_closed: bool = False) -> str:
    """The valid-time join condition of events ``e`` to intervals ``s``; half-open unless ``right_closed``."""
    return _HELD.format(e=e, s=s, who=who, op="<=" if right_closed else "<")


#: Query name -> (inputs by name, tables, SQL).
TEAM_QUERIES: dict[str, tuple[list[str], str, str]] = {
    "j4_events_with_team_closed": (
        ["log", "teams"],
        "events",
        f"SELECT e.match_id, e.row_id, e.player_id, e.t, s.team FROM match_log e LEFT JOIN teams s ON {held('e', 's', right_closed=True)} WHERE e.event_type IN (3, 4)",
    ),
    "q4b_events_with_team": (
        ["log", "teams"],
        "events",
        f"SELECT e.match_id, e.row_id, e.player_id, e.event_type, e.t, s.team, e.victim_id FROM match_log e LEFT JOIN teams s ON {held('e', 's')} WHERE e.event_type IN (3, 4)",
    ),
    "q4c_friendly_fire": (
        ["log", "teams"],
        "events",
        f"SELECT e.match_id, e.row_id, e.player_id AS killer, e.victim_id AS victim, k.team, e.t FROM match_log e JOIN teams k ON {held('e', 'k')} JOIN teams v ON {held('e', 'v', 'victim_id')} WHERE e.event_type = 3 AND k.team = v.team",
    ),
    "q4d_team_kills_deaths": (
        ["log", "maps", "staged", "teams"],
        "events customer",
        f"SELECT map_slug, team, sum(CASE WHEN event_type = 3 THEN 1 ELSE 0 END) AS kills, sum(CASE WHEN event_type = 4 THEN 1 ELSE 0 END) AS deaths FROM staged e LEFT JOIN teams s ON {held('e', 's')} WHERE event_type IN (3, 4) GROUP BY map_slug, team",
    ),
    "q2b_team_distribution": (
        ["log", "teams", "maps"],
        "events customer",
        "SELECT map_slug, team, count(*) AS segments, count(DISTINCT player_id) AS players FROM teams s JOIN maps m ON s.match_id + 1 = m.map_id GROUP BY map_slug, team",
    ),
    "q2c_overlapping_segments": (["log", "teams"], "events", """SELECT DISTINCT b.match_id, b.player_id, b.team_segment_id, b.team FROM teams a JOIN teams b ON a.match_id = b.match_id AND a.player_id = b.player_id
  AND (a.start_timestamp, a.team_segment_id) < (b.start_timestamp, b.team_segment_id) AND b.start_timestamp < coalesce(a.end_timestamp + 40, 9999999999)"""),
    "q2d_team_switchers": (["log", "teams"], "events", """SELECT match_id, player_id, count(*) AS team_segments, count(DISTINCT team) AS n_teams, min(start_timestamp) AS first_start, string_agg(team, ',' ORDER BY start_timestamp, team_segment_id) AS team_sequence FROM teams GROUP BY match_id, player_id HAVING count(DISTINCT team) > 1"""),
    "j7_first_team": (
        ["log", "teams"],
        "events",
        "SELECT match_id, player_id, team FROM (SELECT s.*, row_number() OVER (PARTITION BY match_id, player_id ORDER BY start_timestamp, team_segment_id) AS rn FROM teams s) r WHERE rn = 1",
    ),
    "q2e_matches_without_teams": (["log", "teams", "matches"], "events orders", """SELECT match_id, map_id, player_count FROM matches m WHERE processed AND match_id NOT IN (SELECT match_id FROM teams)"""),
    "a11_wool_objectives": (
        ["log", "teams"],
        "events",
        f"SELECT DISTINCT e.match_id, e.wool_id, s.team FROM match_log e JOIN teams s ON {held('e', 's', right_closed=True)} WHERE e.event_type = 7",
    ),
    "a32_attacking_team": (
        ["log", "teams"],
        "events",
        f"SELECT match_id, wool_id, team FROM (SELECT e.match_id, e.wool_id, s.team, row_number() OVER (PARTITION BY e.match_id, e.wool_id ORDER BY e.t, e.row_id, s.team_segment_id) AS rn FROM match_log e JOIN teams s ON {held('e', 's')} WHERE e.event_type = 7) r WHERE rn = 1",
    ),
    "w14_first_capture": (
        ["log", "teams"],
        "events",
        f"SELECT match_id, team, wool_id, t FROM (SELECT e.match_id, e.wool_id, e.t, s.team, row_number() OVER (PARTITION BY e.match_id, s.team ORDER BY e.t, e.row_id) AS rn FROM match_log e JOIN teams s ON {held('e', 's')} WHERE e.event_type = 7) r WHERE rn = 1",
    ),
    "w13_objective_rank": (
        ["log"],
        "events",
        "SELECT match_id, wool_id, captured_at, row_number() OVER (PARTITION BY match_id ORDER BY coalesce(captured_at, 1000000000), wool_id) AS capture_rank FROM (SELECT match_id, wool_id, min(CASE WHEN event_type = 7 THEN t END) AS captured_at FROM match_log WHERE event_type IN (6, 7) GROUP BY match_id, wool_id) o",
    ),
    "w9_sampling_gap": (
        ["log"],
        "events",
        "SELECT match_id, round(median(gap), 6) AS median_gap FROM (SELECT match_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS gap FROM match_log WHERE event_type = 5) g WHERE gap > 0 AND gap < 30 GROUP BY match_id",
    ),
    "a2_log_interval": (
        ["log"],
        "events",
        "SELECT match_id, CASE WHEN median(CASE WHEN gap > 0 THEN gap END) >= 4 THEN 5 ELSE 2 END AS log_interval FROM (SELECT match_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS gap FROM match_log WHERE event_type = 5) g GROUP BY match_id",
    ),
    "a5_cell_transitions": (
        ["log"],
        "events",
        "SELECT match_id, least(c, p) AS cell_a, greatest(c, p) AS cell_b, count(*) AS transitions FROM (SELECT match_id, c, lag(c) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS p FROM (SELECT m.*, CAST(floor((x + 32) / 5.0) * 100 + floor((z + 32) / 5.0) AS INT) AS c FROM match_log m WHERE event_type = 5 AND y > 0) n) v WHERE p IS NOT NULL AND p <> c GROUP BY 1, 2, 3",
    ),
    "w5_cell_runs": (
        ["log"],
        "events",
        "SELECT match_id, player_id, run, min(c) AS cell, min(t) AS entry_timestamp, max(t) AS exit_timestamp, count(*) AS ticks FROM (SELECT v.*, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT n.*, lag(c) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS p FROM (SELECT m.*, CAST(floor((x + 32) / 16.0) * 100 + floor((z + 32) / 16.0) AS INT) AS c FROM match_log m WHERE event_type = 5) n) v) r GROUP BY match_id, player_id, run",
    ),
    "a9_wool_locations": (["log", "firsts"], "events", """SELECT map_id, wool_id, round(median(x), 6) AS x, round(median(z), 6) AS z, 'touches' AS source, count(*) AS first_touch_count, round(stddev_samp(x), 6) AS x_std, round(stddev_samp(z), 6) AS z_std FROM (
   SELECT f.match_id % 5 AS map_id, f.wool_id, f.x, f.z, abs(f.x - c.mx) + abs(f.z - c.mz) <= 20 AS near, max(CASE WHEN abs(f.x - c.mx) + abs(f.z - c.mz) <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY f.match_id % 5, f.wool_id) AS have
   FROM firsts f JOIN (SELECT match_id % 5 AS map_id, wool_id, median(x) AS mx, median(z) AS mz FROM firsts GROUP BY 1, 2) c ON f.match_id % 5 = c.map_id AND f.wool_id = c.wool_id) n WHERE near OR have = 0 GROUP BY map_id, wool_id"""),
    "a42_kill_distance": (
        ["log"],
        "events",
        "SELECT k.match_id, count(*) AS pairs, round(avg(sqrt(power(k.x - d.x, 2) + power(k.z - d.z, 2))), 6) AS mean_distance, round(max(sqrt(power(k.x - d.x, 2) + power(k.z - d.z, 2))), 6) AS max_distance FROM match_log k JOIN match_log d ON k.match_id = d.match_id AND k.victim_id = d.player_id AND k.t = d.t WHERE k.event_type = 3 AND d.event_type = 4 GROUP BY k.match_id",
    ),
    "q5c_orphans": (["log", "matches"], "events orders", """SELECT 'combat_events' AS kind, count(*) AS orphans FROM match_log WHERE event_type IN (3, 4) AND match_id NOT IN (SELECT match_id FROM matches WHERE processed)
  UNION ALL SELECT 'position_events', count(*) FROM match_log WHERE event_type = 5 AND match_id NOT IN (SELECT match_id FROM matches WHERE processed)
  UNION ALL SELECT 'wool_events', count(*) FROM match_log WHERE event_type IN (6, 7) AND match_id NOT IN (SELECT match_id FROM matches WHERE processed)"""),
    "q1e_unprocessed_matches": (["matches", "maps"], "orders customer", "SELECT match_id, map_slug FROM matches x JOIN maps m ON x.map_id = m.map_id WHERE NOT processed"),
    "q5f_duplicate_matches": (["matches"], "orders", "SELECT map_id, match_start, count(*) AS dupes FROM matches GROUP BY map_id, match_start HAVING count(*) > 1"),
    "q9b_zone_materials": (["chests"], "lineitem part", "SELECT map_id, item_id, sum(cnt) AS total_items FROM chests WHERE zone = 'R' GROUP BY map_id, item_id"),
    "q9c_defence_density": (
        ["chests"],
        "lineitem part",
        "SELECT map_id, count(DISTINCT CASE WHEN zone = 'R' THEN chest_id END) AS defence_chests, coalesce(sum(CASE WHEN zone = 'R' THEN cnt END), 0) AS defence_items, count(DISTINCT CASE WHEN zone = 'A' THEN chest_id END) AS wool_chests, round(CAST(sum(CASE WHEN zone = 'R' THEN cnt END) AS DOUBLE) / nullif(count(DISTINCT CASE WHEN zone = 'A' THEN chest_id END), 0), 6) AS items_per_wool FROM chests GROUP BY map_id",
    ),
    "q9e_maps_without_defence": (["chests"], "lineitem part", """SELECT chest_id AS map_id, count(DISTINCT map_id) AS total_chests FROM chests c WHERE NOT EXISTS (SELECT 1 FROM chests d WHERE d.chest_id = c.chest_id AND d.category = 'Brand#11' AND d.zone = 'R') GROUP BY chest_id"""),
    "a14_chest_categories": (
        ["chests"],
        "lineitem part",
        "SELECT map_id, chest_id, CASE WHEN steel > 0 THEN 'combat' WHEN brass > 0 THEN 'weapon' WHEN tin > 0 THEN 'supply' ELSE 'defence' END AS content_category FROM (SELECT map_id, chest_id, max(CASE WHEN item_id LIKE '%STEEL%' THEN 1 ELSE 0 END) AS steel, max(CASE WHEN item_id LIKE '%BRASS%' THEN 1 ELSE 0 END) AS brass, max(CASE WHEN item_id LIKE '%TIN%' THEN 1 ELSE 0 END) AS tin FROM chests GROUP BY map_id, chest_id) f",
    ),
    "a41_match_thresholds": (["matches", "maps"], "orders customer", """SELECT 'size_tier' AS grouping_key, coalesce(size_tier, 'ALL') AS label, count(*) AS n0, count(*) FILTER (WHERE n >= 1) AS n1, count(*) FILTER (WHERE n >= 5) AS n5, count(*) FILTER (WHERE n >= 10) AS n10, count(*) FILTER (WHERE n >= 20) AS n20 FROM (SELECT m.map_id, size_tier, team_count, count(x.match_id) AS n FROM maps m LEFT JOIN matches x ON m.map_id = x.map_id GROUP BY m.map_id, size_tier, team_count) c GROUP BY ROLLUP (size_tier)
 UNION ALL SELECT 'team_count', coalesce(CAST(team_count AS VARCHAR), 'ALL'), count(*) AS n0, count(*) FILTER (WHERE n >= 1) AS n1, count(*) FILTER (WHERE n >= 5) AS n5, count(*) FILTER (WHERE n >= 10) AS n10, count(*) FILTER (WHERE n >= 20) AS n20 FROM (SELECT m.map_id, size_tier, team_count, count(x.match_id) AS n FROM maps m LEFT JOIN matches x ON m.map_id = x.map_id GROUP BY m.map_id, size_tier, team_count) c GROUP BY ROLLUP (team_count)"""),
    "a39_daily_summary": (["matches"], "orders", "SELECT CAST(match_start AS DATE) AS day, count(*) AS n_matches, count(DISTINCT map_id) AS n_maps FROM matches GROUP BY 1"),
    "l7_vertical_density": (["blocks"], "lineitem", "SELECT map_id, x, z, count(*) AS n_blocks, max(y) - min(y) + 1 AS height, round(CAST(count(*) AS DOUBLE) / (max(y) - min(y) + 1), 6) AS density FROM blocks WHERE block_id <> 0 GROUP BY map_id, x, z"),
    "w18_longest_row_run": (
        ["blocks"],
        "lineitem",
        "SELECT map_id, z, max(n) AS longest FROM (SELECT map_id, z, run, count(*) AS n FROM (SELECT map_id, z, x, x - row_number() OVER (PARTITION BY map_id, z ORDER BY x) AS run FROM (SELECT DISTINCT map_id, z, x FROM blocks WHERE block_id < 3) d) r GROUP BY map_id, z, run) g GROUP BY map_id, z",
    ),
    "a22_terrain_clearance": (
        ["log", "blocks"],
        "events lineitem",
        "SELECT p.map_id, p.x, p.z, max(p.y - (surface_y + 1)) AS max_clearance, min(p.y - (surface_y + 1)) AS min_clearance, count(*) AS n FROM (SELECT match_id % 5 AS map_id, x, y, z FROM match_log WHERE event_type = 5) p JOIN (SELECT map_id, x, z, max(y) AS surface_y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY map_id, x, z) s ON p.map_id = s.map_id AND p.x = s.x AND p.z = s.z GROUP BY p.map_id, p.x, p.z",
    ),
}

#: First touch of each wool and match.
FIRSTS = "firsts AS (SELECT match_id, wool_id, x, z FROM (SELECT m.*, row_number() OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) AS rn FROM match_log m WHERE event_type = 6) r WHERE rn = 1)"


#: Events with the number of their life; a spawn comes before other events of its second, and -1 is before the first.
LIVED = """lived AS (SELECT l.*, CAST(sum(CASE WHEN event_type = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, player_id
  ORDER BY t, CASE WHEN event_type = 2 THEN 0 ELSE 1 END, row_id ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS segment_idx,
 CAST(floor(x / 5.0) * 5 AS INT) AS cx, CAST(floor(z / 5.0) * 5 AS INT) AS cz FROM match_log l)"""

#: Position samples of lives in order, with what stands before each in its life.
SAMPLES = """samples AS (SELECT s.*, lag(x) OVER life AS before_x, lag(z) OVER life AS before_z, lag(cx) OVER life AS before_cx, lag(cz) OVER life AS before_cz, lag(t) OVER life AS before_t
 FROM lived s WHERE event_type = 5 AND segment_idx >= 0 WINDOW life AS (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id))"""

#: Spawns and deaths of one player paired by their order.
SPANS = """spans AS (SELECT s.match_id, s.player_id, s.segment_idx, s.t AS start_timestamp, d.t AS end_timestamp FROM
  (SELECT match_id, player_id, t, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS segment_idx FROM match_log WHERE event_type = 2) s
 JOIN (SELECT match_id, player_id, t, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS segment_idx FROM match_log WHERE event_type = 4) d
 ON s.match_id = d.match_id AND s.player_id = d.player_id AND s.segment_idx = d.segment_idx)"""

#: Occupied cells of a match, numbered by their place.
CELLS = """cells AS (SELECT match_id, cx, cz, count(*) AS occupation, CAST(row_number() OVER (PARTITION BY match_id ORDER BY cx, cz) AS INT) AS node_id
 FROM samples GROUP BY match_id, cx, cz)"""

#: The block ids that count as resources and their names.
RESOURCES = """resources AS (SELECT * FROM (VALUES (35, 'wool'), (41, 'gold_block'), (42, 'iron_block'), (52, 'mob_spawner'), (57, 'diamond_block')) v (block_id, resource_type))"""

MORE = {"resources": RESOURCES, "lived": LIVED, "samples": SAMPLES, "spans": SPANS, "cells": CELLS}
_LIFE = ["log", "lived", "samples"]

#: Query name -> (inputs by name, tables, SQL).
LIFE_QUERIES: dict[str, tuple[list[str], str, str]] = {
    "j2_interval_lookup": (
        ["log", "spans"],
        "events",
        "SELECT e.match_id, e.row_id, min(s.segment_idx) AS segment_idx FROM match_log e LEFT JOIN spans s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND e.t <= s.end_timestamp WHERE e.event_type IN (3, 6, 7) GROUP BY e.match_id, e.row_id",
    ),
    "w1_player_ordinal": (["log"], "events", "SELECT match_id, player_id, row_id, row_number() OVER (PARTITION BY match_id, player_id, event_type ORDER BY t, row_id) - 1 AS ordinal FROM match_log WHERE event_type IN (2, 4)"),
    "w3_last_position": (
        _LIFE,
        "events",
        "SELECT match_id, player_id, segment_idx, t, x, y, z FROM (SELECT s.*, row_number() OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t DESC, row_id DESC) AS rn FROM samples s) r WHERE rn = 1",
    ),
    "w8_previous_cell": (_LIFE, "events", "SELECT match_id, player_id, segment_idx, row_id, cx, cz, before_cx, before_cz, t - before_t AS dt FROM samples"),
    "w22_deduplicated_cells": (_LIFE, "events", "SELECT match_id, player_id, segment_idx, row_id, cx, cz FROM samples WHERE before_cx IS NULL OR before_cx <> cx OR before_cz <> cz"),
    "w12_event_share": (["log"], "events", "SELECT event_type, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 6) AS pct FROM (SELECT event_type, count(*) AS n FROM match_log GROUP BY event_type) c"),
    "w15_climbs": (
        _LIFE,
        "events",
        """SELECT match_id, player_id, segment_idx, row_id, t, low_t FROM (
 SELECT r.*, max(CASE WHEN y >= 40 THEN t END) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_t FROM (
  SELECT s.*, max(CASE WHEN y <= 20 THEN t END) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low_t FROM samples s) r) h
 WHERE y >= 40 AND low_t IS NOT NULL AND t - low_t <= 90 AND (high_t IS NULL OR high_t < low_t)""",
    ),
    "w21_cumulative_share": (
        [*_LIFE, "cells"],
        "events",
        "SELECT match_id, node_id, occupation, round(CAST(1 AS DOUBLE) * sum(occupation) OVER (PARTITION BY match_id ORDER BY occupation DESC, node_id ROWS UNBOUNDED PRECEDING) / sum(occupation) OVER (PARTITION BY match_id), 9) AS share FROM cells",
    ),
    "a6_life_path": (
        _LIFE,
        "events",
        """SELECT match_id, player_id, segment_idx, samples, unique_cells, round(path, 6) AS path, round(span, 6) AS span, round(path / greatest(span, 1.0), 6) AS tortuosity FROM (
 SELECT match_id, player_id, segment_idx, count(*) AS samples, count(DISTINCT 100000 * cx + cz) AS unique_cells,
  sum(coalesce(sqrt(CAST((x - before_x) * (x - before_x) + (z - before_z) * (z - before_z) AS DOUBLE)), 0.0)) AS path,
  sqrt(CAST((max(x) - min(x)) * (max(x) - min(x)) + (max(z) - min(z)) * (max(z) - min(z)) AS DOUBLE)) AS span FROM samples GROUP BY match_id, player_id, segment_idx) f WHERE samples >= 4""",
    ),
    "a8_life_height": (_LIFE, "events", "SELECT match_id, player_id, segment_idx, round(avg(y), 9) AS mean_y, round(avg(CASE WHEN y >= 22 THEN 1 ELSE 0 END), 9) AS high_share FROM samples GROUP BY match_id, player_id, segment_idx HAVING count(*) >= 4"),
    "a16_block_ids": (["blocks"], "lineitem", "SELECT DISTINCT map_id, block_id FROM blocks"),
    "a17_surface_blocks": (["blocks"], "lineitem", "SELECT map_id, count(*) AS surface_blocks FROM (SELECT map_id, x, z FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY map_id, x, z) s GROUP BY map_id"),
    "a19_excavation": (
        ["log", "maps", "staged"],
        "events customer",
        "SELECT map_slug, x, z, min(low) AS lowest, max(low) - min(low) AS floor_range, count(*) AS matches FROM (SELECT map_slug, match_id, x, z, min(y) AS low FROM staged WHERE event_type = 5 GROUP BY map_slug, match_id, x, z) f GROUP BY map_slug, x, z",
    ),
    "a23_dominant_location": (["log", "diamonds", "placed"], "events nation region", """SELECT match_id, cx, cz, location_type, n FROM (SELECT c.*, row_number() OVER (PARTITION BY match_id, cx, cz ORDER BY n DESC, location_type) AS rn FROM (SELECT match_id, CAST(floor(x / 5.0) * 5 AS INT) AS cx, CAST(floor(z / 5.0) * 5 AS INT) AS cz, location_type, count(*) AS n FROM placed WHERE event_type = 5 GROUP BY 1, 2, 3, 4) c) r WHERE rn = 1"""),
    "a29_sky_cells": (_LIFE, "events", "SELECT match_id, cx, cz, count(*) AS n, count(DISTINCT player_id) AS players FROM samples WHERE y >= 40 GROUP BY match_id, cx, cz HAVING count(*) >= 3"),
    "a35_depth_series": (
        _LIFE,
        "events",
        """SELECT p.match_id, p.minute, round(mean_depth, 6) AS mean_depth, round(sd_depth, 6) AS sd_depth, coalesce(deaths, 0) AS deaths FROM (
 SELECT match_id, CAST(floor(t / 60.0) AS INT) AS minute, avg(depth) AS mean_depth, stddev_samp(depth) AS sd_depth FROM (
  SELECT match_id, t, greatest(0.0, least(1.0, 1.0 - sqrt(CAST(x * x + z * z AS DOUBLE)) / 45.0)) AS depth FROM samples) d GROUP BY 1, 2) p
 LEFT JOIN (SELECT match_id, CAST(floor(t / 60.0) AS INT) AS minute, count(*) AS deaths FROM match_log WHERE event_type = 4 GROUP BY 1, 2) k ON p.match_id = k.match_id AND p.minute = k.minute""",
    ),
    "a36_top_player": (
        ["log"],
        "events",
        "SELECT match_id, player_id, kills FROM (SELECT k.*, row_number() OVER (PARTITION BY match_id ORDER BY kills DESC, player_id) AS rn FROM (SELECT match_id, player_id, count(*) AS kills FROM match_log WHERE event_type = 3 GROUP BY match_id, player_id) k) r WHERE rn = 1",
    ),
    "l1_ground_layer": (["blocks"], "lineitem", "SELECT map_id, x, z, block_id FROM blocks WHERE y = 0 AND block_id <> 0"),
    "l4_lowest_bedrock": (["blocks"], "lineitem", "SELECT map_id, x, z, min(y) AS y FROM blocks WHERE block_id = 7 GROUP BY map_id, x, z"),
    "l7_resource_blocks": (
        ["blocks", "resources"],
        "lineitem",
        "SELECT map_id, x, y, z, resource_type FROM blocks JOIN resources USING (block_id)",
    ),
    "w19_longest_column_run": (
        ["blocks"],
        "lineitem",
        "SELECT map_id, x, z, max(n) AS longest FROM (SELECT map_id, x, z, run, count(*) AS n FROM (SELECT map_id, x, z, y - row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS run FROM blocks WHERE block_id <> 0) r GROUP BY map_id, x, z, run) g GROUP BY map_id, x, z",
    ),
    "g11_cell_adjacency": (
        [*_LIFE, "cells"],
        "events",
        "SELECT a.match_id, a.node_id AS src, b.node_id AS dst FROM cells a JOIN cells b ON a.match_id = b.match_id AND a.cx + 5 = b.cx AND a.cz = b.cz UNION ALL SELECT a.match_id, a.node_id, b.node_id FROM cells a JOIN cells b ON a.match_id = b.match_id AND a.cx = b.cx AND a.cz + 5 = b.cz",
    ),
    "g17_team_distances": (
        ["log", "teams", "centres"],
        "events",
        "SELECT a.match_id, a.team, b.team AS other, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z)), 6) AS distance FROM centres a JOIN centres b ON a.match_id = b.match_id AND a.team <> b.team",
    ),
    "g21_team_segments": (["log", "diamonds"], "events nation region", """SELECT match_id, player_id, team, t AS start_timestamp, lead(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS end_timestamp FROM (
   SELECT n.*, lag(team) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS before FROM (
    SELECT e.match_id, e.player_id, e.row_id, e.t, (SELECT 'team' || d.polygon_id FROM diamonds d WHERE d.map_id = e.match_id % 5 AND d.kind = 'island'
      ORDER BY CASE WHEN abs(e.x - d.cx) <= 3 AND abs(e.z - d.cz) <= 3 THEN 0 ELSE 1 END, CASE WHEN abs(e.x - d.cx) <= 3 AND abs(e.z - d.cz) <= 3 THEN 0 ELSE (e.x - d.cx) * (e.x - d.cx) + (e.z - d.cz) * (e.z - d.cz) END, d.polygon_id LIMIT 1) AS team
    FROM match_log e WHERE e.event_type = 2) n) c WHERE before IS NULL OR before <> team"""),
    "q0a_maps": (["maps"], "customer", "SELECT map_id, map_slug FROM maps"),
    "q1b_map_sampling_gap": (
        ["log", "maps", "staged"],
        "events customer",
        "SELECT map_slug, match_id, median(gap) AS median_gap FROM (SELECT map_slug, match_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS gap FROM staged WHERE event_type = 5) g WHERE gap > 0 AND gap < 30 GROUP BY map_slug, match_id",
    ),
    "q1c_matches": (["matches", "maps"], "orders customer", "SELECT match_id, m.map_id, map_slug, match_duration, player_count, processed FROM matches x JOIN maps m ON x.map_id = m.map_id"),
    "q1f_row_counts": (["log", "matches", "maps", "chests"], "events orders customer lineitem part", "SELECT 'match_log' AS name, count(*) AS n FROM match_log UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'maps', count(*) FROM maps UNION ALL SELECT 'chests', count(*) FROM chests"),
    "q1g_spawns": (["log", "maps", "staged"], "events customer", "SELECT map_slug, x, z, count(*) AS n FROM staged WHERE event_type = 2 GROUP BY map_slug, x, z"),
    "q5g_maps_without_spawns": (["log", "maps"], "events customer", """SELECT map_id, map_slug FROM maps WHERE map_id NOT IN (SELECT match_id + 1 FROM match_log WHERE event_type = 2)"""),
    "q6a_marker_share": (["blocks"], "lineitem", "SELECT map_id, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE block_id = 36) / count(*), 6) AS pct FROM blocks WHERE y = 0 GROUP BY map_id"),
}

#: Mean spawn of each team.
MORE["centres"] = """centres AS (SELECT s.match_id, s.team, avg(l.x) AS x, avg(l.z) AS z FROM teams s JOIN match_log l ON l.match_id = s.match_id AND l.row_id = s.team_segment_id GROUP BY s.match_id, s.team)"""


#: Query name -> (inputs, tables, SQL).
SHARED: dict[str, tuple[list[str], str, str]] = {
    "q1a_maps_with_matches": ([MATCHES, MAPS], "orders customer", "SELECT m.map_id, map_slug, count(match_id) AS n_matches, coalesce(sum(player_count), 0) AS players, round(avg(match_duration), 6) AS avg_duration FROM maps m LEFT JOIN matches x ON m.map_id = x.map_id GROUP BY m.map_id, map_slug"),
    "q1d_processing_status": ([MATCHES], "orders", "SELECT processed, count(*) AS n FROM matches GROUP BY processed"),
    "a18_match_statistics": ([MATCHES], "orders", "SELECT coalesce(CAST(map_id AS VARCHAR(9)), 'ALL') AS map_key, count(*) AS n, count(*) FILTER (WHERE processed) AS n_processed, sum(player_count) AS players FROM matches GROUP BY ROLLUP (map_id)"),
    "w11_map_size_buckets": ([MAPS], "customer", "SELECT map_id, total_blocks, ntile(5) OVER (ORDER BY total_blocks, map_id) AS size_bucket FROM maps"),
    "q7a_match_gaps": ([MATCHES, MAPS], "orders customer", """SELECT match_id, next_match, before_slug, after_slug, gap_seconds,
  CASE WHEN match_duration >= 3600 THEN CAST(match_duration // 3600 AS VARCHAR) || 'h ' ELSE '' END || CASE WHEN match_duration % 3600 >= 60 THEN CAST(match_duration % 3600 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST(match_duration % 60 AS VARCHAR) || 's' AS duration,
  CASE WHEN gap_seconds >= 3600 THEN CAST(gap_seconds // 3600 AS VARCHAR) || 'h ' ELSE '' END || CASE WHEN gap_seconds % 3600 >= 60 THEN CAST(gap_seconds % 3600 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST(gap_seconds % 60 AS VARCHAR) || 's' AS gap_duration
 FROM (SELECT match_id, match_duration, map_slug AS before_slug, lead(match_id) OVER w AS next_match, lead(map_slug) OVER w AS after_slug,
   CAST(epoch(CAST(lead(match_start) OVER w AS TIMESTAMP)) - epoch(CAST(match_start AS TIMESTAMP)) AS BIGINT) - match_duration AS gap_seconds
  FROM matches x JOIN maps m USING (map_id) WINDOW w AS (ORDER BY match_start, match_id)) g WHERE gap_seconds >= 6000"""),
    "j15_maps_without_matches": ([MATCHES, MAPS], "orders customer", "SELECT map_id, map_slug FROM maps m WHERE NOT EXISTS (SELECT 1 FROM matches x WHERE x.map_id = m.map_id AND processed)"),
    "a40_match_coverage": ([MATCHES], "orders", """SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 15 THEN '6-15' WHEN n <= 30 THEN '16-30' WHEN n <= 60 THEN '31-60' ELSE '61+' END AS bucket, count(*) AS maps,
  round(avg(n), 6) AS mean_matches, CAST(median(n) AS DOUBLE) AS median_matches, max(n) AS most_matches FROM (SELECT map_id, count(*) AS n FROM matches GROUP BY map_id) c GROUP BY 1"""),
    "w20_weekly_longest": ([MATCHES], "orders", "SELECT CAST(wk AS DATE) AS week_start, match_id, match_duration FROM (SELECT date_trunc('week', match_start) AS wk, match_id, match_duration, row_number() OVER (PARTITION BY date_trunc('week', match_start) ORDER BY match_duration DESC, match_id) AS rn FROM matches) r WHERE rn <= 3"),
    "q9a_zone_category_share": ([CHESTS], "lineitem part", "SELECT zone, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY zone), 6) AS pct FROM (SELECT zone, category, count(*) AS n FROM chests GROUP BY 1, 2) c"),
    "q9d_category_summary": ([CHESTS], "lineitem part", "SELECT category, n, total, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM (SELECT category, count(*) AS n, sum(cnt) AS total FROM chests GROUP BY 1) c"),
    "l2_top_surface": ([BLOCKS], "lineitem", """SELECT map_id, x, z, y, block_id FROM (SELECT b.*, row_number() OVER (PARTITION BY map_id, x, z ORDER BY y DESC) AS rn FROM blocks b WHERE block_id NOT IN (0, 36) AND y <= 28) r WHERE rn = 1"""),
    "l5_lowest_solid": ([BLOCKS], "lineitem", "SELECT map_id, x, z, y, block_id FROM (SELECT b.*, row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS rn FROM blocks b WHERE block_id NOT IN (0, 36)) r WHERE rn = 1"),
    "l6_vertical_segments": ([BLOCKS], "lineitem", "SELECT map_id, x, z, min(y) AS y_start, max(y) AS y_end FROM (SELECT map_id, x, z, y, y - row_number() OVER (PARTITION BY map_id, x, z ORDER BY y) AS run FROM blocks WHERE block_id <> 0) r GROUP BY map_id, x, z, run HAVING count(*) >= 2"),
    "a15_block_inventory": ([BLOCKS], "lineitem", "SELECT map_id, block_id, count(*) AS n, min(y) AS y_min, max(y) AS y_max FROM blocks GROUP BY map_id, block_id"),
    "j8_kill_death_pairs": ([MATCH_LOG], "events", "SELECT k.match_id, k.t, k.player_id AS killer, k.victim_id, k.row_id AS kill_row, d.row_id AS death_row FROM match_log k JOIN match_log d ON k.match_id = d.match_id AND k.victim_id = d.player_id AND k.t = d.t WHERE k.event_type = 3 AND d.event_type = 4"),
    "a12_wool_waves": ([MATCH_LOG], "events", "SELECT match_id, wool_id, wave_idx, min(t) AS start_timestamp, max(t) AS end_timestamp, count(*) AS touches, count(DISTINCT player_id) AS n_carriers FROM (SELECT w.*, sum(new_wave) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) - 1 AS wave_idx FROM (SELECT m.*, CASE WHEN t - lag(t) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) <= 12 THEN 0 ELSE 1 END AS new_wave FROM match_log m WHERE event_type = 6) w) v GROUP BY match_id, wool_id, wave_idx"),
    "a10_wool_monuments": ([MATCH_LOG], "events", "SELECT match_id, wool_id, x, z, count(*) AS capture_count FROM match_log WHERE event_type = 7 GROUP BY match_id, wool_id, x, z"),
    "w2_first_touch": ([MATCH_LOG], "events", "SELECT match_id, wool_id, player_id, t FROM (SELECT m.*, row_number() OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) AS rn FROM match_log m WHERE event_type = 6) r WHERE rn = 1"),
    "a4_cell_occupation": ([MATCH_LOG, DIAMONDS], "events nation region", """SELECT o.match_id, o.cx, o.cz, occupation, players, island_id FROM (SELECT match_id, CAST(floor(x / 5.0) * 5 AS INT) AS cx, CAST(floor(z / 5.0) * 5 AS INT) AS cz, count(*) AS occupation, count(DISTINCT player_id) AS players FROM match_log WHERE event_type = 5 AND y > 0 GROUP BY 1, 2, 3) o
  LEFT JOIN (SELECT * FROM (SELECT match_id, CAST(floor(x / 5.0) * 5 AS INT) AS cx, CAST(floor(z / 5.0) * 5 AS INT) AS cz, island_id, row_number() OVER (PARTITION BY match_id, floor(x / 5.0), floor(z / 5.0) ORDER BY count(*) DESC, island_id) AS rn FROM (SELECT e.*, (SELECT min(polygon_id) FROM diamonds d WHERE d.map_id = e.match_id % 5 AND d.kind = 'island' AND abs(e.x + 0.5 - d.cx) + abs(e.z + 0.5 - d.cz) < d.r) AS island_id FROM match_log e) p
   WHERE event_type = 5 AND y > 0 AND island_id IS NOT NULL GROUP BY match_id, floor(x / 5.0), floor(z / 5.0), island_id) r WHERE rn = 1) i ON o.match_id = i.match_id AND o.cx = i.cx AND o.cz = i.cz"""),
    "a24_population_curve": ([MATCH_LOG], "events", "SELECT match_id, CAST(round(t / 60.0) AS INT) AS minute, count(DISTINCT player_id) AS players FROM match_log GROUP BY 1, 2"),
}

#: Events with the diamond, or else the region around the origin, that holds their block's centre.
PLACED = """placed AS (SELECT e.*, e.match_id % 5 AS map_id, CASE WHEN island_id IS NOT NULL THEN 'island' WHEN abs(x + 0.5) + abs(z + 0.5) < 30.25 THEN 'build_region' ELSE 'void' END AS location_type FROM (SELECT e.*, (SELECT min(polygon_id) FROM diamonds d WHERE d.map_id = e.match_id % 5 AND d.kind = 'island' AND abs(e.x + 0.5 - d.cx) + abs(e.z + 0.5 - d.cz) < d.r) AS island_id FROM match_log e) e)"""

INPUTS = {"placed": PLACED, "log": MATCH_LOG, "matches": MATCHES, "maps": MAPS, "chests": CHESTS, "blocks": BLOCKS, "ground": GROUND, "diamonds": DIAMONDS, "teams": TEAMS, "staged": STAGED, "firsts": FIRSTS} | MORE
SHARED |= {name: ([INPUTS[i] for i in inputs], tables, sql) for name, (inputs, tables, sql) in (TEAM_QUERIES | LIFE_QUERIES).items()}

#: Cells of a match with two samples or more, numbered in the order of their place.
BUSY = ["log", "lived", "samples", "cells"]
NODES = "SELECT match_id, CAST(node_id AS BIGINT) AS node, cx, cz FROM cells WHERE occupation >= 2"


BUSY_WALK = f"""WITH RECURSIVE {{inputs}}, nodes AS MATERIALIZED ({NODES}), edges AS MATERIALIZED (SELECT a.match_id, a.node AS src, b.node AS dst FROM nodes a JOIN nodes b
 ON a.match_id = b.match_id AND abs(a.cx - b.cx) + abs(a.cz - b.cz) = 5)"""
BUSY_SQL = {
    "g2_largest_component": BUSY_WALK + """, walk AS (SELECT match_id, node, node AS root FROM nodes UNION SELECT e.match_id, e.dst, w.root FROM walk w JOIN edges e ON w.match_id = e.match_id AND w.node = e.src),
 named AS (SELECT match_id, node, min(root) AS component FROM walk GROUP BY 1, 2), sized AS (SELECT match_id, component, count(*) AS size FROM named GROUP BY 1, 2),
 best AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY size DESC, component) AS rn FROM sized)
 SELECT n.match_id, n.node, n.component, b.size FROM named n JOIN best b ON n.match_id = b.match_id AND n.component = b.component WHERE rn = 1""",
    "g6_shortest_distances": BUSY_WALK + """, wools AS (SELECT DISTINCT n.match_id, n.node FROM nodes n JOIN match_log e ON e.match_id = n.match_id AND e.event_type = 7 AND floor(e.x / 5.0) * 5 = n.cx AND floor(e.z / 5.0) * 5 = n.cz),
 walk AS (SELECT match_id, node AS source, node, 0 AS hops FROM wools UNION SELECT e.match_id, w.source, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.match_id = e.match_id AND w.node = e.src WHERE w.hops < 40)
 SELECT match_id, source, node, CAST(5 * min(hops) AS DOUBLE) AS distance FROM walk GROUP BY match_id, source, node""",
}



def composed(inputs: list[str], sql: str) -> str:
    """``sql`` behind the named inputs; it may begin with further ones after a comma."""
    text = f"WITH RECURSIVE {', '.join(INPUTS[i] for i in inputs)}{'' if sql.startswith(',') else ' '}{sql}"
    return text.replace("{ep}", "epoch(ts)")


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    own = {
        "a1_life_segments": f"WITH {MATCH_LOG}, {LIVES} SELECT * FROM lives",
        "q4a_life_outcomes": f"WITH {MATCH_LOG}, {MAPS}, {STAGED}, {LIVES} SELECT map_slug, outcome, count(*) AS n FROM lives l JOIN maps m ON l.match_id + 1 = m.map_id GROUP BY map_slug, outcome",
    }
    own |= {name: sql.replace("{inputs}", ", ".join(INPUTS[i] for i in BUSY)) for name, sql in BUSY_SQL.items()}
    shared = {name: f"WITH {', '.join(inputs)} {sql}" for name, (inputs, _, sql) in SHARED.items()}
    return {k: v.replace("{ep}", "epoch(ts)") for k, v in (own | shared).items()}
