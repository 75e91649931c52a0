"""Registered queries over structures, routes, forks and life features, each beside its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import scalars
from matchspark.operators import archetypes, blocks, cluster_graph, forks, graph, life_features, objective_rooms, points_of_interest, routes, shapes, spatial, structures, studies, team_shapes, trajectories
from matchspark.operators.paths import both_ways
from matchspark.operators.sessions import LIFE, asof_segment
from matchspark.plans.inputs import Inputs
from matchspark.plans.map_queries import BOX, TRAFFIC, VISITS, WALK, island_cells, traffic, visits
from matchspark.plans.match_queries import busy_graph, r6
from matchspark.session import cut, scratch_path
from matchspark.sources import warehouse

QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], list[str], str]] = {}


def query(inputs: str, sql: str):
    """Register a function under its name with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = (f, inputs.split(), sql)
        return f

    return keep


def sloped(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Standing samples over the terrain of five maps, and their cells with slopes."""
    surface = blocks.top_surface(i.blocks).withColumnRenamed("y", "surface_y")
    samples = blocks.over_terrain(i.mapped, surface)
    cells = structures.standing_cells(samples, "map_id", 2, -40, 5)
    return samples, structures.local_slopes(cells, "map_id", 5)


#: Local planes in SQL: every pair of near cells, and the normal equations by their textbook determinants.
SLOPES = """, surface AS (SELECT map_id, x, z, max(y) AS surface_y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3),
 stood AS MATERIALIZED (SELECT s.*, s.match_id % 5 AS map_id, s.y - (surface_y + 1) AS rel FROM samples s LEFT JOIN surface f ON f.map_id = s.match_id % 5 AND f.x = s.x AND f.z = s.z),
 caps AS (SELECT map_id, floor(quantile_cont(rel, 0.99)) AS cap FROM stood WHERE rel IS NOT NULL GROUP BY 1),
 kept AS (SELECT map_id, cx, cz, count(*) AS n, median(rel) AS h FROM stood WHERE rel IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND median(rel) >= -40),
 cells AS MATERIALIZED (SELECT s.*, cap FROM kept s JOIN caps USING (map_id) WHERE map_id IN (SELECT map_id FROM kept GROUP BY 1 HAVING count(*) >= 5)),
 pairs AS (SELECT a.map_id, a.cx, a.cz, CAST(b.cx - a.cx AS DOUBLE) AS u, CAST(b.cz - a.cz AS DOUBLE) AS v, b.h AS y FROM cells a JOIN cells b ON a.map_id = b.map_id AND (a.cx - b.cx) * (a.cx - b.cx) + (a.cz - b.cz) * (a.cz - b.cz) <= 64),
 sums AS (SELECT map_id, cx, cz, count(*) AS k, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy, var_pop(y) AS yy FROM pairs GROUP BY 1, 2, 3),
 fits AS (SELECT *, uu * vv - uv * uv AS det, CASE WHEN abs(uu * vv - uv * uv) < 1e-9 THEN uy / (uu + vv) ELSE (uy * vv - vy * uv) / (uu * vv - uv * uv) END AS a, CASE WHEN abs(uu * vv - uv * uv) < 1e-9 THEN vy / (uu + vv) ELSE (vy * uu - uy * uv) / (uu * vv - uv * uv) END AS b FROM sums WHERE k >= 6),
 slopes AS MATERIALIZED (SELECT c.*, CASE WHEN a IS NULL THEN 0 ELSE sqrt(a * a + b * b) END AS gradient, CASE WHEN a IS NULL THEN 9 ELSE sqrt(greatest(0, yy - a * uy - b * vy)) END AS residual FROM cells c LEFT JOIN fits USING (map_id, cx, cz))"""


@query("log lived samples blocks", f"{SLOPES} SELECT map_id, cx, cz, n, h, cap, round(gradient, 6) AS gradient, round(residual, 6) AS residual FROM slopes")
def l42_local_slopes(i: Inputs) -> DataFrame:
    return sloped(i)[1].withColumns({c: r6(c) for c in ("gradient", "residual")})


RUNS = f"""{SLOPES}, steep AS MATERIALIZED (SELECT *, (CAST(cx AS BIGINT) + 1073741824) * 4294967296 + cz + 1073741824 AS node FROM slopes WHERE gradient >= 0.35 AND residual <= 12 AND h <= cap - 2),
 spread AS (SELECT map_id, cx, cz, node FROM steep UNION SELECT o.map_id, o.cx, o.cz, s.node FROM spread s JOIN steep o ON o.map_id = s.map_id AND abs(o.cx - s.cx) <= 5 AND abs(o.cz - s.cz) <= 5),
 ramps AS MATERIALIZED (SELECT s.*, run FROM steep s JOIN (SELECT map_id, cx, cz, min(node) AS run FROM spread GROUP BY 1, 2, 3) r USING (map_id, cx, cz)),
 whole AS (SELECT map_id, run, count(*) AS cells, sum(n) AS samples, avg(cx) AS x, avg(cz) AS z, 0.5 * atan2(2 * covar_pop(cx, cz), var_pop(cx) - var_pop(cz)) AS turn, max(h) - min(h) AS rise FROM ramps GROUP BY 1, 2 HAVING count(*) >= 3),
 laid AS (SELECT w.*, h, (cx - x) * cos(turn) + (cz - z) * sin(turn) AS p, (cz - z) * cos(turn) - (cx - x) * sin(turn) AS q FROM ramps JOIN whole w USING (map_id, run)),
 runs AS MATERIALIZED (SELECT *, g_long / greatest(g_across, 0.02) AS ratio FROM (SELECT map_id, run, any_value(cells) AS cells, CAST(any_value(samples) AS BIGINT) AS samples, any_value(x) AS x, any_value(z) AS z, any_value(rise) AS rise, max(p) - min(p) AS length, max(q) - min(q) AS width,
  CASE WHEN var_pop(p) > 1e-9 THEN abs(covar_pop(p, h) / var_pop(p)) ELSE 0 END AS g_long, CASE WHEN var_pop(q) > 1e-9 THEN abs(covar_pop(q, h) / var_pop(q)) ELSE 0 END AS g_across FROM laid GROUP BY 1, 2) g)"""
FIGURES = ["x", "z", "length", "width", "g_long", "g_across", "ratio"]


def runs(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    samples, cells = sloped(i)
    ramps = structures.ramp_cells(cells, "map_id", 5, 0.35, 12.0)
    return samples, ramps, structures.ramp_runs(ramps, "map_id", 3)


@query("log lived samples blocks", f"{RUNS} SELECT map_id, run, cells, samples, rise, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)} FROM runs")
def l42_ramp_runs(i: Inputs) -> DataFrame:
    return runs(i)[2].withColumns({c: r6(c) for c in FIGURES})


STRUCTURES = f"""{RUNS}, firsts AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY map_id ORDER BY samples DESC, run) AS place FROM runs r) p WHERE place <= 16),
 rooms AS (SELECT f.*, polygon_id AS wool_id, sqrt(pow(greatest(cx - 2 - x, x - cx - 2, 0), 2) + pow(greatest(cz - 2 - z, z - cz - 2, 0), 2)) AS room_distance, row_number() OVER (PARTITION BY f.map_id, run ORDER BY sqrt(pow(greatest(cx - 2 - x, x - cx - 2, 0), 2) + pow(greatest(cz - 2 - z, z - cz - 2, 0), 2)), polygon_id) AS k FROM firsts f JOIN diamonds d ON d.map_id = f.map_id AND d.kind = 'island'),
 kinds AS (SELECT *, CASE WHEN ratio >= 2.5 AND g_long >= 0.45 AND width <= 14 THEN 'stair' WHEN room_distance <= 25 AND g_long <= 0.35 AND ratio < 2 AND width <= 12 AND length >= 8 THEN 'wall' END AS kind FROM rooms WHERE k = 1),
 here AS (SELECT r.map_id, r.run, CASE WHEN o.player_id % 2 = 0 THEN 'red' ELSE 'blue' END AS team, o.k4 FROM stood o JOIN ramps r ON r.map_id = o.map_id AND r.cx = o.cx AND r.cz = o.cz),
 own AS (SELECT map_id, run, count(*) AS standing, count(*) FILTER (team = 'red') AS red, count(*) FILTER (team = 'blue') AS blue, avg(CASE WHEN k4 = 1 THEN 1.0 ELSE 0 END) AS bow, avg(CASE WHEN k4 IN (2, 3) THEN 1.0 ELSE 0 END) AS detail FROM here GROUP BY 1, 2 HAVING count(*) >= 5),
 found AS MATERIALIZED (SELECT k.map_id, run, kind, cells, samples, rise, wool_id, round(room_distance, 6) AS room_distance, CASE WHEN red > blue THEN 'red' ELSE 'blue' END AS owner, round(greatest(red, blue) * 1.0 / standing, 6) AS owner_share, round(bow, 6) AS bow, round(detail, 6) AS detail, round(g_long, 6) AS g_long,
  CASE WHEN abs(-30 - x) <= abs(30 - x) THEN CASE WHEN abs(-30 - x) < abs(30 - x) THEN 'red' ELSE 'blue' END ELSE 'blue' END AS spawn_team, round(sqrt(pow(least(greatest(-32 - x, x + 28, 0), greatest(28 - x, x - 32, 0)), 2) + pow(greatest(-2 - z, z - 2, 0), 2)), 6) AS spawn_distance,
  CASE WHEN wool_id % 3 > 0 THEN CASE WHEN (CASE WHEN red > blue THEN 'red' ELSE 'blue' END) <> (CASE wool_id % 3 WHEN 1 THEN 'red' ELSE 'blue' END) THEN 'defender' ELSE 'attacker' END END AS role FROM kinds k JOIN own USING (map_id, run) WHERE kind IS NOT NULL)"""


def built(i: Inputs) -> DataFrame:
    """Structures near the diamonds (as rooms), with a spawn at each end of the map."""
    samples, ramps, figures = runs(i)
    d = i.adapted("diamonds").where("kind = 'island'").withColumnRenamed("polygon_id", "wool_id")
    box = lambda x, z: [(F.col(x) - 2).alias("min_x"), (F.col(x) + 2).alias("max_x"), (F.col(z) - 2).alias("min_z"), (F.col(z) + 2).alias("max_z")]
    rooms = d.select("map_id", "wool_id", *box("cx", "cz"))
    ends = F.explode(F.array(F.struct(F.lit("red").alias("spawn_team"), F.lit(-30).alias("x")), F.struct(F.lit("blue").alias("spawn_team"), F.lit(30).alias("x"))))
    spawns = d.select("map_id").distinct().select("map_id", ends.alias("e")).select("map_id", "e.*", F.lit(0).alias("z")).select("map_id", "spawn_team", *box("x", "z"))
    attackers = d.select("map_id", "wool_id", F.when(F.col("wool_id") % 3 == 1, "red").when(F.col("wool_id") % 3 == 2, "blue").alias("attacker"))
    held = samples.select("map_id", "cx", "cz", F.when(F.col("player_id") % 2 == 0, "red").otherwise("blue").alias("team"), F.col("k4").alias("held_item"))
    return structures.structures(figures, ramps, held, rooms, spawns, attackers, "map_id", 1, [2, 3], 16, 5)


@query("log lived samples blocks diamonds", f"{STRUCTURES} SELECT * FROM found")
def a33_structures(i: Inputs) -> DataFrame:
    rounded = {c: r6(c) for c in ("room_distance", "owner_share", "bow", "detail", "g_long", "spawn_distance")}
    return built(i).withColumns(rounded).select("map_id", "run", "kind", "cells", "samples", "rise", "wool_id", "room_distance", "owner", "owner_share", "bow", "detail", "g_long", "spawn_team", "spawn_distance", "role")


@query("log lived samples blocks diamonds", f"{STRUCTURES} SELECT count(*) FILTER (kind = 'wall' AND role IS NOT NULL) AS walls, count(*) FILTER (kind = 'wall' AND role = 'defender') AS defended, round(median(room_distance) FILTER (kind = 'wall' AND role IS NOT NULL), 6) AS wall_distance, count(*) FILTER (kind = 'stair' AND spawn_distance <= 45) AS stairs, count(*) FILTER (kind = 'stair' AND spawn_distance <= 45 AND owner = spawn_team) AS own_stairs, round(median(g_long) FILTER (kind = 'stair' AND spawn_distance <= 45), 6) AS stair_gradient FROM found")
def a57_structure_sweep(i: Inputs) -> DataFrame:
    return structures.structure_sweep(built(i)).withColumns({c: r6(c) for c in ("wall_distance", "stair_gradient")})


#: Touches of lives in SQL, each with the place of its objective and a spawn at its team's end, and the samples that lead to it.
REACHED = """, w AS (SELECT match_id % 5 AS map_id, wool_id, median(x) AS wx, median(z) AS wz FROM match_log WHERE event_type = 7 GROUP BY 1, 2),
 touches AS MATERIALIZED (SELECT l.row_id AS touch_id, l.match_id, l.player_id, l.segment_idx, l.t, w.map_id, w.wool_id, wx, wz, CASE WHEN l.player_id % 2 = 0 THEN 'red' ELSE 'blue' END AS team, CASE WHEN l.player_id % 2 = 0 THEN -30 ELSE 30 END AS sx, 0 AS sz FROM lived l JOIN w ON w.map_id = l.match_id % 5 AND w.wool_id = l.wool_id WHERE l.event_type = 6 AND l.segment_idx IS NOT NULL),
 met AS (SELECT touch_id, s.x, s.z, sqrt((s.x - wx) * (s.x - wx) + (s.z - wz) * (s.z - wz)) > 20 AS outside, row_number() OVER (PARTITION BY touch_id ORDER BY s.t, s.row_id) AS idx, count(*) OVER (PARTITION BY touch_id) AS n FROM touches o JOIN samples s USING (match_id, player_id, segment_idx) WHERE s.t <= o.t),
 paths AS MATERIALIZED (SELECT touch_id, idx, x, z FROM (SELECT *, max(CASE WHEN outside THEN idx END) OVER (PARTITION BY touch_id) AS crossed FROM met) c WHERE n >= 4 AND crossed < n AND idx >= crossed - 40)"""


def ways(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Touches with their objective and spawn, and the paths to them."""
    wools = i.log.where("event_type = 7").groupBy((F.col("match_id") % 5).alias("map_id"), "wool_id").agg(F.median("x").alias("wx"), F.median("z").alias("wz"))
    even = F.col("player_id") % 2 == 0
    lived = asof_segment(i.log).where("event_type = 6 and segment_idx is not null").withColumn("map_id", F.col("match_id") % 5)
    touches = lived.join(wools, ["map_id", "wool_id"]).select(F.col("row_id").alias("touch_id"), *LIFE, "t", "map_id", "wool_id", "wx", "wz", F.when(even, "red").otherwise("blue").alias("team"), F.when(even, -30).otherwise(30).alias("sx"), F.lit(0).alias("sz"))
    touches = cut(touches)
    return touches, cut(routes.reached(touches, i.samples, 20.0))


BUNDLE = ["map_id", "wool_id", "team"]
PROFILE = f"""{REACHED}, close AS (SELECT p.*, coalesce(sqrt(pow(p.x - lag(p.x) OVER v, 2) + pow(p.z - lag(p.z) OVER v, 2)), 0) AS step FROM paths p JOIN touches o USING (touch_id) WHERE sqrt((p.x - wx) * (p.x - wx) + (p.z - wz) * (p.z - wz)) <= 80 WINDOW v AS (PARTITION BY touch_id ORDER BY idx)),
 arcs AS MATERIALIZED (SELECT *, sum(step) OVER (PARTITION BY touch_id ORDER BY idx) AS arc, max(idx) OVER (PARTITION BY touch_id) AS last_idx FROM close),
 goals AS (SELECT touch_id, k, total * k / 4 AS target FROM (SELECT touch_id, sum(step) AS total FROM close GROUP BY 1 HAVING count(*) >= 4 AND sum(step) >= 20) e, range(0, 5) t(k)),
 curves AS (SELECT o.map_id, o.wool_id, o.team, k, touch_id, last(a.x ORDER BY a.idx) AS x, last(a.z ORDER BY a.idx) AS z, any_value(wx) AS wx, any_value(wz) AS wz FROM goals g JOIN arcs a USING (touch_id) JOIN touches o USING (touch_id) WHERE a.arc < target OR a.arc = 0 GROUP BY 1, 2, 3, 4, 5),
 sized AS MATERIALIZED (SELECT *, sqrt((x - wx) * (x - wx) + (z - wz) * (z - wz)) AS far, count(*) OVER (PARTITION BY map_id, wool_id, team, k) AS n FROM curves),
 mids AS (SELECT map_id, wool_id, team, k, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS turn, avg(far) AS distance FROM sized WHERE n >= 2 GROUP BY ALL),
 laid AS (SELECT s.*, distance, round((x - mx) * cos(turn) + (z - mz) * sin(turn), 9) AS spot FROM sized s JOIN mids USING (map_id, wool_id, team, k)),
 gaps AS (SELECT *, round(spot - lag(spot) OVER v, 6) AS gap, row_number() OVER v - 1 AS below, greatest(1, floor(0.2 * n)) AS low FROM laid WINDOW v AS (PARTITION BY map_id, wool_id, team, k ORDER BY spot, touch_id)),
 profile AS MATERIALIZED (SELECT map_id, wool_id, team, k, any_value(n) AS n, any_value(distance) AS distance, max(spot) - min(spot) AS spread, first(gap ORDER BY gap DESC, below) FILTER (below >= low AND below <= n - low) AS gap, first(least(below, n - below) * 1.0 / n ORDER BY gap DESC, below) FILTER (below >= low AND below <= n - low) AS minority FROM gaps GROUP BY 1, 2, 3, 4)"""


def profile(i: Inputs) -> DataFrame:
    touches, paths = ways(i)
    return routes.split_profile(routes.bundles(paths, touches, BUNDLE, 2, 5), BUNDLE, 2)


@query("log lived samples", f"{PROFILE} SELECT map_id, wool_id, team, CAST(k AS INT) AS k, n, gap, round(minority, 6) AS minority, round(spread, 6) AS spread, round(distance, 6) AS distance FROM profile")
def g20_split_profiles(i: Inputs) -> DataFrame:
    return profile(i).withColumns({c: r6(c) for c in ("minority", "spread", "distance")})


@query("log lived samples", f"""{PROFILE} SELECT map_id, wool_id, team, max(n) AS n, max(gap) FILTER (distance <= 25) AS approach_gap, coalesce(first(gap >= 6 AND minority >= 0.2 ORDER BY gap DESC, k) FILTER (distance <= 25), false) AS two_approaches,
 max(gap) FILTER (distance > 25) AS lane_gap, coalesce(first(gap >= 6 AND minority >= 0.2 ORDER BY gap DESC, k) FILTER (distance > 25), false) AS two_lanes FROM profile GROUP BY 1, 2, 3""")  # fmt: skip
def g20_approach_bundles(i: Inputs) -> DataFrame:
    return routes.route_splits(profile(i), BUNDLE, 25, 6.0)


@query("log lived samples diamonds", f"""{REACHED}, known AS (SELECT o.*, first(p.x ORDER BY idx) AS px, first(p.z ORDER BY idx) AS pz, sqrt(pow(any_value(wx) - any_value(sx), 2) + pow(any_value(wz) - any_value(sz), 2)) AS len FROM touches o JOIN paths p USING (touch_id) GROUP BY ALL HAVING count(*) >= 3),
 axes AS (SELECT *, CASE WHEN len > 0 THEN (wx - sx) / len ELSE 0 END AS ax, CASE WHEN len > 0 THEN (wz - sz) / len ELSE 0 END AS az FROM known),
 near AS (SELECT o.*, polygon_id, d.cx, d.cz, p.x, p.z, row_number() OVER (PARTITION BY o.touch_id, polygon_id ORDER BY sqrt((p.x - d.cx) * (p.x - d.cx) + (p.z - d.cz) * (p.z - d.cz)), p.idx) AS nth, sqrt((p.x - d.cx) * (p.x - d.cx) + (p.z - d.cz) * (p.z - d.cz)) <= d.r + 10 AS close FROM axes o JOIN paths p USING (touch_id) JOIN diamonds d ON d.map_id = o.map_id AND d.kind = 'island'),
 sides AS (SELECT *, (px - sx) * ax + (pz - sz) * az AS a, (wx - sx) * ax + (wz - sz) * az AS b, (cx - sx) * ax + (cz - sz) * az AS v, (z - cz) * ax - (x - cx) * az >= 0 AS one FROM near WHERE nth = 1 AND close)
 SELECT map_id, polygon_id AS void_id, wool_id, team, count(*) AS near, least(count(*) FILTER (one), count(*) FILTER (NOT one)) AS rotated, round(least(count(*) FILTER (one), count(*) FILTER (NOT one)) * 1.0 / count(*), 6) AS share FROM sides WHERE v BETWEEN least(a, b) - 5 AND greatest(a, b) + 5 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")  # fmt: skip
def a34_void_rotation(i: Inputs) -> DataFrame:
    touches, paths = ways(i)
    voids = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("polygon_id").alias("void_id"), F.col("cx").alias("x"), F.col("cz").alias("z"), F.col("r").alias("half"))
    return routes.void_sides(paths, touches, voids, 2).withColumn("share", r6("share"))


#: Halves in SQL: spawn centres, objectives by the median of their touches, and the nearest node of each.
HALVES = """, n AS MATERIALIZED (SELECT match_id, CAST(node_id AS BIGINT) AS node, cx, cz FROM cells WHERE occupation >= 2), e AS MATERIALIZED (SELECT a.match_id, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.match_id = b.match_id AND abs(a.cx - b.cx) + abs(a.cz - b.cz) = 5),
 wools AS (SELECT match_id, wool_id, CASE WHEN wool_id < 2 THEN 'red' ELSE 'blue' END AS team, median(x) AS wool_x, median(z) AS wool_z FROM match_log WHERE event_type = 6 GROUP BY 1, 2),
 fair AS (SELECT match_id FROM (SELECT match_id, team, count(*) AS k FROM wools GROUP BY 1, 2) o GROUP BY 1 HAVING count(*) = 2 AND min(k) = 2 AND max(k) = 2 INTERSECT SELECT match_id FROM centres GROUP BY 1 HAVING count(*) = 2),
 halves AS MATERIALIZED (SELECT w.*, c.x AS spawn_x, c.z AS spawn_z FROM wools w JOIN centres c USING (match_id, team) WHERE match_id IN (FROM fair)),
 tied AS (SELECT h.*, (SELECT n.node FROM n WHERE n.match_id = h.match_id AND sqrt((cx - spawn_x) * (cx - spawn_x) + (cz - spawn_z) * (cz - spawn_z)) < 50 ORDER BY sqrt((cx - spawn_x) * (cx - spawn_x) + (cz - spawn_z) * (cz - spawn_z)), n.node LIMIT 1) AS spawn,
  (SELECT n.node FROM n WHERE n.match_id = h.match_id AND sqrt((cx - wool_x) * (cx - wool_x) + (cz - wool_z) * (cz - wool_z)) < 20 ORDER BY sqrt((cx - wool_x) * (cx - wool_x) + (cz - wool_z) * (cz - wool_z)), n.node LIMIT 1) AS wool FROM halves h),
 ends AS MATERIALIZED (SELECT t.match_id, team, count(*) AS rows, any_value(spawn) AS spawn, CASE WHEN count(DISTINCT wool) = 2 THEN first(wool ORDER BY cx, wool) FILTER (wool IS NOT NULL) END AS first, CASE WHEN count(DISTINCT wool) = 2 THEN last(wool ORDER BY cx, wool) FILTER (wool IS NOT NULL) END AS second FROM tied t LEFT JOIN n ON n.match_id = t.match_id AND n.node = t.wool GROUP BY 1, 2),
 far AS (SELECT DISTINCT match_id, spawn AS source, spawn AS node, 0 AS hops FROM ends WHERE spawn IS NOT NULL AND first IS NOT NULL UNION SELECT e.match_id, f.source, e.dst, f.hops + 1 FROM far f JOIN e ON e.match_id = f.match_id AND e.src = f.node WHERE f.hops < 60),
 d AS MATERIALIZED (SELECT match_id, source, node, min(hops) AS hops FROM far GROUP BY 1, 2, 3), prev AS MATERIALIZED (SELECT d.match_id, d.source, d.node, min(e.src) AS previous FROM d JOIN e ON e.match_id = d.match_id AND e.dst = d.node JOIN d p ON p.match_id = d.match_id AND p.source = d.source AND p.node = e.src AND p.hops = d.hops - 1 GROUP BY 1, 2, 3),
 arms AS (SELECT x.match_id, team, arm, spawn AS source, CASE arm WHEN 1 THEN first ELSE second END AS target FROM ends x, (VALUES (1), (2)) v(arm)),
 way AS (SELECT a.*, hops AS seq, d.node FROM arms a JOIN d ON d.match_id = a.match_id AND d.source = a.source AND d.node = a.target UNION SELECT w.match_id, w.team, w.arm, w.source, w.target, w.seq - 1, p.previous FROM way w JOIN prev p ON p.match_id = w.match_id AND p.source = w.source AND p.node = w.node WHERE w.seq > 0),
 degree AS (SELECT match_id, src AS node, count(*) >= 3 AS junction FROM e GROUP BY 1, 2),
 side AS (SELECT match_id, team, source, target, arm, max(seq) AS hops, count(*) FILTER (junction AND w.node <> source AND w.node <> target) AS j FROM way w LEFT JOIN degree USING (match_id, node) GROUP BY ALL),
 met AS (SELECT match_id, team, coalesce(min(seq) FILTER (a.node <> b.node), count(*)) AS common FROM way a JOIN way b USING (match_id, team, seq) WHERE a.arm = 1 AND b.arm = 2 GROUP BY 1, 2),
 pts AS (SELECT a.match_id, a.team, a.hops AS h1, b.hops AS h2, a.j AS j1, b.j AS j2, common, s.cx AS sx, s.cz AS sz, p.cx AS px, p.cz AS pz, q.cx AS qx, q.cz AS qz FROM side a JOIN side b USING (match_id, team) JOIN met USING (match_id, team) JOIN n s ON s.match_id = a.match_id AND s.node = a.source JOIN n p ON p.match_id = a.match_id AND p.node = a.target JOIN n q ON q.match_id = a.match_id AND q.node = b.target WHERE a.arm = 1 AND b.arm = 2),
 forks AS MATERIALIZED (SELECT match_id, team, h1 * 5.0 AS d_first, h2 * 5.0 AS d_second, sqrt(pow(px - sx, 2) + pow(pz - sz, 2)) AS e_first, sqrt(pow(qx - sx, 2) + pow(qz - sz, 2)) AS e_second, j1 AS j_first, j2 AS j_second,
  degrees(acos(greatest(-1, least(1, ((px - sx) * (qx - sx) + (pz - sz) * (qz - sz)) / (greatest(sqrt(pow(px - sx, 2) + pow(pz - sz, 2)), 1e-9) * greatest(sqrt(pow(qx - sx, 2) + pow(qz - sz, 2)), 1e-9)))))) AS angle,
  abs((qx - px) * (pz - sz) - (px - sx) * (qz - pz)) / greatest(sqrt(pow(qx - px, 2) + pow(qz - pz, 2)), 1e-9) AS "offset", (common - 1) * 5.0 AS d_fork, common * 1.0 / (greatest(h1, h2) + 1) AS shared, abs(h1 - h2) * 1.0 / greatest(h1, h2, 1e-9) AS asymmetry FROM pts)"""
FORK = ["d_first", "d_second", "e_first", "e_second", "angle", "offset", "d_fork", "shared", "asymmetry"]


def halves(i: Inputs) -> DataFrame:
    """Both teams' objectives of each match, two each, at the median of their touches."""
    wools = i.log.where("event_type = 6").groupBy("match_id", "wool_id").agg(F.median("x").alias("x"), F.median("z").alias("z")).withColumn("team", F.when(F.col("wool_id") < 2, "red").otherwise("blue"))
    return forks.eligible_halves(i.centres, wools, "match_id")


def forked(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends, figures and nodes of all forks over the graphs of occupied cells."""
    nodes, edges = busy_graph(i)
    degree = both_ways(edges, "match_id").groupBy("match_id", F.col("src").alias("node")).agg((F.count("*") >= 3).alias("junction"))
    nodes = cut(nodes.join(degree, ["match_id", "node"], "left").select("match_id", "node", F.col("cx").alias("x"), F.col("cz").alias("z"), F.coalesce("junction", F.lit(False)).alias("junction")))
    ends = cut(forks.fork_ends(halves(i), nodes, nodes, "match_id"))
    return ends, cut(forks.fork_metrics(ends, nodes, edges, "match_id")), nodes


@query("log lived samples cells teams centres", f"{HALVES} SELECT match_id, team, wool_id, round(spawn_x, 6) AS spawn_x, round(spawn_z, 6) AS spawn_z, wool_x, wool_z FROM halves")
def g15_eligible_halves(i: Inputs) -> DataFrame:
    return halves(i).withColumns({c: r6(c) for c in ("spawn_x", "spawn_z")})


@query("log lived samples cells teams centres", f"{HALVES} SELECT match_id, team, j_first, j_second, {', '.join(f'round("{c}", 6) AS "{c}"' for c in FORK)} FROM forks")
def g14_fork_metrics(i: Inputs) -> DataFrame:
    return forked(i)[1].withColumns({c: r6(c) for c in FORK})


@query("log lived samples cells teams centres", f"{HALVES} SELECT CASE WHEN f.match_id IS NOT NULL THEN 'analysed' WHEN x.rows <> 2 THEN 'wrong_count' WHEN x.match_id NOT IN (SELECT match_id FROM n) THEN 'no_graph' ELSE 'other' END AS outcome, count(*) AS halves, count(DISTINCT x.match_id) AS keys FROM ends x LEFT JOIN forks f USING (match_id, team) GROUP BY 1")
def a60_fork_study(i: Inputs) -> DataFrame:
    ends, metrics, nodes = forked(i)
    return forks.fork_study(ends, metrics, nodes, "match_id")


def snapped(i: Inputs) -> DataFrame:
    """Features of lives on each match's graph of occupied cells; objectives are the nodes of captures, by parity of their number."""
    nodes, edges = busy_graph(i)
    centre = lambda c: (F.col(f"c{c}") + 2.5).alias(c)
    points = nodes.select(F.col("match_id").alias("map_id"), F.col("node").alias("node_id"), centre("x"), centre("z"))
    near = spatial.nearest_nodes(i.samples.select(F.col("match_id").alias("map_id"), "x", "z"), points).select(F.col("map_id").alias("match_id"), "x", "z", "node_id")
    cell = lambda c: trajectories.grid_floor(c, 5).alias(f"c{c}")
    wools = i.log.where("event_type = 7").select("match_id", cell("x"), cell("z")).distinct().join(nodes, ["match_id", "cx", "cz"])
    side = lambda c: F.when(F.col(c) % 2 == 0, "red").otherwise("blue")
    table = life_features.objective_table(wools.select("match_id", "node", side("node").alias("team")), edges, "match_id")
    teams = i.samples.select("match_id").distinct().withColumn("team", F.explode(F.array(F.lit("red"), F.lit("blue"))))
    depths = life_features.attack_depths(table, teams, "match_id")
    rows = spatial.classify(i.mapped, i.areas).join(near, ["match_id", "x", "z"], "left").withColumn("team", side("player_id"))
    homes = teams.withColumn("island_id", F.when(F.col("team") == "red", F.col("match_id") % 5).otherwise(F.col("match_id") % 5 + 5))
    return life_features.snapped_features(rows, depths, homes, "match_id", 2)


@query("log lived samples cells diamonds placed", """, n AS MATERIALIZED (SELECT match_id, CAST(node_id AS BIGINT) AS node, cx, cz FROM cells WHERE occupation >= 2), e AS MATERIALIZED (SELECT a.match_id, a.node AS src, b.node AS dst FROM n a JOIN n b ON a.match_id = b.match_id AND abs(a.cx - b.cx) + abs(a.cz - b.cz) = 5),
 wools AS (SELECT DISTINCT n.match_id, n.node FROM n JOIN match_log l ON l.match_id = n.match_id AND l.event_type = 7 AND floor(l.x / 5.0) * 5 = n.cx AND floor(l.z / 5.0) * 5 = n.cz),
 far AS (SELECT match_id, node AS source, node, 0 AS hops FROM wools UNION SELECT e.match_id, f.source, e.dst, f.hops + 1 FROM far f JOIN e ON e.match_id = f.match_id AND e.src = f.node WHERE f.hops < 60),
 d AS MATERIALIZED (SELECT match_id, source, node, 5.0 * min(hops) AS distance FROM far GROUP BY 1, 2, 3),
 snaps AS MATERIALIZED (SELECT s.*, location_type, island_id, (SELECT n.node FROM n WHERE n.match_id = s.match_id ORDER BY sqrt((s.x - n.cx - 2.5) * (s.x - n.cx - 2.5) + (s.z - n.cz - 2.5) * (s.z - n.cz - 2.5)), n.node LIMIT 1) AS node FROM samples s JOIN placed p USING (row_id)),
 r AS (SELECT a.match_id, a.player_id, a.segment_idx, a.t, a.row_id, d.distance, d.source FROM snaps a JOIN d ON d.match_id = a.match_id AND d.node = a.node AND d.source % 2 <> a.player_id % 2 WHERE a.y > 0),
 best AS (SELECT match_id, player_id, segment_idx, min(distance) AS depth, first(t ORDER BY distance, t, row_id, source) AS t, first(source ORDER BY distance, t, row_id, source) AS target FROM r GROUP BY 1, 2, 3)
 SELECT match_id, player_id, segment_idx, count(*) FILTER (y > 0) AS samples, string_agg(CAST(node AS VARCHAR), ',' ORDER BY a.t, row_id) FILTER (y > 0) AS node_sequence, any_value(depth) AS max_attack_depth, any_value(b.t) AS first_reach, any_value(target) AS target,
  CASE last(location_type ORDER BY a.t, row_id) WHEN 'build_region' THEN 'bridge' WHEN 'island' THEN CASE WHEN last(island_id ORDER BY a.t, row_id) = match_id % 5 + 5 * (player_id % 2) THEN 'home_island' ELSE 'enemy_island' END ELSE 'void' END AS death_region
 FROM snaps a LEFT JOIN best b USING (match_id, player_id, segment_idx) GROUP BY match_id, player_id, segment_idx HAVING count(*) FILTER (y > 0) >= 2""")  # fmt: skip
def g8_snapped_features(i: Inputs) -> DataFrame:
    return snapped(i)


@query("log lived samples diamonds placed", f"{VISITS} SELECT match_id, player_id, segment_idx, visit_idx, location_type, island_id, entry_timestamp, exit_timestamp, len(string_split(node_path, ',')) AS steps, CAST(string_split(node_path, ',')[1] AS INT) AS first_node, CAST(string_split(node_path, ',')[-1] AS INT) AS last_node FROM out WHERE match_id IN (SELECT match_id FROM match_log WHERE event_type = 7)")
def p12_region_visits(i: Inputs) -> DataFrame:
    """Visits of the matches with a capture, with the ends of their paths."""
    rows = life_features.region_visits_of(visits(i)).join(i.log.where("event_type = 7").select("match_id").distinct(), "match_id", "left_semi")
    return rows.select(*LIFE, "visit_idx", "location_type", "island_id", "entry_timestamp", "exit_timestamp", F.size("nodes").alias("steps"), F.get("nodes", F.lit(0)).alias("first_node"), F.element_at("nodes", -1).alias("last_node"))


#: Figures of islands in SQL: empty parts by flooding, the outline by lattice points, and the hull by its supporting pairs.
FEATURES = f"""{WALK}{BOX}, gap AS MATERIALIZED (SELECT b.map_id, b.island_id, u.x, v.z, u.x IN (min_x, max_x) OR v.z IN (min_z, max_z) AS edge FROM box b, unnest(range(b.min_x, b.max_x + 1)) u(x), unnest(range(b.min_z, b.max_z + 1)) v(z) WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.map_id = b.map_id AND i.island_id = b.island_id AND i.x = u.x AND i.z = v.z)),
 flow AS (SELECT map_id, island_id, x, z, z * 1000 + x AS part FROM gap UNION SELECT g.map_id, g.island_id, g.x, g.z, f.part FROM flow f JOIN gap g ON g.map_id = f.map_id AND g.island_id = f.island_id AND abs(g.x - f.x) + abs(g.z - f.z) = 1),
 parted AS MATERIALIZED (SELECT map_id, island_id, x, z, edge, min(part) AS part FROM flow JOIN gap USING (map_id, island_id, x, z) GROUP BY ALL),
 parts AS MATERIALIZED (SELECT map_id, island_id, part, count(*) AS cells, min(x) AS a, max(x) AS b, min(z) AS c, max(z) AS d, bool_or(edge) AS open FROM parted GROUP BY 1, 2, 3),
 whole AS MATERIALIZED (SELECT map_id, island_id, x, z FROM islands UNION SELECT map_id, island_id, x, z FROM parted JOIN parts USING (map_id, island_id, part) WHERE NOT open),
 lattice AS MATERIALIZED (SELECT map_id, island_id, x + dx AS px, z + dz AS pz, sum(CASE WHEN dx = 0 AND dz = 0 THEN 1 WHEN dz = 0 THEN 2 WHEN dx = 0 THEN 4 ELSE 8 END) AS around, count(*) AS n FROM whole, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dz) GROUP BY 1, 2, 3, 4),
 pts AS MATERIALIZED (SELECT map_id, island_id, px, pz, CASE WHEN n IN (1, 3) THEN 1 WHEN around IN (6, 9) THEN 2 ELSE 0 END AS turns, CASE WHEN around IN (6, 9) THEN 4 ELSE 2 END AS sides FROM lattice WHERE n < 4),
 corners AS (SELECT map_id, island_id, CAST(px AS DOUBLE) AS x, CAST(pz AS DOUBLE) AS z, unnest(range(turns)) AS again FROM pts),
 mom AS (SELECT map_id, island_id, avg(x) AS mx, avg(z) AS mz, avg(x * x + z * z) AS mq, var_samp(x) AS xx, var_samp(z) AS zz, covar_samp(x, z) AS xz, covar_samp(x, x * x + z * z) AS xq, covar_samp(z, x * x + z * z) AS zq FROM corners GROUP BY 1, 2),
 fit AS (SELECT *, xx * zz - xz * xz AS det, (xq * zz - zq * xz) / (2 * (xx * zz - xz * xz)) AS ox, (zq * xx - xq * xz) / (2 * (xx * zz - xz * xz)) AS oz, 0.5 * atan2(2 * xz, xx - zz) AS axis FROM mom),
 circ AS (SELECT *, mq - 2 * ox * mx - 2 * oz * mz + ox * ox + oz * oz AS r2 FROM fit),
 res AS (SELECT map_id, island_id, any_value(axis) AS axis, sqrt(avg(pow(sqrt(pow(x - ox, 2) + pow(z - oz, 2)) - sqrt(r2), 2))) / sqrt(any_value(r2)) AS circle, stddev_pop(sqrt((zz * pow(x - mx, 2) - 2 * xz * (x - mx) * (z - mz) + xx * pow(z - mz, 2)) / det)) / avg(sqrt((zz * pow(x - mx, 2) - 2 * xz * (x - mx) * (z - mz) + xx * pow(z - mz, 2)) / det)) AS ellipse,
  (max((x - mx) * cos(axis) + (z - mz) * sin(axis)) - min((x - mx) * cos(axis) + (z - mz) * sin(axis))) * (max((z - mz) * cos(axis) - (x - mx) * sin(axis)) - min((z - mz) * cos(axis) - (x - mx) * sin(axis))) AS turned FROM corners JOIN circ USING (map_id, island_id) GROUP BY 1, 2),
 vert AS MATERIALIZED (SELECT map_id, island_id, px AS x, pz AS z FROM pts WHERE turns > 0),
 hull AS (SELECT p.map_id, p.island_id, sum(p.x * q.z - q.x * p.z) / 2.0 AS hull_area FROM vert p JOIN vert q USING (map_id, island_id) WHERE (p.x, p.z) <> (q.x, q.z) AND NOT EXISTS (SELECT 1 FROM vert r WHERE r.map_id = p.map_id AND r.island_id = p.island_id AND ((q.x - p.x) * (r.z - p.z) - (q.z - p.z) * (r.x - p.x) < 0
  OR (q.x - p.x) * (r.z - p.z) - (q.z - p.z) * (r.x - p.x) = 0 AND (r.x - p.x) * (r.x - q.x) + (r.z - p.z) * (r.z - q.z) < 0)) GROUP BY 1, 2),
 lab AS (SELECT p.*, max_x - min_x + 1 AS wide, max_z - min_z + 1 AS deep, a <= min_x + greatest(0.5, 0.02 * least(max_x - min_x + 1, max_z - min_z + 1)) AS l, b >= max_x - greatest(0.5, 0.02 * least(max_x - min_x + 1, max_z - min_z + 1)) AS r, c <= min_z + greatest(0.5, 0.02 * least(max_x - min_x + 1, max_z - min_z + 1)) AS t, d >= max_z - greatest(0.5, 0.02 * least(max_x - min_x + 1, max_z - min_z + 1)) AS m FROM parts p JOIN box USING (map_id, island_id)),
 cut AS (SELECT *, CASE WHEN l <> r AND t <> m AND cells >= 0.95 * (b - a + 1) * (d - c + 1) THEN CASE WHEN t THEN 'T' ELSE 'B' END || CASE WHEN l THEN 'L' ELSE 'R' END END AS corner FROM lab),
 cuts AS (SELECT map_id, island_id, count(corner) AS cuts, round(sum(cells) FILTER (corner IS NOT NULL) / sum(cells), 4) AS coverage, string_agg(DISTINCT corner, ',' ORDER BY corner) AS corners, CASE WHEN count(DISTINCT corner) = 4 THEN round(greatest(0, least(1 - sum(b - a + 1) FILTER (corner[1] = 'T') / any_value(wide), 1 - sum(b - a + 1) FILTER (corner[1] = 'B') / any_value(wide), 1 - sum(d - c + 1) FILTER (corner[2] = 'L') / any_value(deep), 1 - sum(d - c + 1) FILTER (corner[2] = 'R') / any_value(deep))), 4) ELSE 0 END AS min_side FROM cut GROUP BY 1, 2 HAVING count(corner) > 0),
 flushes AS (SELECT map_id, island_id, greatest(greatest(count(*) FILTER (x = min_x), count(*) FILTER (x = max_x)) * 1.0 / any_value(max_z - min_z + 1), greatest(count(*) FILTER (z = min_z), count(*) FILTER (z = max_z)) * 1.0 / any_value(max_x - min_x + 1)) AS flush FROM whole JOIN box USING (map_id, island_id) GROUP BY 1, 2),
 feats AS MATERIALIZED (SELECT b.map_id, b.island_id, b.area, max_x - min_x + 1 AS wide, max_z - min_z + 1 AS deep, (SELECT count(*) FROM whole w WHERE w.map_id = b.map_id AND w.island_id = b.island_id) AS outer_area, (SELECT count(*) FROM parts p WHERE p.map_id = b.map_id AND p.island_id = b.island_id AND NOT open) AS holes,
  (SELECT sum(sides) / 2 FROM pts p WHERE p.map_id = b.map_id AND p.island_id = b.island_id) AS perimeter, hull_area, circle, ellipse, round(degrees(axis), 2) - 90 * floor(round(degrees(axis), 2) / 90) AS tilt, turned, coalesce(cuts, 0) AS cuts, coalesce(coverage, 0) AS coverage, coalesce(corners, '') AS corners, coalesce(min_side, 0) AS min_side,
  flush,
  NOT EXISTS (SELECT 1 FROM whole w WHERE w.map_id = b.map_id AND w.island_id = b.island_id AND NOT EXISTS (SELECT 1 FROM whole o WHERE o.map_id = w.map_id AND o.island_id = w.island_id AND o.x = min_x + max_x - w.x AND o.z = min_z + max_z - w.z)) AS half_turn
  FROM box b JOIN res USING (map_id, island_id) JOIN flushes USING (map_id, island_id) JOIN hull USING (map_id, island_id) LEFT JOIN cuts USING (map_id, island_id)),
 figured AS MATERIALIZED (SELECT map_id, island_id, area, wide, deep, round(greatest(wide, deep) * 1.0 / least(wide, deep), 4) AS aspect, round(area * 1.0 / (wide * deep), 4) AS fill, round(least(1, outer_area / hull_area), 4) AS convexity, round(perimeter / (2.0 * (wide + deep)), 4) AS rugosity, holes, round(circle, 4) AS circle_residual, round(ellipse, 4) AS ellipse_residual, tilt,
  CASE WHEN tilt BETWEEN 20 AND 70 THEN round(least(1, outer_area / turned), 4) END AS turned_fill, half_turn, round(flush, 4) AS flush, cuts, coverage, corners, min_side FROM feats)"""
MEASURES = ["area", "wide", "deep", "aspect", "fill", "convexity", "rugosity", "holes", "circle_residual", "ellipse_residual", "tilt", "turned_fill", "half_turn", "flush", "cuts", "coverage", "corners", "min_side"]


@query("ground", f"{FEATURES} SELECT map_id, island_id, {', '.join(MEASURES)} FROM figured")
def l26_island_features(i: Inputs) -> DataFrame:
    return archetypes.island_features(island_cells(i)).select("map_id", "island_id", *MEASURES)


@query("ground", f"""{FEATURES}, round_ AS (SELECT *, convexity >= 0.88 AND holes = 0 AND half_turn AND CASE WHEN aspect <= 1.2 THEN circle_residual < 0.12 ELSE ellipse_residual < 0.10 AND fill >= 0.72 END AS is_round, corners IN ('BL,TR', 'BR,TL') AS opposite FROM figured)
 SELECT map_id, island_id, CASE WHEN fill = 1 OR cuts = 4 AND corners = 'BL,BR,TL,TR' AND coverage >= 0.99 AND min_side >= 0.6 OR fill >= 0.95 AND convexity >= 0.95 AND holes = 0 AND cuts = 0 THEN 'rectangle' WHEN turned_fill >= 0.92 THEN 'rectangle_staircase' WHEN fill >= 0.88 AND convexity >= 0.88 AND holes = 0 AND cuts = 0 AND rugosity >= 1.08 THEN 'rectangle_noisy'
  WHEN holes = 1 AND area >= 30 AND fill >= 0.25 AND convexity >= 0.92 AND rugosity <= 1.1 THEN 'ring' WHEN holes = 1 AND area >= 30 AND fill >= 0.25 AND convexity >= 0.85 AND rugosity <= 1.25 THEN 'ring_rugged' WHEN is_round AND rugosity >= 1.05 THEN 'circle_rugged' WHEN is_round THEN 'circle'
  WHEN cuts = 1 AND coverage >= 0.9 THEN 'L' WHEN cuts = 2 AND coverage >= 0.9 THEN CASE WHEN opposite THEN 'Z' ELSE 'T' END WHEN convexity >= 0.6 AND cuts = 1 AND coverage >= 0.7 THEN 'L_noisy' WHEN convexity >= 0.6 AND cuts = 2 AND coverage >= 0.7 THEN CASE WHEN opposite THEN 'Z_noisy' ELSE 'T_noisy' END
  WHEN flush >= 0.8 AND fill >= 0.65 AND convexity >= 0.82 AND rugosity <= 1.12 AND holes = 0 AND cuts = 0 THEN 'rectangle_chopped' WHEN holes >= 2 AND rugosity >= 1.2 THEN 'maze_rugged' WHEN holes >= 2 THEN 'maze' WHEN rugosity >= 1.2 THEN 'amoeba_rugged' WHEN aspect >= 2.5 THEN 'linear' ELSE 'amoeba' END AS island_type,
  wide = deep AND cuts = 0 AND (fill = 1 OR fill >= 0.95 AND convexity >= 0.95 AND holes = 0) AS is_square FROM round_""")  # fmt: skip
def l30_archetypes(i: Inputs) -> DataFrame:
    return archetypes.archetypes(archetypes.island_features(island_cells(i))).select("map_id", "island_id", "island_type", "is_square")


SKELETON = """, g AS MATERIALIZED (SELECT g.map_id, g.map_id AS island_id, x, z, (SELECT count(*) FROM ground o WHERE o.map_id = g.map_id AND abs(o.x - g.x) <= 1 AND abs(o.z - g.z) <= 1) - 1 AS degree FROM ground g),
 sk AS (SELECT map_id, island_id, count(*) FILTER (degree >= 3) AS junctions, count(*) FILTER (degree = 1) AS endpoints, count(*) FILTER (degree = 2) AS edges FROM g GROUP BY 1, 2)"""


@query("ground", f"{SKELETON} SELECT *, CASE WHEN junctions = 0 AND endpoints = 0 THEN 'none' WHEN junctions = 0 AND endpoints = 2 THEN 'line' WHEN edges > junctions + endpoints - 1 THEN 'mesh' ELSE 'tree' END AS topology FROM sk")
def g23_skeleton_classes(i: Inputs) -> DataFrame:
    """Cells of a map taken as one skeleton, those with two neighbours as its edges."""
    nodes = graph.degrees(i.cells).withColumn("island_id", F.col("map_id"))
    return archetypes.skeleton_features(nodes, nodes.where("degree = 2")).drop("min_arm_angle")


@query("ground", f"{SKELETON} SELECT map_id, CAST(sum(n) AS BIGINT) AS nodes, any_value(edges) AS edges, any_value(endpoints) AS endpoints, any_value(junctions) AS junctions FROM sk JOIN (SELECT map_id, count(*) AS n FROM g GROUP BY 1) USING (map_id) GROUP BY 1")
def g24_skeleton_totals(i: Inputs) -> DataFrame:
    nodes = graph.degrees(i.cells).withColumn("island_id", F.col("map_id"))
    return archetypes.skeleton_totals(archetypes.skeleton_features(nodes, nodes.where("degree = 2")), nodes)


#: Rooms in SQL: wools by map, regions as squares, spawners and chests by their colour's number, and the three passes one after the other.
ROOMS = """, regions AS MATERIALIZED (SELECT map_id, kind || '-' || polygon_id AS region_id, cx - r AS min_x, cx + r AS max_x, cz - r AS min_z, cz + r AS max_z FROM diamonds),
 wools AS MATERIALIZED (SELECT map_id, wool_id * 2 + again AS idx, wool_id, CAST(wool_id AS INT) AS damage, x, z FROM (SELECT match_id % 5 AS map_id, wool_id, median(x) AS x, median(z) AS z FROM match_log WHERE event_type = 7 GROUP BY 1, 2) w, (VALUES (0), (1)) v(again)),
 spawners AS MATERIALIZED (SELECT map_id, polygon_id AS idx, kind || '-' || polygon_id AS region_id, CAST(polygon_id % 9 AS INT) AS damage FROM diamonds),
 chest AS MATERIALIZED (SELECT map_id, x - 24 AS x, y, z - 24 AS z, CAST(y % 4 AS INT) AS damage, (y * 48 + z) * 48 + x AS idx FROM blocks WHERE block_id = 3 AND y % 4 < 2),
 inside AS (SELECT c.map_id, c.damage, c.idx, first(region_id ORDER BY (max_x - min_x) * (max_z - min_z), region_id) AS region_id FROM chest c JOIN regions g ON g.map_id = c.map_id AND c.x BETWEEN min_x AND max_x AND c.z BETWEEN min_z AND max_z GROUP BY 1, 2, 3),
 one AS (SELECT map_id, damage, first(region_id ORDER BY idx) AS region_id FROM spawners GROUP BY 1, 2), two AS (SELECT map_id, damage, first(region_id ORDER BY idx) AS region_id FROM inside GROUP BY 1, 2),
 three AS (SELECT w.map_id, w.idx, first(region_id ORDER BY (max_x - min_x) * (max_z - min_z), region_id) AS region_id FROM wools w JOIN regions g ON g.map_id = w.map_id AND w.x BETWEEN min_x AND max_x AND w.z BETWEEN min_z AND max_z GROUP BY 1, 2),
 lead AS (SELECT map_id, round(x, 1) AS px, round(z, 1) AS pz, min(idx) AS lead FROM wools GROUP BY 1, 2, 3),
 solved AS (SELECT l.*, coalesce(one.region_id, two.region_id, three.region_id) AS region_id, CASE WHEN one.region_id IS NOT NULL THEN 'spawner' WHEN two.region_id IS NOT NULL THEN 'chest' WHEN three.region_id IS NOT NULL THEN 'location' END AS how FROM lead l JOIN wools w ON w.map_id = l.map_id AND w.idx = l.lead LEFT JOIN one ON one.map_id = w.map_id AND one.damage = w.damage LEFT JOIN two ON two.map_id = w.map_id AND two.damage = w.damage LEFT JOIN three ON three.map_id = w.map_id AND three.idx = w.idx),
 found AS MATERIALIZED (SELECT w.*, region_id, CASE WHEN w.idx <> lead AND how IS NOT NULL THEN 'shared' ELSE how END AS found_by FROM wools w JOIN solved s ON s.map_id = w.map_id AND s.px = round(w.x, 1) AND s.pz = round(w.z, 1)),
 block AS (SELECT DISTINCT b.map_id, b.x - 24 AS x, b.y, b.z - 24 AS z, CAST(y % 4 AS VARCHAR) AS colour FROM blocks b JOIN regions g ON g.map_id = b.map_id AND g.region_id LIKE 'build%' AND g.map_id <> 3 AND b.x - 24 BETWEEN min_x AND max_x AND b.z - 24 BETWEEN min_z AND max_z WHERE block_id = 5),
 mobs AS (SELECT map_id, x - 24 AS x, z - 24 AS z FROM blocks WHERE block_id = 11 AND (map_id = 2 OR y % 2 = 0)),
 things AS (SELECT map_id, x, z, 'c' AS kind, CAST(damage AS VARCHAR) AS colour FROM chest UNION ALL SELECT map_id, x, z, 'b', colour FROM block UNION ALL SELECT map_id, x, z, 'm', NULL FROM mobs),
 held AS MATERIALIZED (SELECT g.map_id, g.region_id, count(*) FILTER (kind = 'c') AS chest_wool, count(*) FILTER (kind = 'b') AS block_wool, count(*) FILTER (kind = 'm') AS mob_spawners, coalesce(string_agg(DISTINCT colour, ',' ORDER BY colour), '') AS colours FROM regions g LEFT JOIN things t ON t.map_id = g.map_id AND t.x BETWEEN min_x AND max_x AND t.z BETWEEN min_z AND max_z GROUP BY 1, 2)"""


def room_inputs(i: Inputs) -> dict[str, DataFrame]:
    """Regions, wools (each twice, for two teams), spawners and chests of five maps."""
    name = F.concat("kind", F.lit("-"), "polygon_id")
    d = i.adapted("diamonds")
    regions = d.select("map_id", name.alias("region_id"), *((F.col(f"c{c}") + s * F.col("r")).alias(f"{e}_{c}") for c in ("x", "z") for e, s in (("min", -1), ("max", 1))))
    places = i.log.where("event_type = 7").groupBy((F.col("match_id") % 5).alias("map_id"), "wool_id").agg(F.median("x").alias("x"), F.median("z").alias("z"))
    wools = places.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).select("map_id", (F.col("wool_id") * 2 + F.col("again")).alias("idx"), "wool_id", F.col("wool_id").cast("int").alias("damage"), "x", "z")
    spawners = d.select("map_id", F.col("polygon_id").alias("idx"), name.alias("region_id"), (F.col("polygon_id") % 9).cast("int").alias("damage"))
    at = lambda kind: i.blocks.where(F.col("block_id") == kind).select("map_id", (F.col("x") - 24).alias("x"), "y", (F.col("z") - 24).alias("z"), (F.col("y") % 4).cast("int").alias("damage"), ((F.col("y") * 48 + F.col("z")) * 48 + F.col("x")).alias("idx"))
    return {"regions": regions, "wools": wools, "spawners": spawners, "chests": at(3).where("damage < 2"), "blocks": at(5), "mobs": at(11)}


def rooms_of(n: dict[str, DataFrame]) -> DataFrame:
    return objective_rooms.room_regions(n["wools"], n["regions"], n["spawners"], n["chests"])


def room_contents(n: dict[str, DataFrame]) -> DataFrame:
    """What the rooms hold; map 3 renews no blocks, and map 2 has no tile entities."""
    coloured = lambda rows: rows.withColumn("colour", F.col("damage").cast("string"))
    renewables = n["regions"].where("region_id like 'build%' and map_id <> 3")
    entities = n["mobs"].where("map_id <> 2").select("map_id", "x", "y", "z", (F.col("y") % 2 == 0).alias("spawns_wool"))
    return objective_rooms.wool_in_rooms(n["regions"], coloured(n["chests"]), coloured(n["blocks"]), objective_rooms.wool_spawners(n["mobs"].select("map_id", "x", "y", "z"), entities), renewables)


@query("log blocks diamonds", f"{ROOMS} SELECT map_id, idx, wool_id, region_id, found_by FROM found")
def l12_room_regions(i: Inputs) -> DataFrame:
    return rooms_of(room_inputs(i)).select("map_id", "idx", "wool_id", "region_id", "found_by")


@query("log blocks diamonds", f"{ROOMS} SELECT f.map_id, f.wool_id, any_value(min_x) AS min_x, any_value(max_x) AS max_x, any_value(min_z) AS min_z, any_value(max_z) AS max_z FROM found f JOIN regions g USING (map_id, region_id) GROUP BY 1, 2")
def p13_room_rectangles(i: Inputs) -> DataFrame:
    n = room_inputs(i)
    return objective_rooms.room_rectangles(rooms_of(n), n["regions"])


@query("log blocks diamonds", f"{ROOMS} SELECT * FROM held")
def l14_wool_in_rooms(i: Inputs) -> DataFrame:
    return room_contents(room_inputs(i)).withColumn("colours", F.array_join("colours", ","))


@query("log blocks diamonds", f"{ROOMS} SELECT map_id, count(*) AS spawners FROM mobs GROUP BY 1")
def l16_wool_spawners(i: Inputs) -> DataFrame:
    mobs = room_inputs(i)["mobs"].select("map_id", "x", "y", "z")
    entities = mobs.where("map_id <> 2").withColumn("spawns_wool", F.col("y") % 2 == 0)
    return objective_rooms.wool_spawners(mobs, entities).groupBy("map_id").agg(F.count("*").alias("spawners"))


@query("log blocks diamonds", f"""{ROOMS}, s AS (SELECT f.map_id, f.idx, min(s.idx) AS spawner_idx FROM found f JOIN spawners s ON s.map_id = f.map_id AND (s.region_id = f.region_id OR s.damage = f.damage) GROUP BY 1, 2)
 SELECT f.map_id, f.idx, f.wool_id, f.region_id, spawner_idx, CASE WHEN spawner_idx IS NOT NULL THEN 'pgm_spawner' WHEN mob_spawners > 0 THEN 'mob_spawner' WHEN block_wool > 0 THEN 'renewable' WHEN chest_wool > 0 THEN 'chest' ELSE 'unknown' END AS respawn FROM found f LEFT JOIN s USING (map_id, idx) LEFT JOIN held h ON h.map_id = f.map_id AND h.region_id = f.region_id""")  # fmt: skip
def l17_wool_respawns(i: Inputs) -> DataFrame:
    """How each wool comes back: by a spawner for its players or colour, or by what its room holds."""
    n = room_inputs(i)
    return objective_rooms.wool_respawns(rooms_of(n), n["spawners"], room_contents(n)).select("map_id", "idx", "wool_id", "region_id", "spawner_idx", "respawn")


NAMED = """, teams_of AS (SELECT map_id, t.ord, t.team, t.colour, CASE WHEN map_id % 2 = 0 THEN t.name END AS name FROM maps, (VALUES (0, 'red-team', 'dark red', 'Reds'), (1, 'blue-team', 'blue', 'Blues')) t(ord, team, colour, name)),
 named AS (SELECT map_id, CASE map_id % 7 WHEN 0 THEN 'Red-Team-Spawn' WHEN 1 THEN 'blue-spawn-point' WHEN 2 THEN 'reds-spawn' WHEN 3 THEN 'wool-spawn-blue' WHEN 4 THEN 'obs-spawn' WHEN 5 THEN 'spawn' ELSE 'blue-team-spawns' END AS region_id, CASE WHEN map_id % 7 = 6 AND map_id % 3 = 0 THEN 'union' ELSE 'cuboid' END AS kind, total_blocks * 1.0 AS min_x, total_blocks + 4.0 AS max_x, 0.0 AS min_z, 2.0 AS max_z FROM maps),
 told AS (SELECT n.map_id, n.region_id, (SELECT t.team FROM teams_of t WHERE t.map_id = n.map_id AND (contains(lower(n.region_id), t.team) OR contains(lower(n.region_id), t.colour) OR contains(lower(n.region_id), lower(t.name))) ORDER BY NOT contains(lower(n.region_id), t.team), t.ord LIMIT 1) AS team FROM named n)"""


def named_regions(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Regions of all maps, named in turn as maps name them, and two teams each."""
    names = F.array(*(F.lit(x) for x in ("Red-Team-Spawn", "blue-spawn-point", "reds-spawn", "wool-spawn-blue", "obs-spawn", "spawn", "blue-team-spawns")))
    kind = F.when((F.col("map_id") % 7 == 6) & (F.col("map_id") % 3 == 0), "union").otherwise("cuboid")
    regions = i.maps.select("map_id", F.get(names, F.col("map_id") % 7).alias("region_id"), kind.alias("kind"), F.col("total_blocks").cast("double").alias("min_x"), (F.col("total_blocks") + 4.0).alias("max_x"), F.lit(0.0).alias("min_z"), F.lit(2.0).alias("max_z"))
    team = lambda n, *x: F.struct(F.lit(n).alias("ord"), *(F.lit(v).alias(c) for c, v in zip(("team", "colour", "name"), x, strict=True)))
    teams = i.maps.select("map_id", F.explode(F.array(team(0, "red-team", "dark red", "Reds"), team(1, "blue-team", "blue", "Blues"))).alias("t")).select("map_id", "t.*")
    return regions, teams.withColumn("name", F.when(F.col("map_id") % 2 == 0, F.col("name")))


@query("maps", f"{NAMED} SELECT * FROM told")
def f30_teams_of_regions(i: Inputs) -> DataFrame:
    return points_of_interest.teams_of_regions(*named_regions(i))


SPAWNS = f"""{NAMED}, points AS (SELECT map_id, 'red-team-spawn (inline)' AS region_id, total_blocks + 1.0 AS x, 5.0 AS z, 'red-team' AS team FROM maps WHERE stub UNION ALL SELECT map_id, region_id, (min_x + max_x) / 2, 1.0, team FROM named JOIN told USING (map_id, region_id) JOIN maps USING (map_id) WHERE NOT stub AND lower(region_id) LIKE '%spawn%' AND NOT regexp_matches(lower(region_id), 'wool|not-|obs') AND kind <> 'union')"""


def spawn_points(i: Inputs) -> DataFrame:
    """Stub maps carry a spawn of their own, the others' regions are read by their names."""
    regions, teams = named_regions(i)
    at = lambda c, n: (F.col("total_blocks") + n).cast("double").alias(c)
    own = i.maps.where("stub").select("map_id", F.lit("red-team").alias("team"), at("min_x", 0), at("max_x", 2), F.lit(4.0).alias("min_z"), F.lit(6.0).alias("max_z"))
    return points_of_interest.spawn_points(own, regions, teams)


@query("maps", f"{SPAWNS} SELECT map_id, region_id, x, z, team, CASE team WHEN 'red-team' THEN 'dark red' WHEN 'blue-team' THEN 'blue' END AS team_colour FROM points")
def l45_spawn_points(i: Inputs) -> DataFrame:
    return spawn_points(i).select("map_id", "region_id", "x", "z", "team", "team_colour")


@query("maps", f"{SPAWNS} SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY team NULLS LAST, region_id) - 1 AS INT) AS spawn_idx, region_id, x, z, team FROM points")
def l46_spawn_table(i: Inputs) -> DataFrame:
    """The spawn table is written twice, the second time for stub maps alone: no row doubles."""
    path, rows = scratch_path(i.spark, "spawns"), points_of_interest.spawn_table(spawn_points(i), i.maps).withColumn("bucket", F.col("map_id") % 8)
    for some in (rows, rows.join(i.maps.where("map_id % 8 = 3").select("map_id"), "map_id", "left_semi")):
        warehouse.replace_keys(some, path, "bucket")
    return warehouse.stored(i.spark, path, rows.schema).select("map_id", "spawn_idx", "region_id", "x", "z", "team")


@query("log", """, w AS (SELECT wool_id, match_id, count(*) FILTER (x >= 0) AS top, count(*) AS n FROM match_log WHERE event_type IN (6, 7) GROUP BY 1, 2), lf AS MATERIALIZED (SELECT k, coalesce(sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (ORDER BY k), 0) AS f FROM range(0, 10001) r(k))
 SELECT wool_id, match_id, top, n, round(sum(exp(a.f - b.f - c.f - n * ln(2.0))) * 2, 6) AS tail FROM w, range(0, 10001) r(k) JOIN lf b ON b.k = r.k JOIN lf a ON a.k = n JOIN lf c ON c.k = n - r.k WHERE r.k BETWEEN top AND n GROUP BY 1, 2, 3, 4""")  # fmt: skip
def f26_binomial_tails(i: Inputs) -> DataFrame:
    """How odd the share of acts on one side of the map is, for each objective of a match."""
    rows = i.log.where("event_type in (6, 7)").groupBy("wool_id", "match_id").agg(F.count_if(F.col("x") >= 0).alias("top"), F.count("*").alias("n"))
    return rows.withColumn("tail", F.round(scalars.binomial_tails(F.col("top").cast("int"), F.col("n").cast("int")), 6))


#: Territories in SQL: islands by the side of the map's middle that their centre lies on.
TEAMED = f"""{WALK}{BOX}, mid AS (SELECT map_id, min(x) + max(x) AS sx, min(z) + max(z) AS sz FROM islands GROUP BY 1), sided AS MATERIALIZED (SELECT b.*, CASE WHEN 2 * center_x - 1 < sx THEN 'red' ELSE 'blue' END AS team, sx, sz FROM box b JOIN mid USING (map_id)),
 homes AS (SELECT map_id, team, first(center_x - 0.5 ORDER BY area DESC, island_id) AS x, first(center_z - 0.5 ORDER BY area DESC, island_id) AS z, any_value(sx) AS sx, any_value(sz) AS sz FROM sided GROUP BY 1, 2),
 axes AS MATERIALIZED (SELECT *, CASE map_id % 3 WHEN 0 THEN 'mirror_z' WHEN 1 THEN CASE WHEN abs(2 * z - sz) > abs(2 * x - sx) THEN 'mirror_x' ELSE 'mirror_z' END ELSE 'mirror_x' END AS axis FROM homes)"""


def sided(i: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Islands with a team by side, their cells, and twice the middles of the maps."""
    cells = island_cells(i)
    middles = cells.groupBy("map_id").agg((F.min("x") + F.max("x")).alias("sx"), (F.min("z") + F.max("z")).alias("sz"))
    boxes = shapes.bounds(cells, shapes.ISLAND).join(cells.groupBy(*shapes.ISLAND).agg(F.avg("x").alias("x"), F.avg("z").alias("z")), shapes.ISLAND)
    return boxes.join(middles, "map_id").withColumn("team", F.when(2 * F.col("x") < F.col("sx"), "red").otherwise("blue")), cells, middles


@query("ground", f"""{TEAMED}, halves AS (SELECT s.map_id, s.team, axis, abs(CASE axis WHEN 'mirror_x' THEN 2 * i.x - a.sx ELSE 2 * i.z - a.sz END) AS off, CASE axis WHEN 'mirror_x' THEN i.z ELSE i.x END AS along, count(*) AS n FROM islands i JOIN sided s USING (map_id, island_id) JOIN axes a ON a.map_id = s.map_id AND a.team = s.team WHERE CASE axis WHEN 'mirror_x' THEN 2 * i.x <> a.sx ELSE 2 * i.z <> a.sz END GROUP BY ALL)
 SELECT map_id, team, axis, round(avg(n - 1), 6) AS overlap, avg(n - 1) >= 0.6 AS symmetric FROM halves GROUP BY 1, 2, 3""")  # fmt: skip
def l34_team_symmetry(i: Inputs) -> DataFrame:
    """Maps are taken as mirrored or turned in turn; a team's home is its largest island."""
    islands, cells, middles = sided(i)
    homes = islands.groupBy("map_id", "team").agg(F.min_by(F.struct("x", "z"), F.struct(-F.col("area"), "island_id")).alias("h")).select("map_id", "team", "h.*")
    kinds = islands.select("map_id").distinct().withColumn("symmetry", F.when(F.col("map_id") % 3 == 0, "mirror_x").when(F.col("map_id") % 3 == 1, "point").otherwise("mirror_z"))
    axes = team_shapes.inner_axes(homes, kinds, middles)
    owned = cells.join(islands.select(*shapes.ISLAND, "team"), shapes.ISLAND)
    return team_shapes.team_symmetry(owned, axes, middles).withColumn("overlap", r6("overlap"))


@query("ground", f"{TEAMED}, own AS (SELECT map_id, team, area, count(*) AS n FROM sided GROUP BY 1, 2, 3) SELECT map_id, team, any_value(g) AS groups, count(*) FILTER (n = 1) AS covered, any_value(g) = count(*) FILTER (n = 1) AS symmetric FROM own JOIN (SELECT map_id, count(DISTINCT area) AS g FROM sided GROUP BY 1) USING (map_id) GROUP BY 1, 2")
def l34_canonical_coverage(i: Inputs) -> DataFrame:
    """Islands of one area are taken as one shape."""
    return team_shapes.canonical_coverage(sided(i)[0].select(*shapes.ISLAND, "team", F.col("area").alias("shape")))


@query("ground diamonds", f"""{WALK}{BOX}, spot AS (SELECT map_id, abs(cx) AS x, abs(cz) AS z FROM diamonds WHERE polygon_id < 5), near AS (SELECT s.map_id, i.island_id, row_number() OVER (PARTITION BY s.map_id ORDER BY i.x <> s.x OR i.z <> s.z, i.x, i.z) AS k FROM spot s JOIN islands i ON i.map_id = s.map_id AND abs(i.x - s.x) <= 2 AND abs(i.z - s.z) <= 2),
 r AS (SELECT b.map_id, b.island_id, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.k = 1 AND n.map_id = b.map_id AND n.island_id = b.island_id) THEN 'observer' WHEN b.island_id = 3 AND b.map_id < 3 THEN 'listed' WHEN b.map_id > 0 AND NOT (center_x BETWEEN 4 AND 44 AND center_z BETWEEN 4 AND 44) THEN 'outside' END AS reason FROM box b) SELECT * FROM r WHERE reason IS NOT NULL""")  # fmt: skip
def l35_unplayable_islands(i: Inputs) -> DataFrame:
    cells = island_cells(i)
    figures = shapes.island_figures(cells)
    spots = i.adapted("diamonds").where("polygon_id < 5").select("map_id", F.abs("cx").cast("double").alias("x"), F.abs("cz").cast("double").alias("z"))
    boxes = figures.select("map_id").distinct().where("map_id > 0").select("map_id", F.lit(4).alias("min_x"), F.lit(44).alias("max_x"), F.lit(4).alias("min_z"), F.lit(44).alias("max_z"))
    return team_shapes.unplayable(figures, team_shapes.observer_islands(spots, cells), figures.where("island_id = 3 and map_id < 3"), boxes)


def _round(k: int) -> str:
    """One round of moving centres in SQL."""
    return f""" a{k} AS MATERIALIZED (SELECT p.map_id, p.x, p.z, p.n, (SELECT c.node_id FROM c{k} c WHERE c.map_id = p.map_id ORDER BY sqrt((p.x - c.x) * (p.x - c.x) + (p.z - c.z) * (p.z - c.z)), c.node_id LIMIT 1) AS node_id FROM places p),
 c{k + 1} AS MATERIALIZED (SELECT c.map_id, c.node_id, coalesce(sum(a.x * n) * 1.0 / sum(n), any_value(c.x)) AS x, coalesce(sum(a.z * n) * 1.0 / sum(n), any_value(c.z)) AS z FROM c{k} c LEFT JOIN a{k} a ON a.map_id = c.map_id AND a.node_id = c.node_id GROUP BY 1, 2)"""


CLUSTERS = f""", s AS MATERIALIZED (SELECT match_id % 5 AS map_id, samples.* FROM samples), places AS MATERIALIZED (SELECT map_id, x, z, count(*) AS n FROM s GROUP BY 1, 2, 3),
 sized AS (SELECT map_id, count(*) AS m, least(greatest(floor(sqrt(sum(n) / 4)), 20), 400, count(*)) AS k FROM places GROUP BY 1), spots AS (SELECT p.*, m, k, row_number() OVER (PARTITION BY map_id ORDER BY x, z) - 1 AS spot FROM places p JOIN sized USING (map_id)),
 c0 AS MATERIALIZED (SELECT map_id, CAST(floor(spot * k / m) AS BIGINT) AS node_id, CAST(x AS DOUBLE) AS x, CAST(z AS DOUBLE) AS z FROM spots WHERE spot = 0 OR floor(spot * k / m) > floor((spot - 1) * k / m)),{_round(0)},{_round(1)},
 last AS MATERIALIZED (SELECT s.*, (SELECT c.node_id FROM c2 c WHERE c.map_id = s.map_id ORDER BY sqrt((s.x - c.x) * (s.x - c.x) + (s.z - c.z) * (s.z - c.z)), c.node_id LIMIT 1) AS node_id FROM s),
 cn AS MATERIALIZED (SELECT c.map_id, c.node_id, c.x, c.z, count(*) AS occupation FROM c2 c JOIN last l USING (map_id, node_id) WHERE EXISTS (SELECT 1 FROM s v WHERE v.map_id = c.map_id AND v.cx = floor(c.x / 5) * 5 AND v.cz = floor(c.z / 5) * 5) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
 hop AS (SELECT map_id, node_id, lag(node_id) OVER w AS before, t - lag(t) OVER w AS gap FROM last WINDOW w AS (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id)),
 ce AS MATERIALIZED (SELECT h.map_id, least(before, node_id) AS src, greatest(before, node_id) AS dst, count(*) AS transitions FROM hop h WHERE before <> node_id AND gap <= 30 AND (h.map_id, node_id) IN (SELECT (map_id, node_id) FROM cn) AND (h.map_id, before) IN (SELECT (map_id, node_id) FROM cn) GROUP BY 1, 2, 3)"""


def clustered(i: Inputs) -> tuple[DataFrame, DataFrame]:
    places = cut(i.mapped.groupBy("map_id", "x", "z").agg(F.count("*").alias("n")))
    centres = cluster_graph.lloyd(places, cluster_graph.first_centres(places), 2)
    return cluster_graph.cluster_graph(i.mapped, centres, i.mapped, LIFE, 2, 1)


@query("log lived samples", f"{CLUSTERS} SELECT map_id, node_id, round(x, 6) AS x, round(z, 6) AS z, occupation FROM cn")
def g10_cluster_nodes(i: Inputs) -> DataFrame:
    return clustered(i)[0].withColumns({c: r6(c) for c in ("x", "z")})


@query("log lived samples", f"{CLUSTERS} SELECT * FROM ce")
def g10_cluster_edges(i: Inputs) -> DataFrame:
    return clustered(i)[1]


@query("log lived samples", f"{CLUSTERS}{TRAFFIC.replace(', s AS (SELECT match_id % 5 AS map_id, samples.* FROM samples),', ',')} SELECT 'clusters' AS strategy, map_id, count(*) AS nodes, any_value(k) AS edges, any_value(n) AS transitions FROM cn LEFT JOIN (SELECT map_id, count(*) AS k, CAST(sum(transitions) AS BIGINT) AS n FROM ce GROUP BY 1) e USING (map_id) GROUP BY 2 UNION ALL SELECT 'grid_5', map_id, count(*), any_value(e.k), any_value(e.n) FROM nodes LEFT JOIN (SELECT map_id, count(*) AS k, CAST(sum(transitions) AS BIGINT) AS n FROM edges GROUP BY 1) e USING (map_id) GROUP BY 2")
def g9_compared_graphs(i: Inputs) -> DataFrame:
    return cluster_graph.compared({"clusters": clustered(i), "grid_5": traffic(i)})


#: Figures of lives in SQL; the enemy's objective lies at the far end of the map.
PLAYED = """, f AS MATERIALIZED (SELECT match_id * 1000000 + player_id * 1000 + segment_idx AS k, count(*) AS positions, sqrt(pow(last(x ORDER BY t, row_id) - first(x ORDER BY t, row_id), 2) + pow(last(z ORDER BY t, row_id) - first(z ORDER BY t, row_id), 2)) AS span, count(DISTINCT (cx, cz)) AS nodes, sum(coalesce(sqrt(pow(x - before_x, 2) + pow(z - before_z, 2)), 0)) AS way,
  avg(CASE WHEN y >= 22 THEN 1.0 ELSE 0 END) AS high_share, avg(CASE WHEN k4 = 1 THEN 1.0 ELSE 0 END) AS bow_share, avg(CASE WHEN k4 = 2 THEN 1.0 ELSE 0 END) AS builder_share, avg(CASE WHEN k4 = 3 THEN 1.0 ELSE 0 END) AS trap_share, min(sqrt(pow(x - CASE WHEN player_id % 2 = 0 THEN 30 ELSE -30 END, 2) + z * z)) AS enemy_min,
  avg(sqrt(pow(x + CASE WHEN player_id % 2 = 0 THEN 30 ELSE -30 END, 2) + z * z)) AS home_mean, min(CASE WHEN sqrt(pow(x + CASE WHEN player_id % 2 = 0 THEN 30 ELSE -30 END, 2) + z * z) < 30 THEN y END) AS min_y_near FROM samples GROUP BY match_id, player_id, segment_idx),
 acts AS (SELECT match_id * 1000000 + player_id * 1000 + segment_idx AS k, count(*) FILTER (event_type = 3) AS kills, count(*) FILTER (event_type IN (6, 7)) > 0 AS touched FROM lived WHERE segment_idx IS NOT NULL GROUP BY match_id, player_id, segment_idx),
 lives AS MATERIALIZED (SELECT f.*, coalesce(kills, 0) AS kills, coalesce(touched, false) AS touched, way / greatest(span, 1) * ln(1 + nodes) AS wound FROM f LEFT JOIN acts USING (k)),"""
PICKS = [("deep_attacker", "enemy_min IS NOT NULL", "-enemy_min", []), ("defender", "NOT touched AND positions >= 3", "-home_mean", [0]), ("roamer", "span >= 10 AND nodes >= 3", "wound", []), ("traversal", "true", "span", []), ("high_killer", "positions >= 2", "kills", [0, 1, 2, 3]), ("skybridge", "positions >= 3 AND span >= 10", "high_share", [0, 1, 2, 3, 4]), ("bow_archer", "positions >= 3 AND bow_share > 0.1", "bow_share", [0, 1, 2, 3, 4, 5]), ("builder", "positions >= 3 AND builder_share > 0.1", "builder_share", [0, 1, 2, 3, 4, 5, 6])]


def picked(picks: list[tuple[str, str, str, list[int]]]) -> str:
    """One pick after the other in SQL, each without what those it gives way to took."""
    parts = [f" p{n} AS MATERIALIZED (SELECT k, CAST({metric} AS DOUBLE) AS metric FROM lives WHERE {pool}{''.join(f' AND k NOT IN (SELECT k FROM p{x})' for x in after)} ORDER BY {metric} DESC, k LIMIT 1)" for n, (_, pool, metric, after) in enumerate(picks)]
    return ",".join(parts) + " " + " UNION ALL ".join(f"SELECT '{name}' AS category, k, round(metric, 6) AS metric FROM p{n}" for n, (name, *_) in enumerate(picks))


def played(i: Inputs) -> DataFrame:
    """Figures of all lives."""
    key = (F.col("match_id").cast("long") * 1000000 + F.col("player_id").cast("long") * 1000 + F.col("segment_idx")).alias("k")
    side = F.when(F.col("player_id") % 2 == 0, 30).otherwise(-30)
    share = lambda condition: F.avg(condition.cast("int"))
    end = lambda f: f(F.struct("x", "z"), F.struct("t", "row_id"))
    home = F.hypot(F.col("x") + side, F.col("z"))
    rows = i.samples.groupBy(*LIFE).agg(
        F.count("*").alias("positions"), end(F.min_by).alias("a"), end(F.max_by).alias("b"), F.count_distinct("cx", "cz").alias("nodes"), F.sum(F.coalesce(F.hypot(F.col("x") - F.col("before_x"), F.col("z") - F.col("before_z")), F.lit(0.0))).alias("way"), share(F.col("y") >= 22).alias("high_share"), share(F.col("k4") == 1).alias("bow_share"), share(F.col("k4") == 2).alias("builder_share"), share(F.col("k4") == 3).alias("trap_share"),
        F.min(F.hypot(F.col("x") - side, F.col("z"))).alias("enemy_min"), F.avg(home).alias("home_mean"), F.min(F.when(home < 30, F.col("y"))).alias("min_y_near"),
    )
    acts = asof_segment(i.log).where("segment_idx is not null").groupBy(*LIFE).agg(F.count_if(F.col("event_type") == 3).alias("kills"), (F.count_if(F.col("event_type").isin(6, 7)) > 0).alias("touched"))
    rows = rows.withColumn("span", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.z") - F.col("a.z"))).join(acts, LIFE, "left")
    return rows.select(key, "positions", "span", "nodes", (F.col("way") / F.greatest("span", F.lit(1.0))).alias("tortuosity"), F.coalesce("kills", F.lit(0)).alias("kills"), F.coalesce("touched", F.lit(False)).alias("touched"), "high_share", "bow_share", "builder_share", "trap_share", "enemy_min", "home_mean", F.col("home_mean").alias("wool_distance"), "min_y_near")


@query("log lived samples", f"{PLAYED}{picked(PICKS)}")
def t4_representatives(i: Inputs) -> DataFrame:
    return studies.representatives(played(i), "k", 3, 2, 10, 3, 10).withColumn("metric", r6("metric"))


@query("log lived samples", PLAYED + picked([("early_digger", "positions >= 3 AND home_mean < 60 AND min_y_near IS NOT NULL", "-min_y_near", []), ("early_builder", "positions >= 3 AND home_mean < 60 AND trap_share > 0", "trap_share", [0])]))
def t5_defence_representatives(i: Inputs) -> DataFrame:
    return studies.defence_representatives(played(i), "k", 3).withColumn("metric", r6("metric"))


@query("log", """, s AS (SELECT match_id, player_id, y, sqrt(x * x + z * z) AS d, CASE k4 WHEN 0 THEN CASE WHEN y < 8 THEN 'dig' ELSE 'guard' END WHEN 1 THEN 'wall' WHEN 2 THEN CASE WHEN y % 2 = 0 THEN 'trap' ELSE 'gate' END ELSE 'other' END AS activity FROM match_log WHERE event_type = 5)
 SELECT match_id, count(*) AS positions, count(DISTINCT player_id) AS players, min(y) FILTER (d < 30 AND y < 5) AS lowest_near, max(y) FILTER (activity IN ('wall', 'trap', 'gate') AND d < 15) AS wall_height, CAST(max(floor(d)) FILTER (activity IN ('dig', 'wall', 'trap', 'gate')) AS INT) AS perimeter, count(*) FILTER (activity = 'dig') AS digs, count(*) FILTER (activity IN ('trap', 'gate')) AS traps, count(*) FILTER (activity = 'guard') AS guards, count(*) FILTER (activity = 'wall') AS walls, count(*) FILTER (activity = 'other') AS others FROM s GROUP BY 1""")  # fmt: skip
def a45_defence_overview(i: Inputs) -> DataFrame:
    k, y = F.col("k4"), F.col("y")
    activity = F.when(k == 0, F.when(y < 8, "dig").otherwise("guard")).when(k == 1, "wall").when(k == 2, F.when(y % 2 == 0, "trap").otherwise("gate")).otherwise("other")
    rows = i.log.where("event_type = 5").withColumn("wool_distance", F.hypot("x", "z")).withColumn("activity", activity)
    return studies.defence_overview(rows, ["match_id"])


@query("ground", f"{WALK}{BOX}, m AS (SELECT map_id, (min(min_x) + max(max_x) + 1) / 2.0 AS x, (min(min_z) + max(max_z) + 1) / 2.0 AS z FROM box GROUP BY 1), g AS (SELECT *, x % 1 = 0.5 AS hx, z % 1 = 0.5 AS hz, CASE WHEN x % 1 = 0.5 OR z % 1 = 0.5 THEN 5 ELSE 4 END AS grid_size FROM m) SELECT map_id, grid_size, CAST(CASE WHEN hx AND grid_size = 5 THEN trunc(x - 2.5) ELSE round_even(x, 0) END AS INT) AS origin_x, CAST(CASE WHEN hz AND grid_size = 5 THEN trunc(z - 2.5) ELSE round_even(z, 0) END AS INT) AS origin_z FROM g")
def f8_grid_frames(i: Inputs) -> DataFrame:
    middle = lambda c: ((F.min(f"min_{c}") + F.max(f"max_{c}") + 1) / 2).alias(c)
    return spatial.grid_frame(shapes.bounds(island_cells(i), shapes.ISLAND).groupBy("map_id").agg(middle("x"), middle("z")), 4)


@query("ground", f"{WALK}{BOX} SELECT map_id, island_id, CASE WHEN area > 8 THEN 2 ELSE 4 + CAST(map_id % 2 AS INT) END AS grid_size FROM box")
def g13_island_grids(i: Inputs) -> DataFrame:
    """Islands of more than eight cells are taken as winding."""
    islands = shapes.bounds(island_cells(i), shapes.ISLAND).select(*shapes.ISLAND, F.when(F.col("area") > 8, "maze").otherwise("L").alias("archetype"))
    grids = islands.select("map_id").distinct().withColumn("grid_size", (4 + F.col("map_id") % 2).cast("int"))
    return spatial.island_grids(islands, grids).select("map_id", "island_id", "grid_size")
