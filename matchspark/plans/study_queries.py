"""Registered queries of the studies, selections and set operations; ``QUERIES`` as in ``plans/map_queries.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions import scalars
from matchspark.operators import blocks, chests, graph, intervals, matchstats, objectives, sessions, shapes, spatial, studies, trajectories
from matchspark.plans.inputs import Inputs
from matchspark.plans.map_queries import BOX, SHAPE_KEYS, VISITS, WALK, island_cells, visits
from matchspark.plans.match_queries import depth_series, placed, r6

QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], list[str], str]] = {}


def query(inputs: str, sql: str):
    """Register a function under its name with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = (f, inputs.split(), sql)
        return f

    return keep


LIFE = sessions.LIFE
SPANNED = ", d AS (SELECT s.match_id, s.player_id, s.k AS segment_idx, s.t AS a, coalesce(e.t, m.t) AS b FROM (SELECT match_id, player_id, t, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS k FROM match_log WHERE event_type = 2) s LEFT JOIN (SELECT match_id, player_id, t, row_number() OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) - 1 AS k FROM match_log WHERE event_type = 4) e USING (match_id, player_id, k) JOIN (SELECT match_id, player_id, max(t) AS t FROM match_log GROUP BY 1, 2) m USING (match_id, player_id))"


@query("log matches", f"{SPANNED} SELECT m.match_id, m.player_count AS participants, round(coalesce((SELECT sum(b - a) FROM d WHERE d.match_id = m.match_id) / 60.0, 0), 6) AS life_minutes FROM matches m WHERE match_id IN (SELECT match_id FROM match_log)")
def a3_match_totals(i: Inputs) -> DataFrame:
    rows = studies.map_totals(i.matches.join(i.log.select("match_id").distinct(), "match_id", "left_semi"), sessions.life_segments(i.log), ["match_id"])
    return rows.select(F.col("match_id").cast("long").alias("match_id"), "participants", r6("life_minutes"))


GAPS = ", gaps AS (SELECT match_id, CASE WHEN median(CASE WHEN gap > 0 THEN gap END) >= 5 THEN 5 ELSE 2 END AS log_interval FROM (SELECT match_id, t - lag(t) OVER (PARTITION BY match_id, player_id ORDER BY t, row_id) AS gap FROM match_log WHERE event_type = 5) g GROUP BY 1)"


@query("log diamonds placed", "SELECT match_id, count(*) AS n FROM placed WHERE event_type = 5 AND y > 0 AND location_type <> 'void' AND match_id % 3 <> 0 GROUP BY 1")
def p2_trajectory_positions(i: Inputs) -> DataFrame:
    third = F.col("match_id") % 3
    matches = i.log.select("match_id").distinct().select("match_id", (third != 0).alias("processed"), F.when(third == 1, 2).cast("int").alias("log_interval"))
    return studies.trajectory_positions(placed(i, i.log.where("event_type = 5")), matches, 2).groupBy("match_id").agg(F.count("*").alias("n"))


@query("log", "SELECT match_id, row_id FROM match_log WHERE event_type = 5 AND x >= -10 AND x <= 5 AND z >= 0 AND z <= 12")
def p3_within_box(i: Inputs) -> DataFrame:
    return studies.within_box(i.log.where("event_type = 5"), -10, 5, 0, 12).select("match_id", "row_id")


@query("log teams", "SELECT team, count(*) AS n FROM teams GROUP BY 1")
def p4_plain_teams(i: Inputs) -> DataFrame:
    named = i.teams.withColumn("team", F.when(F.col("match_id") % 2 == 0, F.concat("team", F.lit("-team"))).otherwise(F.col("team")))
    return named.groupBy(scalars.plain_team(F.col("team")).alias("team")).agg(F.count("*").alias("n"))


@query("matches maps", "SELECT match_id FROM matches WHERE processed AND map_id IN (SELECT map_id FROM maps WHERE size_tier = 'BUILDING')")
def p5_matches_of_maps(i: Inputs) -> DataFrame:
    return i.matches.where("processed").join(i.maps.where("size_tier = 'BUILDING'"), "map_id", "left_semi").select("match_id")


@query("log", "SELECT DISTINCT match_id, player_id FROM match_log")
def p7_players(i: Inputs) -> DataFrame:
    return i.log.select("match_id", "player_id").distinct()


@query("matches maps", "SELECT match_id FROM matches JOIN maps USING (map_id) WHERE team_count = 2 AND processed AND match_duration > 1200")
def p8_eligible_matches(i: Inputs) -> DataFrame:
    return i.matches.join(i.maps.where("team_count = 2"), "map_id", "left_semi").where("processed and match_duration > 1200").select("match_id")


@query("log teams", ", o AS (SELECT DISTINCT e.match_id, e.wool_id, s.team FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t <= s.end_timestamp) WHERE e.event_type = 7) SELECT match_id, wool_id, team FROM (SELECT *, count(*) OVER (PARTITION BY match_id, wool_id) AS n FROM o) c WHERE n = 2")
def p9_contested_objectives(i: Inputs) -> DataFrame:
    return studies.exactly(objectives.capturing_teams(i.log, i.teams), ["match_id", "wool_id"], 2)


@query("matches", "SELECT match_id, match_duration FROM (SELECT *, row_number() OVER (ORDER BY match_duration DESC, match_id) AS k FROM matches WHERE processed AND match_duration > 600) r WHERE k <= 8")
def p10_longest_matches(i: Inputs) -> DataFrame:
    return studies.sweep(i.matches, 600, 8).select("match_id", "match_duration")


@query("chests", "SELECT zone, map_id, n FROM (SELECT zone, map_id, count(*) AS n, row_number() OVER (PARTITION BY zone ORDER BY count(*) DESC, map_id) AS k FROM chests GROUP BY 1, 2) r WHERE k <= 8")
def t3_top_maps(i: Inputs) -> DataFrame:
    from pyspark.sql import Window

    rows = i.chests.groupBy("zone", "map_id").agg(F.count("*").alias("n"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("n"), "map_id"))).where("k <= 8").drop("k")


@query("ground diamonds", f"{WALK}{BOX} SELECT b.map_id, d.polygon_id AS point_id, b.island_id, round(sqrt((b.center_x - d.cx) * (b.center_x - d.cx) + (b.center_z - d.cz) * (b.center_z - d.cz)), 6) AS distance FROM box b JOIN diamonds d ON d.map_id = b.map_id AND d.kind = 'island' AND (b.center_x - d.cx) * (b.center_x - d.cx) + (b.center_z - d.cz) * (b.center_z - d.cz) <= 400")
def p14_islands_near_points(i: Inputs) -> DataFrame:
    points = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("polygon_id").alias("point_id"), F.col("cx").alias("x"), F.col("cz").alias("z"))
    return studies.near_points(shapes.island_figures(island_cells(i)), points, 20.0).withColumn("distance", r6("distance"))


@query("log", "SELECT match_id, row_id FROM match_log WHERE event_type = 5 AND (sqrt(x * x + z * z) <= 20 OR CASE WHEN y > 5 THEN y * 2 ELSE sqrt(x * x + z * z) END <= 15)")
def p15_defence_zone(i: Inputs) -> DataFrame:
    rows = i.log.where("event_type = 5").withColumn("straight", F.hypot("x", "z")).withColumn("walked", F.when(F.col("y") > 5, F.col("y") * 2.0).otherwise(F.lit(float("inf"))))
    return studies.defence_zone(rows, 20.0, 15.0).select("match_id", "row_id")


@query("log lived", "SELECT match_id, player_id, segment_idx, count(*) AS n, string_agg(t || ':' || event_type, ',' ORDER BY t, row_id) AS trace FROM lived WHERE segment_idx >= 0 AND event_type IN (3, 5, 6, 7) GROUP BY 1, 2, 3")
def j22_traces(i: Inputs) -> DataFrame:
    return studies.traces(sessions.asof_segment(i.log))


@query("log", "SELECT p.match_id, p.row_id, (SELECT min(k4) FROM match_log o WHERE o.match_id = p.match_id AND o.player_id = p.player_id AND o.t = p.t AND o.event_type = 3) AS item FROM match_log p WHERE p.event_type = 5")
def j20_held_items(i: Inputs) -> DataFrame:
    items = i.log.where("event_type = 3").select("match_id", "player_id", "t", F.col("k4").alias("item"))
    return studies.enriched(i.log.where("event_type = 5"), items).select("match_id", "row_id", "item")


@query("log blocks", ", s AS (SELECT map_id, x, z, max(y) AS surface_y FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3) SELECT e.match_id, e.row_id, surface_y + 1 - e.y AS depth FROM match_log e JOIN s ON s.map_id = e.match_id % 5 AND s.x = e.x AND s.z = e.z WHERE e.event_type = 5 AND e.y < surface_y + 1")
def j23_below_surface(i: Inputs) -> DataFrame:
    surface = blocks.top_surface(i.blocks).withColumnRenamed("y", "surface_y")
    return studies.below_surface(i.log.where("event_type = 5").withColumn("map_id", F.col("match_id") % 5), surface).select("match_id", "row_id", "depth")


@query("ground log", f"{SHAPE_KEYS}, corner AS (SELECT map_id, island_id, min(x) AS x0, min(z) AS z0 FROM islands GROUP BY 1, 2) SELECT canonical_key, e.x - x0 AS dx, e.z - z0 AS dz, count(*) AS n FROM match_log e JOIN islands k ON k.map_id = e.match_id % 5 AND k.x = e.x AND k.z = e.z JOIN corner c ON c.map_id = k.map_id AND c.island_id = k.island_id JOIN keys s ON s.map_id = k.map_id AND s.island_id = k.island_id WHERE e.event_type = 5 GROUP BY 1, 2, 3")
def j24_shape_overlay(i: Inputs) -> DataFrame:
    cells = island_cells(i)
    return studies.shape_overlay(i.log.where("event_type = 5").withColumn("map_id", F.col("match_id") % 5), cells, shapes.canonical_keys(cells))


@query("log diamonds", """, f AS (SELECT match_id % 5 AS map_id, match_id, x, z, min(y) AS low FROM match_log WHERE event_type = 5 GROUP BY 1, 2, 3, 4), c AS (SELECT map_id, x, z, max(low) - min(low) AS r FROM f GROUP BY 1, 2, 3),
 b AS (SELECT map_id, CAST(floor((SELECT min(sqrt((c.x - d.cx) * (c.x - d.cx) + (c.z - d.cz) * (c.z - d.cz))) FROM diamonds d WHERE d.kind = 'island' AND d.map_id = c.map_id) / 5) * 5 AS INT) AS band, r FROM c)
 SELECT band, count(*) AS cells, round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0 END), 6) AS static_share, count(DISTINCT map_id) AS maps FROM b GROUP BY 1 HAVING count(*) >= 20""")  # fmt: skip
def a21_pooled_bands(i: Inputs) -> DataFrame:
    cells = trajectories.lowest_floors(i.log.where("event_type = 5").withColumn("map_id", F.col("match_id") % 5), ["map_id"])
    rooms = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("cx").alias("x"), F.col("cz").alias("z"))
    return studies.pooled_bands(trajectories.dug_profile(cells, rooms), 20).withColumn("static_share", r6("static_share"))


@query("log blocks diamonds", """, s AS (SELECT map_id, x, z, max(y) AS depth FROM blocks WHERE block_id NOT IN (0, 36) GROUP BY 1, 2, 3), f AS (SELECT match_id % 5 AS map_id, x, z, count(*) AS dug FROM match_log WHERE event_type = 5 GROUP BY 1, 2, 3)
 SELECT d.map_id, d.polygon_id AS room_id, count(*) AS cells, round(avg(least(1.0, coalesce(dug, 0) * 1.0 / greatest(depth, 1))), 6) AS complete FROM diamonds d JOIN s ON s.map_id = d.map_id AND (s.x - d.cx) * (s.x - d.cx) + (s.z - d.cz) * (s.z - d.cz) <= 625 LEFT JOIN f ON f.map_id = s.map_id AND f.x = s.x AND f.z = s.z WHERE d.kind = 'island' GROUP BY 1, 2 HAVING count(*) >= 40""")  # fmt: skip
def a26_completeness(i: Inputs) -> DataFrame:
    diggable = blocks.top_surface(i.blocks).select("map_id", "x", "z", F.col("y").alias("depth"))
    floors = i.log.where("event_type = 5").groupBy((F.col("match_id") % 5).alias("map_id"), "x", "z").agg(F.count("*").alias("dug"))
    rooms = i.adapted("diamonds").where("kind = 'island'").select("map_id", F.col("polygon_id").alias("room_id"), F.col("cx").alias("x"), F.col("cz").alias("z"))
    return studies.completeness(diggable, floors, rooms).withColumn("complete", r6("complete"))


@query("log teams", """, p AS (SELECT e.match_id, s.team, e.x, e.z, CASE s.team WHEN 'red' THEN -30 ELSE 30 END AS ax, CASE s.team WHEN 'red' THEN 60 ELSE -60 END AS ux FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.event_type = 5)
 SELECT match_id, team, count(*) AS samples, round(median((0 * (x - ax) - ux * (z - 0)) / abs(ux)), 6) AS median_offset FROM p WHERE (x - ax) * 1.0 / ux BETWEEN 0.55 AND 0.95 GROUP BY 1, 2 HAVING count(*) >= 5""")  # fmt: skip
def a27_flank_frame(i: Inputs) -> DataFrame:
    samples = intervals.with_team(i.log.where("event_type = 5"), i.teams, how="inner")
    red = F.col("team") == "red"
    axes = i.teams.select("match_id", "team").distinct().select("match_id", "team", F.when(red, -30).otherwise(30).alias("x"), F.lit(0).alias("z"), F.when(red, 30).otherwise(-30).alias("ex"), F.lit(0).alias("ez"))
    return studies.flank_frame(samples, axes, least=5).withColumn("median_offset", r6("median_offset"))


@query("ground", f"{WALK}{BOX}, r AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY area DESC, island_id) AS rank, count(*) OVER (PARTITION BY map_id) AS n FROM box) SELECT map_id, island_id, area, rank FROM r WHERE n <= 5 OR rank IN (1, 2, 2 + (n - 2) // 3, 2 + (2 * (n - 2)) // 3, n)")
def t9_diverse_islands(i: Inputs) -> DataFrame:
    rows = shapes.bounds(island_cells(i), shapes.ISLAND).select(*shapes.ISLAND, "area")
    return studies.diverse(rows, ["map_id"], "area", "island_id")


@query("ground", f"{WALK}{BOX}, e AS (SELECT min(area) AS lo, max(area) AS hi FROM box) SELECT map_id, CASE WHEN hi > lo THEN CAST(least(24, floor((area - lo) * 1.0 / (hi - lo) * 25)) AS INT) ELSE 0 END AS bin, count(*) AS n FROM box, e GROUP BY 1, 2")
def a61_area_histogram(i: Inputs) -> DataFrame:
    return studies.histogram(shapes.bounds(island_cells(i), shapes.ISLAND), "area", ["map_id"])


@query("ground diamonds", f"{WALK}{BOX}, d AS (SELECT b.map_id, b.island_id, row_number() OVER (PARTITION BY b.map_id ORDER BY round((center_x - 24) * (center_x - 24) + (center_z - 24) * (center_z - 24), 6), island_id) AS k FROM box b) SELECT map_id, island_id FROM d WHERE k = 1")
def t10_nearest_island(i: Inputs) -> DataFrame:
    d2 = F.round((F.col("center_x") - 24) ** 2 + (F.col("center_z") - 24) ** 2, 6)
    return shapes.island_figures(island_cells(i)).groupBy("map_id").agg(F.min_by("island_id", F.struct(d2, "island_id")).alias("island_id"))


@query("log teams", ", c AS (SELECT DISTINCT e.match_id, s.team FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t <= s.end_timestamp) WHERE e.event_type = 7 AND e.wool_id = 0) SELECT DISTINCT match_id, team FROM teams EXCEPT SELECT match_id, team FROM c")
def u3_defenders(i: Inputs) -> DataFrame:
    """Teams of a match that did not capture objective 0."""
    caught = objectives.capturing_teams(i.log.where("wool_id = 0"), i.teams).select("match_id", "team")
    return i.teams.select("match_id", "team").distinct().join(caught, ["match_id", "team"], "left_anti")


ARC = """, p AS (SELECT match_id, player_id, segment_idx, row_number() OVER w AS idx, x, z, coalesce(sqrt((x - before_x) * (x - before_x) + (z - before_z) * (z - before_z)), 0) AS step FROM samples WINDOW w AS (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id)),
 a AS (SELECT *, sum(step) OVER (PARTITION BY match_id, player_id, segment_idx ORDER BY idx) AS arc FROM p), e AS (SELECT match_id, player_id, segment_idx, max(arc) AS total FROM a GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND max(arc) >= 20), g AS (SELECT *, unnest(range(0, 5)) AS k FROM e)"""


@query("log lived samples", f"{ARC} SELECT g.match_id, g.player_id, g.segment_idx, CAST(g.k AS INT) AS k, last(a.x ORDER BY a.idx) AS x, last(a.z ORDER BY a.idx) AS z FROM g JOIN a USING (match_id, player_id, segment_idx) WHERE a.arc = 0 OR a.arc < greatest(0.0, total - 80) + (total - greatest(0.0, total - 80)) * g.k / 4 GROUP BY 1, 2, 3, 4")
def w16_resampled_paths(i: Inputs) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy(*LIFE).orderBy("t", "row_id")
    return studies.resampled(i.samples.withColumn("idx", F.row_number().over(order)).select(*LIFE, "idx", "x", "z"), LIFE, 5)


@query("log", ", m AS (SELECT match_id, avg(x) AS mx, avg(z) AS mz, 0.5 * atan2(2 * covar_pop(x, z), var_pop(x) - var_pop(z)) AS turn, count(*) AS n FROM match_log WHERE event_type = 6 GROUP BY 1), a AS (SELECT e.match_id, n, row_id, round((x - mx) * cos(turn) + (z - mz) * sin(turn), 9) AS spot FROM match_log e JOIN m USING (match_id) WHERE event_type = 6), g AS (SELECT *, round(spot - lag(spot) OVER w, 6) AS gap, row_number() OVER w - 1 AS below FROM a WINDOW w AS (PARTITION BY match_id ORDER BY spot, row_id)) SELECT match_id, first(gap ORDER BY gap DESC, below) AS gap, first(below ORDER BY gap DESC, below) AS below FROM g WHERE gap IS NOT NULL AND below >= 0.2 * n AND below <= 0.8 * n GROUP BY 1")
def w17_largest_gap(i: Inputs) -> DataFrame:
    return studies.largest_gap(i.log.where("event_type = 6").withColumn("idx", F.col("row_id")), ["match_id"])


@query("log", """, w AS (SELECT row_id AS touch_id, match_id, player_id, t AS tt, x AS wx, z AS wz FROM match_log WHERE event_type = 6), p AS (SELECT w.*, e.row_id, e.t, e.x, e.z, row_number() OVER (PARTITION BY touch_id ORDER BY e.t DESC, e.row_id DESC) AS age FROM w JOIN match_log e ON e.match_id = w.match_id AND e.player_id = w.player_id AND e.event_type = 5 AND e.t <= w.tt)
 SELECT touch_id, row_id, age FROM p WHERE age <= 10 AND age <= (SELECT min(age) FROM p q WHERE q.touch_id = p.touch_id AND q.age <= 10 AND (q.x - q.wx) * (q.x - q.wx) + (q.z - q.wz) * (q.z - q.wz) > 900)""")  # fmt: skip
def g19_approaches(i: Inputs) -> DataFrame:
    touches = i.log.where("event_type = 6").withColumnRenamed("row_id", "touch_id")
    return studies.approaches(touches, i.log.where("event_type = 5"), 30.0, 10).select("touch_id", "row_id", "age")


@query("log diamonds", """, h AS (SELECT p.row_id, count(d.polygon_id) AS n, count(DISTINCT (d.cx, d.cz, d.r)) AS boxes FROM match_log p LEFT JOIN diamonds d ON d.map_id = p.match_id % 5 AND abs(p.x - d.cx) <= d.r AND abs(p.z - d.cz) <= d.r WHERE p.event_type = 7 GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN boxes = 1 THEN 'one_bbox' ELSE 'multiple' END AS kind, count(*) AS points FROM h GROUP BY 1""")
def a50_region_audit(i: Inputs) -> DataFrame:
    d = i.adapted("diamonds")
    regions = d.select("map_id", F.col("polygon_id").alias("region_id"), *((F.col(c) + s * F.col("r")).alias(n) for c, s, n in (("cx", -1, "min_x"), ("cx", 1, "max_x"), ("cz", -1, "min_z"), ("cz", 1, "max_z"))))
    points = i.log.where("event_type = 7").select((F.col("match_id") % 5).alias("map_id"), F.col("row_id").alias("point_id"), "x", "z")
    return studies.region_audit(points, regions)


@query("maps", ", walk AS (SELECT map_id AS root, map_id AS spot FROM maps WHERE map_id <= 3 UNION SELECT w.root, m.map_id FROM walk w JOIN maps m ON m.map_id // 3 = w.spot AND m.map_id >= 3) SELECT root, spot AS leaf FROM walk WHERE spot NOT IN (SELECT map_id // 3 FROM maps WHERE map_id >= 3)")
def l18_leaf_regions(i: Inputs) -> DataFrame:
    """A tree over the maps: the parent of a map is a third of its number."""
    tree = i.maps.where("map_id >= 3").select(F.floor(F.col("map_id") / 3).cast("int").alias("region_id"), F.col("map_id").alias("child_id"))
    return studies.leaf_regions(tree, i.maps.where("map_id <= 3").select(F.col("map_id").alias("region_id")))


@query("log lived samples diamonds placed", f"""{VISITS}, c AS (SELECT match_id, player_id, segment_idx, least(bridge_node_1, bridge_node_2) AS a, greatest(bridge_node_1, bridge_node_2) AS b, count(*) AS n FROM out WHERE bridge_node_1 IS NOT NULL AND bridge_node_2 IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
 p AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY match_id, player_id, segment_idx) AS p FROM c) SELECT match_id, player_id, segment_idx, count(*) AS corridors, round(abs(sum(p * log2(p))), 6) AS entropy, round(max(p), 6) AS dominant_share FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def x2_corridor_use(i: Inputs) -> DataFrame:
    return studies.corridor_use(visits(i)).withColumns({c: r6(c) for c in ("entropy", "dominant_share")})


@query("log lived", f"""{SPANNED}, n AS (SELECT match_id, player_id, segment_idx, count(*) FILTER (WHERE event_type = 3) AS k, count(*) FILTER (WHERE event_type IN (6, 7)) AS w, count(*) FILTER (WHERE event_type = 5) AS p FROM lived WHERE segment_idx >= 0 GROUP BY 1, 2, 3)
 SELECT match_id, player_id, segment_idx, CASE WHEN b > a THEN round(coalesce(k, 0) * 60.0 / (b - a), 6) END AS kill_rate, CASE WHEN coalesce(k, 0) + coalesce(w, 0) > 0 THEN round(w * 1.0 / (k + w), 6) END AS objective_share, CASE WHEN b > a THEN round(coalesce(p, 0) * 60.0 / (b - a), 6) END AS mobility_rate FROM d LEFT JOIN n USING (match_id, player_id, segment_idx)""")  # fmt: skip
def x3_ratios(i: Inputs) -> DataFrame:
    return studies.ratios(sessions.life_segments(i.log)).withColumns({c: r6(c) for c in ("kill_rate", "objective_share", "mobility_rate")})


@query("log", "SELECT match_id, wool_id, CAST(t // 60 AS INT) AS bucket, count(DISTINCT player_id) AS pushers, count(DISTINCT player_id) >= 2 AS coordinated FROM match_log WHERE event_type = 6 GROUP BY 1, 2, 3")
def x5_pushes(i: Inputs) -> DataFrame:
    return studies.pushes(i.log.where("event_type = 6"))


@query("log lived samples", """, p AS (SELECT match_id, t // 60 AS minute, round(avg(greatest(0.0, least(1.0, 1.0 - sqrt(x * x + z * z) / 45.0))), 6) AS m FROM samples GROUP BY 1, 2), k AS (SELECT match_id, t // 60 AS minute, count(*) AS n FROM match_log WHERE event_type = 4 GROUP BY 1, 2) SELECT match_id, count(*) AS buckets, round(corr(m, coalesce(n, 0)), 6) AS score FROM p LEFT JOIN k USING (match_id, minute) GROUP BY 1 HAVING count(*) >= 3""")
def x6_push_pull(i: Inputs) -> DataFrame:
    return studies.push_pull(depth_series(i), ["match_id"]).withColumn("score", r6("score"))


@query("log lived samples", "SELECT s.match_id, s.t, CAST((SELECT median(o.y) FROM samples o WHERE o.match_id = s.match_id AND o.t BETWEEN s.t - 60 AND s.t) AS DOUBLE) AS median_y FROM (SELECT DISTINCT match_id, t FROM samples) s")
def x7_rolling_median(i: Inputs) -> DataFrame:
    return studies.rolling_median(i.samples, ["match_id"], 60)


@query("log lived samples", ", n AS (SELECT *, lead(y) OVER w AS y1, row_number() OVER w AS k FROM samples WINDOW w AS (PARTITION BY match_id, player_id, segment_idx ORDER BY t, row_id)) SELECT match_id, player_id, segment_idx, min(t) AS activated FROM n WHERE y >= 22 AND y1 >= 22 GROUP BY 1, 2, 3")
def x8_activation(i: Inputs) -> DataFrame:
    return studies.activation(i.samples, ticks=2)


@query("log", ", y AS (SELECT DISTINCT match_id, CAST(floor(x / 2.0) * 2 AS INT) AS cx, CAST(floor(z / 2.0) * 2 AS INT) AS cz, y FROM match_log WHERE event_type = 5), n AS (SELECT *, sum(new) OVER (PARTITION BY match_id, cx, cz ORDER BY y) AS floor FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY match_id, cx, cz ORDER BY y) > 3 THEN 1 ELSE 0 END AS new FROM y) r) SELECT match_id, cx, cz, CAST(floor AS INT) AS floor, min(y) AS low, max(y) AS high FROM n GROUP BY 1, 2, 3, 4")
def x9_floors(i: Inputs) -> DataFrame:
    return studies.floors_of_cells(i.log.where("event_type = 5"), ["match_id"])


@query("log lived samples", "SELECT match_id, player_id, segment_idx, count(*) FILTER (WHERE y >= 40) AS high_samples, count(*) AS samples FROM samples GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE y >= 40) >= 2")
def q12_sky_lives(i: Inputs) -> DataFrame:
    return studies.sky_lives(i.samples)


@query("log teams", ", f AS (SELECT e.match_id, s.team, e.wool_id, row_number() OVER (PARTITION BY e.match_id, s.team ORDER BY e.t, e.row_id) AS k FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.event_type = 7) SELECT CASE team WHEN 'red' THEN 'blue' ELSE 'red' END AS defender, wool_id, count(*) AS matches FROM f WHERE k = 1 GROUP BY 1, 2")
def q11_first_wool_by_defender(i: Inputs) -> DataFrame:
    rows = objectives.first_captures(i.log, i.teams)
    return rows.groupBy(F.when(F.col("team") == "red", "blue").otherwise("red").alias("defender"), "wool_id").agg(F.count("*").alias("matches"))


@query("log teams", """, w AS (SELECT m.*, sum(new) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) - 1 AS k FROM (SELECT m.*, CASE WHEN t - lag(t) OVER (PARTITION BY match_id, wool_id ORDER BY t, row_id) <= 12 THEN 0 ELSE 1 END AS new FROM match_log m WHERE event_type = 6) m),
 v AS (SELECT match_id, wool_id, k, count(DISTINCT player_id) AS c, min(t) AS s, max(t) AS l, last(player_id ORDER BY t, row_id) AS o FROM w GROUP BY 1, 2, 3),
 j AS (SELECT v.*, (SELECT min(t) FROM match_log e WHERE e.match_id = v.match_id AND e.wool_id = v.wool_id AND e.event_type = 7 AND e.t >= v.s) AS cap, (SELECT min((e.t, e.row_id, e.y)) FROM match_log e WHERE e.match_id = v.match_id AND e.player_id = v.o AND e.event_type = 4 AND e.t >= v.s) AS fall FROM v)
 SELECT CASE WHEN c > 1 THEN 'several' ELSE 'one' END AS carriers, CASE WHEN cap IS NOT NULL THEN 'captured' WHEN fall IS NULL THEN 'incomplete' WHEN fall[3] < 10 THEN 'dropped_void' ELSE 'dropped_land' END AS outcome, count(*) AS waves, round(avg(coalesce(cap, fall[1], l) - s), 6) AS mean_duration FROM j GROUP BY 1, 2""")  # fmt: skip
def q13_multi_touch(i: Inputs) -> DataFrame:
    return studies.multi_touch(sessions.carry_chains(i.log, i.teams, limit=12, void_below=10)).withColumn("mean_duration", r6("mean_duration"))


@query("matches maps", "SELECT coalesce(size_tier, 'ALL') AS tier, count(*) AS n, count(*) FILTER (WHERE processed) AS done FROM matches JOIN maps USING (map_id) GROUP BY ROLLUP (size_tier)")
def q15_status_grid(i: Inputs) -> DataFrame:
    rows = i.matches.join(i.maps, "map_id").rollup("size_tier").agg(F.count("*").alias("n"), F.count_if("processed").alias("done"))
    return rows.select(F.coalesce("size_tier", F.lit("ALL")).alias("tier"), "n", "done")


@query("blocks", "SELECT map_id, resource_type AS kind, count(*) AS n FROM (SELECT map_id, CASE block_id WHEN 35 THEN 'wool' WHEN 41 THEN 'gold_block' WHEN 42 THEN 'iron_block' WHEN 52 THEN 'mob_spawner' WHEN 57 THEN 'diamond_block' END AS resource_type FROM blocks) r WHERE resource_type IS NOT NULL GROUP BY 1, 2")
def a49_resource_summary(i: Inputs) -> DataFrame:
    return blocks.resource_blocks(i.blocks).groupBy("map_id", F.col("resource_type").alias("kind")).agg(F.count("*").alias("n"))


@query("log", "SELECT match_id, CAST(max(n) AS BIGINT) AS best FROM (SELECT match_id, player_id, count(*) AS n FROM match_log WHERE event_type = 3 GROUP BY 1, 2) k GROUP BY 1")
def a59_best_kills(i: Inputs) -> DataFrame:
    return i.log.where("event_type = 3").groupBy("match_id", "player_id").agg(F.count("*").alias("n")).groupBy("match_id").agg(F.max("n").alias("best"))


@query("maps", "SELECT size_tier, sum(CASE WHEN team_count = 2 THEN 1 ELSE 0 END)::BIGINT AS two, sum(CASE WHEN team_count = 3 THEN 1 ELSE 0 END)::BIGINT AS three, sum(CASE WHEN team_count = 4 THEN 1 ELSE 0 END)::BIGINT AS four FROM maps GROUP BY 1")
def a47_kinds_by_pivot(i: Inputs) -> DataFrame:
    rows = i.maps.groupBy("size_tier").pivot("team_count", [2, 3, 4]).count().fillna(0)
    return rows.withColumnsRenamed({"2": "two", "3": "three", "4": "four"})
