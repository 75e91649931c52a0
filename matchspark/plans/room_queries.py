"""Registered queries of map details; ``QUERIES`` as in ``plans/map_queries.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.operators import blocks, chests, intervals, matchstats, objectives, rooms, shapes, spatial
from matchspark.plans.inputs import Inputs
from matchspark.plans.map_queries import BOX, WALK, island_cells
from matchspark.plans.match_queries import r6
from matchspark.session import scratch_path, table
from matchspark.sources import map_rules, warehouse

QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], list[str], str]] = {}


def query(inputs: str, sql: str):
    """Register a function under its name with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = (f, inputs.split(), sql)
        return f

    return keep


def centres(i: Inputs) -> DataFrame:
    """Centres of the diamonds: ``map_id, polygon_id, x, z``."""
    return i.adapted("diamonds").where("kind = 'island'").select("map_id", "polygon_id", F.col("cx").alias("x"), F.col("cz").alias("z"))


@query("ground log", f"{WALK} SELECT i.map_id, i.island_id, coalesce(bool_or(e.event_type = 2), false) AS has_spawn, coalesce(bool_or(e.event_type = 7), false) AS has_wool, min(CASE WHEN e.event_type = 2 THEN CASE WHEN e.player_id % 2 = 0 THEN 'red' ELSE 'blue' END END) AS team FROM islands i LEFT JOIN match_log e ON e.match_id % 5 = i.map_id AND e.x = i.x AND e.z = i.z AND e.event_type IN (2, 7) GROUP BY 1, 2")
def g26_island_flags(i: Inputs) -> DataFrame:
    points = i.log.where("event_type in (2, 7)").select((F.col("match_id") % 5).alias("map_id"), F.when(F.col("event_type") == 2, "spawn").otherwise("wool").alias("kind"), F.when(F.col("player_id") % 2 == 0, "red").otherwise("blue").alias("team"), "x", "z")
    return rooms.flagged_islands(island_cells(i), points)


@query("log teams centres", "SELECT c.match_id AS map_id, w.wool_id, c.team, round(sqrt((w.x - c.x) * (w.x - c.x) + (w.z - c.z) * (w.z - c.z)), 6) AS distance FROM centres c JOIN (SELECT match_id, wool_id, median(x) AS x, median(z) AS z FROM match_log WHERE event_type = 7 GROUP BY 1, 2) w USING (match_id)")
def g18_spawn_baselines(i: Inputs) -> DataFrame:
    wools = i.log.where("event_type = 7").groupBy(F.col("match_id").alias("map_id"), "wool_id").agg(F.median("x").alias("x"), F.median("z").alias("z"))
    return rooms.baselines(i.centres.withColumnRenamed("match_id", "map_id"), wools).withColumn("distance", r6("distance"))


NEAR = "(SELECT d.polygon_id FROM diamonds d WHERE d.kind = 'island' AND d.map_id = e.match_id % 5 AND d.polygon_id % 2 = 0 ORDER BY (e.x - d.cx) * (e.x - d.cx) + (e.z - d.cz) * (e.z - d.cz), d.polygon_id LIMIT 1)"


@query("log diamonds", f"SELECT match_id, row_id, {NEAR} AS node_id FROM match_log e WHERE event_type = 2")
def g25_nearest_of_type(i: Inputs) -> DataFrame:
    even = centres(i).where("polygon_id % 2 = 0").select("map_id", F.col("polygon_id").alias("node_id"), "x", "z")
    return spatial.snapped(i.log.where("event_type = 2").withColumn("map_id", F.col("match_id") % 5), even).select("match_id", "row_id", "node_id")


@query("log lived samples diamonds", "SELECT match_id, player_id % 2 AS team, first(polygon_id ORDER BY deep DESC, n DESC, polygon_id) AS wool_id, max(deep) AS deep FROM (SELECT s.match_id, s.player_id % 2 AS player_id, d.polygon_id, count(*) FILTER (WHERE y < 5) AS deep, count(*) AS n FROM samples s JOIN diamonds d ON d.kind = 'island' AND d.map_id = s.match_id % 5 AND (s.x - d.cx) * (s.x - d.cx) + (s.z - d.cz) * (s.z - d.cz) <= 1600 GROUP BY 1, 2, 3) c GROUP BY 1, 2")
def a44_target_objective(i: Inputs) -> DataFrame:
    wools = centres(i).withColumnRenamed("polygon_id", "wool_id")
    return rooms.target_objective(i.mapped.withColumn("team", F.col("player_id") % 2), wools)


@query("log lived samples diamonds", "SELECT match_id, player_id, segment_idx, count(*) FILTER (WHERE d <= 40) AS near_samples, min(y) FILTER (WHERE d <= 40) AS min_y, round(avg(d), 6) AS mean_distance FROM (SELECT s.*, (SELECT min(sqrt((s.x - d.cx) * (s.x - d.cx) + (s.z - d.cz) * (s.z - d.cz))) FROM diamonds d WHERE d.kind = 'island' AND d.map_id = s.match_id % 5) AS d FROM samples s) n GROUP BY 1, 2, 3")
def a43_defence_metrics(i: Inputs) -> DataFrame:
    return rooms.defence_metrics(i.mapped, centres(i), ["match_id", "player_id", "segment_idx"]).withColumn("mean_distance", r6("mean_distance"))


@query("blocks resources", "SELECT b.map_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, count(DISTINCT b.block_id) AS kinds, count(DISTINCT r.resource_type) AS named, min(coalesce(resource_type, 'Block ' || b.block_id)) AS first_name FROM blocks b LEFT JOIN resources r ON r.block_id = b.block_id GROUP BY 1")
def a62_layer_summary(i: Inputs) -> DataFrame:
    name = F.create_map(*(F.lit(x) for pair in blocks.RESOURCES.items() for x in pair))
    names = i.blocks.select("block_id").distinct().where(F.col("block_id").isin(*blocks.RESOURCES)).select("block_id", name[F.col("block_id")].alias("name"))
    return rooms.layer_summary(i.blocks, names)


@query("maps", "SELECT map_id, size_tier, CAST(CASE WHEN size_tier = 'BUILDING' THEN total_blocks ELSE team_count END AS DOUBLE) AS metric, row_number() OVER (PARTITION BY size_tier ORDER BY CASE WHEN size_tier = 'BUILDING' THEN total_blocks ELSE team_count END DESC, map_id) AS place FROM maps")
def t8_characteristic_first(i: Inputs) -> DataFrame:
    return rooms.ranked(i.maps, "size_tier", {"BUILDING": "total_blocks"}, "team_count", "map_id").select("map_id", "size_tier", "metric", "place")


@query("ground", f"{WALK}{BOX} SELECT map_id, island_id, CASE WHEN island_id = 0 THEN 'main' ELSE CASE WHEN area >= 20 THEN 'large' ELSE 'small' END END AS kind, CASE WHEN area >= 20 THEN 'large' ELSE 'small' END AS auto_kind FROM box")
def l31_overridden_kinds(i: Inputs) -> DataFrame:
    rows = shapes.bounds(island_cells(i), shapes.ISLAND).select(*shapes.ISLAND, F.when(F.col("area") >= 20, "large").otherwise("small").alias("kind"))
    manual = rows.where("island_id = 0").select(*shapes.ISLAND, F.lit("main").alias("kind"))
    return rooms.overridden(rows, manual, shapes.ISLAND, "kind")


ROCK = """, l AS (SELECT map_id, x, z, max(y) AS y FROM blocks WHERE block_id = 7 GROUP BY 1, 2, 3), h AS (SELECT l.map_id, d.polygon_id AS box_id, l.x, l.z, l.y FROM l JOIN diamonds d ON d.kind = 'island' AND d.map_id = l.map_id AND abs(l.x - d.cx) <= 20 AND abs(l.z - d.cz) <= 20),
 high AS (SELECT h.* FROM h JOIN (SELECT map_id, box_id, quantile_cont(y, 0.5) + 3 AS floor FROM h GROUP BY 1, 2) f USING (map_id, box_id) WHERE y > floor)"""


def rock(i: Inputs) -> DataFrame:
    columns = i.blocks.where("block_id = 7").groupBy("map_id", "x", "z").agg(F.max("y").alias("y"))
    boxes = centres(i).select("map_id", F.col("polygon_id").alias("box_id"), *((F.col(c) + s * 20).alias(n) for c, s, n in (("x", -1, "min_x"), ("x", 1, "max_x"), ("z", -1, "min_z"), ("z", 1, "max_z"))))
    return rooms.high_bedrock(columns, boxes, 0.5)


@query("blocks diamonds", f"{ROCK} SELECT * FROM high")
def l43_high_bedrock(i: Inputs) -> DataFrame:
    return rock(i)


@query("blocks diamonds", f"{ROCK}, b AS (SELECT DISTINCT map_id, box_id, CAST(floor(z / 3.0) * 3 AS INT) AS band, x FROM high), g AS (SELECT *, x - row_number() OVER (PARTITION BY map_id, box_id, band ORDER BY x) AS g FROM b), n AS (SELECT map_id, box_id, band, g, count(*) AS n FROM g GROUP BY 1, 2, 3, 4) SELECT map_id, box_id, band, max(n) AS longest FROM n GROUP BY 1, 2, 3 HAVING max(n) >= 2")
def l44_bedrock_lines(i: Inputs) -> DataFrame:
    return rooms.lines_of(rock(i), 2)


@query("ground", f"""{WALK}{BOX}, k AS (SELECT b.map_id, b.island_id, c FROM box b, (VALUES ('nw'), ('ne'), ('sw'), ('se')) v(c) WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.map_id = b.map_id AND i.island_id = b.island_id AND i.x = CASE WHEN c[2] = 'w' THEN min_x ELSE max_x END AND i.z = CASE WHEN c[1] = 'n' THEN min_z ELSE max_z END))
 SELECT b.map_id, b.island_id, count(c) AS cutouts, coalesce(string_agg(c, ',' ORDER BY c), '') AS corners FROM box b LEFT JOIN k USING (map_id, island_id) GROUP BY 1, 2""")  # fmt: skip
def l27_corner_cutouts(i: Inputs) -> DataFrame:
    return rooms.corner_cutouts(island_cells(i))


@query("ground", f"{WALK}{BOX} SELECT map_id, island_id, round(count(*) FILTER (WHERE x = min_x) * 1.0 / (any_value(max_z) - any_value(min_z) + 1), 6) AS west, round(count(*) FILTER (WHERE x = max_x) * 1.0 / (any_value(max_z) - any_value(min_z) + 1), 6) AS east, round(count(*) FILTER (WHERE z = min_z) * 1.0 / (any_value(max_x) - any_value(min_x) + 1), 6) AS north, round(count(*) FILTER (WHERE z = max_z) * 1.0 / (any_value(max_x) - any_value(min_x) + 1), 6) AS south FROM islands JOIN box USING (map_id, island_id) GROUP BY 1, 2")
def l28_flush_sides(i: Inputs) -> DataFrame:
    return rooms.flush_sides(island_cells(i)).withColumns({c: r6(c) for c in ("west", "east", "north", "south")})


@query("maps", "SELECT map_slug, CASE WHEN map_id % 3 = 0 THEN 'spawn' WHEN map_id % 3 = 1 THEN 'wool_room' ELSE 'other' END AS category FROM maps")
def l47_region_kinds(i: Inputs) -> DataFrame:
    prefix = F.when(F.col("map_id") % 3 == 0, "Red-SPAWN-").when(F.col("map_id") % 3 == 1, "blue-wool-room-").otherwise("mid-")
    rows = rooms.region_kinds(i.maps.withColumn("region_id", F.concat(prefix, F.col("map_id"))), {"spawn": "spawn", "wool_room": "wool"})
    return rows.select("map_slug", "category")


@query("ground blocks", "SELECT map_id, count(*) AS cells, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM blocks b WHERE b.map_id = g.map_id AND b.x = g.x AND b.z = g.z AND b.block_id = 9)) AS inside FROM ground g GROUP BY 1")
def l37_overlap(i: Inputs) -> DataFrame:
    return rooms.overlap_share(i.cells, i.blocks.where("block_id = 9"))


@query("maps ground", f"{WALK}{BOX} SELECT map_id, map_slug, coalesce((SELECT string_agg(island_id || ':' || area, ',' ORDER BY island_id) FROM box b WHERE b.map_id = m.map_id), '') AS islands FROM maps m")
def l36_map_documents(i: Inputs) -> DataFrame:
    figures = shapes.bounds(island_cells(i), shapes.ISLAND).select(*shapes.ISLAND, "area")
    rows = rooms.map_documents(i.maps.select("map_id", "map_slug"), figures)
    return rows.withColumn("islands", F.array_join(F.transform("islands", lambda x: F.concat(x["island_id"].cast("string"), F.lit(":"), x["area"].cast("string"))), ","))


@query("chests", "SELECT DISTINCT map_id, p_brand AS material, CAST(substr(p_brand, 7) AS INT) AS ordinal FROM lineitem JOIN part ON l_partkey = p_partkey JOIN chests c ON c.map_id = l_suppkey AND c.chest_id = l_orderkey WHERE l_quantity >= 48 AND CAST(substr(p_brand, 7) AS INT) <= 33")
def p11_placeable(i: Inputs) -> DataFrame:
    """Brands as materials, with their number as ordinal, in stacks of 48."""
    kits = i.chests.select("map_id", F.col("category").alias("material"), F.col("cnt").alias("amount"))
    brands = table(i.spark, i.sf_dir, "part").select(F.col("p_brand").alias("material"), F.substring("p_brand", 7, 9).cast("int").alias("ordinal")).distinct()
    return rooms.placeable(kits, brands, 33, 48)


@query("matches maps", "SELECT match_id, map_slug, processed FROM matches JOIN maps USING (map_id) WHERE size_tier = 'BUILDING' AND NOT processed")
def p6_filtered_listing(i: Inputs) -> DataFrame:
    return i.matches.where("not processed").join(i.maps.where("size_tier = 'BUILDING'"), "map_id").select("match_id", "map_slug", "processed")


@query("matches maps", "SELECT match_id FROM matches WHERE processed AND map_id NOT IN (SELECT map_id FROM maps WHERE stub)")
def s33_skipped_keys(i: Inputs) -> DataFrame:
    """Processed matches of maps that have no output yet."""
    return matchstats.lacking(i.matches.where("processed"), i.maps.where("stub"), ["map_id"]).select("match_id")


@query("maps", "SELECT map_id, true AS has_context, NOT stub AS has_graph FROM maps")
def s30_artefacts(i: Inputs) -> DataFrame:
    """Which artefacts each map has, in documents of many maps a file."""
    path = scratch_path(i.spark, "artefacts")
    for name, rows in (("context", i.maps), ("graph", i.maps.where("not stub"))):
        rows.select("map_id", F.lit(1).alias("v")).write.json(f"{path}/kind={name}")
    return rooms.artefacts(warehouse.json_documents(i.spark, path, "map_id int, v int"), {"context": "has_context", "graph": "has_graph"})


def rules(i: Inputs) -> DataFrame:
    """Rule files of all maps but stubs, written as XML, ten thousand maps a file at most, and read a map a row: a file is read by one task."""
    path = scratch_path(i.spark, "rules")
    tag = lambda **values: F.struct(*(v.alias("_" + k.replace("__", "-")) for k, v in values.items()))
    at = lambda *numbers: F.concat_ws(",", *(n.cast("string") for n in numbers))
    n, text = F.col("map_id"), F.lit
    items = F.array(tag(slot=text("0"), material=text("stone sword"), amount=text(None).cast("int"), unbreakable=text(True)), tag(slot=text("1"), material=text("log"), amount=n % 64 + 1, unbreakable=text(None).cast("boolean")))
    kits = F.array(F.struct(text("main").alias("_id"), items.alias("item"), F.array(tag(slot=text("helmet"), material=text("leather helmet"), team__color=text(True))).alias("armor")), F.struct(text("spare").alias("_id"), F.slice(items, 1, 1).alias("item"), F.array().cast("array<struct<_slot: string, _material: string, `_team-color`: boolean>>").alias("armor")))
    one = lambda name, *rows: F.struct(F.array(*rows).alias(name))
    red, blue = text("red"), text("blue")
    i.maps.where("not stub").repartition("map_slug").select(
        F.col("map_slug").alias("_slug"), one("team", tag(id=red, color=text("dark red"), max=n % 40), tag(id=blue, color=blue, max=n % 40)).alias("teams"), one("wool", tag(team=blue, color=text("lime"), location=at(n, text(9), -n))).alias("wools"),
        one("spawn", tag(team=red, kit=text("main")), tag(team=blue, kit=F.when(n % 2 == 0, "main").otherwise("none"))).alias("spawns"), one("cuboid", tag(id=text("base"), min=at(n + 5, text(0), text(7)), max=F.concat(n.cast("string"), text(",oo,oo")))).alias("regions"), F.struct(kits.alias("kit")).alias("kits"),
    ).write.format("xml").option("rowTag", "map").option("maxRecordsPerFile", 10_000).save(path)
    return map_rules.read_rules(i.spark, path)


@query("maps", "SELECT map_slug, team, CASE team WHEN 'red' THEN 'dark red' ELSE 'blue' END AS colour, CAST(map_id % 40 AS INT) AS most FROM maps, (VALUES ('red'), ('blue')) v(team) WHERE NOT stub")
def s28_map_rules(i: Inputs) -> DataFrame:
    return map_rules.teams(rules(i))


@query("maps", "SELECT map_slug, 'blue' AS team, 'lime' AS colour, CAST(map_id AS DOUBLE) AS x, 9.0 AS y, CAST(-map_id AS DOUBLE) AS z, region_id, min_x, max_x, min_z, max_z FROM (SELECT *, 'base' AS region_id, CAST(map_id AS DOUBLE) AS min_x, map_id + 5.0 AS max_x, 7.0 AS min_z, 7.0 AS max_z FROM maps WHERE NOT stub) m")
def s28_wools_and_regions(i: Inputs) -> DataFrame:
    """Wools of rule files beside their map's region, which has no number on one side."""
    read = rules(i)
    return map_rules.wools(read).join(map_rules.regions(read), "map_slug")


@query("maps", """SELECT map_id, kit_id, team, part, slot, material, amount, unbreakable, team_colour FROM maps, (VALUES ('main', 'item', '0', 'stone sword', true, false), ('main', 'item', '1', 'log', false, false), ('main', 'armor', 'helmet', 'leather helmet', false, true), ('spare', 'item', '0', 'stone sword', true, false)) k(kit_id, part, slot, material, unbreakable, team_colour),
 LATERAL (SELECT CASE WHEN material = 'log' THEN CAST(map_id % 64 + 1 AS INT) ELSE 1 END AS amount), (VALUES ('red'), ('blue'), ('')) t(team) WHERE NOT stub AND CASE kit_id WHEN 'spare' THEN team = '' ELSE team = 'red' OR team = 'blue' AND map_id % 2 = 0 END""")  # fmt: skip
def s32_kit_rows(i: Inputs) -> DataFrame:
    """Kit rows are loaded for all maps, then again for some: no row doubles."""
    read, path = rules(i), scratch_path(i.spark, "kits")
    rows = map_rules.kit_rows(read).withColumn("part", F.lit("item")).unionByName(map_rules.kit_rows(read, "armor").withColumn("part", F.lit("armor")))
    rows = map_rules.known_maps(rows, i.maps).withColumn("bucket", F.col("map_id") % 8)
    for some in (rows, rows.where("bucket = 3")):
        warehouse.replace_keys(some, path, "bucket")
    return warehouse.stored(i.spark, path, rows.schema).select("map_id", "kit_id", "team", "part", "slot", "material", "amount", "unbreakable", "team_colour")


@query("log teams", """, f AS (SELECT e.match_id, e.wool_id, s.team, e.t, row_number() OVER (PARTITION BY e.match_id ORDER BY e.t, e.row_id) AS k FROM match_log e JOIN teams s ON e.match_id = s.match_id AND e.player_id = s.player_id AND e.t >= s.start_timestamp AND (s.end_timestamp IS NULL OR e.t < s.end_timestamp) WHERE e.event_type = 7)
 SELECT a.match_id, a.wool_id AS first_wool, b.wool_id AS second_wool, a.team AS attacker, d.team AS defender, b.t - a.t AS seconds FROM f a JOIN f b ON a.match_id = b.match_id AND a.k = 1 AND b.k = 2 JOIN (SELECT DISTINCT match_id, team FROM teams) d ON d.match_id = a.match_id AND d.team <> a.team""")  # fmt: skip
def j14_objective_frame(i: Inputs) -> DataFrame:
    caught = intervals.with_team(i.log.where("event_type = 7"), i.teams, how="inner")
    return objectives.capture_frame(caught, i.teams.select("match_id", "team").distinct())


@query("log", "SELECT match_id, CASE WHEN t < 60 THEN 'early' WHEN t < 180 THEN 'middle' ELSE 'late' END AS phase, wool_id, count(*) AS n FROM match_log WHERE event_type IN (6, 7) GROUP BY 1, 2, 3")
def q10_phases(i: Inputs) -> DataFrame:
    phase = F.when(F.col("t") < 60, "early").when(F.col("t") < 180, "middle").otherwise("late")
    return i.log.where("event_type in (6, 7)").groupBy("match_id", phase.alias("phase"), "wool_id").agg(F.count("*").alias("n"))


@query("maps matches", "SELECT map_id, map_slug FROM maps WHERE map_id NOT IN (SELECT map_id FROM matches WHERE processed)")
def s29_lookup_misses(i: Inputs) -> DataFrame:
    known = i.matches.where("processed").join(i.maps, "map_id").select("map_slug")
    return warehouse.lookup_misses(i.maps, known, "map_slug").join(i.maps.select("map_id", "map_slug"), "map_slug")


#: Greedy pairs in SQL, one place of a layer after the other: what is taken, who leads and with whom.
PAIRS = """, spot AS MATERIALIZED (SELECT map_id, y, x, z, x * 1000 + z AS k, row_number() OVER (PARTITION BY map_id, y ORDER BY x, z) AS n FROM (SELECT DISTINCT map_id, x, z, y // 8 AS y FROM blocks WHERE block_id = 3) b),
 first AS MATERIALIZED (SELECT s.*, (SELECT o.k FROM spot o WHERE o.map_id = s.map_id AND o.y = s.y AND abs(o.x - s.x) + abs(o.z - s.z) = 1 ORDER BY o.z <> s.z, CASE WHEN o.k > s.k THEN 0 ELSE 1 END LIMIT 1) AS mate FROM spot s),
 walk AS (SELECT map_id, y, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS taken, CAST(NULL AS INT) AS lead, CAST(NULL AS INT) AS mate FROM first WHERE n = 1 UNION ALL
  SELECT f.map_id, f.y, f.n, CASE WHEN list_contains(w.taken, f.k) THEN w.taken WHEN f.mate IS NOT NULL AND NOT list_contains(w.taken, f.mate) THEN list_concat(w.taken, [f.k, f.mate]) ELSE list_append(w.taken, f.k) END, CASE WHEN NOT list_contains(w.taken, f.k) THEN f.k END, CASE WHEN NOT list_contains(w.taken, f.k) AND NOT list_contains(w.taken, f.mate) THEN f.mate END FROM walk w JOIN first f ON f.map_id = w.map_id AND f.y = w.y AND f.n = w.n + 1),
 paired AS (SELECT map_id, y, lead AS k, lead, mate IS NOT NULL AS is_double FROM walk WHERE lead IS NOT NULL UNION ALL SELECT map_id, y, mate, lead, true FROM walk WHERE mate IS NOT NULL)"""


def chest_pairs(i: Inputs) -> DataFrame:
    """Blocks of one kind as chests, in layers of eight heights."""
    return chests.double_chests(i.blocks.where("block_id = 3").select("map_id", "x", "z", F.floor(F.col("y") / 8).cast("int").alias("y")))


@query("blocks", f"{PAIRS} SELECT map_id, y, CAST(k // 1000 AS INT) AS x, CAST(k % 1000 AS INT) AS z, is_double, CAST(lead // 1000 AS INT) AS group_x, CAST(lead % 1000 AS INT) AS group_z FROM paired")
def l9_double_chests(i: Inputs) -> DataFrame:
    return chest_pairs(i).select("map_id", "y", "x", "z", "is_double", "group_x", "group_z")


@query("blocks", f"{PAIRS} SELECT p.map_id, count(*) AS places, count(*) FILTER (is_double) AS doubled, count(DISTINCT (y, lead)) AS chests, any_value(ore) AS resources FROM paired p LEFT JOIN (SELECT map_id, count(*) AS ore FROM blocks WHERE block_id IN (5, 11) GROUP BY 1) r ON r.map_id = p.map_id GROUP BY 1")
def l13_loaded_chests(i: Inputs) -> DataFrame:
    """Chests and resource blocks of all maps are loaded, those of some again: no row doubles."""
    path = scratch_path(i.spark, "chests")
    pairs = chest_pairs(i).select("map_id", "x", "y", "z", F.lit("chest").alias("kind"), "is_double", F.concat_ws(",", "group_x", "group_z").alias("chest_group"))
    ore = i.blocks.where("block_id in (5, 11)").select("map_id", "x", "y", "z", F.lit("resource").alias("kind"), F.lit(None).cast("boolean").alias("is_double"), F.lit(None).cast("string").alias("chest_group"))
    rows = pairs.unionByName(ore)
    for some in (rows, rows.where("map_id = 3")):
        warehouse.replace_keys(some.withColumn("part", F.col("map_id")), path, "part")
    read = warehouse.stored(i.spark, path, rows.withColumn("part", F.col("map_id")).schema)
    chest, known = F.col("kind") == "chest", F.countDistinct(F.when(F.col("kind") == "chest", F.struct("y", "chest_group")))
    return read.groupBy("map_id").agg(F.count_if(chest).alias("places"), F.count_if(chest & F.col("is_double")).alias("doubled"), known.alias("chests"), F.nullif(F.count_if(~chest), F.lit(0)).alias("resources"))
