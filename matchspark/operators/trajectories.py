"""Positions of lives: samples in order, cells, climbs, visits, and figures of each life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from matchspark.operators.sessions import KILL, LIFE, POSITION, asof_segment, at_first, at_last


def in_life() -> WindowSpec:
    return Window.partitionBy(*LIFE).orderBy("t", "row_id")


def so_far() -> WindowSpec:
    return in_life().rowsBetween(Window.unboundedPreceding, 0)



def grid_floor(c: str | Column, size: int, origin: Column | int = 0) -> Column:
    """Lower corner of the grid cell that holds a coordinate; floors, does not truncate."""
    c = F.col(c) if isinstance(c, str) else c
    origin = F.lit(origin) if isinstance(origin, int) else origin
    return (F.floor((c - origin) / size) * size + origin).cast("int")


def life_samples(log: DataFrame, size: int = 5) -> DataFrame:
    """Position samples of lives with their cell and the place, cell and second of the one before."""
    rows = asof_segment(log).where((F.col("event_type") == POSITION) & F.col("segment_idx").isNotNull())
    rows = rows.withColumn("cx", grid_floor("x", size)).withColumn("cz", grid_floor("z", size))
    return rows.select("*", *(F.lag(c).over(in_life()).alias(f"before_{c}") for c in ("x", "z", "cx", "cz", "t")))


def last_positions(samples: DataFrame) -> DataFrame:
    """The last sample of each life."""
    return samples.groupBy(*LIFE).agg(*(at_last(c, "t", "row_id").alias(c) for c in ("t", "x", "y", "z")))


def without_repeats(samples: DataFrame) -> DataFrame:
    """Samples whose cell differs from that of the sample before."""
    return samples.where(F.col("before_cx").isNull() | (F.col("before_cx") != F.col("cx")) | (F.col("before_cz") != F.col("cz")))


def climbs(samples: DataFrame, low: int = 20, high: int = 40, within: int = 90) -> DataFrame:
    """High samples whose last low sample lies at most ``within`` seconds back, with no high one between."""
    low_t = F.last(F.when(F.col("y") <= low, F.col("t")), ignorenulls=True).over(in_life().rowsBetween(Window.unboundedPreceding, -1))
    high_t = F.last(F.when(F.col("y") >= high, F.col("t")), ignorenulls=True).over(in_life().rowsBetween(Window.unboundedPreceding, -1))
    rows = samples.withColumn("low_t", low_t).withColumn("high_t", high_t)
    return rows.where((F.col("y") >= high) & (F.col("t") - F.col("low_t") <= within) & (F.col("high_t").isNull() | (F.col("high_t") < F.col("low_t"))))


def runs(rows: DataFrame, keys: list[str], value: str, time: str = "t", tie: str = "row_id") -> DataFrame:
    """Run-length encoding: ``keys, run, value, entry_timestamp, exit_timestamp, ticks``; runs count from 1."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    new = F.when(F.lag(value).over(order) == F.col(value), 0).otherwise(1)
    numbered = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(time).alias("entry_timestamp"), F.max(time).alias("exit_timestamp"), F.count("*").alias("ticks"))


def cell_occupation(positions: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """Samples and players of each grid cell, and its modal island (the smallest of equally common ones), if given."""
    rows = positions.withColumn("cx", grid_floor("x", size)).withColumn("cz", grid_floor("z", size))
    found = rows.groupBy(*keys, "cx", "cz").agg(F.count("*").alias("occupation"), F.count_distinct("player_id").alias("players"))
    if "island_id" not in positions.columns:
        return found
    modes = rows.where("island_id is not null").groupBy(*keys, "cx", "cz", "island_id").agg(F.count("*").alias("n"))
    modes = modes.groupBy(*keys, "cx", "cz").agg(F.min_by("island_id", F.struct(-F.col("n"), "island_id")).alias("island_id"))
    return found.join(modes, [*keys, "cx", "cz"], "left")


def occupied_cells(samples: DataFrame) -> DataFrame:
    """Cells of a match with their samples, numbered by their place."""
    cells = samples.groupBy("match_id", "cx", "cz").agg(F.count("*").alias("occupation"))
    return cells.withColumn("node_id", F.row_number().over(Window.partitionBy("match_id").orderBy("cx", "cz")))


def transitions(rows: DataFrame, keys: list[str], per: list[str], cell: str) -> DataFrame:
    """Undirected counts of moves between cells that follow each other within ``per``, by ``keys``."""
    before = F.lag(cell).over(Window.partitionBy(*per).orderBy("t", "row_id"))
    moved = rows.withColumn("__before", before).where(F.col("__before").isNotNull() & (F.col("__before") != F.col(cell)))
    return moved.groupBy(*keys, F.least("__before", cell).alias("cell_a"), F.greatest("__before", cell).alias("cell_b")).agg(F.count("*").alias("transitions"))


def cumulative_share(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Running share of ``value`` from the largest down."""
    order = Window.partitionBy(*keys).orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("share", F.sum(value).over(order) / F.sum(value).over(Window.partitionBy(*keys)))


def life_paths(samples: DataFrame, least: int = 4) -> DataFrame:
    """Samples, distinct cells, path length, span and tortuosity of lives with ``least`` samples."""
    step = F.coalesce(F.hypot(F.col("x") - F.col("before_x"), F.col("z") - F.col("before_z")), F.lit(0.0))
    span = F.hypot(F.max("x") - F.min("x"), F.max("z") - F.min("z"))
    rows = samples.groupBy(*LIFE).agg(F.count("*").alias("samples"), F.count_distinct("cx", "cz").alias("unique_cells"), F.sum(step).alias("path"), span.alias("span"))
    return rows.where(F.col("samples") >= least).withColumn("tortuosity", F.col("path") / F.greatest("span", F.lit(1.0)))


def objective_distances(samples: DataFrame, wools: DataFrame, least: int = 4) -> DataFrame:
    """Per life: least distance to another team's objectives and mean distance to the own ones; infinite ones are left out.

    ``samples`` carry ``map_id, team``; ``wools``: ``map_id, team, x, z`` (a few a map).
    """
    w = wools.select("map_id", F.col("team").alias("wool_team"), F.col("x").alias("wx"), F.col("z").alias("wz"))
    far = F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz"))
    each = samples.join(w, "map_id").groupBy(*LIFE, "row_id").agg(F.min(F.when(F.col("wool_team") != F.col("team"), far)).alias("enemy"), F.min(F.when(F.col("wool_team") == F.col("team"), far)).alias("home"))
    return each.groupBy(*LIFE).agg(F.count("*").alias("samples"), F.min("enemy").alias("enemy_min"), F.avg("home").alias("home_mean")).where(F.col("samples") >= least)


def node_sequences(samples: DataFrame, node: str, depth: str) -> DataFrame:
    """Per life: nodes in order without repeats, as text, least ``depth`` and the node of the last sample."""
    kept = samples.withColumn("__last", F.lag(node).over(in_life())).where(F.col(node).isNotNull())
    changed = F.when(F.col("__last").isNull() | (F.col("__last") != F.col(node)), F.struct("t", "row_id", F.col(node).alias("n")))
    rows = F.array_sort(F.collect_list(changed))
    return kept.groupBy(*LIFE).agg(F.array_join(F.transform(rows, lambda r: r["n"].cast("string")), ",").alias("node_sequence"), F.min(depth).alias("max_attack_depth"), at_last(node, "t", "row_id").alias("death_node"))


def life_heights(samples: DataFrame, high: int = 22, least: int = 4) -> DataFrame:
    """Mean height and share of samples from ``high`` up, of lives with ``least`` samples."""
    rows = samples.groupBy(*LIFE).agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg((F.col("y") >= high).cast("int")).alias("high_share"))
    return rows.where(F.col("n") >= least).drop("n")


def sky_cells(samples: DataFrame, ceiling: int = 40, least: int = 3) -> DataFrame:
    """Cells with ``least`` samples at the ceiling, and their players."""
    return samples.where(F.col("y") >= ceiling).groupBy("match_id", "cx", "cz").agg(F.count("*").alias("n"), F.count_distinct("player_id").alias("players")).where(F.col("n") >= least)


def entry_points(climbs_: DataFrame, least: int = 3) -> DataFrame:
    """Cells where climbs end, from ``least`` climbs on, with the running share of the match's climbs."""
    cells = climbs_.groupBy("match_id", "cx", "cz").agg(F.count("*").alias("n"), F.median(F.col("t") - F.col("low_t")).alias("median_seconds")).where(F.col("n") >= least)
    return cumulative_share(cells.withColumn("place", F.struct("cx", "cz")), ["match_id"], "n", "place").drop("place")


def lowest_floors(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Excavation of each column: lowest height over matches, range of the matches' floors (0: static), matches."""
    floors = positions.groupBy(*keys, "match_id", "x", "z").agg(F.min("y").alias("low"))
    return floors.groupBy(*keys, "x", "z").agg(F.min("low").alias("lowest"), (F.max("low") - F.min("low")).alias("floor_range"), F.count("*").alias("matches"))


def dug_profile(cells: DataFrame, rooms: DataFrame, band: int = 5) -> DataFrame:
    """Per map and distance band from the nearest room: cells, median range of floors, share of static cells and of those 5 deep or more.

    ``cells``: ``map_id, x, z, lowest, floor_range``; ``rooms``: ``map_id, x, z`` (a few a map).
    """
    r = rooms.select("map_id", F.col("x").alias("rx"), F.col("z").alias("rz"))
    near = cells.join(r, "map_id").groupBy("map_id", "x", "z", "lowest", "floor_range").agg(F.min(F.hypot(F.col("x") - F.col("rx"), F.col("z") - F.col("rz"))).alias("d"))
    return near.groupBy("map_id", grid_floor("d", band).alias("band")).agg(
        F.count("*").alias("cells"), F.median("floor_range").alias("median_range"), F.avg((F.col("floor_range") == 0).cast("int")).alias("static_share"), F.avg((F.col("floor_range") >= 5).cast("int")).alias("deep_share"))


def dominant(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The commonest ``kind`` of each key and its rows; of equally common ones the smallest."""
    counts = rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(kind, "n"), F.struct(-F.col("n"), kind)).alias("best"))
    return best.select(*keys, f"best.{kind}", "best.n")


def depth_series(samples: DataFrame, deaths: DataFrame, depth: Column, bucket: int = 60) -> DataFrame:
    """Mean and spread of attack depth and deaths for each match and ``bucket`` seconds with samples."""
    minute = F.floor(F.col("t") / bucket).cast("int").alias("minute")
    rows = samples.groupBy("match_id", minute).agg(F.avg(depth).alias("mean_depth"), F.stddev_samp(depth).alias("sd_depth"))
    fell = deaths.groupBy("match_id", minute).agg(F.count("*").alias("deaths"))
    return rows.join(fell, ["match_id", "minute"], "left").withColumn("deaths", F.coalesce("deaths", F.lit(0)))


def density(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of each cell and their share of the fullest cell of the key."""
    cells = samples.groupBy(*keys, "cx", "cz").agg(F.count("*").alias("n"))
    return cells.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))


VISIT = [*LIFE, "visit_idx"]


def region_visits(samples: DataFrame, kills: DataFrame, lives: DataFrame) -> DataFrame:
    """Visits of a life: runs of one island, or of one pair of islands while building; void samples are left out.

    ``samples``: life, ``t, row_id, location_type, island_id, near_1, near_2, node, team,
    home_island, island_team``; ``kills``: life, ``t``; ``lives``: life, ``outcome``. A build
    visit lies between the last node of the island before and the first node of the next.
    """
    built = F.col("location_type") == "build_region"
    rows = samples.where(F.col("location_type") != "void")
    key = F.struct("location_type", F.when(~built, F.col("island_id")).alias("island"), F.when(built, F.least("near_1", "near_2")).alias("a"), F.when(built, F.greatest("near_1", "near_2")).alias("b"))
    rows = rows.withColumn("key", F.to_json(key))
    new = F.when(F.lag("key").over(in_life()) == F.col("key"), 0).otherwise(1)
    rows = rows.withColumn("new", new)
    rows = rows.withColumn("visit_idx", (F.sum("new").over(so_far()) - 1).cast("int"))
    path = F.transform(F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("t", "row_id", "node")))), lambda r: r["node"])
    visits = rows.groupBy(*VISIT).agg(
        at_first("location_type", "t", "row_id").alias("location_type"), at_first("island_id", "t", "row_id").alias("island"), F.min(F.least("near_1", "near_2")).alias("pair_1"), F.max(F.greatest("near_1", "near_2")).alias("pair_2"),
        F.min("t").alias("entry_timestamp"), F.max("t").alias("exit_timestamp"), F.count("*").alias("ticks"), path.alias("path"),
        *(at_first(c, "t", "row_id").alias(c) for c in ("team", "home_island", "island_team")),
    )
    visits = visits.withColumn("entry_node", F.try_element_at("path", F.lit(1))).withColumn("exit_node", F.try_element_at("path", F.lit(-1)))
    visits = visits.withColumn("node_path", F.filter("path", lambda x, i: (i == 0) | (x != F.try_element_at("path", i))))
    order = Window.partitionBy(*LIFE).orderBy("visit_idx")
    island = F.col("location_type") == "island"
    earlier = F.last(F.when(island, F.col("exit_node")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(F.when(island, F.col("entry_node")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    visits = visits.withColumn("earlier", earlier).withColumn("later", later).withColumn("last_idx", F.max("visit_idx").over(Window.partitionBy(*LIFE)))
    hits = kills.select(*LIFE, F.col("t").alias("kill_t")).join(visits.select(*VISIT, "entry_timestamp", "exit_timestamp"), LIFE).where("kill_t between entry_timestamp and exit_timestamp")
    visits = visits.join(hits.groupBy(*VISIT).agg(F.count("*").alias("kill_count")), VISIT, "left").join(lives.select(*LIFE, "outcome"), LIFE, "left")
    at_island = island & F.col("island").isNotNull()
    return visits.select(
        *VISIT, "location_type", F.when(island, F.col("island")).alias("island_id"), F.when(~island, F.col("pair_1")).alias("bridge_island_1"), F.when(~island, F.col("pair_2")).alias("bridge_island_2"),
        "entry_timestamp", "exit_timestamp", (F.col("exit_timestamp") - F.col("entry_timestamp")).alias("duration_s"), "ticks",
        F.when(at_island, F.coalesce(F.col("island") == F.col("home_island"), F.lit(False))).alias("is_home_island"), F.when(at_island, F.coalesce(F.col("island_team") != F.col("team"), F.lit(False))).alias("is_enemy_island"),
        F.coalesce("kill_count", F.lit(0)).alias("kill_count"), ((F.col("visit_idx") == F.col("last_idx")) & F.coalesce(F.col("outcome") == "death", F.lit(False))).alias("was_death"),
        "entry_node", "exit_node", F.when(~island, F.col("earlier")).alias("bridge_node_1"), F.when(~island, F.col("later")).alias("bridge_node_2"), F.array_join(F.transform("node_path", lambda n: n.cast("string")), ",").alias("node_path"),
    )


def visit_summary(visits: DataFrame) -> DataFrame:
    """Per life: visits, distinct islands, changes of region, shares of time, seconds to the first departure, kills by place."""
    seconds = lambda which: F.sum(F.when(which, F.col("duration_s")).otherwise(0))
    home, enemy, build = F.coalesce("is_home_island", F.lit(False)), F.coalesce("is_enemy_island", F.lit(False)), F.col("location_type") == "build_region"
    total = F.sum("duration_s")
    share = lambda which: F.when(total > 0, F.round(seconds(which) / total, 6))
    return visits.groupBy(*LIFE).agg(
        F.count("*").alias("n_visits"), F.count_distinct("island_id").alias("islands_visited"), (F.count("*") - 1).alias("transitions"),
        share(home).alias("frac_time_home"), share(enemy).alias("frac_time_enemy"), share(build).alias("frac_time_build"),
        F.min(F.when(~home, F.col("entry_timestamp"))).cast("int").alias("first_departure"),
        F.sum(F.when(build, F.col("kill_count")).otherwise(0)).alias("kills_build"), F.sum(F.when(enemy, F.col("kill_count")).otherwise(0)).alias("kills_enemy"),
    )


def life_kills(log: DataFrame) -> DataFrame:
    """Kills with the life of their killer."""
    return asof_segment(log).where((F.col("event_type") == KILL) & F.col("segment_idx").isNotNull())
