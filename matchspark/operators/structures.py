"""Walls and staircases that players build, seen in where they stand: slopes of the height field, runs of steep cells, and who holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.scalars import structure_class
from matchspark.operators.components import connected_components
from matchspark.operators.spatial import rectangle_distance
from matchspark.session import cut


def standing_cells(samples: DataFrame, key: str, min_count: int = 12, least_height: float = 2, least_cells: int = 20) -> DataFrame:
    """``key, cx, cz, n, h, cap``: cells with enough samples, their median height above the terrain, and the key's 99th percentile of heights.

    ``samples``: key, ``cx, cz, rel``; rows without ``rel`` take no part. Keys with fewer
    than ``least_cells`` such cells give no rows.
    """
    usable = samples.where("rel is not null")
    caps = usable.groupBy(key).agg(F.floor(F.percentile("rel", 0.99)).alias("cap"))
    cells = usable.groupBy(key, "cx", "cz").agg(F.count("*").alias("n"), F.median("rel").alias("h"))
    cells = cells.where((F.col("n") >= min_count) & (F.col("h") >= least_height))
    enough = cells.groupBy(key).agg(F.count("*").alias("cells")).where(F.col("cells") >= least_cells).select(key)
    return cells.join(enough, key).join(caps, key)


def local_slopes(cells: DataFrame, key: str, size: int, radius: int = 8, least: int = 6) -> DataFrame:
    """``cells`` with ``gradient`` and ``residual`` of the plane that fits the heights within ``radius`` best.

    Each cell sends its height to the cells around it, where sums of the normal equations
    are taken (combined on the map side); the two slopes are then solved from the centred
    sums. Where all cells lie on one line the slope along it counts. With fewer than
    ``least`` cells around, the gradient is 0 and the residual 9.
    """
    reach = range(-(radius // size) * size, radius + 1, size)
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx in reach for dz in reach if dx * dx + dz * dz <= radius * radius))
    sent = cells.select(key, "cx", "cz", "h", F.explode(steps).alias("s")).select(key, (F.col("cx") - F.col("s.dx")).alias("cx"), (F.col("cz") - F.col("s.dz")).alias("cz"), F.col("s.dx").cast("double").alias("dx"), F.col("s.dz").cast("double").alias("dz"), F.col("h").cast("double").alias("y"))
    total = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / F.count("*")
    sums = sent.groupBy(key, "cx", "cz").agg(F.count("*").alias("near"), *(total(a, b).alias(f"{a}_{b}") for a, b in (("dx", "dx"), ("dz", "dz"), ("dx", "dz"), ("dx", "y"), ("dz", "y"), ("y", "y"))))
    det = F.col("dx_dx") * F.col("dz_dz") - F.col("dx_dz") * F.col("dx_dz")
    line, spread = F.abs(det) < 1e-9, F.nullif(F.col("dx_dx") + F.col("dz_dz"), F.lit(0.0))
    a = F.when(line, F.col("dx_y") / spread).otherwise((F.col("dx_y") * F.col("dz_dz") - F.col("dz_y") * F.col("dx_dz")) / F.when(~line, det))
    b = F.when(line, F.col("dz_y") / spread).otherwise((F.col("dz_y") * F.col("dx_dx") - F.col("dx_y") * F.col("dx_dz")) / F.when(~line, det))
    fitted = sums.withColumn("a", a).withColumn("b", b)
    left = F.greatest(F.lit(0.0), F.col("y_y") - F.col("a") * F.col("dx_y") - F.col("b") * F.col("dz_y"))
    few = F.col("near") < least
    slopes = fitted.select(key, "cx", "cz", F.when(few, 0.0).otherwise(F.hypot("a", "b")).alias("gradient"), F.when(few, 9.0).otherwise(F.sqrt(left / F.col("near"))).alias("residual"))
    return cells.join(slopes, [key, "cx", "cz"])


def ramp_cells(cells: DataFrame, key: str, size: int, min_gradient: float = 0.35, max_residual: float = 3.0) -> DataFrame:
    """Steep cells below the key's cap with ``run``, the name of their group: cells that touch, corners included."""
    steep = cells.where((F.col("gradient") >= min_gradient) & (F.col("residual") <= max_residual) & (F.col("h") <= F.col("cap") - 2))
    steep = cut(steep.withColumn("node", (F.col("cx") + (1 << 30)).cast("long") * (1 << 32) + F.col("cz") + (1 << 30)))
    ahead = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dx, dz in ((size, 0), (0, size), (size, size), (size, -size))))
    steps = steep.select(key, F.col("node").alias("src"), "cx", "cz", F.explode(ahead).alias("s")).select(key, "src", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cz") + F.col("s.dz")).alias("cz"))
    links = steps.join(steep.select(key, "cx", "cz", F.col("node").alias("dst")), [key, "cx", "cz"]).select(key, "src", "dst")
    labels = connected_components(links, [key])
    return steep.join(labels, [key, "node"], "left").withColumn("run", F.coalesce("component", "node")).drop("component")


def ramp_runs(cells: DataFrame, key: str, least: int = 6) -> DataFrame:
    """Figures of each run of ``ramp_cells`` with ``least`` cells: place, extents along and across its main axis, rise and slopes.

    ``ratio`` is the slope along the axis over that across it (0.02 at least).
    """
    by = [key, "run"]
    turn = 0.5 * F.atan2(2 * F.covar_pop("cx", "cz"), F.var_pop("cx") - F.var_pop("cz"))
    runs = cells.groupBy(*by).agg(F.count("*").alias("cells"), F.sum("n").alias("samples"), F.avg("cx").alias("x"), F.avg("cz").alias("z"), turn.alias("turn"), (F.max("h") - F.min("h")).alias("rise")).where(F.col("cells") >= least)
    dx, dz = F.col("cx") - F.col("x"), F.col("cz") - F.col("z")
    laid = cells.select(*by, "cx", "cz", "h").join(runs, by).withColumn("along", dx * F.cos("turn") + dz * F.sin("turn")).withColumn("across", dz * F.cos("turn") - dx * F.sin("turn"))

    def slope(c: str) -> Column:
        spread = F.var_pop(c)
        return F.abs(F.coalesce(F.when(spread > 1e-9, F.covar_pop(c, "h") / spread), F.lit(0.0)))

    figures = laid.groupBy(*by).agg((F.max("along") - F.min("along")).alias("length"), (F.max("across") - F.min("across")).alias("width"), slope("along").alias("g_long"), slope("across").alias("g_across"))
    rows = runs.drop("turn").join(figures, by)
    return rows.withColumn("ratio", F.col("g_long") / F.greatest("g_across", F.lit(0.02)))


def nearest_rectangle(runs: DataFrame, rectangles: DataFrame, key: str, name: str, out: str, far: float = 999.0) -> DataFrame:
    """``runs`` with the nearest of their key's few ``rectangles (key, name, min_x, max_x, min_z, max_z)`` and its distance; ties to the smaller name."""
    far_ = rectangle_distance(F.col("x"), F.col("z"), *(F.col(c) for c in ("min_x", "max_x", "min_z", "max_z")))
    met = runs.select(key, "run", "x", "z").join(rectangles, key).groupBy(key, "run").agg(F.min(F.struct(far_.alias("d"), F.col(name).alias("n"))).alias("b"))
    joined = runs.join(met.select(key, "run", F.col("b.n").alias(name), F.col("b.d").alias(out)), [key, "run"], "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(far)))


def structures(runs: DataFrame, cells: DataFrame, samples: DataFrame, rooms: DataFrame, spawns: DataFrame, attackers: DataFrame, key: str, bow: int, details: list[int], top: int = 16, least: int = 100) -> DataFrame:
    """Runs that are stairs or walls, with the nearest room and spawn, the team that stands there most, and what it holds.

    Of a key's ``top`` runs by samples those with ``least`` ``samples (key, cx, cz, team,
    held_item)`` count. ``rooms``: key, ``wool_id`` and a rectangle; ``spawns``: key,
    ``spawn_team`` and a rectangle; ``attackers``: key, ``wool_id, attacker``. The owner
    is the commonest team (ties to the smaller name); its role is attacker or defender of
    the nearest room's wool, null where that has no attacker.
    """
    order = Window.partitionBy(key).orderBy(F.desc("samples"), "run")
    first = runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")
    here = samples.join(cells.select(key, "run", "cx", "cz"), [key, "cx", "cz"]).join(first.select(key, "run"), [key, "run"], "left_semi")
    teams = here.groupBy(key, "run", "team").agg(F.count("*").alias("k"), F.count_if(F.col("held_item") == bow).alias("bows"), F.count_if(F.col("held_item").isin(details)).alias("details"))
    known = F.when(F.col("team").isNotNull(), F.struct(-F.col("k"), "team"))
    held = teams.groupBy(key, "run").agg(F.sum("k").alias("standing"), F.sum(F.when(F.col("team").isNotNull(), F.col("k"))).alias("named"), F.min(known).alias("o"), (F.sum("bows") / F.sum("k")).alias("bow"), (F.sum("details") / F.sum("k")).alias("detail")).where(F.col("standing") >= least)
    held = held.select(key, "run", F.col("o.team").alias("owner"), (-F.col("o.col1") / F.col("named")).alias("owner_share"), "bow", "detail")
    placed = nearest_rectangle(first, rooms, key, "wool_id", "room_distance")
    placed = placed.withColumn("kind", structure_class(F.col("g_long"), F.col("ratio"), F.col("width"), F.col("length"), F.col("room_distance"))).where("kind is not null")
    placed = nearest_rectangle(placed, spawns, key, "spawn_team", "spawn_distance").join(held, [key, "run"])
    role = F.when(F.col("attacker").isNotNull(), F.when(F.col("owner") != F.col("attacker"), "defender").otherwise("attacker"))
    return placed.join(attackers.select(key, "wool_id", "attacker"), [key, "wool_id"], "left").withColumn("role", role).drop("attacker")


def structure_sweep(found: DataFrame, near: float = 45) -> DataFrame:
    """One row over all structures: walls with a role, those their room's defenders hold, their median distance to it; stairs within ``near`` of a spawn, those their own team walks, their median slope."""
    wall = (F.col("kind") == "wall") & F.col("role").isNotNull()
    stair = (F.col("kind") == "stair") & (F.col("spawn_distance") <= near)
    return found.agg(
        F.count_if(wall).alias("walls"), F.count_if(wall & (F.col("role") == "defender")).alias("defended"), F.median(F.when(wall, F.col("room_distance"))).alias("wall_distance"),
        F.count_if(stair).alias("stairs"), F.count_if(stair & (F.col("owner") == F.col("spawn_team"))).alias("own_stairs"), F.median(F.when(stair, F.col("g_long"))).alias("stair_gradient"),
    )
