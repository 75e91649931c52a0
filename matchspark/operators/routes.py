"""Ways to objectives: the paths of lives that reach one, where bundles of paths split, and which side of a void they take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.sessions import LIFE
from matchspark.operators.studies import resampled

#: Points of a resampled path, how far back it reaches, the least share on each side of a split, and its least width.
POINTS, REACH, SIDE, WIDE = 14, 80.0, 0.2, 12.0


def reached(touches: DataFrame, samples: DataFrame, radius: float = 30.0, back: int = 40, least: int = 4) -> DataFrame:
    """The samples that lead to each touch: ``touch_id, idx, x, z``, from ``back`` before the last one outside ``radius`` on.

    ``touches``: ``touch_id``, a life, ``t, wx, wz`` (the objective); ``samples``: a life,
    ``t, row_id, x, z``. Touches count whose life has ``least`` samples until then, the
    last of them within ``radius`` and some outside. A life meets only its own touches.
    """
    w = touches.select("touch_id", *LIFE, F.col("t").alias("touch_t"), "wx", "wz")
    met = samples.select(*LIFE, "t", "row_id", "x", "z").join(w, LIFE).where(F.col("t") <= F.col("touch_t"))
    met = met.withColumn("outside", F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz")) > radius)
    order, all_ = Window.partitionBy("touch_id").orderBy("t", "row_id"), Window.partitionBy("touch_id")
    ranked = met.withColumn("idx", F.row_number().over(order))
    ranked = ranked.withColumn("crossed", F.max(F.when(F.col("outside"), F.col("idx"))).over(all_)).withColumn("n", F.count("*").over(all_))
    return ranked.where((F.col("n") >= least) & (F.col("crossed") < F.col("n")) & (F.col("idx") >= F.col("crossed") - back)).select("touch_id", "idx", "x", "z")


def bundles(paths: DataFrame, touches: DataFrame, keys: list[str], least: int = 10, points: int = POINTS, reach: float = REACH) -> DataFrame:
    """``keys, k, touch_id, x, z, far, n``: the resampled paths of each bundle (objective and team) with ``least`` of them.

    Paths count by their points within ``reach`` of the objective: four at least, over 20
    blocks. ``touches`` has ``touch_id, wx, wz`` and ``keys``; paths of different keys
    never meet.
    """
    w = touches.select("touch_id", "wx", "wz", *keys)
    near = paths.join(w.select("touch_id", "wx", "wz"), "touch_id").where(F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz")) <= reach)
    curves = resampled(near.select("touch_id", "idx", "x", "z"), ["touch_id"], points, float("inf"))
    placed = curves.join(w, "touch_id").withColumn("far", F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz")))
    return placed.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "k"))).where(F.col("n") >= least).select(*keys, "k", "touch_id", "x", "z", "far", "n")


def split_profile(curves: DataFrame, keys: list[str], least: int = 8, side: float = SIDE) -> DataFrame:
    """``keys, k, n, gap, minority, spread, distance``: at each point of a bundle the widest gap along its main axis that leaves ``side`` on each side.

    Of equal gaps the first counts; where all places are equal the gap is 0.
    """
    by = [*keys, "k"]
    mid = curves.groupBy(*by).agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"), (0.5 * F.atan2(2 * F.covar_pop("x", "z"), F.var_pop("x") - F.var_pop("z"))).alias("turn"), F.count("*").alias("of"), F.avg("far").alias("distance")).where(F.col("of") >= least)
    at = F.round((F.col("x") - F.col("mx")) * F.cos("turn") + (F.col("z") - F.col("mz")) * F.sin("turn"), 9)
    placed = curves.join(mid, by).withColumn("at", at)
    order = Window.partitionBy(*by).orderBy("at", "touch_id")
    gaps = placed.withColumn("gap", F.round(F.col("at") - F.lag("at").over(order), 6)).withColumn("below", F.row_number().over(order) - 1)
    low = F.greatest(F.lit(1), F.floor(side * F.col("of")))
    fit = (F.col("below") >= low) & (F.col("below") <= F.col("of") - low)
    best = gaps.groupBy(*by).agg(F.first("of").alias("n"), F.first("distance").alias("distance"), (F.max("at") - F.min("at")).alias("spread"), F.max(F.when(fit, F.struct("gap", -F.col("below")))).alias("b"))
    return best.select(*by, "n", F.col("b.gap").alias("gap"), (F.least(-F.col("b.col2"), F.col("n") + F.col("b.col2")) / F.col("n")).alias("minority"), "spread", "distance")


def route_splits(profile: DataFrame, keys: list[str], inner: float = 45, wide: float = WIDE, side: float = SIDE) -> DataFrame:
    """Each bundle's widest gap near the objective (``approach``) and further out (``lane``), and whether each is a second route."""
    point = F.struct("gap", -F.col("k"), "minority")
    near = F.col("distance") <= inner
    rows = profile.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(near, point)).alias("a"), F.max(F.when(~near, point)).alias("l"))
    split = lambda c: F.coalesce((F.col(f"{c}.gap") >= wide) & (F.col(f"{c}.minority") >= side), F.lit(False))
    return rows.select(*keys, "n", F.col("a.gap").alias("approach_gap"), split("a").alias("two_approaches"), F.col("l.gap").alias("lane_gap"), split("l").alias("two_lanes"))


def void_sides(paths: DataFrame, touches: DataFrame, voids: DataFrame, least: int = 10, margin: float = 10, bucket: int = 32) -> DataFrame:
    """``map_id, void_id, wool_id, team, near, rotated, share``: how many ways round each void were taken on its less common side.

    A path of three points or more skirts a void if it comes within half the void's longer
    side and ``margin`` of its centre, and the void lies between the path's start and the
    objective along the axis from the team's spawn. The side is the sign of the offset from
    that axis at the nearest point (the first of equally near ones). ``voids``: ``map_id,
    void_id, x, z, half``; ``touches``: ``touch_id, map_id, wool_id, team, wx, wz, sx, sz``.
    Points meet voids in grid buckets that cover the voids' surroundings.
    """
    reach = F.col("half") + margin
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / bucket), F.floor((F.col(c) + reach) / bucket)))
    posted = voids.select("map_id", "void_id", F.col("x").alias("vx"), F.col("z").alias("vz"), "half").withColumn("x", F.col("vx")).withColumn("z", F.col("vz")).withColumn("bx", spread("x")).withColumn("bz", spread("z")).drop("x", "z")
    ends = paths.groupBy("touch_id").agg(F.count("*").alias("points"), F.min(F.struct("idx", "x", "z")).alias("start")).where("points >= 3")
    known = touches.join(ends, "touch_id")
    points = paths.join(known.select("touch_id", "map_id"), "touch_id").withColumn("bx", F.floor(F.col("x") / bucket)).withColumn("bz", F.floor(F.col("z") / bucket))
    far = F.hypot(F.col("x") - F.col("vx"), F.col("z") - F.col("vz"))
    met = points.join(posted, ["map_id", "bx", "bz"]).withColumn("far", far).where(F.col("far") <= reach)
    nearest = met.groupBy("touch_id", "void_id", "vx", "vz").agg(F.min(F.struct("far", "idx", "x", "z")).alias("p"))
    rows = nearest.join(known, "touch_id")
    dx, dz = F.col("wx") - F.col("sx"), F.col("wz") - F.col("sz")
    length = F.hypot(dx, dz)
    rows = rows.withColumn("ax", F.when(length > 0, dx / F.nullif(length, F.lit(0.0))).otherwise(0.0)).withColumn("az", F.when(length > 0, dz / F.nullif(length, F.lit(0.0))).otherwise(0.0))
    along = lambda x, z: (F.col(x) - F.col("sx")) * F.col("ax") + (F.col(z) - F.col("sz")) * F.col("az")
    a, b, v = along("start.x", "start.z"), along("wx", "wz"), along("vx", "vz")
    lateral = (F.col("p.z") - F.col("vz")) * F.col("ax") - (F.col("p.x") - F.col("vx")) * F.col("az")
    between = rows.where((v >= F.least(a, b) - 5) & (v <= F.greatest(a, b) + 5))
    tally = between.groupBy("map_id", "void_id", "wool_id", "team").agg(F.count_if(lateral >= 0).alias("one"), F.count_if(lateral < 0).alias("other"))
    near = F.col("one") + F.col("other")
    return tally.where(near >= least).select("map_id", "void_id", "wool_id", "team", near.alias("near"), F.least("one", "other").alias("rotated"), (F.least("one", "other") / near).alias("share"))
