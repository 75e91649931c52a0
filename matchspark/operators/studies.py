"""Studies over many matches: selections, bands, profiles, approaches, traces, fingerprints of play."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.sessions import LIFE, PLAYER


def map_totals(matches: DataFrame, lives: DataFrame, keys: list[str]) -> DataFrame:
    """Participations and minutes of life of each key; both are summed apart and then joined."""
    people = matches.groupBy(*keys).agg(F.sum("player_count").alias("participants"))
    minutes = lives.groupBy(*keys).agg((F.sum("duration") / 60).alias("life_minutes"))
    return people.join(minutes, keys, "left").withColumn("life_minutes", F.coalesce("life_minutes", F.lit(0.0)))


def trajectory_positions(positions: DataFrame, matches: DataFrame, interval: int) -> DataFrame:
    """Positions for trajectory work: of processed matches of this sampling interval (or an unknown one), above 0, not in the void."""
    fit = matches.where("processed").where(F.col("log_interval").isNull() | (F.col("log_interval") == interval)).select("match_id")
    return positions.join(fit, "match_id", "left_semi").where((F.col("y") > 0) & (F.coalesce("location_type", F.lit("")) != "void"))


def within_box(rows: DataFrame, min_x: int, max_x: int, min_z: int, max_z: int) -> DataFrame:
    return rows.where(F.col("x").between(min_x, max_x) & F.col("z").between(min_z, max_z))


def exactly(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of the keys that exactly n rows have."""
    return rows.join(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") == n).select(*keys), keys, "left_semi")


def sweep(matches: DataFrame, least: int, n: int) -> DataFrame:
    """The n longest processed matches longer than ``least``; ties to the smaller number."""
    return matches.where(F.col("processed") & (F.col("match_duration") > least)).orderBy(F.desc("match_duration"), "match_id").limit(n)


def around(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """``points (map_id, point_id, x, z)`` with each of ``places (map_id, region_id, px, pz)`` within ``radius``, and its ``distance``; they meet in grid buckets."""
    from matchspark.operators.spatial import held_by

    squares = places.select("map_id", F.struct("region_id", "px", "pz").alias("region_id"), *((F.col(f"p{c}") + s * radius).alias(f"{e}_{c}") for c in ("x", "z") for e, s in (("min", -1), ("max", 1))))
    far = F.hypot(F.col("region_id.px") - F.col("x"), F.col("region_id.pz") - F.col("z"))
    met = held_by(points.select("map_id", "point_id", "x", "z"), squares).withColumn("distance", far).where(F.col("distance") <= radius)
    return met.select("map_id", "point_id", "x", "z", "region_id.region_id", "distance")


def near_points(figures: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Islands whose centre lies within ``radius`` of a point ``map_id, point_id, x, z``."""
    centres = figures.select("map_id", F.col("island_id").alias("region_id"), F.col("center_x").alias("px"), F.col("center_z").alias("pz"))
    return around(points, centres, radius).select("map_id", "point_id", F.col("region_id").alias("island_id"), "distance")


def defence_zone(samples: DataFrame, radius: float = 70.0, steps: float = 60.0) -> DataFrame:
    """Samples near the target: within ``radius`` in a straight line or ``steps`` along the graph; an endless way counts as the straight one."""
    walked = F.when(F.col("walked") < float("inf"), F.col("walked"))
    return samples.where((F.col("straight") <= radius) | (F.coalesce(walked, "straight") <= steps))


def traces(events: DataFrame, kinds: tuple[int, ...] = (3, 5, 6, 7)) -> DataFrame:
    """Per life, its events of these kinds in order as one text ``t:kind`` and their number."""
    rows = events.where(F.col("event_type").isin(*kinds) & F.col("segment_idx").isNotNull())
    steps = F.array_sort(F.collect_list(F.struct("t", "row_id", "event_type")))
    return rows.groupBy(*LIFE).agg(F.count("*").alias("n"), F.array_join(F.transform(steps, lambda s: F.concat(s["t"].cast("string"), F.lit(":"), s["event_type"].cast("string"))), ",").alias("trace"))


def enriched(positions: DataFrame, items: DataFrame) -> DataFrame:
    """Positions with the item that the player of the match held in that second; the smallest of several."""
    held = items.groupBy(*PLAYER, "t").agg(F.min("item").alias("item"))
    return positions.join(held, [*PLAYER, "t"], "left")


def below_surface(positions: DataFrame, terrain: DataFrame) -> DataFrame:
    """Samples under the surface of their column, with the depth."""
    return positions.join(terrain.select("map_id", "x", "z", "surface_y"), ["map_id", "x", "z"]).where(F.col("y") < F.col("surface_y") + 1).withColumn("depth", F.col("surface_y") + 1 - F.col("y"))


def shape_overlay(positions: DataFrame, cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Samples by canonical shape and place within the island's box, over all instances of the shape."""
    corner = cells.groupBy("map_id", "island_id").agg(F.min("x").alias("x0"), F.min("z").alias("z0"))
    on = positions.join(cells, ["map_id", "x", "z"]).join(corner, ["map_id", "island_id"]).join(keys, ["map_id", "island_id"])
    return on.groupBy("canonical_key", (F.col("x") - F.col("x0")).alias("dx"), (F.col("z") - F.col("z0")).alias("dz")).agg(F.count("*").alias("n"))


def pooled_bands(profile: DataFrame, least: int = 200) -> DataFrame:
    """Bands of all maps together, weighted by their cells, from ``least`` cells on."""
    rows = profile.groupBy("band").agg(F.sum("cells").alias("cells"), (F.sum(F.col("static_share") * F.col("cells")) / F.sum("cells")).alias("static_share"), F.count("*").alias("maps"))
    return rows.where(F.col("cells") >= least)


def completeness(diggable: DataFrame, floors: DataFrame, rooms: DataFrame, radius: float = 25.0, least: int = 40) -> DataFrame:
    """Mean share of the dug depth over all diggable cells near each room; untouched cells count 0.

    ``diggable``: ``map_id, x, z, depth`` (greatest possible); ``floors``: ``map_id, x, z,
    dug``; ``rooms``: ``map_id, room_id, x, z``. Rooms with ``least`` cells.
    """
    places = rooms.select("map_id", F.col("room_id").alias("region_id"), F.col("x").alias("px"), F.col("z").alias("pz"))
    near = around(diggable.withColumn("point_id", F.col("depth")), places, radius).select("map_id", "x", "z", F.col("point_id").alias("depth"), F.col("region_id").alias("room_id")).join(floors, ["map_id", "x", "z"], "left")
    share = F.least(F.lit(1.0), F.coalesce("dug", F.lit(0)) / F.greatest("depth", F.lit(1)))
    return near.groupBy("map_id", "room_id").agg(F.count("*").alias("cells"), F.avg(share).alias("complete")).where(F.col("cells") >= least)


def flank_frame(samples: DataFrame, axes: DataFrame, low: float = 0.55, high: float = 0.95, least: int = 15) -> DataFrame:
    """Median lateral offset of attack samples between two shares of the way from own to enemy spawn.

    ``axes``: ``match_id, team, x, z, ex, ez``; keys with ``least`` samples count.
    """
    a = axes.select("match_id", "team", *(F.col(c).cast("double").alias(f"a_{c}") for c in ("x", "z", "ex", "ez")))
    ux, uz = F.col("a_ex") - F.col("a_x"), F.col("a_ez") - F.col("a_z")
    vx, vz = F.col("x") - F.col("a_x"), F.col("z") - F.col("a_z")
    length = ux * ux + uz * uz
    rows = samples.join(a, ["match_id", "team"]).where(length > 0).withColumn("along", (ux * vx + uz * vz) / length).withColumn("off", (uz * vx - ux * vz) / F.sqrt(length))
    return rows.where(F.col("along").between(low, high)).groupBy("match_id", "team").agg(F.count("*").alias("samples"), F.median("off").alias("median_offset")).where(F.col("samples") >= least)


def best_by(rows: DataFrame, category: dict[str, tuple], key: str) -> DataFrame:
    """``category, key, metric``: for each category in turn the best row of its pool that none of those it gives way to took.

    ``category``: name -> (pool condition, metric, names it gives way to: all earlier ones
    if left out); the greatest metric wins, ties go to the smaller key, rows without one
    come last. One pass ranks every pool and keeps as many of its rows as earlier picks can
    take from it, and one more; the picks are made among these few rows.
    """
    names = list(category)
    after = {n: list(c[2]) if len(c) > 2 else names[:k] for k, (n, c) in enumerate(category.items())}
    entries = F.array(*(F.when(F.coalesce(c[0], F.lit(False)), F.struct(F.lit(n).alias("category"), c[1].cast("double").alias("metric"), F.lit(len(after[n]) + 1).alias("most"))) for n, c in category.items()))
    pools = rows.select(key, F.explode(entries).alias("e")).where("e is not null").select(key, "e.*")
    order = Window.partitionBy("category").orderBy(F.desc_nulls_last("metric"), key)
    first = pools.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= len(names)).where("rank <= most")

    def chosen(some: pd.DataFrame) -> pd.DataFrame:
        taken, out = {}, []
        for n in names:
            left = some[(some["category"] == n) & ~some[key].isin([taken[x] for x in after[n] if x in taken])].sort_values("rank")
            if len(left):
                taken[n] = left.iloc[0][key]
                out.append(left.iloc[:1])
        return pd.concat(out)[["category", key, "metric"]]

    kind = rows.schema[key].dataType.simpleString()
    return first.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(chosen, f"category string, {key} {kind}, metric double")


def representatives(lives: DataFrame, key: str, positions: int = 8, few: int = 4, roamed: float = 40, nodes: int = 12, crossed: float = 20, share: float = 0.1) -> DataFrame:
    """A life for each way to play, by their figures ``positions, span, nodes, tortuosity, kills, high_share, bow_share, builder_share, enemy_min, home_mean, touched``.

    The one nearest to an enemy objective; the one nearest to its own all along that never
    touched one; the most winding and far one; the longest way; the most kills; the most
    time up high, with a bow, with building blocks. The first four may be one life (but the
    defender is not the attacker), the others are lives that no earlier one took.
    """
    c = F.col
    enough = c("positions") >= positions
    return best_by(lives, {
        "deep_attacker": (c("enemy_min").isNotNull(), -c("enemy_min")),
        "defender": (c("home_mean").isNotNull() & ~c("touched") & enough, -c("home_mean"), ["deep_attacker"]),
        "roamer": ((c("span") >= roamed) & (c("nodes") >= nodes), c("tortuosity") * F.log1p("nodes"), []),
        "traversal": (F.lit(True), c("span"), []),
        "high_killer": (c("positions") >= few, c("kills")),
        "skybridge": (enough & (c("span") >= crossed), c("high_share")),
        "bow_archer": (enough & (c("bow_share") > share), c("bow_share")),
        "builder": (enough & (c("builder_share") > share), c("builder_share")),
    }, key)


def defence_representatives(lives: DataFrame, key: str, positions: int = 8, near: float = 60) -> DataFrame:
    """The life that dug lowest near its objective and, of the others, the one that held traps most: ``positions, wool_distance, min_y_near, trap_share``."""
    pool = (F.col("positions") >= positions) & (F.col("wool_distance") < near)
    return best_by(lives, {"early_digger": (pool & F.col("min_y_near").isNotNull(), -F.col("min_y_near")), "early_builder": (pool & (F.col("trap_share") > 0), F.col("trap_share"))}, key)


def defence_overview(samples: DataFrame, keys: list[str], pit: float = 30, wall: float = 15, low: int = 5) -> DataFrame:
    """``keys, positions, players, lowest_near, wall_height, perimeter`` and the samples of each kind of defence work.

    ``samples``: keys, ``player_id, y, wool_distance, activity`` (dig, wall, trap, gate,
    guard or other). ``lowest_near``: the least height below ``low`` within ``pit`` of the
    objective; ``wall_height``: the greatest of walls, traps and gates within ``wall``;
    ``perimeter``: the farthest defence work, in whole blocks; null without any.
    """
    c = F.col
    built, work = c("activity").isin("wall", "trap", "gate"), c("activity").isin("dig", "wall", "trap", "gate")
    n = lambda *kinds: F.count_if(c("activity").isin(*kinds))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.count_distinct("player_id").alias("players"), F.min(F.when((c("wool_distance") < pit) & (c("y") < low), c("y"))).alias("lowest_near"), F.max(F.when(built & (c("wool_distance") < wall), c("y"))).alias("wall_height"),
        F.max(F.when(work, F.floor("wool_distance"))).cast("int").alias("perimeter"), n("dig").alias("digs"), n("trap", "gate").alias("traps"), n("guard").alias("guards"), n("wall").alias("walls"), n("other").alias("others"),
    )


def diverse(rows: DataFrame, keys: list[str], value: str, tie: str, n: int = 5) -> DataFrame:
    """Up to n examples of each key: the two best by ``value`` and evenly spaced ranks after them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie))
    count = F.count("*").over(Window.partitionBy(*keys))
    marked = rows.withColumn("rank", rank).withColumn("of", count)
    step = (F.col("of") - 2) / (n - 2)
    wanted = F.array(F.lit(1), F.lit(2), *((F.lit(2) + F.floor(step * k)).cast("int") for k in range(1, n - 1)))
    return marked.where((F.col("of") <= n) | F.array_contains(wanted, F.col("rank"))).drop("of")


def histogram(rows: DataFrame, value: str, keys: list[str], bins: int = 25) -> DataFrame:
    """Rows by equal bins of ``value`` between its least and greatest over all keys; the last bin is closed."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def resampled(points: DataFrame, key: list[str], n: int = 14, last: float = 80.0, least: float = 20.0) -> DataFrame:
    """n points evenly along the last ``last`` blocks of each path: the last point before each arc length (the first at the start).

    ``points``: key, ``idx, x, z``. Paths need four points and an arc of ``least``.
    """
    order = Window.partitionBy(*key).orderBy("idx")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("z") - F.lag("z").over(order)), F.lit(0.0))
    rows = points.withColumn("step", step).withColumn("arc", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*key).agg(F.max("arc").alias("total"), F.count("*").alias("points")).where((F.col("points") >= 4) & (F.col("total") >= least))
    start = F.greatest(F.lit(0.0), F.col("total") - last)
    targets = ends.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("target", F.col("start") + (F.col("total") - F.col("start")) * F.col("k") / (n - 1))
    met = targets.join(rows.select(*key, "idx", "arc", "x", "z"), key).where((F.col("arc") < F.col("target")) | (F.col("arc") == 0))
    return met.groupBy(*key, "k").agg(F.max_by(F.struct("x", "z"), "idx").alias("p")).select(*key, "k", "p.x", "p.z")


def largest_gap(points: DataFrame, key: list[str], least: float = 0.2) -> DataFrame:
    """Where projected points split best: the widest gap along their main axis that leaves ``least`` of them on each side."""
    mid = points.groupBy(*key).agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"), (0.5 * F.atan2(2 * F.covar_pop("x", "z"), F.var_pop("x") - F.var_pop("z"))).alias("turn"), F.count("*").alias("n"))
    placed = points.join(mid, key).withColumn("at", F.round((F.col("x") - F.col("mx")) * F.cos("turn") + (F.col("z") - F.col("mz")) * F.sin("turn"), 9))
    order = Window.partitionBy(*key).orderBy("at", "idx")
    gaps = placed.withColumn("gap", F.round(F.col("at") - F.lag("at").over(order), 6)).withColumn("below", F.row_number().over(order) - 1)
    fit = gaps.where((F.col("below") >= least * F.col("n")) & (F.col("below") <= (1 - least) * F.col("n")) & F.col("gap").isNotNull())
    return fit.groupBy(*key).agg(F.max_by(F.struct("gap", "below"), F.struct("gap", -F.col("below"))).alias("b")).select(*key, "b.gap", "b.below")


def approaches(touches: DataFrame, positions: DataFrame, radius: float = 30.0, back: int = 40) -> DataFrame:
    """Per touch, the samples of its player from the last one outside ``radius`` on, at most ``back`` of them.

    Samples are numbered by player, so a touch names the numbers of its last ``back`` ones
    and meets no others.

    ``touches``: ``touch_id, match_id, player_id, t, x, z``; ``positions``: ``match_id,
    player_id, row_id, t, x, z``.
    """
    w = touches.select("touch_id", "match_id", "player_id", F.col("t").alias("touch_t"), F.col("x").alias("wx"), F.col("z").alias("wz"))
    own = Window.partitionBy(*PLAYER).orderBy("t", "row_id")
    numbered = positions.withColumn("nth", F.row_number().over(own))
    seen = numbered.select(*PLAYER, "t", F.col("nth"), F.lit(None).cast("long").alias("touch_id")).unionByName(touches.select(*PLAYER, "t", F.lit(None).cast("int").alias("nth"), F.col("touch_id").cast("long").alias("touch_id")))
    upto = F.max("nth").over(Window.partitionBy(*PLAYER).orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    last = seen.withColumn("upto", upto).where("touch_id is not null and upto is not null").select("touch_id", F.explode(F.sequence(F.greatest(F.lit(1), F.col("upto") - back + 1), F.col("upto"))).alias("nth"))
    rows = w.join(last, "touch_id").join(numbered, [*PLAYER, "nth"]).drop("nth")
    rows = rows.withColumn("age", F.row_number().over(Window.partitionBy("touch_id").orderBy(F.desc("t"), F.desc("row_id")))).where(F.col("age") <= back)
    outside = F.when(F.hypot(F.col("x") - F.col("wx"), F.col("z") - F.col("wz")) > radius, F.col("age"))
    rows = rows.withColumn("crossed", F.min(outside).over(Window.partitionBy("touch_id")))
    return rows.where(F.col("age") <= F.col("crossed")).select("touch_id", "match_id", "player_id", "row_id", "t", "x", "z", "age")


def region_audit(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Points by the rectangles that hold them: none, one, several with one box, several."""
    from matchspark.operators.spatial import held_by

    held = held_by(points.select("map_id", "point_id", "x", "z"), regions)
    per = held.groupBy("map_id", "point_id").agg(F.count("*").alias("n"), F.count_distinct("min_x", "max_x", "min_z", "max_z").alias("boxes"))
    rows = points.select("map_id", "point_id").join(per, ["map_id", "point_id"], "left")
    kind = F.when(F.col("n").isNull(), "zero").when(F.col("n") == 1, "one").when(F.col("boxes") == 1, "one_bbox").otherwise("multiple")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("points"))


def leaf_regions(tree: DataFrame, roots: DataFrame, rounds: int = 20) -> DataFrame:
    """Leaves below each root of a region tree ``region_id, child_id`` (a reference is a child); trees deeper than ``rounds`` raise."""
    from matchspark.session import cut

    children = tree.select(F.col("region_id").alias("at"), "child_id").where("child_id is not null")
    front, leaves = cut(roots.select(F.col("region_id").alias("root"), F.col("region_id").alias("at")).distinct()), None
    for _ in range(rounds):
        last = front.join(children.select("at").distinct(), "at", "left_anti")
        leaves = last if leaves is None else leaves.unionByName(last)
        front = cut(front.join(children, "at").select("root", F.col("child_id").alias("at")).distinct())
        if front.isEmpty():
            return leaves.select("root", F.col("at").alias("leaf")).distinct()
    raise RuntimeError(f"the region tree is deeper than {rounds}")


def ratios(lives: DataFrame) -> DataFrame:
    """Kills a minute, share of touches and captures among all acts, and samples a minute of each life."""
    minutes = F.when(F.col("duration") > 0, F.col("duration") / 60)
    acts = F.col("kill_count") + F.col("wool_touches") + F.col("wool_captures")
    return lives.select(*LIFE, (F.col("kill_count") / minutes).alias("kill_rate"), F.when(acts > 0, (F.col("wool_touches") + F.col("wool_captures")) / acts).alias("objective_share"), (F.col("position_count") / minutes).alias("mobility_rate"))


def corridor_use(visits: DataFrame) -> DataFrame:
    """Per life: distinct corridors (pairs of bridge nodes), entropy of their use in bits and the share of the commonest."""
    pairs = visits.where("location_type = 'build_region' and bridge_node_1 is not null and bridge_node_2 is not null")
    counts = pairs.groupBy(*LIFE, F.least("bridge_node_1", "bridge_node_2").alias("a"), F.greatest("bridge_node_1", "bridge_node_2").alias("b")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*LIFE))
    return counts.withColumn("p", share).groupBy(*LIFE).agg(F.count("*").alias("corridors"), F.abs(F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.max("p").alias("dominant_share"))


def pushes(touches: DataFrame, bucket: int = 60, least: int = 2) -> DataFrame:
    """Players at each objective in each bucket of time, and whether enough of them push together."""
    rows = touches.groupBy("match_id", "wool_id", F.floor(F.col("t") / bucket).cast("int").alias("bucket")).agg(F.count_distinct("player_id").alias("pushers"))
    return rows.withColumn("coordinated", F.col("pushers") >= least)


def push_pull(series: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of attack depth with the deaths of the same bucket, of keys with three buckets or more."""
    return series.groupBy(*keys).agg(F.count("*").alias("buckets"), F.corr("mean_depth", "deaths").alias("score")).where("buckets >= 3")


def rolling_median(samples: DataFrame, keys: list[str], back: int = 300) -> DataFrame:
    """Median height over the last ``back`` seconds at each second with samples."""
    frame = Window.partitionBy(*keys).orderBy("t").rangeBetween(-back, 0)
    return samples.withColumn("median_y", F.percentile("y", 0.5).over(frame)).groupBy(*keys, "t").agg(F.max("median_y").alias("median_y"))


def activation(samples: DataFrame, high: int = 22, ticks: int = 3) -> DataFrame:
    """First second of each life from which ``ticks`` samples in a row are at ``high`` or above."""
    order = Window.partitionBy(*LIFE).orderBy("t", "row_id")
    ahead = F.sum((F.col("y") >= high).cast("int")).over(order.rowsBetween(0, ticks - 1))
    return samples.withColumn("ahead", ahead).where(F.col("ahead") == ticks).groupBy(*LIFE).agg(F.min("t").alias("activated"))


def floors_of_cells(samples: DataFrame, keys: list[str], side: int = 2, gap: int = 3) -> DataFrame:
    """Floors of each cell of ``side`` blocks: its heights split where they lie more than ``gap`` apart."""
    cell = [(F.floor(F.col(c) / side) * side).cast("int").alias(f"c{c}") for c in ("x", "z")]
    ys = samples.select(*keys, *cell, "y").distinct()
    order = Window.partitionBy(*keys, "cx", "cz").orderBy("y")
    numbered = ys.withColumn("new", F.coalesce((F.col("y") - F.lag("y").over(order) > gap).cast("int"), F.lit(0))).withColumn("floor", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "cx", "cz", "floor").agg(F.min("y").alias("low"), F.max("y").alias("high"))


def multi_touch(waves: DataFrame) -> DataFrame:
    """Outcomes of waves by their carriers: one or several."""
    return waves.groupBy(F.when(F.col("n_carriers") > 1, "several").otherwise("one").alias("carriers"), "outcome").agg(F.count("*").alias("waves"), F.avg("duration_s").alias("mean_duration"))


def sky_lives(samples: DataFrame, high: int = 40, least: int = 2) -> DataFrame:
    """Lives with ``least`` samples at ``high`` or above, those samples and all."""
    return samples.groupBy(*LIFE).agg(F.count_if(F.col("y") >= high).alias("high_samples"), F.count("*").alias("samples")).where(F.col("high_samples") >= least)


def life_clusters(features: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """Clusters of lives: nulls become the median, columns are standardised, two principal components, k-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler

    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=2, inputCol="scaled", outputCol="axes"), KMeans(k=k, seed=seed, featuresCol="axes", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(features).transform(features).select(*LIFE, "cluster")
