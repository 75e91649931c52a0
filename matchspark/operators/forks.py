"""Forks: how far the ways from a team's spawn to its two objectives run together, and where they part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.paths import shortest_paths
from matchspark.operators.spatial import nearest_nodes
from matchspark.session import cut


def eligible_halves(spawns: DataFrame, wools: DataFrame, key: str, teams: int = 2, each: int = 2) -> DataFrame:
    """``key, team, wool_id, spawn_x, spawn_z, wool_x, wool_z`` of the keys with two spawning teams and two teams that defend two objectives each.

    ``spawns``: key, ``team, x, z``, averaged by team; ``wools``: key, ``team`` (that
    defends it), ``wool_id, x, z``, one row each.
    """
    places = spawns.groupBy(key, "team").agg(F.avg("x").alias("spawn_x"), F.avg("z").alias("spawn_z"))
    both = places.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == teams).select(key)
    owned = wools.groupBy(key, "team").agg(F.count_distinct("wool_id").alias("n")).groupBy(key).agg(F.count("*").alias("sides"), F.min("n").alias("least"), F.max("n").alias("most"))
    fair = owned.where((F.col("sides") == teams) & (F.col("least") == each) & (F.col("most") == each)).select(key)
    rows = wools.select(key, "team", "wool_id", F.col("x").alias("wool_x"), F.col("z").alias("wool_z"))
    return rows.join(both, key, "left_semi").join(fair, key, "left_semi").join(places, [key, "team"])


def fork_ends(halves: DataFrame, spawn_nodes: DataFrame, wool_nodes: DataFrame, key: str, spawn_within: float = 50, wool_within: float = 20) -> DataFrame:
    """``key, team, rows, spawn, first, second`` of each half: the nodes nearest to its spawn and objectives, within limits.

    ``first`` has the smaller x (then node). ``rows`` counts the half's objectives;
    ``spawn`` is null without a near node, ``first`` and ``second`` unless there are two
    different ones. Nodes: key, ``node, x, z``.
    """
    def nearest(points: DataFrame, nodes: DataFrame, x: str, z: str, within: float, out: str) -> DataFrame:
        named = nodes.select(F.col(key).alias("map_id"), F.col("node").alias("node_id"), "x", "z")
        near = nearest_nodes(points.select(F.col(key).alias("map_id"), F.col(x).alias("x"), F.col(z).alias("z")), named).where(F.col("distance") < within)
        return points.join(near.select(F.col("map_id").alias(key), F.col("x").alias(x), F.col("z").alias(z), F.col("node_id").alias(out)), [key, x, z], "left")

    rows = nearest(nearest(halves, spawn_nodes, "spawn_x", "spawn_z", spawn_within, "spawn"), wool_nodes, "wool_x", "wool_z", wool_within, "wool")
    rows = rows.join(wool_nodes.select(key, F.col("node").alias("wool"), F.col("x").alias("at")), [key, "wool"], "left")
    found = rows.groupBy(key, "team").agg(F.count("*").alias("rows"), F.first("spawn").alias("spawn"), F.array_sort(F.collect_set(F.when(F.col("wool").isNotNull(), F.struct("at", "wool")))).alias("w"))
    two = lambda k: F.when(F.size("w") == 2, F.get("w", F.lit(k))["wool"])
    return found.select(key, "team", "rows", "spawn", two(0).alias("first"), two(1).alias("second"))


def fork_metrics(ends: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Figures of each half with a way to both objectives, for all graphs at once.

    ``key, team, d_first, d_second`` (lengths of the ways), ``e_first, e_second`` (straight
    ones), ``j_first, j_second`` (junctions between the ends), ``angle`` at the spawn in
    degrees, ``offset`` (of the spawn from the line through the objectives), ``d_fork``
    (way to the last common node), ``shared`` (common nodes to those of the longer way)
    and ``asymmetry`` of the lengths. ``nodes``: key, ``node, x, z, junction``.
    """
    ends = cut(ends.where("spawn is not null and first is not null and second is not null").select(key, "team", "spawn", "first", "second"))
    arms = ends.select(key, "team", F.col("spawn").alias("source"), F.explode(F.array(F.struct(F.lit(1).alias("arm"), F.col("first").alias("target")), F.struct(F.lit(2).alias("arm"), F.col("second").alias("target")))).alias("a")).select(key, "team", "source", "a.*")
    steps = shortest_paths(arms.select(key, "source", "target"), edges, key).join(nodes.select(key, "node", "x", "z", "junction"), [key, "node"])
    order = Window.partitionBy(key, "source", "target").orderBy("seq")
    length = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("z") - F.lag("z").over(order)), F.lit(0.0))
    steps = steps.withColumn("length", length).withColumn("way", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    walked = cut(arms.join(steps, [key, "source", "target"]).select(key, "team", "arm", "source", "target", "seq", "node", "x", "z", "way", "junction"))
    inner = F.col("junction") & (F.col("node") != F.col("source")) & (F.col("node") != F.col("target"))
    figures = walked.groupBy(key, "team").pivot("arm", [1, 2]).agg(F.max("way").alias("d"), F.count("node").alias("n"), F.count_if(inner).alias("j"), F.max_by(F.struct("x", "z"), "seq").alias("end"), F.min_by(F.struct("x", "z"), "seq").alias("start")).where("`1_n` > 0 and `2_n` > 0")
    one, two = (walked.where(F.col("arm") == a).select(key, "team", "seq", F.col("node").alias(f"n{a}"), F.col("way").alias(f"w{a}")) for a in (1, 2))
    side = one.join(two, [key, "team", "seq"])
    parts = side.groupBy(key, "team").agg(F.min(F.when(F.col("n1") != F.col("n2"), F.col("seq"))).alias("parted"), F.count("*").alias("both"))
    shared = F.coalesce("parted", "both")
    fork = side.join(parts.withColumn("common", shared), [key, "team"]).where(F.col("seq") == F.col("common") - 1).select(key, "team", "common", F.col("w1").alias("d_fork"))
    rows = figures.join(fork, [key, "team"])
    s, a, b = F.col("1_start"), F.col("1_end"), F.col("2_end")
    ax, az, bx, bz = a["x"] - s["x"], a["z"] - s["z"], b["x"] - s["x"], b["z"] - s["z"]
    tiny = F.lit(1e-9)
    lengths = F.greatest(F.hypot(ax, az), tiny) * F.greatest(F.hypot(bx, bz), tiny)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + az * bz) / lengths))))
    lateral = F.abs((b["x"] - a["x"]) * az - ax * (b["z"] - a["z"])) / F.greatest(F.hypot(b["x"] - a["x"], b["z"] - a["z"]), tiny)
    return rows.select(
        key, "team", F.col("1_d").alias("d_first"), F.col("2_d").alias("d_second"), F.hypot(ax, az).alias("e_first"), F.hypot(bx, bz).alias("e_second"), F.col("1_j").alias("j_first"), F.col("2_j").alias("j_second"),
        angle.alias("angle"), lateral.alias("offset"), "d_fork", (F.col("common") / F.greatest("1_n", "2_n")).alias("shared"), (F.abs(F.col("1_d") - F.col("2_d")) / F.greatest("1_d", "2_d", tiny)).alias("asymmetry"),
    )


def fork_study(ends: DataFrame, metrics: DataFrame, nodes: DataFrame, key: str, each: int = 2) -> DataFrame:
    """``outcome, halves, keys`` of all halves: analysed, or the first reason against it: wrong_count of objectives, no_graph, other."""
    graphs = nodes.select(key).distinct().withColumn("graph", F.lit(True))
    done = metrics.select(key, "team").withColumn("done", F.lit(True))
    rows = ends.join(graphs, key, "left").join(done, [key, "team"], "left")
    outcome = F.when(F.col("done"), "analysed").when(F.col("rows") != each, "wrong_count").when(F.col("graph").isNull(), "no_graph").otherwise("other")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("halves"), F.count_distinct(key).alias("keys"))
