"""Traffic graphs over k-means clusters of places, for all maps at once, and comparisons of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.spatial import nearest_nodes
from matchspark.operators.trajectories import grid_floor
from matchspark.session import cut


def first_centres(places: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """``map_id, node_id, x, z``: each map's k first centres, evenly spaced over its places in order of x and z.

    ``places``: ``map_id, x, z, n``. k is the root of a quarter of the map's samples, between
    ``least`` and ``most`` and no more than its places.
    """
    order = Window.partitionBy("map_id").orderBy("x", "z")
    sizes = places.groupBy("map_id").agg(F.sum("n").alias("samples"), F.count("*").alias("places"))
    k = F.least(F.greatest(F.floor(F.sqrt(F.col("samples") / 4)), F.lit(least)), F.lit(most), F.col("places"))
    ranked = places.select("map_id", "x", "z").withColumn("at", F.row_number().over(order) - 1).join(sizes.withColumn("k", k), "map_id")
    slot = F.floor(F.col("at") * F.col("k") / F.col("places"))
    before = F.floor((F.col("at") - 1) * F.col("k") / F.col("places"))
    return ranked.where((F.col("at") == 0) | (slot > before)).select("map_id", slot.cast("long").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))


def lloyd(places: DataFrame, centres: DataFrame, rounds: int = 10) -> DataFrame:
    """``centres`` after ``rounds`` of moving each to the mean of the samples nearest to it; all maps move together.

    A place meets the centres of its own map in grid buckets; ties go to the smaller
    number, and a centre without samples stays where it is.
    """
    centres = cut(centres)
    for _ in range(rounds):
        near = nearest_nodes(places, centres).select("map_id", "x", "z", "node_id")
        mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}")
        moved = places.join(near, ["map_id", "x", "z"]).groupBy("map_id", "node_id").agg(mean("x"), mean("z"))
        centres = cut(centres.join(moved, ["map_id", "node_id"], "left").select("map_id", "node_id", F.coalesce("mx", "x").alias("x"), F.coalesce("mz", "z").alias("z")))
    return centres


def cluster_graph(samples: DataFrame, centres: DataFrame, valid: DataFrame, per: list[str], min_occupation: int = 5, min_transitions: int = 2, max_gap: int = 30, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes ``map_id, node_id, x, z, occupation`` and edges ``map_id, src, dst, transitions`` between the clusters of places.

    ``samples``: ``map_id``, the columns ``per`` of a life, ``t, row_id, x, z``. Edges count
    moves of a life from one cluster to another within ``max_gap`` seconds. Clusters count
    whose centre lies in a ``valid (map_id, cx, cz)`` cell and that have enough samples.
    """
    near = nearest_nodes(samples.select("map_id", "x", "z"), centres).select("map_id", "x", "z", "node_id")
    rows = samples.join(near, ["map_id", "x", "z"])
    held = centres.withColumn("cx", grid_floor("x", size)).withColumn("cz", grid_floor("z", size)).join(valid.select("map_id", "cx", "cz").distinct(), ["map_id", "cx", "cz"], "left_semi")
    counts = rows.groupBy("map_id", "node_id").agg(F.count("*").alias("occupation")).where(F.col("occupation") >= min_occupation)
    nodes = cut(held.select("map_id", "node_id", "x", "z").join(counts, ["map_id", "node_id"]))
    order = Window.partitionBy(*per).orderBy("t", "row_id")
    hops = rows.withColumn("before", F.lag("node_id").over(order)).withColumn("gap", F.col("t") - F.lag("t").over(order)).where((F.col("before") != F.col("node_id")) & (F.col("gap") <= max_gap))
    edges = hops.groupBy("map_id", F.least("before", "node_id").alias("src"), F.greatest("before", "node_id").alias("dst")).agg(F.count("*").alias("transitions")).where(F.col("transitions") >= min_transitions)
    for end in ("src", "dst"):
        edges = edges.join(nodes.select("map_id", F.col("node_id").alias(end)), ["map_id", end], "left_semi")
    return nodes, edges.select("map_id", "src", "dst", "transitions")


def compared(graphs: dict[str, tuple[DataFrame, DataFrame]], key: str = "map_id") -> DataFrame:
    """``strategy, key, nodes, edges, transitions`` of several graphs of each key."""
    parts = []
    for name, (nodes, edges) in graphs.items():
        n = nodes.groupBy(key).agg(F.count("*").alias("nodes"))
        e = edges.groupBy(key).agg(F.count("*").alias("edges"), F.sum("transitions").alias("transitions"))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("edges", "transitions")}
        parts.append(n.join(e, key, "left").withColumns(zero).select(F.lit(name).alias("strategy"), key, "nodes", "edges", "transitions"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
