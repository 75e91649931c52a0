"""Traffic graphs: from the samples of all lives to nodes and edges, one graph a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.components import connected_components
from matchspark.operators.paths import largest_component
from matchspark.operators.trajectories import cell_occupation
from matchspark.session import cut


def line_cells(x0: Column, z0: Column, x1: Column, z1: Column, size: int) -> Column:
    """Cells (structs ``x, z``) of the straight line between two cells, both included, each a grid step further.

    The long axis moves by one cell a step; the short one's offset has a closed form, so
    no loop over rows is needed.
    """
    dx, dz = F.abs((x1 - x0) / size).cast("int"), F.abs((z1 - z0) / size).cast("int")
    sx, sz = F.signum(x1 - x0).cast("int") * size, F.signum(z1 - z0).cast("int") * size
    most, least = F.greatest(dx, dz), F.least(dx, dz)

    def at(i: Column) -> Column:
        minor = F.when(most == 0, 0).otherwise(F.floor((i * least - F.floor(most / 2) + most - 1) / most)).cast("int")
        return F.struct((x0 + sx * F.when(dx >= dz, i).otherwise(minor)).cast("int").alias("x"), (z0 + sz * F.when(dx >= dz, minor).otherwise(i)).cast("int").alias("z"))

    return F.transform(F.sequence(F.lit(0), most), at)


def walked_edges(samples: DataFrame, valid: DataFrame, key: str, size: int, max_gap: int = 30) -> DataFrame:
    """Undirected counts of steps between neighbouring cells: ``key, ax, az, bx, bz, transitions``.

    Samples of a life carry the cell and second before (``life_samples``). Each hop of at
    most ``max_gap`` seconds walks the straight line of cells; a step counts if both its
    cells are ``valid (key, cx, cz)``.
    """
    moved = (F.col("before_cx") != F.col("cx")) | (F.col("before_cz") != F.col("cz"))
    hops = samples.where(F.col("before_cx").isNotNull() & moved & (F.col("t") - F.col("before_t") <= max_gap))
    counted = hops.groupBy(key, "before_cx", "before_cz", "cx", "cz").agg(F.count("*").alias("hops"))  # equal hops walk one line
    cells = counted.withColumn("line", line_cells(F.col("before_cx"), F.col("before_cz"), F.col("cx"), F.col("cz"), size))
    steps = F.zip_with(F.slice("line", 1, F.size("line") - 1), F.slice("line", 2, F.size("line") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    edges = cells.select(key, "hops", F.explode(steps).alias("s")).groupBy(key, F.col("s.a.x").alias("ax"), F.col("s.a.z").alias("az"), F.col("s.b.x").alias("bx"), F.col("s.b.z").alias("bz")).agg(F.sum("hops").alias("transitions"))
    known = valid.select(key, "cx", "cz").distinct()
    for end in "ab":
        edges = edges.join(known.toDF(key, f"{end}x", f"{end}z"), [key, f"{end}x", f"{end}z"], "left_semi")
    return edges


def traffic_graph(samples: DataFrame, key: str, size: int = 5, min_occupation: int = 5, min_transitions: int = 2, max_gap: int = 30) -> tuple[DataFrame, DataFrame]:
    """Nodes ``key, node_id, cx, cz, occupation[, island_id]`` and edges ``key, src, dst, transitions`` of each key's traffic.

    Nodes are cells with enough samples, numbered from 0 by their place; edges have enough
    transitions; only the largest component of a graph stays.
    """
    cells = cell_occupation(samples, [key], size).drop("players")
    edges = walked_edges(samples, cells, key, size, max_gap)
    order = Window.partitionBy(key).orderBy("cx", "cz")
    nodes = cut(cells.where(F.col("occupation") >= min_occupation).withColumn("node_id", (F.row_number().over(order) - 1).cast("long")))
    edges = edges.where(F.col("transitions") >= min_transitions)
    for end, name in (("a", "src"), ("b", "dst")):
        edges = edges.join(nodes.select(key, F.col("cx").alias(f"{end}x"), F.col("cz").alias(f"{end}z"), F.col("node_id").alias(name)), [key, f"{end}x", f"{end}z"])
    edges = cut(edges.select(key, "src", "dst", "transitions"))
    keep = largest_component(nodes.select(key, F.col("node_id").alias("node")), edges, key).select(key, F.col("node").alias("node_id"))
    nodes = nodes.join(keep, [key, "node_id"], "left_semi")
    edges = edges.join(keep.withColumnRenamed("node_id", "src"), [key, "src"], "left_semi").join(keep.withColumnRenamed("node_id", "dst"), [key, "dst"], "left_semi")
    return nodes, edges


def with_anchors(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, key: str, size: int = 5, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """The graph with points of interest ``key, anchor_id, x, z, poi_type``.

    An anchor whose cell has a node marks it. Others become nodes of their own, numbered
    after the last by ``anchor_id`` (one for each cell, the first), with an edge of one
    transition to each of the ``k`` nodes of the traffic nearest to the anchor; ties to the
    lower node. Where there is no traffic they are numbered from 0 and have no edge.
    """
    from matchspark.operators.spatial import nearest_nodes

    cell = lambda c: (F.floor(F.col(c) / size) * size).cast("int")
    a = anchors.withColumn("cx", cell("x")).withColumn("cz", cell("z"))
    a = a.groupBy(key, "cx", "cz").agg(F.min(F.struct("anchor_id", "x", "z", "poi_type")).alias("a")).select(key, "cx", "cz", "a.*")
    marked = nodes.join(a.select(key, "cx", "cz", "poi_type"), [key, "cx", "cz"], "left").withColumn("fixed", F.col("poi_type").isNotNull())
    last = nodes.groupBy(key).agg(F.max("node_id").alias("last"))
    lone = cut(a.join(nodes.select(key, "cx", "cz"), [key, "cx", "cz"], "left_anti").join(last, key, "left").withColumn("last", F.coalesce("last", F.lit(-1))))
    lone = lone.withColumn("node_id", F.col("last") + F.row_number().over(Window.partitionBy(key).orderBy("anchor_id")))
    more = lone.select(key, "node_id", "cx", "cz", F.lit(0).cast("long").alias("occupation"), "poi_type", F.lit(True).alias("fixed"))
    centres = nodes.select(F.col(key).alias("map_id"), "node_id", (F.col("cx") + size / 2).alias("x"), (F.col("cz") + size / 2).alias("z"))
    near = nearest_nodes(lone.select(F.col(key).alias("map_id"), "x", "z"), centres, k).withColumnRenamed("map_id", key).withColumnRenamed("node_id", "near")
    links = lone.select(key, "node_id", "x", "z").join(near, [key, "x", "z"]).select(key, F.least("node_id", "near").alias("src"), F.greatest("node_id", "near").alias("dst"), F.lit(1).cast("long").alias("transitions"))
    return marked.select(*more.columns).unionByName(more), edges.unionByName(links)


def weighted(nodes: DataFrame, edges: DataFrame, key: str, how: str = "shortest", size: int = 5) -> DataFrame:
    """Edges ``key, src, dst, weight``: ``shortest`` length, ``dense`` length squared by the grid, or ``traffic_weighted``, ``traffic_dense`` by transitions."""
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(nodes.select(key, F.col("node_id").alias(end), F.col("cx").alias(f"{end}_x"), F.col("cz").alias(f"{end}_z")), [key, end])
    length = F.hypot(F.col("src_x") - F.col("dst_x"), F.col("src_z") - F.col("dst_z"))
    weight = length * length / size if how in ("dense", "traffic_dense") else length
    weight = weight / F.greatest("transitions", F.lit(1)) if how.startswith("traffic") else weight
    return ends.select(key, "src", "dst", weight.cast("double").alias("weight"))


def topology(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Per key: nodes, edges, total length, marked nodes, parts of the graph."""
    length = weighted(nodes, edges, key).groupBy(key).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("length"))
    counts = nodes.groupBy(key).agg(F.count("*").alias("n_nodes"), F.count_if("fixed").alias("n_fixed"))
    labels = connected_components(edges, [key]).groupBy(key).agg(F.count_distinct("component").alias("linked_parts"), F.count("*").alias("linked"))
    joined = counts.join(length, key, "left").join(labels, key, "left")
    parts = F.coalesce("linked_parts", F.lit(0)) + F.col("n_nodes") - F.coalesce("linked", F.lit(0))
    return joined.select(key, "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("length", F.lit(0.0)).alias("length"), "n_fixed", parts.alias("parts"))


def adjacency(cells: DataFrame, key: str, size: int = 5) -> DataFrame:
    """Links between cells ``key, node_id, cx, cz`` that touch along a side."""
    steps = cells.select(key, F.col("node_id").alias("src"), F.explode(F.array(F.struct((F.col("cx") + size).alias("cx"), F.col("cz").alias("cz")), F.struct(F.col("cx").alias("cx"), (F.col("cz") + size).alias("cz")))).alias("c"))
    return steps.select(key, "src", "c.cx", "c.cz").join(cells.select(key, F.col("node_id").alias("dst"), "cx", "cz"), [key, "cx", "cz"]).select(key, "src", "dst")


def degrees(cells: DataFrame) -> DataFrame:
    """Neighbours (of eight) of each skeleton cell ``map_id, x, z`` and its kind: endpoint 1, junction 3 or more."""
    steps = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z")) for dx in (-1, 0, 1) for dz in (-1, 0, 1) if dx or dz))
    spots = cells.select("map_id", "x", "z").distinct()
    near = spots.select("map_id", F.explode(steps).alias("s")).groupBy("map_id", F.col("s.x").alias("x"), F.col("s.z").alias("z")).agg(F.count("*").alias("degree"))
    rows = spots.join(near, ["map_id", "x", "z"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.withColumn("kind", F.when(F.col("degree") == 1, "endpoint").when(F.col("degree") >= 3, "junction").otherwise("path"))
