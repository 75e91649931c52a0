"""Graph operators over many graphs at once: largest component, shortest distances and paths.

Graphs whose links times sources are at most ``WORK`` are walked whole, each in a task that
holds nothing else; larger ones in rounds of joins over all of them together.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from matchspark.operators.components import connected_components
from matchspark.session import cut


def largest_component(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, node, component, size`` of the nodes in each graph's largest component.

    ``nodes`` has ``key, node``; ``edges`` has ``key, src, dst`` between them. A node
    without links is a component of its own; of equal sizes the smallest label wins.
    """
    labels = connected_components(edges, [key])
    named = nodes.join(labels, [key, "node"], "left").select(key, "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy(key, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(key).agg(F.max_by(F.struct("component", "size"), F.struct("size", -F.col("component"))).alias("best"))
    chosen = best.select(key, "best.component", "best.size")
    return named.join(chosen, [key, "component"]).select(key, "node", "component", "size")


def both_ways(edges: DataFrame, key: str) -> DataFrame:
    return edges.select(key, "src", "dst", "weight").unionByName(edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


#: Links of a graph times sources that one task walks.
WORK = 1_000_000
#: Lengths of ways that differ by no more are equal.
NEAR = 1e-9


def _walk(key: str, by_source: bool):
    """A cogrouped function of the sources and links (both ways) of one graph: what each source, or the nearest, is away from each node."""

    def run(sources: pa.Table, links: pa.Table) -> pa.Table:
        around: dict[object, list[tuple[object, float]]] = {}
        for src, dst, weight in zip(*(links[c].to_pylist() for c in ("src", "dst", "weight")), strict=True):
            around.setdefault(src, []).append((dst, weight))
        starts = dict.fromkeys(sources["node"].to_pylist())
        rows = []
        for some in [[s] for s in starts] if by_source else [list(starts)]:
            known: dict[object, float] = {}
            heap = [(0.0, s) for s in some]
            while heap:
                far, node = heappop(heap)
                if node not in known:
                    known[node] = far
                    for other, weight in around.get(node, ()):
                        if other not in known:
                            heappush(heap, (far + weight, other))
            rows += [(*([some[0]] if by_source else []), node, far) for node, far in known.items()]
        node_type = sources.schema.field("node").type
        cells = list(zip(*rows, strict=True))
        names = [*(["source"] if by_source else []), "node", "distance"]
        columns = [pa.array(c, pa.float64() if n == "distance" else node_type) for n, c in zip(names, cells, strict=True)]
        named = pa.array(sources[key][:1].to_pylist() * len(rows), sources.schema.field(key).type)
        return pa.table([named, *columns], names=[key, *names])

    return run


def _anew(rows: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that both sides of a cogroup may come from one table."""
    return rows.select(*(F.col(c).alias(f"{c}_") for c in rows.columns)).toDF(*rows.columns)


def shortest_distances(sources: DataFrame, edges: DataFrame, key: str, by_source: bool = False, fold: int = 4, max_rounds: int = 10_000, work: int = WORK) -> DataFrame:
    """``key, node, distance`` of every node that a source of its graph reaches; ``by_source`` adds ``source``.

    ``sources`` has ``key, node``; ``edges`` has ``key, src, dst, weight`` (not negative),
    walked both ways. With ``by_source`` each source has distances of its own, else the
    nearest source counts. Graphs without sources give no rows.
    """
    starts = cut(sources.select(key, "node").distinct())
    n_edges, n_starts = edges.groupBy(key).agg(F.count("*").alias("links")), starts.groupBy(key).agg(F.count("*").alias("starts"))
    load = F.coalesce("links", F.lit(0)) * (F.col("starts") if by_source else F.lit(1))
    small = cut(n_starts.join(n_edges, key, "left").select(key, (load <= work).alias("small")))
    here, links = starts.join(small.where("small").select(key), key, "left_semi"), both_ways(edges, key).join(small.where("small").select(key), key, "left_semi")
    fields = {f.name: f.dataType for f in starts.schema}
    names = [key, *(["source"] if by_source else []), "node"]
    schema = StructType([*(StructField(c, fields["node" if c == "source" else c]) for c in names), StructField("distance", DoubleType())])
    walked = here.groupBy(key).cogroup(_anew(links).groupBy(key)).applyInArrow(_walk(key, by_source), schema)
    large = small.where("not small").select(key)
    if large.isEmpty():
        return walked
    return walked.unionByName(distances_in_rounds(starts.join(large, key, "left_semi"), edges.join(large, key, "left_semi"), key, by_source, fold, max_rounds))


def distances_in_rounds(sources: DataFrame, edges: DataFrame, key: str, by_source: bool = False, fold: int = 4, max_rounds: int = 10_000) -> DataFrame:
    """``shortest_distances`` by joins: ``key, node, distance`` of every node that a source of its graph reaches; ``by_source`` adds ``source``.

    ``sources`` has ``key, node``; ``edges`` has ``key, src, dst, weight`` (not negative),
    walked both ways. With ``by_source`` each source has distances of its own, else the
    nearest source counts. A round relaxes only the edges of nodes whose distance fell, for
    all graphs and sources together, and checks them against the reached nodes they touch;
    improvements are kept beside what is known and folded into it every ``fold`` rounds,
    so that a long path does not rewrite all nodes once a hop.
    """
    both = cut(both_ways(edges, key))
    at = [key, "source", "node"] if by_source else [key, "node"]
    start = sources.select(key, *([F.col("node").alias("source")] if by_source else []), "node", F.lit(0.0).alias("distance")).distinct()
    known, recent = cut(start), []
    front = known
    for n in range(1, max_rounds + 1):
        names = [c for c in at if c != "node"]
        reached = front.withColumnRenamed("node", "src").join(both, [key, "src"]).select(*names, F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
        reached = reached.groupBy(*at).agg(F.min("distance").alias("distance"))
        old = known
        for x in recent:
            old = old.unionByName(x)
        old = old.join(reached.select(*at), at, "left_semi").groupBy(*at).agg(F.min("distance").alias("old"))
        front = cut(reached.join(old, at, "left").where("old is null or distance < old").select(*at, "distance"))
        if front.isEmpty():
            break
        recent.append(front)
        if n % fold == 0:
            for x in recent:
                known = known.unionByName(x)
            known, recent = cut(known.groupBy(*at).agg(F.min("distance").alias("distance"))), []
    else:
        raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    for x in recent:
        known = known.unionByName(x)
    return known.groupBy(*at).agg(F.min("distance").alias("distance"))


def _follow(key: str):
    """A cogrouped function of the pairs and the nodes before each node of one graph: the nodes from target back to source."""

    def run(pairs: pa.Table, before: pa.Table) -> pa.Table:
        last = {(s, n): p for s, n, p in zip(*(before[c].to_pylist() for c in ("source", "node", "previous")), strict=True)}
        rows = []
        for source, target in zip(pairs["source"].to_pylist(), pairs["target"].to_pylist(), strict=True):
            node, back = target, 0
            while node is not None:
                rows.append((source, target, back, node))
                node, back = last.get((source, node)), back + 1
        types = [pairs.schema.field("source").type, pairs.schema.field("target").type, pa.int32(), pairs.schema.field("target").type]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)]
        return pa.table([pa.array(pairs[key][:1].to_pylist() * len(rows), pairs.schema.field(key).type), *columns], names=[key, "source", "target", "back", "node"])

    return run


def _ways(key: str):
    """A cogrouped function of the pairs and the links (both ways) of one graph: the nodes from target back to source.

    A source's search ends with the distance of its farthest target, so only nodes up to there are held.
    """

    def run(pairs: pa.Table, links: pa.Table) -> pa.Table:
        around: dict[object, list[tuple[object, float]]] = {}
        for src, dst, weight in zip(*(links[c].to_pylist() for c in ("src", "dst", "weight")), strict=True):
            around.setdefault(src, []).append((dst, weight))
        wanted: dict[object, list] = {}
        for source, target in zip(pairs["source"].to_pylist(), pairs["target"].to_pylist(), strict=True):
            wanted.setdefault(source, []).append(target)
        rows = []
        for source, targets in wanted.items():
            known: dict[object, float] = {}
            heap, left, last = [(0.0, source)], set(targets), 0.0
            while heap and (left or heap[0][0] <= last + NEAR):
                far, node = heappop(heap)
                if node not in known:
                    known[node] = far
                    if node in left:
                        left.remove(node)
                        last = far
                    for other, weight in around.get(node, ()):
                        if other not in known:
                            heappush(heap, (far + weight, other))
            for target in targets:
                node, back = (target if target in known else None), 0
                while node is not None:
                    rows.append((source, target, back, node))
                    fits = (src for src, weight in around.get(node, ()) if src in known and abs(known[src] + weight - known[node]) <= NEAR and (weight > 0 or src < node))
                    node, back = (min(fits, default=None) if node != source else None), back + 1
        types = [pairs.schema.field("source").type, pairs.schema.field("target").type, pa.int32(), pairs.schema.field("target").type]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)]
        return pa.table([pa.array(pairs[key][:1].to_pylist() * len(rows), pairs.schema.field(key).type), *columns], names=[key, "source", "target", "back", "node"])

    return run


def shortest_paths(pairs: DataFrame, edges: DataFrame, key: str, max_rounds: int = 10_000, work: int = WORK) -> DataFrame:
    """``key, source, target, seq, node`` of a shortest path for each pair; ``seq`` 0 is the source.

    ``pairs``: ``key, source, target``. Of equally short ways a path takes, seen from the
    target, the lowest node each time. Pairs without a way give no rows. Graphs whose links
    times pairs are at most ``work`` are searched whole, each in one task, from which only
    the paths come back; for the others distances and steps are tables of their own.
    """
    pairs = cut(pairs.select(key, "source", "target").dropna().distinct())
    edges = cut(edges.select(key, "src", "dst", "weight").join(pairs.select(key).distinct(), key, "left_semi"))
    load = pairs.groupBy(key).agg(F.count("*").alias("pairs")).join(edges.groupBy(key).agg(F.count("*").alias("links")), key, "left")
    small = cut(load.select(key, (F.coalesce("links", F.lit(0)) * F.col("pairs") <= work).alias("small")))
    here, large = small.where("small").select(key), small.where("not small").select(key)
    fields = {f.name: f.dataType for f in pairs.schema}
    schema = StructType([*(StructField(c, fields[c]) for c in (key, "source", "target")), StructField("back", IntegerType()), StructField("node", fields["target"])])
    links = both_ways(edges, key).join(here, key, "left_semi").dropna(subset=["src", "dst"])
    walked = _from_source(cut(pairs.join(here, key, "left_semi").groupBy(key).cogroup(_anew(links).groupBy(key)).applyInArrow(_ways(key), schema)), key)
    if large.isEmpty():
        return walked
    return walked.unionByName(_paths_by_steps(pairs.join(large, key, "left_semi"), edges.join(large, key, "left_semi"), key, max_rounds, work))


def _paths_by_steps(pairs: DataFrame, edges: DataFrame, key: str, max_rounds: int, work: int) -> DataFrame:
    """``shortest_paths`` from tables of all distances and of the node before each node."""
    both = both_ways(edges, key)
    sources = pairs.select(key, F.col("source").alias("node")).distinct()
    far = cut(shortest_distances(sources, edges, key, by_source=True))
    near = far.select(key, "source", F.col("node").alias("src"), F.col("distance").alias("before"))
    steps = near.join(both, [key, "src"]).withColumnRenamed("dst", "node").join(far, [key, "source", "node"])
    steps = steps.where((F.abs(F.col("before") + F.col("weight") - F.col("distance")) <= NEAR) & (F.col("node") != F.col("source")) & ((F.col("weight") > 0) | (F.col("src") < F.col("node"))))
    before = cut(steps.groupBy(key, "source", "node").agg(F.min("src").alias("previous")))
    wanted = cut(pairs.select(key, "source", "target").distinct().join(far.select(key, "source", F.col("node").alias("target")), [key, "source", "target"]))
    load = before.groupBy(key).agg(F.count("*").alias("known")).join(wanted.groupBy(key).agg(F.count("*").alias("pairs")), key, "right")
    small = cut(load.select(key, (F.coalesce("known", F.lit(0)) * F.col("pairs") <= work).alias("small")))
    here, large = small.where("small").select(key), small.where("not small").select(key)
    fields = {f.name: f.dataType for f in wanted.schema}
    schema = StructType([*(StructField(c, fields[c]) for c in (key, "source", "target")), StructField("back", IntegerType()), StructField("node", fields["target"])])
    followed = wanted.join(here, key, "left_semi").groupBy(key).cogroup(_anew(before.join(here, key, "left_semi")).groupBy(key)).applyInArrow(_follow(key), schema)
    if large.isEmpty():
        return _from_source(followed, key)
    front = cut(wanted.join(large, key, "left_semi").select(key, "source", "target", F.lit(0).alias("back"), F.col("target").alias("node")))
    parts = [front]
    for _ in range(max_rounds):
        front = cut(front.join(before, [key, "source", "node"]).select(key, "source", "target", (F.col("back") + 1).alias("back"), F.col("previous").alias("node")))
        if front.isEmpty():
            break
        parts.append(front)
    rows = followed
    for x in parts:
        rows = rows.unionByName(x)
    return _from_source(rows, key)


def _from_source(rows: DataFrame, key: str) -> DataFrame:
    """Steps counted from the target as steps counted from the source."""
    hops = rows.groupBy(key, "source", "target").agg(F.max("back").alias("hops"))
    return rows.join(hops, [key, "source", "target"]).select(key, "source", "target", (F.col("hops") - F.col("back")).alias("seq"), "node")
