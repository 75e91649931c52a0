"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined on the map side) and an equi-join on the node,
so no adjacency list is ever gathered in one place; a hub is one hot join key, which
adaptive skew handling splits. Rounds grow with the logarithm of the longest path. Once
the links are few, which is counted each round, one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from matchspark.session import cut


def _star(edges: DataFrame, keys: list[str], large: bool) -> DataFrame:
    """One step over edges (keys, u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(*keys, F.col("__v").alias("__u"), F.col("__u").alias("__v")))
        lowest = both.groupBy(*keys, "__u").agg(F.least(F.min("__v"), F.first("__u")).alias("__low"))
        moved = both.where("__v > __u").join(lowest, [*keys, "__u"]).select(*keys, F.col("__v").alias("__u"), F.col("__low").alias("__v"))
        return moved.where("__u > __v").distinct()
    lowest = edges.groupBy(*keys, "__u").agg(F.min("__v").alias("__low"))
    moved = edges.join(lowest, [*keys, "__u"]).select(*keys, F.col("__v").alias("__u"), F.col("__low").alias("__v"))
    own = lowest.select(*keys, "__u", F.col("__low").alias("__v"))
    return moved.where("__u > __v").unionByName(own).distinct()


def _state(edges: DataFrame, keys: list[str]) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "__u", "__v").cast("decimal(38,0)"))).first()
    return tuple(row)


#: Links up to this number are finished in one task.
SMALL = 100_000


def _finished(n_keys: int):
    """A mapInArrow function over all links (keys, u, v): each node with the least node that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[tuple, tuple] = {}
        kept: dict[tuple, object] = {}
        schema = None

        def find(x: tuple) -> tuple:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for *key, u, v in zip(*columns, strict=True):
                ends = []
                for node in (u, v):
                    name = (*key, tuple(node.values()) if isinstance(node, dict) else node)
                    if name not in root:
                        root[name], kept[name] = name, node
                    ends.append(find(name))
                root[max(ends)] = min(ends)
        if root:
            rows = [(*x[:n_keys], kept[x], kept[find(x)]) for x in root]
            types = [*(schema.field(i).type for i in range(n_keys)), schema.field(n_keys).type, schema.field(n_keys).type]
            names = [*(schema.field(i).name for i in range(n_keys)), "node", "component"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def connected_components(edges: DataFrame, keys: list[str] | None = None, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """Label the nodes of an undirected graph with the smallest node they reach.

    ``edges`` has columns ``src``, ``dst`` and, for many graphs at once, the columns
    ``keys``. Rows with a null end and loops add no link. Returns ``keys, node,
    component`` for every node that has a link to another node; no rows for no links.
    """
    keys = keys or []
    links = (
        edges.where("src is not null and dst is not null and src <> dst")
        .select(*keys, F.greatest("src", "dst").alias("__u"), F.least("src", "dst").alias("__v"))
        .distinct()
    )
    links = cut(links)
    before = _state(links, keys)
    if before[0]:
        for _ in range(max_rounds):
            if before[0] <= small:
                fields = {f.name: f.dataType for f in links.schema}
                out = StructType([*(StructField(k, fields[k]) for k in keys), StructField("node", fields["__u"]), StructField("component", fields["__u"])])
                return links.select(*keys, "__u", "__v").coalesce(1).mapInArrow(_finished(len(keys)), out)
            links = cut(_star(_star(links, keys, True), keys, False))
            after = _state(links, keys)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(*keys, F.col("__u").alias("node"), F.col("__v").alias("component"))
    roots = links.select(*keys, F.col("__v").alias("node"), F.col("__v").alias("component")).distinct()
    return members.unionByName(roots)
