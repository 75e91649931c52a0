"""Exact top-k by inner product over a pivot-distance index.

With one more coordinate ``sqrt(M - |x|^2)`` (0 for a query; M: the largest squared norm)
the highest inner product is the least distance. Vectors are keyed by nearest pivot and
their distance to it: each pivot's vectors form ``RINGS`` annuli, and each annulus knows
the least and the greatest distance of its vectors to every pivot. By the triangle
inequality these give a lower bound of a query's distance to anything in the annulus.

A query expands its annuli in the order of that bound, ``GROWTH`` times as many in each
wave, and keeps its k best so far; a wave leaves out every annulus whose bound exceeds
the distance of the k-th best. The annuli are a fixed number, so their table is small at
any size; their vectors lie in blocks of at most ``BLOCK`` that many tasks search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.session import cut

#: Rows of the bounded sample that pivots and rings are chosen from; pivots; annuli of a pivot.
SAMPLE, PIVOTS, RINGS = 1024, 16, 4
#: Vectors in a block, queries in a pack, growth of the opened annuli, blocks that one join key holds.
BLOCK, QUERIES, GROWTH, LANE = 2048, 256, 4, 16
#: Beyond this squared norm scores are summed in integers, as floats are no longer exact; beyond the other they do not fit.
EXACT, FITS = 2.0**52, 2.0**62


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component.

    Rows that are null or hold null or non-finite components take no part, nor do those
    whose squared norm does not fit a score.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") * scale) * (x.cast("double") * scale))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).where(norm < FITS / 4)
    return rows.select("vec_id", whole.alias("v"))


def lifted(v: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, most - (v.astype(float) ** 2).sum(axis=1)))
    return np.column_stack([v.astype(float), extra])


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each is the point that lies farthest from those before it."""
    chosen, far = [0], gaps(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, gaps(points, points[chosen[-1] :][:1])[:, 0])
    return points[chosen]


def bounds(near: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible distance of each query (rows of ``near``: to the pivots) to each annulus (rows of ``low`` and ``high``)."""
    return np.maximum(0, np.maximum(low[None] - near[:, None], near[:, None] - high[None])).max(axis=2)


def reach(q: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """The distance at which a vector scores ``score``, with room for rounding."""
    return np.sqrt(np.maximum(0, (q.astype(float) ** 2).sum(axis=1) + most - 2 * score)) * (1 + 1e-9) + 1e-6 * np.sqrt(most) + 1e-3


def best_of(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query; ties to the smaller vec_id."""
    return rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def packed(columns: list[str], size: int):
    """A mapInPandas function that joins up to ``size`` following rows of one cell into one row; bytes are joined."""

    def run(batches):
        for b in batches:
            for cell, rows in b.groupby("cell", sort=False):
                for i in range(0, len(rows), size):
                    part = rows.iloc[i : i + size]
                    yield pd.DataFrame([{"cell": cell, **{c: b"".join(part[c]) if part[c].dtype == object else part[c].to_numpy("<i8").tobytes() for c in columns}}])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose vec_id is divisible by ``every``.

    Candidates are all rows but those with the query's own vec_id; ties go to the smaller
    vec_id; rows that repeat a vec_id are candidates each, and the least of their vectors
    (component by component) asks. Only vectors of the commonest
    length take part (the greater of equally common ones), so that scores are defined. An
    empty table gives no rows.
    """
    rows = integers(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None or lengths["n"] == 0:
        return rows.where("false").selectExpr("vec_id as query_id", "1 as rank", "vec_id", "vec_id as score")
    width = lengths["n"]
    rows = cut(rows.where(F.size("v") == width))
    most = float(rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0])
    sample = lifted(np.stack(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"]), most)
    pivots = spread(sample, PIVOTS)
    apart = gaps(sample, pivots)
    own = apart.argmin(axis=1)
    rings = np.array([np.quantile(apart[own == p, p], np.linspace(0, 1, RINGS + 1)[1:-1]) if (own == p).any() else np.zeros(RINGS - 1) for p in range(len(pivots))])

    def keyed(batches):
        for b in batches:
            if len(b):
                v = np.stack(b["v"])
                d = gaps(lifted(v, most), pivots)
                at = d.argmin(axis=1)
                far = d[np.arange(len(v)), at]
                cell = at * RINGS + (far[:, None] > rings[at]).sum(axis=1)
                yield pd.DataFrame({"cell": cell, "far": far, "ids": b["vec_id"].to_numpy(), "m": [x.tobytes() for x in v.astype("<i4")], "d": list(d)})

    index = cut(rows.mapInPandas(keyed, "cell int, far double, ids long, m binary, d array<double>"))
    spans = index.select("cell", F.posexplode("d").alias("p", "d")).groupBy("cell", "p").agg(F.min("d").alias("low"), F.max("d").alias("high")).toPandas()
    cells = np.sort(spans["cell"].unique())
    low, high = (spans.pivot(index="cell", columns="p", values=c).loc[cells].to_numpy() for c in ("low", "high"))

    blocks = index.select("cell", "far", "ids", "m").repartitionByRange("cell", "far", "ids").sortWithinPartitions("cell", "far", "ids")
    blocks = cut(blocks.mapInPandas(packed(["ids", "m"], BLOCK), "cell int, ids binary, m binary").withColumn("lane", F.monotonically_increasing_id()))
    lanes = max(1, -(-blocks.count() // (LANE * len(cells))))
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("lane"), F.lit(lanes)).cast("int"))

    def opened(first: int, last: int):
        """The annuli that stand at these places in a query's order, as far as they are within its reach."""

        def run(batches):
            for b in batches:
                if len(b):
                    v = np.stack(b["v"])
                    least = bounds(gaps(lifted(v, most, True), pivots), low, high)
                    within = reach(v, most, b["least"].fillna(-np.inf).to_numpy(float)) if b["least"].notna().any() else np.full(len(v), np.inf)
                    order = np.argsort(least, axis=1, kind="stable")[:, first:last]
                    hit = np.take_along_axis(least, order, axis=1) <= within[:, None]
                    at, n = np.nonzero(hit)
                    raw, ids = [x.tobytes() for x in v.astype("<i4")], b["query_id"].to_numpy()
                    known = b["least"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
                    yield pd.DataFrame({"cell": cells[order[at, n]], "qids": ids[at], "q": [raw[i] for i in at], "least": known[at]})

        return run

    def search(batches):
        held, count = [], 0
        for b in batches:
            for r in b.itertuples():
                q, m = np.frombuffer(r.q, "<i4").reshape(-1, width), np.frombuffer(r.m, "<i4").reshape(-1, width)
                ids, qids, least = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.qids, "<i8"), np.frombuffer(r.least, "<i8")
                score = (q.astype(float) @ m.T.astype(float)).astype(np.int64) if most < EXACT else q.astype(np.int64) @ m.T.astype(np.int64)
                fit = (score >= least[:, None]) & (qids[:, None] != ids)
                at, n = np.nonzero(fit)
                held.append(best_of(pd.DataFrame({"query_id": qids[at], "vec_id": ids[n], "score": score[at, n]}), k))
                count += len(held[-1])
                if count > 100_000:
                    held = [best_of(pd.concat(held), k)]
                    if len(held[0]) > 50_000:
                        yield held.pop()
                    count = sum(map(len, held))
        if held:
            yield best_of(pd.concat(held), k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    found, first, last = None, 0, GROWTH
    while first < len(cells):
        least = queries.withColumn("least", F.lit(None).cast("long")) if found is None else queries.join(found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left")
        asked = least.mapInPandas(opened(first, last), "cell int, qids long, q binary, least long")
        packs = asked.repartition("cell", F.pmod("qids", F.lit(QUERIES))).sortWithinPartitions("cell").mapInPandas(packed(["qids", "q", "least"], QUERIES), "cell int, qids binary, q binary, least binary")
        met = blocks.join(packs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))), ["cell", "lane"])
        new = met.mapInPandas(search, "query_id long, vec_id long, score long")
        both = new if found is None else found.select("query_id", "vec_id", "score").unionByName(new)
        found = cut(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        first, last = last, last * GROWTH
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 5"""
