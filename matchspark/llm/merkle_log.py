"""Merkle manifest of a table: nodes in postorder append logs, proofs addressed by closed-form positions.

Every language has a tree of its own over its leaves, and the roots of the languages are
the leaves of one more tree. A node is the hash of up to ``ARITY`` consecutive nodes of the
level below, so a tree's levels end where one node is left. ``SPAN`` consecutive nodes of a
level are the input of one builder, which is aligned: its first node's number is a multiple
of ``SPAN``. A builder appends nodes to its log in the order in which they are complete, its
input among them, for ``DEPTH`` levels or as many as the tree has. The roots of builders are
the input of the next round of builders, so a tree of n leaves takes log(n) / log(SPAN) rounds.

Where a node stands in a log follows from the sizes of subtrees alone (``position``), so the
siblings of any node are read at computed places and no pointers are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.session import cut

ARITY, DEPTH = 8, 3
SPAN = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def node_hash(nodes: list[bytes]) -> bytes:
    """The hash over the hex texts of digests."""
    return sha256(b"".join(nodes).hex().encode()).digest()


def position(level: int, index: int, leaves: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of a tree of ``leaves`` leaves.

    It follows its last leaf, every node that was complete before that leaf, and the
    ``level`` nodes between that leaf and itself.
    """
    last = min((index + 1) * ARITY**level, leaves) - 1
    whole, before = last, last
    while whole:
        whole //= ARITY
        before += whole
    return before + level


def width(level: int, leaves: int) -> int:
    """Nodes of a level."""
    return -(-leaves // ARITY**level)


def appended(leaves: list[bytes], levels: int) -> list[bytes]:
    """The log of a tree: each node as soon as the nodes below it are there; after the last leaf all open ones."""
    log, waiting = [], [[] for _ in range(levels)]
    for at, node in enumerate(leaves, 1):
        log.append(node)
        for run in waiting:
            run.append(node)
            if len(run) < ARITY and at < len(leaves):
                break
            node = node_hash(run)
            run.clear()
            log.append(node)
    return log


@lru_cache(maxsize=64)
def addresses(leaves: int, levels: int) -> list[list[list[int]]]:
    """For each level and each run of siblings in it, where they stand in the log."""
    out = []
    for level in range(levels):
        n = width(level, leaves)
        out.append([[position(level, i, leaves) for i in range(first, min(first + ARITY, n))] for first in range(0, n, ARITY)])
    return out


def siblings(log: bytes, leaf: int, leaves: int, levels: int) -> bytes:
    """The path of a leaf to its log's last node: for each level its place in the run, the others' number and digests."""
    path, at = [], leaf
    for runs in addresses(leaves, levels):
        run, place = runs[at // ARITY], at % ARITY
        path.append(bytes((place, len(run) - 1)))
        path += [log[32 * p : 32 * p + 32] for i, p in enumerate(run) if i != place]
        at //= ARITY
    return b"".join(path)


def fold(node: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its path give, and the path's siblings without their places."""
    at, others = 0, []
    while at < len(path):
        place, n = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + 32 * n]
        others.append(run)
        node = sha256((run[: 32 * place] + node + run[32 * place :]).hex().encode()).digest()
        at += 2 + 32 * n
    return node, b"".join(others)


def _digest(docs: DataFrame, fields: tuple[str, ...], text=None):
    """The leaf of a row: its fields, each with its length, or a sign for null."""
    parts = []
    for name in fields:
        value = (text if name == "text" and text is not None else F.col(f"`{name}`")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their number within ``group`` in ``order`` (nulls first) from 0, and ``n``, the group's rows.

    Rows are dealt out by ranges of group, order and, as rows may be equal, arrival; a
    range's rows are counted from its own first, and a window over the ranges of a group (a
    row each) gives what stands before. So a group with most of all rows is in many tasks.
    """
    keys = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    arrived = rows.withColumn("arrived", F.monotonically_increasing_id())
    placed = arrived.repartitionByRange(*keys, "arrived").sortWithinPartitions(*keys, "arrived").drop("arrived")
    placed = cut(placed.withColumn("spot", F.monotonically_increasing_id()))
    part = F.shiftright("spot", 33)
    ranges = placed.groupBy(group, part.alias("part")).agg(F.min("spot").alias("first"), F.count("*").alias("size"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("size").over(of).alias("n"))
    joined = placed.withColumn("part", part).join(ranges, [group, "part"])
    return joined.withColumn("i", F.col("spot") + F.col("shift")).drop("spot", "shift", "part")


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id") -> DataFrame:
    """The leaves of a table: ``tree, i, n, key, leaf, tampered``.

    ``tree`` is the value of ``by`` with a sign before it, so that null comes first and
    differs from the empty text. ``tampered`` is the leaf of a row whose text has its A-Z
    lower-cased; it is null except where 3 divides the CRC-32 of the key's decimal text.
    """
    changed = F.crc32(F.col(order).cast("string").cast("binary")) % 3 == 0
    altered = _digest(docs, fields, F.translate("text", UPPER, LOWER))
    tree = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(order).cast("long").alias("key"), _digest(docs, fields).alias("leaf"), F.when(changed, altered).alias("tampered"))
    return numbered(cut(rows), "tree", ["key", "leaf"])


LOG = "tree string, block long, n long, nodes binary"


def _levels(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = width(1, n), levels + 1
    return min(levels, DEPTH)


def _built(rows: pa.Table) -> pa.Table:
    """A builder: its input nodes in order, and their log."""
    rows = rows.sort_by("i")
    n = rows["n"][0].as_py()
    log = appended(rows["leaf"].to_pylist(), _levels(n))
    return pa.table({"tree": rows["tree"][:1].cast(pa.string()), "block": pa.array([rows["i"][0].as_py() // SPAN], pa.int64()), "n": pa.array([n], pa.int64()), "nodes": pa.array([b"".join(log)], pa.binary())})


def build(leaves: DataFrame) -> list[DataFrame]:
    """The logs of all trees over ``tree, i, n, leaf``, one table a round, written to the shared folder.

    A row is one builder: ``tree, block, n`` (nodes of the round's lowest level in the whole
    tree) and ``nodes``, the digests of its log. At most ``SPAN`` rows meet in a group.
    """
    rounds, nodes = [], leaves.select("tree", "i", "n", "leaf")
    while True:
        log = cut(nodes.groupBy("tree", F.floor(F.col("i") / SPAN).alias("block")).applyInArrow(_built, LOG))
        rounds.append(log)
        more = log.where(F.col("n") > SPAN)
        nodes = more.select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / SPAN).alias("n"), F.substring("nodes", -32, 32).alias("leaf"))
        if more.isEmpty():
            return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree, leaf``: the last node of every tree."""
    ends = [log.where(F.col("n") <= SPAN).select("tree", F.substring("nodes", -32, 32).alias("leaf")) for log in rounds]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def _stepped(batches):
    """Rows of logs with the path above them -> the path of every input node of theirs."""
    for batch in batches:
        for tree, block, n, nodes, above in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = min(SPAN, n - block * SPAN)
            paths = [siblings(nodes, i, own, _levels(n)) + above for i in range(own)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * own, pa.string()), pa.array(range(block * SPAN, block * SPAN + own), pa.int64()), pa.array(paths, pa.binary())], ["tree", "i", "above"])


def with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest round's logs with ``above``, the path from each one's last node to the root of all.

    ``above`` has ``tree, above`` (binary): the path from each tree's root.
    """
    top = lambda log: log.where(F.col("n") <= SPAN).join(above, "tree").select(*log.columns, "above")
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        log = top(rounds[k])
        if paths is not None:
            inner = rounds[k].where(F.col("n") > SPAN).join(paths.withColumnRenamed("i", "block"), ["tree", "block"])
            log = log.unionByName(inner.select(*log.columns))
        if k:
            paths = cut(log.mapInArrow(_stepped, "tree string, i long, above binary"))
    return log


def _proved(root: bytes):
    schema = pa.schema([("tree", pa.string()), ("key", pa.int64()), ("leaf", pa.binary()), ("proof", pa.binary()), ("folded", pa.binary()), ("verified", pa.bool_())])

    def run(rows: pa.Table, logs: pa.Table) -> pa.Table:
        """The leaves of one builder, with its log."""
        n, block, nodes, above = (logs[c][0].as_py() for c in ("n", "block", "nodes", "above"))
        first, levels, out = block * SPAN, _levels(n), []
        own = min(SPAN, n - first)
        for tree, key, i, leaf, tampered in zip(*(rows[c].to_pylist() for c in ("tree", "key", "i", "leaf", "tampered")), strict=True):
            path = siblings(nodes, i - first, own, levels) + above
            folded, others = fold(tampered or leaf, path)
            out.append((tree, key, leaf, sha256(others.hex().encode()).digest(), folded, folded == root))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


@dataclass
class Manifest:
    """Leaves, the logs of all trees by round, the logs of the tree over their roots, and the root of all (None: no rows)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: bytes | None

    def proofs(self) -> DataFrame:
        """``tree, key, leaf, proof, folded, verified`` of every leaf, from the logs.

        ``proof`` is the hash of all siblings from leaf to root, ``folded`` the root that
        the tampered leaf, or else the leaf, gives with them.
        """
        start = self.subroots.select(F.lit("").alias("tree"), F.lit(b"").alias("above")).limit(1)
        ranks = with_paths(self.top, start).mapInArrow(_stepped, "tree string, i long, above binary")
        above = cut(self.subroots.select("tree", "i").join(ranks.select("i", "above"), "i").select("tree", "above"))
        logs = with_paths(self.rounds, above)
        rows = self.leaves.select("tree", F.floor(F.col("i") / SPAN).alias("block"), "key", "i", "leaf", "tampered")
        found = rows.groupBy("tree", "block").cogroup(logs.groupBy("tree", "block")).applyInArrow(_proved(self.root), "tree string, key long, leaf binary, proof binary, folded binary, verified boolean")
        return found


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id") -> Manifest:
    """Build the trees of all rows of ``docs``, one for each value of ``by``, and the tree over their roots.

    Leaves ascend by ``order`` (null first); rows that share it ascend by their digests, so
    equal rows are neighbours and each keeps a place of its own. The driver gets one digest.
    """
    leaves = cut(leaves_of(docs, fields, by, order))
    rounds = build(leaves)
    subroots = numbered(roots(rounds).withColumn("all", F.lit("")), "all", ["tree"])
    subroots = cut(subroots.select("tree", "i", "n", "leaf"))
    top = build(subroots.withColumn("tree", F.lit("")))
    last = roots(top).first()
    return Manifest(leaves, rounds, subroots, top, bytes(last.leaf) if last else None)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: one row for each row of ``docs``.

    Columns doc_id, source, lang, n_chars and text are hashed, null told apart from empty;
    whole texts of any length; other columns are not read and may have any names. Rows
    without doc_id come first in their language and are never tampered with; repeated rows
    keep a leaf each. A null language is a tree of its own, before all others. An empty
    table gives no rows. Texts are read once and stay on the JVM; only digests are shuffled.
    """
    built = manifest(docs)
    text = lambda name: F.lower(F.hex(name))
    subroots = built.subroots.select("tree", F.col("leaf").alias("subroot"))
    rows = built.proofs().join(subroots, "tree")
    root = built.root.hex() if built.root else None
    return rows.select(F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(root).cast("string").alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"), "verified")


def _sql(levels: int = 6) -> str:
    """DuckDB SQL of the same manifest for trees of up to ``8 ** levels`` leaves."""
    fields = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || {c}, '-')" for c in FIELDS)
    changed = fields.replace("CAST(text AS VARCHAR)", "translate(text, 'A', 'a')").replace("|| text,", "|| translate(text, 'A', 'a'),").replace("'A', 'a'", f"'{UPPER}', '{LOWER}'")
    parts = [
        "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS a)",
        f"""docs AS (SELECT doc_id, lang, sha256({fields}) AS leaf, sha256({changed}) AS altered,
 xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c >> 8, a[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, crc)""",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs)",
        "k0 AS (SELECT lang, i, leaf AS h FROM l0)",
    ]
    for k in range(levels):  # a tree of one node keeps it
        parts.append(f"k{k + 1} AS (SELECT lang, i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM k{k}) x GROUP BY lang, i // 8)")
    parts.append(f"t0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h FROM k{levels})")
    for k in range(2):
        parts.append(f"t{k + 1} AS (SELECT i // 8 AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER () AS n FROM t{k}) x GROUP BY i // 8)")
    parts.append("f0 AS (SELECT doc_id, lang, leaf, i, CASE WHEN hit THEN altered ELSE leaf END AS f, '' AS others FROM l0)")
    steps = [(f"k{k}", "r.lang IS NOT DISTINCT FROM f.lang AND ", "PARTITION BY lang") for k in range(levels)] + [(f"t{k}", "", "") for k in range(2)]
    for k, (level, same, by) in enumerate(steps):
        rank = "(SELECT t.i FROM t0 t WHERE t.lang IS NOT DISTINCT FROM f.lang)" if level == "t0" else "f.i"
        parts.append(f"""g{k} AS (SELECT f.*, {rank} AS at FROM f{k} f)""")
        before, after = ("coalesce(string_agg(r.h, '' ORDER BY r.i) FILTER (r.i {x} f.at), '')".replace("{x}", x) for x in "<>")
        parts.append(f"""f{k + 1} AS (SELECT f.doc_id, f.lang, f.leaf, f.at // 8 AS i, CASE WHEN max(r.n) = 1 THEN f.f ELSE sha256({before} || f.f || {after}) END AS f,
 f.others || {before} || {after} AS others FROM g{k} f JOIN (SELECT *, count(*) OVER ({by}) AS n FROM {level}) r ON {same}r.i // 8 = f.at // 8 GROUP BY f.doc_id, f.lang, f.leaf, f.at, f.f, f.others)""")
    last = len(steps)
    return f"WITH {', '.join(parts)} SELECT f.doc_id, f.leaf, s.h AS subroot, r.h AS root, sha256(f.others) AS proof_sha256, f.f AS folded_root, f.f = r.h AS verified FROM f{last} f JOIN t0 s ON s.lang IS NOT DISTINCT FROM f.lang, t2 r"


SQL = _sql()
