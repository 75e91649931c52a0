"""Near copies by the exact Jaccard similarity of five-word shingles: a byte-position inverted index with count filtering.

A set's fingerprint has positions in proportion to its shingles. A shingle belongs to one
position by its hash, and a position's bytes are the sum of the hashes there. Two sets of n
and m shingles with a similarity of 0.8 or more differ in at most ``(n + m) / 9`` shingles,
so in at most as many positions: unlike the bits of a SimHash, the bytes of this
fingerprint bound what such a pair can differ in. The index posts each distinct set under
the bytes of its first ``n // 4 + 1`` filled positions, in an order that all sets share; so
each such pair meets in a list. There its shared positional bytes are tallied, one byte of
each of ``TALLY`` positions, pairs that differ in too many are left out before they leave
the list, and the rest is verified on whole sets. The order puts positions first that hold
many shingles which a sample does not show to be common; it changes lengths of lists, not
results. Sets near a power of two are posted with the fingerprint of the next size besides.

Lists first name two of their members, the heaviest ones, as partners of all: a set weighs
as many meetings as its positions have in all lists, so that lists of one group of near copies
name the same few members, and those closest to what the copies have in common. Each set is
compared with the heaviest of its partners. Only pairs that are still in different groups
are then compared each with each, long lists in blocks. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import small, unused, words_of
from matchspark.operators.components import connected_components
from matchspark.session import cut

SEED, SHINGLE = 42, 5
#: Sampled texts for the order of shingles, and in how many of them a shingle is common.
SAMPLE, COMMON = 4096, 8
#: Rows of a list that are compared at a time with the whole list.
ROWS = 64
#: Longer lists are cut into blocks when all pairs are compared; each two blocks meet in a task of their own.
LONG = 4096
#: Common shingles that are kept for the order, the commonest first.
KEPT = 1 << 16
#: Rows that go, and pairs to verify, are told to all tasks up to this number, so that no text is shuffled.
FEW = 500_000
#: How the lists choose pairs, round by round.
ROUNDS = ["heaviest", "all"]
#: Sets of so many shingles have counts of hashes by 1024 or 4096 buckets, which bound the shared ones.
FINE = 512
#: Shingles that a position has at most on average, and the least number of positions.
FILL, LEAST = 3, 32
#: Positions whose bytes are tallied in the lists.
TALLY = 128


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one for 1 to 4 words, none for no words."""
    words = [w.lower() for w in words_of(text)]
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b"%b %b %b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], words[3:], words[4:])], np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED)], np.uint64).view(np.int64)[0])


def near(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share ``both`` have a similarity of 0.8 or more."""
    return 9 * both >= 4 * (n + m)


def prefix(hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The hashes of which sets of similarity 0.8 or more share one, in the order of all documents: common shingles last."""
    return np.concatenate([hashes[rare], hashes[~rare]])[: len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def spots(hashes: np.ndarray, positions: int) -> np.ndarray:
    """The position of each hash in fingerprints of so many positions."""
    return (hashes >> np.uint64(40)).astype(np.int64) % positions


def positions_of(n: int) -> int:
    """Positions of the fingerprint of n shingles; of two near sets the larger one decides."""
    return max(LEAST, 1 << (-(-n // FILL) - 1).bit_length())


def marks(hashes: np.ndarray) -> bytes:
    """One byte of each of ``TALLY`` positions: the sum of the hashes there; equal positions have equal bytes."""
    low = (hashes & np.uint64(255)).astype(float)
    return (np.bincount(spots(hashes, TALLY), low, TALLY).astype(np.int64) & 255).astype("u1").tobytes()


def enough(shared: np.ndarray, n: np.ndarray, m: np.ndarray, positions: int = TALLY) -> np.ndarray:
    """Count filter: whether sets of n and m whose fingerprints share so many positional bytes can be near."""
    return 9 * (positions - shared) <= n + m


def posted_bytes(hashes: np.ndarray, positions: int, rare: np.ndarray) -> np.ndarray:
    """The bytes of the filled positions as 64-bit numbers, those with most uncommon shingles first."""
    at = spots(hashes, positions)
    total, uncommon = np.zeros(positions, np.uint64), np.bincount(at, rare, positions)
    np.add.at(total, at, hashes)
    filled = np.unique(at)
    keys = total[filled] + np.array([positions * 0x9E3779B97F4A7C15 % 2**64], np.uint64)  # sizes have lists of their own
    return keys[np.lexsort((keys, -uncommon[filled]))]


def keys_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The lists of a set, as signed numbers: any two near sets have one in common.

    Of near sets each has at most ``n // 4`` positions that the other has not. A set with no
    more filled ones than that is posted under all of them, so it meets those that have
    more; such sets meet each other by their first shingles.
    """
    n, keys = len(hashes), [np.zeros(0, np.uint64)]
    rare = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] != hashes if len(common) else np.ones(n, bool)
    for positions in {positions_of(n), positions_of(5 * n // 4)} if n else ():
        keys.append(posted_bytes(hashes, positions, rare)[: n // 4 + 1])
        if len(keys[-1]) <= n // 4:
            keys.append(prefix(hashes, rare))
    return np.unique(np.concatenate(keys)).view(np.int64)


def fine_counts(hashes: np.ndarray) -> bytes:
    """Hashes by finer buckets, four to a bucket at most on average up to 16,384 hashes; nothing for small sets."""
    if len(hashes) < FINE:
        return b""
    buckets = 1024 if len(hashes) < 4096 else 4096
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets), 255).astype("u1").tobytes()


def fine_bound(x: bytes, y: bytes, n: int, m: int) -> int:
    """``bound`` of two sets by their finer counts; the finer ones of different grain are added up to the coarser grain."""
    if not x or not y:
        return min(n, m)
    a, b = (np.frombuffer(z, "u1") for z in (x, y))
    if (a == 255).any() or (b == 255).any():
        return min(n, m)
    grain = min(len(a), len(b))
    a, b = (z.reshape(-1, grain).sum(axis=0, dtype=np.int64) for z in (a, b))
    return int(np.minimum(a, b).sum())


def _rows(schema: pa.Schema, function):
    """A mapInArrow function that gives the rows that ``function`` returns for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [x for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True) for x in function(*row)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many sampled texts hold."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text").distinct()
    schema = pa.schema([("hash", pa.int64())])
    hashes = some.mapInArrow(_rows(schema, lambda t: [(x,) for x in shingles(t).view(np.int64).tolist()]), "hash long")
    counted = hashes.groupBy("hash").count().where(F.col("count") > COMMON)
    found = counted.orderBy(F.desc("count"), "hash").limit(KEPT).select("hash").toPandas()["hash"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one list (rows of equal first column) at a time, lists of one row left out."""
    open_: list[list[np.ndarray]] = []  # parts of the list that has not ended, joined when it does

    def ended() -> Iterator[list[np.ndarray]]:
        if sum(len(part[0]) for part in open_) > 1:
            yield open_[0] if len(open_) == 1 else [np.concatenate(x) for x in zip(*open_, strict=True)]
        open_.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        if open_ and open_[0][0][0] != key[0]:
            yield from ended()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = int(starts[1]) if len(starts) > 1 else len(key)
        open_.append([c[:first] for c in columns])
        if len(starts) > 1:
            yield from ended()
            ends = starts[2:]
            for s, e in zip(starts[1:-1][ends - starts[1:-1] > 1].tolist(), ends[ends - starts[1:-1] > 1].tolist(), strict=True):
                yield [c[s:e] for c in columns]
            open_.append([c[starts[-1] :] for c in columns])
    yield from ended()


def _batches(parts: Iterator[list[np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of some ten thousand rows from small parts."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def pairs_of(node, n, group, how: str, block=None, bytes_=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one list that are to be verified; ``group`` holds weights in the first round.

    ``block``: pairs of equal blocks are compared elsewhere, but for block -1. ``bytes_``:
    positional bytes of each set, which are tallied.
    """
    block = np.full(len(node), -1) if block is None else block
    rows = np.arange(len(node))

    def tallied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if bytes_ is None or not len(a):
            return a, b
        shared = np.concatenate([(bytes_[a[i : i + 8192]] == bytes_[b[i : i + 8192]]).sum(axis=1) for i in range(0, len(a), 8192)])
        fit = enough(shared, n[a], n[b])
        return a[fit], b[fit]

    if how == "heaviest":
        for first in np.lexsort((node, -group))[:2]:
            fit = rows[(rows != first) & near(np.minimum(n, n[first]), n, n[first])]
            yield tallied(np.full(len(fit), first), fit)
        return
    if (group == group[0]).all():
        return
    for i in range(0, len(node), ROWS):
        some = rows[i : i + ROWS]
        apart = (group[some][:, None] != group) & ((block[some][:, None] != block) | (block == -1))
        a, b = np.nonzero(apart & (some[:, None] < rows) & near(np.minimum(n[some][:, None], n), n[some][:, None], n))
        yield tallied(some[a], b)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SET = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("data", pa.binary())])
#: Bytes of sets that a block of them has on average, and the least number of blocks.
BLOCK, BLOCKS = 1 << 23, 8
LIST = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("size", pa.int64())])


def _kept_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(([*columns, np.full(len(columns[0]), len(columns[0]))] for columns in whole_lists(batches)), LIST)


def _candidates(how: str):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, node, n, group, block, raw in whole_lists(batches):
            bytes_ = np.frombuffer(b"".join(raw), "u1").reshape(-1, TALLY)
            for a, b in pairs_of(node, n.astype(np.int64), group, how, block, bytes_):
                if len(a):
                    yield [node[a], node[b]] if how == "heaviest" else [np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]

    return lambda batches: _batches(parts(batches), PAIR)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, block, node), each with its text's set, as rows of SET."""
    text, packed = None, None
    for batch in small(batches, 100):
        rows = []
        for x, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if packed is None or x != text:
                text, packed = x, shingles(x).astype("<u8").tobytes()
            rows.append((*key, packed))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SET, strict=True)], schema=SET)


def _tested(near_enough):
    """A mapInArrow function over rows (block, node, data, b) by block, data (without b) before pairs: the pairs (node, b) whose data pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in small(batches, 200):
            found = []
            for block, node, data, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    at, known = block, {}
                if b is None:
                    known[node] = data
                elif near_enough(known[node], known[b]):
                    found.append((node, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=PAIR)

    return run


def _alike(x: bytes, y: bytes) -> bool:
    """Whether two packed sets are near."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return bool(near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))


def _maybe_alike(x: bytes, y: bytes) -> bool:
    """Whether two sets can be near by their sizes (8 bytes) and finer counts."""
    n, m = (int.from_bytes(z[:8]) for z in (x, y))
    return bool(near(fine_bound(x[8:], y[8:], n, m), n, m))


def _dealt(pairs: DataFrame, size: int) -> DataFrame:
    """Pairs with the ``block`` of their two ends: nodes are dealt into blocks that have ``BLOCK`` of ``size`` bytes each."""
    blocks = max(BLOCKS, size // BLOCK)
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    return pairs.select((F.least(own("a"), own("b")) * blocks + F.greatest(own("a"), own("b"))).alias("block"), "a", "b")


def _met(dealt: DataFrame, data: DataFrame, near_enough) -> DataFrame:
    """The pairs whose data (``block, node, data``) pass the test."""
    rows = data.withColumn("b", F.lit(None).cast("long")).unionByName(dealt.select("block", F.col("a").alias("node"), F.lit(None).cast("binary").alias("data"), "b"))
    return rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first()).mapInArrow(_tested(near_enough), "a long, b long").distinct()


def _ends(dealt: DataFrame) -> DataFrame:
    return dealt.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs (a, b)`` that can be near by finer counts; ``nodes``: ``node, n, fine``. Pairs with a small set pass."""
    large = nodes.where(F.col("n") >= FINE).select("node", "n", "fine")
    sides = [large.select(F.col("node").alias(c)) for c in ("a", "b")]
    both = cut(pairs.join(sides[0], "a", "left_semi").join(sides[1], "b", "left_semi"))
    rest = pairs.join(both, ["a", "b"], "left_anti")
    size = both.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(large, "node").agg(F.sum(F.length("fine").cast("long"))).first()[0] or 0
    dealt = _dealt(both, size)
    sized = F.concat(F.unhex(F.lpad(F.hex(F.col("n").cast("long")), 16, "0")), F.col("fine"))
    data = _ends(dealt).join(large, "node").select("block", "node", sized.alias("data"))
    return rest.unionByName(_met(dealt, data, _maybe_alike))


def verified(docs: DataFrame, pairs: DataFrame, rows_of: DataFrame, few: int) -> DataFrame:
    """The ``pairs (a, b)`` that are near, from whole texts.

    Sets are dealt into blocks of some ``BLOCK`` bytes, and a pair belongs to the two blocks
    of its ends. A set goes once to each two blocks that have a pair of its own, however
    many pairs these are, so what is shuffled does not grow with the pairs of a group.
    ``rows_of``: ``node, of_row, n``, one row of ``docs`` for each set; of a ``few`` pairs
    their hashes are broadcast, so that only the sets of candidates are shuffled.
    """
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(rows_of, "node"))
    dealt = _dealt(pairs, 8 * (ends.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0))
    asked = _ends(dealt).join(ends.select("node", "of_row"), "node").select("of_row", "block", "node")
    wanted = F.broadcast(asked) if few else asked
    met = docs.select("text", F.xxhash64("doc_id", "text").alias("of_row")).join(wanted, "of_row").select("text", "block", "node")
    return _met(dealt, met.mapInArrow(_asked, "block long, node long, data binary"), _alike)


def _in_blocks(lists: DataFrame, long: int = LONG) -> DataFrame:
    """Lists of more than ``long`` rows as lists of two blocks each, under keys of their own; ``block`` is -1 in whole ones."""
    blocks = F.ceil(F.col("size") / long)
    own = F.pmod(F.xxhash64("node"), blocks)
    other = F.explode(F.when(blocks > 1, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.lit(-1).cast("long"))))
    dealt = lists.withColumn("own", own).withColumn("other", other)
    both = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    block = F.when((F.col("other") == -1) | (F.col("own") == F.col("other")), F.lit(-1)).otherwise(F.col("own"))
    key = F.when(F.col("other") == -1, F.col("key")).otherwise(both)
    return dealt.select(key.alias("key"), "node", "n", "group", block.cast("long").alias("block"), "bytes")


def near_groups(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, component_id``: one row for each row of ``docs (doc_id, text, ...)``.

    Links of a similarity of 0.8 or more join rows to components. A component is named by
    the smallest doc_id in it, or, with ``row`` (a long column that is returned too), by
    one of its shingle sets, so that rows without doc_id have one. Words are lower-cased
    (ASCII); texts of no words are alike; a text of one to four words is one shingle.
    """
    more = [row] if row else []
    common = common_shingles(docs)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in more), ("node", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary()), ("fine", pa.binary()), ("keys", pa.list_(pa.int64())), ("of_row", pa.int64())])

    def sketch(doc_id, text, of_row, *extra):
        hashes = shingles(text)
        return [(doc_id, *extra, name_of(hashes), len(hashes), marks(hashes), fine_counts(hashes), keys_of(hashes, common), of_row)]

    told = "".join(f"{c} long, " for c in more)
    prints = cut(docs.select("doc_id", "text", F.xxhash64("doc_id", "text"), *more).mapInArrow(_rows(schema, sketch), f"doc_id long, {told}node long, n int, bytes binary, fine binary, keys array<long>, of_row long"))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("of_row").alias("of_row"), *(F.first(c).alias(c) for c in ("n", "bytes", "fine", "keys"))))
    posted = nodes.select("node", "n", F.explode("keys").alias("key")).select("key", "node", "n")
    in_order = posted.repartition("key").sortWithinPartitions("key", "node")
    lists = cut(in_order.mapInArrow(_kept_lists, "key long, node long, n int, size long"))
    weights = lists.groupBy("node").agg(F.sum("size").alias("component"))
    least = nodes.select("node", "doc_id", "of_row")
    links, tested, groups = None, None, None
    for how in ROUNDS:
        named = weights if how == "heaviest" else groups
        told = nodes.select("node", "bytes")
        told = told.join(named, "node", "left") if named is not None else told.withColumn("component", F.col("node"))
        named = lists.join(told, "node").select("key", "node", "n", "size", F.coalesce("component", "node").alias("group"), "bytes")
        named = _in_blocks(named) if how == "all" else named.withColumn("block", F.lit(-1).cast("long"))
        named = named.select("key", "node", "n", "group", "block", "bytes")
        fit = named.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates(how), "a long, b long").distinct()
        if how == "heaviest":  # one partner for each set: the heaviest of those that met it
            heavy = weights.select(F.col("node").alias("a"), F.col("component").alias("weight"))
            fit = fit.join(heavy, "a").groupBy("b").agg(F.max_by("a", F.struct("weight", "a")).alias("a")).select("a", "b")
        if tested is not None:
            known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            fit = fit.join(known, ["a", "b"], "left_anti")
        pairs = cut(fit)
        tested = pairs if tested is None else tested.unionByName(pairs)
        left = cut(plausible(pairs, nodes))
        new = cut(verified(docs, left, nodes.select("node", "of_row", "n"), left.count() <= FEW))
        links = new if links is None else links.unionByName(new)
        groups = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    firsts = least.join(groups, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    lowest = firsts.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    if row:
        return prints.select("doc_id", row, "node").join(firsts.select("node", F.col("group").alias("component_id")), "node").select("doc_id", row, "component_id")
    return prints.select("doc_id", "node").join(firsts.select("node", "group"), "node").join(lowest, "group").select("doc_id", "component_id")


def keep_first(docs: DataFrame, few: int = FEW) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    That is the row with the smallest doc_id (rows without one come last), of those the
    one with the smallest hash of its columns; of equal rows one stays. Null and empty
    texts form one group. Other columns stay as they are; an empty table gives no rows.
    Where the rows that go are ``few``, their hashes are broadcast and only rows that
    equal another are shuffled; beyond, one join by hash shuffles all rows.
    """
    id_, text_, row_ = unused(docs, "id", "text", "row")
    groups = near_groups(docs.select("doc_id", "text", row_hash(docs).alias(row_)), row_)
    chosen = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row_)).alias("best"), F.count("*").alias("n"))
    chosen = cut(groups.join(chosen, "component_id").groupBy(row_).agg(F.max(F.col(row_) == F.col(f"best.{row_}")).alias("stays"), F.count("*").alias("times")))
    marked = docs.withColumn(row_, row_hash(docs))
    gone, again = chosen.where("not stays").select(row_), chosen.where("stays and times > 1").select(row_)
    hint = F.broadcast if gone.count() <= few and again.count() <= few else lambda x: x
    left = marked.join(hint(gone), row_, "left_anti")
    once, repeated = left.join(hint(again), row_, "left_anti"), left.join(hint(again), row_, "left_semi").dropDuplicates([row_])
    return once.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; nulls and empty texts differ."""
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(*cells)
