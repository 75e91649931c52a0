"""SimHash fingerprints of documents, their likeness, and search within a Hamming radius by permuted block tables.

The terms of a text are its pairs of neighbouring words, each weighted by
``1 + log2(occurrences)``, so that what a text says often counts more without drowning the
rest. The 128-bit hash of a term votes with its weight on every bit, for one or against it;
a bit of the fingerprint is set where the votes for it prevail. Two fingerprints differ in
a share of bits that estimates the angle between the texts' weight vectors, so its cosine
estimates their likeness.

For the search a fingerprint is cut into ``radius + EXTRA`` blocks. A table moves some
``EXTRA`` blocks to the front and is looked up by them; there is a table for every choice.
Two fingerprints within the radius differ in at most ``radius`` blocks, so they agree in the
front blocks of one table at least. The first such table counts the pair; others leave it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations
from math import cos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import small
from matchspark.session import cut

BITS = 128
#: Weights are whole numbers in this part of one, so that sums don't depend on their order.
UNIT = 16
#: Hamming radius of the search and blocks at the front of a table.
RADIUS, EXTRA = 3, 2
#: Fingerprints of one table entry that meet in a task.
LIST = 4096


def terms(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms of a text and their weights."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found = Counter(map(b" ".join, zip(words, words[1:], strict=False)) if len(words) > 1 else words)
    times = np.fromiter(found.values(), np.float64, len(found))
    return list(found), np.rint(UNIT * (1 + np.log2(times))) if len(found) else times


def fingerprint(text: str | None) -> bytes:
    """16 bytes; all zero for no words. Equal texts have equal fingerprints."""
    found, weights = terms(text)
    if not found:
        return bytes(BITS // 8)
    digest, votes = xxhash.xxh3_128_digest, np.zeros(BITS)
    for at in range(0, len(found), 1 << 14):  # sums below 2**24 are exact in 32 bits
        hashes = np.frombuffer(b"".join(map(digest, found[at : at + (1 << 14)])), np.uint8).reshape(-1, BITS // 8)
        some = weights[at : at + (1 << 14)].astype(np.float32)
        votes += some @ np.unpackbits(hashes, axis=1).astype(np.float32)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits stands for; 0 at a right angle or more, 1 for equal ones."""
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, cos(pi * differing / BITS)) if differing < BITS // 2 else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many of the next one's first, or all of those."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: Rows of a range: done ones, and the texts of its first and last row, which rows of other ranges need.
RANGED = pa.schema([*ROW, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _finished(doc_id: int | None, text: str, own: bytes, following: str, after: bytes) -> tuple:
    changed = edited(text, following)
    print_ = fingerprint(changed)
    return (doc_id, len(text), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, print_, likeness(own, print_), likeness(own, after))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text) in order: each with the one after it; the first and last texts stay for other ranges."""
    last = part = None
    none = (None,) * len(ROW)
    for batch in small(batches, 200):
        out = []
        for part, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, own = text or "", fingerprint(text)
            out.append((*_finished(*last, text, own), part, None, None) if last else (*none, part, "first", text))
            last = doc_id, text, own
        if out:
            yield _batch(out, RANGED)
    if last:
        yield _batch([(last[0], *none[1:], part, "last", last[1])], RANGED)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, following): the last row of each range with the first of the next."""
    for batch in small(batches, 50):
        rows = [_finished(i, text, fingerprint(text), after, fingerprint(after)) for i, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _batch(rows, ROW)


def prints(docs: DataFrame) -> DataFrame:
    """The columns of ``ROW`` for each row of ``docs (doc_id, text, ...)``; fingerprints are 16 bytes.

    Rows follow each other by doc_id, null first, and by a hash of the text where it
    repeats; after the last comes the first. They are dealt out by ranges of that order;
    only the first and last text of a range goes to another task, to meet its neighbour's.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), "text")
    rows = cut(ranges.mapInArrow(_walk, from_arrow_schema(RANGED)))
    first, last = (rows.where(F.col("edge") == edge) for edge in ("first", "last"))
    all_ = Window.orderBy("part")  # a row for each range
    after = F.coalesce(F.lead("part").over(all_), F.min("part").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    following = first.select("part").withColumn("after", after)
    ends = last.join(following, "part").join(first.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
    ended = ends.select("doc_id", "text", "following").mapInArrow(_joined, from_arrow_schema(ROW))
    return rows.where("edge is null").select(*ROW.names).unionByName(ended)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Start and length of each block, in bits."""
    edges = [round(i * BITS / (radius + EXTRA)) for i in range(radius + EXTRA + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _posted(rows: DataFrame, radius: int) -> DataFrame:
    """``rows (fp, ...)`` once for each table: ``place`` (number of the table) and ``front``, its leading blocks."""
    bits = F.concat(*(F.lpad(F.conv(F.hex(F.substring("fp", i + 1, 1)), 16, 2), 8, "0") for i in range(BITS // 8)))
    with_bits = rows.withColumn("bits", bits)
    tables = [F.struct(F.lit(n).alias("place"), F.xxhash64(*(F.substring("bits", at + 1, size) for at, size in front)).alias("front")) for n, front in enumerate(combinations(_blocks(radius), EXTRA))]
    return with_bits.select(*rows.columns, F.explode(F.array(*tables)).alias("at")).select(*rows.columns, "at.place", "at.front")


def _counted(radius: int):
    """A function of the fingerprints and the queries of a part of a table entry: how many rows each query has within the radius."""
    blocks = _blocks(radius)
    fronts = list(combinations(range(len(blocks)), EXTRA))
    schema = pa.schema([("fp", pa.binary()), ("found", pa.int64())])

    def bits(column: pa.ChunkedArray) -> np.ndarray:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
        return raw.reshape(-1, BITS // 8)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        own, times, place = bits(rows["fp"]), rows["times"].to_numpy(), asked["place"][0].as_py()
        out = []
        for query in bits(asked["fp"]):
            differing = own ^ query
            near = np.flatnonzero(np.bitwise_count(differing).sum(axis=1) <= radius)
            unpacked = np.unpackbits(differing[near], axis=1)
            same = np.stack([~unpacked[:, a : a + n].any(axis=1) for a, n in blocks], axis=1)
            agreeing = np.stack([same[:, f].all(axis=1) for f in map(list, fronts)], axis=1)
            out.append(int(times[near[agreeing.argmax(axis=1) == place]].sum()))
        return pa.table([asked["fp"].cast(pa.binary()), pa.array(out, pa.int64())], schema=schema)

    return run


def within_radius(index: DataFrame, queries: DataFrame, radius: int = RADIUS, longest: int = LIST) -> DataFrame:
    """``fp, found``: for each distinct fingerprint of ``queries (fp)`` the rows of ``index (fp)`` within ``radius`` bits.

    Equal fingerprints are one entry with a count. Of the tables' entries only those that
    queries ask for are shuffled further; an entry with more than ``longest`` fingerprints
    is dealt out in parts, each of which all its queries meet. Exact: no entry is cut short.
    """
    posted = _posted(index.groupBy("fp").agg(F.count("*").alias("times")), radius)
    asked = _posted(queries.select("fp").distinct(), radius)
    entry = ["place", "front"]
    wanted = cut(posted.join(asked.select(*entry).distinct(), entry, "left_semi"))
    sizes = wanted.groupBy(*entry).agg(F.ceil(F.count("*") / longest).alias("parts"))
    rows = wanted.join(sizes, entry).withColumn("part", F.pmod(F.xxhash64("fp"), "parts")).select("fp", "times", *entry, "part")
    anew = sizes.select(*(F.col(c).alias(f"{c}_") for c in sizes.columns)).toDF(*sizes.columns)  # columns of their own
    asked = asked.join(anew, entry).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("fp", *entry, "part")
    keys = [*entry, "part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_counted(radius), "fp binary, found long")
    return found.groupBy("fp").agg(F.sum("found").alias("found"))


def document_prints(docs: DataFrame, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within``.

    One row for each row of ``docs (doc_id, text, ...)``; fingerprints are 32 hex digits.
    ``n_within``: for rows whose doc_id ``every`` divides, all rows (its own among them)
    whose fingerprint is within ``radius`` bits; null for others. Null texts are empty;
    texts without words have fingerprint zero; of any length they are read whole. Rows
    without doc_id come first; rows that repeat a doc_id follow each other. A single row is
    followed by itself; an empty table gives no rows; other columns are not read.
    """
    rows = cut(prints(docs))
    fps = rows.select("doc_id", F.col("fingerprint").alias("fp"))
    found = within_radius(fps, fps.where(F.col("doc_id") % every == 0), radius)
    asking = F.col("doc_id") % every == 0
    counted = rows.where(asking).join(found.withColumnRenamed("fp", "fingerprint"), "fingerprint", "left").select(*rows.columns, F.col("found").alias("n_within"))
    others = rows.where(~F.coalesce(asking, F.lit(False))).withColumn("n_within", F.lit(None).cast("long"))
    text = lambda c: F.lower(F.hex(c)).alias(c) if c in ("fingerprint", "edited_fingerprint") else F.col(c)
    return counted.unionByName(others).select(*(text(c) for c in counted.columns))
