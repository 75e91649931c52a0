"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three
bits share at least ``8 - 3 = 5`` of them, and so three within one half (bytes 0-3 or 4-7):
the index therefore posts each distinct fingerprint under the eight byte triples of its
halves. Every pair that meets in a posting list is counted: its shared positional bytes are
tallied over all eight positions, pairs below five are left out, and only the bits of the
rest are compared. A pair with five shared bytes meets in one list at least. Lists longer
than ``LONG`` are posted again under five bytes each, in other tasks; what is left of such
a list can hold no more than 2**24 fingerprints, and beyond ``LONG`` of them is searched by
bit flips in linear time. A list yields a spanning forest of its links, not all its pairs.
Nodes of the links are the fingerprints themselves, so identifiers may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import per_row
from matchspark.operators.components import connected_components
from matchspark.session import cut

SEED, SHINGLE, BITS = 42, 3, 3
SHARED = 8 - BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Posting lists up to this length are compared within one task, in a matrix.
LONG = 2048


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    counts = np.zeros(64, np.int64)
    table = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(table), 1 << 16):
        counts += np.unpackbits(table[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every whole text; null counts as empty."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, lambda i, t: (i, fingerprint(t))), "doc_id long, fp long")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def tally(fps: np.ndarray) -> np.ndarray:
    """Shared positional bytes of all pairs of a posting list, counted position by position."""
    counted = np.zeros((len(fps), len(fps)), np.uint8)
    for column in fps.astype("<u8").view(np.uint8).reshape(-1, 8).T:
        counted += column[:, None] == column
    return counted


def linked(fps: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes (count filter) and then differ in few bits (verification)."""
    near = tally(fps) >= SHARED
    a, b = np.nonzero(near)
    near[a, b] = popcount(fps[a] ^ fps[b]) <= BITS
    return near


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that span the groups of a posting list."""
    if len(fps) == 2:
        return [(0, 1)] if linked(fps)[0, 1] else []
    if len(fps) > LONG:
        return flips(fps)
    near = linked(fps)
    left, out = np.ones(len(fps), bool), []
    for root in np.flatnonzero(near.sum(axis=1) > 1):
        if left[root]:
            left[root] = False
            front = np.array([root])
            while len(front):
                found = near[front].any(axis=0) & left
                left &= ~found
                front = np.flatnonzero(found)
                out += [(int(root), int(x)) for x in front]
    return out


def flips(fps: np.ndarray) -> list[tuple[int, int]]:
    """The same for a list that shares five bytes: lowest labels through all flips of the others' bits."""
    free = [i for i in range(64) if ((fps ^ fps[0]) >> np.uint64(i) & np.uint64(1)).any()]
    masks = [np.uint64(sum(1 << i for i in some)) for n in range(1, BITS + 1) for some in combinations(free, n)]
    order = np.argsort(fps)
    values, label, moved = fps[order], np.arange(len(fps)), True
    while moved:
        before = label.copy()
        for mask in masks:
            at = np.minimum(np.searchsorted(values, values ^ mask), len(values) - 1)
            hit = values[at] == values ^ mask
            label[hit] = np.minimum(label[hit], label[at[hit]])
        label = label[label]
        moved = not np.array_equal(before, label)
    return [(int(order[x]), int(order[i])) for i, x in enumerate(label.tolist()) if x != i]


def search(refine: bool):
    """A mapInArrow function over rows (key, fp) sorted by key.

    Returns links (one fingerprint, the other), or, if ``refine``, the rows of long lists
    as (null, fingerprint, key), which are to be posted anew.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64())])

    def out(a, b, lists=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a if lists is None else [None] * len(b), b, lists if lists is not None else [None] * len(b))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, spilling = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in chain_last(batches):
            if batch is not None:
                k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                if spilling is not None:
                    n = int(np.searchsorted(k, spilling, side="right"))
                    if n:
                        yield out(None, f[:n], k[:n])
                        k, f = k[n:], f[n:]
                    if len(k):
                        spilling = None
                key, fps = np.concatenate([key, k]), np.concatenate([fps, f])
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            done = len(key) if batch is None else int(starts[-1])
            ends = np.r_[starts[1:], len(key)]
            a, b = [], []
            for s, e in zip(starts, ends, strict=True):
                if e > done or e - s < 2:
                    continue
                if refine and e - s > LONG:
                    yield out(None, fps[s:e], key[s:e])
                else:
                    for x, y in forest(fps[s:e].view(np.uint64)):
                        a.append(int(fps[s + x]))
                        b.append(int(fps[s + y]))
            if a:
                yield out(a, b)
            key, fps = key[done:], fps[done:]
            if refine and len(key) > LONG:
                spilling = int(key[0])
                yield out(None, fps, key)
                key, fps = key[:0], fps[:0]

    return run


def chain_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches and then None, which says that the last list has ended."""
    yield from batches
    yield None


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def _posted(fps: DataFrame, groups: list[tuple[int, ...]], at: str | None = None) -> DataFrame:
    """Rows (key, fp): the key holds the group's number and its positional bytes."""
    keys = []
    for n, group in enumerate(groups):
        key = F.lit(n).cast("long")
        for i in group:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(i))
        keys.append(key if at is None else F.when(F.shiftrightunsigned(at, 24) == F.lit(n // 10), key))
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "fp").where("key is not null")
    return rows.repartition("key").sortWithinPartitions("key", "fp")


def near_links(fps: DataFrame) -> DataFrame:
    """``src, dst`` (fingerprints) that connect all distinct fingerprints ``fp`` within three bits."""
    found = cut(_posted(fps, TRIPLES).mapInArrow(search(True), "a long, b long, list long"))
    fives = [(*t, *more) for t in TRIPLES for more in combinations([i for i in range(8) if i not in t], 2)]
    long = found.where("list is not null").select("list", F.col("b").alias("fp"))
    again = _posted(long, fives, "list").mapInArrow(search(False), "a long, b long, list long")
    return found.where("list is null").unionByName(again).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``docs (doc_id, text, ...)``.

    The component is the smallest doc_id that links of at most three differing bits reach;
    null where only rows without doc_id are reached. Empty and null texts have fingerprint
    zero and link like any other; repeated rows stay repeated; other columns are not read;
    an empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(near_links(distinct.select("fp"))).select(F.col("node").alias("fp"), "component")
    named = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
