"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Pieces are dealt at random into shards of about ``SHARD`` pieces. Each shard is packed by
several islands, tasks of their own with a population of packings that start from best-fit
decreasing, of the true sizes and of noisy ones. A crossover injects well-filled bins of
another parent whole, removes their pieces from the other bins, opens the emptiest bins and some
others (mutation), swaps displaced pieces for smaller ones where a bin gets fuller, and
best-fits the rest. After each epoch the elite packing of an island moves to the next
island of its shard through a shuffle; the best island wins. A shard is done when it
reaches the bound that no packing can beat.

Bins that stay badly filled are dealt anew, whole, from all shards into new ones, and
evolve there a second time, so that the waste does not grow by a bin a shard.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.encoding import encoder
from matchspark.llm.text import batches_of, crc_of_ids, small
from matchspark.session import cut

LIMIT, SHARD = 2048, 2000
#: Islands of a shard, packings on an island, epochs between migrations, crossovers in an epoch.
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 8, 2, 12
#: Bins filled to less than this share are packed again with those of other shards.
FILLED = 0.98
#: Documents that a task has in memory at once.
ROWS = 2500

#: Bits for the number of a bin.
BITS = 24
LAST = (1 << BITS) - 1

Packing = tuple[list[list[int]], list[int]]


def totals(bins: list[list[int]], size: list[int]) -> list[int]:
    return [sum(map(size.__getitem__, b)) for b in bins]


def best_fit(bins: list[list[int]], items: list[int], size: list[int], limit: int, sums: list[int] | None = None) -> list[list[int]]:
    """Put each item (longest first) into the bin that it leaves fullest, else into a new one; ``sums`` of the bins follow."""
    sums = totals(bins, size) if sums is None else sums
    room = sorted((limit - s) << BITS | n for n, s in enumerate(sums) if s < limit)  # room and number of a bin in one integer
    for item in sorted(items, key=size.__getitem__, reverse=True):
        need = size[item]
        at = bisect_left(room, need << BITS)
        if at < len(room):
            spot = room.pop(at)
            n = spot & LAST
            bins[n].append(item)
            sums[n] += need
        else:
            n = len(bins)
            spot = limit << BITS | n
            bins.append([item])
            sums.append(need)
        spot -= need << BITS
        if spot > LAST:
            insort(room, spot)
    return bins


def bound(size: list[int], limit: int) -> int:
    """Bins that any packing needs: by the sum, and by the pieces of which no two fit together."""
    return max(-(-sum(size) // limit), sum(2 * s > limit for s in size))


def fitness(packing: Packing) -> tuple:
    """Fewer bins first, then fuller ones."""
    bins, sums = packing
    return -len(bins), sum(s * s for s in sums)


def cross(one: Packing, other: Packing, size: list[int], limit: int, rng: random.Random) -> Packing:
    """Inject about half of the other parent's well-filled bins; their pieces leave the first parent's bins."""
    injected = [(list(b), s) for b, s in zip(*other, strict=True) if s >= FILLED * limit and rng.random() < 0.5]
    taken = {i for b, _ in injected for i in b}
    clear = [taken.isdisjoint(b) for b in one[0]]
    whole = sorted(((s, n) for n, (s, free) in enumerate(zip(one[1], clear, strict=True)) if free))
    least = max(1, len(whole) // 20)
    drawn = set(rng.sample(range(least, len(whole)), min(least + 1, len(whole) - least))) if len(whole) > least else set()
    whole = [x for n, x in enumerate(whole) if n < least or n in drawn] + [x for n, x in enumerate(whole) if n >= least and n not in drawn]
    least += len(drawn)
    loose = [i for b, free in zip(one[0], clear, strict=True) if not free for i in b if i not in taken]
    loose += [i for _, n in whole[:least] for i in one[0][n]]
    kept = injected + [(list(one[0][n]), s) for s, n in whole[least:]]
    bins, sums = [b for b, _ in kept], [s for _, s in kept]
    loose = swapped(bins, sums, loose, size, limit, rng)
    return best_fit(bins, loose, size, limit, sums), sums


def swapped(bins: list[list[int]], sums: list[int], loose: list[int], size: list[int], limit: int, rng: random.Random, tries: int = 20) -> list[int]:
    """Swap a loose piece for one or two smaller pieces of a bin that gets fuller; returns what is loose then."""
    open_ = [n for n, s in enumerate(sums) if s < limit]
    out = []
    for item in loose:
        need = size[item]
        for n in rng.sample(open_, min(tries, len(open_))):
            room, b = limit - sums[n], bins[n]
            found = next(((i,) for i in b if size[i] < need <= size[i] + room), None) or next(((b[i], b[j]) for i in range(len(b)) for j in range(i) if size[b[i]] + size[b[j]] < need <= size[b[i]] + size[b[j]] + room), None)
            if found:
                bins[n] = [i for i in b if i not in found] + [item]
                sums[n] += need - sum(size[i] for i in found)
                out += found
                break
        else:
            out.append(item)
    return out


def started(size: list[int], limit: int, known: list[Packing], most: int, rng: random.Random) -> list[Packing]:
    """A population: what is known, best-fit decreasing, then best fit of noisy orders, while the bound is not met."""
    population, least = list(known), bound(size, limit)
    while len(population) < most and min((len(p[0]) for p in population), default=least + 1) > least:
        noise = 0.0 if len(population) == len(known) else 0.02 * len(population)
        noisy = [round(s * (1 + noise * rng.random())) for s in size]
        bins: list[list[int]] = []
        for i in sorted(range(len(size)), key=noisy.__getitem__, reverse=True) if noise else []:
            bins.append([i])
            if len(bins) >= max(1, len(size) // 40):
                break
        seeded = {i for b in bins for i in b}
        bins = best_fit(bins, [i for i in range(len(size)) if i not in seeded], size, limit)
        population.append((bins, totals(bins, size)))
    return sorted(population, key=fitness, reverse=True)


def evolve(size: list[int], population: list[Packing], limit: int, generations: int, rng: random.Random) -> list[Packing]:
    """Crossovers of two parents, the better of two drawn each; a child takes the place of the worst that it beats."""
    least, rated = bound(size, limit), [(fitness(p), p) for p in population]
    for _ in range(generations):
        if len(rated) < 2 or -rated[0][0][0] <= least:
            break
        a, b = (min(rng.sample(range(len(rated)), 2)) for _ in range(2))
        child = cross(rated[a][1], rated[b if b != a else (a + 1) % len(rated)][1], size, limit, rng)
        worth = fitness(child)
        if worth > rated[-1][0] and all(worth != w for w, _ in rated):
            rated[-1] = (worth, child)
            rated.sort(key=lambda x: x[0], reverse=True)
    return [p for _, p in rated]


def bins_of(column: np.ndarray) -> list[list[int]]:
    order = np.argsort(column, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(column[order])) + 1)]


def island(limit: int, population: int, generations: int, epoch: int):
    """An applyInPandas function over the pieces of one shard's island (at most a few thousand).

    ``homes`` holds the bin of a piece in each packing of the population, the best first.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        size, rng = rows["length"].tolist(), random.Random(int(rows["island"][0]) * 1009 + epoch)
        held = np.array(rows["homes"].tolist(), np.int64).reshape(len(rows), -1)
        known = [(bins, totals(bins, size)) for bins in (bins_of(c) for c in held.T)]
        evolved = evolve(size, started(size, limit, known, population, rng), limit, generations, rng)[:population]
        homes, fill = np.zeros((len(size), len(evolved)), np.int64), np.zeros(len(size), np.int64)
        for j, (bins, sums) in enumerate(evolved):
            for n, b in enumerate(bins):
                homes[b, j] = n
                if j == 0:
                    fill[b] = sums[n]
        worth = fitness(evolved[0])
        return rows.assign(homes=list(homes), fill=fill, bins=-worth[0], score=float(worth[1]))

    return run


def solved(dealt: DataFrame, limit: int, islands: int, population: int, epochs: int, generations: int) -> DataFrame:
    """``item, length, shard, home, fill``: the best packing of each shard of ``dealt (item, length, shard, homes)``."""
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = state.select("item", "length", "shard", "island", "homes", *(F.lit(0).cast(t).alias(c) for c, t in (("fill", "long"), ("bins", "long"), ("score", "double"))))
    for epoch in range(epochs):
        state = cut(state.groupBy("shard", "island").applyInPandas(island(limit, population, generations, epoch), state.schema))
        if epoch + 1 < epochs:  # the elite packing of each island moves on to the next one
            elite = state.select("item", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("homes")[0].alias("elite"))
            state = state.join(elite, ["item", "island"]).withColumn("homes", F.concat(F.array("elite"), "homes")).select(*state.columns)
    best = state.groupBy("shard").agg(F.max_by("island", F.struct(-F.col("bins"), "score", "island")).alias("island"))
    return state.join(best, ["shard", "island"]).select("item", "length", "shard", F.col("homes")[0].alias("home"), "fill")


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Pieces ``doc_id, piece, start, length, ids_crc32`` of every document; only the first may be short."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in names])

    def run(batches):
        encode = encoder(tokenizer)
        for batch in small(batches, ROWS):
            keys, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            del batch
            for doc_id, raw in zip(keys, encode.batch(texts), strict=True):
                ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id))
                ends = range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)
                rows += [(doc_id, n, max(0, e - limit), e - max(0, e - limit), crc_of_ids(ids[max(0, e - limit) : e])) for n, e in enumerate(ends)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            del keys, texts, rows

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, limit: int = LIMIT, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all pieces of ``docs``.

    Null and empty texts are one piece with the end id alone; repeated rows and rows
    without doc_id are packed each; full pieces are sequences of their own. Other columns
    are not read; an empty table gives no rows.
    """
    with batches_of(docs.sparkSession, ROWS):
        pieces = cut(cut_documents(docs, tokenizer, end_id, limit).withColumn("item", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < limit).select("item", "length")
    shards = max(1, round(short.count() / SHARD))
    search = limit, islands, population, epochs, generations
    dealt = short.select("*", F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard"), F.array().cast("array<long>").alias("homes"))
    chosen = cut(solved(dealt, *search))
    place = F.struct(F.lit(0).alias("round"), "shard", "home")
    kept = chosen.select("item", "length", place.alias("place"))
    if shards > 1:
        poor = F.col("fill") < FILLED * limit
        loose = chosen.where(poor)
        again = max(1, round(loose.count() / SHARD))
        bin_ = F.xxhash64("shard", "home")
        anew = loose.select("item", "length", F.pmod(bin_, F.lit(again)).alias("shard"), F.array(bin_).alias("homes"))
        second = cut(solved(anew, *search)).select("item", "length", F.struct(F.lit(1).alias("round"), "shard", "home").alias("place"))
        kept = chosen.where(~poor).select("item", "length", place.alias("place")).unionByName(second)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = Window.partitionBy("place").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    spots = kept.select("item", (2 * (F.col("place.shard") * (4 * SHARD) + F.col("place.home")) + F.col("place.round")).alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
    packed = pieces.join(spots, "item").select(*names, "sequence_id", "offset")
    full = pieces.where(F.col("length") == limit).select(*names, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
