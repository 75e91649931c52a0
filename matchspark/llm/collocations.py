"""Phrase collocations from depth-truncated suffix trees, built in groups of word prefixes.

The text of a language is a sequence of pieces, and the suffix tree over all places where a
word stands, cut at ``LONGEST`` words, has the count of every phrase. It is partitioned
vertically, by the words that suffixes begin with:

1. Words are counted. A phrase is no commoner than its rarest word, so suffixes end before
   the first word below the least count, and a prefix with one word of at most ``budget``
   occurrences has no more suffixes than that.
2. A suffix goes to the group of its shortest prefix that holds such a word, of all its
   words if none does: commoner prefixes are extended word by word. Prefixes are spread over
   as many groups as keep a group's share at half the budget, so a group fits in memory.
   Each chunk of text sends one sorted run of distinct suffixes to each group it has any for.
3. A group merges its runs into its subtree, in order of the suffixes. The count of a node is
   the total of the leaves below it, which are neighbours. Nodes above the extended prefix of
   a group get a part of their count in several groups; these parts are added up after.

Which words are common enough is asked of bitmaps of a fixed size, in which some rarer words
pass; what that lets through is counted and then dropped by its count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.text import small
from matchspark.session import cut

LEAST, LONGEST, TOP = 30, 4, 2000
#: Suffixes that may begin with one group prefix, and words of text that are taken together.
BUDGET, CHUNK = 1_000_000, 1_000_000
#: Bits of the maps of common words; a map word (of Spark's bitmap functions) has 2**15.
MAP_BITS = 1 << 24
ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str | None) -> list[bytes]:
    """A text with A-Z in lower case, cut at punctuation and line ends."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(ENDS).split(b"\n")


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 42)


def _by_language(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, list[bytes | None]]]:
    """Words of some texts of a language, None after each piece; about ``chunk`` of them."""
    held: dict[str, list[bytes | None]] = defaultdict(list)
    n = 0
    for batch in small(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = held[lang]
            for piece in pieces(text):
                found = piece.split()
                words += found
                words.append(None)
                n += len(found)
                if n >= chunk:
                    yield from held.items()
                    held.clear()
                    words, n = held[lang], 0
    yield from held.items()


def _word_counts(chunk: int):
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_language(batches, chunk):
            found = Counter(words)
            del found[None]
            keys = pa.array(list(found), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), keys, pa.array(found.values(), pa.int64())], schema=schema)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``lang, word, n``: occurrences of every word of every language."""
    return _texts(docs).mapInArrow(_word_counts(chunk), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_map(words: DataFrame, bits: int = MAP_BITS) -> bytes:
    """A bitmap of the hashes of ``words (lang, word)``; the driver gets ``bits`` / 8 bytes at most."""
    spot = F.pmod(F.xxhash64("lang", "word"), F.lit(bits)) + 1
    rows = words.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("map"))
    whole = bytearray(bits // 8)
    for bucket, part in rows.collect():
        whole[(bucket - 1) * 4096 : bucket * 4096] = part
    return bytes(whole)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def suffixes(ids: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The suffixes at all places with two common words or more: a row of ``LONGEST`` ids, 0 beyond their end.

    ``ids`` has 0 between pieces; ``common`` tells for each id whether its word is common.
    """
    kept = np.where(common[ids], ids, 0)
    columns = [kept]
    for k in range(1, LONGEST):
        columns.append(np.where(columns[-1] > 0, np.r_[kept[k:], np.zeros(min(k, len(kept)), kept.dtype)], 0))
    rows = np.stack(columns, axis=1)
    return rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)]


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Two numbers for the four ids of each suffix, in whose order suffixes with the same beginning are neighbours."""
    return [rows[:, i].astype(np.uint64) << np.uint64(32) | rows[:, i + 1].astype(np.uint64) for i in (0, 2)]


def sorted_runs(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ids in order, with the sum of their times."""
    if not len(rows):
        return rows, times
    high, low = _keys(rows)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
    return rows[order[first]], np.add.reduceat(times[order], first)


def placed(rows: np.ndarray, hashes: np.ndarray, hot: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the words of its prefix and its group."""
    depth, open_ = np.ones(len(rows), np.uint8), hot[rows[:, 0]]
    key = hashes[rows[:, 0]]
    for k in range(1, LONGEST):
        depth[open_] = k + 1
        key = np.where(open_, (key ^ key >> np.uint64(29)) * MIX + hashes[rows[:, k]], key)
        open_ = open_ & (rows[:, k] > 0) & hot[rows[:, k]]
    return depth, ((key ^ key >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def _runs(common_map: bytes, hot_map: bytes, groups: int, chunk: int):
    schema = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("words", pa.binary()), ("ids", pa.binary()), ("times", pa.binary()), ("depths", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").view(bool) for m in (common_map, hot_map)]
        for lang, words in _by_language(batches, chunk):
            numbers: dict[bytes | None, int] = defaultdict(count().__next__)
            numbers[None]
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            del words
            names, seed = list(numbers), seed_of(lang)
            hashes = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in names[1:])], np.uint64)
            spots = (hashes & np.uint64(len(maps[0]) - 1)).astype(np.int64)
            common, hot = (m[spots] for m in maps)
            common[0] = False
            rows = suffixes(ids, common)
            rows, times = sorted_runs(rows, np.ones(len(rows), np.int64))
            depth, part = placed(rows, hashes, hot, groups)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0, True]) if len(order) else []
            for at, end in zip(edges, edges[1:], strict=False):
                some = order[at:end]
                own, inner = np.unique(rows[some], return_inverse=True)
                own_words = b"\n".join(names[i] if i else b"" for i in own.tolist())
                small_ids = inner.reshape(-1, LONGEST).T.astype("<u4") + np.uint32(own[0] > 0)  # 0 stays the end
                cells = [lang, int(part[some[0]]), zstandard.compress(own_words if own[0] == 0 else b"\n" + own_words, 1), _packed(small_ids), _packed(times[some].astype("<u4")), _packed(depth[some])]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return run, schema


def _subtree(least: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
    unpacked = lambda data, kind: np.frombuffer(zstandard.decompress(data), kind)

    def run(runs: pa.Table) -> pa.Table:
        """The runs of a group, merged; the counts of the nodes of its subtree."""
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        numbers[b""]
        parts = []
        for words, ids, times, depths in zip(*(runs[c].to_pylist() for c in ("words", "ids", "times", "depths")), strict=True):
            known = np.array([numbers[w] for w in zstandard.decompress(words).split(b"\n")], np.int64)
            parts.append((known[unpacked(ids, "<u4").reshape(LONGEST, -1).T], unpacked(times, "<u4").astype(np.int64), unpacked(depths, np.uint8)))
        rows, times, depths = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort(_keys(rows)[::-1])
        rows, times, depths = rows[order], times[order], depths[order]
        names, out = list(numbers), []
        turn = np.zeros(len(rows), bool)
        turn[0] = True
        for size in range(1, LONGEST + 1):
            turn[1:] |= rows[1:, size - 1] != rows[:-1, size - 1]
            starts = np.flatnonzero(turn)
            totals = np.add.reduceat(times, starts)
            here = (rows[starts, size - 1] > 0) & ((totals >= least) | (depths[starts] > size)) & (size > 1)
            for at, n in zip(starts[here].tolist(), totals[here].tolist(), strict=True):
                out.append((b" ".join(names[i] for i in rows[at, :size].tolist()), size, n))
        phrases, sizes, ns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array([runs["lang"][0].as_py()] * len(out), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(ns, pa.int64())], schema=schema)

    return run


def phrase_counts(docs: DataFrame, words: DataFrame, least: int = LEAST, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """``lang, phrase, words, n``: phrases of 2 to ``LONGEST`` words with ``least`` occurrences or more, from their subtrees."""
    common = words.where(F.col("n") >= least)
    total = common.agg(F.sum("n")).first()[0] or 0
    groups = 1 + 2 * total // budget
    run, _ = _runs(word_map(common), word_map(words.where(F.col("n") > budget)), groups, chunk)
    runs = _texts(docs).mapInArrow(run, "lang string, part long, words binary, ids binary, times binary, depths binary")
    nodes = runs.groupBy("lang", "part").applyInArrow(_subtree(least), "lang string, phrase string, words int, n long")
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of each phrase at the cut that scores lowest."""
    known = words.select("lang", F.col("word").alias("part"), "n").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "n"))
    split = phrases.select("lang", "phrase", F.col("words").alias("size"), F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", joined(1, F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    with_l = cuts.join(known.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    with_r = with_l.join(known.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    value = F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = with_r.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def maximal(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases that no longer one holds with at least ``percent`` of their occurrences."""
    longer = phrases.where("words > 2").select("lang", "n", "words", F.split("phrase", " ", -1).alias("w"))
    spans = [(at, size) for size in range(2, LONGEST) for at in range(1, LONGEST - size + 2)]
    inner = F.array(*(F.when((F.col("words") > size) & (F.col("words") >= at + size - 1), F.array_join(F.slice("w", at, size), " ")) for at, size in spans))
    held = longer.select("lang", "n", F.explode(inner).alias("phrase")).where("phrase is not null").groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    joined = phrases.join(held, ["lang", "phrase"], "left")
    return joined.where(F.col("within").isNull() | (100 * _whole(F.col("within")) < percent * _whole(F.col("n")))).drop("within")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    Whole texts of all rows of ``docs (lang, text, ...)`` count; null texts and texts
    without words add nothing, a null language is ``und``; copies and repeated rows count
    each time; ties in score and ``a`` go by the phrase's UTF-8 bytes, so every rank is
    defined. An empty table gives no rows; other columns are not read.
    """
    words = cut(word_counts(docs, chunk))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = cut(phrase_counts(docs, words, least, budget, chunk))
    found = scored(phrases, words.where(F.col("n") >= least)).join(maximal(phrases).select("lang", "phrase"), ["lang", "phrase"], "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the same table over ``documents``.
SQL = """WITH pieces AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
 grams AS MATERIALIZED (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) t(k)),
 f AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
 sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
 parts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:size], ' ') AS tail FROM c, range(1, 4) t(k) WHERE k < size),
 cuts AS (SELECT p.lang, p.phrase, p.a, l.a AS l, r.a AS r, k, CAST(2000000 AS HUGEINT) * p.a // (l.a + r.a) AS score FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.tail),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) x WHERE nth = 1),
 inner_ AS (SELECT c.lang, array_to_string(c.ws[i:i + s - 1], ' ') AS phrase, max(a) AS a FROM c, range(2, 4) t(s), range(1, 4) u(i) WHERE s < c.size AND i + s - 1 <= c.size GROUP BY 1, 2),
 kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.a IS NULL OR 100 * CAST(i.a AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
 SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r.r, n, CAST(score AS BIGINT) AS score FROM ranked r JOIN sizes s ON s.lang = r.lang WHERE rank <= 2000"""
