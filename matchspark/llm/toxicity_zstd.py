"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

Training rows are parted by their hash: the dictionaries learn from three of four parts,
the thresholds from the fourth. A window is marked if the toxic dictionary shortens it by
enough bytes more than the ordinary one; a text is toxic if it has enough marked windows
beyond those that an ordinary text of its length would have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.text import per_row

#: Most labelled documents of each class that are learned from, and calibrated on, by lowest hash of doc_id.
SAMPLE = 5_000
#: Level of compression, most bytes of a dictionary, most windows that one is made from, distances that a process keeps.
LEVEL, DICTIONARY, COMMON, KNOWN = 19, 64 * 1024, 8_000, 400_000
#: Distances that may mark a window, and marked windows that may make a text toxic.
DISTANCES, LEAST = range(1, 13), range(1, 6)
WINDOW = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[str]:
    """The windows of a whole text: each run of letters, in lower case."""
    return WINDOW.findall((text or "").lower())


def frame(window: str) -> str:
    """The window four times: one long match where a dictionary holds it, and never too short to compress."""
    return f" {window} {window} {window} {window} "


def trained(counted: list[tuple[int, str]]) -> bytes:
    """Dictionary content: the frames of the windows, the commonest last, where offsets are short; cut at the front."""
    return "".join(frame(w) for _, w in sorted(counted)).encode()[-DICTIONARY:] + bytes(64)


class Distance:
    """Bytes by which the toxic dictionary shortens a window more than the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.known: dict[str, int] = {}
        self.both = [self.compressor(x) for x in (ordinary, toxic)]

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content.rjust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, window: str) -> int:
        gap = self.known.get(window)
        if gap is None:
            ordinary, toxic = (len(c.compress(frame(window).encode())) for c in self.both)
            if len(self.known) >= KNOWN:
                self.known.clear()
            gap = self.known[window] = ordinary - toxic
        return gap

    def marks(self, text: str | None) -> list[int]:
        """How many windows the text has, and how many of them at each of DISTANCES."""
        gaps = np.array([self(w) for w in windows(text)], np.int64)
        return [len(gaps), *((gaps >= t).sum() for t in DISTANCES)]


def calibrate(toxic: np.ndarray, ordinary: np.ndarray) -> tuple[int, int, float]:
    """The distance that marks a window, the marks that make a text toxic, and the share of windows marked in ordinary texts.

    Rows are those of ``Distance.marks``; the choice has the best balanced accuracy.
    """
    scored = {}
    for t in DISTANCES:
        rate = ordinary[:, t].sum() / max(1, ordinary[:, 0].sum())
        for c in LEAST:
            hit = [x[:, t] >= c + 2 * rate * x[:, 0] for x in (toxic, ordinary)]
            scored[t, c, float(rate)] = hit[0].mean() + 1 - hit[1].mean()
    return max(scored, key=lambda k: (scored[k], -k[1], -k[0]))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of rows (text, toxic) with the texts of each class that hold them, as (window, toxic texts, ordinary texts)."""
    for batch in batches:
        found = Counter((w, y) for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in set(windows(x)))
        names = list({w for w, _ in found})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[w, y] for w in names], pa.int64()) for y in (1, 0))], ["window", "t", "o"])


def dictionaries(texts: DataFrame) -> tuple[bytes, bytes] | None:
    """Contents of the toxic and the ordinary dictionary from ``texts (text, toxic)``; None without both classes.

    The toxic one takes windows in at least three and 1 % of the toxic texts that are 20
    times as common there as in ordinary ones, the ordinary one the commonest windows.
    Windows are counted by class in one grouped count; only what the dictionaries hold
    comes to the driver.
    """
    nt, no = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not nt or not no:
        return None
    counts = texts.select("text", "toxic").mapInArrow(_counted, "window string, t long, o long").groupBy("window").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    telling = counts.where((F.col("t") >= max(3, 0.01 * nt)) & (F.col("t") / nt > 20 * (F.col("o") + 0.25) / no)).orderBy(F.desc("t"), "window").limit(COMMON)
    common = counts.where("o > 1").orderBy(F.desc("o"), "window").limit(COMMON)
    return tuple(trained([(r[1], r[0]) for r in x.collect()]) for x in (telling.select("window", "t"), common.select("window", "o")))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``: n marked windows of the whole text give n / (n + c + e).

    c marks make a text toxic beyond e, twice those of an ordinary text of its length.
    Learned from training rows of ``labels.toxic`` only; without both classes all score 0.
    Null and empty texts have no window and score 0; repeated rows stay, also without
    doc_id; other columns are not read; an empty table gives no rows.
    """
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def texts(tuning: bool) -> DataFrame:
        """Texts and classes of at most ``sample`` training rows of each class."""
        part = known.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 4) == F.lit(tuning))
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        some = part.where("toxic = 1").orderBy(*order).limit(sample).unionByName(part.where("toxic = 0").orderBy(*order).limit(sample))
        return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    content = dictionaries(texts(False))
    at, least, rate = 12, 1, 0.0
    if content:
        marks = [f"m{t}" for t in (0, *DISTANCES)]
        out = pa.schema([("toxic", pa.int64()), *((c, pa.int64()) for c in marks)])
        measure = lambda batches: (lambda d: per_row(["toxic", "text"], out, lambda y, x: (y, *d.marks(x)))(batches))(Distance(*content))
        rated = lambda x: x.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(measure, "toxic long, " + ", ".join(f"{c} long" for c in marks))
        for tuning in (True, False):  # without a class in the fourth part, the others calibrate
            rows = rated(texts(tuning)).limit(4 * sample).toPandas().to_numpy()
            both = [rows[rows[:, 0] == y][:, 1:] for y in (1, 0)]
            if all(map(len, both)):
                at, least, rate = calibrate(*both)
                break
    else:
        content = bytes(64), bytes(64)
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        distance = Distance(*content)

        def one(doc_id, text):
            found = windows(text)
            n = sum(distance(w) >= at for w in found)
            return doc_id, n / (n + least + 2 * rate * len(found)) if n else 0.0

        return per_row(["doc_id", "text"], out, one)(batches)

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
