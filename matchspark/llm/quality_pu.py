"""Quality classifier by positive-unlabelled learning with the non-negative risk.

A text's features are hashed byte trigrams of the whole text and shares of its characters
and words. The model sees trusted positives and unlabelled documents; the class prior is
estimated from these two alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.decision_list import statistics
from matchspark.llm.text import per_row

#: Most trusted positives, and most unlabelled rows, that the model is fitted on.
SAMPLE = 20_000
#: Buckets of byte trigrams; bytes of a text that are hashed at a time.
BUCKETS, CHUNK = 512, 1 << 20
SHARES = 8
#: Signs are what is neither letter, digit nor white space; words that consist of them are bare.
SIGN, BARE = re.compile(r"[^\w\s]"), re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


def trigrams(data: bytes) -> np.ndarray:
    """Square roots of the hashed trigrams' shares; no trigrams give zeros."""
    counts = np.zeros(BUCKETS, np.int64)
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - 2, CHUNK):
        x = raw[at : at + CHUNK + 2].astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(23), minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum()))


def features(text: str | None) -> np.ndarray:
    """Trigrams and shares of a whole text; all between 0 and 1, and of no words the last is 1."""
    text = text or ""
    _, n, chars, symbols, dups, repeats, upper = statistics(0, text)
    c, w = max(1, chars), max(1, n)
    words = text.split()
    again = sum(a == b for a, b in zip(words, words[1:])) / w
    shares = [symbols / c, repeats / w, upper / c, min(1, 4 * dups / w), again, 1 / w, len(SIGN.findall(text)) / c, len(BARE.findall(text)) / w]
    return np.concatenate([trigrams(text.encode("utf-8", "surrogatepass")), shares]).astype(np.float32)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Both parts of the risk of scores z: prior * R_p(+), and R_u(-) - prior * R_p(-), with the logistic loss."""
    plus = prior * np.logaddexp(0, -positive).mean()
    return float(plus), float(np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 2000, rate: float = 0.02, batch: int = 512, decay: float = 1e-3, biased: bool = False) -> tuple[np.ndarray, float]:
    """Weights of a logistic score that minimise prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) by Adam on batches.

    Where the estimated negative part of a batch is below zero, only its own gradient is
    followed upwards, as the non-negative estimator prescribes. ``biased`` takes the
    unlabelled rows for negatives instead, which the estimate of the prior needs.
    """
    rng = np.random.default_rng(1)
    w, mean, var = np.zeros(positive.shape[1] + 1), 0.0, 0.0
    for step in range(1, rounds + 1):
        p, u = (np.column_stack([x[rng.integers(0, len(x), batch)], np.ones(batch)]) for x in (positive, unlabelled))
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        plus, minus = p.T @ (sp - 1) / len(p), u.T @ su / len(u)
        if biased:
            g = plus + minus
        else:
            negative = minus - prior * p.T @ sp / len(p)
            g = prior * plus + negative if risk(zp, zu, prior)[1] >= 0 else -negative
        g = g + decay * w
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        w = w - pace * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def scales(unlabelled: np.ndarray) -> np.ndarray:
    """What each feature is divided by: trigrams by one, shares by their spread."""
    return np.concatenate([np.ones(BUCKETS), np.maximum(unlabelled[:, BUCKETS:].std(axis=0), 1e-3)])


def scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.minimum(x / scale, 8)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from both samples alone.

    The unlabelled mass of a region is at least prior times its positive mass, and equals
    it where no negatives are. Regions are those above a threshold of a score fitted on
    one half; on the other half the least ratio, with room for chance, is the estimate.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    w, b = fit(positive[::2], unlabelled[::2], 0.5, rounds=800, biased=True)
    p, u = np.sort(positive[1::2] @ w + b), np.sort(unlabelled[1::2] @ w + b)
    at = np.quantile(p, np.linspace(0, 0.6, 61))
    above = lambda x: 1 - np.searchsorted(x, at) / len(x)
    ratio = (above(u) + np.sqrt(above(u) * (1 - above(u)) / len(u))) / above(p)
    return float(np.clip(ratio.min(), 0.01, 0.99))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Trusted positives are training rows with quality 1; unlabelled is a hash sample of
    documents that are no held-out rows; each at most ``sample`` rows. No other label is
    used. With no positives all score 0.5. Null is empty text; repeated rows stay, also
    without doc_id; other columns are not read; an empty table gives no rows.
    """
    train = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    hashed = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = train.where("quality = 1").orderBy(*hashed).limit(sample)
    web = docs.where(~held_out()).select("doc_id").orderBy(*hashed).limit(sample)
    raw = pa.schema([("x", pa.binary())])
    measure = per_row(["text"], raw, lambda text: (features(text).astype("<f2").tobytes(),))

    def take(ids: DataFrame) -> np.ndarray:
        some = docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text").orderBy(*hashed).limit(sample)
        rows = some.select("text").mapInArrow(measure, "x binary").toPandas()["x"]
        return np.frombuffer(b"".join(rows), "<f2").reshape(-1, BUCKETS + SHARES).astype(np.float32)

    weights = None
    if not good.isEmpty():
        p, u = take(good), take(web)
        if len(p) and len(u):
            scale = scales(u)
            p, u = (scaled(x, scale) for x in (p, u))
            weights = (scale, *fit(p, u, estimated_prior(p, u)))
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(doc_id: int, text: str | None) -> tuple:
        if weights is None:
            return doc_id, 0.5
        scale, w, b = weights
        z = scaled(features(text).astype("<f2"), scale) @ w + b
        return doc_id, float(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    scored = docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, score), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
