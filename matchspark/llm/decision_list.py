"""Quality rules: a decision list learned by sequential covering from labelled statistics."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from matchspark.llm.text import beside, per_row, unused, words_of

WINDOW = 8
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOL = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]")
#: Most labelled rows that the rules are learned from, taken by lowest hash of their identifier.
SAMPLE = 20_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
RATIOS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)", "mean_word": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_words, 1)", "words": "double(n_words)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight that occur twice or more in the text, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rank = ids
    for width in (1, 2, 4):  # exact ranks of windows of 2, 4 and 8 words
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
    often = np.bincount(rank)[rank] > 1
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def statistics(doc_id: int, text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += bool(words_of(line))
        seen.add(line)
    upper = len(UPPER.findall(text))
    return doc_id, len(words), len(text) - len(SPACES.findall(text)), len(SYMBOL.findall(text)), dups, repeated_words(words), upper


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and STATS of each whole text; null counts as empty."""
    out = pa.schema([(c, pa.int64()) for c in ["doc_id", *STATS]])
    return docs.select("doc_id", "text").mapInArrow(per_row(["doc_id", "text"], out, statistics), ", ".join(f"{c} long" for c in ["doc_id", *STATS]))


def grow(x: np.ndarray, y: np.ndarray, most: int = 3) -> list[tuple[int, bool, float]]:
    """Threshold conjunction for y = 1: each condition is the one with the highest gain."""
    rule, at = [], np.ones(len(y), bool)
    while len(rule) < most and at.any() and y[at].mean() < 1:
        best, base = (0.0, None), y[at].mean()
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[at, j], np.linspace(0, 1, 65))):
                for above in (True, False):
                    hit = at & (x[:, j] > t if above else x[:, j] <= t)
                    p = y[hit].sum()
                    if p and (gain := p * (np.log2(p / hit.sum()) - np.log2(base))) > best[0] + 1e-9:
                        best = (gain, (j, above, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        at &= covers([best[1]], x)
    return rule


def covers(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    at = np.ones(len(x), bool)
    for j, above, t in rule:
        at &= x[:, j] > t if above else x[:, j] <= t
    return at


def learn(x: np.ndarray, y: np.ndarray, most: int = 8, precision: float = 0.9) -> list[list[tuple[int, bool, float]]]:
    """Rules for rejection (y = 1): grown on two thirds, pruned on one third, until none is precise."""
    rules, left, third = [], np.ones(len(y), bool), np.arange(len(y)) % 3 == 2
    while len(rules) < most and y[left].sum() >= 5:
        rule = grow(x[left & ~third], y[left & ~third])

        def worth(r, held=left & third):
            at = covers(r, x[held])
            return (2 * y[held][at].sum() - at.sum()) / max(1, at.sum()) if at.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        at = covers(rule, x) & left
        if not rule or not at.any() or y[at].mean() < precision:
            break
        rules.append(rule)
        left &= ~at
    return rules


def expression(rules: list[list[tuple[int, bool, float]]], ratios: dict[str, str] = RATIOS) -> Column:
    """The ordered list as a Spark conditional: the number of the first rule that fires, else 0."""
    names, out = list(ratios), F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        fired = F.lit(True)
        for j, above, t in rule:
            c = F.expr(ratios[names[j]])
            fired = fired & (c > t if above else c <= t)
        out = F.when(fired, F.lit(n)).otherwise(out)
    return out


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[tuple[int, bool, float]]]:
    """The rules that at most ``sample`` labelled documents give (``labels.quality``, 0 rejected)."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    fitted = text_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")).join(chosen, "doc_id")
    rows = fitted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).selectExpr("quality", *(f"{e} as {c}" for c, e in RATIOS.items())).toPandas()
    return learn(rows[list(RATIOS)].to_numpy(float), (rows["quality"] == 0).to_numpy(int)) if len(rows) else []


FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words``, the four statistics, ``base_failed, rule, kept`` for each row.

    Rules are learned from at most ``sample`` labelled documents (``labels.quality``, 0
    rejected); with none, only the base rule holds. Null and empty texts have no words and
    fail the base rule; repeated rows stay, and rows without doc_id; columns besides doc_id
    and text are not read; an empty table gives no rows.
    """
    rules = learned(docs, labels, sample)
    out = text_statistics(docs).withColumn("base_failed", F.expr(FAILED)).withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop("n_upper")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the rules or the base rule reject.

    Each row is judged by its own text, in the pass that reads it: rows that repeat a
    doc_id or have none are judged alone, no text is shuffled. Null and empty texts go;
    repeated good rows stay; other columns stay as they are, whatever their names.
    """
    rules, names = learned(docs, labels, sample), unused(docs, *STATS)
    rated = beside(docs, [StructField(n, LongType()) for n in names], lambda text: statistics(0, text)[1:])
    swap = dict(zip(STATS, names, strict=True))
    fill = lambda e: re.sub(r"\bn_\w+|\bword_chars\b", lambda m: f"`{swap[m[0]]}`", e)
    good = ~F.expr(fill(FAILED)) & (expression(rules, {k: fill(e) for k, e in RATIOS.items()}) == 0)
    return rated.where(good).select(*(F.col(f"`{c}`") for c in docs.columns))
