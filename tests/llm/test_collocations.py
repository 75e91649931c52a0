import random
import re
from collections import Counter

import numpy as np
import pytest

from matchspark.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, word string"


def brute(rows, least=30, top=2000):
    counts, sizes = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    within = Counter()
    for (lang, *words), n in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = (lang, *words[i : i + k])
                within[key] = max(within[key], n)
    out = {}
    for (lang, *words), n in found.items():
        if 100 * within[(lang, *words)] >= 80 * n:
            continue
        cuts = [(counts[(lang, *words[:k])], counts[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, x, y = min((2000000 * n // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -n, " ".join(words).encode(), x, y))
    return {(lang, r, p.decode(), -a, x, y, sizes[lang], -s) for lang, rows in out.items() for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


def texts():
    rng = random.Random(4)
    usual = ["the", "of", "And", "in", "é", "漢", "x y", "c\0d"]
    rows = []
    for n in range(300):
        words = [rng.choice(usual) if rng.random() < 0.7 else f"rare{rng.randrange(5000)}" for _ in range(60)]
        words[5:5] = ["New", "York", "City"] if n % 3 else ["new", "york"]
        words[20:20] = ["one", "two", "three", "four", "five"]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    rows += [("the of the of the " * 20_000, "en"), (None, "en"), ("", "fr"), (" .\n", None), ("a b c d e", "de")]
    return rows + [("shared passage with equal words here", "fr")] * 70


def result(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate(rows)], SCHEMA)
    out = col.collocations(docs.repartition(3), **how).collect()
    assert len(out) == len(set(out))
    return {tuple(r) for r in out}


@pytest.mark.parametrize("how", [{}, {"budget": 200, "chunk": 5000}, {"budget": 20_000, "chunk": 777, "top": 9}])
def test_phrases_match_brute_force(spark, how):
    rows = texts()
    got = result(spark, rows, **how)
    assert got == brute(rows, top=how.get("top", 2000)) and len(got) > 20


def test_no_phrases(spark):
    assert result(spark, [("a b " * 14, "en"), (None, None)]) == set()
    assert col.collocations(spark.createDataFrame([], SCHEMA)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(spark, []) == set()


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a b c", 3, big - 1)], "lang string, phrase string, words int, n long")
    words = spark.createDataFrame([("en", "a", big + 3), ("en", "b", big), ("en", "c", big)], "lang string, word string, n long")
    got = {r.phrase: (r.l, r.r, r.score) for r in col.scored(phrases, words).collect()}
    assert got["a b"] == (big + 3, big, 2000000 * big // (2 * big + 3))


def test_word_map_agrees_with_the_hash_of_the_tasks(spark):
    import xxhash

    rows = [("en", f"w{i}") for i in range(200)] + [("", "é"), ("fr", "w1")]
    bitmap = np.unpackbits(np.frombuffer(col.word_map(spark.createDataFrame(rows, "lang string, word string"), 1 << 16), np.uint8), bitorder="little")
    spots = {xxhash.xxh64_intdigest(w.encode(), col.seed_of(lang)) % (1 << 16) for lang, w in rows}
    assert set(np.flatnonzero(bitmap).tolist()) == spots
