import random
from collections import Counter
from hashlib import sha256
from math import cos, log2, pi

import numpy as np
import xxhash

from matchspark.llm import text_prints as tp

SCHEMA = "doc_id long, text string, fingerprint string, n_within int, part int"


def plain_print(text):
    words = (text or "").encode().lower().split()
    terms = [a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else words
    votes = [0] * 128
    for term, n in Counter(terms).items():
        bits = int.from_bytes(xxhash.xxh3_128_digest(term))
        for i in range(128):
            votes[i] += round(16 * (1 + log2(n))) * (1 if bits >> (127 - i) & 1 else -1)
    return sum(1 << (127 - i) for i in range(128) if votes[i] > 0) if terms else 0


def plain_likeness(a, b):
    return max(0.0, cos(pi * (a ^ b).bit_count() / 128))


def texts():
    rng = random.Random(3)
    words = [f"W{i}" for i in range(300)]
    out = [None, "", "one", "Two words", "two  words", "é ü x 漢 z", "long " + " ".join(rng.choice(words) for _ in range(30_000))]
    for _ in range(8):
        base = [rng.choice(words) for _ in range(400)]
        out += [" ".join(base)] * 3
        for _ in range(4):
            base[rng.randrange(400)] = rng.choice(words)
            out.append("\t".join(base).lower())
    return out


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(rows, key=key)
    prints = [plain_print(t) for _, t in rows]
    out = []
    for k, (i, text) in enumerate(rows):
        following, text = rows[(k + 1) % len(rows)][1] or "", text or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        fp = plain_print(changed)
        near = sum((prints[k] ^ p).bit_count() <= 3 for p in prints) if i is not None and i % 100 == 0 else None
        out.append((i, len(text), sha256(changed.encode()).hexdigest(), f"{prints[k]:032x}", f"{fp:032x}", round(plain_likeness(prints[k], fp), 9), round(plain_likeness(prints[k], prints[(k + 1) % len(rows)]), 9), near))
    return out


def result(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = tp.document_prints(docs.repartition(3))
    return [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9), r.n_within) for r in got.collect()]


def test_rows_match_brute_force(spark):
    rows = [(None, "No name here")] + [(10 * i, t) for i, t in enumerate(texts())]
    assert Counter(result(spark, rows)) == Counter(brute(rows))


def test_repeated_ids_and_single_rows(spark):
    same = [(100, "a b c d e f")] * 4
    assert Counter(result(spark, same)) == Counter(brute(same))
    assert result(spark, [(0, "only words here")]) == brute([(0, "only words here")])
    ties = result(spark, [(100, "x y"), (100, "p q"), (200, None)])
    assert [r[0] for r in sorted(ties)] == [100, 100, 200] and {r[3] for r in ties} == {f"{plain_print(t):032x}" for t in ("x y", "p q", "")}


def test_empty_table(spark):
    out = tp.document_prints(spark.createDataFrame([], SCHEMA))
    assert out.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and out.count() == 0


def test_search_finds_every_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = [int.from_bytes(rng.bytes(16)) for _ in range(5)]
    fps = [b ^ sum({1 << int(k) for k in rng.integers(0, 128, n)}) for b in base for n in range(8) for _ in range(12)] + [base[0]] * 5
    rows = spark.createDataFrame([(bytearray(x.to_bytes(16)),) for x in fps], "fp binary")
    asked = spark.createDataFrame([(bytearray(x.to_bytes(16)),) for x in base], "fp binary")
    for radius in (3, 5):
        got = {int.from_bytes(r.fp): r.found for r in tp.within_radius(rows, asked, radius, longest=16).collect()}
        assert got == {b: sum((b ^ x).bit_count() <= radius for x in fps) for b in base}


def test_likeness_tells_half_edited_texts_from_others(spark):
    rows = [(i, t) for i, t in enumerate(texts()[7:]) if i % 7 == 0]
    assert all(r[5] > 0.2 and r[5] > r[6] for r in result(spark, rows))
