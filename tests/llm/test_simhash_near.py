import random

import numpy as np
import pytest

from matchspark.llm import simhash_near as near


def brute(fps):
    label = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3 and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    out = [None, "", "one", "Two words", "two  words", "é ü\u00a0x y z"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(4):
            base[rng.randrange(120)] = rng.choice(words)
            out.append(" ".join(base))
        out.append("\t".join(base).upper())
    return out


@pytest.mark.parametrize("long", [2048, 3])
def test_components_match_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(near, "LONG", long)
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = [near.fingerprint(t) for _, t, _ in rows]
    assert [got[i].component_id for i in range(len(rows))] == brute(fps)
    assert got[0].fingerprint == "0" * 16 and got[0].component_id == 0 == got[1].component_id
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{x & (2**64 - 1):016x}" for x in fps]


def test_long_lists_by_flips():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 14, 400).astype(np.uint64))
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in near.flips(fps):
        label[find(a)] = find(b)
    want = brute([int(x) for x in fps])
    groups = {}
    for i, x in enumerate(want):
        groups.setdefault(x, set()).add(find(i))
    assert all(len(x) == 1 for x in groups.values()) and len({find(i) for i in range(len(fps))}) == len(groups)


def test_empty_table(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "other words here now"), (None, None), (9, "z " * 100_000)]
    got = sorted(((r.doc_id, r.component_id) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (None, None), (9, 9)], key=str)


def test_tally_counts_shared_positional_bytes():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 3, (40, 8)).astype(np.uint8)
    want = [[sum(a == b) for b in fps] for a in fps]
    assert near.tally(fps.view("<u8").ravel()).tolist() == np.array(want).tolist()
