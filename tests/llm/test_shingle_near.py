import random

import pytest

from matchspark.llm import shingle_near as near


def similarity(a, b):
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(5)))) for t in (a, b))
    return len(x & y) / len(x | y)


def texts():
    """Originals with copies of some changed words: similarities on both sides of 0.8."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for k in range(12):
        base = [f"w{k}x{rng.randrange(400)}" for _ in range(200)] + passage
        for changes in (0, 1, 2, 3, 4, 5, 6, 7, 9):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = f"new{rng.random()}"
            out.append(" ".join(copy))
    out += [out[0].upper().replace(" ", "\t"), out[1]]
    rng.shuffle(out)
    return out


def brute(all_texts):
    label = list(range(len(all_texts)))
    links = [(i, j) for i in range(len(all_texts)) for j in range(i) if similarity(all_texts[i], all_texts[j]) >= 0.8]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return label, links


@pytest.mark.parametrize(("rounds", "long"), [(["heaviest", "all"], 4096), (["all"], 4096), (["all"], 10)])
def test_groups_match_brute_force(spark, monkeypatch, rounds, long):
    monkeypatch.setattr(near, "ROUNDS", rounds)
    monkeypatch.setattr(near._in_blocks, "__defaults__", (long,))
    monkeypatch.setattr(near, "ROWS", 7)
    rows = texts()
    want, links = brute(rows)
    assert any(similarity(rows[i], rows[j]) < 0.85 for i, j in links)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_groups(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert sorted(r.doc_id for r in near.keep_first(docs).collect()) == sorted(set(want))


def test_few_words(spark):
    rows = [None, "", " ", "one two", "One  TWO", "one three"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in near.keep_first(docs).collect()} == {0, 3, 5}
    assert near.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_keep_first_with_nulls_repeats_and_other_columns(spark, few):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (5, text, 1), (6, text, 1), (5, text, 2), (None, text, 1), (None, "alone in this", 1), (None, "alone in this", 1), (7, None, 1), (8, "", 1), (9, "x " * 200_000, 1), (10, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = sorted(map(tuple, near.keep_first(docs, few).collect()), key=str)
    five = [r for r in got if r[0] == 5]
    assert len(five) == 1 and five[0] in rows
    assert [r for r in got if r[0] != 5] == sorted([(7, None, 1), (9, "x " * 200_000, 1), (10, "y", 1), (None, "alone in this", 1)], key=str)


def test_finer_counts_bound_what_large_sets_share(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for n, m, both in ((1500, 1600, 1400), (1500, 1600, 0), (3000, 9000, 2500), (20_000, 20_000, 1000), (900, 1500, 800)):
        shared = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, k - both, dtype=np.uint64)])) for k in (n, m))
        found = near.fine_bound(near.fine_counts(x), near.fine_counts(y), len(x), len(y))
        assert both <= found <= min(n, m)
        assert not (both == 0 and near.near(found, n, m)) and not (both == 1000 and near.near(found, n, m))
    full = np.arange(1500, dtype=np.uint64)  # all in one bucket: tells nothing
    assert near.fine_bound(near.fine_counts(full), near.fine_counts(full), 1500, 1500) == 1500


def test_large_copies_are_found(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    edited = list(base)
    for at in rng.sample(range(3000), 40):
        edited[at] = "new"
    rows = [base, edited, other, other[:1500] + base[1500:], base[:2400]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_groups(docs).collect()}
    assert [got[i] for i in range(len(rows))] == brute([" ".join(w) for w in rows])[0]


def test_lists_over_several_batches():
    import numpy as np
    import pyarrow as pa

    keys = [1] * 5 + [2] + [3] * 2 + [4] * 7 + [5] + [6] * 3
    for size in (1, 2, 3, 5, 30):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(range(i, min(i + size, len(keys))))], ["key", "n"]) for i in range(0, len(keys), size)]
        got = [(int(k[0]), n.tolist()) for k, n in near.whole_lists(iter(batches))]
        assert got == [(k, [i for i, x in enumerate(keys) if x == k]) for k in (1, 3, 4, 6)] and np.ndim(got[0][1]) == 1


def hashed(rng, n):
    import numpy as np

    return np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))


@pytest.mark.parametrize("crowded", [False, True])
def test_near_sets_share_a_list_and_pass_the_tally(crowded):
    import numpy as np

    rng = random.Random(12)
    for n in [*range(1, 60), 76, 77, 95, 96, 97, 110, 383, 384, 385, 480, 1500, 6000]:
        x = hashed(rng, n)
        if crowded:  # all shingles in few positions: too few of them are filled
            x = np.unique(x & np.uint64((1 << 40) - 1) | np.uint64(rng.randrange(3) << 40))
        for gone, new in ((n // 5, 0), (n // 10, n // 10), (0, n // 4), (n // 9, n // 9)):
            y = np.unique(np.concatenate([np.array(rng.sample(x.tolist(), len(x) - gone), np.uint64), hashed(rng, new)]))
            both = len(np.intersect1d(x, y))
            if not near.near(both, len(x), len(y)):
                continue
            for common in (np.zeros(0, np.uint64), np.sort(np.array(rng.sample(x.tolist(), n // 2), np.uint64))):
                assert set(near.keys_of(x, common).tolist()) & set(near.keys_of(y, common).tolist())
            shared = sum(a == b for a, b in zip(near.marks(x), near.marks(y), strict=True))
            assert near.enough(shared, len(x), len(y))


def test_unlike_sets_do_not_leave_their_list():
    import numpy as np

    rng = random.Random(13)
    line = hashed(rng, 20)
    sets = [np.unique(np.concatenate([line, hashed(rng, 40)])) for _ in range(100)]
    sets += [np.unique(np.r_[sets[0][2:], hashed(rng, 2)])]
    bytes_ = np.array([list(near.marks(x)) for x in sets], np.uint8)
    n, node = np.array([len(x) for x in sets]), np.arange(len(sets))
    found = [(int(a), int(b)) for x, y in near.pairs_of(node, n, node, "all", None, bytes_) for a, b in zip(x, y, strict=True)]
    assert found == [(0, 100)]
