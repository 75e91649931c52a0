import zlib
from collections import Counter
from hashlib import sha256

import pytest

from matchspark.llm import merkle_log as merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int"


def h(parts):
    return sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def leaf_of(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [None if v is None else str(v) for v in (row[0], row[1], row[2], row[3], text)]
    return h(["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def folded(node, at, levels, others):
    for level in levels[:-1]:
        first = at // 8 * 8
        run = level[first : first + 8]
        others += run[: at - first] + run[at - first + 1 :]
        node = h([*run[: at - first], node, *run[at - first + 1 :]])
        at //= 8
    return node


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    for lang in trees:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: levels_of([leaf_of(r) for r in trees[lang]]) for lang in langs}
    top = levels_of([built[lang][-1][0] for lang in langs]) if langs else []
    out = []
    for rank, lang in enumerate(langs):
        for i, row in enumerate(trees[lang]):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            others = []
            node = folded(leaf_of(row, hit), i, built[lang], others)
            node = folded(node, rank, top, others)
            out.append((row[0], leaf_of(row), built[lang][-1][0], top[-1][0], h(others), node, node == top[-1][0]))
    return out


def rows_of():
    few = [(None, None, None, None, None), (None, "a", "en", 3, ""), (7, "a", "en", 3, "Tie"), (7, "b", "en", 3, "Other tie"), (8, "a", "en", 4, "SAME"), (8, "a", "en", 4, "SAME"), (8, "a", "en", 4, "SAME"), (5, "", "", 0, ""), (3, "é", "ü", -1, "Zürich X 漢"), (12, "s", "long", 9, "Word " * 60_000)]
    few += [(100 + i, "s", f"lang{i % 11}", i, f"Text {i}") for i in range(40)]
    return few + [(1000 + i, "s", "hot", i, f"Page {i}" if i % 3 else f"page {i}") for i in range(1203)]


@pytest.mark.parametrize("n", [1, 10, None])
def test_manifest_matches_brute_force(spark, n):
    rows = rows_of()[:n]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = Counter(tuple(r) for r in merkle.merkle_manifest(docs).collect())
    assert got == Counter(brute(rows))


def test_empty_table(spark):
    out = merkle.merkle_manifest(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 512])
def test_positions_are_those_of_a_postorder_walk(leaves):
    levels, n = 0, leaves
    while n > 1:
        n, levels = merkle.width(1, n), levels + 1
    walk = []

    def visit(level, index):
        if level:
            for child in range(index * 8, min(index * 8 + 8, merkle.width(level - 1, leaves))):
                visit(level - 1, child)
        walk.append((level, index))

    visit(levels, 0)
    assert [merkle.position(level, index, leaves) for level, index in walk] == list(range(len(walk)))
    digests = [sha256(bytes([i % 256, i // 256])).digest() for i in range(leaves)]
    log = merkle.appended(digests, levels)
    want = levels_of([d.hex() for d in digests])
    assert [x.hex() for x in log] == [want[level][index] for level, index in walk]


def test_a_path_proves_its_leaf_alone():
    digests = [sha256(bytes([i])).digest() for i in range(77)]
    log = merkle.appended(digests, 3)
    for i in range(77):
        path = merkle.siblings(b"".join(log), i, 77, 3)
        assert merkle.fold(digests[i], path)[0] == log[-1] != merkle.fold(digests[i - 1], path)[0]


def test_a_log_has_a_row_a_builder(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows_of()], SCHEMA)
    built = merkle.manifest(docs)
    hot = sorted(built.rounds[0].where("tree = '=hot'").collect(), key=lambda r: r.block)
    assert [r.block for r in hot] == [0, 1, 2] and [len(r.nodes) // 32 for r in hot] == [585, 585, 206]
    assert len(built.rounds) == 2 and [len(r.nodes) // 32 for r in built.rounds[1].collect()] == [4]
