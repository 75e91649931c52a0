import random

import pytest

from matchspark.operators.components import connected_components


@pytest.mark.parametrize("small", [0, 20, 100_000])
def test_components_equal_union_find(spark, small):
    rng = random.Random(1)
    edges = [(k, rng.randrange(60), rng.randrange(60)) for k in (1, 2) for _ in range(35)] + [(1, None, 3), (1, 4, 4)]
    label = {(k, n): n for k in (1, 2) for n in range(60)}
    for _ in range(60):
        for k, a, b in edges:
            if a is not None:
                label[k, a] = label[k, b] = min(label[k, a], label[k, b])
    got = connected_components(spark.createDataFrame(edges, "m int, src int, dst int"), ["m"], small=small).collect()
    linked = {(k, n) for k, a, b in edges if a is not None and a != b for n in (a, b)}
    assert {(r.m, r.node): r.component for r in got} == {x: label[x] for x in linked}
    assert len(got) == len(linked)
