"""Connected components against union-find."""

import random

import pytest

from sightline.operators.graph import connected_components

RNG = random.Random(5)
ORDER = list(range(60))
RNG.shuffle(ORDER)
CASES = {
    "path": [(i, i + 1) for i in range(40)],
    "shuffled path": list(zip(ORDER, ORDER[1:], strict=False)),
    "random": [(RNG.randrange(300), RNG.randrange(300)) for _ in range(160)],
    "star at its smallest": [(0, i) for i in range(1, 50)],
    "star at its largest": [(99, i) for i in range(50)],
    "loops, repeats and nulls": [(1, 1), (2, 3), (3, 2), (None, 4), (5, None)],
    "empty": [],
}


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
@pytest.mark.parametrize("case", CASES)
def test_components(spark, case, block):
    got = [tuple(r) for r in connected_components(spark.createDataFrame(CASES[case], "a long, b long"), block=block).collect()]
    assert sorted(got) == sorted(brute(CASES[case]).items())


def test_names_as_nodes(spark):
    edges = [("ё", "я"), ("я", "z"), ("\U0001f600", "\uffee"), ("b", "a")]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {("ё", "z"), ("я", "z"), ("z", "z"), ("\U0001f600", "\uffee"), ("\uffee", "\uffee"), ("b", "a"), ("a", "a")}
