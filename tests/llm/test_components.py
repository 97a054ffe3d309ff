"""Connected components, and their extension by more edges, against union-find."""

import random

import pytest

from logweave.llm.common import Scratch
from logweave.llm.components import components, extend

PATH = [(i, i + 1) for i in range(40)]
STAR = [(100, 100 + i) for i in range(1, 30)] + [(129, 101), (129, 101)]


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def groups(labels):
    out = {}
    for node, label in labels.items():
        out.setdefault(label, set()).add(node)
    return sorted(map(sorted, out.values()))


def found(df):
    rows = [tuple(r) for r in df.select("node", "label").collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    some = random.Random(seed)
    edges = [*PATH, *STAR, *[(some.randrange(200, 400), some.randrange(200, 400)) for _ in range(90)]]
    edges = [(a, b) for a, b in edges if a != b]
    more = [(some.randrange(0, 450), some.randrange(0, 450)) for _ in range(25)]
    more = [(a, b) for a, b in more if a != b]
    tmp = Scratch(spark, "test-components")
    first = tmp.keep(components(spark.createDataFrame(edges, "a long, b long"), tmp, "a"), "labels")
    assert found(first) == union_find(edges)
    again = extend(first, spark.createDataFrame(more, "a long, b long"), tmp, "b")
    assert groups(found(again)) == groups(union_find(edges + more))


def test_no_edges(spark):
    tmp = Scratch(spark, "test-components")
    none = spark.createDataFrame([], "a long, b long")
    first = tmp.keep(components(none, tmp, "a"), "labels")
    assert found(first) == {}
    assert found(extend(first, none, tmp, "b")) == {}
    assert found(extend(first, spark.createDataFrame([(2, 1)], "a long, b long"), tmp, "c")) == {1: 1, 2: 1}
