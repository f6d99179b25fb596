"""Groups of matching records against union-find."""

import random

import pytest

from ranksmith.llm.groups import match_groups

SCHEMA = "seq long, src string, dst string, weight double"


def brute(rows):
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, u, v, _ in rows:
        for x in (u, v):
            if x is not None:
                up.setdefault(x, x)
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)), key=lambda s: s.encode())
            up[b] = a
    return {(find(x), x) for x in up}


def shapes():
    r = random.Random(4)
    yield "random", [(f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(90)]
    yield "chain", [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)]
    yield "zigzag", [(f"c{(i * 37) % 101:03d}", f"c{((i + 1) * 37) % 101:03d}") for i in range(100)]
    yield "star", [("zz", f"s{i}") for i in range(300)] + [("aa", f"t{i}") for i in range(50)]
    yield "odd", [("a", "a"), ("a", None), (None, "b"), (None, None), ("é", "z"), ("z", "é"), ("Z", "é"), ("a", "b "), ("b", "b ")] * 2
    yield "empty", []
    yield "links nothing", [("a", None), ("b", "b")]


@pytest.mark.parametrize(("name", "pairs"), list(shapes()), ids=[n for n, _ in shapes()])
def test_same_as_union_find(spark, name, pairs):
    rows = [(i, u, v, None if i % 2 else -1.0) for i, (u, v) in enumerate(pairs)]
    got = [(r.group_name, r.record_name) for r in match_groups(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([("x", "a", "b", "y", 1)], "name string, src string, dst string, u string, id int")
    assert sorted(tuple(r) for r in match_groups(df).collect()) == [("a", "a"), ("a", "b")]
