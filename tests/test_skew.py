"""Per-key totals by tree aggregation, lookups with hot keys, and degenerate tables."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ranksmith.operators.tree_aggregate import hot_nodes, node_totals, tree_aggregate
from ranksmith.session import hot_keys, lookup

SCHEMA = "seq long, src string, dst string, weight double"


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0.0])
    for _, s, d, w in rows:
        for side, n in (("src", s), ("dst", d)):
            t = out[side, n]
            t[0] += 1
            if w is not None:
                t[1] += 1
                t[2] += w
    return {k: (v[0], v[1], v[2] if v[1] else None) for k, v in out.items()}


@pytest.mark.parametrize(("log2", "fan"), [(2, 2), (3, 4), (16, 32)])
def test_totals(spark, log2, fan):
    rows = [(i, "hub" if i % 3 else f"n{i % 17}", None if i % 11 == 0 else f"m{i % 5}", None if i % 7 == 0 else float(i % 4 - 1)) for i in range(500)] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.side, r.node): (r.n_rows, r.n_weighted, r.weight_sum) for r in node_totals(df, chunk_rows_log2=log2, fan_in=fan).collect()}
    assert got == brute(rows)


def test_rounds_follow_the_fan_in(spark):
    df = spark.range(4096).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    x = tree_aggregate(df, ["k"], "v", chunk_rows_log2=4, fan_in=4)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 4  # 256 chunks, a quarter each round
    assert x.first().value_sum == 4095 * 4096 / 2


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert node_totals(empty).count() == 0 and hot_nodes(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None)] * 3, SCHEMA)
    assert {(r.side, r.node, r.n_rows, r.weight_sum) for r in node_totals(nulls).collect()} == {("src", None, 3, None), ("dst", None, 3, None)}
    assert hot_nodes(nulls).count() == 0


def test_whole_and_decimal_sums_are_exact(spark):
    df = spark.createDataFrame([("k", (1 << 53) + 1)] * 3, "k string, v long")
    assert tree_aggregate(df, ["k"], "v", chunk_rows_log2=1, fan_in=2).first().value_sum == 3 * ((1 << 53) + 1)
    assert str(tree_aggregate(df.select("k", F.lit("0.1").cast("decimal(20,1)").alias("v")), ["k"], "v").first().value_sum) == "0.3"


def test_hot_share_counts_all_rows(spark):
    rows = [(i, "a" if i < 2 else f"n{i}", None, 1.0) for i in range(200)]
    assert {tuple(r) for r in hot_nodes(spark.createDataFrame(rows, SCHEMA)).collect()} == {("src", "a")}


def test_extra_columns(spark):
    df = spark.createDataFrame([("x", 1, "a", "b", 2.0)], "node string, n_rows int, src string, dst string, weight double")
    assert sorted(tuple(r) for r in node_totals(df).collect()) == [("dst", "b", 1, 1, 2.0), ("src", "a", 1, 1, 2.0)]


def test_lookup_spreads_hot_and_null_keys(spark):
    big = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(1000)], "i long, k string")
    values = spark.createDataFrame([("hot", 1), *((f"k{i}", 10 + i) for i in range(5))], "k string, v int")
    hot = hot_keys(big, "k", 1000, "k")
    got = {r.i: r.v for r in lookup(big, "k", values, "k", "v", "v", hot).collect()}
    want = dict(values.collect())
    assert got == {r.i: want.get(r.k) for r in big.collect()} and len(got) == 1000
    assert {r.i: r.v for r in lookup(big, "k", values, "k", "v", "v", None).collect()} == got
