"""Per-key totals of badly skewed keys by multi-level tree aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_aggregate(
    rows: DataFrame,
    keys: list[str],
    value: str,
    n_rows: int | None = None,
    chunk_rows_log2: int = 16,
    fan_in: int = 32,
) -> DataFrame:
    """Row count, count of values and value sum per key, without a reducer that gets all partials of a hot key.

    Rows of one input partition are cut into chunks of ``2**chunk_rows_log2``; a chunk never leaves
    its task, so Spark's partial aggregation folds it to one state per key before anything moves.
    Then rounds merge the states of ``fan_in`` neighbouring chunks each, until one state per key is
    left: a hot key's states are merged by many tasks, of which none gets more than ``fan_in`` times
    its share of states, in ``log(chunks) / log(fan_in)`` rounds.

    Null keys form a group of their own. Null values count as rows but not as values; a key without
    any value has a null sum. NaN values make their key's sum NaN, as in SQL. Whole and decimal numbers have exact sums of their kind. An
    empty input gives no rows. Up to ``fan_in`` chunks there is one round. ``n_rows`` (a count Parquet has in its footers) only sets the number of rounds.
    """
    if n_rows is None:
        n_rows = rows.count()
    # A partition's last chunk may be short, so chunks are numbered over partitions: at most this many ids.
    row_id = F.monotonically_increasing_id()
    part, index = F.shiftright(row_id, 33), row_id.bitwiseAND((1 << 33) - 1)
    # Chunk k of partition p goes to leaf (p + k * stride): any spread does, as merging is commutative.
    leaves = max(1, -(-n_rows // (1 << chunk_rows_log2)))
    leaf = F.pmod(F.xxhash64(part, F.shiftright(index, chunk_rows_log2)), F.lit(leaves))
    kind = dict(rows.dtypes)[value]
    # Whole and decimal numbers are summed as what they are, so no digit is lost; all else as doubles.
    exact = kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")
    v = F.col(value) if exact else F.col(value).cast("double")
    x = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], v.alias("_v"), leaf.alias("_leaf"))
    ks = [f"_k{i}" for i in range(len(keys))]
    rounds = max(1, math.ceil(math.log(leaves, fan_in) - 1e-9)) if leaves > 1 else 1
    state = None
    for _ in range(rounds):
        leaves = max(1, -(-leaves // fan_in))
        merged = F.pmod(F.col("_leaf"), F.lit(leaves)).alias("_leaf")
        if state is None:
            state = x.groupBy(*ks, merged).agg(F.count("*").alias("_n"), F.count("_v").alias("_m"), F.sum("_v").alias("_s"))
        else:
            state = state.groupBy(*ks, merged).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m"), F.sum("_s").alias("_s"))
    assert state is not None and leaves == 1
    return state.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_n").alias("n_rows"), F.col("_m").alias("n_values"), F.col("_s").alias("value_sum"))


def node_totals(edges: DataFrame, n_rows: int | None = None, **tree: int) -> DataFrame:
    """``side, node, n_rows, n_weighted, weight_sum`` for both ends of an edge table (src, dst, weight).

    A null end is counted under a null node, so each side's counts add up to the rows of the table.
    """
    n = edges.count() if n_rows is None else n_rows
    sides = [edges.select(F.lit(s).alias("side"), F.col(s).alias("node"), F.col("weight")) for s in ("src", "dst")]
    out = tree_aggregate(sides[0].unionByName(sides[1]), ["side", "node"], "weight", n_rows=2 * n, **tree)
    return out.select("side", "node", "n_rows", F.col("n_values").alias("n_weighted"), F.col("value_sum").alias("weight_sum"))


def hot_nodes(edges: DataFrame, share: float = 0.01, **tree: int) -> DataFrame:
    """``side, node`` of the non-null nodes in at least ``share`` of all rows, of which there are at most ``2 / share``."""
    n = edges.count()
    x = node_totals(edges, n_rows=n, **tree)
    return x.where(F.col("node").isNotNull() & (F.col("n_rows") >= F.lit(share * n))).select("side", "node")
