"""Queries over the graph and games tables: skewed totals and broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.plans import iterated_sql
from ranksmith.operators.tree_aggregate import hot_nodes, node_totals
from ranksmith.session import table
from ranksmith.sources.games_lines import broken_lines, valid_games


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_nodes(table(spark, d, "graph_edges"))


def p2_node_totals(spark: SparkSession, d: str) -> DataFrame:
    x = node_totals(table(spark, d, "graph_edges"))
    return x.withColumn("weight_sum", F.round("weight_sum", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_lines(table(spark, d, "games_raw")).select("file_name", "line_no")


def p3_broken_lines(spark: SparkSession, d: str) -> DataFrame:
    return broken_lines(table(spark, d, "games_raw")).select("file_name", "line_no", "broken_field", "reason")


def p3_valid_games(spark: SparkSession, d: str) -> DataFrame:
    x = valid_games(table(spark, d, "games_raw"))
    return x.select("file_name", "line_no", F.array_join("side1", " ").alias("side1"), F.array_join("side2", " ").alias("side2"), "threshold", "count")


_NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"

#: What a valid game is, step by step: fields, quotes, players, numbers.
_GAMES = f"""
WITH l AS (SELECT file_name, line_no, trim(raw_line, ' ' || chr(9) || chr(13)) s FROM games_raw),
f AS (SELECT *, [trim(x, ' ') for x in string_split(s, chr(9))] fs FROM l WHERE s IS NULL OR s <> ''),
q AS (SELECT *, list_bool_and([CASE WHEN x[1] = '"' THEN regexp_full_match(x, '"([^"]|"")*"') ELSE NOT contains(x, '"') END for x in fs]) quoted FROM f),
v AS (SELECT *, CASE WHEN quoted AND len(fs) BETWEEN 3 AND 4 THEN [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END for x in fs] END vs FROM q),
p AS (SELECT *, [y for y in string_split(vs[1], ' ') if y <> ''] s1, [y for y in string_split(vs[2], ' ') if y <> ''] s2,
  CASE WHEN regexp_full_match(vs[3], '{_NUM}') THEN try_cast(vs[3] AS DOUBLE) END t,
  CASE WHEN vs[4] IS NULL THEN CAST(1 AS DOUBLE) WHEN regexp_full_match(vs[4], '{_NUM}') THEN try_cast(vs[4] AS DOUBLE) END c FROM v),
g AS (SELECT *, coalesce(vs IS NOT NULL AND len(s1) > 0 AND len(s2) > 0 AND len(list_distinct(s1 || s2)) = len(s1 || s2)
  AND t IS NOT NULL AND isfinite(t) AND c IS NOT NULL AND isfinite(c) AND c > 0, false) ok FROM p)
"""

_SIDES = "SELECT 'src' side, src node, weight FROM graph_edges UNION ALL SELECT 'dst', dst, weight FROM graph_edges"

QUERIES = {"p2_found": p2_found, "p2_node_totals": p2_node_totals, "p3_found": p3_found, "p3_broken_lines": p3_broken_lines, "p3_valid_games": p3_valid_games}

ORACLE = {
    "p2_found": f"""SELECT side, node FROM ({_SIDES}) GROUP BY side, node
        HAVING node IS NOT NULL AND count(*) >= 0.01 * (SELECT count(*) FROM graph_edges)""",
    "p2_node_totals": f"""SELECT side, node, count(*) AS n_rows, count(weight) AS n_weighted, round(sum(weight), 6) AS weight_sum
        FROM ({_SIDES}) GROUP BY side, node""",
    "p3_found": _GAMES + "SELECT file_name, line_no FROM g WHERE NOT ok",
    "p3_broken_lines": iterated_sql.broken_lines(_GAMES, _NUM),
    "p3_valid_games": _GAMES + "SELECT file_name, line_no, array_to_string(s1, ' ') AS side1, array_to_string(s2, ' ') AS side2, t AS threshold, c AS count FROM g WHERE ok",
}
