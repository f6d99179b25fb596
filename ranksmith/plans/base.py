"""Inputs of the operator queries, derived from the test tables, and the same in SQL.

Any two nations that supply an order play a game, which the larger revenue wins; the nations of an order by revenue are a ballot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.session import table


def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """``k, r``: each order with its nations ``n`` and their ``cents``, an array of at most as many as there are nations."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    x = x.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    # An order has a handful of lines, so partial sums would save nothing: one shuffle by order serves both aggregations.
    x = x.select("k", "n_name", "cents").repartition("k")
    x = x.groupBy("k", F.col("n_name").alias("n")).agg(F.sum("cents").alias("cents"))
    return x.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "cents"))).alias("r"))


def nation_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``k, winner, loser, weight, cents``: one row per game, weight 1, cents the difference."""
    x = order_revenue(spark, d).where(F.size("r") > 1)
    x = x.select("k", F.posexplode("r").alias("i", "a"), "r")
    x = x.select("k", "a", F.explode(F.expr("slice(r, i + 2, greatest(size(r) - i - 1, 0))")).alias("b")).where("a.cents <> b.cents")
    first = F.col("a.cents") > F.col("b.cents")
    return x.select("k", F.when(first, F.col("a.n")).otherwise(F.col("b.n")).alias("winner"), F.when(first, F.col("b.n")).otherwise(F.col("a.n")).alias("loser"), F.lit(1.0).alias("weight"), F.abs(F.col("a.cents") - F.col("b.cents")).alias("cents"))


def nation_games(spark: SparkSession, d: str) -> DataFrame:
    """``seq, period, league, side1, side2, margin, weight``: nations by name on the sides; league is the customer's market segment."""
    p = nation_pairs(spark, d)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    x = p.join(o, p["k"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, d, "nation")
    first = F.col("winner") < F.col("loser")
    x = x.join(n.select(F.col("n_name").alias("winner"), F.col("n_nationkey").alias("wn")), "winner").join(n.select(F.col("n_name").alias("loser"), F.col("n_nationkey").alias("ln")), "loser")
    day = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    seq = (day * 10_000_000_000 + F.col("k")) * 1000 + F.least("wn", "ln") * 30 + F.greatest("wn", "ln")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    margin = F.when(first, F.col("cents")).otherwise(-F.col("cents")) / F.lit(100.0)
    return x.select(seq.alias("seq"), month.alias("period"), F.col("c_mktsegment").alias("league"), F.array(F.least("winner", "loser")).alias("side1"), F.array(F.greatest("winner", "loser")).alias("side2"), margin.alias("margin"), F.lit(1.0).alias("weight"))


def nation_ballots(spark: SparkSession, d: str) -> DataFrame:
    """``ballot_id, items``: the nations of each order of two or more, by revenue and then by name."""
    x = order_revenue(spark, d).where(F.size("r") > 1)
    best = F.array_sort(F.transform("r", lambda v: F.struct((-v["cents"]).alias("c"), v["n"].alias("n"))))
    return x.select(F.col("k").alias("ballot_id"), F.transform(best, lambda v: v["n"]).alias("items"))


def nation_matches(spark: SparkSession, d: str) -> DataFrame:
    """``seq, teams``: the ballots as matches, ranked by revenue (equal revenue, equal rank)."""
    x = order_revenue(spark, d).where(F.size("r") > 1)
    rank = lambda v: F.size(F.filter("r", lambda o: o["cents"] > v["cents"])) + 1
    return x.select(F.col("k").alias("seq"), F.transform("r", lambda v: F.struct(rank(v).alias("rank"), F.array(v["n"]).alias("players"))).alias("teams"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges").select("src", "dst", "weight")


def votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "annotated_pairs").select("seq", "annotator", "winner", "loser", "weight")


def rewards(spark: SparkSession, d: str) -> DataFrame:
    """``seq, arm, reward``: events, with rewards of at most 1."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("arm"), F.least(F.col("value") / 500, F.lit(1.0)).alias("reward"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("arm"), (F.col("l_quantity") / 50).alias("reward"), F.array(F.lit(1.0), F.col("l_discount"), F.col("l_tax")).alias("x"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """``episode_id, step, state, reward``: a user's events of a day, whole numbers of cents as rewards."""
    e = table(spark, d, "events")
    episode = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return e.select(episode.alias("episode_id"), F.col("event_id").alias("step"), F.col("event_type").alias("state"), F.round(F.col("value") * 100).alias("reward"))


def nation_odds(spark: SparkSession, d: str) -> DataFrame:
    """``event_id, outcome, odds``: per region the nations' shares of customers, with five per cent on top."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    x = n.join(c, n["n_nationkey"] == c["c_nationkey"])
    t = x.groupBy("n_regionkey").agg(F.sum("c").alias("t"))
    x = x.join(t, "n_regionkey")
    return x.select(F.col("n_regionkey").alias("event_id"), F.col("n_name").alias("outcome"), (F.col("t") / (F.col("c") * F.lit(1.05))).alias("odds")).where("odds > 1")


def segment_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """``source, weight, outcome, prob``: the order states each market segment's orders lead one to expect."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("source"), F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    t = x.groupBy("source").agg(F.sum("n").alias("weight"))
    return x.join(t, "source").select("source", F.col("weight").cast("double").alias("weight"), "outcome", (F.col("n") / F.col("weight")).alias("prob"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("outcome"), (F.round(F.col("value") * 100).cast("long") % 7 - 3).cast("double").alias("shares"))


# -- the same in SQL ---------------------------------------------------------------------------------------------------

NAT = """nat AS (SELECT l_orderkey k, n_name n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) cents
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey, n_name)"""
PW = f"""{NAT},
pw AS (SELECT a.k, CASE WHEN a.cents > b.cents THEN a.n ELSE b.n END w, CASE WHEN a.cents > b.cents THEN b.n ELSE a.n END l, abs(a.cents - b.cents) cents
  FROM nat a JOIN nat b ON a.k = b.k AND a.n < b.n WHERE a.cents <> b.cents)"""
BALLOT = f"""{NAT},
bal AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY cents DESC, n) - 1 p, count(*) OVER (PARTITION BY k) m FROM nat),
ballot AS (SELECT * FROM bal WHERE m > 1)"""
OP = f"""{PW},
op AS (SELECT w, l, CAST(count(*) AS DOUBLE) x FROM pw GROUP BY w, l),
un AS (SELECT least(w, l) i, greatest(w, l) j, sum(CASE WHEN w < l THEN x ELSE 0 END) wi, sum(CASE WHEN w < l THEN 0 ELSE x END) wj FROM op GROUP BY 1, 2),
ent AS (SELECT DISTINCT w e FROM op UNION SELECT l FROM op),
dir AS (SELECT i a, j b, wi ab, wj ba FROM un UNION ALL SELECT j, i, wj, wi FROM un)"""
EDGE = """ed AS (SELECT src s, dst d, sum(coalesce(weight, 1)) w, count(*) n FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND (weight IS NULL OR isfinite(weight)) GROUP BY 1, 2),
nd AS (SELECT s e FROM ed UNION SELECT d FROM ed)"""
REWARD = "rw AS (SELECT event_id seq, event_type arm, least(value / 500, 1) reward FROM events)"
STEP = """st AS (SELECT concat(CAST(user_id AS VARCHAR), '/', strftime(ts, '%Y%m%d')) episode_id, event_id step, event_type state, round(value * 100) reward FROM events)"""
