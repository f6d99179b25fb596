"""A query for each operator over the whole derived inputs, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions import math as fm
from ranksmith.operators import bandits, bootstrap, choice, consensus, counting, graph, odds, online, pairs, spectral, trajectories
from ranksmith.plans import base, iterated_sql
from ranksmith.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def scores(m, digits: int = 6) -> DataFrame:
    return m.table.select("entity", r("score", digits).alias("score"))


def fitted(name: str, op, data: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    query(name, sql)(lambda spark, d: scores(op.fit(data(spark, d)), digits))


# -- counting ----------------------------------------------------------------------------------------------------------

_TALLY = f"WITH {base.PW}, t AS (SELECT e, sum(w) w, sum(l) l FROM (SELECT w e, 1.0::DOUBLE w, 0.0::DOUBLE l FROM pw UNION ALL SELECT l, 0.0, 1.0 FROM pw) GROUP BY e) "
_WILSON = "(w + {zz} / 2) / (w + l + {zz}) {sign} {z} / (w + l + {zz}) * sqrt(w * l / (w + l) + {zz} / 4)"


def _wilson(z: float, sign: str = "+") -> str:
    return _WILSON.format(z=f"{z}::DOUBLE", zz=f"({z * z!r}::DOUBLE)", sign=sign)


for _conf, _z in (("P95", 1.96), ("P90", 1.645)):
    fitted(f"b1_win_rate_{_conf.lower()}", counting.WinRate(_conf), base.nation_pairs, _TALLY + f"SELECT e AS entity, round({_wilson(_z)}, 6) + 0.0 AS score FROM t")
fitted("b1_win_rate_p50", counting.WinRate("P50"), base.nation_pairs, _TALLY + "SELECT e AS entity, round(w / (w + l), 6) + 0.0 AS score FROM t")
fitted("b1_win_rate_lower", counting.WinRate("P95", "lower"), base.nation_pairs, _TALLY + f"SELECT e AS entity, round({_wilson(1.96, '-')}, 6) + 0.0 AS score FROM t")
fitted("b2_borda", counting.Borda(), base.nation_pairs, _TALLY + "SELECT e AS entity, w AS score FROM t")
fitted("b4_copeland", counting.Copeland(), base.nation_pairs, f"WITH {base.OP} SELECT a AS entity, CAST(sum(CASE WHEN ab > ba THEN 1.0 WHEN ab = ba THEN 0.5 ELSE 0 END) AS DOUBLE) AS score FROM dir GROUP BY a")


@query("b3_borda_rankings", f"WITH {base.BALLOT} SELECT n AS entity, CAST(sum(m - 1 - p) AS DOUBLE) AS score FROM ballot GROUP BY n")
def _(spark, d):
    return scores(counting.Borda().fit_rankings(base.nation_ballots(spark, d)))


@query("l10_tally", _TALLY + "SELECT e AS entity, CAST(w AS BIGINT) AS n_won, w AS w_won, CAST(l AS BIGINT) AS n_lost, l AS w_lost FROM t")
def _(spark, d):
    return pairs.tally(base.nation_pairs(spark, d))


for _dir, _sql in (("in", "SELECT d e, w FROM ed UNION ALL SELECT s, 0 FROM ed"), ("out", "SELECT s e, w FROM ed UNION ALL SELECT d, 0 FROM ed"), ("total", "SELECT d e, w FROM ed UNION ALL SELECT s, w FROM ed")):
    fitted(f"g6_degree_{_dir}", counting.Degree(_dir), base.edges, f"WITH {base.EDGE} SELECT e AS entity, round(sum(w), 6) + 0.0 AS score FROM ({_sql}) GROUP BY e")

# -- lowerings ---------------------------------------------------------------------------------------------------------

_GAMES_CTE = f"""{base.PW}, gm AS (SELECT (date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 10000000000 + pw.k) * 1000 + least(a.n_nationkey, b.n_nationkey) * 30 + greatest(a.n_nationkey, b.n_nationkey) seq,
  year(o_orderdate) * 12 + month(o_orderdate) period, c_mktsegment league, w, l, pw.cents / 100.0::DOUBLE m
  FROM pw JOIN orders ON pw.k = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON a.n_name = w JOIN nation b ON b.n_name = l)"""


@query("l1_to_pairwise", f"WITH {_GAMES_CTE} SELECT seq, period, w AS winner, l AS loser, 1.0::DOUBLE AS weight FROM gm")
def _(spark, d):
    return pairs.to_pairwise(base.nation_games(spark, d))


@query("l1_half_win", f"WITH {_GAMES_CTE} SELECT winner, loser, sum(x) AS weight FROM (SELECT w winner, l loser, CASE WHEN m < 100 THEN 0.5 ELSE 1.0 END::DOUBLE x FROM gm UNION ALL SELECT l, w, 0.5::DOUBLE FROM gm WHERE m < 100) GROUP BY 1, 2")
def _(spark, d):
    close = base.nation_games(spark, d).withColumn("margin", F.when(F.abs("margin") < 100, 0.0).otherwise(F.col("margin")))
    return pairs.to_pairwise(close, "half_win").groupBy("winner", "loser").agg(F.sum("weight").alias("weight"))


@query("l2_margin_pairs", f"WITH {_GAMES_CTE} SELECT seq, period, w AS winner, l AS loser, m AS weight FROM gm")
def _(spark, d):
    return pairs.margin_pairs(base.nation_games(spark, d))


@query("l3_to_matchups", f"WITH {_GAMES_CTE} SELECT seq, period, CASE WHEN w < l THEN 1 ELSE 2 END AS rank1, least(w, l) AS team1, CASE WHEN w < l THEN 2 ELSE 1 END AS rank2, greatest(w, l) AS team2 FROM gm")
def _(spark, d):
    t = F.col("teams")
    return pairs.to_matchups(base.nation_games(spark, d)).select("seq", "period", t[0]["rank"].alias("rank1"), t[0]["players"][0].alias("team1"), t[1]["rank"].alias("rank2"), t[1]["players"][0].alias("team2"))


_VOTE = "vt AS (SELECT seq, winner w, loser l, coalesce(weight, 1) x FROM annotated_pairs WHERE winner IS NOT NULL AND loser IS NOT NULL AND winner <> loser AND (weight IS NULL OR isfinite(weight)))"


@query("l4_from_pairwise", f"WITH {_VOTE} SELECT seq, w AS side1, l AS side2, 1.0::DOUBLE AS margin, x AS weight FROM vt")
def _(spark, d):
    g = pairs.from_pairwise(pairs.clean_pairs(base.votes(spark, d)))
    return g.select("seq", F.col("side1")[0].alias("side1"), F.col("side2")[0].alias("side2"), "margin", "weight")


@query("l6_as_graph", f"WITH {_VOTE} SELECT l AS src, w AS dst, count(*) AS n, round(sum(x), 6) + 0.0 AS weight FROM vt GROUP BY 1, 2")
def _(spark, d):
    return pairs.as_graph(pairs.clean_pairs(base.votes(spark, d))).groupBy("src", "dst").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query("l7_ballot_pairs", f"WITH {base.BALLOT} SELECT a.n AS winner, b.n AS loser, count(*) AS n FROM ballot a JOIN ballot b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2")
def _(spark, d):
    return pairs.ballots_to_pairwise(base.nation_ballots(spark, d)).groupBy("winner", "loser").agg(F.count("*").alias("n"))


def _min_count_sql(k: int, rounds: int = 12) -> str:
    """Removal unrolled: more rounds than any of the tables needs change nothing."""
    sql = f"WITH {_VOTE}, r0 AS MATERIALIZED (SELECT * FROM vt)"
    for i in range(rounds):
        sql += f", k{i} AS MATERIALIZED (SELECT e FROM (SELECT w e FROM r{i} UNION ALL SELECT l FROM r{i}) GROUP BY e HAVING count(*) >= {k}), r{i + 1} AS MATERIALIZED (SELECT * FROM r{i} WHERE w IN (SELECT e FROM k{i}) AND l IN (SELECT e FROM k{i}))"
    return sql + f" SELECT seq, w AS winner, l AS loser FROM r{rounds}"


@query("l8_filter_min_count", _min_count_sql(40))
def _(spark, d):
    return pairs.filter_min_count(pairs.clean_pairs(base.votes(spark, d)), 40).select("seq", "winner", "loser")


@query("l9_filter_min_count_games", _min_count_sql(40))
def _(spark, d):
    g = pairs.from_pairwise(pairs.clean_pairs(base.votes(spark, d)))
    return pairs.filter_min_count_games(g, 40).select("seq", F.col("side1")[0].alias("winner"), F.col("side2")[0].alias("loser"))


@query("l11_periods", "WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) b FROM orders) SELECT CAST(p AS INTEGER) AS period, count(*) AS n FROM (SELECT dense_rank() OVER (ORDER BY b) p FROM m) GROUP BY p")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderdate")
    return pairs.period_index(o, F.year("o_orderdate") * 12 + F.month("o_orderdate")).groupBy("period").agg(F.count("*").alias("n"))


@query("l12_adjacency", f"WITH {base.EDGE} SELECT s AS node, count(*) AS degree, min(d) AS first, max(d) AS last FROM ed GROUP BY s")
def _(spark, d):
    e = base.edges(spark, d).where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    n = F.col("neighbours")
    return pairs.out_adjacency(e).select("node", F.size(n).cast("long").alias("degree"), n[0]["node"].alias("first"), F.element_at(n, -1)["node"].alias("last"))


@query("l12_undirected_adjacency", f"WITH {base.EDGE} SELECT e AS node, count(*) AS entries FROM (SELECT s e FROM ed UNION ALL SELECT d FROM ed) GROUP BY e")
def _(spark, d):
    e = base.edges(spark, d).where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return pairs.undirected_adjacency(e).select("node", F.size("neighbours").cast("long").alias("entries"))


@query("s1_pair_table", f"WITH {base.OP} SELECT i, j, wi AS w_ij, wj AS w_ji, CAST(wi AS BIGINT) AS n_ij, CAST(wj AS BIGINT) AS n_ji FROM un")
def _(spark, d):
    return pairs.pair_table(base.nation_pairs(spark, d))


@query("s2_ordered_pairs", f"WITH {base.OP} SELECT w AS winner, l AS loser, x AS w, CAST(x AS BIGINT) AS n FROM op")
def _(spark, d):
    return pairs.ordered_pairs(base.nation_pairs(spark, d))


@query("s4_dense_ranks", _TALLY + "SELECT e AS entity, w AS score, CAST(row_number() OVER (ORDER BY w DESC, e) AS INTEGER) AS rank FROM t")
def _(spark, d):
    return consensus.dense_ranks(counting.Borda().fit(base.nation_pairs(spark, d)).table)


@query("s5_quantiles", f"WITH {base.REWARD} SELECT arm AS entity, round(quantile_cont(reward, 0.1), 6) + 0.0 AS q10, round(quantile_cont(reward, 0.5), 6) + 0.0 AS q50 FROM rw GROUP BY arm")
def _(spark, d):
    return base.rewards(spark, d).groupBy(F.col("arm").alias("entity")).agg(r(F.percentile("reward", F.lit(0.1))).alias("q10"), r(F.percentile("reward", F.lit(0.5))).alias("q50"))


@query("s8_suffix_sums", f"WITH {base.BALLOT}, u AS (SELECT k, p, n, sum(length(n)::DOUBLE) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) s FROM ballot) SELECT n AS entity, round(sum(1 / s), 6) + 0.0 AS total FROM u GROUP BY n")
def _(spark, d):
    b = base.nation_ballots(spark, d)
    g = table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.length("n_name").cast("double").alias("score"))
    return choice.suffix_sums(b, g).groupBy("entity").agg(r(F.sum(1 / F.col("suffix"))).alias("total"))


@query("s9_kendall_distance", f"WITH {base.BALLOT} SELECT a.k AS ballot_id, CAST(sum(CASE WHEN a.n > b.n THEN 1 ELSE 0 END) AS INTEGER) AS distance FROM ballot a JOIN ballot b ON a.k = b.k AND a.p < b.p GROUP BY a.k")
def _(spark, d):
    names = [x.n_name for x in table(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    return consensus.kendall_distance(base.nation_ballots(spark, d), names)


@query("l15_resample")
def _(spark, d):
    return bootstrap.resample(base.votes(spark, d), "votes", 7).groupBy("winner").agg(F.count("*").alias("n"))


# -- iterative pairwise rankers, with fixed rounds unrolled in SQL ---------------------------------------------------------


def unrolled(head: str, start: str, step: Callable[[str], str], rounds: int, last: str) -> str:
    """``start`` and ``step`` give ``e, x``; ``step`` and ``last`` get the table of the round before."""
    sql = f"WITH {head}, v0 AS MATERIALIZED ({start})"
    for k in range(rounds):
        sql += f", v{k + 1} AS MATERIALIZED ({step(f'v{k}')})"
    return sql + " " + last.replace("$V", f"v{rounds}")


_EVEN = "SELECT e, 1.0::DOUBLE / (SELECT count(*) FROM ent) x FROM ent"
_OUT = "SELECT e AS entity, round(x, 6) + 0.0 AS score FROM $V"


def _chain(head: str, arcs: str, rounds: int) -> str:
    """A chain with arcs (a, b, p) whose rows keep what is left."""
    return unrolled(
        f"{head}, arc AS MATERIALIZED ({arcs})", _EVEN,
        lambda v: f"SELECT e, sum(y) x FROM (SELECT b e, x * p y FROM arc JOIN {v} ON a = e UNION ALL SELECT e, x * (1 - coalesce((SELECT sum(p) FROM arc WHERE a = e), 0)) FROM {v}) GROUP BY e",
        rounds, _OUT)


fitted("b8_rank_centrality", spectral.RankCentrality(iterations=30, tolerance=0), base.nation_pairs, _chain(base.OP, "SELECT a, b, ba / (ab + ba) / (SELECT max(c) FROM (SELECT count(*) c FROM dir GROUP BY a)) p FROM dir", 30))
fitted("b9_random_walker", spectral.RandomWalker(iterations=30, tolerance=0), base.nation_pairs, _chain(base.OP, "SELECT a, b, (0.75 * ba + 0.25 * ab) / sum(ab + ba) OVER (PARTITION BY a) p FROM dir", 30))
fitted(
    "b10_keener", spectral.Keener(iterations=30, tolerance=0), base.nation_pairs,
    unrolled(
        f"{base.OP}, kn AS MATERIALIZED (SELECT a, b, (0.5 + 0.5 * sign(q - 0.5) * sqrt(abs(2 * q - 1))) / g f FROM (SELECT a, b, (ab + 1) / (ab + ba + 2) q, sum(ab + ba) OVER (PARTITION BY a) g FROM dir))", _EVEN,
        lambda v: f"SELECT e, y / sum(y) OVER () x FROM (SELECT a e, sum(f * x) y FROM kn JOIN {v} ON b = e GROUP BY a)", 30, _OUT))


@query(
    "b11_offense_defense",
    unrolled(f"{base.OP}", "SELECT e, 1.0::DOUBLE x, 0.0::DOUBLE o FROM ent",
             lambda v: f"SELECT q.l e, sum(q.x / o.o) x, any_value(z.o) o FROM op q JOIN (SELECT w, sum(op.x / {v}.x) o FROM op JOIN {v} ON l = e GROUP BY w) o ON q.w = o.w JOIN (SELECT w, sum(op.x / {v}.x) o FROM op JOIN {v} ON l = e GROUP BY w) z ON z.w = q.l GROUP BY q.l", 8,
             "SELECT e AS entity, round(o, 3) + 0.0 AS offense, round(x, 5) + 0.0 AS defense, round(o / x, 4) + 0.0 AS score FROM $V"),
)
def _(spark, d):
    m = spectral.OffenseDefense(iterations=8, tolerance=0).fit(base.nation_pairs(spark, d))
    return m.table.select("entity", r("offense", 3).alias("offense"), r("defense", 5).alias("defense"), r("score", 4).alias("score"))


fitted(
    "b7_lsr", spectral.Lsr(), base.nation_pairs,
    unrolled(f"{base.OP}, ch AS MATERIALIZED (SELECT l a, w b, x / sum(x) OVER (PARTITION BY l) p FROM op)", _EVEN,
             lambda v: f"SELECT e, (y + 1e-8) / sum(y + 1e-8) OVER () x FROM (SELECT b e, sum(x * p) y FROM ch JOIN {v} ON a = e GROUP BY b)", 10,
             "SELECT e AS entity, round(s - avg(s) OVER (), 6) + 0.0 AS score FROM (SELECT e, ln(x / sqrt(dg)) s FROM $V JOIN (SELECT l, sum(x) / 2 dg FROM op GROUP BY l) ON l = e)"))

_MM = unrolled(
    f"{base.OP}, won AS (SELECT w, sum(x) t FROM op GROUP BY w)", _EVEN,
    lambda v: f"SELECT e, y / sum(y) OVER () x FROM (SELECT a e, any_value(t) / sum((ab + ba) / (p.x + q.x)) y FROM dir JOIN {v} p ON a = p.e JOIN {v} q ON b = q.e JOIN won ON won.w = a GROUP BY a)",
    12, _OUT)


@query("a1_bradley_terry_mm", _MM)
def _(spark, d):
    return scores(spectral.BradleyTerryMM(iterations=12, tolerance=0).fit(base.nation_pairs(spark, d)))


@query("a1_bradley_terry_mm_distributed", _MM)
def _(spark, d):
    x = spectral.mm_distributed(base.nation_pairs(spark, d), 12)
    return x.select("entity", r("score").alias("score"))


fitted(
    "h1_mc4", spectral.Mc4(iterations=40, tolerance=0), base.nation_ballots,
    unrolled(
        f"{base.BALLOT}, op AS (SELECT a.n w, b.n l, count(*)::DOUBLE x FROM ballot a JOIN ballot b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2), ent AS (SELECT DISTINCT n e FROM ballot), arc AS MATERIALIZED (SELECT p.l a, p.w b, 1.0::DOUBLE / (SELECT count(*) FROM ent) p FROM op p LEFT JOIN op q ON p.w = q.l AND p.l = q.w WHERE p.x > coalesce(q.x, 0))", _EVEN,
        lambda v: f"SELECT e, 0.85 * sum(y) + 0.15 / (SELECT count(*) FROM ent) x FROM (SELECT b e, x * p y FROM arc JOIN {v} ON a = e UNION ALL SELECT e, x * (1 - coalesce((SELECT sum(p) FROM arc WHERE a = e), 0)) FROM {v}) GROUP BY e", 40, _OUT))


_LR = unrolled(
    base.OP, "SELECT e, 0.0::DOUBLE x FROM ent",
    lambda v: f"SELECT e, n - 1e-5 * n / sqrt(sum(n * n) OVER ()) x FROM (SELECT {v}.e, any_value({v}.x) + sum(g) n FROM {v} JOIN (SELECT w e, x / (SELECT sum(x) FROM op) / (1 + exp(a - b)) g FROM (SELECT op.w, op.x, p.x a, q.x b FROM op JOIN {v} p ON op.w = p.e JOIN {v} q ON op.l = q.e) UNION ALL SELECT l, -x / (SELECT sum(x) FROM op) / (1 + exp(a - b)) FROM (SELECT op.l, op.x, p.x a, q.x b FROM op JOIN {v} p ON op.w = p.e JOIN {v} q ON op.l = q.e)) gr USING (e) GROUP BY {v}.e)",
    10, _OUT)
fitted("a2_bradley_terry_lr", choice.BradleyTerryLR(), base.nation_pairs, _LR)

# -- rankers that SQL can't follow: rows here, published vectors and equivalences in the tests ------------------------------

for _name, _op, _data in (
    ("a8_ilsr", spectral.ILsr(), base.nation_pairs),
    ("b13_colley", spectral.Colley(), base.nation_pairs),
    ("b14_hodge_rank", spectral.HodgeRank(), base.nation_pairs),
    ("b15_serial_rank", spectral.SerialRank(iterations=5000, tolerance=0), base.nation_pairs),
    ("b7_lsr_monte_carlo", spectral.Lsr(estimator="monte-carlo"), base.nation_pairs),
    ("a5_thurstone", choice.ThurstoneMosteller(), base.nation_pairs),
    ("a6_es_rum", choice.EsRum(), base.nation_pairs),
    ("a10_bayes_bt", choice.BayesianBradleyTerry(), base.nation_pairs),
    ("a13_blade_chest", choice.BladeChest(), base.nation_pairs),
    ("a14_nash_averaging", choice.NashAveraging(), base.nation_pairs),
    ("b5_kemeny", consensus.Kemeny(passes=10), base.nation_pairs),
    ("b6_kemeny_evolution", consensus.Kemeny(passes=4000, algo="evolution"), base.nation_pairs),
    ("a7_plackett_luce", choice.PlackettLuce(), base.nation_ballots),
    ("h2_footrule", consensus.Footrule(), base.nation_ballots),
    ("a3_generalized_bt", choice.GeneralizedBt(home=True, ties="none"), base.nation_games),
    ("a4_team_bt", choice.TeamBradleyTerry(), base.nation_games),
):
    fitted(_name, _op, _data)


@query("a3_generalized_bt_ties")
def _(spark, d):
    close = base.nation_games(spark, d).withColumn("margin", F.when(F.abs("margin") < 100, 0.0).otherwise(F.col("margin")))
    return scores(choice.GeneralizedBt().fit(close))


@query("a8_ilsr_rankings")
def _(spark, d):
    return scores(spectral.ILsr().fit_rankings(base.nation_ballots(spark, d)))


@query("b12_massey")
def _(spark, d):
    return scores(spectral.Massey().fit(pairs.margin_pairs(base.nation_games(spark, d))), 4)


@query("a9_mallows")
def _(spark, d):
    # All ballots must rank one set: each customer segment's and year's order of all nations by what they won, those without a game at nothing.
    x = base.nation_games(spark, d).select("league", "period", F.explode(F.array(F.struct(F.col("side1")[0].alias("n"), F.col("margin").alias("m")), F.struct(F.col("side2")[0].alias("n"), (-F.col("margin")).alias("m")))).alias("r"))
    x = x.groupBy("league", F.floor(F.col("period") / 12).alias("y"), "r.n").agg(F.sum("r.m").alias("m"))
    x = x.groupBy("league", "y").agg(F.map_from_entries(F.collect_list(F.struct("n", "m"))).alias("won"))
    names = [r.n_name for r in table(spark, d, "nation").select("n_name").collect()]
    best = F.array_sort(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.struct((-F.coalesce(F.try_element_at("won", n), F.lit(0.0))).alias("m"), n.alias("n"))))
    b = x.select(F.concat_ws("/", "league", "y").alias("ballot_id"), F.transform(best, lambda v: v["n"]).alias("items"))
    return scores(consensus.Mallows().fit(b))


@query("a11_covariate_bt")
def _(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    n = table(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    f = n.select(F.col("n_name").alias("entity"), F.array(F.coalesce("a", F.lit(0.0)) / 1000, F.coalesce("n", F.lit(0)) / 100.0).alias("x"))
    return scores(choice.CovariateBt().fit(base.nation_pairs(spark, d), f))


@query("a12_crowd_bt")
def _(spark, d):
    m = choice.CrowdBt().fit(base.votes(spark, d))
    return m.table.select("side", "entity", r("score", 4).alias("score"))


@query("m1_bootstrap")
def _(spark, d):
    m = bootstrap.Bootstrap(bootstrap.ranker_solver(spectral.BradleyTerryMM()), replicates=100).fit(base.nation_pairs(spark, d))
    return m.table.select("entity", r("score").alias("score"), "rank", r("lower").alias("lower"), r("upper").alias("upper"), "rank_lower", "rank_upper")


# -- online ------------------------------------------------------------------------------------------------------------

for _name, _op, _data in (("c1_elo", online.Elo(), base.nation_games), ("c2_elo_mov", online.MovElo(), base.nation_games), ("c5_melo", online.MElo(), base.nation_games), ("c4_weng_lin", online.WengLin(), base.nation_matches), ("c4_weng_lin_tm", online.WengLin(variant="thurstone-mosteller"), base.nation_matches)):
    query(_name)(lambda spark, d, op=_op, data=_data: op.fit(data(spark, d)).table.select("league", "entity", r("score").alias("score")))


@query("c3_glicko2")
def _(spark, d):
    m = online.Glicko2().fit(base.nation_games(spark, d).withColumn("period", F.floor(F.col("period") / 12)))
    return m.table.select("entity", r("rating", 4).alias("rating"), r("rd", 4).alias("rd"), r("sigma").alias("sigma"))


@query("c6_whr")
def _(spark, d):
    m = online.Whr().fit(pairs.to_pairwise(base.nation_games(spark, d)))
    return m.table.select("entity", "period", r("rating", 2).alias("rating"), r("sd", 2).alias("sd"))


# -- graph -------------------------------------------------------------------------------------------------------------

_N = "(SELECT count(*) FROM nd)"


def _pagerank_sql(sink: str, rounds: int = 10) -> str:
    arcs = "SELECT s, d FROM ed"
    if sink == "reverse":
        arcs += " UNION ALL SELECT d, s FROM ed WHERE d NOT IN (SELECT s FROM ed)"
    head = f"{base.EDGE}, arc AS MATERIALIZED (SELECT s, d, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) p FROM ({arcs})), sk AS MATERIALIZED (SELECT e FROM nd WHERE e NOT IN (SELECT s FROM ed))"
    lost = {"uniform": lambda v: f" + (SELECT coalesce(sum(x), 0) FROM {v} WHERE e IN (SELECT e FROM sk)) / {_N}", "all": lambda v: f" + ((SELECT coalesce(sum(x), 0) FROM {v} WHERE e IN (SELECT e FROM sk)) - CASE WHEN {v}.e IN (SELECT e FROM sk) THEN {v}.x ELSE 0 END) / ({_N} - 1)"}.get(sink, lambda v: "")
    return unrolled(head, f"SELECT e, 1.0::DOUBLE / {_N} x FROM nd", lambda v: f"SELECT {v}.e, 0.15::DOUBLE / {_N} + 0.85 * (coalesce(y, 0){lost(v)}) x FROM {v} LEFT JOIN (SELECT d e, sum(x * p) y FROM arc JOIN {v} ON s = e GROUP BY d) i ON i.e = {v}.e", rounds, "SELECT e AS entity, round(x, 9) + 0.0 AS score FROM $V")


for _sink in ("reverse", "all", "uniform", "none"):
    fitted(f"g1_page_rank_{_sink}", graph.PageRank(sink=_sink), base.edges, _pagerank_sql(_sink), 9)

# The ground's weight is a row of its own in SQL.
fitted(
    "g2_leader_rank", graph.LeaderRank(iterations=15, tolerance=0), base.edges,
    unrolled(
        f"{base.EDGE}, a0 AS (SELECT s, d FROM ed UNION ALL SELECT e, chr(0) FROM nd UNION ALL SELECT chr(0), e FROM nd), arc AS MATERIALIZED (SELECT s, d, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) p FROM a0)",
        "SELECT e, 1.0::DOUBLE x FROM nd UNION ALL SELECT chr(0), 0.0",
        lambda v: f"SELECT d e, sum(x * p) x FROM arc JOIN {v} ON s = e GROUP BY d", 15,
        f"SELECT e AS entity, round(x + (SELECT x FROM $V WHERE e = chr(0)) / {_N}, 6) + 0.0 AS score FROM $V WHERE e <> chr(0)"))


def _hits_sql(rounds: int) -> str:
    sql = f"WITH {base.EDGE}, h0 AS MATERIALIZED (SELECT e, 1.0::DOUBLE / {_N} x FROM nd)"
    unit = "SELECT nd.e, coalesce(y, 0) / sum(y) OVER () x FROM nd LEFT JOIN ({}) i ON i.e = nd.e"
    for k in range(rounds):
        into_d = f"SELECT d e, sum(x) y FROM ed JOIN h{k} ON s = e GROUP BY d"
        into_s = f"SELECT s e, sum(x) y FROM ed JOIN a{k + 1} ON d = e GROUP BY s"
        sql += f", a{k + 1} AS MATERIALIZED ({unit.format(into_d)}), h{k + 1} AS MATERIALIZED ({unit.format(into_s)})"
    return sql + f" SELECT a.e AS entity, round(a.x, 8) + 0.0 AS authority, round(h.x, 8) + 0.0 AS hub FROM a{rounds} a JOIN h{rounds} h ON a.e = h.e"


@query("g3_hits", _hits_sql(10))
def _(spark, d):
    m = graph.Hits(iterations=10, tolerance=0).fit(base.edges(spark, d))
    return m.table.select("entity", r("authority", 8).alias("authority"), r("hub", 8).alias("hub"))


fitted("g4_katz", graph.Katz(alpha=1e-5, iterations=10, tolerance=0), base.edges, unrolled(base.EDGE, "SELECT e, 1.0::DOUBLE x FROM nd", lambda v: f"SELECT nd.e, 1 + coalesce(y, 0) x FROM nd LEFT JOIN (SELECT d e, sum(1e-5 * w * x) y FROM ed JOIN {v} ON s = e GROUP BY d) i ON i.e = nd.e", 10, "SELECT e AS entity, round(x - 1, 8) + 0.0 AS score FROM $V"), 8)


@query("g1_page_rank_seeds")
def _(spark, d):
    e = base.edges(spark, d)
    nodes = graph.Graph(e, "seeds").nodes
    seeds = nodes.where(F.col("entity").endswith("3")).select("entity", F.length("entity").alias("weight"))
    return scores(graph.PageRank(sink="uniform").fit(e, seeds))


def _supply(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("src"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("dst"))
    return x.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", F.lit(1.0).alias("weight"))


@query("g5_birank_priors")
def _(spark, d):
    prior = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("entity")).agg((F.count("*") / 1000).alias("score"))
    # Half of each round comes from the priors, so the start is forgotten.
    return graph.BiRank(iterations=30, beta=0.5).fit(_supply(spark, d), src_prior=prior).table.select("side", "entity", r("score", 5).alias("score"))


@query("g5_birank")
def _(spark, d):
    return graph.BiRank().fit(_supply(spark, d)).table.select("side", "entity", r("score").alias("score"))


def _harmonic_sql(rounds: int) -> str:
    sql = f"WITH {base.EDGE}, ar AS (SELECT DISTINCT s, d FROM ed WHERE s <> d), f0 AS MATERIALIZED (SELECT e q, e FROM nd), z0 AS MATERIALIZED (SELECT q, e, 0 k FROM f0)"
    for k in range(rounds):
        sql += f", f{k + 1} AS MATERIALIZED (SELECT DISTINCT q, d e FROM f{k} JOIN ar ON s = e EXCEPT SELECT q, e FROM z{k}), z{k + 1} AS MATERIALIZED (SELECT * FROM z{k} UNION ALL SELECT q, e, {k + 1} FROM f{k + 1})"
    return sql + f" SELECT e AS entity, round(sum(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END), 6) + 0.0 AS score FROM z{rounds} GROUP BY e"


@query("g7_harmonic")
def _(spark, d):
    return scores(graph.Harmonic().fit(base.edges(spark, d)))


@query("g7_harmonic_lengths")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("src"))
    to = n.select(F.col("k").alias("k2"), F.col("src").alias("dst"))
    e = n.withColumn("k2", F.explode(F.array_distinct(F.array((F.col("k") + 1) % 25, (F.col("k") * 7) % 25)))).join(to, "k2").where("k <> k2")
    return scores(graph.Harmonic(cost="weight").fit(e.select("src", "dst", (1.0 + (F.col("k") * 5 + F.col("k2")) % 7).alias("weight"))))


@query("g7_harmonic_sample16")
def _(spark, d):
    return scores(graph.Harmonic(sample=16).fit(base.edges(spark, d)))


@query("g7_harmonic_nations", _harmonic_sql(9).replace("FROM graph_edges WHERE", "FROM (SELECT a.n_name src, b.n_name dst, 1.0::DOUBLE weight FROM nation a JOIN nation b ON (a.n_nationkey + 1) % 25 = b.n_nationkey OR (a.n_nationkey * 7) % 25 = b.n_nationkey) WHERE"))
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("src"))
    to = n.select(F.col("k").alias("k2"), F.col("src").alias("dst"))
    e = n.withColumn("k2", F.explode(F.array_distinct(F.array((F.col("k") + 1) % 25, (F.col("k") * 7) % 25)))).join(to, "k2")
    x = graph.Harmonic().fit(e.select("src", "dst", F.lit(1.0).alias("weight")))
    return scores(x)


fitted("g8_k_core", graph.KCore(), base.edges)


@query("g9_components")
def _(spark, d):
    x = table(spark, d, "match_links").select("src", "dst", F.lit(1.0).alias("weight"))
    return graph.extract_components(x)


# -- trajectories ------------------------------------------------------------------------------------------------------

_RET = f"WITH {base.STEP}, rt AS (SELECT episode_id, step, state, sum(reward) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) g FROM st)"
_FIRST = _RET + ", fv AS (SELECT episode_id, state, arg_min(g, step) g FROM rt GROUP BY 1, 2)"


def _value(m) -> DataFrame:
    return m.table.select("entity", r("score", 4).alias("score"), "n")


query("t1_mc_value", _FIRST + " SELECT state AS entity, round(avg(g), 4) + 0.0 AS score, count(*) AS n FROM fv GROUP BY state")(lambda spark, d: _value(trajectories.McValue().fit(base.steps(spark, d))))
query("t1_mc_value_every_median", _RET + " SELECT state AS entity, round(quantile_cont(g, 0.5), 4) + 0.0 AS score, count(*) AS n FROM rt GROUP BY state")(lambda spark, d: _value(trajectories.McValue(visit="every", aggregate="median").fit(base.steps(spark, d))))
query("t1_mc_value_winsorized", _FIRST + ", q AS (SELECT state, quantile_cont(g, 0.05) lo, quantile_cont(g, 0.95) hi FROM fv GROUP BY 1) SELECT state AS entity, round(avg(greatest(least(g, hi), lo)), 4) + 0.0 AS score, count(*) AS n FROM fv JOIN q USING (state) GROUP BY state")(lambda spark, d: _value(trajectories.McValue(winsorize=0.05).fit(base.steps(spark, d))))
query("t1_mc_value_discounted", f"WITH {base.STEP}, o AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step) i FROM st), rt AS (SELECT a.episode_id, a.state, a.i, sum(b.reward * pow(0.9, b.i - a.i)) g FROM o a JOIN o b ON a.episode_id = b.episode_id AND b.i >= a.i GROUP BY 1, 2, 3), fv AS (SELECT episode_id, state, arg_min(g, i) g FROM rt GROUP BY 1, 2) SELECT state AS entity, round(avg(g), 4) + 0.0 AS score, count(*) AS n FROM fv GROUP BY state")(lambda spark, d: _value(trajectories.McValue(gamma=0.9).fit(base.steps(spark, d))))


@query("t2_td_value")
def _(spark, d):
    return online.TdValue().fit(base.steps(spark, d).withColumn("seq", F.col("step").cast("long"))).table.select("entity", r("score", 4).alias("score"), "n")


@query("t3_value_compare")
def _(spark, d):
    m = trajectories.ValueCompare().fit(base.steps(spark, d))
    return m.table.select("entity", r("score", 2).alias("score"), r("lower", 2).alias("lower"), r("upper", 2).alias("upper"), "n", "n_rep")


@query("t3_value_pairs")
def _(spark, d):
    op = trajectories.ValueCompare()
    return op.pairs(op.fit(base.steps(spark, d))).select("a", "b", r("diff", 2).alias("diff"), r("p_b_above_a", 4).alias("p_b_above_a"))


query("t4_behavior_cloning", f"WITH {base.STEP} SELECT state AS entity, round((count(*) + 0.5) / (SELECT count(*) + 0.5 * count(DISTINCT state) FROM st), 6) + 0.0 AS score, count(*) AS n FROM st GROUP BY state")(lambda spark, d: trajectories.BehaviorCloning(smoothing=0.5).fit(base.steps(spark, d)).table.select("entity", r("score").alias("score"), "n"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.col("o_orderkey").alias("episode_id"), F.lit(0).alias("step"), F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("state"), F.lit(0.0).alias("reward"))


_TOK = "tk AS (SELECT c_mktsegment g, o_orderpriority a, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
query("t4_behavior_cloning_per_state", f"WITH {_TOK} SELECT concat(g, '|', a) AS entity, round(n / sum(n) OVER (PARTITION BY g), 6) + 0.0 AS score, n FROM tk")(lambda spark, d: trajectories.BehaviorCloning(sep="|").fit(_tokens(spark, d)).table.select("entity", r("score").alias("score"), "n"))
query("l14_implied_pairs", f"WITH {_TOK} SELECT x.a AS winner, y.a AS loser, CAST(sum(x.n - y.n) AS DOUBLE) AS weight FROM tk x JOIN tk y ON x.g = y.g AND x.n > y.n GROUP BY 1, 2")(lambda spark, d: trajectories.BehaviorCloning(sep="|").implied_pairs(_tokens(spark, d)))

# -- bandits -----------------------------------------------------------------------------------------------------------

_ARM = f"WITH {base.REWARD}, am AS (SELECT arm, count(*) n, sum(reward) t FROM rw GROUP BY arm)"
_INDEX = {"greedy": "t / n", "epsilon-greedy": "t / n", "ucb1": "t / n + sqrt(2 * ln((SELECT sum(n) FROM am)::DOUBLE) / n)", "thompson-beta": "(1 + t) / (2 + n)", "thompson-gaussian": "t / (1 + n)"}
for _policy in bandits.policies():
    _sql = _ARM + f" SELECT arm AS entity, n, round({_INDEX[_policy]}, 6) + 0.0 AS score FROM am" if _policy in _INDEX else None
    query(f"e_bandit_{_policy.replace('-', '_')}", _sql)(lambda spark, d, p=_policy: bandits.Bandit(p).fit(base.rewards(spark, d)).table.select("entity", "n", r("score").alias("score")))


@query("e1_bandit_state", _ARM + ", sq AS (SELECT arm, sum(reward * reward) s FROM rw GROUP BY arm) SELECT arm AS entity, n, round(t, 4) + 0.0 AS total, round(s, 4) + 0.0 AS squares FROM am JOIN sq USING (arm)")
def _(spark, d):
    return bandits.arm_sums(base.rewards(spark, d)).select("entity", "n", r("total", 4).alias("total"), r("squares", 4).alias("squares"))


@query("e1_bandit_merged", _ARM + " SELECT arm AS entity, n, round(t / n, 6) + 0.0 AS score FROM am")
def _(spark, d):
    x, op = base.rewards(spark, d), bandits.Bandit("greedy")
    m = op.merge(op.fit(x.where("seq % 3 = 0")), op.fit(x.where("seq % 3 <> 0")))
    return m.table.select("entity", "n", r("score").alias("score"))


@query("e9_sliding_window_ucb", f"WITH {base.REWARD}, lw AS (SELECT * FROM rw ORDER BY seq DESC LIMIT 1000) SELECT arm AS entity, count(*) AS n, round(avg(reward) + sqrt(2 * ln(least((SELECT count(*) FROM rw), 1000)::DOUBLE) / count(*)), 6) + 0.0 AS score FROM lw GROUP BY arm")
def _(spark, d):
    return bandits.SlidingWindowUcb().fit(base.rewards(spark, d)).table.select("entity", "n", r("score").alias("score"))


@query("e10_lin_ucb_sums", "SELECT l_returnflag AS entity, count(*) AS n, round(sum(l_discount * l_tax), 4) + 0.0 AS a12, round(sum(l_discount * l_discount), 4) + 0.0 AS a11, round(sum(l_quantity / 50 * l_tax), 4) + 0.0 AS b2 FROM lineitem GROUP BY 1")
def _(spark, d):
    x = bandits.LinUcb().sums(base.contexts(spark, d))
    return x.select("entity", "n", r(F.col("a")[5], 4).alias("a12"), r(F.col("a")[4], 4).alias("a11"), r(F.col("b")[2], 4).alias("b2"))


fitted("e10_lin_ucb", bandits.LinUcb(), base.contexts)


@query("e11_dueling_scores", f"WITH {base.OP} SELECT a AS entity, round(avg(CASE WHEN ab > ba THEN 1.0 ELSE 0.0 END::DOUBLE), 6) + 0.0 AS score FROM dir GROUP BY a")
def _(spark, d):
    op = bandits.DuelingBandit()
    return op.scores(op.fit(base.nation_pairs(spark, d))).select("entity", r("score").alias("score"))


@query("e12_top_arms", _ARM + " SELECT arm AS entity, round(t / n, 6) + 0.0 AS score FROM am ORDER BY t / n DESC, arm LIMIT 3")
def _(spark, d):
    return bandits.Bandit("greedy").fit(base.rewards(spark, d)).top(3).select("entity", r("score").alias("score"))


# -- odds, forecasts, stakes -------------------------------------------------------------------------------------------

_ODDS = "WITH cc AS (SELECT n_regionkey g, n_name o, count(*) c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), oo AS (SELECT g, o, sum(c) OVER (PARTITION BY g) / (c * 1.05::DOUBLE) q FROM cc), od AS (SELECT g, o, 1 / q r, sum(1 / q) OVER (PARTITION BY g) b, count(*) OVER (PARTITION BY g) k FROM oo WHERE q > 1)"
for _method, _sql in (("multiplicative", "r / b"), ("additive", "r - (b - 1) / k"), ("power", None), ("shin", None)):
    _full = _ODDS + f" SELECT g AS event_id, o AS outcome, round({_sql}, 6) + 0.0 AS prob, round(b, 6) + 0.0 AS booksum FROM od" if _sql else None
    query(f"f1_devig_{_method}", _full)(lambda spark, d, m=_method: odds.OddsDevig(m).fit(base.nation_odds(spark, d)).table.select("event_id", "outcome", r("prob").alias("prob"), r("booksum").alias("booksum")))

_FC = "WITH fc AS (SELECT c_mktsegment s, o_orderstatus o, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), pf AS (SELECT s, o, n::DOUBLE / sum(n) OVER (PARTITION BY s) p, sum(n) OVER (PARTITION BY s)::DOUBLE w FROM fc), wt AS (SELECT sum(w) t FROM (SELECT DISTINCT s, w FROM pf))"
query("f2_pool_linear", _FC + ", g AS (SELECT o, sum(w / t * p) v FROM pf, wt GROUP BY o) SELECT o AS entity, round(v / sum(v) OVER (), 6) + 0.0 AS score FROM g")(lambda spark, d: scores(odds.OpinionPool("linear").fit(base.segment_forecasts(spark, d))))
query("f2_pool_logarithmic", _FC + ", g AS (SELECT o, exp(2 * sum(w / t * ln(p))) v FROM pf, wt GROUP BY o) SELECT o AS entity, round(v / sum(v) OVER (), 6) + 0.0 AS score FROM g")(lambda spark, d: scores(odds.OpinionPool("logarithmic", extremize=2.0).fit(base.segment_forecasts(spark, d))))
query("f3_lmsr", "WITH q AS (SELECT event_type o, sum((CAST(round(value * 100) AS BIGINT) % 7 - 3)::DOUBLE) s FROM events GROUP BY 1), z AS (SELECT o, s, exp((s - max(s) OVER ()) / 100) v FROM q) SELECT o AS entity, s AS shares, round(v / sum(v) OVER (), 6) + 0.0 AS score FROM z")(lambda spark, d: odds.Lmsr().fit(base.trades(spark, d)).table.select("entity", "shares", r("score").alias("score")))


@query("f4_kelly", "SELECT p_partkey, round(greatest(((1 + p_size) / 52.0::DOUBLE * (p_retailprice / 1000 + 1) - 1) / (p_retailprice / 1000), 0), 6) + 0.0 AS kelly, round(0.25 * greatest(((1 + p_size) / 52.0::DOUBLE * (p_retailprice / 1000 + 1) - 1) / (p_retailprice / 1000), 0), 6) + 0.0 AS quarter, round(p_retailprice / 1000 - 1, 6) + 0.0 AS clv FROM part")
def _(spark, d):
    p, b = (1 + F.col("p_size")) / F.lit(52.0), F.col("p_retailprice") / 1000
    return table(spark, d, "part").select("p_partkey", r(fm.kelly_fraction(p, b)).alias("kelly"), r(fm.fractional_kelly(p, b, F.lit(0.25))).alias("quarter"), r(fm.closing_line_value(F.col("p_retailprice"), F.lit(1000.0))).alias("clv"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity") / 51).alias("p"), (F.col("l_returnflag") == "R").alias("outcome"))


_CALL = "WITH cl AS (SELECT l_quantity / 51 p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE o FROM lineitem)"
query("f7_brier", _CALL + " SELECT round(avg((p - o) * (p - o)), 6) + 0.0 AS brier FROM cl")(lambda spark, d: odds.brier_score(_calls(spark, d)).select(r("brier").alias("brier")))
query("f8_log_loss", _CALL + " SELECT round(avg(CASE WHEN o > 0 THEN -ln(p) ELSE -ln(1 - p) END), 6) + 0.0 AS log_loss FROM cl")(lambda spark, d: odds.log_loss(_calls(spark, d)).select(r("log_loss").alias("log_loss")))
query("f10_calibration", _CALL + " SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(mp, 6) + 0.0 AS mean_p, round(rt, 6) + 0.0 AS rate FROM range(10) t(b) LEFT JOIN (SELECT least(floor(p * 10), 9) b, count(*) n, avg(p) mp, avg(o) rt FROM cl GROUP BY 1) USING (b)")(lambda spark, d: odds.calibration_table(_calls(spark, d)).select("bin", "n", r("mean_p").alias("mean_p"), r("rate").alias("rate")))


@query("f6_portfolio_kelly")
def _(spark, d):
    # One bet for each order priority: how often such orders are finished, at a price that grows with the priority.
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("p")).orderBy("o_orderpriority")
    bets = [(x.o_orderpriority, x.p, 1.5 + 0.25 * k) for k, x in enumerate(o.collect())]
    stakes = odds.portfolio_kelly([p for _, p, _ in bets], [b for _, _, b in bets])
    return spark.createDataFrame([(name, float(v)) for (name, _, _), v in zip(bets, stakes, strict=True)], "bet string, stake double").select("bet", r("stake", 4).alias("stake"))


# -- scalar functions --------------------------------------------------------------------------------------------------


def _horner(cs, x: str) -> str:
    out = repr(float(cs[0])) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


_T = f"(1 / (1 + {fm.ERF_P} * abs(x) * sqrt(0.5::DOUBLE)))"
_CDF = f"(1 + sign(x) * (1 - {_horner([*reversed(fm.ERF_A), 0.0], _T)} * exp(-x * x / 2))) / 2"
_Q = "sqrt(-2 * ln({}))"


def _tail(q: str) -> str:
    return f"{_horner(fm.PPF_C, q)} / {_horner([*fm.PPF_D, 1.0], q)}"


_PPF = f"CASE WHEN p < {fm.PPF_LOW} THEN {_tail(_Q.format('p'))} WHEN p > 1 - {fm.PPF_LOW} THEN -({_tail(_Q.format('1 - p'))}) ELSE {_horner(fm.PPF_A, '((p - 0.5) * (p - 0.5))')} * (p - 0.5) / {_horner([*fm.PPF_B, 1.0], '((p - 0.5) * (p - 0.5))')} END"


@query("x2_normal_functions", f"WITH n AS (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE x, p_size / 51.0::DOUBLE p FROM part) SELECT p_partkey, round(exp(-x * x / 2) / sqrt(2 * pi()), 8) + 0.0 AS pdf, round({_CDF}, 8) + 0.0 AS cdf, round({_PPF}, 8) + 0.0 AS ppf, round(1 / (1 + exp(-x)), 8) + 0.0 AS sigmoid, round(1 / (1 + pow(10, -x / 400)), 8) + 0.0 AS expected FROM n")
def _(spark, d):
    n = table(spark, d, "part").select("p_partkey", ((F.col("p_size") - 25) / F.lit(8.0)).alias("x"), (F.col("p_size") / F.lit(51.0)).alias("p"))
    x = F.col("x")
    return n.select("p_partkey", r(fm.norm_pdf(x), 8).alias("pdf"), r(fm.norm_cdf(x), 8).alias("cdf"), r(fm.norm_ppf(F.col("p")), 8).alias("ppf"), r(fm.sigmoid(x), 8).alias("sigmoid"), r(fm.expected_score(x, F.lit(0.0)), 8).alias("expected"))


@query("x5_logsumexp", "WITH u AS (SELECT l_orderkey k, l_quantity x FROM lineitem), m AS (SELECT k, max(x) t FROM u GROUP BY k) SELECT k AS l_orderkey, round(any_value(t) + ln(sum(exp(x - t))), 6) + 0.0 AS lse FROM u JOIN m USING (k) GROUP BY k")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", r(fm.logsumexp(F.col("q"))).alias("lse"))


ORACLE.update(iterated_sql.ORACLE)
