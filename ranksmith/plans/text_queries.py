"""Each reader and writer over whole tables: the table is written as text in the format, read back, and compared with SQL on the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksmith.model import Model
from ranksmith.operators import counting, graph, trajectories
from ranksmith.plans import base, data_queries, iterated_sql
from ranksmith.session import Scratch, table
from ranksmith.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def folder(spark: SparkSession) -> str:
    """A place of its own in the shared folder, gone with the process."""
    return Scratch(spark, "text").base


def written(df: DataFrame, line: Column, *order: str) -> str:
    """The path of text files with a line for each row, in order over all files."""
    path = folder(df.sparkSession)
    df.orderBy(*order).select(line.alias("value")).write.text(path)
    return path


def in_blocks(df: DataFrame, line: Column, block: str, *order: str) -> str:
    """The same with an empty line before each block; a block is in one file."""
    path = folder(df.sparkSession)
    first = F.row_number().over(Window.partitionBy(block).orderBy(*order)) == 1
    x = df.select(block, *order, F.when(first, F.concat(F.lit("\n"), line)).otherwise(line).alias("value"))
    x.repartitionByRange(block).sortWithinPartitions(block, *order).select("value").write.text(path)
    return path


def tabs(*c: str | Column) -> Column:
    return F.concat_ws("\t", *c)


def spaces(*c: str | Column) -> Column:
    return F.concat_ws(" ", *c)


@query("r1_read_games", f"WITH {iterated_sql._GAMES} SELECT row_number() OVER (ORDER BY seq) AS seq, n1 AS side1, n2 AS side2, m AS margin, 1.0::DOUBLE AS weight FROM gm")
def _(spark, d):
    g = base.nation_games(spark, d)
    x = readers.read_games(spark, written(g, tabs(F.col("side1")[0], F.col("side2")[0], "margin", "weight"), "seq"))
    return x.select("seq", F.col("side1")[0].alias("side1"), F.col("side2")[0].alias("side2"), "margin", "weight")


@query("r1_read_games_periods", data_queries._GAMES + """, b AS (SELECT file_name, line_no, ok, fs, coalesce(s, '') = '' e FROM (SELECT l.file_name, l.line_no, l.s, g.ok, g.t fs, g.c FROM l LEFT JOIN g USING (file_name, line_no))),
  k AS (SELECT *, coalesce(lag(e) OVER w, true) p FROM b WHERE e OR ok WINDOW w AS (PARTITION BY file_name ORDER BY line_no)),
  n AS (SELECT *, sum(CASE WHEN p AND NOT e THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY line_no) q FROM k)
  SELECT file_name, CAST(q AS INTEGER) AS period, count(*) AS n, round(sum(fs), 4) + 0.0 AS margins FROM n WHERE NOT e GROUP BY 1, 2""")
def _(spark, d):
    path = folder(spark)
    x = table(spark, d, "games_raw").select("file_name", "line_no", F.col("raw_line").alias("value"))
    x.repartitionByRange("file_name").sortWithinPartitions("file_name", "line_no").select("value", "file_name").write.partitionBy("file_name").text(path)
    g = readers.read_games(spark, path, periods=True, strict=False)
    return g.groupBy(F.regexp_extract("file", "file_name=([^/]+)", 1).alias("file_name"), "period").agg(F.count("*").alias("n"), r(F.sum("margin"), 4).alias("margins"))


@query("r2_read_graph", "SELECT src, dst, count(*) AS n, round(sum(weight), 6) + 0.0 AS weight FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    e = base.edges(spark, d).where("src IS NOT NULL AND dst IS NOT NULL AND weight IS NOT NULL")
    return readers.read_graph(spark, written(e, spaces("src", "dst", "weight"), "src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query("r3_read_rankings", f"WITH {base.BALLOT}, a AS (SELECT k, string_agg(n, ' ' ORDER BY p) items FROM ballot GROUP BY k) SELECT row_number() OVER (ORDER BY k) - 1 AS ballot_id, items FROM a")
def _(spark, d):
    b = base.nation_ballots(spark, d)
    return readers.read_rankings(spark, written(b, F.array_join("items", " "), "ballot_id")).select("ballot_id", F.array_join("items", " ").alias("items"))


_COMPLETE = "annotator IS NOT NULL AND winner IS NOT NULL AND loser IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight)"


@query("r4_read_annotated", f"SELECT annotator, winner, loser, count(*) AS n, round(sum(weight), 6) + 0.0 AS weight FROM annotated_pairs WHERE {_COMPLETE} GROUP BY ALL")
def _(spark, d):
    v = base.votes(spark, d).where(_COMPLETE)
    return readers.read_annotated(spark, written(v, spaces("annotator", "winner", "loser", "weight"), "seq")).groupBy("annotator", "winner", "loser").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("weight"))


@query("r5_read_matchups", f"WITH {base.NAT}, t AS (SELECT k, n, rank() OVER (PARTITION BY k ORDER BY cents DESC) AS rank, count(*) OVER (PARTITION BY k) m FROM nat) SELECT dense_rank() OVER (ORDER BY k) - 1 AS seq, CAST(rank AS INTEGER) AS rank, n AS player FROM t WHERE m > 1")
def _(spark, d):
    m = base.nation_matches(spark, d).withColumn("t", F.array_sort("teams"))
    sign = lambda t, i: F.when(i == 0, "").when(F.get("t", i - 1)["rank"] == t["rank"], " = ").otherwise(" | ")
    line = F.array_join(F.transform("t", lambda t, i: F.concat(sign(t, i), t["players"][0])), "")
    x = readers.read_matchups(spark, written(m, line, "seq")).select("seq", F.explode("teams").alias("t"))
    return x.select("seq", F.col("t.rank").cast("int").alias("rank"), F.col("t.players")[0].alias("player"))


@query("r6_read_rewards", f"WITH {base.REWARD} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, arm, round(reward, 6) + 0.0 AS reward FROM rw")
def _(spark, d):
    return readers.read_rewards(spark, written(base.rewards(spark, d), spaces("arm", "reward"), "seq")).select("seq", "arm", r("reward").alias("reward"))


@query("r7_read_seeds", "SELECT n_name AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE n_nationkey / 4.0 END::DOUBLE AS weight FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return readers.read_seeds(spark, written(n, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(spaces("n_name", F.col("n_nationkey") / 4)), "n_nationkey"))


@query("r8_read_features", "SELECT concat('c', c_custkey) AS entity, c_acctbal AS x1, c_nationkey::DOUBLE AS x2 FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    x = readers.read_features(spark, written(c, spaces(F.concat(F.lit("c"), "c_custkey"), "c_acctbal", "c_nationkey"), "c_custkey"))
    return x.select("entity", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query("r9_read_contextual", "SELECT l_returnflag AS arm, round(l_quantity / 50, 6) + 0.0 AS reward, l_discount AS x2, l_tax AS x3, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    c = base.contexts(spark, d)
    x = readers.read_contextual(spark, written(c, spaces("arm", "reward", F.col("x")[0], F.col("x")[1], F.col("x")[2]), "seq"))
    return x.groupBy("arm", r("reward").alias("reward"), F.col("x")[1].alias("x2"), F.col("x")[2].alias("x3")).agg(F.count("*").alias("n"))


@query("r10_read_trajectories", f"WITH {base.STEP}, n AS (SELECT episode_id, count(*) k FROM st GROUP BY 1) SELECT state, k AS steps, count(*) AS n, round(sum(reward), 2) + 0.0 AS reward FROM st JOIN n USING (episode_id) GROUP BY 1, 2")
def _(spark, d):
    x = readers.read_trajectories(spark, in_blocks(base.steps(spark, d), spaces("state", "reward"), "episode_id", "step"))
    n = x.groupBy("episode_id").agg(F.count("*").alias("steps"))
    return x.join(n, "episode_id").groupBy("state", "steps").agg(F.count("*").alias("n"), r(F.sum("reward"), 2).alias("reward"))


@query("r11_read_odds", f"WITH {iterated_sql._ODDS} SELECT o AS outcome, round(1 / r, 6) + 0.0 AS odds, round(b, 6) + 0.0 AS booksum FROM od")
def _(spark, d):
    x = readers.read_odds(spark, in_blocks(base.nation_odds(spark, d), spaces("outcome", "odds"), "event_id", "outcome"))
    return x.select("outcome", r("odds").alias("odds"), r(F.sum(1 / F.col("odds")).over(Window.partitionBy("event_id"))).alias("booksum"))


_FC = "WITH fc AS (SELECT c_mktsegment s, o_orderstatus o, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("r12_read_forecasts", _FC + " SELECT s AS source, 1.0::DOUBLE AS weight, o AS outcome, round(n::DOUBLE / sum(n) OVER (PARTITION BY s), 6) + 0.0 AS prob FROM fc")
def _(spark, d):
    x = readers.read_forecasts(spark, written(base.segment_forecasts(spark, d), spaces("source", "outcome", "prob"), "source", "outcome"))
    return x.select("source", "weight", "outcome", r("prob").alias("prob"))


@query("r13_read_market", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, event_type AS outcome, (CAST(round(value * 100) AS BIGINT) % 7 - 3)::DOUBLE AS shares FROM events")
def _(spark, d):
    return readers.read_market(spark, written(base.trades(spark, d), spaces("outcome", "shares"), "seq")).select("seq", "outcome", "shares")


@query("r14_read_kelly", "SELECT concat('p', p_partkey) AS name, round((1 + p_size) / 52.0::DOUBLE, 6) + 0.0 AS p, round(p_retailprice / 1000, 6) + 0.0 AS odds FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    line = spaces(F.concat(F.lit("p"), "p_partkey"), (1 + F.col("p_size")) / 52, F.col("p_retailprice") / 1000)
    return readers.read_kelly(spark, written(p, line, "p_partkey")).select("name", r("p").alias("p"), r("odds").alias("odds"))


@query("r14_read_clv", "SELECT concat('p', p_partkey) AS label, p_retailprice AS taken, 1000.0::DOUBLE AS closing FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return readers.read_clv(spark, written(p, spaces(F.concat(F.lit("p"), "p_partkey"), "p_retailprice", F.lit(1000)), "p_partkey")).select("label", "taken", "closing")


@query("r15_read_calibration", "SELECT round(l_quantity / 51, 6) + 0.0 AS p, l_returnflag = 'R' AS outcome, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    x = table(spark, d, "lineitem")
    word = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "WIN").otherwise("true")).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "Loss").otherwise("0"))
    y = readers.read_calibration(spark, written(x, spaces(F.col("l_quantity") / 51, word), "l_orderkey", "l_linenumber"))
    return y.groupBy(r("p").alias("p"), "outcome").agg(F.count("*").alias("n"))


@query("r16_dataset", "SELECT seq, annotator, winner, loser, weight FROM annotated_pairs WHERE weight IS NULL OR NOT isnan(weight)")
def _(spark, d):
    path = folder(spark)
    readers.save_dataset(base.votes(spark, d).where("weight IS NULL OR NOT isnan(weight)"), "annotated", path)
    return readers.load_dataset(spark, path, "annotated")


_TALLY = f"WITH {base.PW}, t AS (SELECT e, sum(w) w FROM (SELECT w e, 1.0::DOUBLE w FROM pw UNION ALL SELECT l, 0.0 FROM pw) GROUP BY e) SELECT e AS entity, w AS score FROM t"


@query("r17_state", _TALLY)
def _(spark, d):
    path = folder(spark)
    counting.Borda().fit(base.nation_pairs(spark, d)).save(path)
    return Model.load(spark, path, "borda").table.select("entity", "score")


@query("w1_text", _TALLY.replace("SELECT e AS entity, w AS score FROM t", "SELECT row_number() OVER (ORDER BY w DESC, e) - 1 AS line, e AS entity, w AS score FROM t"))
def _(spark, d):
    path = folder(spark)
    writers.write_text(counting.Borda().fit(base.nation_pairs(spark, d)), path)
    x = readers.numbered_lines(spark, path)
    return x.select(F.col("seq").alias("line"), F.regexp_extract("line", "^(.*): ", 1).alias("entity"), F.regexp_extract("line", ": (.*)$", 1).cast("double").alias("score"))


@query("w7_jsonl", _TALLY)
def _(spark, d):
    path = folder(spark)
    writers.write_jsonl(counting.Borda().fit(base.nation_pairs(spark, d)), path)
    return spark.read.json(path).select("entity", F.col("score").cast("double").alias("score"))


@query("w9_components", iterated_sql.ORACLE["g9_components"].replace("SELECT c AS component, size, v AS entity FROM cc JOIN nr USING (g)", "SELECT CAST(c AS INTEGER) AS component, count(*) AS edges FROM match_links JOIN cc ON v = src JOIN nr USING (g) WHERE dst IS NOT NULL GROUP BY c"))
def _(spark, d):
    path = folder(spark)
    e = table(spark, d, "match_links").select("src", "dst", F.lit(1.0).alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL")
    writers.write_components_by(graph.extract_components(e), e, path)
    return spark.read.parquet(path).groupBy("component").agg(F.count("*").alias("edges"))


@query("w10_implied_pairs", "WITH tk AS (SELECT c_mktsegment g, o_orderpriority a, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT x.a AS winner, y.a AS loser, CAST(sum(x.n - y.n) AS DOUBLE) AS weight FROM tk x JOIN tk y ON x.g = y.g AND x.n > y.n GROUP BY 1, 2")
def _(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    tokens = x.select(F.col("o_orderkey").alias("episode_id"), F.lit(0).alias("step"), F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("state"), F.lit(0.0).alias("reward"))
    p = trajectories.BehaviorCloning(sep="|").implied_pairs(tokens)
    g = readers.read_games(spark, written(writers.implied_pair_lines(p), F.col("value"), "value"))
    return g.select(F.array_join("side1", " ").alias("winner"), F.array_join("side2", " ").alias("loser"), F.col("weight"))
