"""Ratings, bandits, values, odds, streams: published vectors, and updates in parts equal to one fit."""

import math

import numpy as np
import pytest

from ranksmith.functions import sql
from ranksmith.model import InvalidInput, Model, NumericError, ParamMismatch
from ranksmith.operators import bandits, odds, online, pairs, trajectories
from ranksmith.streaming.online import StateTable, keyed_fold, session_episodes, stream_updates

GAME = "seq long, period int, league string, side1 array<string>, side2 array<string>, margin double, weight double"


def games(spark, rows):
    return spark.createDataFrame([(i, p, "l", [a], [b], float(m), 1.0) for i, (p, a, b, m) in enumerate(rows)], GAME)


@pytest.fixture(scope="module")
def season(spark):
    rng = np.random.default_rng(5)
    return games(spark, [(i // 20, *(f"p{k}" for k in rng.choice(6, 2, replace=False)), rng.integers(-3, 4)) for i in range(120)])


def test_glicko2_published(spark):
    op = online.Glicko2()
    state = spark.createDataFrame([("1", 1500.0, 200.0, 0.06), ("2", 1400.0, 30.0, 0.06), ("3", 1550.0, 100.0, 0.06), ("4", 1700.0, 300.0, 0.06)], op._schema)
    from ranksmith.model import params_of

    m = op.update(Model("glicko2", params_of(op), state), games(spark, [(1, "1", "2", 1), (1, "1", "3", -1), (1, "1", "4", -1)]))
    r = m.table.where("entity = '1'").first()
    assert abs(r.rating - 1464.06) < 0.01 and abs(r.rd - 151.52) < 0.01 and abs(r.sigma - 0.05999) < 1e-4


def test_weng_lin_published(spark):
    def rate(teams, **kw):
        df = spark.createDataFrame([(1, teams)], "seq long, teams array<struct<rank:int,players:array<string>>>")
        return {r.entity: (r.mu, r.sigma) for r in online.WengLin(**kw).fit(df).table.collect()}

    two = rate([(1, ["w"]), (2, ["l"])])
    assert two["w"] == pytest.approx((27.63523138347365, 8.065506316323548)) and two["l"] == pytest.approx((22.36476861652635, 8.065506316323548))
    five = rate([(i, [str(i)]) for i in range(1, 6)])
    assert [five[str(i)][0] for i in range(1, 6)] == pytest.approx([35.5409255338946, 30.2704627669473, 25.0, 19.729537233052703, 14.4590744661054])
    assert five["1"][1] == pytest.approx(7.202515895247076)
    t = rate([(1, ["a1", "a2", "a3"]), (2, ["b1"]), (3, ["c1", "c2"])])
    assert t["a1"] == pytest.approx((25.992743915179297, 8.19709997489984)) and t["b1"] == pytest.approx((28.48909130001799, 8.220848339985736)) and t["c2"] == pytest.approx((20.518164784802714, 8.127515465304823))
    tm = rate([(1, ["w"]), (2, ["l"])], variant="thurstone-mosteller")
    assert tm["w"] == pytest.approx((29.230718708993216, 7.630934718709003), abs=1e-4)
    with pytest.raises(Exception, match="no player twice"):
        rate([(1, ["a"]), (2, ["a"])])


@pytest.mark.parametrize("variant", ["thurstone-mosteller", "bradley-terry"])
def test_weng_lin_of_millions_of_pairs(monkeypatch, variant):
    op = online.WengLin(variant=variant, tau=0.2)
    teams = [(2, ["a", "b"]), (1, ["c"]), (3, ["d"]), (4, ["e", "f"])]
    state = {p: [20.0 + 3 * k, 8.0 - k] for k, p in enumerate("abcde")}
    want = {p: [m, math.hypot(d, op.tau)] for p, (m, d) in (state | {"f": [op.mu, op.sigma]}).items()}
    # Each side of each pair by itself, as the papers have it.
    sums = [(sum(want[p][0] for p in t), sum(want[p][1] ** 2 for p in t)) for _, t in teams]
    moves = []
    for (rank, _), (m, v) in zip(teams, sums):
        omega = delta = 0.0
        for (other, _), (mq, vq) in zip(teams, sums):
            if other != rank:
                c = math.sqrt(v + vq + 2 * op.beta**2)
                if variant == "bradley-terry":
                    p = 1 / (1 + math.exp((mq - m) / c))
                    x, y = (other > rank) - p, p * (1 - p)
                else:
                    x, y = op._shift((m - mq) / c, op.epsilon / c, 1 if other > rank else -1)
                omega, delta = omega + v / c * x, delta + math.sqrt(v) / c * v / c**2 * y
        moves.append((omega, delta))
    for (_, t), (_, v), (omega, delta) in zip(teams, sums, moves):
        for p in t:
            m, d = want[p]
            want[p] = [m + d * d / v * omega, d * math.sqrt(max(1 - d * d / v * delta, op.kappa))]
    # A decided pair makes no array of its one number: that alone took a hundred times as long.
    monkeypatch.setattr(online, "np_norm_cdf", None)
    op.step(state, {"t": [{"r": r, "p": p} for r, p in teams]})
    assert state.keys() == want.keys()
    for p in want:
        assert state[p] == pytest.approx(want[p], abs=1e-12)


def test_weng_lin_draws_and_teams_in_one_batch(spark):
    op = online.WengLin(variant="thurstone-mosteller")
    schema = "league string, seq long, teams array<struct<rank:int,players:array<string>>>"
    rows = [("x", 1, [(1, ["a"]), (1, ["b"]), (2, ["c"])]), ("x", 2, [(2, ["a", "b"]), (1, ["c"])]), ("y", 1, [(1, ["b"]), (2, ["a"])]), ("y", 2, [(1, ["b"]), (2, ["a"]), (2, ["c"])])]
    want: dict = {"x": {}, "y": {}}
    for league, _, teams in rows:
        op.step(want[league], {"t": [{"r": r, "p": p} for r, p in teams]})
    # Batches of single players and of teams are read in different ways.
    for m in (op.fit(spark.createDataFrame(rows, schema)), op.update(op.fit(spark.createDataFrame(rows[:1] + rows[2:], schema)), spark.createDataFrame(rows[1:2], schema))):
        got = {(r.league, r.entity): list(r.state) for r in m.table.collect()}
        assert got == {(g, e): s for g, x in want.items() for e, s in x.items()}
    assert want["x"]["a"] != want["x"]["c"]


def test_elo_by_hand_and_in_parts(spark, season):
    op = online.Elo()
    state = {}
    for r in season.orderBy("seq").collect():
        a, b = (state.setdefault(s[0], 1500.0) for s in (r.side1, r.side2))
        d = 32 * ((r.margin > 0) + (r.margin == 0) / 2 - 1 / (1 + 10 ** ((b - a) / 400)))
        state[r.side1[0]], state[r.side2[0]] = a + d, b - d
    whole = {r.entity: r.score for r in op.fit(season).table.collect()}
    assert whole == pytest.approx(state)
    parts = op.update(op.fit(season.where("seq < 50")), season.where("seq >= 50"))
    assert {r.entity: r.score for r in parts.table.collect()} == pytest.approx(whole)
    with pytest.raises(ParamMismatch):
        online.Elo(k=16).update(parts, season)
    m = online.MElo(init_scale=0.0)
    zero = {r.entity: r.score for r in m.fit(season).table.collect()}
    assert len(zero) == 6 and abs(sum(zero.values())) < 1e-9
    asked = spark.createDataFrame([("l", "p0", "p1")], "league string, a string, b string")
    assert 0 < online.MElo.predict(m.fit(season), asked).first().p < 1
    assert {r.entity for r in online.MovElo().fit(season).table.collect()} == set(whole)


def test_leagues_do_not_mix(spark, season):
    from pyspark.sql import functions as F

    both = season.unionByName(season.withColumn("league", F.lit("m")))
    rows = online.Elo().fit(both).table.collect()
    one = {r.entity: r.score for r in rows if r.league == "l"}
    assert one == {r.entity: r.score for r in rows if r.league == "m"} and len(rows) == 12


def test_whr_is_a_maximum(spark, season):
    m = online.Whr(tolerance=1e-9).fit(pairs.to_pairwise(season, "half_win"))
    rows = {(r.entity, r.period): r.rating / online.GLICKO_SCALE for r in m.table.collect()}
    p = [(r.period, r.winner, r.loser, r.weight) for r in pairs.to_pairwise(season, "half_win").collect()]

    def value(x):
        v = sum(w * -math.log1p(math.exp(-(x[a, t] - x[b, t]))) for t, a, b, w in p)
        by = {}
        for e, t in sorted(x):
            by.setdefault(e, []).append(t)
        for e, ts in by.items():
            v += -0.5 * math.log1p(math.exp(-x[e, ts[0]])) - 0.5 * math.log1p(math.exp(x[e, ts[0]]))
            v -= sum((x[e, u] - x[e, t]) ** 2 / (2 * 0.0006 * (u - t)) for t, u in zip(ts, ts[1:], strict=False))
        return v

    best = value(rows)
    for k in list(rows)[:8]:
        assert value(rows | {k: rows[k] + 1e-3}) < best and value(rows | {k: rows[k] - 1e-3}) < best


def rewards(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, f"a{i % 3}", float(rng.random() < 0.2 + 0.2 * (i % 3)), [1.0, float(i % 5)]) for i in range(300)], "seq long, arm string, reward double, x array<double>")


def test_bandits(spark):
    df = rewards(spark)
    for p in bandits.policies():
        op = bandits.Bandit(p)
        whole = {r.entity: r.score for r in op.fit(df).table.collect()}
        parts = op.update(op.fit(df.where("seq < 100")), df.where("seq >= 100"))
        assert {r.entity: r.score for r in parts.table.collect()} == pytest.approx(whole), p
        arms, after = op.select_k(parts, 2)
        assert len(set(arms)) == 2 and after.info["draws"] == 1 and op.select_k(parts, 2)[0] == arms
        if p == "exp3":
            with pytest.raises(ParamMismatch):
                op.merge(parts, parts)
        else:
            assert {r.entity: r.score for r in op.merge(op.fit(df.where("seq % 2 = 0")), op.fit(df.where("seq % 2 = 1"))).table.collect()} == pytest.approx(whole)
    u = bandits.Bandit()
    assert u.select(u.add_arm(u.fit(df), "new"))[0] == "new" and u.total_n(u.fit(df)) == 300
    beta = bandits.Bandit("thompson-beta").fit(spark.createDataFrame([(i, "a", float(i < 7)) for i in range(10)], "seq long, arm string, reward double"))
    assert beta.table.first().score == pytest.approx(8 / 12)
    kl = bandits.Bandit("kl-ucb").fit(df).table.collect()
    for r in kl:
        q, m = r.score, r.total / r.n
        assert m * math.log(m / q) + (1 - m) * math.log((1 - m) / (1 - q)) == pytest.approx(math.log(300) / r.n, rel=1e-6)
    sw = bandits.SlidingWindowUcb(window=30)
    two = sw.update(sw.fit(df.where("seq < 120")), df.where("seq >= 120"))
    assert sorted(tuple(r) for r in two.scores().collect()) == sorted(tuple(r) for r in sw.fit(df).scores().collect()) and sw.select(two)
    lin = bandits.LinUcb()
    a, b = lin.fit(df), lin.update(lin.fit(df.where("seq < 99")), df.where("seq >= 99"))
    assert {r.entity: r.score for r in a.table.collect()} == pytest.approx({r.entity: r.score for r in b.table.collect()})
    assert lin.select_for(a, [1.0, 2.0]) in {"a0", "a1", "a2"}
    with pytest.raises(InvalidInput):
        lin.fit(spark.createDataFrame([(1, "a", 1.0, [1.0]), (2, "a", 1.0, [1.0, 2.0])], "seq long, arm string, reward double, x array<double>"))


def test_dueling(spark):
    p = spark.createDataFrame([("a", "b", 9.0), ("b", "a", 1.0), ("a", "c", 8.0), ("c", "b", 3.0)], "winner string, loser string, weight double")
    for policy in ("rucb", "double-thompson"):
        op = bandits.DuelingBandit(policy)
        m = op.fit(p)
        assert op.scores(m).first().entity == "a" and op.total_duels(m) == 21
        x, y, after = op.select_pair(m)
        assert x != y and after.info["draws"] == 1 and op.select_pair(m)[:2] == (x, y)
        assert op.total_duels(op.merge(m, m)) == 42


def test_values(spark):
    rows = [("e1", 1, "s", 1.0), ("e1", 2, "t", 2.0), ("e1", 3, "s", 4.0), ("e2", 1, "t", 1.0), ("e3", 1, "s", None), ("e3", 2, None, 1.0)]
    df = spark.createDataFrame(rows, "episode_id string, step long, state string, reward double")
    assert {r.entity: (r.score, r.n) for r in trajectories.McValue().fit(df).table.collect()} == {"s": (7.0, 1), "t": (3.5, 2)}
    every = {(r.episode_id, r.step): r.g for r in trajectories.returns(df, 0.5, "every").collect()}
    assert every == {("e1", 1): 3.0, ("e1", 2): 4.0, ("e1", 3): 4.0, ("e2", 1): 1.0}
    assert trajectories.McValue(min_observations=2).fit(df).table.count() == 1
    td = {r.entity: r.score for r in online.TdValue(alpha=0.5).fit(df.where("reward IS NOT NULL").withColumn("seq", df.step)).table.collect()}
    assert td.keys() == {"s", "t"}
    more = spark.createDataFrame([(f"e{i}", 1, "ab"[i % 2], float(i % 2) + (i % 3) / 9) for i in range(60)], df.schema)
    op = trajectories.ValueCompare(replicates=80, permutations=40)
    m = op.fit(more)
    assert all(r.lower <= r.score <= r.upper for r in m.table.collect())
    pair = op.pairs(m).first()
    assert (pair.a, pair.b) == ("a", "b") and pair.p_b_above_a == 1 and pair.p_value < 0.05
    tok = spark.createDataFrame([("e", i, t, 0.0) for i, t in enumerate(["x|l", "x|l", "x|r", "y|r"])], df.schema)
    assert {r.entity: r.score for r in trajectories.BehaviorCloning(sep="|").fit(tok).table.collect()} == pytest.approx({"x|l": 2 / 3, "x|r": 1 / 3, "y|r": 1})
    assert [tuple(r) for r in trajectories.BehaviorCloning(sep="|").implied_pairs(tok).collect()] == [("l", "r", 1.0)]


def test_odds(spark):
    o = spark.createDataFrame([("e", "a", 4.2), ("e", "b", 3.7), ("e", "c", 1.95)], "event_id string, outcome string, odds double")
    p = {r.outcome: r.prob for r in odds.OddsDevig().fit(o).table.collect()}
    assert p == pytest.approx({"a": 0.2311414, "b": 0.2630644, "c": 0.5057941}, abs=1e-5)
    s = odds.OddsDevig("shin").fit(o).table.collect()
    assert s[0].z == pytest.approx(0.01054734, abs=1e-3) and sum(r.prob for r in s) == pytest.approx(1)
    for m in ("additive", "multiplicative"):
        assert sum(r.prob for r in odds.OddsDevig(m).fit(o).table.collect()) == pytest.approx(1)
    long = spark.createDataFrame([("e", "a", 1.01), ("e", "b", 100.0), ("e", "c", 5.0)], o.schema)
    with pytest.raises(NumericError):
        odds.OddsDevig("additive").fit(long)
    assert min(r.prob for r in odds.OddsDevig("additive", "clamp").fit(long).table.collect()) == 0
    with pytest.raises(InvalidInput):
        odds.OddsDevig().fit(o.unionByName(o))
    f = spark.createDataFrame([("s", 1.0, "a", 0.7), ("s", 1.0, "b", 0.3), ("t", 1.0, "a", 1.0), ("t", 1.0, "b", 0.0)], "source string, weight double, outcome string, prob double")
    assert {r.entity: r.score for r in odds.OpinionPool().fit(f).table.collect()} == {"a": 1.0, "b": 0.0}
    assert {r.entity: r.score for r in odds.OpinionPool("linear").fit(f).table.collect()} == pytest.approx({"a": 0.85, "b": 0.15})
    op = odds.Lmsr(10.0)
    t = spark.createDataFrame([("a", 5.0), ("b", 0.0)], "outcome string, shares double")
    m = op.fit(t)
    assert {r.entity: r.score for r in m.table.collect()} == pytest.approx({"a": 1 / (1 + math.exp(-0.5)), "b": 1 / (1 + math.exp(0.5))})
    assert op.trade_cost(m, "a", 1.0) == pytest.approx(10 * (math.log(math.exp(0.6) + 1) - math.log(math.exp(0.5) + 1)))
    assert odds.portfolio_kelly([0.6], [1.0])[0] == pytest.approx(0.2, abs=1e-6)
    c = spark.createDataFrame([(0.05, False), (0.95, True), (1.0, True), (None, True)], "p double, outcome boolean")
    table = odds.calibration_table(c).orderBy("bin").collect()
    assert [r.n for r in table] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2] and table[4].mean_p is None
    assert odds.log_loss(c).first()[0] > 0 and odds.brier_score(c).first()[0] == pytest.approx((0.05**2 * 2) / 3)


def test_wilson_published(spark):
    from pyspark.sql import functions as F

    from ranksmith.functions.math import norm_cdf, norm_ppf, wilson_interval

    want = {(81, 263): (0.2553, 0.3662), (15, 148): (0.0624, 0.1605), (0, 20): (0.0, 0.1611), (1, 29): (0.0061, 0.1718)}
    df = spark.createDataFrame([(float(a), float(b - a)) for a, b in want], "w double, l double")
    for r, e in zip(df.select(wilson_interval(F.col("w"), F.col("l")).alias("i")).collect(), want.values(), strict=True):
        assert tuple(r.i) == pytest.approx(e, abs=5e-5)
    one = spark.createDataFrame([(0.975,)], "p double").select(norm_ppf(F.col("p")).alias("x")).select("x", norm_cdf(F.col("x")).alias("p")).first()
    assert one.x == pytest.approx(1.959964, abs=1e-6) and one.p == pytest.approx(0.975, abs=1e-6)


def test_stream_equals_batch(spark, season, tmp_path):
    for lo in range(0, 120, 40):
        season.where(f"seq >= {lo} AND seq < {lo + 40}").coalesce(1).write.parquet(f"{tmp_path}/in/{lo:03d}")
    op = online.Elo()
    want = {r.entity: r.score for r in op.fit(season).table.collect()}
    read = lambda: spark.readStream.schema(season.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream_updates(read(), op, f"file://{tmp_path}/state", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = StateTable(op, f"file://{tmp_path}/state").latest(spark)
    assert {r.entity: r.score for r in got.table.collect()} == pytest.approx(want)


def test_keyed_state_equals_batch(spark, season, tmp_path):
    season.coalesce(1).write.parquet(f"{tmp_path}/in")
    op = online.Elo()
    stream = spark.readStream.schema(season.schema).parquet(f"{tmp_path}/in")
    q = keyed_fold(stream, op).writeStream.outputMode("update").format("memory").queryName("elo_state").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.entity: r.score for r in op.fit(season).table.collect()}
    assert {r.entity: r.state[0] for r in spark.table("elo_state").collect()} == pytest.approx(want)


def test_sessions(spark):
    df = spark.sql("SELECT 'u' user, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) ts, 'v' kind, 1D value FROM VALUES (0),(10),(50),(55) t(m)")
    x = session_episodes(df, "user", "ts", "kind", "value").orderBy("step").collect()
    assert [r.episode_id for r in x] == ["u/0", "u/0", "u/1", "u/1"]


def test_sql_functions(spark, season):
    names = sql.register(spark)
    assert "rs_elo" in names
    season.createOrReplaceTempView("season")
    got = {r.entity: r.score for r in spark.sql("SELECT * FROM rs_elo(TABLE(season) PARTITION BY league ORDER BY seq)").collect()}
    assert got == pytest.approx({r.entity: r.score for r in online.Elo().fit(season).table.collect()})
    assert spark.sql("SELECT rs_kelly(0.6D, 1D) k, rs_norm_cdf(0D) c").first().k == pytest.approx(0.2)


def test_glicko2_refuses_team_games_and_joins_agree(spark, monkeypatch):
    rows = [(k, 1 + k // 4, [f"p{k % 3}"], [f"p{(k + 1) % 5 + 3}"], float((-1) ** k), 1.0) for k in range(16)]
    schema = "seq long, period int, side1 array<string>, side2 array<string>, margin double, weight double"
    games = spark.createDataFrame(rows, schema)
    whole = sorted(online.Glicko2().fit(games).table.collect())
    monkeypatch.setattr(online, "BROADCAST_PLAYERS", 0)
    for a, b in zip(whole, sorted(online.Glicko2().fit(games).table.collect()), strict=True):
        assert a.entity == b.entity and a.rating == pytest.approx(b.rating) and a.sigma == pytest.approx(b.sigma)
    with pytest.raises(Exception, match="InvalidInput"):
        online.Glicko2().fit(spark.createDataFrame([*rows, (99, 9, ["a", "b"], ["c", "d"], 1.0, 1.0)], schema)).table.collect()
