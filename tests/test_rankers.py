"""Published vectors, equivalences between methods, optimality, and degenerate inputs."""

import itertools
import math

import numpy as np
import pytest

from ranksmith.model import EmptyDataset, InvalidInput, NumericError, TooLarge
from ranksmith.operators import bootstrap, choice, consensus, counting, graph, pairs, spectral

AGRESTI = ("Mil Det Tor NY Bos Cle Bal".split(), [[0, 7, 9, 7, 7, 9, 11], [6, 0, 7, 5, 11, 9, 9], [4, 6, 0, 7, 7, 8, 12], [6, 8, 6, 0, 6, 7, 10], [6, 2, 6, 7, 0, 7, 12], [4, 4, 5, 6, 6, 0, 6], [2, 4, 1, 3, 1, 7, 0]])
LOGITS = dict(zip(AGRESTI[0], [1.5814, 1.4364, 1.2945, 1.2476, 1.1077, 0.6839, 0.0], strict=True))
ACC = [("Duke", "Miami", 7, 52), ("Duke", "UNC", 21, 24), ("Duke", "UVA", 7, 38), ("Duke", "VT", 0, 45), ("Miami", "UNC", 34, 16), ("Miami", "UVA", 25, 17), ("Miami", "VT", 27, 7), ("UNC", "UVA", 7, 5), ("UNC", "VT", 3, 30), ("UVA", "VT", 14, 52)]
TEAMS = ["Duke", "Miami", "UNC", "UVA", "VT"]
PAIR = "winner string, loser string, weight double"


@pytest.fixture(scope="module")
def league(spark):
    names, m = AGRESTI
    return spark.createDataFrame([(a, b, float(m[i][j])) for i, a in enumerate(names) for j, b in enumerate(names) if m[i][j]], PAIR)


@pytest.fixture(scope="module")
def tennessee(spark):
    votes = [("MNCK", 42), ("NCKM", 26), ("CKNM", 15), ("KCNM", 17)]
    return spark.createDataFrame([(i, list(b)) for i, b in enumerate(x for v, k in votes for x in [v] * k)], "ballot_id long, items array<string>")


def scores(model):
    return {r.entity: r.score for r in model.table.select("entity", "score").collect()}


def close(a, b, tol):
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < tol for k in a), (a, b)


def against_bal(s, log=True):
    f = math.log if log else float
    return {k: f(v) - f(s["Bal"]) for k, v in s.items()}


def test_bradley_terry_and_its_kin(spark, league):
    mm = scores(spectral.BradleyTerryMM(tolerance=1e-10).fit(league))
    close(against_bal(mm), LOGITS, 2e-4)
    assert abs(sum(mm.values()) - 1) < 1e-9
    close(against_bal(scores(spectral.ILsr().fit(league)), False), LOGITS, 2e-4)
    close({r.entity: r.score for r in spectral.mm_distributed(league, 40).collect()}, mm, 2e-3)
    games = pairs.from_pairwise(league)
    close(against_bal(scores(choice.TeamBradleyTerry().fit(games))), LOGITS, 2e-4)
    close(against_bal(scores(choice.GeneralizedBt(ties="none").fit(games)), False), LOGITS, 2e-4)
    ballots = league.selectExpr("explode(sequence(1, int(weight))) i", "array(winner, loser) items")
    close(against_bal(scores(choice.PlackettLuce().fit(ballots))), LOGITS, 2e-4)
    close(against_bal(scores(spectral.ILsr().fit_rankings(ballots)), False), LOGITS, 2e-4)


def test_ilsr_of_more_distinct_ballots_than_one_memory_held(spark, monkeypatch):
    import itertools

    rows = [(list(b), 1 + (3 * k) % 7) for k, b in enumerate(itertools.permutations("abcde", 4))]
    ballots = spark.createDataFrame(rows, "items array<string>, n int").selectExpr("explode(sequence(1, n)) i", "items").select("items")
    kept = spectral.bounded

    def few(df, limit, what):
        return kept(df, 50 if "ballots" in what else limit, what)

    monkeypatch.setattr(spectral, "bounded", few)
    local = scores(spectral.ILsr().fit_rankings(ballots))
    close(local, scores(spectral.ILsr(outer=100, local_choices=0).fit_rankings(ballots)), 1e-9)
    best = scores(choice.PlackettLuce(iterations=10_000).fit(ballots))
    mean = sum(map(math.log, best.values())) / len(best)
    close(local, {k: math.log(v) - mean for k, v in best.items()}, 1e-4)


def test_plackett_luce_of_more_distinct_ballots_than_pairs_fit(spark, monkeypatch):
    import itertools

    # Items that are always first or last, two components, and all orders of four of five.
    rows = [(["top", *b, "end"] if k % 2 else list(b),) for k, b in enumerate(itertools.permutations("abcde", 4)) if k % 7] + [(["x", "y"],), (["y", "x"],), (["y", "x"],)]
    ballots = spark.createDataFrame(rows, "items array<string>")

    def result(short, items):
        monkeypatch.setattr(choice, "SHORT_BALLOT", short)
        monkeypatch.setattr(choice, "LOCAL_ITEMS", items)
        return {r.entity: (r.section, r.kind, r.score) for r in choice.PlackettLuce().fit(ballots).table.collect()}

    monkeypatch.setattr(choice, "LOCAL_PAIRS", 10)
    near = result(16, 10_000)
    assert [near[k][1] for k in ("top", "end", "x")] == ["undefeated", "winless", "ranked"] and near["y"][2] == pytest.approx(2 / 3)
    for short, items in ((2, 10_000), (3, 0)):
        far = result(short, items)
        assert far.keys() == near.keys()
        for k in near:
            assert far[k][:2] == near[k][:2] and far[k][2] == pytest.approx(near[k][2], abs=1e-9)


def test_harmonic_of_a_graph_has_all_sources(spark, tmp_path):
    import random

    import __spark_entry__ as entry

    rnd = random.Random(5)
    rows = [(f"n{min(rnd.randrange(400), rnd.randrange(400))}", f"n{rnd.randrange(400)}", 1.0) for _ in range(900)] + [("alone", "alone", 1.0)]
    spark.createDataFrame(rows, "src string, dst string, weight double").write.parquet(f"{tmp_path}/graph_edges.parquet")
    after = {}
    for a, b, _ in rows:
        after.setdefault(a, set()).add(b)
    want = dict.fromkeys({x for r in rows for x in r[:2]}, 0.0)
    for source in want:
        seen, front, depth = {source}, {source}, 0
        while front:
            depth += 1
            front = {b for a in front for b in after.get(a, ())} - seen
            seen |= front
            for b in front:
                want[b] += 1 / depth
    close({r.entity: r.score for r in entry.queries()["g7_harmonic"](spark, str(tmp_path)).collect()}, want, 2e-6)
    e = spark.read.parquet(f"{tmp_path}/graph_edges.parquet")
    close(scores(graph.Harmonic(max_edges=0).fit(e)), want, 1e-9)
    close(scores(graph.Harmonic(direction="out").fit(e)), scores(graph.Harmonic(direction="out", max_edges=0).fit(e)), 1e-9)


def test_bayes_and_covariates_near_the_mle(spark, league):
    b = choice.BayesianBradleyTerry(samples=1500, burn_in=200).fit(league).table.collect()
    assert all(r.lower <= r.score <= r.upper for r in b) and abs(sum(r.score for r in b) - 1) < 1e-9
    assert sorted(r.entity for r in b if r.score > 0.15) == ["Det", "Mil", "NY", "Tor"]
    f = spark.createDataFrame([(n, [1.0 if k == i else 0.0 for k in range(7)]) for i, n in enumerate(AGRESTI[0])], "entity string, x array<double>")
    close(against_bal(scores(choice.CovariateBt(l2=1e-8).fit(league, f)), False), LOGITS, 1e-3)
    with pytest.raises(InvalidInput):
        choice.CovariateBt().fit(league, f.where("entity <> 'Bal'"))


def test_sections_of_undefeated_and_winless(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0), ("c", "d", 1.0), ("x", "a", 1.0), ("p", "q", 1.0), ("q", "p", 1.0)], PAIR)
    rows = spectral.BradleyTerryMM(remove_total_losers=True).fit(df).table.collect()
    kind = {r.entity: r.kind for r in rows}
    assert kind == {"x": "undefeated", "a": "undefeated", "d": "winless", "b": "ranked", "c": "ranked", "p": "ranked", "q": "ranked"}
    assert len({r.section for r in rows if r.kind == "ranked"}) == 2
    star = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0)], PAIR)
    assert {r.entity: r.kind for r in spectral.BradleyTerryMM().fit(star).table.collect()} == {"a": "undefeated", "b": "isolated", "c": "isolated"}


def test_voting(spark, tennessee):
    assert scores(counting.Borda().fit_rankings(tennessee)) == {"M": 126, "N": 194, "C": 173, "K": 107}
    p = pairs.ballots_to_pairwise(tennessee)
    assert scores(counting.Copeland().fit(p)) == {"N": 3, "C": 2, "K": 1, "M": 0}
    best = max(itertools.permutations("MNCK"), key=lambda o: sum(r.n for r in pairs.ordered_pairs(p).collect() if o.index(r.winner) < o.index(r.loser)))
    k = consensus.Kemeny(passes=20).fit(p)
    assert tuple(r.entity for r in k.scores().collect()) == best == tuple("NCKM")
    e = consensus.Kemeny(passes=800, algo="evolution").fit(p)
    assert [r.entity for r in e.scores().collect()] == list("NCKM")
    m = consensus.Mallows().fit(tennessee)
    assert [r.entity for r in m.scores().collect()] == list("NCKM") and 0 < m.info["phi"] < 1
    f = consensus.Footrule().fit(tennessee)
    cost = lambda o: sum(k * sum(abs(b.index(x) - o.index(x)) for x in b) for b, k in (("MNCK", 42), ("NCKM", 26), ("CKNM", 15), ("KCNM", 17)))
    assert f.info["cost"] == min(cost(o) for o in itertools.permutations("MNCK"))
    mc4 = scores(spectral.Mc4().fit(tennessee))
    assert max(mc4, key=mc4.get) == "N" and abs(sum(mc4.values()) - 1) < 1e-9


def test_least_squares_and_keener(spark):
    margins = spark.createDataFrame([(a, b, float(x - y)) if x > y else (b, a, float(y - x)) for a, b, x, y in ACC], PAIR)
    close(scores(spectral.Massey().fit(margins)), dict(zip(TEAMS, [-24.8, 18.2, -8.0, -3.4, 18.0], strict=True)), 1e-6)
    wins = margins.selectExpr("winner", "loser", "1D weight")
    close(scores(spectral.Colley().fit(wins)), dict(zip(TEAMS, [0.2143, 0.7857, 0.5, 0.3571, 0.6429], strict=True)), 1e-4)
    points = spark.createDataFrame([r for a, b, x, y in ACC for r in ((a, b, float(x)), (b, a, float(y)))], PAIR)
    close(scores(spectral.Keener().fit(points)), dict(zip(TEAMS, [0.0671, 0.3506, 0.1585, 0.1605, 0.2634], strict=True)), 2e-3)
    close(scores(spectral.Keener(skew=False).fit(points)), dict(zip(TEAMS, [0.0898, 0.2948, 0.1649, 0.1891, 0.2613], strict=True)), 2e-3)
    h = spectral.HodgeRank("mean-margin").fit(margins)
    close(scores(h), scores(spectral.Massey().fit(margins)), 1e-6)
    assert 0 <= h.info["inconsistency"] <= 1
    with pytest.raises(NumericError):
        spectral.OffenseDefense().fit(spark.createDataFrame([("a", "b", 1.0)], PAIR))


def test_chains_sum_to_one_and_order(spark, league):
    for op in (spectral.RankCentrality(), spectral.RandomWalker()):
        s = scores(op.fit(league))
        assert abs(sum(s.values()) - 1) < 1e-9 and min(s, key=s.get) == "Bal"
    line = spark.createDataFrame([(a, b, 1.0) for a, b in itertools.combinations("edcba", 2)], PAIR)
    s = scores(spectral.SerialRank().fit(line))
    assert abs(sum(s.values())) < 1e-9 and sorted(s, key=s.get) == list("abcde")
    mu = scores(choice.ThurstoneMosteller().fit(league))
    assert abs(sum(mu.values())) < 1e-9 and min(mu, key=mu.get) == "Bal"
    nash = choice.NashAveraging(iterations=5000).fit(league)
    assert abs(sum(r.p for r in nash.table.collect()) - 1) < 1e-9 and 0 <= nash.info["gap"] < 1
    assert scores(choice.BladeChest(epochs=5).fit(league)) == scores(choice.BladeChest(epochs=5).fit(league))
    assert min(scores(choice.EsRum(passes=40).fit(league)).values()) == 0
    lsr = spectral.Lsr()
    warm = scores(lsr.fit(league, lsr.fit(league)))
    assert warm.keys() == LOGITS.keys()


def test_crowd_finds_the_liar(spark):
    votes = [(k, *(("a", "b") if (k != "liar") == (i % 5 > 0) else ("b", "a")), 1.0) for k in ("good", "fair", "liar") for i in range(40)]
    m = choice.CrowdBt().fit(spark.createDataFrame(votes, "annotator string, winner string, loser string, weight double"))
    s = {(r.side, r.entity): r.score for r in m.table.collect()}
    assert s["item", "a"] > s["item", "b"] and s["annotator", "liar"] < 0.5 < s["annotator", "good"]


def test_crowd_of_more_votes_than_pairs_fit(spark, monkeypatch):
    import random

    draw = random.Random(12)
    votes = [(f"n{k}", *draw.sample("abcd", 2), float(draw.randint(1, 3))) for k in range(8) for _ in range(20)]
    df = spark.createDataFrame(votes, "annotator string, winner string, loser string, weight double")
    op = choice.CrowdBt(iterations=4)

    def result():
        m = op.fit(df)
        return {(r.side, r.entity): r.score for r in m.table.collect()}, m.info["loglik"]

    # By hand: the cells' expectations and the sweeps, vote by vote.
    g, eta = dict.fromkeys("abcd", 1.0), {f"n{k}": 10 / 11 for k in range(8)}
    for _ in range(op.iterations):
        r = [(w * eta[k] * g[a] / (eta[k] * g[a] + (1 - eta[k]) * g[b])) for k, a, b, w in votes]
        eta = {k: (9 + sum(x for x, v in zip(r, votes) if v[0] == k)) / (9 + sum(v[3] for v in votes if v[0] == k)) for k in eta}
        wins = {e: 0.5 + sum(x for x, v in zip(r, votes) if v[1] == e) + sum(v[3] - x for x, v in zip(r, votes) if v[2] == e) for e in g}
        for _ in range(20):
            g = {e: wins[e] / (1 / (g[e] + 1) + sum(w / (g[a] + g[b]) for _, a, b, w in votes if e in (a, b))) for e in g}
    monkeypatch.setattr(choice, "LOCAL_PAIRS", 12)
    near, ll = result()
    for e in g:
        assert near["item", e] == pytest.approx(math.log(g[e]), abs=1e-9)
    for k in eta:
        assert near["annotator", k] == pytest.approx(eta[k], abs=1e-9)
    monkeypatch.setattr(choice, "LOCAL_CELLS", 0)
    far, same = result()
    assert same == pytest.approx(ll) and far == pytest.approx(near, abs=1e-9)


def test_bootstrap_covers_the_point(spark, league):
    op = bootstrap.Bootstrap(bootstrap.ranker_solver(spectral.BradleyTerryMM()), replicates=40)
    rows = op.fit(league.selectExpr("winner", "loser", "explode(sequence(1, int(weight))) i").selectExpr("winner", "loser", "1D weight")).table.collect()
    assert all(r.lower <= r.score <= r.upper and r.rank_lower <= r["rank"] <= r.rank_upper + 1 for r in rows) and len(rows) == 7
    with pytest.raises(NumericError):
        # Three rows of three pairs: most resamples lack a pair, which this solver can't do without.
        bootstrap.Bootstrap(lambda c: [0.0] * c.size if len(c.w) == 3 else 1 / 0, replicates=60).fit(league.limit(3))


def test_resample_is_by_unit_and_seed(spark):
    x = spark.range(3000).selectExpr("id seq", "cast(id % 7 as string) winner", "'z' loser", "1D weight")
    a, b = bootstrap.resample(x, "pairs", 3), bootstrap.resample(x.repartition(7), "pairs", 3)
    assert a.count() == b.count() and abs(a.count() - 3000) < 300
    t = spark.range(400).selectExpr("id div 4 episode_id", "id step", "'s' state", "1D reward")
    assert all(r["count"] == 4 for r in bootstrap.resample(t, "trajectories", 1).groupBy("episode_id", "draw").count().collect())


def test_pagerank_and_hits_published(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ["12", "13", "31", "32", "35", "45", "46", "54", "56", "64"]], "src string, dst string, weight double")
    close(scores(graph.PageRank(damping=0.9, iterations=60, sink="uniform").fit(e)), dict(zip("123456", [0.03721, 0.05396, 0.04151, 0.3751, 0.206, 0.2862], strict=True)), 1e-4)
    h = spark.createDataFrame([(a, b, 1.0) for a, b in (("1", "3"), ("1", "6"), ("2", "1"), ("3", "6"), ("6", "3"), ("6", "5"), ("10", "6"))], "src string, dst string, weight double")
    rows = {r.entity: (r.authority, r.hub) for r in graph.Hits(iterations=40).fit(h).table.collect()}
    want = {"1": (0, 0.366), "2": (0, 0), "3": (0.366, 0.2113), "5": (0.134, 0), "6": (0.5, 0.2113), "10": (0, 0.2113)}
    assert all(abs(rows[k][i] - want[k][i]) < 1e-3 for k in want for i in (0, 1))


def test_small_graphs(spark):
    g = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 1.0), ("a", "b", 1.0), ("x", "y", 3.0), ("z", "z", 1.0), (None, "a", 1.0)]
    e = spark.createDataFrame(g, "src string, dst string, weight double")
    parts = {}
    for r in graph.extract_components(e).collect():
        parts.setdefault(r.component, set()).add(r.entity)
    assert parts == {0: set("abcd"), 1: set("xy"), 2: {"z"}}
    assert scores(graph.KCore().fit(e)) == {"a": 2, "b": 2, "c": 2, "d": 1, "x": 1, "y": 1, "z": 0}
    h = scores(graph.Harmonic().fit(e))
    assert abs(h["d"] - (1 + 1 / 2 + 1 / 3)) < 1e-9
    w = scores(graph.Harmonic(cost="weight").fit(e.where("src <> dst").dropDuplicates()))
    assert abs(w["c"] - (1 / 2 + 1 / 3)) < 1e-9
    k = scores(graph.Katz(alpha=0.01).fit(e))
    assert k["b"] > k["a"] > 0
    with pytest.raises(NumericError):
        graph.Katz(alpha=50.0).fit(e)
    assert scores(counting.Degree("in").fit(e))["b"] == 2
    lead = scores(graph.LeaderRank(iterations=30).fit(e))
    assert abs(sum(lead.values()) - 7) < 1e-6
    both = graph.BiRank().fit(spark.createDataFrame([("a", "a", 1.0), ("a", "b", 1.0)], "src string, dst string, weight double")).table.collect()
    assert {(r.side, r.entity) for r in both} == {("src", "a"), ("dst", "a"), ("dst", "b")}
    with pytest.raises(EmptyDataset):
        graph.KCore().fit(e.limit(0))


def test_chain_components_of_a_long_path(spark):
    e = spark.range(300).selectExpr("format_string('%04d', id) src", "format_string('%04d', id + 1) dst", "1D weight")
    assert graph.extract_components(e).select("component").distinct().count() == 1


def test_degenerate_pairs(spark):
    df = spark.createDataFrame([("a", "a", 1.0), (None, "b", 1.0), ("a", None, 1.0), ("a", "b", float("nan"))], PAIR)
    assert counting.WinRate().fit(df).table.count() == 0 and counting.Copeland().fit(df).table.count() == 0
    for op in (spectral.Colley(), spectral.RankCentrality(), choice.ThurstoneMosteller()):
        with pytest.raises(EmptyDataset):
            op.fit(df)
    with pytest.raises(NumericError):
        spectral.ILsr().fit(spark.createDataFrame([("a", "b", 1.0)], PAIR))
    with pytest.raises(TooLarge):
        pairs.local_cells(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], PAIR), limit=1)


def test_lowerings(spark):
    g = spark.createDataFrame([(1, 1, ["a"], ["b"], 2.0, 2.0), (2, 1, ["a"], ["c"], -1.0, 1.0), (3, 2, ["b"], ["c"], 0.0, 1.0)], "seq long, period int, side1 array<string>, side2 array<string>, margin double, weight double")
    half = {(r.winner, r.loser): r.weight for r in pairs.to_pairwise(g, "half_win").collect()}
    assert half == {("a", "b"): 2.0, ("c", "a"): 1.0, ("b", "c"): 0.5, ("c", "b"): 0.5}
    assert pairs.to_pairwise(g, "discard").count() == 2
    with pytest.raises(Exception, match="tied game"):
        pairs.to_pairwise(g).collect()
    assert pairs.margin_pairs(g, "zero").count() == 4 and pairs.margin_pairs(g, "discard", False).count() == 2
    assert [t["rank"] for t in pairs.to_matchups(g).orderBy("seq").collect()[3].teams] == [1, 1]
    rows = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d")]
    left = pairs.filter_min_count(spark.createDataFrame([(*r, 1.0) for r in rows], PAIR), 2)
    assert sorted((r.winner, r.loser) for r in left.collect()) == [("a", "b"), ("a", "b")]


def test_warm_start_saves_sweeps(spark):
    rng = np.random.default_rng(8)
    skill = rng.normal(size=40)
    def games(n):
        a, b = rng.integers(0, 40, n), rng.integers(0, 40, n)
        won = rng.random(n) < 1 / (1 + np.exp(skill[b] - skill[a]))
        return [(f"e{x if w else y:02d}", f"e{y if w else x:02d}", 1.0) for x, y, w in zip(a, b, won, strict=True) if x != y]
    old, more = games(3000), games(60)
    frame = lambda rows: spark.createDataFrame(rows, "winner string, loser string, weight double")
    op = spectral.BradleyTerryMM(tolerance=1e-9)
    before = op.fit(frame(old))
    cold, warm = op.fit(frame(old + more)), op.fit(frame(old + more), before)
    assert warm.info["sweeps"] <= 0.75 * cold.info["sweeps"]
    a, b = ({r.entity: r.score for r in m.table.collect()} for m in (cold, warm))
    assert a == pytest.approx(b, abs=1e-6)


def test_ties_are_at_the_maximum(spark):
    rng = np.random.default_rng(4)
    rows = [([f"p{a}"], [f"p{b}"], float(rng.choice([1, -1, 0], p=[0.5, 0.3, 0.2])), 1.0) for a in range(4) for b in range(4) if a != b for _ in range(6)]
    games = spark.createDataFrame(rows, "side1 array<string>, side2 array<string>, margin double, weight double")

    def log_likelihood(kind, s, tie, home):
        total = 0.0
        for (h,), (v,), m, _ in rows:
            a, b = home * math.exp(s[h]), math.exp(s[v])
            if kind == "davidson":
                p = {1.0: a, -1.0: b, 0.0: tie * math.sqrt(a * b)}
                total += math.log(p[m] / sum(p.values()))
            else:
                p = {1.0: a / (a + tie * b), -1.0: b / (tie * a + b)}
                total += math.log(p[m] if m else 1 - p[1.0] - p[-1.0])
        return total

    for kind in ("davidson", "rao-kupper"):
        m = choice.GeneralizedBt(ties=kind, home=True, tolerance=1e-12).fit(games)
        s = {r.entity: r.score for r in m.table.collect()}
        tie, home = m.info["tie"], m.info["home"]
        best = log_likelihood(kind, s, tie, home)
        for d in (1e-3, -1e-3):
            assert log_likelihood(kind, s, tie + d, home) <= best + 1e-8 and log_likelihood(kind, s, tie, home + d) <= best + 1e-8
            assert all(log_likelihood(kind, {**s, k: s[k] + d}, tie, home) <= best + 1e-8 for k in s)


def test_bootstrap_of_any_ranker(spark):
    rng = np.random.default_rng(6)
    rows = [(f"n{min(a, b)}", f"n{max(a, b)}", 1.0) if rng.random() < 0.75 else (f"n{max(a, b)}", f"n{min(a, b)}", 1.0) for a, b in rng.integers(0, 5, (300, 2)) if a != b]
    data = spark.createDataFrame(rows, "winner string, loser string, weight double")
    for op in (spectral.Keener(), spectral.ILsr(), choice.ThurstoneMosteller()):
        point = {r.entity: r.score for r in op.fit(data).table.collect()}
        got = {r.entity: r for r in bootstrap.Bootstrap(bootstrap.ranker_solver(op), replicates=20).fit(data).table.collect()}
        assert all(got[k].score == pytest.approx(v) and got[k].lower <= v + 0.2 and got[k].upper >= v - 0.2 and got[k].lower < got[k].upper for k, v in point.items())
    ballots = spark.createDataFrame([(k, [f"n{x}" for x in rng.permutation(4)]) for k in range(30)], "ballot_id int, items array<string>")
    m = bootstrap.RefitBootstrap(lambda b: counting.Borda().fit_rankings(b), "ballots", replicates=6).fit(ballots)
    assert m.info["succeeded"] == 6 and all(r.lower < r.upper for r in m.table.collect())
