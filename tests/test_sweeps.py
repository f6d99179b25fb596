"""Pair tables beyond one memory: the distributed iterations give what those in memory give."""

import random

import pytest

from ranksmith.model import NumericError
from ranksmith.operators import pairs, spectral

R = random.Random(5)
NAMES = [f"n{k}" for k in range(9)]


@pytest.fixture(scope="module")
def votes(spark):
    rows = [(a, b, float(R.randint(1, 4))) for a in NAMES for b in NAMES if a != b and R.random() < 0.8]
    return spark.createDataFrame(rows * 2, "winner string, loser string, weight double")


def both(op, data, monkeypatch, cols=("score",)):
    def table(m):
        return {r.entity: [r[c] for c in cols] for r in m.table.collect()}

    near = table(op.fit(data))
    monkeypatch.setattr(pairs, "LOCAL_PAIRS", 1)
    far = table(op.fit(data))
    assert near.keys() == far.keys()
    for k in near:
        assert far[k] == pytest.approx(near[k], abs=1e-6)


@pytest.mark.parametrize(
    "op",
    [
        spectral.Lsr(steps=4), spectral.RankCentrality(iterations=5, tolerance=0), spectral.RandomWalker(iterations=5, tolerance=0), spectral.Keener(iterations=5, tolerance=0),
        spectral.Massey(), spectral.Colley(), spectral.HodgeRank(), spectral.HodgeRank(flow="mean-margin"), spectral.ILsr(),
    ],
    ids=lambda o: type(o).__name__,
)
def test_same_as_in_memory(votes, monkeypatch, op):
    both(op, votes, monkeypatch)


def test_offense_defense(votes, monkeypatch):
    both(spectral.OffenseDefense(iterations=4, tolerance=0), votes, monkeypatch, ("offense", "defense", "score"))


def test_serial_rank(spark, monkeypatch):
    # A clear order, so that few steps settle it.
    rows = [(NAMES[a], NAMES[b], 1.0) for a in range(5) for b in range(a + 1, 5)]
    data = spark.createDataFrame(rows, "winner string, loser string, weight double")
    near = {r.entity: r.score for r in spectral.SerialRank().fit(data).table.collect()}
    monkeypatch.setattr(pairs, "LOCAL_PAIRS", 1)
    far = {r.entity: r.score for r in spectral.SerialRank(iterations=25).fit(data).table.collect()}
    assert sorted(near, key=near.get) == sorted(far, key=far.get) and all(abs(near[k] - far[k]) < 1e-2 for k in near)


def test_mc4(spark, monkeypatch):
    ballots = spark.createDataFrame([(k, R.sample(NAMES, 5)) for k in range(12)], "ballot_id int, items array<string>")
    both(spectral.Mc4(iterations=5, tolerance=0), ballots, monkeypatch)


def test_bradley_terry_sections(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("y", "x"), ("x", "y"), ("top", "a"), ("top", "x"), ("boss", "top"), ("k", "l"), ("b", "low")]
    data = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "winner string, loser string, weight double")
    table = lambda m: {r.entity: (r.section, r.kind, r.score if r.score is None else round(r.score, 5)) for r in m.table.collect()}
    near = table(spectral.BradleyTerryMM(tolerance=1e-12, remove_total_losers=True).fit(data))
    assert near == table(spectral.BradleyTerryMM(remove_total_losers=True, local_pairs=0).fit(data))


def test_no_finite_strengths(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LOCAL_PAIRS", 0)
    with pytest.raises(NumericError):
        spectral.ILsr().fit(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "winner string, loser string, weight double"))
