"""Luce strengths against minorisation-maximisation, and consensus against planted truth."""

import math

import numpy as np
import pytest

from ranksmith.model import NumericError
from ranksmith.llm.votes import CommunityModel, _digamma, luce_strengths, stronger_than

SCHEMA = "seq long, annotator string, winner string, loser string, weight double, loaded_at long"


def planted(n_items=14, seed=2):
    rng = np.random.default_rng(seed)
    s = np.linspace(-1.5, 1.5, n_items)
    kinds = {"good": 0.92, "fair": 0.75, "coin": 0.5, "liar": 0.1}
    rows, k = [], 0
    for a in range(24):
        kind = list(kinds)[a % 8] if a % 8 < 4 else "good"
        for _ in range(60 if a % 5 else 6):
            i, j = rng.choice(n_items, 2, replace=False)
            hi, lo = (i, j) if s[i] > s[j] else (j, i)
            w, l = (hi, lo) if rng.random() < kinds[kind] else (lo, hi)
            rows.append((k, f"{kind}{a:02d}", f"i{w:02d}", f"i{l:02d}", 1.0 if k % 4 else None, k))
            k += 1
    return rows


def dirty(rows):
    return rows + [(r[0], *r[1:5], r[5] + 1000) for r in rows[:40]] + [
        (90001, "x", "i00", "i00", 1.0, 0), (90002, "x", None, "i01", 1.0, 0), (90003, "x", "i01", None, 1.0, 0), (90004, None, "i13", "i00", 1.0, 0),
        (90005, "x", "i00", "i13", 0.0, 0), (90006, "x", "i00", "i13", -2.0, 0), (90007, "x", "i00", "i13", float("nan"), 0), (90008, "x", "i00", "i13", float("inf"), 0)]


def mm(rows, prior):
    w = {}
    seen = set()
    for seq, _, a, b, x, _ in rows:
        x = 1.0 if x is None else x
        if seq in seen or a is None or b is None or a == b or not (0 < x < float("inf")):
            continue
        seen.add(seq)
        w[a, b] = w.get((a, b), 0) + x
    names = sorted({k for p in w for k in p})
    at = {k: i for i, k in enumerate(names)}
    n = len(names)
    a, b, x = (np.array(v) for v in zip(*((at[p], at[q], c) for (p, q), c in w.items()), strict=True))
    pi = np.ones(n + 1)
    won = np.bincount(a, x, n + 1) + np.append(np.full(n, prior), prior * n)
    for _ in range(30000):
        t = x / (pi[a] + pi[b])
        v = 2 * prior / (pi[:n] + pi[n])
        new = won / (np.bincount(a, t, n + 1) + np.bincount(b, t, n + 1) + np.append(v, v.sum()))
        new /= np.exp(np.log(new).mean())
        done = np.abs(np.log(new / pi)).max() < 1e-11
        pi = new
        if done:
            break
    s = np.log(pi[:n])
    return dict(zip(names, s - s.mean(), strict=True))


def test_strengths_are_the_maximum(spark):
    rows = dirty(planted())
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.item: r.strength for r in luce_strengths(df).collect()}
    assert got == pytest.approx(mm(rows, 0.01), abs=1e-6)
    anchors = spark.createDataFrame([("i07", True), ("i03", False)], "item string, is_yardstick boolean")
    assert {r.item for r in stronger_than(luce_strengths(df), anchors).collect()} == {k for k, v in got.items() if v > got["i07"]}
    assert stronger_than(luce_strengths(df), anchors.where("NOT is_yardstick")).count() == 0


def test_distributed_steps_agree(spark):
    df = spark.createDataFrame(planted()[:150], SCHEMA)
    a = {r.item: r.strength for r in luce_strengths(df).collect()}
    b = {r.item: r.strength for r in luce_strengths(df, local_pairs=0).collect()}
    assert a == pytest.approx(b, abs=1e-7)
    for pairs_in_memory in (0, 1000):
        with pytest.raises(NumericError):
            luce_strengths(df, outer=2, local_pairs=pairs_in_memory)


def test_undefeated_and_winless_stay_finite(spark):
    df = spark.createDataFrame([(1, "x", "a", "b", 1.0, 0), (2, "x", "b", "c", 1.0, 0), (3, "x", "p", "q", 1.0, 0)], SCHEMA)
    s = {r.item: r.strength for r in luce_strengths(df).collect()}
    assert s["a"] > s["b"] > s["c"] and s["p"] > s["q"] and all(math.isfinite(v) for v in s.values())


def test_empty_votes(spark):
    df = spark.createDataFrame([(1, "x", None, "b", 1.0, 0)], SCHEMA)
    assert luce_strengths(df).count() == 0
    m = CommunityModel(df)
    assert m.consensus().count() == 0 and m.reliability().count() == 0 and m.unreliable().count() == 0


def test_consensus_and_annotators(spark):
    rows = dirty(planted())
    m = CommunityModel(spark.createDataFrame(rows, SCHEMA), communities=4)
    c = m.consensus().collect()
    right = sum(r.winner == max(r.low, r.high) for r in c)
    assert right > 0.9 * len(c) and all(0.5 <= r.certainty <= 1 and 0 <= r.agreement <= 1 for r in c)
    bad = {r.annotator for r in m.unreliable().collect()}
    many = {a for a in {r[1] for r in rows if r[1]} if sum(r[1] == a for r in planted()) >= 20}
    assert bad == {a for a in many if a[:4] in ("coin", "liar")}
    r = {x.annotator: x for x in m.reliability().collect()}
    assert r["liar03"].reliability < 0.3 < 0.8 < r["good04"].reliability


def test_joins_instead_of_broadcasts_agree(spark, monkeypatch):
    import ranksmith.llm.votes as v

    df = spark.createDataFrame(planted()[:300], SCHEMA)
    a = {(r.low, r.high): r.certainty for r in CommunityModel(df, rounds=3, tolerance=0).consensus().collect()}
    monkeypatch.setattr(v, "BROADCAST_ROWS", 0)
    b = {(r.low, r.high): r.certainty for r in CommunityModel(df, rounds=3, tolerance=0).consensus().collect()}
    assert a == pytest.approx(b)


def test_digamma():
    assert _digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721])
