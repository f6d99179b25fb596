"""Spectral and least-squares rankers over aggregated pairs.

Each reduces the rows in Spark to ordered pairs (one shuffle, partial sums). Up to ``LOCAL_PAIRS`` of them it iterates in one memory, as
the iterations are too many and too small to be jobs; larger pair tables are iterated where they lie (``sweeps``), with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.model import InvalidInput, Model, NumericError, TooLarge, params_of
from ranksmith.operators.pairs import Cells, ballots_to_pairwise, bounded, clean_pairs, local_cells, pair_table, require
from ranksmith.session import Scratch

EPS = 1e-8


def frame(data: DataFrame, columns: dict[str, Any], schema: str) -> DataFrame:
    """A result table from arrays; of ``Cells`` it is one in memory."""
    if isinstance(data, Cells):
        return pd.DataFrame(columns)
    return data.sparkSession.createDataFrame(pd.DataFrame(columns), schema)


def cells_or_arcs(pairs: DataFrame, label: str, limit: int | None = None) -> Any:
    """The aggregated pairs in memory, or their ``sweeps.Arcs`` if they are too many."""
    from ranksmith.operators.sweeps import Arcs

    try:
        return local_cells(pairs, limit)
    except TooLarge:
        return Arcs(pairs, label)


def scored(data: DataFrame, c: Cells, algorithm: str, op: Any, score: np.ndarray, **info: Any) -> Model:
    return Model(algorithm, params_of(op), frame(data, {"entity": c.names, "score": np.asarray(score, float) + 0.0}, "entity string, score double"), info)


def chain_step(c: Cells, src: np.ndarray, dst: np.ndarray, p: np.ndarray):
    """One step of a chain whose rows sum to at most 1; what is left of a row stays where it is."""
    stay = 1 - np.bincount(src, p, c.size)
    return lambda pi: stay * pi + np.bincount(dst, pi[src] * p, c.size)


def iterate(step, x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, int]:
    for k in range(iterations):
        y = step(x)
        moved = np.abs(y - x).sum()
        x = y
        if moved < tolerance:
            return x, k + 1
    return x, iterations


@dataclass(frozen=True)
class Lsr:
    """Luce spectral ranking of one chain; ``steps=None`` means 10 power steps, or 1000 steps of each random walk."""

    steps: int | None = None
    estimator: str = "power"
    seed: int = 2020

    def fit(self, pairs: DataFrame, init: Model | None = None) -> Model:
        c = cells_or_arcs(pairs, "lsr")
        if not isinstance(c, Cells):
            if self.estimator != "power" or init is not None:
                raise TooLarge("beyond one memory there are power steps from an even start only")
            return sweeps().lsr(c, self, 10 if self.steps is None else self.steps, EPS)
        out = c.add(c.b, c.w / 2)
        degree = out
        p = np.divide(c.w / 2, out[c.b], out=np.zeros(len(c.w)), where=out[c.b] > 0)
        if self.estimator == "power":
            pi = np.full(c.size, 1 / c.size)
            if init is not None:
                old = {r.entity: r.score for r in init.table.select("entity", "score").collect()}
                pi = np.array([np.exp(old[k]) * np.sqrt(max(d, EPS)) if k in old else 1 / c.size for k, d in zip(c.names, degree, strict=True)])
                pi /= pi.sum()
            for _ in range(10 if self.steps is None else self.steps):
                pi = np.bincount(c.a, pi[c.b] * p, c.size) + EPS
                pi /= pi.sum()
        elif self.estimator == "monte-carlo":
            pi = _walks(pairs, c, p, 1000 if self.steps is None else self.steps, self.seed)
        else:
            raise InvalidInput(f"estimator {self.estimator}")
        s = np.log(np.maximum(pi, 1e-300) / np.sqrt(np.maximum(degree, EPS)))
        return scored(pairs, c, "lsr", self, s - s.mean())


def _walks(data: DataFrame, c: Cells, p: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Visits of one seeded walk from each node; walks run in parallel and depend on seed and node only."""
    order = np.lexsort((c.a, c.b))
    src, dst, cum = c.b[order], c.a[order], np.zeros(len(order))
    start = np.searchsorted(src, np.arange(c.size + 1))
    for i in range(c.size):
        cum[start[i] : start[i + 1]] = np.cumsum(p[order][start[i] : start[i + 1]])
    sent = data.sparkSession.sparkContext.broadcast((start, dst, cum, c.size))

    def walk(batches):
        start, dst, cum, n = sent.value
        visits = np.zeros(n, dtype=np.int64)
        for pdf in batches:
            for node in pdf["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(node)]))
                draw, cur = rng.random(steps), int(node)
                for u in draw:
                    visits[cur] += 1
                    lo, hi = start[cur], start[cur + 1]
                    cur = int(u * n) if lo == hi else int(dst[min(lo + np.searchsorted(cum[lo:hi], u), hi - 1)])
        yield pd.DataFrame({"node": np.arange(n), "visits": visits})

    rows = data.sparkSession.range(c.size).mapInPandas(walk, "node long, visits long").groupBy("node").agg(F.sum("visits").alias("visits"))
    out = np.zeros(c.size)
    for r in bounded(rows, c.size, "nodes").itertuples():
        out[r.node] = r.visits
    return out / out.sum()


@dataclass(frozen=True)
class ILsr:
    """Iterative Luce spectral ranking to the maximum-likelihood strengths (logarithms, mean zero), of pairs or ballots."""

    outer: int = 100
    inner_steps: int = 50
    tolerance: float = 1e-10
    local_choices: int = 5_000_000

    def fit(self, pairs: DataFrame, init: Model | None = None) -> Model:
        c = cells_or_arcs(pairs, "ilsr")
        if not isinstance(c, Cells):
            return sweeps().ilsr(c, self)
        strongly_connected(c)
        pi = np.full(c.size, 1 / c.size)
        if init is not None:
            old = {r.entity: r.score for r in init.table.select("entity", "score").collect()}
            pi = np.array([np.exp(old.get(k, 0.0)) for k in c.names])
            pi /= pi.sum()

        def rates(pi: np.ndarray):
            return c.b, c.a, c.w / (pi[c.a] + pi[c.b])

        return self._solve(pairs, c, rates, pi)

    def fit_rankings(self, ballots: DataFrame) -> Model:
        """A ballot is a row of choices: its first item out of all, the second out of the rest, and so on.

        Equal choices (a winner out of the same items) are counted in Spark. Up to ``local_choices`` items in all of them the rates
        are added up in one memory, beyond that by a Spark job a round; only ordered pairs (LOCAL_PAIRS) are bounded.
        """
        disk = Scratch(ballots.sparkSession, "ilsr")
        x = ballots.where(F.size("items") >= 2).select(F.posexplode("items").alias("p", "winner"), "items")
        x = x.withColumn("rest", F.expr("array_sort(slice(items, p + 2, greatest(size(items) - p - 1, 0)))")).where(F.size("rest") > 0)
        choices = disk.save(x.groupBy("winner", "rest").agg(F.count("*").cast("double").alias("w")))
        c = local_cells(choices.select("winner", F.explode("rest").alias("loser"), F.col("w").alias("weight")))
        strongly_connected(c)
        coded = self._coded(choices, c, disk)
        if (coded.agg(F.sum(F.size("ids"))).first()[0] or 0) <= self.local_choices:
            batches = coded.toArrow().combine_chunks().to_batches()

            def rates(pi: np.ndarray):
                total = sum((_choice_rates(x, pi, c) for x in batches), np.zeros(len(c.a)))
                return c.b, c.a, total
        else:

            def rates(pi: np.ndarray):
                return c.b, c.a, self._job_rates(coded, pi, c)

        return self._solve(ballots, c, rates, np.full(c.size, 1 / c.size))

    @staticmethod
    def _coded(choices: DataFrame, c: Cells, disk: Scratch) -> DataFrame:
        """``ids, w``: the numbers of a choice's winner and of the rest."""
        sent = choices.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(c.names)})

        def code(batches):
            at = sent.value
            for batch in batches:
                ids = [[at[i] for i in (winner, *rest)] for winner, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(2)], ["ids", "w"])

        return disk.save(choices.select("winner", "rest", "w").mapInArrow(code, "ids array<int>, w double"))

    @staticmethod
    def _job_rates(coded: DataFrame, pi: np.ndarray, c: Cells) -> np.ndarray:
        """The same sums, each task over its choices: at most one row a task for each ordered pair."""
        sent = coded.sparkSession.sparkContext.broadcast((pi, c))

        def add(batches):
            pi, c = sent.value
            total = np.zeros(len(c.a))
            for batch in batches:
                total += _choice_rates(batch, pi, c)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"cell": at, "r": total[at]})

        out = np.zeros(len(c.a))
        rows = coded.mapInArrow(add, "cell long, r double").groupBy("cell").agg(F.sum("r").alias("r")).toPandas()
        sent.destroy()
        out[rows["cell"].to_numpy()] = rows["r"].to_numpy()
        return out

    def _solve(self, data: DataFrame, c: Cells, rates, pi: np.ndarray) -> Model:
        used = self.outer
        for k in range(self.outer):
            src, dst, r = rates(pi)
            out = np.bincount(src, r, c.size)
            step = chain_step(c, src, dst, r / out.max())
            new, _ = iterate(step, pi, self.inner_steps, self.tolerance)
            new = new / new.sum()
            moved, pi = np.abs(new - pi).sum(), new
            if moved < self.tolerance:
                used = k + 1
                break
        s = np.log(pi)
        return scored(data, c, "ilsr", self, s - s.mean(), rounds=used)


def _choice_rates(batch: pa.RecordBatch, pi: np.ndarray, c: Cells) -> np.ndarray:
    """For each ordered pair, the sum of the weights of the choices of one over the other by the strengths chosen from."""
    ids, offsets = batch.column(0).values.to_numpy(zero_copy_only=False), batch.column(0).offsets.to_numpy().astype(np.int64)
    ids, offsets = ids[offsets[0] : offsets[-1]].astype(np.int64), offsets - offsets[0]
    length = np.diff(offsets)
    owner = np.repeat(np.arange(len(length)), length)
    rate = batch.column(1).to_numpy(zero_copy_only=False) / np.bincount(owner, pi[ids], len(length))
    # An item that a ballot names again is no pair with itself; all other pairs of a choice are among the ordered ones.
    lost = ids != ids[offsets[:-1]][owner]
    owner = owner[lost]
    key = c.a.astype(np.int64) * c.size + c.b
    order = np.argsort(key)
    at = order[np.searchsorted(key, ids[offsets[:-1]][owner] * c.size + ids[lost], sorter=order)]
    return np.bincount(at, rate[owner], len(key))


def strongly_connected(c: Cells) -> None:
    """Ford's condition: everyone is linked by wins to everyone else; else no finite strengths exist."""
    for src, dst in ((c.a, c.b), (c.b, c.a)):
        seen = np.zeros(c.size, bool)
        seen[0] = True
        while True:
            new = np.zeros(c.size, bool)
            new[dst[seen[src]]] = True
            new &= ~seen
            if not new.any():
                break
            seen |= new
        if not seen.all():
            raise NumericError(f"no finite strengths: {[c.names[i] for i in np.flatnonzero(~seen)[:5]]} are not linked by wins both ways")


@dataclass(frozen=True)
class RankCentrality:
    iterations: int = 200
    tolerance: float = 1e-10

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(pairs, "rank-centrality")
        if not isinstance(c, Cells):
            return sweeps().rank_centrality(c, self)
        i, j, wi, wj = c.unordered()
        d_max = max(1, np.bincount(np.concatenate([i, j])).max())
        both = wi + wj > 0
        i, j, wi, wj = i[both], j[both], wi[both], wj[both]
        p = np.concatenate([wj, wi]) / np.tile(wi + wj, 2) / d_max
        pi, used = iterate(chain_step(c, np.concatenate([i, j]), np.concatenate([j, i]), p), np.full(c.size, 1 / c.size), self.iterations, self.tolerance)
        return scored(pairs, c, "rank-centrality", self, pi, rounds=used)


@dataclass(frozen=True)
class RandomWalker:
    p: float = 0.75
    iterations: int = 1000
    tolerance: float = 1e-12

    def fit(self, pairs: DataFrame) -> Model:
        if not 0.5 < self.p < 1:
            raise InvalidInput(f"p must lie between a half and 1, got {self.p}")
        c = cells_or_arcs(pairs, "random-walker")
        if not isinstance(c, Cells):
            return sweeps().random_walker(c, self)
        i, j, wi, wj = c.unordered()
        g = c.add(c.a, c.w) + c.add(c.b, c.w)
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        mine, theirs = np.concatenate([wi, wj]), np.concatenate([wj, wi])
        pi, used = iterate(chain_step(c, src, dst, (self.p * theirs + (1 - self.p) * mine) / g[src]), np.full(c.size, 1 / c.size), self.iterations, self.tolerance)
        return scored(pairs, c, "random-walker", self, pi, rounds=used)


@dataclass(frozen=True)
class Keener:
    """Perron vector of smoothed score shares; rows are (scorer, opponent, amount), both directions of a game."""

    skew: bool = True
    normalize_games: bool = True
    iterations: int = 1000
    tolerance: float = 1e-12

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(pairs, "keener")
        if not isinstance(c, Cells):
            return sweeps().keener(c, self)
        i, j, si, sj = c.unordered()
        a = np.concatenate([si + 1, sj + 1]) / np.tile(si + sj + 2, 2)
        if self.skew:
            a = 0.5 + 0.5 * np.sign(a - 0.5) * np.sqrt(np.abs(2 * a - 1))
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        if self.normalize_games:
            a = a / np.maximum(c.add(c.a, c.n) + c.add(c.b, c.n), 1)[src]

        def step(r: np.ndarray) -> np.ndarray:
            y = np.bincount(src, a * r[dst], c.size)
            if not (y.sum() > 0 and np.isfinite(y.sum())):
                raise NumericError("the power iteration collapsed; is the schedule connected?")
            return y / y.sum()

        r, used = iterate(step, np.full(c.size, 1 / c.size), self.iterations, self.tolerance)
        return scored(pairs, c, "keener", self, r, rounds=used)


@dataclass(frozen=True)
class OffenseDefense:
    """Sinkhorn balance of (scorer, opponent, amount): offense, defense, and their ratio as score."""

    iterations: int = 500
    tolerance: float = 1e-9

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(pairs, "offense-defense")
        if not isinstance(c, Cells):
            return sweeps().offense_defense(c, self)
        m = c.w > 0
        a, b, w = c.a[m], c.b[m], c.w[m]
        for at, what in ((a, "never scored"), (b, "was never scored on")):
            idle = np.flatnonzero(np.bincount(at, minlength=c.size) == 0)
            if len(idle):
                raise NumericError(f"{[c.names[i] for i in idle[:5]]} {what}")
        d, o = np.ones(c.size), np.ones(c.size)
        for _ in range(self.iterations):
            o = np.bincount(a, w / d[b], c.size)
            new = np.bincount(b, w / o[a], c.size)
            moved = np.abs(new - d).sum() / np.abs(d).sum()
            d = new
            if moved < self.tolerance:
                break
        # Offense and defense have a common factor to choose; ratings are by offense over defense.
        table = frame(pairs, {"entity": c.names, "offense": o, "defense": d, "score": o / d}, "entity string, offense double, defense double, score double")
        return Model("offense-defense", params_of(self), table)


def conjugate_gradient(mul, b: np.ndarray, iterations: int, tolerance: float, mean_zero: bool = False) -> np.ndarray:
    """Solves ``A x = b`` for a positive (semi)definite ``mul``; with ``mean_zero`` in the space without constants."""
    centre = (lambda v: v - v.mean()) if mean_zero else (lambda v: v)
    x, r = np.zeros_like(b), centre(b)
    p, rr = r.copy(), r @ r
    stop = tolerance * max(np.sqrt(b @ b), 1e-300)
    for _ in range(iterations):
        if np.sqrt(rr) <= stop:
            break
        ap = centre(mul(p))
        step = rr / (p @ ap)
        x, r = x + step * p, r - step * ap
        new = r @ r
        p, rr = r + new / rr * p, new
    return centre(x)


def _laplacian(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
    diag = np.bincount(i, w, n) + np.bincount(j, w, n)
    return lambda x: diag * x - np.bincount(i, w * x[j], n) - np.bincount(j, w * x[i], n)


@dataclass(frozen=True)
class Massey:
    """Least-squares ratings of margins (a row's weight), mean zero."""

    iterations: int = 1000
    tolerance: float = 1e-10

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(require(pairs, F.coalesce(F.col("weight") >= 0, F.lit(True)), "a negative margin"), "massey")
        if not isinstance(c, Cells):
            return sweeps().massey(c, self)
        r = conjugate_gradient(_laplacian(c.size, c.a, c.b, c.n), c.add(c.a, c.w) - c.add(c.b, c.w), self.iterations, self.tolerance, True)
        return scored(pairs, c, "massey", self, r)


@dataclass(frozen=True)
class Colley:
    """Colley's ratings; a row's weight is its number of games."""

    iterations: int = 1000
    tolerance: float = 1e-10

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(pairs, "colley")
        if not isinstance(c, Cells):
            return sweeps().colley(c, self)
        lap = _laplacian(c.size, c.a, c.b, c.w)
        b = 1 + (c.add(c.a, c.w) - c.add(c.b, c.w)) / 2
        return scored(pairs, c, "colley", self, conjugate_gradient(lambda x: 2 * x + lap(x), b, self.iterations, self.tolerance))


@dataclass(frozen=True)
class HodgeRank:
    """Potentials of the pairwise flow, and the share of the flow that no ranking explains."""

    flow: str = "log-odds"
    iterations: int = 1000
    tolerance: float = 1e-10

    def fit(self, pairs: DataFrame) -> Model:
        if self.flow not in ("log-odds", "win-rate-delta", "mean-margin"):
            raise InvalidInput(f"flow {self.flow}")
        c = cells_or_arcs(pairs, "hodge-rank")
        if not isinstance(c, Cells):
            return sweeps().hodge_rank(c, self)
        i, j, wi, wj = c.unordered()
        low = np.minimum(c.a, c.b).astype(np.int64) * c.size + np.maximum(c.a, c.b)
        n = np.bincount(np.searchsorted(i * c.size + j, low), c.n, len(i))
        if self.flow == "log-odds":
            y, w = np.log((wi + 0.5) / (wj + 0.5)), wi + wj
        elif self.flow == "win-rate-delta":
            y, w = np.divide(wi - wj, wi + wj, out=np.zeros_like(wi), where=wi + wj > 0), wi + wj
        else:
            y, w = (wi - wj) / n, n
        s = conjugate_gradient(_laplacian(c.size, i, j, w), np.bincount(i, w * y, c.size) - np.bincount(j, w * y, c.size), self.iterations, self.tolerance, True)
        whole = (w * y * y).sum()
        rest = (w * (y - (s[i] - s[j])) ** 2).sum()
        return scored(pairs, c, "hodge-rank", self, s, inconsistency=float(rest / whole) if whole > 0 else 0.0)


@dataclass(frozen=True)
class SerialRank:
    """Fiedler coordinates of the similarity ``(n 1 1' + C C') / 2``, whose product with a vector needs no dense matrix."""

    iterations: int = 1000
    tolerance: float = 1e-12
    seed: int = 2014

    def fit(self, pairs: DataFrame) -> Model:
        c = cells_or_arcs(pairs, "serial-rank")
        if not isinstance(c, Cells):
            return sweeps().serial_rank(c, self)
        i, j, wi, wj = c.unordered()
        v = np.sign(wi - wj)

        def cmul(x: np.ndarray) -> np.ndarray:
            return np.bincount(i, v * x[j], c.size) - np.bincount(j, v * x[i], c.size)

        smul = lambda x: (c.size * x.sum() - cmul(cmul(x))) / 2
        degree = smul(np.ones(c.size))
        shift = 2 * max(degree.max(), 1.0)

        def unit(x: np.ndarray) -> np.ndarray:
            x = x - x.mean()
            n = np.linalg.norm(x)
            return x / n if n > 0 else x

        x = unit(np.random.Generator(np.random.Philox(self.seed)).random(c.size) - 0.5)
        for _ in range(self.iterations):
            y = unit((shift - degree) * x + smul(x))
            done = 1 - abs(x @ y) < self.tolerance
            x = y
            if done:
                break
        net = c.add(c.a, c.w) - c.add(c.b, c.w)
        if x @ net < 0 or (x @ net == 0 and x[0] < 0):
            x = -x
        return scored(pairs, c, "serial-rank", self, x)


@dataclass(frozen=True)
class Mc4:
    """Stationary distribution of the majority chain over ballots: from i to j with 1/n if most ballots with both prefer j."""

    damping: float = 0.85
    iterations: int = 200
    tolerance: float = 1e-9

    def fit(self, ballots: DataFrame) -> Model:
        c = cells_or_arcs(ballots_to_pairwise(ballots), "mc4")
        if not isinstance(c, Cells):
            return sweeps().mc4(c, self)
        i, j, wi, wj = c.unordered()
        n = c.size
        to_j, to_i = wj > wi, wi > wj
        src, dst = np.concatenate([i[to_j], j[to_i]]), np.concatenate([j[to_j], i[to_i]])
        walk = chain_step(c, src, dst, np.full(len(src), 1 / n))
        pi, used = iterate(lambda x: self.damping * walk(x) + (1 - self.damping) / n, np.full(n, 1 / n), self.iterations, self.tolerance)
        return scored(ballots, c, "mc4", self, pi, rounds=used)


@dataclass(frozen=True)
class BradleyTerryMM:
    """Minorisation-maximisation of Bradley-Terry strengths, by component, with undefeated and winless entities apart.

    ``table``: ``section, kind, entity, score``; kinds ``ranked`` (strengths that sum to 1 in their section), ``undefeated``
    (rows won), ``winless`` (minus rows lost, if removed) and ``isolated`` (whose opponents were all taken out; null score).
    Beyond ``local_pairs`` pairs the same maximum is reached by accelerated rounds of Spark jobs; made-up games and links are for
    pair tables in one memory only, and a start from earlier strengths isn't needed there.
    """

    iterations: int = 10_000
    tolerance: float = 1e-6
    min_graph_size: int = 1
    remove_total_losers: bool = False
    create_fake_games: float = 0.0
    random_subgraph_links: int = 0
    random_subgraph_weight: float = 1e-3
    seed: int = 1221
    local_pairs: int = 5_000_000

    def _large(self, arcs: Any) -> Model:
        if self.create_fake_games > 0 or self.random_subgraph_links:
            raise TooLarge("made-up games and links need the pairs in one memory")
        return sweeps().bradley_terry(arcs, self)

    def fit(self, pairs: DataFrame, init: Model | None = None) -> Model:
        c = cells_or_arcs(pairs, "btm-mm", self.local_pairs)
        if not isinstance(c, Cells):
            return self._large(c)
        a, b, w, n = c.a, c.b, c.w, c.n
        kinds: dict[str, list[tuple[str, float]]] = {"undefeated": [], "winless": []}
        if self.create_fake_games > 0:
            never_lost = np.setdiff1d(np.unique(a), np.unique(b))
            others = [int(b[a == i][0]) for i in never_lost]
            a, b = np.concatenate([a, others]).astype(int), np.concatenate([b, never_lost]).astype(int)
            w, n = np.concatenate([w, np.full(len(others), self.create_fake_games)]), np.concatenate([n, np.ones(len(others))])
        else:
            while len(a):
                up = np.setdiff1d(np.unique(a), np.unique(b))
                down = np.setdiff1d(np.unique(b), np.unique(a)) if self.remove_total_losers else np.array([], int)
                if not len(up) and not len(down):
                    break
                kinds["undefeated"] += [(c.names[i], float(n[a == i].sum())) for i in up]
                kinds["winless"] += [(c.names[i], -float(n[b == i].sum())) for i in down]
                keep = ~np.isin(a, up) & ~np.isin(b, down) & ~np.isin(b, up) & ~np.isin(a, down)
                a, b, w, n = a[keep], b[keep], w[keep], n[keep]
        label = _components(c.size, a, b)
        alive = np.unique(np.concatenate([a, b]))
        groups = sorted(({int(x): alive[label[alive] == x] for x in np.unique(label[alive])}).values(), key=lambda g: (-len(g), g[0]))
        if self.random_subgraph_links and len(groups) > 1:
            rng = np.random.Generator(np.random.Philox(self.seed))
            for g in groups[1:]:
                for _ in range(self.random_subgraph_links):
                    x, y = int(rng.choice(groups[0])), int(rng.choice(g))
                    a, b = np.concatenate([a, [x, y]]), np.concatenate([b, [y, x]])
                    w, n = np.concatenate([w, [self.random_subgraph_weight] * 2]), np.concatenate([n, [1, 1]])
            groups = [alive]
        old = {r.entity: r.score for r in init.table.where("kind = 'ranked'").collect()} if init is not None else {}
        rows, sweeps = [], 0
        for section, g in enumerate(x for x in groups if len(x) >= self.min_graph_size):
            at = np.full(c.size, -1)
            at[g] = np.arange(len(g))
            m = at[a] >= 0
            pi0 = np.array([old.get(c.names[k], 1 / len(g)) for k in g])
            pi, used = mm_sweeps(at[a[m]], at[b[m]], w[m], len(g), pi0, self.iterations, self.tolerance)
            sweeps = max(sweeps, used)
            rows += [(section, "ranked", c.names[k], float(p)) for k, p in zip(g, pi, strict=True)]
        extra = len({r[0] for r in rows})
        said = {r[2] for r in rows} | {k for v in kinds.values() for k, _ in v}
        for k, (kind, xs) in enumerate(kinds.items()):
            rows += [(extra + k, kind, e, s) for e, s in xs]
        rows += [(extra + 2, "isolated", e, None) for i, e in enumerate(c.names) if e not in said and i not in set(alive.tolist())]
        return Model("btm-mm", params_of(self), pairs.sparkSession.createDataFrame(rows, "section int, kind string, entity string, score double"), {"sweeps": sweeps})


def sweeps():
    """The module of the distributed iterations, which needs this one's neighbours."""
    from ranksmith.operators import sweeps as module

    return module


def mm_sweeps(a, b, w, n, pi, iterations, tolerance):
    """Hunter's MM: ``pi_i = W_i / sum_j n_ij / (pi_i + pi_j)``, summing to 1."""
    pi = pi / pi.sum()
    won = np.bincount(a, w, n)
    for k in range(iterations):
        x = w / (pi[a] + pi[b])
        new = won / (np.bincount(a, x, n) + np.bincount(b, x, n))
        new /= new.sum()
        moved = np.abs(new - pi).mean()
        pi = new
        if moved < tolerance:
            return pi, k + 1
    return pi, iterations


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def mm_distributed(pairs: DataFrame, sweeps: int) -> DataFrame:
    """``entity, score`` after fixed MM sweeps, each a Spark job on the written pair table; for pair tables beyond one memory.

    For one component in which everybody won and lost; scores sum to 1.
    """
    disk = Scratch(pairs.sparkSession, "mm")
    cells = disk.save(pair_table(clean_pairs(pairs)).select("i", "j", (F.col("w_ij") + F.col("w_ji")).alias("n"), "w_ij", "w_ji"))
    ends = F.array(F.struct(F.col("i").alias("entity"), F.col("w_ij").alias("w")), F.struct(F.col("j").alias("entity"), F.col("w_ji").alias("w")))
    won = disk.save(cells.select(F.explode(ends).alias("e")).select("e.*").groupBy("entity").agg(F.sum("w").alias("won")))
    m = won.count()
    state = disk.save(won.select("entity", "won", F.lit(1 / m).alias("pi")))
    for _ in range(sweeps):
        pi = state.select("entity", "pi")
        x = cells.join(pi.withColumnRenamed("entity", "i").withColumnRenamed("pi", "pi_i"), "i").join(pi.withColumnRenamed("entity", "j").withColumnRenamed("pi", "pi_j"), "j")
        t = F.col("n") / (F.col("pi_i") + F.col("pi_j"))
        x = x.select(F.explode(F.array(F.struct(F.col("i").alias("entity"), t.alias("t")), F.struct(F.col("j").alias("entity"), t.alias("t")))).alias("e")).select("e.*")
        new = state.select("entity", "won").join(x.groupBy("entity").agg(F.sum("t").alias("t")), "entity").select("entity", "won", (F.col("won") / F.col("t")).alias("pi"))
        new = disk.save(new)
        total = new.agg(F.sum("pi")).first()[0]
        disk.drop(state)
        state = new.withColumn("pi", F.col("pi") / F.lit(total))
        state._scratch_path = new._scratch_path
    return state.select("entity", F.col("pi").alias("score"))
