"""Consensus orders: Kemeny, footrule, Mallows, and the differential evolution that can search them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.functions.math import bracketed_root
from ranksmith.model import EmptyDataset, InvalidInput, Model, TooLarge, params_of
from ranksmith.operators.pairs import Cells, ballots_to_pairwise, bounded, clean_pairs, local_cells
from ranksmith.operators.spectral import frame

#: The searches keep an n by n table.
MAX_ITEMS = 5000


def _order_model(data: DataFrame, algorithm: str, op, names: list[str], order: np.ndarray, **info) -> Model:
    """Best first, as scores n down to 1."""
    n = len(order)
    return Model(algorithm, params_of(op), frame(data, {"entity": [names[k] for k in order], "score": [float(n - i) for i in range(n)]}, "entity string, score double"), info)


@dataclass(frozen=True)
class DifferentialEvolution:
    """Maximises a function of a vector by DE/best/1 with dithered steps; deterministic for a seed."""

    dims: int
    population: int | None = None
    f: tuple[float, float] = (0.1, 0.9)
    cr: float = 0.9
    span: float = 1.0

    def fit(self, value: Callable[[np.ndarray], float], evaluations: int, seed: int, start: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        rng = np.random.Generator(np.random.Philox(seed))
        size = self.population or max(4, int(self.dims**0.7))
        x = rng.uniform(-self.span, self.span, (size, self.dims))
        if start is not None:
            x[0] = start
        v = np.array([value(p) for p in x])
        left = evaluations - size
        while left > 0:
            for k in range(size):
                i, j = rng.choice(size, 2, replace=False)
                trial = x[v.argmax()] + rng.uniform(*self.f) * (x[i] - x[j])
                take = rng.random(self.dims) < self.cr
                take[rng.integers(self.dims)] = True
                trial = np.where(take, trial, x[k])
                t = value(trial)
                if t >= v[k]:
                    x[k], v[k] = trial, t
                left -= 1
        return float(v.max()), x[v.argmax()]


@dataclass(frozen=True)
class Kemeny:
    """The order that agrees with most comparisons, by repeated best insertion or by differential evolution.

    ``passes=None`` means one insertion pass, or 50 000 evaluations. Weights must be whole numbers. Equal starts are ordered by
    first appearance (by ``seq`` where there is one, else by name).
    """

    passes: int | None = None
    min_obs: int = 1
    algo: str = "insertion"
    seed: int = 2020

    def fit(self, pairs: DataFrame) -> Model:
        x = clean_pairs(pairs)
        c = local_cells(x)
        if (c.w % 1).any():
            raise InvalidInput("weights must be whole numbers")
        if c.size > MAX_ITEMS:
            raise TooLarge(f"more than {MAX_ITEMS} entities")
        wins = np.zeros((c.size, c.size))
        np.add.at(wins, (c.a, c.b), c.w)
        few = wins + wins.T < self.min_obs
        wins[few] = 0
        rank = np.arange(c.size)
        if "seq" in x.columns:
            # Within a row the winner is seen first.
            ends = x.select(F.explode(F.array(F.struct(F.col("winner").alias("e"), F.struct("seq", F.lit(0).alias("o")).alias("s")), F.struct(F.col("loser").alias("e"), F.struct("seq", F.lit(1).alias("o")).alias("s")))).alias("r"))
            seen = bounded(ends.groupBy("r.e").agg(F.min("r.s").alias("s")).select("e", "s.seq", "s.o"), MAX_ITEMS, "entities").sort_values(["seq", "o"])
            at = {e: i for i, e in enumerate(seen["e"])}
            rank = np.array([at[k] for k in c.names])
        order = self._insert(wins, rank) if self.algo == "insertion" else self._evolve(wins)
        place = np.empty(c.size, int)
        place[order] = np.arange(c.size)
        agreed = float(c.w[place[c.a] < place[c.b]].sum())
        return _order_model(pairs, "kemeny", self, c.names, order, concordant=agreed)

    def _insert(self, wins: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Worst first while inserting: an item is scored by its wins over those to its left and their wins to its right."""
        majorities = (wins > wins.T).sum(axis=1)
        order = np.lexsort((-rank, -majorities))
        last = 0.0
        for _ in range(1 if self.passes is None else self.passes):
            line: list[int] = []
            total = 0.0
            for e in order:
                left, right = wins[e, line], wins[line, e]
                # Gain at each gap: what it beats before the gap, and what beats it after.
                gain = np.concatenate([[0.0], np.cumsum(left)]) + np.concatenate([np.cumsum(right[::-1])[::-1], [0.0]])
                at = int(gain.argmax())
                total += float(gain[at])
                line.insert(at, int(e))
            order = np.array(line)
            if total == last:
                break
            last = total
        return order[::-1]

    def _evolve(self, wins: np.ndarray) -> np.ndarray:
        n = len(wins)

        def agreed(x: np.ndarray) -> float:
            o = np.argsort(-x, kind="stable")
            return float(np.triu(wins[np.ix_(o, o)], 1).sum())

        _, x = DifferentialEvolution(n).fit(agreed, 50_000 if self.passes is None else self.passes, self.seed)
        return np.argsort(-x, kind="stable")


def rank_costs(ballots: DataFrame) -> DataFrame:
    """``entity, pos, cost``: summed distance between the item's place on the ballots that name it and each place of all."""
    placed = ballots.select(F.posexplode("items").alias("p", "entity")).groupBy("entity", F.col("p").cast("int").alias("p")).agg(F.count("*").alias("k"))
    n = placed.select("entity").distinct().count()
    spread = placed.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    return spread.groupBy("entity", "pos").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("pos"))).cast("long").alias("cost"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest perfect matching, by shortest augmenting paths with potentials."""
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for i in range(n):
        row_of[n], j0 = i, n
        dist, prev, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j0] >= 0:
            done[j0] = True
            r = row_of[j0]
            new = cost[r] - u[r] - v[:n]
            better = ~done[:n] & (new < dist)
            dist[better], prev[better] = new[better], j0
            j1 = int(np.where(done[:n], np.inf, dist).argmin())
            delta = dist[j1]
            seen = np.flatnonzero(done)
            u[row_of[seen]] += delta
            v[seen] -= delta
            dist[~done[:n]] -= delta
            j0 = j1
        while j0 != n:
            row_of[j0], j0 = row_of[prev[j0]], prev[j0]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


@dataclass(frozen=True)
class Footrule:
    """The order nearest to all ballots in summed distance of places, exactly, by an assignment."""

    def fit(self, ballots: DataFrame) -> Model:
        rows = bounded(rank_costs(ballots), MAX_ITEMS * 400, "cells of item and place")
        if not len(rows):
            raise EmptyDataset("no ballot")
        names = sorted(set(rows["entity"]), key=lambda s: s.encode())
        at = {k: i for i, k in enumerate(names)}
        cost = np.zeros((len(names), len(names)))
        cost[[at[e] for e in rows["entity"]], rows["pos"]] = rows["cost"]
        place = assignment(cost)
        return _order_model(ballots, "footrule", self, names, np.argsort(place), cost=int(cost[np.arange(len(names)), place].sum()))


def kendall_distance(ballots: DataFrame, order: list[str]) -> DataFrame:
    """``ballot_id, distance``: pairs of a ballot in another order than ``order``, counted within the ballot."""
    # One pass of each ballot over its own places in the order.
    spark = ballots.sparkSession
    known = spark.createDataFrame(list(enumerate(order)), "rank int, entity string")
    x = ballots.select("ballot_id", F.posexplode("items").alias("p", "entity")).join(F.broadcast(known), "entity")
    lists = x.groupBy("ballot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "rank"))), lambda s: s["rank"]).alias("r"))
    after = F.transform("r", lambda v, i: F.size(F.filter(F.slice("r", i + 2, F.greatest(F.size("r") - i - 1, F.lit(0))), lambda w: w < v)))
    return lists.select("ballot_id", F.aggregate(after, F.lit(0), lambda s, v: s + v).alias("distance"))


@dataclass(frozen=True)
class Mallows:
    """Central order and dispersion of ballots that all rank the same items."""

    passes: int | None = None
    seed: int = 1957

    def fit(self, ballots: DataFrame) -> Model:
        distinct = bounded(ballots.groupBy("items").agg(F.count("*").alias("k")), 1_000_000, "distinct ballots")
        if not len(distinct):
            raise EmptyDataset("no ballot")
        items = sorted(distinct["items"].iloc[0], key=lambda s: s.encode())
        if any(sorted(x, key=lambda s: s.encode()) != items or len(set(x)) < len(x) for x in distinct["items"]):
            raise InvalidInput("ballots must be orders of one set of items")
        model = Kemeny(passes=self.passes or 50, seed=self.seed).fit(ballots_to_pairwise(ballots))
        order = [r.entity for r in model.scores().collect()]
        at = {k: i for i, k in enumerate(order)}
        n = len(order)
        d = np.array([_inversions([at[k] for k in x]) for x in distinct["items"]], float)
        mean = float((d * distinct["k"]).sum() / distinct["k"].sum())
        theta = _mallows_theta(n, mean)
        phi = 0.0 if mean == 0 else 1 - 1e-12 if theta is None else float(np.exp(-theta))
        return _order_model(ballots, "mallows", self, order, np.arange(n), phi=phi, mean_distance=mean)


def _inversions(x: list[int]) -> int:
    a = np.array(x)
    return int((a[:, None] > a[None, :])[np.triu_indices(len(a), 1)].sum())


def _mallows_theta(n: int, mean: float) -> float | None:
    if mean == 0 or mean >= n * (n - 1) / 4:
        return None
    j = np.arange(1, n + 1)

    def gap(t: float) -> float:
        return float(n / np.expm1(t) - (j / np.expm1(j * t)).sum() - mean)

    return bracketed_root(gap, 1e-9, 50.0)


def majority_table(c: Cells) -> np.ndarray:
    i, j, wi, wj = c.unordered()
    return np.stack([i, j, np.sign(wi - wj).astype(int)], axis=1)


def ballot_positions(ballots: DataFrame) -> DataFrame:
    """``ballot_id, entity, place``: 1-based places."""
    return ballots.select("ballot_id", F.posexplode("items").alias("p", "entity")).select("ballot_id", "entity", (F.col("p") + 1).alias("place"))


def dense_ranks(scores: DataFrame) -> DataFrame:
    """``entity, score, rank``: 1-based, by score and then by name. Of one result table, so one sort."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "entity")))
