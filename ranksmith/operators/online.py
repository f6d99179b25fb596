"""Online ratings and other folds whose order matters.

A fold is one sequence by definition, so it runs in one task for each *league* (a column; without one, all rows are one
league). Rows come to it sorted by ``seq``, batch by batch, and only the entities' states are held in memory. Leagues
run in parallel. The same ``step`` is used by the batch update, the SQL table function and the stream.
Rows of a later update come after all earlier ones, whatever their seq.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions.math import ERF_A, ERF_P, np_norm_cdf
from ranksmith.model import Model, params_of, same_params
from ranksmith.operators.pairs import finite, require, single_players
from ranksmith.session import Scratch, hot_keys, lookup

State = dict[str, list[float]]
STATE = "league string, entity string, state array<double>"
#: A smaller normal mass than this counts as none.
TINY = 2.222758749e-162


class Fold:
    """Base of the folds: subclasses say how a row changes the states, and what is shown of a state."""

    algorithm = ""

    def payload(self, data: DataFrame) -> DataFrame:
        """``league, seq, payload``: a row's fields as a struct."""
        raise NotImplementedError

    def step(self, state: State, row: dict[str, Any]) -> None:
        raise NotImplementedError

    def follow(self) -> Callable[[State, Any], None]:
        """``step`` for one of the ``rows`` of a batch."""
        return self.step

    def rows(self, payload: pa.StructArray) -> Iterable[Any]:
        # Field by field, as Arrow makes one list of a column much faster than structs.
        names = [f.name for f in payload.type]
        return (dict(zip(names, p, strict=True)) for p in zip(*(c.to_pylist() for c in payload.flatten()), strict=True))

    def shown(self, state: DataFrame) -> DataFrame:
        return state.withColumn("score", F.col("state")[0])

    def init(self, spark: SparkSession) -> Model:
        return Model(self.algorithm, params_of(self), self.shown(spark.createDataFrame([], STATE)))

    def fit(self, data: DataFrame) -> Model:
        return self.update(self.init(data.sparkSession), data)

    def update(self, model: Model, data: DataFrame) -> Model:
        same_params(model, self)
        rows = self.payload(data).select("league", F.lit(1).alias("o"), "seq", F.lit(None).cast("string").alias("entity"), F.lit(None).cast("array<double>").alias("state"), "payload")
        old = model.table.select("league", F.lit(0).alias("o"), F.lit(None).cast("long").alias("seq"), "entity", "state", F.lit(None).cast(rows.schema["payload"].dataType).alias("payload"))
        # A given number of partitions, or adaptive execution would put small leagues into one task.
        spark = data.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism)
        x = old.unionByName(rows).repartition(n, "league").sortWithinPartitions("league", "o", "seq", "payload").select("league", "entity", "state", "payload")
        return Model(self.algorithm, params_of(self), self.shown(x.mapInArrow(self._run, STATE)))

    def _run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        league, state, begun, step = None, {}, False, self.follow()
        for batch in batches:
            for g, entity, s, row in zip(*(c.to_pylist() for c in batch.columns[:3]), self.rows(batch.column(3)), strict=True):
                if not begun or g != league:
                    if state:
                        yield _rows(league, state)
                    league, state, begun = g, {}, True
                if entity is not None:
                    state[entity] = list(s)
                else:
                    step(state, row)
        if state:
            yield _rows(league, state)


def _rows(league: str, state: State) -> pa.RecordBatch:
    columns = [pa.array([league] * len(state), pa.string()), pa.array(list(state), pa.string()), pa.array([[float(v) for v in s] for s in state.values()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["league", "entity", "state"])


def _league(data: DataFrame):
    return F.col("league").cast("string") if "league" in data.columns else F.lit("")


def duels(games: DataFrame) -> DataFrame:
    """1v1 games as payloads: names, sign of the margin, its size, and the count. In a stream other games are left out."""
    if games.isStreaming:
        games = games.where((F.size("side1") == 1) & (F.size("side2") == 1))
    else:
        games = single_players(games)
    x = games.where(F.col("side1")[0].isNotNull() & F.col("side2")[0].isNotNull() & finite(F.col("margin").cast("double")) & finite(F.col("weight").cast("double")))
    fields = F.struct(F.col("side1")[0].alias("a"), F.col("side2")[0].alias("b"), F.col("margin").cast("double").alias("m"), F.col("weight").cast("double").alias("w"))
    return x.select(_league(games).alias("league"), "seq", fields.alias("payload"))


def _outcome(m: float) -> float:
    return 1.0 if m > 0 else 0.0 if m < 0 else 0.5


@dataclass(frozen=True)
class Elo(Fold):
    k: float = 32.0
    initial_rating: float = 1500.0
    scale: float = 400.0
    algorithm = "elo"

    def payload(self, data: DataFrame) -> DataFrame:
        return duels(data)

    def gain(self, margin: float) -> float:
        return 1.0

    def step(self, state: State, row: dict[str, Any]) -> None:
        a = state.setdefault(row["a"], [self.initial_rating])
        b = state.setdefault(row["b"], [self.initial_rating])
        e = 1 / (1 + 10 ** ((b[0] - a[0]) / self.scale))
        d = self.k * row["w"] * (_outcome(row["m"]) - e) * self.gain(row["m"])
        a[0] += d
        b[0] -= d


@dataclass(frozen=True)
class MovElo(Elo):
    """Elo with wins counted by the logarithm of their margin."""

    mov_exponent: float = 1.0
    algorithm = "elo-mov"

    def gain(self, margin: float) -> float:
        return 1.0 if margin == 0 else (math.log1p(abs(margin)) / math.log(2)) ** self.mov_exponent


@dataclass(frozen=True)
class MElo(Fold):
    """Elo with vectors for cycles; a name's starting vector depends on the seed and the name only."""

    k: int = 1
    lr_rating: float = 16.0
    lr_vector: float = 1.0
    initial_rating: float = 0.0
    init_scale: float = 0.1
    seed: int = 2018
    algorithm = "melo"

    def payload(self, data: DataFrame) -> DataFrame:
        return duels(data)

    def _new(self, name: str) -> list[float]:
        import zlib

        rng = np.random.Generator(np.random.Philox(key=[self.seed, zlib.crc32(name.encode())]))
        return [self.initial_rating, *rng.normal(0, self.init_scale, 2 * self.k).tolist()]

    @staticmethod
    def form(x: list[float], y: list[float]) -> float:
        return sum(x[i] * y[i + 1] - x[i + 1] * y[i] for i in range(1, len(x), 2))

    def step(self, state: State, row: dict[str, Any]) -> None:
        for n in (row["a"], row["b"]):
            if n not in state:
                state[n] = self._new(n)
        a, b = state[row["a"]], state[row["b"]]
        z = a[0] - b[0] + self.form(a, b)
        d = row["w"] * (_outcome(row["m"]) - 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
        was = list(a)
        a[0] += self.lr_rating * d
        b[0] -= self.lr_rating * d
        for i in range(1, len(a), 2):
            xb, yb = b[i], b[i + 1]
            a[i] += self.lr_vector * d * yb
            a[i + 1] -= self.lr_vector * d * xb
            b[i] -= -self.lr_vector * d * was[i + 1]
            b[i + 1] -= self.lr_vector * d * was[i]

    @staticmethod
    def predict(model: Model, asked: DataFrame) -> DataFrame:
        """``league, a, b, p`` for the asked pairs."""
        t = model.table
        x = asked.join(t.select("league", F.col("entity").alias("a"), F.col("state").alias("sa")), ["league", "a"]).join(t.select("league", F.col("entity").alias("b"), F.col("state").alias("sb")), ["league", "b"])
        form = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("sa") - 1), lambda i: F.when(i == 0, F.get("sa", i) - F.get("sb", i)).when(i % 2 == 1, F.get("sa", i) * F.get("sb", i + 1)).otherwise(-F.get("sa", i) * F.get("sb", i - 1))), F.lit(0.0), lambda s, v: s + v)
        return x.select("league", "a", "b", (1 / (1 + F.exp(-form))).alias("p"))


@dataclass(frozen=True)
class WengLin(Fold):
    """Team ratings ``mu, sigma`` from ranked teams, full pairings; score is mu minus three sigma."""

    variant: str = "bradley-terry"
    mu: float = 25.0
    sigma: float = 25.0 / 3
    beta: float = 25.0 / 6
    kappa: float = 1e-4
    epsilon: float = 0.1
    tau: float = 0.0
    gamma: str = "sigma-over-c"
    algorithm = "weng-lin"

    def payload(self, data: DataFrame) -> DataFrame:
        bad = F.exists("teams", lambda t: t["players"].isNull() | (F.size(t["players"]) == 0))
        everyone = F.flatten(F.transform("teams", lambda t: t["players"]))
        broken = (F.size("teams") < 2) | bad | (F.size(F.array_distinct(everyone)) < F.size(everyone))
        if data.isStreaming:
            data = data.where(~broken)
        else:
            data = require(data, ~broken, "a match needs two teams, none empty, and no player twice")
        return data.select(_league(data).alias("league"), "seq", F.struct(F.transform("teams", lambda t: F.struct(t["rank"].alias("r"), t["players"].alias("p"))).alias("t")).alias("payload"))

    def shown(self, state: DataFrame) -> DataFrame:
        s = F.col("state")
        return state.select("league", "entity", "state", s[0].alias("mu"), s[1].alias("sigma"), (s[0] - 3 * s[1]).alias("score"))

    def _shift(self, x: float, t: float, won: int) -> tuple[float, float]:
        """Mean shift and variance factor of the probit variant."""
        pdf = lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi)
        cdf = lambda v: float(np_norm_cdf(v))
        if won:
            y = (x if won > 0 else -x) - t
            mass = cdf(y)
            v = -y if mass <= TINY else pdf(y) / mass
            return won * v, v * (v + y)
        mass = cdf(t - x) - cdf(-t - x)
        if mass <= TINY:
            return (-x - t if x < 0 else -x + t), 1.0
        v = (pdf(-t - x) - pdf(t - x)) / mass
        return v, ((t - x) * pdf(t - x) + (t + x) * pdf(t + x)) / mass + v * v

    def step(self, state: State, row: dict[str, Any]) -> None:
        self.follow()(state, ([t["r"] for t in row["t"]], [t["p"] for t in row["t"]]))

    def rows(self, payload: pa.StructArray) -> Iterable[Any]:
        """The ranks and the teams of each match; where all teams of a batch are of one player, the players instead."""
        matches = payload.flatten()[0]
        ranks, teams = matches.values.field("r"), matches.values.field("p")
        if not len(teams) or ranks.null_count or teams.null_count:
            return (([t["r"] for t in m], [t["p"] for t in m]) if m is not None else None for m in matches.to_pylist())
        begin = teams.offsets.to_numpy()
        if (np.diff(begin) == 1).all():
            people = teams.values.slice(begin[0], begin[-1] - begin[0]).to_pylist()
        else:
            people = teams.to_pylist()
        ranks, at = ranks.to_numpy().tolist(), matches.offsets.to_numpy().tolist()
        return ((ranks[i:j], people[i:j]) for i, j in itertools.pairwise(at))

    def follow(self) -> Callable[[State, Any], None]:
        """One pass over the pairs of a match: what moves one side moves the other against it. Constants are bound once, as there are millions of pairs."""
        exp, sqrt, shift, mean, sd, kappa, epsilon, tau = math.exp, math.sqrt, self._shift, self.mu, self.sigma, self.kappa, float(self.epsilon), self.tau
        noise, probit, by_c, half, scale, tiny = 2 * self.beta**2, self.variant != "bradley-terry", self.gamma == "sigma-over-c", math.sqrt(0.5), 1 / math.sqrt(2 * math.pi), TINY
        e0, (e1, e2, e3, e4, e5) = ERF_P, ERF_A

        def rate(state: State, match: tuple[list[int], list[Any]]) -> None:
            ranks, teams = match
            n = len(ranks)
            alone = type(teams[0]) is str
            if alone:
                seats = [state.get(p) or state.setdefault(p, [mean, sd]) for p in teams]
                if tau:
                    for s in seats:
                        s[1] = sqrt(s[1] ** 2 + tau**2)
                mus, vs = [s[0] for s in seats], [s[1] * s[1] for s in seats]
            else:
                seats = [[state.setdefault(p, [mean, sd]) for p in t] for t in teams]
                if tau:
                    for t in seats:
                        for s in t:
                            s[1] = sqrt(s[1] ** 2 + tau**2)
                mus, vs = [sum(s[0] for s in t) for t in seats], [sum(s[1] * s[1] for s in t) for t in seats]
            shifts, factors = [0.0] * n, [0.0] * n
            for i in range(n - 1):
                mu, var, rank, omega, delta = mus[i], vs[i], ranks[i], shifts[i], factors[i]
                for q in range(i + 1, n):
                    other = ranks[q]
                    c = sqrt(var + vs[q] + noise)
                    x = (mu - mus[q]) / c
                    if not probit:
                        v = 1.0 / (1.0 + exp(-x))
                        w = v * (1.0 - v)
                        v = (1.0 if other > rank else 0.0 if other < rank else 0.5) - v
                    elif other == rank:
                        # Far out, what the two ends of the interval leave of their difference isn't the same from both sides.
                        v, w = shift(x, epsilon / c, 0)
                        back, more = shift(-x, epsilon / c, 0)
                        omega += v / c
                        delta += w / (c * c * c if by_c else c * c)
                        shifts[q] += back / c
                        factors[q] += more / (c * c * c if by_c else c * c)
                        continue
                    else:
                        # The normal distribution function of np_norm_cdf, and its density.
                        y = (x if other > rank else -x) - epsilon / c
                        if y >= 0.0:
                            a = y * half
                            t = 1.0 / (1.0 + e0 * a)
                            a = exp(-a * a)
                            mass = (1.0 + (1.0 - ((((e5 * t + e4) * t + e3) * t + e2) * t + e1) * t * a)) * 0.5
                        else:
                            a = -y * half
                            t = 1.0 / (1.0 + e0 * a)
                            a = exp(-a * a)
                            mass = (1.0 - (1.0 - ((((e5 * t + e4) * t + e3) * t + e2) * t + e1) * t * a)) * 0.5
                        v = -y if mass <= tiny else a * scale / mass
                        w = v * (v + y)
                        if other < rank:
                            v = -v
                    v /= c
                    w /= c * c * c if by_c else c * c
                    omega += v
                    delta += w
                    shifts[q] -= v
                    factors[q] += w
                shifts[i], factors[i] = omega, delta
            for s, var, omega, delta in zip(seats, vs, shifts, factors, strict=True):
                delta *= sqrt(var) if by_c else 1.0 / n
                for s in (s,) if alone else s:
                    # The player's part of the team's variance, times the variance.
                    part = s[1] * s[1]
                    s[0] += part * omega
                    left = 1.0 - part * delta
                    s[1] *= sqrt(left if left > kappa else kappa)

        return rate


@dataclass(frozen=True)
class TdValue(Fold):
    """State values by temporal differences, in the order of the steps; score with the number of updates."""

    alpha: float = 0.1
    gamma: float = 1.0
    passes: int = 1
    initial_value: float = 0.0
    algorithm = "td-value"

    def payload(self, data: DataFrame) -> DataFrame:
        """Steps (episode_id, step, state, reward) with the next state of the episode; a window per episode."""
        from pyspark.sql import Window

        x = data.where(F.col("state").isNotNull() & finite(F.col("reward").cast("double")))
        keys = [c for c in ("league",) if c in data.columns]
        nxt = F.lead("state").over(Window.partitionBy(*keys, "episode_id").orderBy("step"))
        x = x.withColumn("_n", nxt)
        fields = F.struct(F.col("episode_id").cast("string").alias("e"), F.col("step").alias("i"), F.col("state").alias("s"), F.col("reward").cast("double").alias("r"), F.col("_n").alias("n"))
        seq = F.col("seq") if "seq" in data.columns else F.col("step").cast("long")
        x = x.select(_league(data).alias("league"), seq.alias("seq"), fields.alias("payload"))
        return x if self.passes == 1 else x.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(self.passes - 1))) * F.lit(1 << 40) + F.col("seq"))

    def shown(self, state: DataFrame) -> DataFrame:
        return state.select("league", "entity", "state", F.col("state")[0].alias("score"), F.col("state")[1].cast("long").alias("n"))

    def step(self, state: State, row: dict[str, Any]) -> None:
        v = state.setdefault(row["s"], [self.initial_value, 0.0])
        nxt = state.get(row["n"], [self.initial_value])[0] if row["n"] is not None else 0.0
        v[0] += self.alpha * (row["r"] + self.gamma * nxt - v[0])
        v[1] += 1


@dataclass(frozen=True)
class Exp3(Fold):
    """Exponential weights of arms; each reward is divided by the chance its arm had, among the arms seen so far."""

    gamma: float = 0.1
    algorithm = "exp3"

    def payload(self, data: DataFrame) -> DataFrame:
        x = data.where(F.col("arm").isNotNull() & finite(F.col("reward").cast("double")))
        return x.select(_league(data).alias("league"), "seq", F.struct(F.col("arm").alias("a"), F.col("reward").cast("double").alias("r")).alias("payload"))

    def shown(self, state: DataFrame) -> DataFrame:
        """``state``: gain, pulls, summed rewards; score is the chance of the arm."""
        from pyspark.sql import Window

        w = Window.partitionBy("league")
        x = state.withColumn("_g", F.col("state")[0])
        x = x.withColumn("_e", F.exp(F.col("_g") - F.max("_g").over(w)))
        p = (1 - self.gamma) * F.col("_e") / F.sum("_e").over(w) + F.lit(self.gamma) / F.count("*").over(w)
        return x.select("league", "entity", "state", p.alias("score"), F.col("state")[1].cast("long").alias("n"))

    def step(self, state: State, row: dict[str, Any]) -> None:
        s = state.setdefault(row["a"], [0.0, 0.0, 0.0])
        top = max(v[0] for v in state.values())
        total = sum(math.exp(v[0] - top) for v in state.values())
        p = (1 - self.gamma) * math.exp(s[0] - top) / total + self.gamma / len(state)
        s[0] += self.gamma * row["r"] / p / len(state)
        s[1] += 1
        s[2] += row["r"]


# -- Glicko-2: parallel within a period --------------------------------------------------------------------------------

GLICKO_SCALE = 173.7178
#: Up to this many players (a name and two numbers, about 50 MB as a hash table) go to every task; more are joined with hot ones spread.
BROADCAST_PLAYERS = 500_000


@dataclass(frozen=True)
class Glicko2:
    """Ratings, deviations and volatilities by rating period; the games of a period are one aggregation against frozen ratings.

    Only players of a period change. ``entity, rating, rd, sigma, score``.
    """

    tau: float = 0.5
    rating: float = 1500.0
    rd: float = 350.0
    sigma: float = 0.06

    _schema = "entity string, rating double, rd double, sigma double"

    def init(self, spark: SparkSession) -> Model:
        return Model("glicko2", params_of(self), spark.createDataFrame([], self._schema).withColumn("score", F.col("rating")))

    def fit(self, games: DataFrame) -> Model:
        return self.update(self.init(games.sparkSession), games)

    def update(self, model: Model, games: DataFrame) -> Model:
        same_params(model, self)
        disk = Scratch(games.sparkSession, "glicko2")
        g = single_players(games).where(finite(F.col("margin").cast("double")) & F.col("side1")[0].isNotNull() & F.col("side2")[0].isNotNull())
        period = F.col("period") if "period" in games.columns else F.lit(1)
        s = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") < 0, 0.0).otherwise(0.5)
        # A row for each player of a game; equal ones of a period are summed before anything else.
        seat = lambda me, you, score: F.struct(F.col(me)[0].alias("entity"), F.col(you)[0].alias("other"), score.alias("s"))
        x = g.select(period.alias("period"), F.col("weight").cast("double").alias("w"), F.explode(F.array(seat("side1", "side2", s), seat("side2", "side1", 1 - s))).alias("r"))
        x = x.groupBy("period", "r.entity", "r.other", "r.s").agg(F.sum("w").alias("w"))
        seats = disk.save(x)
        periods = sorted((r.period, r.n) for r in seats.groupBy("period").agg(F.count("*").alias("n")).collect())
        # A large state isn't written anew each period but only its players, and merged every few periods.
        state = disk.save(model.table.select("entity", "rating", "rd", "sigma"))
        few = state.count() + seats.agg(F.count_distinct("entity")).first()[0] <= BROADCAST_PLAYERS
        for k, (p, n) in enumerate(periods):
            new = disk.save(self._period(disk, state, seats.where(F.col("period") == p), n, few))
            if few:
                state = new
                continue
            state = state.join(new.select("entity"), "entity", "left_anti").unionByName(new)
            if k % 8 == 7 or k + 1 == len(periods):
                state = disk.save(state)
        return Model("glicko2", params_of(self), state.withColumn("score", F.col("rating")))

    def _period(self, disk: Scratch, state: DataFrame, games: DataFrame, n: int, few: bool) -> DataFrame:
        # Both players' ratings by joins that a player in very many games can't unbalance.
        packed = state.select("entity", F.struct("rating", "rd").alias("v"))
        if few:
            x = games.join(F.broadcast(packed.withColumnRenamed("v", "me")), "entity", "left")
            x = x.join(F.broadcast(packed.select(F.col("entity").alias("other"), F.col("v").alias("you"))), "other", "left")
        else:
            hot = disk.save(hot_keys(games, "entity", n, "entity"))
            x = lookup(games, "entity", packed, "entity", "v", "me", hot)
            x = lookup(x, "other", packed, "entity", "v", "you", hot)
        known = lambda name: [F.coalesce(F.col(f"{name}.{c}"), F.lit(getattr(self, c))) for c in ("rating", "rd")]
        (ra, _), (rb, db) = known("me"), known("you")
        mu, mu_j, phi_j = ((c - 1500.0) / GLICKO_SCALE if k < 2 else c / GLICKO_SCALE for k, c in enumerate((ra, rb, db)))
        gj = 1 / F.sqrt(1 + 3 * phi_j * phi_j / F.lit(math.pi**2))
        e = 1 / (1 + F.exp(-gj * (mu - mu_j)))
        sums = x.groupBy("entity").agg(F.sum(F.col("w") * gj * gj * e * (1 - e)).alias("info"), F.sum(F.col("w") * gj * (F.col("s") - e)).alias("gain"))
        all_ = sums.join(state, "entity", "full" if few else "left").fillna({"rating": self.rating, "rd": self.rd, "sigma": self.sigma}).select("entity", "rating", "rd", "sigma", "info", "gain")
        tau = self.tau

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                m = pdf["info"].notna().to_numpy()
                t = pdf[m]
                phi, sigma = t["rd"].to_numpy() / GLICKO_SCALE, t["sigma"].to_numpy()
                v = 1 / t["info"].to_numpy()
                delta = v * t["gain"].to_numpy()
                new = np.array([volatility(a, b, c, d, tau) for a, b, c, d in zip(phi, sigma, v, delta, strict=True)])
                star = np.sqrt(phi**2 + new**2)
                after = 1 / np.sqrt(1 / star**2 + 1 / v)
                pdf.loc[m, "rating"] = t["rating"].to_numpy() + GLICKO_SCALE * after**2 * t["gain"].to_numpy()
                pdf.loc[m, "rd"] = GLICKO_SCALE * after
                pdf.loc[m, "sigma"] = new
                yield pdf[["entity", "rating", "rd", "sigma"]]

        return all_.mapInPandas(solve, self._schema)


def volatility(phi: float, sigma: float, v: float, delta: float, tau: float, tolerance: float = 1e-6) -> float:
    """The new volatility of the published procedure: a bracketed root by the Illinois rule."""
    a = math.log(sigma * sigma)

    def f(x: float) -> float:
        e = math.exp(x)
        d = phi * phi + v + e
        return e * (delta * delta - d) / (2 * d * d) - (x - a) / (tau * tau)

    lo = a
    if delta * delta > phi * phi + v:
        hi = math.log(delta * delta - phi * phi - v)
    else:
        k = 1
        while f(a - k * tau) < 0:
            k += 1
        hi = a - k * tau
    flo, fhi = f(lo), f(hi)
    while abs(hi - lo) > tolerance:
        mid = lo + (lo - hi) * flo / (fhi - flo)
        fm = f(mid)
        if fm * fhi <= 0:
            lo, flo = hi, fhi
        else:
            flo /= 2
        hi, fhi = mid, fm
    return math.exp(lo / 2)


# -- Whole-history rating ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whr:
    """Whole-history ratings: a timeline ``entity, period, rating, sd`` for each player, on the Elo scale.

    Pairs are summed by period in Spark; the timelines (player-periods) are then solved in one memory, bounded by ``limit``, player
    by player with exact tridiagonal Newton steps. ``score`` is the latest rating.
    """

    w2: float = 0.0006
    prior_games: float = 1.0
    iterations: int = 200
    tolerance: float = 1e-5
    limit: int = 5_000_000

    def fit(self, pairs: DataFrame, init: Model | None = None) -> Model:
        from ranksmith.operators.pairs import bounded, clean_pairs

        x = clean_pairs(pairs)
        period = F.col("period") if "period" in x.columns else F.lit(1)
        p = bounded(x.groupBy(period.cast("int").alias("t"), "winner", "loser").agg(F.sum("weight").alias("w")), self.limit, "pairs by period")
        names, at = np.unique(np.concatenate([p["winner"], p["loser"]]).astype(object), return_inverse=True)
        # Periods count by their place among those that occur.
        _, t = np.unique(p["t"].to_numpy(), return_inverse=True)
        tt = np.concatenate([t, t]).astype(np.int64)
        span = int(tt.max()) + 1 if len(tt) else 1
        days, day = np.unique(at.astype(np.int64) * span + tt, return_inverse=True)
        player, when = days // span, days % span
        m = len(p)
        a, b, w = day[:m], day[m:], p["w"].to_numpy(float)
        mine, other = np.concatenate([a, b]), np.concatenate([b, a])
        won, weight = np.concatenate([np.ones(m), np.zeros(m)]), np.tile(w, 2)
        order = np.argsort(mine, kind="stable")
        mine, other, won, weight = mine[order], other[order], won[order], weight[order]
        first = np.searchsorted(player, np.arange(len(names) + 1))
        seat = np.searchsorted(mine, np.arange(len(days) + 1))
        r = np.zeros(len(days))
        if init is not None:
            old = {(q.entity, q.period): q.rating / GLICKO_SCALE for q in init.table.collect()}
            raw = np.unique(p["t"].to_numpy())
            r = np.array([old.get((names[k], int(raw[q])), 0.0) for k, q in zip(player, when, strict=True)])

        def system(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lo, hi = first[k], first[k + 1]
            u = slice(seat[lo], seat[hi])
            s = 1 / (1 + np.exp(-(r[mine[u]] - r[other[u]])))
            n = hi - lo
            g = np.bincount(mine[u] - lo, weight[u] * (won[u] - s), n)
            h = -1e-3 - np.bincount(mine[u] - lo, weight[u] * s * (1 - s), n)
            s0 = 1 / (1 + np.exp(-r[lo]))
            g[0] += self.prior_games * (0.5 - s0)
            h[0] -= self.prior_games * s0 * (1 - s0)
            pull = 1 / (self.w2 * np.diff(when[lo:hi]))
            step = np.diff(r[lo:hi]) * pull
            g[:-1] += step
            g[1:] -= step
            h[:-1] -= pull
            h[1:] -= pull
            return g, h, pull

        used = self.iterations
        for sweep in range(self.iterations):
            moved = 0.0
            for k in range(len(names)):
                g, h, pull = system(k)
                d = thomas(h, pull, -g)
                r[first[k] : first[k + 1]] += d
                moved = max(moved, float(np.abs(d).max()))
            if moved < self.tolerance:
                used = sweep + 1
                break
        sd = np.empty(len(days))
        for k in range(len(names)):
            _, h, pull = system(k)
            sd[first[k] : first[k + 1]] = np.sqrt(inverse_diagonal(-h, -pull))
        raw = np.unique(p["t"].to_numpy())
        rows = pd.DataFrame({"entity": names[player], "period": raw[when].astype("int32"), "rating": r * GLICKO_SCALE, "sd": sd * GLICKO_SCALE})
        last = np.zeros(len(days), bool)
        last[first[1:] - 1] = True
        rows["score"] = np.repeat(rows["rating"].to_numpy()[last], np.diff(first))
        table = pairs.sparkSession.createDataFrame(rows, "entity string, period int, rating double, sd double, score double")
        return Model("whr", params_of(self), table, {"sweeps": used})


def thomas(diag: np.ndarray, off: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a symmetric tridiagonal system."""
    d, y = diag.astype(float).copy(), rhs.astype(float).copy()
    for k in range(1, len(d)):
        f = off[k - 1] / d[k - 1]
        d[k] -= f * off[k - 1]
        y[k] -= f * y[k - 1]
    y[-1] /= d[-1]
    for k in range(len(d) - 2, -1, -1):
        y[k] = (y[k] - off[k] * y[k + 1]) / d[k]
    return y


def inverse_diagonal(diag: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The diagonal of the inverse of a symmetric tridiagonal matrix, from elimination from both ends."""
    n = len(diag)
    down, up = diag.astype(float).copy(), diag.astype(float).copy()
    for k in range(1, n):
        down[k] -= off[k - 1] ** 2 / down[k - 1]
    for k in range(n - 2, -1, -1):
        up[k] -= off[k] ** 2 / up[k + 1]
    return 1 / (down + up - diag)
