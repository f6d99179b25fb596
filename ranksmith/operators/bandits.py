"""Bandits: arm states are sums, so they merge exactly; indices are expressions over the small arm table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksmith.model import InvalidInput, Model, ParamMismatch, params_of, same_params
from ranksmith.operators.online import Exp3
from ranksmith.operators.pairs import bounded, clean_pairs, finite, require

ARMS = "entity string, n long, total double, squares double"
#: Selection draws for every arm; that many can be looked at by hand.
MAX_ARMS = 1_000_000


def arm_sums(rewards: DataFrame) -> DataFrame:
    x = rewards.where(F.col("arm").isNotNull() & finite(F.col("reward").cast("double")))
    r = F.col("reward").cast("double")
    return x.groupBy(F.col("arm").alias("entity")).agg(F.count("*").alias("n"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"))


@dataclass(frozen=True)
class Bandit:
    """``policy``: greedy, epsilon-greedy, ucb1, thompson-beta, thompson-gaussian, kl-ucb, or exp3 (which is a fold).

    Arms never pulled score infinity under the bounds, their mean 0 or the prior's else. ``info['draws']`` counts selections, whose random
    numbers depend on the seed and that count only.
    """

    policy: str = "ucb1"
    epsilon: float = 0.1
    exploration: float = 2.0
    alpha: float = 1.0
    beta: float = 1.0
    prior_mean: float = 0.0
    prior_weight: float = 1.0
    c: float = 0.0
    gamma: float = 0.1
    seed: int = 42

    def init(self, spark: SparkSession) -> Model:
        if self.policy == "exp3":
            return self._named(Exp3(self.gamma).init(spark), 0)
        return Model("bandit", params_of(self), self._scored(spark.createDataFrame([], ARMS)), {"draws": 0})

    def fit(self, rewards: DataFrame) -> Model:
        return self.update(self.init(rewards.sparkSession), rewards)

    def update(self, model: Model, rewards: DataFrame) -> Model:
        same_params(model, self)
        if self.policy == "exp3":
            inner = Exp3(self.gamma)
            return self._named(inner.update(Model("exp3", params_of(inner), model.table, {}), rewards), model.info["draws"])
        if self.policy == "thompson-beta":
            rewards = require(rewards, F.coalesce(F.col("reward").between(0, 1), F.lit(True)), "rewards must lie in [0, 1]")
        both = model.table.select("entity", "n", "total", "squares").unionByName(arm_sums(rewards))
        return self._made(both, model.info["draws"])

    def _made(self, arms: DataFrame, draws: int) -> Model:
        t = arms.groupBy("entity").agg(*[F.sum(k).alias(k) for k in ("n", "total", "squares")])
        return Model("bandit", params_of(self), self._scored(t), {"draws": draws})

    def _named(self, m: Model, draws: int) -> Model:
        return Model("bandit", params_of(self), m.table, {"draws": draws})

    def add_arm(self, model: Model, arm: str) -> Model:
        """An arm that has no pull yet."""
        if self.policy == "exp3":
            raise InvalidInput("the arms of exp3 come from its rewards")
        one = model.table.sparkSession.createDataFrame([(arm, 0, 0.0, 0.0)], ARMS)
        return self._made(model.table.select("entity", "n", "total", "squares").unionByName(one), model.info["draws"])

    def merge(self, a: Model, b: Model) -> Model:
        """The state of both histories; exact for sums, undefined for exp3."""
        same_params(a, self), same_params(b, self)
        if self.policy == "exp3":
            raise ParamMismatch("exp3 states depend on their order and don't merge")
        return self._made(a.table.select("entity", "n", "total", "squares").unionByName(b.table.select("entity", "n", "total", "squares")), a.info["draws"] + b.info["draws"])

    def total_n(self, model: Model) -> int:
        return int(model.table.agg(F.sum("n")).first()[0] or 0)

    def _scored(self, t: DataFrame) -> DataFrame:
        n, mean = F.col("n"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
        # One row per arm, so one group of arms.
        log_t = F.log(F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)).cast("double"))
        never = F.lit(float("inf"))
        index: dict[str, Column] = {
            "greedy": mean,
            "epsilon-greedy": mean,
            "ucb1": F.when(n > 0, mean + F.sqrt(F.lit(self.exploration) * log_t / n)).otherwise(never),
            "thompson-beta": (self.alpha + F.col("total")) / (self.alpha + self.beta + n),
            "thompson-gaussian": (F.lit(self.prior_weight * self.prior_mean) + F.col("total")) / (self.prior_weight + n),
        }
        if self.policy == "kl-ucb":
            x = t.withColumn("_b", log_t + (F.lit(self.c) * F.log(F.greatest(log_t, F.lit(1e-300))) if self.c else F.lit(0.0)))
            bound = F.when(F.col("n") > 0, _kl_upper(F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0), F.col("_b") / F.col("n"))).otherwise(never)
            return x.withColumn("score", bound).drop("_b")
        if self.policy not in index:
            raise InvalidInput(f"policy {self.policy}")
        return t.withColumn("score", index[self.policy])

    def select_k(self, model: Model, k: int) -> tuple[list[str], Model]:
        """The k arms to pull, best first (equal draws: the arm named first), and the state after the draw."""
        rows = bounded(model.table.drop("league", "state"), MAX_ARMS, "arms").sort_values("entity").reset_index(drop=True)
        if k > len(rows):
            raise InvalidInput(f"{k} arms of {len(rows)}")
        draws = model.info["draws"]
        rng = np.random.Generator(np.random.Philox(key=[self.seed, draws]))
        value = rows["score"].to_numpy(float)
        if self.policy == "epsilon-greedy" and rng.random() < self.epsilon:
            value = rng.random(len(rows))
        elif self.policy == "thompson-beta":
            value = rng.beta(self.alpha + rows["total"], self.beta + rows["n"] - rows["total"])
        elif self.policy == "thompson-gaussian":
            n, w = rows["n"].to_numpy(float), self.prior_weight + rows["n"].to_numpy(float)
            var = np.where(n < 2, 1.0, np.maximum(rows["squares"] / np.maximum(n, 1) - np.square(rows["total"] / np.maximum(n, 1)), 1e-12))
            value = rng.normal(value, np.sqrt(var / w))
        elif self.policy == "exp3":
            value = np.log(np.maximum(value, 1e-300)) + rng.gumbel(size=len(rows))
        order = np.argsort(-value, kind="stable")[:k]
        return rows["entity"][order].tolist(), Model(model.algorithm, model.params, model.table, model.info | {"draws": draws + 1})

    def select(self, model: Model) -> tuple[str, Model]:
        arms, after = self.select_k(model, 1)
        return arms[0], after


def _kl_upper(mean: Column, bound: Column) -> Column:
    """The largest q with ``kl(mean, q) <= bound``, by 64 halvings within the row."""

    @F.pandas_udf("double")
    def solve(m: pd.Series, b: pd.Series) -> pd.Series:
        p = np.clip(m.to_numpy(float), 0, 1)
        lo, hi = p.copy(), np.ones_like(p)
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(64):
                q = (lo + hi) / 2
                kl = np.where(p > 0, p * np.log(p / q), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0)
                ok = kl <= b.to_numpy(float)
                lo, hi = np.where(ok, q, lo), np.where(ok, hi, q)
        return pd.Series(lo)

    return solve(mean, bound)


@dataclass(frozen=True)
class SlidingWindowUcb:
    """Upper bounds over the last ``window`` rewards by seq; arms without one in it score infinity.

    The window is found by ranges of seq: counts from the end say which ranges are needed, so nothing but them is sorted.
    """

    window: int = 1000
    exploration: float = 2.0

    def init(self, spark: SparkSession) -> Model:
        return Model("sw-ucb", params_of(self), self._scored(spark.createDataFrame([], "seq long, arm string, reward double"), 0), {"t": 0})

    def fit(self, rewards: DataFrame) -> Model:
        return self.update(self.init(rewards.sparkSession), rewards)

    def update(self, model: Model, rewards: DataFrame) -> Model:
        same_params(model, self)
        x = rewards.where(F.col("arm").isNotNull() & finite(F.col("reward").cast("double"))).select("seq", "arm", F.col("reward").cast("double").alias("reward"))
        t = model.info["t"] + x.count()
        # A top-N by seq: each task keeps its own N before they are merged.
        last = x.orderBy(F.desc("seq"), F.desc("arm"), F.desc("reward")).limit(self.window)
        names = x.select("arm").distinct()
        if model.info["t"]:
            last = last.unionByName(model.table.select(F.explode("kept").alias("k"), "entity").select(F.col("k.seq").alias("seq"), F.col("entity").alias("arm"), F.col("k.reward").alias("reward")))
            last = last.orderBy(F.desc("seq"), F.desc("arm"), F.desc("reward")).limit(self.window)
            names = names.unionByName(model.table.select(F.col("entity").alias("arm"))).distinct()
        return Model("sw-ucb", params_of(self), self._scored(last, t, names), {"t": t})

    def _scored(self, last: DataFrame, t: int, names: DataFrame | None = None) -> DataFrame:
        g = last.groupBy("arm").agg(F.count("*").alias("n"), F.sum("reward").alias("total"), F.collect_list(F.struct("seq", "reward")).alias("kept"))
        x = (names if names is not None else last.select("arm")).join(g, "arm", "left")
        log_t = math.log(max(min(t, self.window), 1))
        score = F.when(F.col("n") > 0, F.col("total") / F.col("n") + F.sqrt(F.lit(self.exploration * log_t) / F.col("n"))).otherwise(float("inf"))
        return x.select(F.col("arm").alias("entity"), score.alias("score"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.array().cast("array<struct<seq:bigint,reward:double>>")).alias("kept"))

    def select(self, model: Model) -> str:
        return model.top(1).first().entity


@dataclass(frozen=True)
class LinUcb:
    """Ridge regressions per arm from order-free sums of the contexts: ``a`` (row by row, without the ridge), ``b``, n."""

    alpha: float = 1.0
    ridge: float = 1.0

    def init(self, spark: SparkSession) -> Model:
        return Model("lin-ucb", params_of(self), spark.createDataFrame([], "entity string, n long, a array<double>, b array<double>, sx array<double>, score double"), {})

    def fit(self, rewards: DataFrame) -> Model:
        return self.update(self.init(rewards.sparkSession), rewards)

    def sums(self, rewards: DataFrame) -> DataFrame:
        x = rewards.where(F.col("arm").isNotNull() & finite(F.col("reward").cast("double")) & F.forall("x", lambda v: finite(v)))
        widths = [r[0] for r in x.select(F.size("x")).distinct().limit(2).collect()]
        if len(widths) != 1 or widths[0] < 1:
            raise InvalidInput("contexts must be of one width")
        d = widths[0]
        # d squared plus 2 d + 1 plain sums: partial sums in the tasks, one row per arm and task.
        cells = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)]
        cells += [F.sum(F.col("x")[i] * F.col("reward").cast("double")).alias(f"b{i}") for i in range(d)] + [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
        g = x.groupBy(F.col("arm").alias("entity")).agg(F.count("*").alias("n"), *cells)
        a = F.array(*[F.col(f"a{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
        return g.select("entity", "n", a.alias("a"), F.array(*[F.col(f"b{i}") for i in range(d)]).alias("b"), F.array(*[F.col(f"s{i}") for i in range(d)]).alias("sx"))

    def update(self, model: Model, rewards: DataFrame) -> Model:
        same_params(model, self)
        add = lambda p, q: F.when(p.isNull(), q).when(q.isNull(), p).otherwise(F.zip_with(p, q, lambda u, v: u + v))
        old = model.table.select("entity", *[F.col(k).alias(f"{k}0") for k in ("n", "a", "b", "sx")])
        x = self.sums(rewards).join(old, "entity", "full")
        x = x.select("entity", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), *[add(F.col(k), F.col(f"{k}0")).alias(k) for k in ("a", "b", "sx")])
        out = Model("lin-ucb", params_of(self), x, {})
        rows = bounded(x, MAX_ARMS, "arms")
        mean = np.sum(np.stack([np.array(v) for v in rows["sx"]]), axis=0) / rows["n"].sum()
        out.table = self._at(rows, mean, rewards.sparkSession)
        return out

    def _at(self, rows: pd.DataFrame, x: np.ndarray, spark: SparkSession) -> DataFrame:
        score = []
        for a, b in zip(rows["a"], rows["b"], strict=True):
            inv = np.linalg.inv(self.ridge * np.eye(len(x)) + np.array(a).reshape(len(x), len(x)))
            score.append(float(x @ inv @ np.array(b) + self.alpha * np.sqrt(max(x @ inv @ x, 0))))
        return spark.createDataFrame(rows[["entity", "n", "a", "b", "sx"]].assign(score=score), "entity string, n long, a array<double>, b array<double>, sx array<double>, score double")

    def select_for(self, model: Model, x: list[float]) -> str:
        """The arm with the highest bound at this context; equal ones by name."""
        t = self._at(bounded(model.table, MAX_ARMS, "arms"), np.array(x, float), model.table.sparkSession)
        return Model("", {}, t).top(1).first().entity


@dataclass(frozen=True)
class DuelingBandit:
    """Which two arms to compare next: ``rucb`` or ``double-thompson``; score is the share of met opponents beaten."""

    policy: str = "rucb"
    alpha: float = 0.51
    seed: int = 42

    def init(self, spark: SparkSession) -> Model:
        return Model("dueling", params_of(self), spark.createDataFrame([], "winner string, loser string, weight double"), {"draws": 0})

    def fit(self, pairs: DataFrame) -> Model:
        return self.update(self.init(pairs.sparkSession), pairs)

    def update(self, model: Model, pairs: DataFrame) -> Model:
        same_params(model, self)
        x = model.table.unionByName(clean_pairs(pairs).select("winner", "loser", "weight"))
        return Model("dueling", params_of(self), x.groupBy("winner", "loser").agg(F.sum("weight").alias("weight")), model.info)

    def merge(self, a: Model, b: Model) -> Model:
        same_params(b, self)
        return self.update(Model(a.algorithm, a.params, a.table, {"draws": a.info["draws"] + b.info["draws"]}), b.table)

    def total_duels(self, model: Model) -> float:
        return float(model.table.agg(F.sum("weight")).first()[0] or 0.0)

    def scores(self, model: Model) -> DataFrame:
        from ranksmith.operators.pairs import both_roles, pair_table

        p = pair_table(model.table).select(F.col("i").alias("winner"), F.col("j").alias("loser"), F.signum(F.col("w_ij") - F.col("w_ji")).alias("s"))
        x = both_roles(p, {"b": (F.col("s") > 0).cast("double")}, {"b": (F.col("s") < 0).cast("double")})
        return x.groupBy("entity").agg(F.avg("b").alias("score")).orderBy(F.desc("score"), "entity")

    def select_pair(self, model: Model) -> tuple[str, str, Model]:
        """Needs all pairs of arms in one memory, at most 3000 arms."""
        rows = bounded(model.table, 9_000_000, "pairs of arms")
        names = sorted(set(rows["winner"]) | set(rows["loser"]), key=lambda s: s.encode())
        n = len(names)
        if not 2 <= n <= 3000:
            raise InvalidInput(f"{n} arms")
        at = {k: i for i, k in enumerate(names)}
        w = np.zeros((n, n))
        w[[at[k] for k in rows["winner"]], [at[k] for k in rows["loser"]]] = rows["weight"]
        met = w + w.T
        t = max(met.sum() / 2, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(met > 0, w / met + np.sqrt(self.alpha * np.log(t) / met), 1.0)
        np.fill_diagonal(u, 0.5)
        draws = model.info["draws"]
        rng = np.random.Generator(np.random.Philox(key=[self.seed, draws]))
        if self.policy == "rucb":
            able = np.flatnonzero((u >= 0.5).all(axis=1))
            first = int(rng.choice(able)) if len(able) else int(rng.integers(n))
            rest = u[:, first].copy()
        elif self.policy == "double-thompson":
            up = np.triu(rng.beta(w + 1, w.T + 1), 1)
            theta = up + np.tril(1 - up.T, -1)
            wins = ((u >= 0.5) & (theta > 0.5) & ~np.eye(n, dtype=bool)).sum(axis=1)
            first = int(rng.choice(np.flatnonzero(wins == wins.max())))
            again = rng.beta(w[:, first] + 1, w[first] + 1)
            wait = (u[:, first] > 0.5) & (np.arange(n) != first)
            rest = np.where(wait, again, -1.0) if wait.any() else u[:, first].copy()
        else:
            raise InvalidInput(f"policy {self.policy}")
        rest[first] = -np.inf
        return names[first], names[int(rest.argmax())], Model(model.algorithm, model.params, model.table, {"draws": draws + 1})


def policies() -> list[str]:
    return ["greedy", "epsilon-greedy", "ucb1", "thompson-beta", "thompson-gaussian", "kl-ucb", "exp3"]


