"""State values from episodes: ``episode_id, step, state, reward`` rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.model import InvalidInput, Model, params_of
from ranksmith.operators.pairs import bounded, finite, require


def clean_steps(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("state").isNotNull() & F.col("episode_id").isNotNull() & finite(F.col("reward").cast("double"))).select("episode_id", "step", "state", F.col("reward").cast("double").alias("reward"))


def returns(steps: DataFrame, gamma: float = 1.0, visit: str = "first") -> DataFrame:
    """``episode_id, step, state, g``: the discounted return from each (first) visit of a state on.

    An episode is one group, as returns run backwards through it; its rows stay in the JVM. Without discount it is a
    running sum, else a fold over the episode's rewards.
    """
    if visit not in ("first", "every"):
        raise InvalidInput(f"visit {visit}")
    x = clean_steps(steps)
    if gamma == 1.0:
        w = Window.partitionBy("episode_id").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
        x = x.withColumn("g", F.sum("reward").over(w))
    else:
        rows = F.reverse(F.array_sort(F.collect_list(F.struct("step", "state", "reward"))))
        fold = F.aggregate(
            "rows",
            F.struct(F.lit(0.0).alias("g"), F.array().cast("array<struct<step:bigint,state:string,g:double>>").alias("out")),
            lambda a, r: F.struct((r["reward"] + F.lit(gamma) * a["g"]).alias("g"), F.concat(a["out"], F.array(F.struct(r["step"].cast("long").alias("step"), r["state"].alias("state"), (r["reward"] + F.lit(gamma) * a["g"]).alias("g")))).alias("out")),
            lambda a: a["out"],
        )
        x = x.groupBy("episode_id").agg(rows.alias("rows")).select("episode_id", F.explode(fold).alias("r")).select("episode_id", "r.*")
    if visit == "first":
        x = x.groupBy("episode_id", "state").agg(F.min_by(F.struct("step", "g"), "step").alias("v")).select("episode_id", "v.step", "state", "v.g")
    return x.select("episode_id", "step", "state", "g")


@dataclass(frozen=True)
class McValue:
    """Mean or median return of each state; ``winsorize`` clamps a state's returns to its own quantiles q and 1 - q."""

    gamma: float = 1.0
    visit: str = "first"
    aggregate: str = "mean"
    winsorize: float | None = None
    min_observations: int = 1

    def fit(self, steps: DataFrame) -> Model:
        r = returns(steps, self.gamma, self.visit)
        if self.winsorize is not None:
            q = self.winsorize
            edges = r.groupBy("state").agg(F.percentile("g", F.lit(q)).alias("lo"), F.percentile("g", F.lit(1 - q)).alias("hi"))
            r = r.join(edges, "state").withColumn("g", F.greatest(F.least("g", "hi"), "lo"))
        if self.aggregate not in ("mean", "median"):
            raise InvalidInput(f"aggregate {self.aggregate}")
        score = F.avg("g") if self.aggregate == "mean" else F.percentile("g", F.lit(0.5))
        x = r.groupBy(F.col("state").alias("entity")).agg(score.alias("score"), F.count("*").alias("n"))
        return Model("mc-value", params_of(self), x.where(F.col("n") >= self.min_observations))


@dataclass(frozen=True)
class ValueCompare:
    """Values with bootstrap intervals over episodes, and for each pair of states the share of replicates in which the second is better.

    Each episode and state is first summed to a return and a count. Replicate r weighs an episode by a random number that depends on
    (seed, r, episode) alone: Poisson counts for ``bootstrap``, exponentials for ``bayesian-bootstrap``. ``pairs(model)`` has the comparisons; with
    ``permutations`` also a permutation test over shuffled returns, for state tables of bounded size.
    """

    gamma: float = 1.0
    visit: str = "first"
    replicates: int = 2000
    method: str = "bootstrap"
    credible: float = 0.95
    permutations: int = 0
    min_observations: int = 2
    seed: int = 2026

    def fit(self, steps: DataFrame) -> Model:
        if self.method not in ("bootstrap", "bayesian-bootstrap"):
            raise InvalidInput(f"method {self.method}")
        r = returns(steps, self.gamma, self.visit)
        cells = r.groupBy("episode_id", "state").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
        seen = r.groupBy("state").agg(F.avg("g").alias("point"), F.count("*").alias("n")).where(F.col("n") >= self.min_observations)
        names = [x.state for x in bounded(seen.select("state"), 100_000, "states").sort_values("state").itertuples()]
        if not names:
            raise InvalidInput("no state was observed often enough")
        at = {s: i for i, s in enumerate(names)}
        spark, op, k = steps.sparkSession, self, len(names)

        def replicate(batches):
            num, den = np.zeros((op.replicates, k)), np.zeros((op.replicates, k))
            for pdf in batches:
                for e, part in pdf.groupby("e"):
                    rng = np.random.Generator(np.random.Philox(key=[op.seed, int(e) & ((1 << 63) - 1)]))
                    w = rng.poisson(1.0, op.replicates).astype(float) if op.method == "bootstrap" else rng.exponential(1.0, op.replicates)
                    for s, g, n in zip(part["state"], part["g"], part["n"], strict=True):
                        if s in at:
                            num[:, at[s]] += w * g
                            den[:, at[s]] += w * n
            keep = np.flatnonzero(den.any(axis=0))
            for j in keep:
                yield pd.DataFrame({"rep": np.arange(op.replicates), "state": names[j], "num": num[:, j], "den": den[:, j]})

        hashed = cells.select(F.xxhash64(F.col("episode_id").cast("string")).alias("e"), "state", "g", "n").repartition("e").sortWithinPartitions("e")
        sums = hashed.mapInPandas(replicate, "rep long, state string, num double, den double").groupBy("rep", "state").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
        means = sums.where("den > 0").select("rep", "state", (F.col("num") / F.col("den")).alias("v"))
        tail = (1 - self.credible) / 2
        q = means.groupBy("state").agg(F.percentile("v", F.lit(tail)).alias("lower"), F.percentile("v", F.lit(1 - tail)).alias("upper"), F.count("*").alias("n_rep"))
        x = seen.join(q, "state").select(F.col("state").alias("entity"), F.col("point").alias("score"), "lower", "upper", "n", "n_rep")
        m = Model("value-compare", params_of(self), x)
        m._replicates, m._returns, m._names = means, r, names  # type: ignore[attr-defined]
        return m

    def pairs(self, model: Model) -> DataFrame:
        """``a, b, diff, p_b_above_a[, p_value]`` for a < b."""
        v = model._replicates  # type: ignore[attr-defined]
        x = v.withColumnRenamed("state", "a").withColumnRenamed("v", "va").join(v.withColumnRenamed("state", "b").withColumnRenamed("v", "vb"), "rep").where("a < b")
        x = x.groupBy("a", "b").agg(F.avg((F.col("vb") > F.col("va")).cast("double")).alias("p_b_above_a"))
        p = model.table.select("entity", "score")
        x = x.join(p.select(F.col("entity").alias("a"), F.col("score").alias("sa")), "a").join(p.select(F.col("entity").alias("b"), F.col("score").alias("sb")), "b")
        x = x.select("a", "b", (F.col("sb") - F.col("sa")).alias("diff"), "p_b_above_a")
        if not self.permutations:
            return x
        smp = bounded(model._returns.select("state", "g"), 5_000_000, "returns")  # type: ignore[attr-defined]
        groups = {s: np.sort(g["g"].to_numpy()) for s, g in smp.groupby("state")}
        sent, op = model.table.sparkSession.sparkContext.broadcast(groups), self

        def test(batches):
            for pdf in batches:
                out = []
                for a, b in zip(pdf["a"], pdf["b"], strict=True):
                    ga, gb = sent.value[a], sent.value[b]
                    import zlib

                    rng = np.random.Generator(np.random.Philox(key=[op.seed, zlib.crc32(f"{a}\0{b}".encode())]))
                    pool, d = np.concatenate([ga, gb]), abs(gb.mean() - ga.mean())
                    hits = 0
                    for _ in range(op.permutations):
                        rng.shuffle(pool)
                        hits += abs(pool[len(ga) :].mean() - pool[: len(ga)].mean()) >= d - 1e-12
                    out.append((hits + 1) / (op.permutations + 1))
                yield pdf.assign(p_value=out)

        return x.mapInPandas(test, "a string, b string, diff double, p_b_above_a double, p_value double")


@dataclass(frozen=True)
class BehaviorCloning:
    """Smoothed frequencies of tokens: of all, or of the action after ``sep`` within each state before it."""

    sep: str | None = None
    smoothing: float = 0.0

    def fit(self, steps: DataFrame) -> Model:
        c = self._counts(steps)
        w = Window.partitionBy("group")
        n, k, a = F.sum("n").over(w), F.count("*").over(w), F.lit(self.smoothing)
        return Model("behavior-cloning", params_of(self), c.select("entity", ((F.col("n") + a) / (n + a * k)).alias("score"), "n"))

    def _counts(self, steps: DataFrame) -> DataFrame:
        x = steps.where(F.col("state").isNotNull())
        if self.sep is not None:
            x = require(x, F.col("state").contains(self.sep), f"a token without {self.sep!r}")
            group = F.substring_index("state", self.sep, 1)
        else:
            group = F.lit("")
        return x.groupBy(group.alias("group"), F.col("state").alias("entity")).agg(F.count("*").alias("n"))

    def implied_pairs(self, steps: DataFrame) -> DataFrame:
        """``winner, loser, weight``: within a state, an action seen more often beats one seen less, by the difference of counts."""
        c = self._counts(steps)
        action = F.expr(f"substring(entity, length(group) + {len(self.sep) + 1})") if self.sep is not None else F.col("entity")
        c = c.select("group", action.alias("e"), "n")
        x = c.alias("a").join(c.alias("b"), "group").where("a.n > b.n")
        return x.groupBy(F.col("a.e").alias("winner"), F.col("b.e").alias("loser")).agg(F.sum(F.col("a.n") - F.col("b.n")).cast("double").alias("weight"))
