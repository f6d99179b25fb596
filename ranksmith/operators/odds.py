"""Odds, forecasts, markets, stakes and their diagnostics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksmith.functions.math import bracketed_root
from ranksmith.model import InvalidInput, Model, NumericError, params_of, same_params
from ranksmith.operators.pairs import finite


@dataclass(frozen=True)
class OddsDevig:
    """Fair chances from quoted odds: ``multiplicative``, ``additive``, ``power`` or ``shin``. ``event_id, outcome, prob, booksum, z``."""

    method: str = "power"
    additive_clamp: str = "error"

    def fit(self, odds: DataFrame) -> Model:
        if self.method not in ("power", "multiplicative", "additive", "shin") or self.additive_clamp not in ("error", "clamp"):
            raise InvalidInput(f"{self.method}, {self.additive_clamp}")
        x = odds.select("event_id", "outcome", F.col("odds").cast("double").alias("odds"))
        if x.where(F.col("outcome").isNull() | ~F.coalesce(finite(F.col("odds")) & (F.col("odds") > 1), F.lit(False))).limit(1).count():
            raise InvalidInput("odds must be finite and above 1, and outcomes have names")
        if x.groupBy("outcome").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            raise InvalidInput("an outcome is quoted twice")
        w = Window.partitionBy("event_id")
        x = x.withColumn("r", 1 / F.col("odds")).withColumn("booksum", F.sum("r").over(w)).withColumn("k", F.count("*").over(w))
        if x.where("k < 2").limit(1).count():
            raise InvalidInput("an event with one outcome")
        none = F.lit(0.0)
        if self.method == "multiplicative":
            out = x.select("event_id", "outcome", (F.col("r") / F.col("booksum")).alias("prob"), "booksum", none.alias("z"))
        elif self.method == "additive":
            p = F.col("r") - (F.col("booksum") - 1) / F.col("k")
            x = x.withColumn("p", p)
            if self.additive_clamp == "error" and x.where("p < 0").limit(1).count():
                raise NumericError("a chance below zero; clamping is an option")
            x = x.withColumn("p", F.greatest("p", none))
            out = x.select("event_id", "outcome", (F.col("p") / F.sum("p").over(w)).alias("prob"), "booksum", none.alias("z"))
        else:
            solve = _power if self.method == "power" else _shin
            events = x.groupBy("event_id", "booksum").agg(F.array_sort(F.collect_list(F.struct("outcome", "r"))).alias("q"))
            kind = dict(odds.dtypes)["event_id"]

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    done = [solve(np.array([o["r"] for o in q])) for q in pdf["q"]]
                    yield pd.DataFrame({"event_id": pdf["event_id"], "booksum": pdf["booksum"], "outcomes": [[o["outcome"] for o in q] for q in pdf["q"]], "probs": [list(p) for p, _ in done], "z": [z for _, z in done]})

            y = events.mapInPandas(run, f"event_id {kind}, booksum double, outcomes array<string>, probs array<double>, z double")
            out = y.select("event_id", F.explode(F.arrays_zip("outcomes", "probs")).alias("o"), "booksum", "z").select("event_id", F.col("o.outcomes").alias("outcome"), F.col("o.probs").alias("prob"), "booksum", "z")
        return Model("odds-devig", params_of(self), out.withColumn("entity", F.col("outcome")).withColumn("score", F.col("prob")))


def _power(r: np.ndarray) -> tuple[np.ndarray, float]:
    """``r ** (1 / tau)`` that sums to 1."""
    b = r.sum()
    if abs(b - 1) < 1e-15:
        return r, 0.0
    lo, hi = (1e-12, 1.0) if b > 1 else (1.0, 1e6)
    t = bracketed_root(lambda t: float(np.exp(np.log(r) / t).sum() - 1), lo, hi)
    return (r / b if t is None else np.exp(np.log(r) / t)), 0.0


def _shin(r: np.ndarray) -> tuple[np.ndarray, float]:
    """Shin's model: the share z of insiders for which the chances sum to 1."""
    b = r.sum()

    def probs(z: float) -> np.ndarray:
        return (np.sqrt(z * z + 4 * (1 - z) * r * r / b) - z) / (2 * (1 - z))

    z = bracketed_root(lambda z: float(probs(z).sum() - 1), 0.0, 1 - 1e-9)
    return (r / b, 0.0) if z is None else (probs(z), float(z))


@dataclass(frozen=True)
class OpinionPool:
    """One forecast from several sources: ``logarithmic`` (a zero vetoes) or ``linear``, extremised by a power.

    ``missing`` outcomes of a source: ``error``, ``skip`` (its weight is left out of the log pool's sum without making up for it), or ``uniform``.
    """

    kind: str = "logarithmic"
    extremize: float = 1.0
    missing: str = "error"
    eps_floor: float | None = None

    def fit(self, forecasts: DataFrame) -> Model:
        if self.kind not in ("logarithmic", "linear") or self.missing not in ("error", "skip", "uniform"):
            raise InvalidInput(f"{self.kind}, {self.missing}")
        f = forecasts.select("source", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), "outcome", F.col("prob").cast("double").alias("prob"))
        bad = f.groupBy("source").agg(F.sum("prob").alias("s"), F.min("prob").alias("lo"), F.min("weight").alias("w"), F.count("*").alias("n"), F.count_distinct("outcome").alias("k"))
        if bad.where("abs(s - 1) > 1e-9 OR lo < 0 OR NOT w > 0 OR n < 2 OR k < n OR s IS NULL").limit(1).count():
            raise InvalidInput("a source's weight must be positive and its chances of distinct outcomes sum to 1")
        sources = f.groupBy("source").agg(F.max("weight").alias("weight"))
        n_out = f.select("outcome").distinct().count()
        total = sources.agg(F.sum("weight")).first()[0]
        if self.missing == "error" and f.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") < n_out).limit(1).count():
            raise InvalidInput("a source lacks an outcome")
        p = F.col("prob") if self.eps_floor is None else F.greatest("prob", F.lit(self.eps_floor))
        w = F.col("weight") / F.lit(total)
        # What a source without the outcome would add is known from the sums of the others: no product of sources and outcomes is made.
        log_p = F.when(p > 0, F.log(p))
        g = f.groupBy("outcome").agg(F.sum(w * p).alias("lin"), F.sum(w * log_p).alias("log"), F.sum((p <= 0).cast("int")).alias("vetoes"), F.sum(w).alias("w"))
        even = 1 / n_out
        rest = (1 - F.col("w")) if self.missing == "uniform" else F.lit(0.0)
        one = F.lit(1)
        if self.kind == "linear":
            raw = F.col("lin") + rest * even
            g = g.withColumn("v", F.pow(raw, F.lit(self.extremize)))
        else:
            log = (F.coalesce("log", F.lit(0.0)) + rest * float(np.log(even))) * F.lit(self.extremize)
            g = g.withColumn("l", F.when(F.col("vetoes") == 0, log))
            g = g.withColumn("v", F.coalesce(F.exp(F.col("l") - F.max("l").over(Window.partitionBy(one))), F.lit(0.0)))
        x = g.select(F.col("outcome").alias("entity"), (F.col("v") / F.sum("v").over(Window.partitionBy(one))).alias("score"))
        return Model("opinion-pool", params_of(self), x)


@dataclass(frozen=True)
class Lmsr:
    """Prices of a market maker from the shares outstanding; trades add up in any order."""

    b: float = 100.0

    def init(self, spark: SparkSession) -> Model:
        return Model("lmsr", params_of(self), spark.createDataFrame([], "entity string, shares double, score double"))

    def fit(self, trades: DataFrame) -> Model:
        return self.update(self.init(trades.sparkSession), trades)

    def update(self, model: Model, trades: DataFrame) -> Model:
        same_params(model, self)
        if not self.b > 0:
            raise InvalidInput("b must be positive")
        new = trades.where(F.col("outcome").isNotNull() & finite(F.col("shares").cast("double"))).select(F.col("outcome").alias("entity"), F.col("shares").cast("double").alias("shares"))
        q = model.table.select("entity", "shares").unionByName(new).groupBy("entity").agg(F.sum("shares").alias("shares"))
        w = Window.partitionBy()  # outcomes of one market
        x = q.withColumn("_e", F.exp((F.col("shares") - F.max("shares").over(w)) / F.lit(self.b)))
        return Model("lmsr", params_of(self), x.select("entity", "shares", (F.col("_e") / F.sum("_e").over(w)).alias("score")))

    def cost(self, model: Model) -> float:
        top = model.table.agg(F.max("shares")).first()[0]
        return float(model.table.agg(F.lit(top) + F.lit(self.b) * F.log(F.sum(F.exp((F.col("shares") - F.lit(top)) / F.lit(self.b))))).first()[0])

    def trade_cost(self, model: Model, outcome: str, shares: float) -> float:
        one = model.table.sparkSession.createDataFrame([(outcome, float(shares))], "outcome string, shares double")
        return self.cost(self.update(model, one)) - self.cost(model)


def portfolio_kelly(p: list[float], b: list[float], steps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """Stakes on up to 12 independent bets at once that maximise expected log wealth: projected gradients over all joint outcomes."""
    k = len(p)
    if not 1 <= k <= 12 or len(b) != k:
        raise InvalidInput("between 1 and 12 bets")
    won = ((np.arange(2**k)[:, None] >> np.arange(k)) & 1).astype(bool)
    chance = np.where(won, p, 1 - np.array(p)).prod(axis=1)
    gain = np.where(won, b, -1.0)
    f, rate = np.zeros(k), 0.1
    value = 0.0
    for _ in range(steps):
        g = gain.T @ (chance / (1 + gain @ f))
        while rate > 1e-15:
            new = _capped(f + rate * g)
            wealth = 1 + gain @ new
            v = float(chance @ np.log(wealth)) if (wealth > 0).all() else -np.inf
            if v >= value:
                break
            rate /= 2
        done = np.abs(new - f).max() < tolerance
        f, value, rate = new, v, rate * 1.5
        if done:
            break
    return f


def _capped(x: np.ndarray, cap: float = 1 - 1e-9) -> np.ndarray:
    """The nearest point with no negative part and a sum of at most ``cap``."""
    x = np.maximum(x, 0)
    if x.sum() <= cap:
        return x
    u = np.sort(x)[::-1]
    c = (np.cumsum(u) - cap) / np.arange(1, len(u) + 1)
    return np.maximum(x - c[np.flatnonzero(u > c)[-1]], 0)


# -- diagnostics -------------------------------------------------------------------------------------------------------


def _forecasts(df: DataFrame) -> DataFrame:
    x = df.select(F.col("p").cast("double").alias("p"), F.col("outcome").cast("double").alias("o"))
    return x.where(F.col("p").between(0, 1) & F.col("o").isNotNull() & ~F.isnan("p"))


def brier_score(df: DataFrame) -> DataFrame:
    return _forecasts(df).agg(F.avg((F.col("p") - F.col("o")) * (F.col("p") - F.col("o"))).alias("brier"))


def log_loss(df: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.least(F.col("p"), F.lit(1 - eps)), F.lit(eps))
    return _forecasts(df).agg(F.avg(F.when(F.col("o") > 0, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def calibration_table(df: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, lower, upper, n, mean_p, rate``: also of bins without a forecast, whose means are null."""
    if bins < 1:
        raise InvalidInput("at least one bin")
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    g = _forecasts(df).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("o").alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    x = every.join(g, "bin", "left")
    return x.select("bin", (F.col("bin") / F.lit(bins)).alias("lower"), ((F.col("bin") + 1) / F.lit(bins)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate")
