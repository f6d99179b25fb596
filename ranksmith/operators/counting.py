"""Operators that are one aggregation: win rate, Borda, Copeland, degree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.functions.math import wilson_bound
from ranksmith.model import InvalidInput, Model, params_of, same_params
from ranksmith.operators.pairs import both_roles, clean_pairs, pair_table, tally

#: Normal quantiles as the published tables round them.
Z = {"P95": 1.96, "P90": 1.645, "P50": 0.0}


@dataclass(frozen=True)
class WinRate:
    """Wilson bound of each entity's weighted win rate; the upper one by default, as ``P50`` the plain rate. Online: states add up."""

    confidence: str = "P95"
    bound: str = "upper"

    def _scored(self, t: DataFrame) -> DataFrame:
        if self.confidence not in Z or self.bound not in ("upper", "lower"):
            raise InvalidInput(f"confidence {self.confidence}, bound {self.bound}")
        w, l = F.col("w_won"), F.col("w_lost")
        score = w / (w + l) if self.confidence == "P50" else wilson_bound(w, l, Z[self.confidence], self.bound == "upper")
        return t.withColumn("score", F.when(w + l > 0, score).otherwise(0.0))

    def init(self, spark: SparkSession) -> Model:
        return Model("win-rate", params_of(self), spark.createDataFrame([], "entity string, n_won long, w_won double, n_lost long, w_lost double, score double"))

    def update(self, model: Model, pairs: DataFrame) -> Model:
        same_params(model, self)
        cols = ["n_won", "w_won", "n_lost", "w_lost"]
        both = model.table.select("entity", *cols).unionByName(tally(clean_pairs(pairs)))
        return Model("win-rate", params_of(self), self._scored(both.groupBy("entity").agg(*[F.sum(c).alias(c) for c in cols])))

    def fit(self, pairs: DataFrame) -> Model:
        return Model("win-rate", params_of(self), self._scored(tally(clean_pairs(pairs))))


@dataclass(frozen=True)
class Borda:
    """Summed winning weight; of ballots, the number of items ranked below."""

    def fit(self, pairs: DataFrame) -> Model:
        return Model("borda", {}, tally(clean_pairs(pairs)).select("entity", F.col("w_won").alias("score")))

    def fit_rankings(self, ballots: DataFrame) -> Model:
        x = ballots.where(F.size("items") >= 2).select(F.size("items").alias("m"), F.posexplode("items").alias("p", "entity"))
        return Model("borda", {}, x.groupBy("entity").agg(F.sum((F.col("m") - 1 - F.col("p")).cast("double")).alias("score")))


@dataclass(frozen=True)
class Copeland:
    """One for each opponent beaten on net weight, a half for each even one."""

    def fit(self, pairs: DataFrame) -> Model:
        p = pair_table(clean_pairs(pairs)).select(F.col("i").alias("winner"), F.col("j").alias("loser"), (F.signum(F.col("w_ij") - F.col("w_ji"))).alias("s"))
        x = both_roles(p, {"score": (1 + F.col("s")) / 2}, {"score": (1 - F.col("s")) / 2})
        return Model("copeland", {}, x.groupBy("entity").agg(F.sum("score").alias("score")))


@dataclass(frozen=True)
class Degree:
    """Weighted strength of each node; parallel edges add up."""

    direction: str = "in"

    def fit(self, edges: DataFrame) -> Model:
        if self.direction not in ("in", "out", "total"):
            raise InvalidInput(f"direction {self.direction}")
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
        e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("winner"), F.col("dst").alias("loser"), w.alias("w"))
        x = both_roles(e, {"s": F.col("w") if self.direction != "in" else F.lit(0.0)}, {"s": F.col("w") if self.direction != "out" else F.lit(0.0)})
        return Model("degree", params_of(self), x.groupBy("entity").agg(F.sum("s").alias("score")))
