"""What every operator returns, and how its state is kept."""

from __future__ import annotations

import dataclasses
import json
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptyDataset(ValueError):
    """An operator got no usable row."""


class InvalidInput(ValueError):
    """A parameter or a row is outside of what the operator is defined for."""


class NumericError(ArithmeticError):
    """No finite answer exists, or an iteration left the finite numbers."""


class ParamMismatch(ValueError):
    """A state was made with other parameters than those it is continued with."""


class TooLarge(ValueError):
    """A solver that works in one memory got more sufficient statistics than its documented bound."""


@dataclasses.dataclass
class Model:
    """``table`` has the entities, ``info`` the scalars; ``algorithm`` and ``params`` say what made them."""

    algorithm: str
    params: dict[str, Any]
    table: DataFrame
    info: dict[str, Any] = dataclasses.field(default_factory=dict)

    def scores(self) -> DataFrame:
        """``entity, score``, best first; equal scores by name."""
        return self.table.select("entity", "score").orderBy(F.desc("score"), "entity")

    def top(self, k: int) -> DataFrame:
        return self.scores().limit(k)

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(self.info.items())], "name string, value string")

    def save(self, path: str) -> None:
        """Parquet for the entities, one JSON line for the rest."""
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/entities")
        head = json.dumps({"algorithm": self.algorithm, "params": self.params, "info": self.info})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")

    @staticmethod
    def load(spark: SparkSession, path: str, algorithm: str | None = None) -> Model:
        head = json.loads(spark.read.text(f"{path}/header").first()[0])
        if algorithm is not None and head["algorithm"] != algorithm:
            raise ParamMismatch(f"the state is one of {head['algorithm']}, not of {algorithm}")
        return Model(head["algorithm"], head["params"], spark.read.parquet(f"{path}/entities"), head["info"])


class Ranker(Protocol):
    def fit(self, data: DataFrame) -> Model: ...


class OnlineRanker(Protocol):
    def init(self, spark: SparkSession) -> Model: ...

    def update(self, model: Model, data: DataFrame) -> Model: ...


def params_of(op: Any) -> dict[str, Any]:
    return {k: v for k, v in dataclasses.asdict(op).items() if not isinstance(v, DataFrame)}


def same_params(model: Model, op: Any) -> None:
    if model.params != params_of(op):
        raise ParamMismatch(f"{model.algorithm}: state with {model.params}, asked with {params_of(op)}")
