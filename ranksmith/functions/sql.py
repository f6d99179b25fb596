"""The operators in SQL: scalar functions as pandas UDFs and the folds as table functions.

``SELECT * FROM rs_elo(TABLE(games) PARTITION BY league ORDER BY seq)`` folds each league in its order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ranksmith.functions.math import np_norm_cdf, np_norm_pdf, np_norm_ppf
from ranksmith.operators.online import Elo, MElo, MovElo, TdValue


def register(spark: SparkSession) -> list[str]:
    """Registers all functions and returns their names."""

    def one(name: str, f) -> str:
        def call(x: pd.Series) -> pd.Series:
            return pd.Series(f(x.to_numpy(float)))

        spark.udf.register(name, F.pandas_udf(call, "double"))
        return name

    def wilson(won: pd.Series, lost: pd.Series, z: pd.Series) -> pd.Series:
        n, zz = won + lost, z * z
        return (won + zz / 2) / (n + zz) + z / (n + zz) * np.sqrt(won * lost / n + zz / 4)

    def kelly(p: pd.Series, b: pd.Series) -> pd.Series:
        return ((p * (b + 1) - 1) / b).clip(lower=0)

    def expected(a: pd.Series, b: pd.Series) -> pd.Series:
        return 1 / (1 + 10 ** ((b - a) / 400))

    names = [one("rs_norm_cdf", np_norm_cdf), one("rs_norm_pdf", np_norm_pdf), one("rs_norm_ppf", np_norm_ppf)]
    for name, f in (("rs_wilson_upper", wilson), ("rs_kelly", kelly), ("rs_elo_expected", expected)):
        spark.udf.register(name, F.pandas_udf(f, "double"))
        names.append(name)
    for name, op in (("rs_elo", Elo()), ("rs_elo_mov", MovElo()), ("rs_melo", MElo())):
        spark.udtf.register(name, _duel_table(op))
        names.append(name)
    spark.udtf.register("rs_td_value", _td_table(TdValue()))
    return [*names, "rs_td_value"]


def _duel_table(op):
    @F.udtf(returnType="league string, entity string, score double")
    class Duels:
        def __init__(self):
            self.state, self.league = {}, None

        def eval(self, row):
            self.league = row["league"]
            op.step(self.state, {"a": row["side1"][0], "b": row["side2"][0], "m": float(row["margin"]), "w": float(row["weight"])})

        def terminate(self):
            for k, v in self.state.items():
                yield self.league, k, float(v[0])

    return Duels


def _td_table(op):
    @F.udtf(returnType="entity string, score double, n long")
    class Steps:
        """Rows of ``episode_id, state, reward`` in order: an episode's step is applied once its next one is known."""

        def __init__(self):
            self.state, self.held = {}, None

        def eval(self, row):
            if self.held is not None:
                same = self.held["episode_id"] == row["episode_id"]
                op.step(self.state, {"s": self.held["state"], "r": float(self.held["reward"]), "n": row["state"] if same else None})
            self.held = row

        def terminate(self):
            if self.held is not None:
                op.step(self.state, {"s": self.held["state"], "r": float(self.held["reward"]), "n": None})
            for k, v in self.state.items():
                yield k, float(v[0]), int(v[1])

    return Steps
