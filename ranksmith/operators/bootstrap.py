"""Resampling of every shape, and bootstrap intervals around the rankers that fit pair tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.model import Model, NumericError
from ranksmith.session import Scratch
from ranksmith.operators.pairs import LOCAL_PAIRS, Cells, bounded, cells_of, clean_pairs, ordered_pairs

#: What is drawn as a whole: a row, or all rows of one of these columns.
UNITS = {"pairs": None, "rewards": None, "contextual": None, "votes": None, "games": None, "edges": None, "matches": None, "ballots": "ballot_id", "trajectories": "episode_id"}


def resample(data: DataFrame, shape: str, seed: int) -> DataFrame:
    """Units drawn with Poisson(1) counts from (seed, unit), however the rows are partitioned; ``draw`` tells copies apart.

    The size of the draw varies by about the root of the number of units, which is what lets every task draw for itself.
    """
    unit = UNITS[shape]
    key = F.xxhash64(F.lit(seed), F.col(unit).cast("string")) if unit else F.xxhash64(F.lit(seed), *[F.to_json(F.struct(c)) for c in data.columns], F.monotonically_increasing_id() if "seq" not in data.columns else F.lit(0))
    u = (F.shiftrightunsigned(key, 11)).cast("double") / F.lit(float(1 << 53))
    # Inverse of the Poisson distribution up to 12, beyond which less than 1e-10 lies.
    edge, p, cuts = 0.0, float(np.exp(-1)), []
    for k in range(13):
        edge += p
        cuts.append(edge)
        p /= k + 1
    n = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    return data.withColumn("draw", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))


@dataclass(frozen=True)
class Bootstrap:
    """Intervals of scores and ranks over refits on resampled pairs.

    ``solver`` maps ``Cells`` to one score per name. Counts of a pair's rows are drawn as a multinomial over all rows, which
    is exactly a resample of rows by pair; so replicates need the pair table only, and refits run in parallel tasks.
    Failed refits are left out; fewer than half of them is an error. Scores of sections that have another scale stay out.
    """

    solver: Callable[[Cells], np.ndarray]
    replicates: int = 200
    credible: float = 0.95
    seed: int = 26

    def fit(self, pairs: DataFrame) -> Model:
        p = bounded(ordered_pairs(clean_pairs(pairs)), LOCAL_PAIRS, "ordered pairs").sort_values(["winner", "loser"])
        c = cells_of(p)
        point = self.solver(c)
        spark, op = pairs.sparkSession, self
        sent = spark.sparkContext.broadcast(c)

        def refit(batches):
            c: Cells = sent.value
            total, mean = int(c.n.sum()), c.w / c.n
            for pdf in batches:
                for r in pdf["id"]:
                    rng = np.random.Generator(np.random.Philox(key=[op.seed, int(r)]))
                    n = rng.multinomial(total, c.n / total).astype(float)
                    m = n > 0
                    try:
                        s = np.asarray(op.solver(Cells(c.names, c.a[m], c.b[m], (n * mean)[m], n[m])), float)
                    except Exception:
                        continue
                    seen = np.zeros(c.size, bool)
                    seen[c.a[m]] = seen[c.b[m]] = True
                    if not np.isfinite(s[seen]).all():
                        continue
                    order = np.lexsort((np.arange(c.size)[seen], -s[seen]))
                    rank = np.empty(len(order), int)
                    rank[order] = np.arange(1, len(order) + 1)
                    yield pd.DataFrame({"rep": r, "entity": [k for k, y in zip(c.names, seen, strict=True) if y], "score": s[seen], "rank": rank})

        n_tasks = min(self.replicates, max(spark.sparkContext.defaultParallelism, 1))
        runs = spark.range(0, self.replicates, 1, n_tasks).mapInPandas(refit, "rep long, entity string, score double, rank int")
        tail = (1 - self.credible) / 2
        quant = lambda col, q: F.percentile(col, F.lit(q))
        x = runs.groupBy("entity").agg(
            quant("score", tail).alias("lower"), quant("score", 1 - tail).alias("upper"), quant("rank", tail).alias("rank_lower"), quant("rank", 1 - tail).alias("rank_upper"), F.count("*").alias("n_rep"))
        rows = bounded(x, LOCAL_PAIRS, "entities")
        done = int(rows["n_rep"].max()) if len(rows) else 0
        if 2 * done < self.replicates:
            raise NumericError(f"{done} of {self.replicates} refits succeeded")
        base = pd.DataFrame({"entity": c.names, "score": point})
        base["rank"] = base.sort_values(["score", "entity"], ascending=[False, True]).reset_index().reset_index().set_index("index")["level_0"].add(1).astype("int32")
        out = spark.createDataFrame(base.merge(rows, "left", "entity"), "entity string, score double, rank int, lower double, upper double, rank_lower double, rank_upper double, n_rep long")
        out = out.withColumn("coverage", F.coalesce("n_rep", F.lit(0)) / F.lit(float(self.replicates)))
        return Model("bootstrap", {k: v for k, v in params_of_safe(self).items()}, out, {"succeeded": done})


def params_of_safe(op: Any) -> dict[str, Any]:
    return {"replicates": op.replicates, "credible": op.credible, "seed": op.seed}


def ranker_solver(ranker: Any) -> Callable[[Cells], np.ndarray]:
    """Any ranker's own fit of aggregated pairs as a solver: scores in the order of the names."""
    from ranksmith.operators import spectral

    if isinstance(ranker, spectral.BradleyTerryMM):
        return lambda c: spectral.mm_sweeps(c.a, c.b, c.w, c.size, np.full(c.size, 1 / c.size), ranker.iterations, ranker.tolerance)[0]

    def solve(c: Cells) -> np.ndarray:
        score = ranker.fit(c).table.set_index("entity")["score"]
        return score.reindex(c.names).to_numpy(float)

    return solve


@dataclass(frozen=True)
class RefitBootstrap:
    """The same intervals for any ranker and dataset: each replicate is a fit of its own on resampled rows.

    ``fit`` maps the data to a model with ``entity, score``; rows are resampled by ``unit`` of the dataset's ``shape`` (see ``resample``). Fits follow one
    another, each as parallel as the ranker is; failed ones are left out, and fewer than half of them is an error.
    """

    fit_model: Callable[[DataFrame], Model]
    shape: str
    replicates: int = 50
    credible: float = 0.95
    seed: int = 26

    def fit(self, data: DataFrame) -> Model:
        disk = Scratch(data.sparkSession, "refits")
        point = self.fit_model(data).table.select("entity", "score")
        runs, done = None, 0
        for k in range(self.replicates):
            try:
                one = disk.save(self.fit_model(resample(data, self.shape, self.seed + k)).table.select("entity", "score"))
            except Exception:
                continue
            done += 1
            runs = one if runs is None else runs.unionByName(one)
        if runs is None or 2 * done < self.replicates:
            raise NumericError(f"{done} of {self.replicates} refits succeeded")
        tail = (1 - self.credible) / 2
        x = runs.groupBy("entity").agg(F.percentile("score", F.lit(tail)).alias("lower"), F.percentile("score", F.lit(1 - tail)).alias("upper"), F.count("*").alias("n_rep"))
        return Model("bootstrap", params_of_safe(self), point.join(x, "entity", "left"), {"succeeded": done})
