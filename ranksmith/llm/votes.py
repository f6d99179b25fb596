"""Votes between two items: one global ranking, and a consensus of annotators who differ."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.model import NumericError
from ranksmith.operators.sweeps import Arcs, luce_logs
from ranksmith.session import Scratch, hot_keys, lookup


def delivered_once(votes: DataFrame) -> DataFrame:
    """``seq, annotator, winner, loser, weight``: the first loaded row of each seq; rows without a seq stay each for itself."""
    cols = ["annotator", "winner", "loser", "weight"]
    have = [F.col(c) if c in votes.columns else F.lit(None).cast("string").alias(c) for c in cols]
    first = F.col("loaded_at") if "loaded_at" in votes.columns else F.lit(0)
    x = votes.select("seq", first.alias("at"), *have)
    once = x.where("seq IS NOT NULL").groupBy("seq").agg(F.min(F.struct("at", *cols)).alias("v")).select("seq", "v.annotator", "v.winner", "v.loser", "v.weight")
    return once.unionByName(x.where("seq IS NULL").drop("at"))


def won_votes(votes: DataFrame) -> DataFrame:
    """``winner, loser, w``: summed weight of each ordered pair that a countable vote names."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    x = votes.select("winner", "loser", w.alias("w")).where("winner IS NOT NULL AND loser IS NOT NULL AND winner <> loser")
    x = x.where(~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf")))
    return x.groupBy("winner", "loser").agg(F.sum("w").alias("w"))


#: Up to this many ordered pairs (24 bytes each, on numbers instead of names) the chain is solved in the driver's memory.
LOCAL_PAIRS = 2_000_000


def luce_strengths(
    votes: DataFrame,
    prior: float = 0.01,
    tolerance: float = 1e-9,
    outer: int = 500,
    inner: int = 30,
    local_pairs: int = LOCAL_PAIRS,
) -> DataFrame:
    """``item, strength, won, lost``: maximum-likelihood Luce strengths (logarithms, mean zero) by iterative spectral ranking.

    Each round rebuilds a Markov chain from the current strengths, with the rate ``w / (s_i + s_j)`` from the loser to the
    winner of each pair, and moves on to its stationary distribution; its fixed point is the exact maximum of the likelihood.
    The stationary distribution is that of the jump chain divided by the outflow, so that items with very many
    votes don't slow it down.

    ``prior`` is the weight of one win and one loss of each item against a virtual item: with it the maximum exists for
    items that never won or never lost too. Rows are votes: the same seq counts once, null weight is 1, and rows with a null or
    equal winner and loser or a weight that is not a finite positive number do not count. Items that stand in no counted vote have no
    strength and no row. Beyond ``local_pairs`` pairs the rounds are Spark jobs on tables in the shared folder: each rebuilds the rates
    and takes one step towards the stationary distribution, accelerated so that tens of rounds reach the same maximum. Either way pair
    totals are summed in Spark first, and not to have converged after ``outer`` rounds is an error.
    """
    disk = Scratch(votes.sparkSession, "luce")
    pairs = disk.save(won_votes(delivered_once(votes)))
    n_pairs = pairs.count()
    if n_pairs > local_pairs:
        g = Arcs(pairs.select("winner", "loser", F.col("w").alias("weight")), "luce")
        logs, _ = luce_logs(g, prior, tolerance, outer)
        mean = logs.agg(F.avg("x")).first()[0]
        out = g.nodes.join(logs, "id").join(g.sums(won=F.col("ab"), lost=F.col("ba")), "id")
        return out.select(F.col("entity").alias("item"), (F.col("x") - F.lit(mean)).alias("strength"), "won", "lost")
    sides = pairs.select(F.explode(F.array(F.struct(F.col("winner").alias("item"), F.col("w").alias("won"), F.lit(0.0).alias("lost")), F.struct(F.col("loser").alias("item"), F.lit(0.0).alias("won"), F.col("w").alias("lost")))).alias("s")).select("s.*")
    items = disk.save(sides.groupBy("item").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"), F.count("*").alias("n")).sort("item").withColumn("id", F.monotonically_increasing_id()))
    hot = items.where(F.col("n") * 1000 >= max(2 * n_pairs, 1000)).select("item")
    x = lookup(pairs, "winner", items, "item", "id", "a", hot).select("a", "loser", "w")
    coded = disk.save(lookup(x, "loser", items, "item", "id", "b", hot).select("a", "b", "w"))
    return items.join(_local(coded, prior, tolerance, outer, inner), "id").select("item", "strength", "won", "lost")


def _local(coded: DataFrame, prior: float, tolerance: float, outer: int, inner: int) -> DataFrame:
    import pandas as pd

    p = coded.toPandas()
    ids, at = np.unique(np.concatenate([p["a"].to_numpy(), p["b"].to_numpy()]), return_inverse=True)
    a, b, w, n = at[: len(p)], at[len(p) :], p["w"].to_numpy(dtype=float), len(ids)
    s, v = np.full(n, 1 / max(n, 1)), 1 / max(n, 1)  # v: the virtual item
    for _ in range(outer if n else 0):
        rate, own = w / (s[a] + s[b]), prior / (s + v)
        out = np.bincount(b, rate, n) + own
        out_v = own.sum()
        # The visits of the jump chain; half of the steps stay, so that it can't swing.
        visits, visits_v = s * out, v * out_v
        for _ in range(inner):
            flow = visits / out
            nxt = np.bincount(a, rate * flow[b], n) + own * visits_v / out_v
            nxt_v = (own * flow).sum()
            visits, visits_v = (visits + nxt) / 2, (visits_v + nxt_v) / 2
        new, new_v = visits / out, visits_v / out_v
        total = new.sum() + new_v
        new, new_v = new / total, new_v / total
        moved = np.abs(np.log(new / s)).max()
        s, v = new, new_v
        if moved < tolerance:
            break
    else:
        if n:
            raise NumericError(f"not converged after {outer} rounds")
    log = np.log(s)
    out = pd.DataFrame({"id": ids.astype("int64"), "strength": log - log.mean() if n else log})
    return coded.sparkSession.createDataFrame(out, "id long, strength double")


def stronger_than(strengths: DataFrame, anchors: DataFrame) -> DataFrame:
    """``item``: those above the yardstick of ``anchors``; without a yardstick that has a strength there are none."""
    bar = anchors.where("is_yardstick").select("item").distinct().join(strengths, "item").agg(F.max("strength")).first()[0]
    return strengths.where(F.col("strength") > F.lit(bar)).select("item")


#: Tables of at most this many rows (two or three numbers each, about 30 MB as a hash table) are broadcast in the vote rounds.
BROADCAST_ROWS = 500_000


class CommunityModel:
    """Consensus of pairwise votes by a community confusion model, fitted by variational updates.

    A pair of items has a better one; which, is latent. An annotator belongs to one of a few latent communities, and each
    community has a confusion matrix: how often its members name either item if the one or the other is better. So an annotator with
    few votes is judged mostly by the community they resemble.

    A vote is one seq with annotator, winner and loser present and winner unlike loser, whatever its weight. The matrices
    have a prior that leans to right answers, which decides between the model and its mirror image. The sums over
    votes are Spark aggregations with partial sums, so neither a hot annotator nor a hot pair burdens one task;
    only ``communities`` times four sums come to the driver. Not to converge in ``rounds`` rounds is an error, unless ``tolerance`` is 0: then all are made. Empty input gives empty results.
    """

    def __init__(self, votes: DataFrame, communities: int = 6, rounds: int = 500, tolerance: float = 1e-3):
        self.k = communities
        self.disk = disk = Scratch(votes.sparkSession, "consensus")
        x = delivered_once(votes).where("annotator IS NOT NULL AND winner IS NOT NULL AND loser IS NOT NULL AND winner <> loser")
        # Which of the two counts as the first is left to a hash: names may follow the items' quality, and then one answer would always be right.
        turned = _turned(F.least("winner", "loser"), F.greatest("winner", "loser"))
        said = ((F.col("winner") > F.col("loser")) != turned).cast("int")
        x = x.select("annotator", F.least("winner", "loser").alias("low"), F.greatest("winner", "loser").alias("high"), said.alias("said"))
        cells = disk.save(x.groupBy("annotator", "low", "high", "said").agg(F.count("*").alias("c")))
        total = cells.count()
        self.pairs = disk.save(cells.groupBy("low", "high").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("said")).alias("n_said")).withColumn("pair", F.monotonically_increasing_id()))
        self.annotators = disk.save(cells.groupBy("annotator").agg(F.sum("c").alias("n"), F.count("*").alias("m")).withColumn("who", F.monotonically_increasing_id()))
        self.few_pairs = self.pairs.count() <= BROADCAST_ROWS
        self.few_annotators = self.annotators.count() <= BROADCAST_ROWS
        # Numbers instead of names from here on. No pair has more votes than annotators, so pairs need no salt.
        hot = self.annotators.where(F.col("m") * 1000 >= max(total, 1000)).select("annotator")
        y = lookup(cells, "annotator", self.annotators, "annotator", "who", "who", hot)
        self.votes = disk.save(y.join(self.pairs.select("low", "high", "pair"), ["low", "high"]).select("who", "pair", "said", "c"))
        self.hot_who = None if self.few_annotators else disk.save(hot_keys(self.votes, "who", total, "who"))
        self.hot_pair = None if self.few_pairs else disk.save(hot_keys(self.votes, "pair", total, "pair"))
        self._fit(rounds, tolerance)

    def _with(self, key: str, values: DataFrame, names: list[str]) -> DataFrame:
        if self.few_pairs if key == "pair" else self.few_annotators:
            return self.votes.join(F.broadcast(values), key)
        packed = values.select(key, F.struct(*names).alias("packed"))
        out = lookup(self.votes, key, packed, key, "packed", "packed", self.hot_pair if key == "pair" else self.hot_who)
        return out.select(*self.votes.columns, "packed.*")

    def _sums(self, truth: DataFrame) -> DataFrame:
        """Per annotator the expected votes n_tk: said k while t is better."""
        x = self._with("pair", truth, ["q"])
        q = {0: 1 - F.col("q"), 1: F.col("q")}
        return x.groupBy("who").agg(*[F.sum(F.when(F.col("said") == k, F.col("c") * q[t]).otherwise(0.0)).alias(f"n{t}{k}") for t in (0, 1) for k in (0, 1)])

    def _members(self, sums: DataFrame, e: np.ndarray, rho: np.ndarray) -> DataFrame:
        score: list[Column] = []
        for m in range(self.k):
            s = F.lit(float(rho[m]))
            for t in (0, 1):
                for k in (0, 1):
                    s = s + F.col(f"n{t}{k}") * F.lit(float(e[m, t, k]))
            score.append(s)
        x = sums.withColumn("_s", F.array(*score)).withColumn("_m", F.array_max("_s"))
        x = x.withColumn("_e", F.transform("_s", lambda v: F.exp(v - F.col("_m"))))
        return x.withColumn("r", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_s", "_m", "_e")

    def _totals(self, members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        aggs = [F.sum(F.col("r")[m]).alias(f"r{m}") for m in range(self.k)]
        aggs += [F.sum(F.col("r")[m] * F.col(f"n{t}{k}")).alias(f"c{m}{t}{k}") for m in range(self.k) for t in (0, 1) for k in (0, 1)]
        row = members.agg(*aggs).first()
        size = np.array([row[f"r{m}"] or 0.0 for m in range(self.k)])
        return size, np.array([row[f"c{m}{t}{k}"] or 0.0 for m in range(self.k) for t in (0, 1) for k in (0, 1)]).reshape(self.k, 2, 2)

    def _fit(self, rounds: int, tolerance: float) -> None:
        disk = self.disk
        truth = disk.save(self.pairs.select("pair", F.least(F.greatest(F.col("n_said") / F.col("n"), F.lit(0.05)), F.lit(0.95)).alias("q")))
        sums = disk.save(self._sums(truth))
        # Communities start at evenly spaced shares of right answers.
        centres = np.linspace(0.15, 0.95, self.k)
        n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
        right = (F.col("n00") + F.col("n11") + 2) / (n + 3)
        near = F.array(*[F.exp(-((right - F.lit(float(c))) ** 2) / 0.02) for c in centres])
        members = sums.withColumn("_e", near).withColumn("r", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).drop("_e")
        size, counts = self._totals(members)
        lean = np.array([[1.3, 0.7], [0.7, 1.3]])
        self.e = np.zeros((self.k, 2, 2))
        older = None
        for _ in range(rounds):
            alpha = counts + lean
            e = _digamma(alpha) - _digamma(alpha.sum(axis=2, keepdims=True))
            rho = _digamma(size + 1) - _digamma(size.sum() + self.k)
            moved, self.e = np.abs(np.exp(e) - np.exp(self.e)).max(), e
            members = self._members(sums, e, rho)
            # What an annotator's vote for the one or the other item adds to the log odds that the higher is better.
            gain = [sum((F.col("r")[m] * F.lit(float(e[m, 1, k] - e[m, 0, k])) for m in range(self.k)), F.lit(0.0)).alias(f"g{k}") for k in (0, 1)]
            x = self._with("who", members.select("who", *gain), ["g0", "g1"])
            odds = x.groupBy("pair").agg(F.sum(F.col("c") * F.when(F.col("said") == 1, F.col("g1")).otherwise(F.col("g0"))).alias("z"))
            # A round is one job: from the annotators' sums to the pairs and back, of which only the new sums are written.
            truth = odds.select("pair", (1 / (1 + F.exp(-F.col("z")))).alias("q"))
            if moved < tolerance:
                truth = disk.save(truth)
                sums = disk.save(self._sums(truth))
                break
            old, sums = sums, disk.save(self._sums(truth))
            size, counts = self._totals(self._members(sums, e, rho))
            disk.drop(older)
            older = old
        else:
            if tolerance > 0:
                raise NumericError(f"not converged after {rounds} rounds")
            truth = disk.save(truth)
        self.truth, self.members = truth, self._members(sums, self.e, rho)
        self.accuracy = [float((np.exp(self.e[m, 0, 0]) + np.exp(self.e[m, 1, 1])) / 2) for m in range(self.k)]

    def consensus(self) -> DataFrame:
        """``low, high, winner, certainty, agreement, n_votes`` per pair: the likely better item, how likely, and the share of votes that name it.

        At even odds the item with the smaller name is given.
        """
        x = self.pairs.join(self.truth, "pair")
        turned = _turned(F.col("low"), F.col("high"))
        named = F.when(F.col("q") > 0.5, F.col("n_said")).otherwise(F.col("n") - F.col("n_said"))
        high = F.when(F.col("q") == 0.5, False).otherwise((F.col("q") > 0.5) != turned)
        # At even odds the smaller name is given: its votes are those not said, or those said if the pair is turned.
        named = F.when((F.col("q") == 0.5) & turned, F.col("n_said")).otherwise(named)
        return x.select("low", "high", F.when(high, F.col("high")).otherwise(F.col("low")).alias("winner"), F.greatest("q", 1 - F.col("q")).alias("certainty"), (named / F.col("n")).alias("agreement"), F.col("n").alias("n_votes"))

    def reliability(self, votes_of_community: float = 10.0) -> DataFrame:
        """``annotator, n_votes, named_better, share, reliability`` per annotator.

        ``named_better`` counts votes for the item inferred to be the better one (half a vote each at even odds), ``share`` is its part of all
        votes; ``reliability`` also has the communities' expected share in it, with the weight of ``votes_of_community`` votes.
        """
        best = self.truth.select("pair", F.when(F.col("q") > 0.5, 1.0).when(F.col("q") < 0.5, 0.0).otherwise(0.5).alias("q"))
        right = self._sums(best).select("who", (F.col("n00") + F.col("n11")).alias("named"))
        own = sum((F.col("r")[m] * F.lit(self.accuracy[m]) for m in range(self.k)), F.lit(0.0))
        x = self.annotators.join(right, "who").join(self.members.select("who", own.alias("expected")), "who")
        smooth = (F.col("named") + F.lit(votes_of_community) * F.col("expected")) / (F.col("n") + F.lit(votes_of_community))
        return x.select("annotator", F.col("n").alias("n_votes"), F.col("named").alias("named_better"), (F.col("named") / F.col("n")).alias("share"), smooth.alias("reliability"))

    def unreliable(self, least_votes: int = 20) -> DataFrame:
        """``annotator``: those with ``least_votes`` votes who name the better item in less than two thirds of them."""
        return self.reliability().where((F.col("n_votes") >= least_votes) & (3 * F.col("named_better") < 2 * F.col("n_votes"))).select("annotator")


def _turned(low: Column, high: Column) -> Column:
    return F.md5(F.concat_ws("\x01", low, high)) >= "8"


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by recurrence and the asymptotic series, to about 1e-12 for positive arguments."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))
