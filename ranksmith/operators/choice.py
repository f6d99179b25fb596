"""Maximum-likelihood and Bayesian choice models, fitted on aggregates of bounded size."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.functions.math import np_norm_cdf, np_norm_pdf, np_norm_ppf, np_softmax
from ranksmith.model import EmptyDataset, InvalidInput, Model, NumericError, TooLarge, params_of
from ranksmith.operators.pairs import LOCAL_PAIRS, bounded, clean_pairs, local_cells, require, single_players
from ranksmith.operators.spectral import _components, frame, scored
from ranksmith.session import Scratch


@dataclass(frozen=True)
class BradleyTerryLR:
    """Gradient steps on the logistic likelihood, period by period; decay shrinks by the norm once a pass."""

    passes: int = 10
    alpha: float = 1.0
    decay: float = 1e-5
    thrifty: bool = False

    def fit(self, pairs: DataFrame, init: Model | None = None) -> Model:
        x = clean_pairs(pairs)
        period = F.col("period") if "period" in x.columns else F.lit(1)
        if self.thrifty:
            # One sequence: its rows must be in order, so they come to one place; bounded.
            rows = bounded(x.select(period.alias("p"), "seq", "winner", "loser", F.col("weight").alias("w")), LOCAL_PAIRS, "rows in sequence").sort_values(["p", "seq"])
        else:
            rows = bounded(x.groupBy(period.alias("p"), "winner", "loser").agg(F.sum("weight").alias("w")), LOCAL_PAIRS, "pairs by period").sort_values("p")
        if not len(rows):
            raise EmptyDataset("no pair")
        names, at = np.unique(np.concatenate([rows["winner"], rows["loser"]]).astype(object), return_inverse=True)
        a, b, w, p = at[: len(rows)], at[len(rows) :], rows["w"].to_numpy(float), rows["p"].to_numpy()
        s = np.zeros(len(names))
        if init is not None:
            old = {r.entity: r.score for r in init.table.collect()}
            s = np.array([old.get(k, 0.0) for k in names])
        for q in pd.unique(p):
            m = p == q
            i, j, x = a[m], b[m], w[m]
            if x.sum() == 0:
                continue
            for _ in range(self.passes):
                if self.thrifty:
                    for i1, j1, x1 in zip(i, j, x, strict=True):
                        g = self.alpha * x1 / x.sum() / (1 + np.exp(s[i1] - s[j1]))
                        s[i1] += g
                        s[j1] -= g
                else:
                    g = self.alpha * x / x.sum() / (1 + np.exp(s[i] - s[j]))
                    s = s + np.bincount(i, g, len(s)) - np.bincount(j, g, len(s))
                norm = np.linalg.norm(s)
                s = s - self.decay * s / norm if norm > 0 else s
        return Model("btm-lr", params_of(self), frame(pairs, {"entity": list(names), "score": s}, "entity string, score double"))


@dataclass(frozen=True)
class GeneralizedBt:
    """Bradley-Terry with ties (``davidson``, ``rao-kupper`` or ``none``) and an advantage of side 1 (``home``)."""

    ties: str = "davidson"
    home: bool = False
    iterations: int = 10_000
    tolerance: float = 1e-9

    def fit(self, games: DataFrame) -> Model:
        games = single_players(games)
        h, v = F.col("side1")[0].alias("h"), F.col("side2")[0].alias("v")
        won = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
        g = games.groupBy(h, v).agg(won(F.col("margin") > 0).alias("x1"), won(F.col("margin") < 0).alias("x2"), won(F.col("margin") == 0).alias("x0"))
        p = bounded(g, LOCAL_PAIRS, "ordered pairs of sides")
        if not len(p):
            raise EmptyDataset("no game")
        names, at = np.unique(np.concatenate([p["h"], p["v"]]).astype(object), return_inverse=True)
        n, i, j = len(names), at[: len(p)], at[len(p) :]
        x1, x2, x0 = (p[c].to_numpy(float) for c in ("x1", "x2", "x0"))
        if self.ties == "none" and x0.sum() > 0:
            raise InvalidInput("tied games, but a model without ties")
        total = x1 + x2 + x0
        pi, tie, gam = np.full(n, 1 / n), 1.0 if self.ties == "rao-kupper" else 0.5, 1.0
        theta = 1.5
        for _ in range(self.iterations):
            hp, vp = gam * pi[i], pi[j]
            if self.ties == "rao-kupper":
                # A tie counts as a part of a win of both; MM on both comparisons of a game.
                d1, d2 = hp + theta * vp, theta * hp + vp
                s1, s2 = (x1 + x0) / d1, (x2 + x0) / d2
                num = np.bincount(i, x1 + x0, n) + np.bincount(j, x2 + x0, n)
                den = np.bincount(i, gam * (s1 + theta * s2), n) + np.bincount(j, theta * s1 + s2, n)
            else:
                root = np.sqrt(hp * vp)
                nu = tie if self.ties == "davidson" else 0.0
                d = hp + vp + nu * root
                num = np.bincount(i, x1 + x0 / 2, n) + np.bincount(j, x2 + x0 / 2, n)
                den = np.bincount(i, total * (gam + nu * root / pi[i] / 2) / d, n) + np.bincount(j, total * (1 + nu * root / pi[j] / 2) / d, n)
            new = num / den
            new /= new.sum()
            hp, vp = gam * new[i], new[j]
            new_gam, new_tie = gam, tie
            if self.ties == "davidson":
                d = hp + vp + tie * np.sqrt(hp * vp)
                new_tie = x0.sum() / max((total * np.sqrt(hp * vp) / d).sum(), 1e-300)
                if self.home:
                    d = hp + vp + new_tie * np.sqrt(hp * vp)
                    new_gam = gam * (x1 + x0 / 2).sum() / (total * (hp + new_tie * np.sqrt(hp * vp) / 2) / d).sum()
            elif self.ties == "rao-kupper":
                new_tie = theta = _rao_kupper(hp, vp, x1, x2, x0)
                if self.home:
                    d1, d2 = hp + theta * vp, theta * hp + vp
                    new_gam = gam * (x1 + x0).sum() / ((x1 + x0) * hp / d1 + (x2 + x0) * theta * hp / d2).sum()
            elif self.home:
                new_gam = gam * x1.sum() / (total * hp / (hp + vp)).sum()
            moved = np.abs(new - pi).mean() + abs(new_tie - tie) + abs(new_gam - gam)
            pi, tie, gam = new, new_tie, new_gam
            if not np.isfinite(moved):
                raise NumericError("the fit diverged")
            if moved < self.tolerance:
                break
        s = np.log(np.maximum(pi, 1e-300))
        table = frame(games, {"entity": list(names), "score": s - s.mean()}, "entity string, score double")
        return Model("gbt", params_of(self), table, {"tie": float(tie if self.ties != "none" else 0.0), "home": float(gam)})


def _rao_kupper(h, v, x1, x2, x0) -> float:
    """The threshold, by bisection of the likelihood's derivative over (1, 100]."""
    if x0.sum() == 0:
        return 1.0

    def slope(t: float) -> float:
        return x0.sum() * 2 * t / (t * t - 1) - ((x1 + x0) * v / (h + t * v)).sum() - ((x2 + x0) * h / (t * h + v)).sum()

    lo, hi = 1 + 1e-12, 100.0
    for _ in range(64):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class TeamBradleyTerry:
    """Player strengths when sides of several meet: a side's strength is the sum or product of its players'."""

    aggregate: str = "additive"
    iterations: int = 10_000
    tolerance: float = 1e-9
    ties: str = "error"

    def fit(self, games: DataFrame) -> Model:
        if self.ties == "error":
            games = require(games, F.col("margin") != 0, "a tied game")
        first = F.col("margin") > 0
        g = games.where("margin <> 0").select(F.when(first, F.col("side1")).otherwise(F.col("side2")).alias("w"), F.when(first, F.col("side2")).otherwise(F.col("side1")).alias("l"), F.col("weight").cast("double").alias("x"))
        p = bounded(g.select(F.array_sort("w").alias("w"), F.array_sort("l").alias("l"), "x").groupBy("w", "l").agg(F.sum("x").alias("x")), LOCAL_PAIRS, "distinct pairings of sides")
        if not len(p):
            raise EmptyDataset("no game")
        names = sorted({k for s in (*p["w"], *p["l"]) for k in s}, key=lambda s: s.encode())
        at = {k: i for i, k in enumerate(names)}
        n, m, x = len(names), len(p), p["x"].to_numpy(float)
        who = np.array([at[k] for s in (*p["w"], *p["l"]) for k in s])
        row = np.repeat(np.arange(2 * m), [len(s) for s in (*p["w"], *p["l"])])
        game, wins = row % m, row < m
        won = np.bincount(who[wins], x[game[wins]], n)
        idle = [names[i] for i in np.flatnonzero((won == 0) | (np.bincount(who[~wins], minlength=n) == 0))[:5]]
        if idle:
            raise NumericError(f"no finite strengths: {idle} only won or only lost")
        pi = np.full(n, 1 / n if self.aggregate == "additive" else 1.0)
        for _ in range(self.iterations):
            if self.aggregate == "additive":
                side = np.bincount(row, pi[who], 2 * m)
                both = side[:m] + side[m:]
                new = pi * np.bincount(who[wins], (x / side[:m])[game[wins]], n) / np.bincount(who, (x / both)[game], n)
                new /= new.sum()
            elif self.aggregate == "product":
                side = np.exp(np.bincount(row, np.log(pi)[who], 2 * m))
                both = side[:m] + side[m:]
                new = won / np.bincount(who, x[game] * side[row] / pi[who] / both[game], n)
                new /= np.exp(np.log(new).mean())
            else:
                raise InvalidInput(f"aggregate {self.aggregate}")
            moved = np.abs(new - pi).mean()
            pi = new
            if moved < self.tolerance:
                break
        return Model("team-bt", params_of(self), frame(games, {"entity": names, "score": pi}, "entity string, score double"))


@dataclass(frozen=True)
class ThurstoneMosteller:
    """Probit strengths by damped Newton steps with Fisher curvature, mean zero."""

    iterations: int = 1000
    tolerance: float = 1e-10
    pseudo_count: float = 0.0

    def fit(self, pairs: DataFrame) -> Model:
        c = local_cells(pairs)
        i, j, wi, wj = c.unordered()
        wi, wj = wi + self.pseudo_count, wj + self.pseudo_count
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        mine, theirs = np.concatenate([wi, wj]), np.concatenate([wj, wi])
        start = np_norm_ppf(np.clip((mine + 0.5) / (mine + theirs + 1), 1e-6, 1 - 1e-6))
        mu = np.bincount(src, start, c.size) / np.maximum(np.bincount(src, minlength=c.size), 1)
        mu -= mu.mean()
        for _ in range(self.iterations):
            d = mu[src] - mu[dst]
            p, q, pdf = np.maximum(np_norm_cdf(d), 1e-300), np.maximum(np_norm_cdf(-d), 1e-300), np_norm_pdf(d)
            g = np.bincount(src, mine * pdf / p - theirs * pdf / q, c.size)
            h = np.bincount(src, (mine + theirs) * pdf * pdf / (p * q), c.size)
            new = mu + np.divide(0.5 * g, h, out=np.zeros(c.size), where=h > 0)
            new -= new.mean()
            far = np.flatnonzero(~np.isfinite(new) | (np.abs(new) > 30))
            if len(far):
                raise NumericError(f"diverged at {[c.names[k] for k in far[:3]]}; a pseudo count makes the answer finite")
            moved = np.abs(new - mu).mean()
            mu = new
            if moved < self.tolerance:
                break
        return scored(pairs, c, "thurstone", self, mu)


@dataclass(frozen=True)
class EsRum:
    """Means and deviations of random utilities by an evolution strategy whose populations are scored in parallel tasks.

    Deviations add (not variances); weights must be whole numbers. Means are shifted to a minimum of 0 and all is divided by the
    largest deviation.
    """

    distribution: str = "gaussian"
    passes: int = 100
    alpha: float = 1.0
    gamma: float = 1e-3
    min_obs: int = 1
    prior: float = 0.0
    seed: int = 2019

    def fit(self, pairs: DataFrame) -> Model:
        c = local_cells(pairs)
        i, j, wi, wj = c.unordered()
        if (np.concatenate([wi, wj]) % 1).any():
            raise InvalidInput("weights must be whole numbers")
        n = wi + wj + 2 * self.prior
        keep = wi + wj >= self.min_obs
        i, j, share, n = i[keep], j[keep], (wi + self.prior)[keep] / n[keep], n[keep]
        k, fixed = c.size, self.distribution == "fixed-normal"

        def loss(x: np.ndarray) -> float:
            mu, sd = x[:k], np.ones(k) if fixed else np.exp(x[k:])
            return float((n * np.abs(np_norm_cdf((mu[i] - mu[j]) / (sd[i] + sd[j])) - share)).sum() / n.sum() + self.gamma * np.sqrt((x * x).mean()))

        rng = np.random.Generator(np.random.Philox(self.seed))
        won = c.add(c.a, c.w)
        rate = won / np.maximum(won + c.add(c.b, c.w), 1e-300)
        mean = np.concatenate([2 * np_norm_ppf(np.clip(rate, 0.01, 0.99)), np.zeros(0 if fixed else k)])
        width = np.full(len(mean), 0.3 * self.alpha)
        best, at = mean.copy(), loss(mean)
        size = 4 + int(3 * np.log(len(mean))) * 2
        for _ in range(self.passes):
            noise = rng.standard_normal((size, len(mean)))
            values = np.array([loss(mean + width * z) for z in noise])
            order = np.argsort(values, kind="stable")[: size // 2]
            rank = np.log(size / 2 + 0.5) - np.log(np.arange(1, len(order) + 1))
            w = rank / rank.sum()
            mean = mean + width * (w[:, None] * noise[order]).sum(axis=0)
            width = width * np.exp(0.1 * ((w[:, None] * noise[order] ** 2).sum(axis=0) - 1)).clip(0.8, 1.1)
            now = loss(mean)
            if now < at:
                best, at = mean.copy(), now
        mu, sd = best[:k], np.ones(k) if fixed else np.exp(best[k:])
        top = sd.max()
        mu = (mu - mu.min()) / top
        return Model("es-rum", params_of(self), frame(pairs, {"entity": c.names, "score": mu, "sigma": sd / top}, "entity string, score double, sigma double"), {"loss": at})


#: A ballot of up to so many items is taken as the sets that its choices were made from, which many ballots share; a longer one stays a list.
SHORT_BALLOT = 16
#: Most items in all sets and lists, 4 bytes each, that are added up in one memory; more are added up by a Spark job a round.
LOCAL_ITEMS = 10_000_000


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items of all lists, each list's start and length."""
    offsets = batch.column(0).offsets.to_numpy().astype(np.int64)
    ids = batch.column(0).values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return ids, offsets[:-1] - offsets[0], np.diff(offsets)


def _remaining(batch: pa.RecordBatch, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each list the items that are kept, if there are two of them: all in a row, and how many a list has."""
    ids, _, length = _lists(batch)
    own = np.repeat(np.arange(len(length)), length)
    left = np.bincount(own[keep[ids]], minlength=len(length))
    return ids[keep[ids] & (left >= 2)[own]], left[left >= 2]


def _places(batch: pa.RecordBatch, keep: np.ndarray) -> np.ndarray:
    """How often each item stands above another, then how often below."""
    ids, length = _remaining(batch, keep)
    ends, n = np.cumsum(length), len(keep)
    return np.concatenate([np.bincount(np.delete(ids, ends - 1), minlength=n), np.bincount(np.delete(ids, ends - length), minlength=n)]).astype(float)


def _choice_sets(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    """``ids, list``: the items each choice was made from, sorted; or the ballot itself, if it is long."""
    ids, length = _remaining(batch, keep)
    starts, out, sizes, lists = np.cumsum(length) - length, [], [], []
    for m in np.unique(length):
        x = ids[starts[length == m][:, None] + np.arange(m)]
        for p in range(m - 1) if m <= SHORT_BALLOT else (0,):
            out.append((np.sort(x[:, p:], axis=1) if m <= SHORT_BALLOT else x).ravel())
            sizes.append(np.full(len(x), m - p))
            lists.append(np.full(len(x), m > SHORT_BALLOT))
    flat, ends = np.concatenate([*out, np.zeros(0, int)]), np.cumsum(np.concatenate([[0], *sizes]))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.concatenate([*lists, np.zeros(0, bool)]), pa.bool_())], ["ids", "list"])


def _choice_odds(batch: pa.RecordBatch, g: np.ndarray) -> np.ndarray:
    """For each item, the weights of the choices from sets that hold it, over the strengths of those sets."""
    ids, starts, length = _lists(batch)
    is_list, w = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    part = np.repeat(np.where(is_list, 0.0, w / np.maximum(np.add.reduceat(g[ids], starts), 1e-300)), length)
    for k in np.flatnonzero(is_list):
        # What is left from each place on; the last place is no choice.
        own = slice(starts[k], starts[k] + length[k])
        part[own] = w[k] / np.maximum(np.cumsum(g[ids[own]][::-1])[::-1], 1e-300)
        part[own.stop - 1] = 0.0
        part[own] = np.cumsum(part[own])
    return np.bincount(ids, part, len(g))


class _Batches:
    """Rows as Arrow batches: in one memory if they are few, else where they are written. ``form`` makes of a batch what is summed over."""

    def __init__(self, table: DataFrame, near: bool, form=lambda batch: batch, rows: int = 1 << 17):
        self.table, self.form, self.local = table, form, None
        if near:
            self.local = [form(b) for b in table.toArrow().combine_chunks().to_batches(max_chunksize=rows)]

    def total(self, f, x: Any, size: int) -> np.ndarray:
        """The sum of ``f(batch, x)`` over all batches."""
        if self.local is not None:
            return sum((f(b, x) for b in self.local), np.zeros(size))
        sent, form = self.table.sparkSession.sparkContext.broadcast(x), self.form

        def add(batches):
            out = np.zeros(size)
            for b in batches:
                out += f(form(b), sent.value)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_pydict({"cell": at, "r": out[at]})

        rows = self.table.mapInArrow(add, "cell long, r double").groupBy("cell").agg(F.sum("r").alias("r")).toArrow()
        sent.destroy()
        out = np.zeros(size)
        out[rows["cell"].to_numpy()] = rows["r"].to_numpy()
        return out

    def labels(self, n: int) -> np.ndarray:
        """Of each item, the same number as of all items that lists tie it to."""

        def tied(batches):
            label, keys, waiting = np.arange(n), [], 0
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    ids, starts, length = _lists(b)
                    keys.append(np.unique(np.repeat(ids[starts], length).astype(np.int64) * n + ids))
                    waiting += len(keys[-1])
                if keys and (b is None or waiting > n):
                    key = np.concatenate(keys)
                    label, keys, waiting = _components(n, np.concatenate([np.arange(n), key // n]), np.concatenate([label, key % n])), [], 0
            yield pa.RecordBatch.from_pydict({"item": np.arange(n)[label < np.arange(n)], "label": label[label < np.arange(n)]})

        if self.local is not None:
            rows = pa.Table.from_batches(tied(self.local))
        else:
            rows = self.table.mapInArrow(tied, "item long, label long").toArrow()
        return _components(n, rows["item"].to_numpy(), rows["label"].to_numpy())


@dataclass(frozen=True)
class PlackettLuce:
    """Hunter's MM over ballots, by component of co-occurrence; always-last and never-beaten items apart.

    A round needs only the sets that items were chosen from, however many ballots share them.
    """

    iterations: int = 10_000
    tolerance: float = 1e-9

    def fit(self, ballots: DataFrame, init: Model | None = None) -> Model:
        disk = Scratch(ballots.sparkSession, "plackett-luce")
        x = ballots.where(F.size("items") >= 2)
        x = require(x, F.size(F.array_distinct("items")) == F.size("items"), "a ballot names an item twice")
        x = disk.save(x.select("items"))
        seat = x.select(F.posexplode("items").alias("p", "entity"), (F.size("items") - 1).alias("last"))
        rows = bounded(seat.groupBy("entity").agg(F.count("*").alias("n"), F.count_if(F.col("p") < F.col("last")).alias("above"), F.count_if(F.col("p") > 0).alias("below")), LOCAL_PAIRS, "items of ballots")
        if not len(rows):
            raise EmptyDataset("no ballot of two items")
        names = sorted(rows["entity"], key=lambda s: s.encode())
        at, n = {k: i for i, k in enumerate(names)}, len(names)
        above, below = np.zeros(n), np.zeros(n)
        above[[at[k] for k in rows["entity"]]], below[[at[k] for k in rows["entity"]]] = rows["above"], rows["below"]
        sent = ballots.sparkSession.sparkContext.broadcast(pa.array(names, pa.string()))

        def code(batches):
            for batch in batches:
                lists = batch.column(0)
                ids = pc.index_in(lists.values, value_set=sent.value.cast(lists.values.type))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lists.offsets, ids)], ["ids"])

        coded = disk.save(x.mapInArrow(code, "ids array<int>"))
        disk.drop(x)
        apart: dict[str, list[tuple[str, float]]] = {"undefeated": [], "winless": []}
        keep, all_ = np.ones(n, bool), None
        while True:
            top, last = np.flatnonzero((above > 0) & (below == 0)), np.flatnonzero((below > 0) & (above == 0))
            if not len(top) and not len(last):
                break
            apart["undefeated"] += [(names[k], float(above[k])) for k in top]
            apart["winless"] += [(names[k], -float(below[k])) for k in last]
            keep[top] = keep[last] = False
            all_ = all_ or _Batches(coded, rows["n"].sum() <= LOCAL_ITEMS)
            above, below = np.split(all_.total(_places, keep, 2 * n), 2)
        rows_out: list[tuple[int, str, str, float | None]] = []
        sweeps = section = 0
        used = np.flatnonzero(above + below > 0)
        if len(used):

            def split(batches):
                for batch in batches:
                    yield _choice_sets(batch, keep)

            sets = disk.save(coded.mapInArrow(split, "ids array<int>, list boolean").groupBy("ids", "list").agg(F.count("*").cast("double").alias("w")))
            choices = _Batches(sets, sets.agg(F.sum(F.size("ids"))).first()[0] <= LOCAL_ITEMS)
            won, label = above, choices.labels(n)
            old = {r.entity: r.score for r in init.table.where("kind = 'ranked'").collect()} if init is not None else {}
            g = np.zeros(n)
            g[used] = [old.get(names[k], 1.0) for k in used]
            for k in range(self.iterations):
                total = np.bincount(label, g, n)
                g = np.divide(g, total[label], out=np.zeros_like(g), where=total[label] > 0)
                new = np.divide(won, choices.total(_choice_odds, g, n), out=np.zeros_like(won), where=won > 0)
                t = np.bincount(label, new, n)
                new = np.divide(new, t[label], out=np.zeros_like(new), where=t[label] > 0)
                moved = np.abs(new - g)[used].mean()
                g, sweeps = new, k + 1
                if moved < self.tolerance:
                    break
            for _, members in _by_size(used, label):
                rows_out += [(section, "ranked", names[k], float(g[k])) for k in members]
                section += 1
        for k, (kind, xs) in enumerate(apart.items()):
            rows_out += [(section + k, kind, e, s) for e, s in xs]
        said = {r[2] for r in rows_out}
        rows_out += [(section + 2, "isolated", e, None) for e in names if e not in said]
        return Model("plackett-luce", params_of(self), ballots.sparkSession.createDataFrame(rows_out, "section int, kind string, entity string, score double"), {"sweeps": sweeps})


def _by_size(used: np.ndarray, label: np.ndarray) -> list[tuple[int, np.ndarray]]:
    groups = [(int(x), used[label[used] == x]) for x in np.unique(label[used])]
    return sorted(groups, key=lambda g: (-len(g[1]), g[1][0]))


@dataclass(frozen=True)
class BayesianBradleyTerry:
    """Gibbs sampling of strengths with gamma latent times, chains in parallel tasks; score is the mean of ``pi``."""

    shape: float = 1.0
    rate: float = 1.0
    samples: int = 2000
    burn_in: int = 500
    credible: float = 0.9
    seed: int = 2012
    chains: int = 1

    def fit(self, pairs: DataFrame) -> Model:
        c = local_cells(pairs)
        i, j, wi, wj = c.unordered()
        won = c.add(c.a, c.w)
        op, n = self, c.size
        sent = pairs.sparkSession.sparkContext.broadcast((i, j, wi + wj, won))

        def chain(batches):
            i, j, games, won = sent.value
            for pdf in batches:
                for k in pdf["id"]:
                    rng = np.random.Generator(np.random.Philox(key=[op.seed, int(k)]))
                    lam, kept = np.ones(n), np.empty((op.samples, n))
                    for t in range(op.burn_in + op.samples):
                        z = rng.gamma(games, 1 / (lam[i] + lam[j]))
                        lam = rng.gamma(op.shape + won, 1 / (op.rate + np.bincount(i, z, n) + np.bincount(j, z, n)))
                        if t >= op.burn_in:
                            kept[t - op.burn_in] = lam / lam.sum()
                    for e in range(n):
                        yield pd.DataFrame({"e": e, "pi": kept[:, e]})

        tail = (1 - self.credible) / 2
        draws = pairs.sparkSession.range(0, self.chains, 1, self.chains).mapInPandas(chain, "e int, pi double")
        names = pairs.sparkSession.createDataFrame(pd.DataFrame({"e": np.arange(n, dtype="int32"), "entity": c.names}), "e int, entity string")
        q = draws.groupBy("e").agg(F.avg("pi").alias("score"), F.percentile("pi", F.lit(tail)).alias("lower"), F.percentile("pi", F.lit(1 - tail)).alias("upper"))
        return Model("bayes-bt", params_of(self), q.join(names, "e").select("entity", "score", "lower", "upper"))


@dataclass(frozen=True)
class CovariateBt:
    """Strengths that are linear in features (``entity, x``), by ridge Newton steps; with ``intercepts`` one more term each."""

    l2: float = 1e-4
    intercepts: bool = False
    iterations: int = 500
    tolerance: float = 1e-8

    def fit(self, pairs: DataFrame, features: DataFrame) -> Model:
        if self.intercepts and self.l2 <= 0:
            raise InvalidInput("intercepts need l2 > 0")
        c = local_cells(pairs)
        x = {r.entity: r.x for r in bounded(features.select("entity", "x").join(frame(pairs, {"entity": c.names}, "entity string"), "entity", "left_semi"), 1_000_000, "entities").itertuples()}
        lost = [k for k in c.names if k not in x]
        if lost:
            raise InvalidInput(f"no features of {lost[:5]}")
        f = np.array([x[k] for k in c.names], float)
        d = f.shape[1]
        if self.intercepts:
            if c.size > 5000:
                raise InvalidInput("intercepts of more than 5000 entities make the system too large")
            f = np.hstack([f, np.eye(c.size)])
        diff = f[c.a] - f[c.b] if f.shape[1] <= 200 else None
        beta = np.zeros(f.shape[1])

        def value(b: np.ndarray) -> float:
            s = f @ b
            return float(-(c.w * np.logaddexp(0, -(s[c.a] - s[c.b]))).sum() - self.l2 / 2 * b @ b)

        now = value(beta)
        for _ in range(self.iterations):
            s = f @ beta
            p = 1 / (1 + np.exp(s[c.a] - s[c.b]))
            if diff is not None:
                g = diff.T @ (c.w * p) - self.l2 * beta
                hess = (diff * (c.w * p * (1 - p))[:, None]).T @ diff
            else:
                v, k = c.w * p * (1 - p), c.size
                lap = np.zeros((k, k))
                np.add.at(lap, (c.a, c.a), v), np.add.at(lap, (c.b, c.b), v), np.add.at(lap, (c.a, c.b), -v), np.add.at(lap, (c.b, c.a), -v)
                g = f.T @ (c.add(c.a, c.w * p) - c.add(c.b, c.w * p)) - self.l2 * beta
                hess = f.T @ lap @ f
            step = np.linalg.solve(hess + self.l2 * np.eye(len(beta)), g)
            for _ in range(41):
                new = value(beta + step)
                if new >= now - 1e-12:
                    break
                step = step / 2
            beta, moved, now = beta + step, np.abs(step).max(), new
            if moved < self.tolerance:
                break
        m = scored(pairs, c, "cbt", self, f @ beta, beta=beta[:d].tolist())
        if self.intercepts:
            m.info["intercepts"] = dict(zip(c.names, beta[d:].tolist(), strict=True))
        return m


#: Most cells of annotator and pair (20 bytes each, and as much while they come) that CrowdBt sums over in one memory; more are summed by a Spark job a round.
LOCAL_CELLS = 5_000_000


def _crowd_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The runs of equal pairs, as winners, losers, starts and lengths; the annotators and weights of their cells."""
    a, b, k, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[starts], b[starts], starts, np.diff(np.append(starts, len(a))), k, w


def _crowd_weights(cells: tuple[np.ndarray, ...], m: int) -> np.ndarray:
    return np.bincount(cells[4], cells[5], m)


def _crowd_sums(cells: tuple[np.ndarray, ...], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Each annotator's weight of votes taken as meant, each item's wins, and the votes' log-likelihood."""
    (a, b, starts, length, k, w), (g, eta) = cells, x
    if not len(a):
        return np.zeros(len(eta) + len(g) + 1)
    t = np.repeat(g[a] / (g[a] + g[b]), length)
    e = eta[k]
    r = e * t
    z = r + (1 - e) * (1 - t)
    r *= w
    r /= z
    won, all_ = np.add.reduceat(r, starts), np.add.reduceat(w, starts)
    return np.concatenate([np.bincount(k, r, len(eta)), np.bincount(a, won, len(g)) + np.bincount(b, all_ - won, len(g)), [w @ np.log(z)]])


@dataclass(frozen=True)
class CrowdBt:
    """Bradley-Terry strengths with a reliability of each annotator (``side`` item or annotator), by expectation maximisation.

    Votes are numbered in the tasks. Items, annotators and pairs of items come to one memory; the votes of each annotator on a pair
    up to LOCAL_CELLS.
    """

    lam: float = 0.5
    eta_prior_alpha: float = 10.0
    eta_prior_beta: float = 1.0
    iterations: int = 200
    tolerance: float = 1e-8
    inner_sweeps: int = 10

    def fit(self, votes: DataFrame) -> Model:
        if self.lam <= 0 or min(self.eta_prior_alpha, self.eta_prior_beta) < 1:
            raise InvalidInput("needs lam > 0 and priors of at least 1")
        spark = votes.sparkSession
        disk = Scratch(spark, "crowd-bt")
        x = clean_pairs(votes).where("annotator IS NOT NULL AND weight > 0").select("annotator", "winner", "loser", "weight")
        said = [F.struct(F.lit(c == "annotator").alias("votes"), F.col(c).alias("e")) for c in ("annotator", "winner", "loser")]
        known = disk.save(x.select(F.explode(F.array(*said)).alias("r")).select("r.*").distinct())
        size = known.count()
        if not size:
            raise EmptyDataset("no vote")
        if size > LOCAL_PAIRS:
            raise TooLarge(f"more than {LOCAL_PAIRS} items and annotators; this solver needs them in one memory")
        known = known.toArrow().combine_chunks()
        who, names = (pc.take(e, pc.sort_indices(e)) for e in (known.filter(f)["e"].combine_chunks() for f in (known["votes"], pc.invert(known["votes"]))))
        n, m = len(names), len(who)
        cells = disk.save(self._cells(x, who, names))
        pairs = disk.save(cells.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("w").alias("w")))
        if pairs.count() > LOCAL_PAIRS:
            raise TooLarge(f"more than {LOCAL_PAIRS} pairs of items; this solver needs them in one memory")
        p = pairs.toArrow()
        i, j, total = (p[c].to_numpy() for c in ("i", "j", "w"))
        order = np.argsort(i.astype(np.int64) * n + j)
        i, j, total = i[order], j[order].astype(np.intp), total[order]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        lower, often = i[first], np.diff(np.append(first, len(i)))
        cells = _Batches(cells, cells.count() <= LOCAL_CELLS, _crowd_cells, 1 << 20)
        weight = cells.total(_crowd_weights, m, m)
        al, be = self.eta_prior_alpha, self.eta_prior_beta
        g, eta, last = np.ones(n), np.full(m, al / (al + be)), -np.inf
        sums = cells.total(_crowd_sums, (g, eta), m + n + 1)
        for _ in range(self.iterations):
            eta = (al - 1 + sums[:m]) / (al + be - 2 + weight)
            wins = self.lam + sums[m : m + n]
            # Simultaneous sweeps, with a mean-one scale for stability; the fixed point is that of one-by-one sweeps.
            for _ in range(2 * self.inner_sweeps):
                y = total / (np.repeat(g[lower], often) + g[j])
                below = np.bincount(j, y, n)
                below[lower] += np.add.reduceat(y, first)
                g = wins / (2 * self.lam / (g + 1) + below)
            # The sums of the next round are at the strengths that the likelihood is of.
            sums = cells.total(_crowd_sums, (g, eta), m + n + 1)
            ll = sums[-1] + self.lam * (np.log(g) - 2 * np.log1p(g)).sum()
            ll += ((al - 1) * np.log(eta) + (be - 1) * np.log(np.maximum(1 - eta, 1e-300))).sum()
            if abs(ll - last) <= self.tolerance * abs(ll):
                break
            last = ll
        if (weight * eta).sum() / weight.sum() < 0.5:
            g, eta = 1 / g, 1 - eta
        rows = pa.table({"side": ["item"] * n + ["annotator"] * m, "entity": pa.chunked_array([names, who]), "score": np.concatenate([np.log(g), eta])})
        return Model("crowd-bt", params_of(self), spark.createDataFrame(rows, "side string, entity string, score double"), {"loglik": float(ll)})

    @staticmethod
    def _cells(votes: DataFrame, who: pa.Array, names: pa.Array) -> DataFrame:
        """``a, b, k, w``: the numbers of winner, loser and annotator with summed weights, equal pairs in a row."""
        sent = votes.sparkSession.sparkContext.broadcast((who, names))

        def code(batches):
            held: list[pa.RecordBatch] = []
            for batch in itertools.chain(batches, [None]):
                held += [batch] if batch is not None else []
                # Each look-up hashes all names first, so it is one of many rows.
                if held and (batch is None or sum(map(len, held)) > len(sent.value[0]) + len(sent.value[1])):
                    x, held = pa.Table.from_batches(held).combine_chunks(), []
                    ids = [pc.index_in(x[c], value_set=sent.value[c != "annotator"].cast(x[c].type)) for c in ("winner", "loser", "annotator")]
                    yield from pa.table([*ids, x["weight"]], ["a", "b", "k", "w"]).to_batches()

        coded = votes.mapInArrow(code, "a int, b int, k int, w double").repartition("a", "b")
        return coded.groupBy("a", "b", "k").agg(F.sum("w").alias("w")).sortWithinPartitions("a", "b", "k")


@dataclass(frozen=True)
class BladeChest:
    """Intransitive strengths: vectors of blades and chests by sequential stochastic gradients, reshuffled every epoch.

    One sequence by nature, so its pairs come to one place, as distinct pairs with their weights; bounded.
    """

    dims: int = 8
    variant: str = "inner"
    lr: float = 0.05
    epochs: int = 50
    l2: float = 1e-4
    init_scale: float = 0.1
    seed: int = 2016
    limit: int = 1_000_000

    def fit(self, pairs: DataFrame) -> Model:
        if self.variant not in ("inner", "dist"):
            raise InvalidInput(f"variant {self.variant}")
        c = local_cells(pairs, self.limit)
        rng = np.random.Generator(np.random.Philox(self.seed))
        blade, chest = (rng.normal(0, self.init_scale, (c.size, self.dims)) for _ in "bc")
        gamma, mean = np.zeros(c.size), c.w.mean()
        for _ in range(self.epochs):
            for e in rng.permutation(len(c.a)):
                i, j, x = c.a[e], c.b[e], c.w[e] / mean
                if self.variant == "inner":
                    m = blade[i] @ chest[j] - blade[j] @ chest[i]
                    gbi, gcj, gbj, gci = chest[j], blade[i], -chest[i], -blade[j]
                else:
                    dj, di = chest[i] - blade[j], chest[j] - blade[i]
                    m = dj @ dj - di @ di
                    gbi, gcj, gbj, gci = 2 * di, -2 * di, -2 * dj, 2 * dj
                step = self.lr * x / (1 + np.exp(np.clip(m + gamma[i] - gamma[j], -700, 700)))
                gamma[i] += step
                gamma[j] -= step
                blade[i], chest[j] = blade[i] + step * gbi - self.lr * self.l2 * blade[i], chest[j] + step * gcj - self.lr * self.l2 * chest[j]
                blade[j], chest[i] = blade[j] + step * gbj - self.lr * self.l2 * blade[j], chest[i] + step * gci - self.lr * self.l2 * chest[i]
        rows = {"entity": c.names, "score": gamma, "blade": blade.tolist(), "chest": chest.tolist()}
        return Model("blade-chest", params_of(self), frame(pairs, rows, "entity string, score double, blade array<double>, chest array<double>"))

    @staticmethod
    def matchup(model: Model, asked: DataFrame) -> DataFrame:
        """``a, b, p``: the chance that a beats b, for the asked pairs."""
        from ranksmith.functions.math import dot, sigmoid

        t = model.table
        x = asked.join(t.select(F.col("entity").alias("a"), F.col("score").alias("ga"), F.col("blade").alias("ba"), F.col("chest").alias("ca")), "a")
        x = x.join(t.select(F.col("entity").alias("b"), F.col("score").alias("gb"), F.col("blade").alias("bb"), F.col("chest").alias("cb")), "b")
        if model.params["variant"] == "inner":
            m = dot(F.col("ba"), F.col("cb")) - dot(F.col("bb"), F.col("ca"))
        else:
            dist = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, y: s + y)
            m = dist("bb", "ca") - dist("ba", "cb")
        return x.select("a", "b", sigmoid(m + F.col("ga") - F.col("gb")).alias("p"))


@dataclass(frozen=True)
class NashAveraging:
    """Maximum-entropy equilibrium of the game of picking an entity, by annealed multiplicative weights."""

    iterations: int = 200_000
    tolerance: float = 1e-6
    learning_rate: float = 0.5
    anneal_every: int = 5000

    def fit(self, pairs: DataFrame) -> Model:
        if not 0 < self.learning_rate <= 1 or self.anneal_every < 1:
            raise InvalidInput("learning rate in (0, 1], anneal_every of 1 or more")
        c = local_cells(pairs)
        i, j, wi, wj = c.unordered()
        v = np.divide(wi - wj, wi + wj, out=np.zeros_like(wi), where=wi + wj > 0)
        if c.size <= 3000:
            dense = np.zeros((c.size, c.size))
            dense[i, j], dense[j, i] = v, -v
            mul = dense.dot
        else:
            mul = lambda x: np.bincount(i, v * x[j], c.size) - np.bincount(j, v * x[i], c.size)
        z, tau, k = np.zeros(c.size), 1.0, 1
        x = np_softmax(z)
        ax = mul(x)
        total = ax.copy()
        while k < self.iterations and total.max() / k >= self.tolerance:
            z = (1 - self.learning_rate) * z + self.learning_rate / tau * ax
            if k % self.anneal_every == 0:
                tau = max(tau / 2, 1e-300)
            x = np_softmax(z)
            ax = mul(x)
            total += ax
            k += 1
        table = frame(pairs, {"entity": c.names, "score": mul(x), "p": x}, "entity string, score double, p double")
        return Model("nash-averaging", params_of(self), table, {"gap": float(total.max() / k), "rounds": k})


def suffix_sums(ballots: DataFrame, strengths: DataFrame) -> DataFrame:
    """``ballot_id, p, entity, suffix``: the strength of each ballot's items from each place on, as one window per ballot."""
    x = ballots.select("ballot_id", F.posexplode("items").alias("p", "entity")).join(strengths.select("entity", "score"), "entity")
    w = Window.partitionBy("ballot_id").orderBy("p").rowsBetween(0, Window.unboundedFollowing)
    return x.withColumn("suffix", F.sum("score").over(w)).select("ballot_id", "p", "entity", "suffix")

