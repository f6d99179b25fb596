"""Rankers whose pair tables exceed one memory: the same iterations as joins and sums over written tables.

Pairs are coded once as arcs in both directions. A pass joins the arcs with the values of both ends and sums by node, with partial sums in
the tasks; a step is one written table of nodes. Only sums over all nodes come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.model import EmptyDataset, Model, NumericError, params_of
from ranksmith.operators.graph import BROADCAST_NODES, minimum_labels, numbered_by_size
from ranksmith.operators.pairs import clean_pairs, pair_table
from ranksmith.session import Scratch, hot_keys, lookup

#: Earlier rounds that an accelerated iteration looks back to.
MEMORY = 8


def _ends() -> tuple[Column, Column, Column, Column]:
    """Weights of a over b and of b over a, and both ends' x."""
    return F.col("ab"), F.col("ba"), F.col("p.x"), F.col("q.x")


class Arcs:
    """``nodes`` (id, entity; ids in order of the names), ``arcs`` (a, b, ab, ba, nab, nba): weight and rows of a over b and b over a."""

    def __init__(self, pairs: DataFrame, label: str):
        self.disk = disk = Scratch(pairs.sparkSession, label)
        cells = disk.save(pair_table(clean_pairs(pairs)))
        ends = cells.select(F.explode(F.array("i", "j")).alias("entity")).groupBy("entity").agg(F.count("*").alias("k"))
        self.nodes = disk.save(ends.sort("entity").withColumn("id", F.monotonically_increasing_id()))
        self.n = self.nodes.count()
        if not self.n:
            raise EmptyDataset("no pair with two ends")
        m = 2 * cells.count()
        hot = self.nodes.where(F.col("k") * 1000 >= max(m, 1000)).select("entity")
        x = lookup(cells, "i", self.nodes, "entity", "id", "a", hot)
        x = lookup(x, "j", self.nodes, "entity", "id", "b", hot)
        one, two = ("a", "b", "w_ij", "w_ji", "n_ij", "n_ji"), ("b", "a", "w_ji", "w_ij", "n_ji", "n_ij")
        names = ("a", "b", "ab", "ba", "nab", "nba")
        both = F.array(*[F.struct(*[F.col(c).alias(k) for c, k in zip(cols, names, strict=True)]) for cols in (one, two)])
        self.use(disk.save(x.select(F.explode(both).alias("r")).select("r.*")))

    def use(self, arcs: DataFrame) -> None:
        self.arcs = arcs
        self.few = self.n <= BROADCAST_NODES
        # Every pair stands in both directions, so the nodes hot at one end are those at the other.
        self.hot = None if self.few else self.disk.save(hot_keys(arcs, "a", arcs.count(), "id"))

    def _at(self, rows: DataFrame, key: str, packed: DataFrame, alias: str) -> DataFrame:
        if self.few:
            return rows.join(F.broadcast(packed.select(F.col("id").alias("_i"), F.col("v").alias(alias))), rows[key] == F.col("_i")).drop("_i")
        return lookup(rows, key, packed, "id", "v", alias, self.hot)

    def sums(self, state: DataFrame | None = None, need: tuple[str, ...] = ("x",), **out: Column) -> DataFrame:
        """``id`` and sums over its arcs of expressions in the arc's columns, ``p`` (a's values of the state) and ``q`` (b's)."""
        x = self.arcs
        if state is not None:
            packed = state.select("id", F.struct(*need).alias("v"))
            x = self._at(self._at(x, "a", packed, "p"), "b", packed, "q")
        return x.groupBy(F.col("a").alias("id")).agg(*[F.sum(c).alias(k) for k, c in out.items()])

    def start(self, **values: Any) -> DataFrame:
        return self.nodes.select("id", *[(v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in values.items()])

    def iterate(self, state: DataFrame, step: Callable[[DataFrame], DataFrame], iterations: int, tolerance: float, unit: bool = False) -> tuple[DataFrame, int]:
        """Repeats ``step``, which adds ``y`` to the state's columns, the next x; with ``unit`` the sum of x is 1."""
        for k in range(iterations):
            new = self.disk.save(step(state))
            total = F.lit(float(new.agg(F.sum("y")).first()[0])) if unit else F.lit(1.0)
            moved = new.agg(F.sum(F.abs(F.col("y") / total - F.col("x")))).first()[0]
            if moved is None or not np.isfinite(moved):
                raise NumericError("the iteration collapsed; is the schedule connected?")
            self.disk.drop(state)
            state = new.withColumn("x", F.col("y") / total).drop("y")
            state._scratch_path = new._scratch_path  # type: ignore[attr-defined]
            if moved < tolerance:
                return state, k + 1
        return state, iterations

    def model(self, algorithm: str, op: Any, state: DataFrame, *cols: Column, **info: Any) -> Model:
        return Model(algorithm, params_of(op), self.nodes.join(state, "id").select("entity", *cols), info)


def _scored(x: str | Column = "x") -> Column:
    return (F.col(x) if isinstance(x, str) else x).alias("score")


def _balance(g: Arcs, s: DataFrame, y: Column, **sums: Column) -> DataFrame:
    return s.join(g.sums(s, tuple(c for c in s.columns if c != "id"), **sums), "id").select(*s.columns, y.alias("y"))


# -- chains ------------------------------------------------------------------------------------------------------------


def lsr(g: Arcs, op: Any, steps: int, eps: float) -> Model:
    ab, ba, p, q = _ends()
    deg = g.sums(half=ba / 2)
    s = g.disk.save(g.start(x=1 / g.n).join(deg, "id"))
    inn = F.when(F.col("q.half") > 0, q * ab / 2 / F.col("q.half")).otherwise(0.0)
    s, _ = g.iterate(s, lambda s: _balance(g, s, F.col("inn") + eps, inn=inn), steps, 0, True)
    log = F.log(F.greatest("x", F.lit(1e-300)) / F.sqrt(F.greatest("half", F.lit(eps))))
    return g.model("lsr", op, s, _scored(log - F.lit(s.agg(F.avg(log)).first()[0])))


def rank_centrality(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    d_max = g.arcs.groupBy("a").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
    part = lambda w: F.when(ab + ba > 0, w / (ab + ba)).otherwise(0.0) / d_max
    s, used = g.iterate(g.start(x=1 / g.n), lambda s: _balance(g, s, F.col("x") * (1 - F.col("out")) + F.col("inn"), inn=q * part(ab), out=part(ba)), op.iterations, op.tolerance)
    return g.model("rank-centrality", op, s, _scored(), rounds=used)


def random_walker(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    s = g.disk.save(g.start(x=1 / g.n).join(g.sums(g=ab + ba), "id"))
    inn, out = q * (op.p * ab + (1 - op.p) * ba) / F.col("q.g"), (op.p * ba + (1 - op.p) * ab) / F.col("p.g")
    s, used = g.iterate(s, lambda s: _balance(g, s, F.col("x") * (1 - F.col("out")) + F.col("inn"), inn=inn, out=out), op.iterations, op.tolerance)
    return g.model("random-walker", op, s, _scored(), rounds=used)


def keener(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    f = (ab + 1) / (ab + ba + 2)
    if op.skew:
        f = 0.5 + 0.5 * F.signum(f - 0.5) * F.sqrt(F.abs(2 * f - 1))
    games = F.greatest("games", F.lit(1)) if op.normalize_games else F.lit(1.0)
    s, used = g.iterate(g.start(x=1 / g.n), lambda s: _balance(g, s, F.col("inn") / games, inn=f * q, games=F.col("nab") + F.col("nba")), op.iterations, op.tolerance, True)
    return g.model("keener", op, s, _scored(), rounds=used)


def mc4(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    n = float(g.n)
    y = op.damping * (F.col("x") * (1 - F.col("out")) + F.col("inn")) + (1 - op.damping) / n
    s, used = g.iterate(g.start(x=1 / n), lambda s: _balance(g, s, y, inn=F.when(ab > ba, q / n).otherwise(0.0), out=F.when(ba > ab, 1 / n).otherwise(0.0)), op.iterations, op.tolerance)
    return g.model("mc4", op, s, _scored(), rounds=used)


def offense_defense(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    idle = g.sums(scored=F.col("ab"), against=F.col("ba")).where("scored <= 0 OR against <= 0").limit(5).count()
    if idle:
        raise NumericError("somebody never scored, or was never scored on")
    s = g.disk.save(g.start(x=1.0))
    for _ in range(op.iterations):
        o = g.disk.save(s.select("id", "x").join(g.sums(s, o=ab / q), "id"))
        new = g.disk.save(o.join(g.sums(o, ("o",), d=ba / F.col("q.o")), "id").select("id", "o", "x", "d"))
        moved = new.agg((F.sum(F.abs(F.col("d") - F.col("x"))) / F.sum(F.abs("x"))).alias("m")).first()[0]
        g.disk.drop(s, o)
        s = new.select("id", "o", F.col("d").alias("x"))
        s._scratch_path = new._scratch_path
        if moved < op.tolerance:
            break
    return g.model("offense-defense", op, s, F.col("o").alias("offense"), F.col("x").alias("defense"), _scored(F.col("o") / F.col("x")))


# -- least squares -------------------------------------------------------------------------------------------------------


def conjugate_gradient(g: Arcs, weight: Column, shift: float, b: DataFrame, iterations: int, tolerance: float, mean_zero: bool) -> DataFrame:
    """``id, x``: the solution of (shift + Laplacian of ``weight``) x = b (``id, b``); a step is one written table and two sums."""
    ab, ba, p, q = _ends()
    mean = b.agg(F.avg("b")).first()[0] if mean_zero else 0.0
    s = g.disk.save(b.select("id", F.lit(0.0).alias("s"), (F.col("b") - mean).alias("r"), (F.col("b") - mean).alias("x")))
    rr, bb = s.agg(F.sum(F.col("r") ** 2)).first()[0], b.agg(F.sum(F.col("b") ** 2)).first()[0]
    stop = tolerance * max(np.sqrt(bb), 1e-300)
    for _ in range(iterations):
        if np.sqrt(rr) <= stop:
            break
        ap = g.sums(s, l=weight * (p - q))
        new = g.disk.save(s.join(ap, "id").select("id", "s", "r", "x", (F.lit(shift) * F.col("x") + F.col("l")).alias("ap")))
        step = rr / new.agg(F.sum(F.col("x") * F.col("ap"))).first()[0]
        left = F.col("r") - step * F.col("ap")
        now = new.agg(F.sum(left**2)).first()[0]
        g.disk.drop(s)
        s = new.select("id", (F.col("s") + step * F.col("x")).alias("s"), left.alias("r"), (left + now / rr * F.col("x")).alias("x"))
        s._scratch_path = new._scratch_path
        rr = now
    off = s.agg(F.avg("s")).first()[0] if mean_zero else 0.0
    return s.select("id", (F.col("s") - off).alias("x"))


def massey(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    x = conjugate_gradient(g, F.col("nab") + F.col("nba"), 0.0, g.disk.save(g.sums(b=ab - ba)), op.iterations, op.tolerance, True)
    return g.model("massey", op, x, _scored())


def colley(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    b = g.disk.save(g.sums(d=ab - ba).select("id", (1 + F.col("d") / 2).alias("b")))
    return g.model("colley", op, conjugate_gradient(g, ab + ba, 2.0, b, op.iterations, op.tolerance, False), _scored())


def hodge_rank(g: Arcs, op: Any) -> Model:
    ab, ba, p, q = _ends()
    n = F.col("nab") + F.col("nba")
    y = {"log-odds": F.log((ab + 0.5) / (ba + 0.5)), "win-rate-delta": F.when(ab + ba > 0, (ab - ba) / (ab + ba)).otherwise(0.0), "mean-margin": (ab - ba) / n}[op.flow]
    w = n if op.flow == "mean-margin" else ab + ba
    x = g.disk.save(conjugate_gradient(g, w, 0.0, g.disk.save(g.sums(b=w * y)), op.iterations, op.tolerance, True))
    parts = g.sums(x, whole=w * y * y, rest=w * (y - (p - q)) ** 2).agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest")).first()
    return g.model("hodge-rank", op, x, _scored(), inconsistency=float(parts.rest / parts.whole) if parts.whole > 0 else 0.0)


def serial_rank(g: Arcs, op: Any) -> Model:
    """Power steps on the shifted similarity: its product with a vector is two passes over the signs of the pairs."""
    ab, ba, p, q = _ends()
    sign, n = F.signum(ab - ba), float(g.n)

    def similar(s: DataFrame) -> DataFrame:
        """The state with ``z``, the similarity's product with x."""
        total = s.agg(F.sum("x")).first()[0]
        c = g.disk.save(s.join(g.sums(s, c=sign * q), "id"))
        return c.join(g.sums(c, ("c",), cc=sign * F.col("q.c")), "id").withColumn("z", (F.lit(n * total) - F.col("cc")) / 2).drop("c", "cc")

    net = g.sums(net=ab - ba)
    degree = g.disk.save(similar(g.start(x=1.0)).select("id", F.col("z").alias("degree")))
    shift = 2 * max(degree.agg(F.max("degree")).first()[0], 1.0)
    start = F.xxhash64(F.lit(op.seed), "id").bitwiseAND((1 << 40) - 1) / F.lit(float(1 << 40)) - 0.5
    s = g.disk.save(g.start(x=start).join(degree, "id").join(net, "id"))

    def unit(s: DataFrame, y: str) -> DataFrame:
        m = s.agg(F.avg(y), F.stddev_pop(y)).first()
        return s.withColumn("u", (F.col(y) - m[0]) / max(m[1] * np.sqrt(n), 1e-300))

    s = unit(s, "x").withColumn("x", F.col("u")).drop("u")
    for _ in range(op.iterations):
        new = g.disk.save(similar(s).withColumn("y", (F.lit(shift) - F.col("degree")) * F.col("x") + F.col("z")).drop("z"))
        u = unit(new, "y")
        same = u.agg(F.sum(F.col("u") * F.col("x"))).first()[0]
        g.disk.drop(s)
        s = u.withColumn("x", F.col("u")).drop("u", "y")
        s._scratch_path = new._scratch_path
        if 1 - abs(same) < op.tolerance:
            break
    way = s.agg(F.sum(F.col("x") * F.col("net")), F.min_by("x", "id")).first()
    turn = -1.0 if way[0] < 0 or (way[0] == 0 and way[1] < 0) else 1.0
    return g.model("serial-rank", op, s, _scored(F.col("x") * turn + 0.0))


# -- maximum likelihood --------------------------------------------------------------------------------------------------


def luce_logs(g: Arcs, prior: float = 0.0, tolerance: float = 1e-9, rounds: int = 500) -> tuple[DataFrame, int]:
    """``id, x``: logarithms of the maximum-likelihood Luce strengths, up to a constant in each component.

    A round rebuilds the rates of the Luce chain, ``ab / (s_a + s_b)`` from b to a, and takes each node's next strength from the balance of what
    comes in and what goes out. Rounds are accelerated (Anderson): the next logarithms are the combination of the last MEMORY rounds' whose
    residuals are smallest in the sum of squares, so tens of rounds are enough, of one written table and one job of sums each. ``prior`` is the
    weight of a win and a loss of each node against one virtual node, whose strength is a number in the driver. Not
    converged after ``rounds`` rounds is an error.
    """
    ab, ba, p, q = _ends()
    s, v = g.disk.save(g.start(x=0.0).withColumn("past", F.array().cast("array<struct<f:double,g:double>>"))), 0.0
    fv: list[float] = []
    gv: list[float] = []
    sa, sb = F.exp("p.x"), F.exp("q.x")
    for k in range(rounds):
        own = F.lit(prior) / (F.exp("x") + F.lit(float(np.exp(v))))
        r = g.sums(s, inn=ab * sb / (sa + sb), out=ba / (sa + sb))
        to = F.log((F.col("inn") + own * F.lit(float(np.exp(v)))) / (F.col("out") + own))
        x = s.join(r, "id").select("id", "x", to.alias("g"), own.alias("own"), "past")
        new = g.disk.save(x.select("id", "own", F.concat(F.array(F.struct((F.col("g") - F.col("x")).alias("f"), "g")), F.slice("past", 1, MEMORY)).alias("past")))
        m = min(k, MEMORY)
        now = F.col("past")[0]
        df = [now["f"] - F.col("past")[i]["f"] for i in range(1, m + 1)]
        aggs = [F.max(F.abs(now["f"])).alias("far"), F.sum("own").alias("own"), F.sum(F.col("own") * F.exp(now["g"])).alias("flow")]
        aggs += [F.sum(df[i] * df[j]).alias(f"d{i}_{j}") for i in range(m) for j in range(i, m)] + [F.sum(df[i] * now["f"]).alias(f"e{i}") for i in range(m)]
        row = new.agg(*aggs).first()
        if row.far is None or not np.isfinite(row.far):
            raise NumericError("no finite strengths: somebody only won or only lost")
        to_v = float(np.log(row.flow / row.own)) if prior > 0 else 0.0
        fv, gv = [to_v - v, *fv][: MEMORY + 1], [to_v, *gv][: MEMORY + 1]
        c = np.zeros(m)
        if m:
            dv = np.array([fv[0] - fv[i] for i in range(1, m + 1)])
            a = np.array([[row[f"d{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)]) + np.outer(dv, dv)
            b = np.array([row[f"e{i}"] for i in range(m)]) + dv * fv[0]
            c = np.linalg.lstsq(a + 1e-12 * np.trace(a) * np.eye(m), b, rcond=None)[0]
        g.disk.drop(s)
        step = now["g"]
        for i in range(m):
            step = step - F.lit(float(c[i])) * (now["g"] - F.col("past")[i + 1]["g"])
        done = max(row.far, abs(fv[0])) < tolerance
        v = float(gv[0] - sum(c[i] * (gv[0] - gv[i + 1]) for i in range(m)))
        s = new.select("id", (now["g"] if done else step).alias("x"), "past")
        s._scratch_path = new._scratch_path
        if done:
            return s.select("id", "x"), k + 1
    raise NumericError(f"not converged after {rounds} rounds")


def ilsr(g: Arcs, op: Any) -> Model:
    for won, lost in (("nab", "nba"), ("nba", "nab")):
        # Who is linked to the first node by wins, and by losses: frontiers over the arcs.
        front = seen = g.disk.save(g.nodes.agg(F.min("id").alias("id")))
        while front.limit(1).count():
            near = g.arcs.where(F.col(lost) > 0).join(front.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            front = g.disk.save(near.join(seen, "id", "left_anti"))
            seen = g.disk.save(seen.unionByName(front))
        if seen.count() < g.n:
            raise NumericError("no finite strengths: not everybody is linked by wins both ways")
    x, used = luce_logs(g, tolerance=max(op.tolerance, 1e-12))
    return g.model("ilsr", op, x, _scored(F.col("x") - F.lit(x.agg(F.avg("x")).first()[0])), rounds=used)


def bradley_terry(g: Arcs, op: Any) -> Model:
    """``section, kind, entity, score`` as of the solver in one memory: undefeated and winless peeled, strengths by component."""
    apart: DataFrame | None = None
    while True:
        s = g.arcs.groupBy(F.col("a").alias("id")).agg(F.sum("nab").alias("won"), F.sum("nba").alias("lost"))
        kind = F.when(F.col("lost") == 0, F.lit("undefeated"))
        if op.remove_total_losers:
            kind = kind.when(F.col("won") == 0, F.lit("winless"))
        out = g.disk.save(s.withColumn("kind", kind).where("kind IS NOT NULL").select("id", "kind", F.when(F.col("kind") == "winless", -F.col("lost")).otherwise(F.col("won")).cast("double").alias("score")))
        if not out.limit(1).count():
            break
        apart = out if apart is None else apart.unionByName(out)
        gone = out.select("id")
        left = g.arcs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        g.use(g.disk.save(left.select("a", "b", "ab", "ba", "nab", "nba")))
    spark = g.nodes.sparkSession
    rows, sections, used = [], 0, 0
    alive = g.disk.save(g.arcs.select(F.col("a").alias("id")).distinct())
    if alive.limit(1).count():
        labels = minimum_labels(g.disk, g.disk.save(g.arcs.where("a < b").select("a", "b")))
        comp = g.disk.save(alive.join(labels, F.col("id") == F.col("v"), "left").select("id", F.coalesce("p", "id").alias("l")))
        sizes = g.disk.save(comp.groupBy("l").agg(F.count("*").alias("size")).where(F.col("size") >= op.min_graph_size))
        sections = sizes.count()
        every, g.nodes = g.nodes, g.nodes.join(alive, "id", "left_semi")
        x, used = luce_logs(g, tolerance=1e-10)
        g.nodes = every
        x = x.join(comp, "id")
        total = x.groupBy("l").agg(F.sum(F.exp("x")).alias("t"))
        ranked = x.join(total, "l").join(numbered_by_size(g.disk, sizes), "l")
        rows.append(ranked.select(F.col("component").cast("int").alias("section"), F.lit("ranked").alias("kind"), "id", (F.exp("x") / F.col("t")).alias("score")))
    if apart is not None:
        rows.append(apart.select(F.when(F.col("kind") == "undefeated", sections).otherwise(sections + 1).alias("section"), "kind", "id", "score"))
    said = rows[0]
    for more in rows[1:]:
        said = said.unionByName(more)
    taken = alive if apart is None else alive.unionByName(apart.select("id"))
    alone = g.nodes.join(taken, "id", "left_anti").select(F.lit(sections + 2).alias("section"), F.lit("isolated").alias("kind"), "id", F.lit(None).cast("double").alias("score"))
    table = said.unionByName(alone).join(g.nodes, "id").select("section", "kind", "entity", "score")
    return Model("btm-mm", params_of(op), table, {"sweeps": used})
