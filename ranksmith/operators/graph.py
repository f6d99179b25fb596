"""Graph operators as joins and sums over edge tables: src, dst, weight.

Edges are aggregated once and written; each pass is one join with the node values and one sum with partial sums in the
tasks, so a hot node's incoming edges never meet in one place unsummed. Its outgoing edges are joined by ``lookup``,
which spreads hot keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.model import EmptyDataset, InvalidInput, Model, NumericError, params_of
from ranksmith.operators.pairs import finite
from ranksmith.session import Scratch, hot_keys, lookup


#: Node tables of at most this many rows (an id and a number, about 30 MB as a hash table) are broadcast in the passes.
BROADCAST_NODES = 500_000
#: Sources that a breadth-first search goes from at once.
SOURCES = 256


class Graph:
    """An edge table coded once: ``nodes`` (entity, id), ``edges`` (s, d, w, n: ids, summed weight, rows)."""

    def __init__(self, edges: DataFrame, label: str):
        self.disk = disk = Scratch(edges.sparkSession, label)
        w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        e = edges.select("src", "dst", w.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL").where(finite(F.col("w")))
        cells = disk.save(e.groupBy("src", "dst").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
        ends = cells.select(F.explode(F.array("src", "dst")).alias("entity")).groupBy("entity").agg(F.count("*").alias("k"))
        self.nodes = disk.save(ends.sort("entity").withColumn("id", F.monotonically_increasing_id()))
        self.n, self.m = self.nodes.count(), cells.count()
        if not self.n:
            raise EmptyDataset("no edge with two ends")
        hot = self.nodes.where(F.col("k") * 1000 >= max(2 * self.m, 1000)).select("entity")
        x = lookup(cells, "src", self.nodes, "entity", "id", "s", hot).select("s", "dst", "w", "n")
        self.edges = disk.save(lookup(x, "dst", self.nodes, "entity", "id", "d", hot).select("s", "d", "w", "n"))
        self.hot_s, self.hot_d = (disk.save(hot_keys(self.edges, c, self.m, "id")) for c in "sd")

    def start(self, value: float) -> DataFrame:
        return self.nodes.select("id", F.lit(float(value)).alias("x"))

    def out_sums(self, weighted: bool) -> DataFrame:
        return self.edges.groupBy(F.col("s").alias("id")).agg(F.sum("w" if weighted else F.lit(1.0)).alias("out"))

    def at(self, rows: DataFrame, key: str, values: DataFrame, values_key: str, value: str, alias: str, hot: DataFrame | None) -> DataFrame:
        """``lookup`` of one value per node: small node tables go to every task, larger ones are joined with hot keys spread."""
        if self.n <= BROADCAST_NODES:
            few = F.broadcast(values.select(F.col(values_key).alias("_vk"), F.col(value).alias(alias)))
            return rows.join(few, rows[key] == few["_vk"], "left").drop("_vk")
        return lookup(rows, key, values, values_key, value, alias, hot)

    def push(self, edges: DataFrame, x: DataFrame, back: bool = False) -> DataFrame:
        """``id, y``: for each node the sum over its incoming (``back``: outgoing) edges of ``f`` times the other end's x."""
        key, to, hot = ("d", "s", self.hot_d) if back else ("s", "d", self.hot_s)
        j = self.at(edges, key, x, "id", "x", "_x", hot)
        return j.groupBy(F.col(to).alias("id")).agg(F.sum(F.col("_x") * F.col("f")).alias("y"))

    def named(self, x: DataFrame, **cols) -> DataFrame:
        return self.nodes.join(x, "id").select("entity", *[c.alias(k) for k, c in cols.items()])

    def loop(self, x: DataFrame, step: Callable[[DataFrame], DataFrame], iterations: int, tolerance: float, check_every: int = 5) -> tuple[DataFrame, int]:
        """Repeats ``step`` on written tables; the change is looked at every few rounds, as that is a job."""
        for k in range(iterations):
            new = self.disk.save(step(x))
            if tolerance > 0 and (k + 1) % check_every == 0:
                moved = new.join(x.withColumnRenamed("x", "_was"), "id").agg(F.sum(F.abs(F.col("x") - F.col("_was")))).first()[0]
                if moved is not None and moved < tolerance:
                    return new, k + 1
            self.disk.drop(x)
            x = new
        return x, iterations


def _total(df: DataFrame, c) -> float:
    return float(df.agg(F.sum(c)).first()[0] or 0.0)


@dataclass(frozen=True)
class PageRank:
    """Fixed passes over deduplicated, unweighted edges. ``sink``: where a node without outgoing edges sends its weight:
    ``reverse`` (to its endorsers), ``all`` (evenly to the others), ``uniform`` (as the teleport) or ``none`` (it is lost)."""

    damping: float = 0.85
    iterations: int = 10
    sink: str = "reverse"

    def fit(self, edges: DataFrame, seeds: DataFrame | None = None) -> Model:
        if self.sink not in ("reverse", "all", "uniform", "none"):
            raise InvalidInput(f"sink {self.sink}")
        g = Graph(edges, "pagerank")
        e = g.edges.select("s", "d")
        out = g.disk.save(g.out_sums(False))
        sinks = g.disk.save(g.nodes.join(out, "id", "left_anti").select("id"))
        if self.sink == "reverse":
            back = e.join(sinks, e["d"] == sinks["id"], "left_semi").select(F.col("d").alias("s"), F.col("s").alias("d"))
            e = e.unionByName(back)
            out = g.disk.save(e.groupBy(F.col("s").alias("id")).agg(F.count("*").cast("double").alias("out")))
        coded = lookup(e, "s", out, "id", "out", "out", g.hot_s)
        coded = g.disk.save(coded.select("s", "d", (1 / F.col("out")).alias("f")))
        if seeds is None:
            tele = g.nodes.select("id", F.lit(1 / g.n).alias("t"))
        else:
            w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in seeds.columns else F.lit(1.0)
            s = seeds.groupBy(F.col(seeds.columns[0]).alias("entity")).agg(F.sum(w).alias("w"))
            if s.join(g.nodes, "entity", "left_anti").limit(1).count():
                raise InvalidInput("a seed that is no node")
            whole = _total(s, "w")
            tele = g.nodes.join(s, "entity", "left").select("id", (F.coalesce("w", F.lit(0.0)) / F.lit(whole)).alias("t"))
        tele = g.disk.save(tele)

        def step(x: DataFrame) -> DataFrame:
            y = tele.join(x, "id").join(g.push(coded, x), "id", "left")
            lost = _total(x.join(sinks, "id", "left_semi"), "x") if self.sink in ("all", "uniform") else 0.0
            got = F.coalesce("y", F.lit(0.0))
            if self.sink == "uniform":
                got = got + F.lit(lost) * F.col("t")
            elif self.sink == "all" and g.n > 1:
                marked = sinks.withColumn("is_sink", F.lit(True))
                y = y.join(marked, "id", "left")
                got = got + (F.lit(lost) - F.when(F.col("is_sink"), F.col("x")).otherwise(0.0)) / F.lit(g.n - 1)
            return y.select("id", (F.lit(1 - self.damping) * F.col("t") + F.lit(self.damping) * got).alias("x"))

        x, _ = g.loop(g.disk.save(tele.select("id", F.col("t").alias("x"))) if seeds is not None else g.start(1 / g.n), step, self.iterations, 0.0)
        return Model("page-rank", params_of(self), g.named(x, score=F.col("x")))


@dataclass(frozen=True)
class LeaderRank:
    """Random walk with a ground node linked both ways to everybody; its share is spread evenly at the end."""

    iterations: int = 1000
    tolerance: float = 1e-12
    check_every: int = 5

    def fit(self, edges: DataFrame) -> Model:
        g = Graph(edges, "leader-rank")
        out = g.nodes.join(g.out_sums(False), "id", "left").select("id", (F.coalesce("out", F.lit(0.0)) + 1).alias("out"))
        out = g.disk.save(out)
        coded = g.disk.save(lookup(g.edges, "s", out, "id", "out", "out", g.hot_s).select("s", "d", (1 / F.col("out")).alias("f")))
        ground = 0.0
        # Walkers start on the nodes, none on the ground. The ground's weight is one number.
        state = g.start(1.0)

        def step(x: DataFrame) -> DataFrame:
            nonlocal ground
            up = _total(x.join(out, "id"), F.col("x") / F.col("out"))
            new = g.nodes.select("id").join(g.push(coded, x), "id", "left").select("id", (F.coalesce("y", F.lit(0.0)) + F.lit(ground / g.n)).alias("x"))
            ground = up
            return new

        x, used = g.loop(state, step, self.iterations, self.tolerance * g.n, self.check_every)
        return Model("leader-rank", params_of(self), g.named(x, score=F.col("x") + F.lit(ground / g.n)), {"rounds": used})


@dataclass(frozen=True)
class Hits:
    """Authorities and hubs over deduplicated edges, each summing to 1; ``score`` is the authority."""

    iterations: int = 100
    tolerance: float = 1e-12
    check_every: int = 5

    def fit(self, edges: DataFrame) -> Model:
        g = Graph(edges, "hits")
        e = g.disk.save(g.edges.select("s", "d", F.lit(1.0).alias("f")))
        h, a = g.start(1 / g.n), None
        used = self.iterations
        for k in range(self.iterations):
            a_new = g.disk.save(self._unit(g, g.push(e, h)))
            h_new = g.disk.save(self._unit(g, g.push(e, a_new, back=True)))
            moved = None
            if self.tolerance > 0 and a is not None and (k + 1) % self.check_every == 0:
                moved = a_new.join(a.withColumnRenamed("x", "_was"), "id").agg(F.sum(F.abs(F.col("x") - F.col("_was")))).first()[0]
            g.disk.drop(h, a)
            h, a = h_new, a_new
            if moved is not None and moved < self.tolerance:
                used = k + 1
                break
        x = a.join(h.withColumnRenamed("x", "hub"), "id")
        return Model("hits", params_of(self), g.named(x, authority=F.col("x"), hub=F.col("hub"), score=F.col("x")), {"rounds": used})

    @staticmethod
    def _unit(g: Graph, y: DataFrame) -> DataFrame:
        y = g.disk.save(y)
        total = _total(y, "y")
        if not total > 0:
            raise NumericError("no weight is left")
        return g.nodes.select("id").join(y, "id", "left").select("id", (F.coalesce("y", F.lit(0.0)) / F.lit(total)).alias("x"))


@dataclass(frozen=True)
class Katz:
    """Weighted Katz centrality without the constant of one; parallel edges add up."""

    alpha: float = 0.1
    iterations: int = 100
    tolerance: float = 1e-12
    check_every: int = 5

    def fit(self, edges: DataFrame) -> Model:
        if self.alpha <= 0:
            raise InvalidInput("alpha must be positive")
        g = Graph(edges, "katz")
        e = g.disk.save(g.edges.select("s", "d", (F.col("w") * F.lit(self.alpha)).alias("f")))

        def step(x: DataFrame) -> DataFrame:
            new = g.disk.save(g.nodes.select("id").join(g.push(e, x), "id", "left").select("id", (1 + F.coalesce("y", F.lit(0.0))).alias("x")))
            size = _total(new, F.abs("x"))
            if not np.isfinite(size) or size > 1e12 * g.n:
                raise NumericError("the series diverges; a lower alpha converges")
            return new

        x, used = g.loop(g.start(1.0), step, self.iterations, self.tolerance, self.check_every)
        return Model("katz", params_of(self), g.named(x, score=F.col("x") - 1), {"rounds": used})


@dataclass(frozen=True)
class BiRank:
    """Scores of both sides of a bipartite graph under symmetric normalisation; a name on both sides is two entities.

    ``alpha`` and ``beta`` weigh the neighbours against a prior; without priors that changes nothing.
    """

    iterations: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    seed: int = 2019

    def fit(self, edges: DataFrame, src_prior: DataFrame | None = None, dst_prior: DataFrame | None = None) -> Model:
        g = Graph(edges, "birank")
        ws = g.edges.groupBy(F.col("s").alias("id")).agg(F.sum("w").alias("k"))
        wd = g.edges.groupBy(F.col("d").alias("id")).agg(F.sum("w").alias("k"))
        ws, wd = g.disk.save(ws), g.disk.save(wd)
        x = lookup(g.edges, "s", ws, "id", "k", "ks", g.hot_s)
        x = lookup(x, "d", wd, "id", "k", "kd", g.hot_d)
        e = g.disk.save(x.select("s", "d", (F.col("w") / F.sqrt(F.col("ks") * F.col("kd"))).alias("f")))
        # Starts depend on the seed and the name only.
        begin = lambda ids, side: g.nodes.join(ids, "id", "left_semi").select("id", ((F.xxhash64(F.lit(self.seed), F.lit(side), "entity").bitwiseAND((1 << 52) - 1) + 1) / F.lit(float(1 << 52))).alias("x"))
        p, u = g.disk.save(begin(wd, "dst")), g.disk.save(begin(ws, "src"))
        p0, u0 = (self._prior(g, q) for q in (dst_prior, src_prior))
        for _ in range(self.iterations):
            p = g.disk.save(self._mixed(g.push(e, u), p0, self.alpha))
            u = g.disk.save(self._mixed(g.push(e, p, back=True), u0, self.beta))
        rows = g.named(u, side=F.lit("src"), score=F.col("x")).unionByName(g.named(p, side=F.lit("dst"), score=F.col("x")))
        return Model("birank", params_of(self), rows.select("side", "entity", "score"))

    @staticmethod
    def _prior(g: Graph, q: DataFrame | None) -> DataFrame | None:
        return None if q is None else g.nodes.join(q.groupBy("entity").agg(F.sum("score").alias("q")), "entity").select("id", "q")

    @staticmethod
    def _mixed(y: DataFrame, prior: DataFrame | None, keep: float) -> DataFrame:
        if prior is None:
            return y.select("id", F.col("y").alias("x"))
        return y.join(prior, "id", "left").select("id", (F.lit(keep) * F.col("y") + F.lit(1 - keep) * F.coalesce("q", F.lit(0.0))).alias("x"))


@dataclass(frozen=True)
class Harmonic:
    """Summed inverse distances from all (or sampled) sources; by breadth with unit costs, else by shortest weighted paths.

    Up to ``max_edges`` edges, tasks share the edge arrays: with unit costs each goes from SOURCES sources at once, a bit for
    each, with weighted ones by Dijkstra from one after the other. Beyond that unit costs go frontier by frontier as
    joins of (source, node) with the edges; weighted ones are bounded.
    """

    direction: str = "in"
    cost: str = "unit"
    sample: int | None = None
    seed: int = 2008
    max_edges: int = 5_000_000

    def fit(self, edges: DataFrame) -> Model:
        if self.direction not in ("in", "out") or self.cost not in ("unit", "weight"):
            raise InvalidInput(f"direction {self.direction}, cost {self.cost}")
        g = Graph(edges, "harmonic")
        if self.cost == "weight" and g.edges.where("w <= 0").limit(1).count():
            raise InvalidInput("lengths must be positive")
        e = g.edges.where("s <> d").select("s", "d", "w") if self.direction == "in" else g.edges.where("s <> d").select(F.col("d").alias("s"), F.col("s").alias("d"), "w")
        sources = g.nodes.select(F.col("id").alias("source"))
        if self.sample is not None and self.sample < g.n:
            sources = sources.orderBy(F.xxhash64(F.lit(self.seed), "source")).limit(self.sample)
        scale = g.n / min(self.sample or g.n, g.n)
        e, sources = g.disk.save(e), g.disk.save(sources)
        if self.cost == "unit":
            reach = self._breadth(g, e, sources) if g.m <= self.max_edges else self._frontiers(g, e, sources)
        else:
            reach = self._dijkstra(g, e, sources)
        x = g.nodes.join(reach, "id", "left").select("entity", (F.coalesce("h", F.lit(0.0)) * F.lit(scale)).alias("score"))
        return Model("harmonic", params_of(self), x)

    def _breadth(self, g: Graph, e: DataFrame, sources: DataFrame) -> DataFrame:
        # As Arrow: rows of Python objects would take the driver ten times the memory.
        t = e.select("s", "d").toArrow()
        ids, at = np.unique(np.concatenate([t["s"].to_numpy(), t["d"].to_numpy()]), return_inverse=True)
        s, d = at[: len(t)], at[len(t) :]
        order = np.argsort(d, kind="stable")
        to, first = np.unique(d[order], return_index=True)
        sent = g.nodes.sparkSession.sparkContext.broadcast((ids, s[order].astype(np.int32), to, first))

        def run(batches):
            ids, src, to, first = sent.value
            total = np.zeros(len(ids))
            for pdf in batches:
                # Nodes without any edge to another node reach none.
                known = np.flatnonzero(np.isin(ids, pdf["source"].to_numpy()))
                for k in range(0, len(known), SOURCES):
                    block = known[k : k + SOURCES]
                    bit = np.arange(len(block))
                    front = np.zeros((len(ids), SOURCES // 64), dtype=np.uint64)
                    front[block, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
                    seen, depth = front.copy(), 0
                    while True:
                        depth += 1
                        new = np.bitwise_or.reduceat(front[src], first, axis=0) & ~seen[to]
                        if not new.any():
                            break
                        total[to] += np.bitwise_count(new).sum(axis=1) / depth
                        seen[to] |= new
                        front[:] = 0
                        front[to] = new
            yield pd.DataFrame({"id": ids, "h": total})

        return sources.repartition(sources.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "id long, h double").groupBy("id").agg(F.sum("h").alias("h"))

    def _frontiers(self, g: Graph, e: DataFrame, sources: DataFrame) -> DataFrame:
        front = seen = g.disk.save(sources.select("source", F.col("source").alias("id")))
        parts, depth = None, 0
        while front.limit(1).count():
            depth += 1
            step = front.join(e.select(F.col("s").alias("id"), "d"), "id").select("source", F.col("d").alias("id")).distinct()
            front = g.disk.save(step.join(seen, ["source", "id"], "left_anti"))
            seen = seen.unionByName(front)
            got = front.groupBy("id").agg((F.count("*") / F.lit(float(depth))).alias("h"))
            parts = got if parts is None else parts.unionByName(got)
        return parts.groupBy("id").agg(F.sum("h").alias("h"))

    def _dijkstra(self, g: Graph, e: DataFrame, sources: DataFrame) -> DataFrame:
        from ranksmith.operators.pairs import bounded

        t = bounded(e, self.max_edges, "edges")
        ids, at = np.unique(np.concatenate([t["s"], t["d"]]), return_inverse=True)
        s, d, w = at[: len(t)], at[len(t) :], t["w"].to_numpy()
        order = np.argsort(s, kind="stable")
        first = np.searchsorted(s[order], np.arange(len(ids) + 1))
        sent = g.nodes.sparkSession.sparkContext.broadcast((ids, first, d[order], w[order]))

        def run(batches):
            import heapq

            ids, first, to, length = sent.value
            total = np.zeros(len(ids))
            for pdf in batches:
                for source in pdf["source"]:
                    k = int(np.searchsorted(ids, source))
                    if k == len(ids) or ids[k] != source:
                        continue
                    best, heap = {k: 0.0}, [(0.0, k)]
                    while heap:
                        far, v = heapq.heappop(heap)
                        if far > best[v]:
                            continue
                        for x in range(first[v], first[v + 1]):
                            n = far + length[x]
                            if n < best.get(int(to[x]), np.inf):
                                best[int(to[x])] = n
                                heapq.heappush(heap, (n, int(to[x])))
                    for v, far in best.items():
                        if v != k:
                            total[v] += 1 / far
            yield pd.DataFrame({"id": ids, "h": total})

        return sources.repartition(sources.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "id long, h double").groupBy("id").agg(F.sum("h").alias("h"))


@dataclass(frozen=True)
class KCore:
    """Coreness of each node in the undirected simple graph, by repeated h-indices of the neighbours' values."""

    rounds: int = 10_000

    def fit(self, edges: DataFrame) -> Model:
        g = Graph(edges, "k-core")
        e = g.edges.where("s <> d").select(F.explode(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))).alias("e")).select("e.*").distinct()
        e = g.disk.save(e)
        core = g.disk.save(e.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("c")))
        hot = g.disk.save(hot_keys(e, "s", max(e.count(), 1), "id"))
        for _ in range(self.rounds):
            # The largest h with h neighbours of value h or more: values are counted first, so a hub is a short histogram.
            seen = g.at(e, "s", core, "id", "c", "c", hot).groupBy("d", "c").agg(F.count("*").alias("k"))
            lists = seen.groupBy(F.col("d").alias("id")).agg(F.reverse(F.array_sort(F.collect_list(F.struct("c", "k")))).alias("l"))
            best = F.aggregate("l", F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("n")), lambda a, v: F.struct(F.greatest(a["h"], F.least(v["c"], a["n"] + v["k"])).alias("h"), (a["n"] + v["k"]).alias("n")))
            new = g.disk.save(core.join(lists.select("id", best["h"].alias("h")), "id").select("id", F.least("c", "h").alias("c"), (F.col("h") < F.col("c")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            g.disk.drop(core)
            core = new.select("id", "c")
            core._scratch_path = new._scratch_path
            if not moved:
                break
        x = g.nodes.join(core, "id", "left").select("entity", F.coalesce("c", F.lit(0)).cast("double").alias("score"))
        return Model("k-core", {}, x)


def _pointed(rows: DataFrame, n_rows: int, key: str, flat: DataFrame, n: int, alias: str) -> DataFrame:
    """``rows`` with what ``key`` points to in ``flat`` (v, p), or null: few pointers go to every task, many are joined with hot keys spread."""
    if n <= BROADCAST_NODES:
        return rows.join(F.broadcast(flat.select(F.col("v").alias("_v"), F.col("p").alias(alias))), rows[key] == F.col("_v"), "left").drop("_v")
    return lookup(rows, key, flat, "v", "p", alias, hot_keys(rows, key, n_rows, "v"))


def _flat_pointers(disk: Scratch, edges: DataFrame) -> tuple[DataFrame, int]:
    """``v, p``: every node with a smaller neighbour, and the node at the end of its chain of smallest neighbours."""
    start = disk.save(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
    flat, n = start, start.count()
    while True:
        # A pointer moves if where it points has itself a pointer; with none moved, all are flat. Few pointers jump thrice a job.
        x = flat.select("v", "p")
        for _ in range(3 if n <= BROADCAST_NODES else 1):
            x = _pointed(x, n, "p", flat, n, "q").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        step = disk.save(x)
        moved = step.where("moved").limit(1).count()
        disk.drop(flat)
        flat = step
        if not moved:
            return flat.select("v", "p"), n


def minimum_labels(disk: Scratch, edges: DataFrame) -> DataFrame | None:
    """``v, p``: each node that isn't the smallest of its component, and the smallest; None without an edge.

    ``edges`` (a < b, distinct, a written table) point from the larger to the smaller end. Minimum labels are propagated along them, pointers
    are jumped until they are flat, and the edges are contracted to the labels reached; every step is a table in the shared folder. It ends when no
    edge joins two labels any more, that is, when no label changes.
    """
    n_edges = edges.count()
    hooks: list[tuple[DataFrame, int]] = []
    while n_edges:
        flat, n = _flat_pointers(disk, edges)
        hooks.append((flat, n))
        x = _pointed(edges, n_edges, "a", flat, n, "pa").select(F.coalesce("pa", "a").alias("a"), "b")
        x = _pointed(x, n_edges, "b", flat, n, "pb").select("a", F.coalesce("pb", "b").alias("b")).where("a <> b")
        left = disk.save(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        disk.drop(edges)
        edges, n_edges = left, left.count()
    # A node is contracted away once, so the rounds' pointers are about different nodes; those
    # of earlier rounds lead to nodes that later rounds may have moved on.
    labels, known = None, 0
    for flat, n in reversed(hooks):
        if labels is None:
            labels, known = flat, n
            continue
        moved = _pointed(flat, n, "p", labels, known, "q").select("v", F.coalesce("q", "p").alias("p"))
        labels, known = disk.save(moved.unionByName(labels)), known + n
    return labels


def numbered_by_size(disk: Scratch, sizes: DataFrame) -> DataFrame:
    """``l, size, component``: the components' numbers in order of size and label, without one window over all."""
    # Components in order of size: a sorted table of them, numbered by place without one window over all.
    ordered = disk.save(sizes.orderBy(F.desc("size"), "l").withColumn("o", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("o", 33).alias("part")).agg(F.count("*").alias("k")).orderBy("part").collect()
    before, total = [], 0
    for r in parts:
        before.append((r.part, total))
        total += r.k
    offsets = disk.spark.createDataFrame(before or [(0, 0)], "part long, before long")
    return ordered.join(F.broadcast(offsets), F.shiftright("o", 33) == F.col("part")).select("l", "size", (F.col("before") + F.col("o").bitwiseAND((1 << 33) - 1)).alias("component"))


def extract_components(edges: DataFrame, min_size: int = 1) -> DataFrame:
    """``component, size, entity``: undirected components (of edges with a weight), largest first, then by their smallest name."""
    g = Graph(edges, "components")
    e = g.disk.save(g.edges.where("s <> d").select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct())
    found = minimum_labels(g.disk, e)
    label = g.nodes.select("id", F.col("id").alias("l"))
    if found is not None:
        label = g.disk.save(g.nodes.join(found, F.col("id") == F.col("v"), "left").select("id", F.coalesce("p", "id").alias("l")))
    sizes = g.disk.save(label.groupBy("l").agg(F.count("*").alias("size")).where(F.col("size") >= min_size))
    numbered = numbered_by_size(g.disk, sizes)
    out = lookup(label, "l", numbered.select(F.col("l").alias("k"), F.struct("component", "size").alias("v")), "k", "v", "v", hot_keys(label, "l", g.n, "k"))
    return out.where("v IS NOT NULL").join(g.nodes, "id").select("v.component", "v.size", "entity")


def write_components(components: DataFrame, edges: DataFrame, path: str) -> None:
    """One directory of edges for each component."""
    c = components.select(F.col("entity").alias("src"), "component")
    edges.join(c, "src").write.mode("overwrite").partitionBy("component").parquet(path)
