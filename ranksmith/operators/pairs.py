"""Lowerings, filters and the pair tables that most operators start from.

Shapes: pairs ``winner, loser, weight``; games ``side1, side2, margin, weight``; ballots ``ballot_id, items``;
edges ``src, dst, weight``; matches ``teams``. ``seq`` orders rows and ``period`` groups them where that matters.
Rows that no operator is defined for (null ends, self-pairs, weights that are no finite number) are left out by ``clean_pairs``.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.model import EmptyDataset, InvalidInput, TooLarge
from ranksmith.session import Scratch

#: Most rows of aggregated pairs that a solver takes into one memory (two numbers and a weight each).
LOCAL_PAIRS = 5_000_000


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """``df``, which fails while it is read if a row isn't ``ok``: no pass over the data of its own."""
    if isinstance(df, Cells):
        return df
    return df.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"InvalidInput: {message}")).cast("boolean")))


def single_players(games: DataFrame) -> DataFrame:
    return require(games, (F.size("side1") == 1) & (F.size("side2") == 1), "only games of one player a side")


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """Rows with both ends, unlike each other, and a finite weight (1 where there is no such column or no value)."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in pairs.columns else F.lit(1.0)
    rest = [c for c in pairs.columns if c not in ("winner", "loser", "weight")]
    x = pairs.select("winner", "loser", w.alias("weight"), *rest)
    return x.where(F.col("winner").isNotNull() & F.col("loser").isNotNull() & (F.col("winner") != F.col("loser")) & finite(F.col("weight")))


# -- lowerings ---------------------------------------------------------------------------------------------------------


def to_pairwise(games: DataFrame, ties: str = "error") -> DataFrame:
    """1v1 games as won pairs, weight = count; ties: ``error``, ``discard`` or ``half_win`` (both win half the weight)."""
    _choice("ties", ties, ("error", "discard", "half_win"))
    games = single_players(games)
    if ties == "error":
        games = require(games, F.col("margin") != 0, "a tied game; choose discard or half_win")
    a, b = F.col("side1")[0], F.col("side2")[0]
    row = lambda w, l, x: F.struct(w.alias("winner"), l.alias("loser"), x.alias("weight"))
    tied = F.array(row(a, b, F.col("weight") / 2), row(b, a, F.col("weight") / 2)) if ties == "half_win" else F.array().cast("array<struct<winner:string,loser:string,weight:double>>")
    won = F.when(F.col("margin") > 0, F.array(row(a, b, F.col("weight").cast("double")))).when(F.col("margin") < 0, F.array(row(b, a, F.col("weight").cast("double"))))
    rest = [c for c in ("seq", "period") if c in games.columns]
    return games.select(*rest, F.explode(F.coalesce(won, tied)).alias("p")).select(*rest, "p.*")


def margin_pairs(games: DataFrame, ties: str = "error", replicate: bool = True) -> DataFrame:
    """1v1 games with the margin as weight, a row for each counted game; ties: ``error``, ``discard`` or ``zero``.

    Without ``replicate`` one row with ``count`` stays; sums over the rows are the same.
    """
    _choice("ties", ties, ("error", "discard", "zero"))
    games = require(single_players(games), F.col("weight") == F.floor("weight"), "counts must be whole")
    if ties == "error":
        games = require(games, F.col("margin") != 0, "a tied game; choose discard or zero")
    x = games.where("margin <> 0") if ties == "discard" else games
    first = F.col("margin") >= 0
    rest = [c for c in ("seq", "period") if c in games.columns]
    a, b = F.col("side1")[0], F.col("side2")[0]
    x = x.select(*rest, F.when(first, a).otherwise(b).alias("winner"), F.when(first, b).otherwise(a).alias("loser"), F.abs("margin").alias("weight"), F.col("weight").cast("long").alias("count"))
    return x.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("_i", "count") if replicate else x


def to_matchups(games: DataFrame) -> DataFrame:
    """Games as matches of two ranked teams, a row for each counted game."""
    rank = lambda lost: F.when(lost, 2).otherwise(1).cast("int")
    teams = F.array(
        F.struct(rank(F.col("margin") < 0).alias("rank"), F.col("side1").alias("players")),
        F.struct(rank(F.col("margin") > 0).alias("rank"), F.col("side2").alias("players")),
    )
    rest = [c for c in ("seq", "period") if c in games.columns]
    return games.select(*rest, teams.alias("teams"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("weight").cast("long"))).alias("_i")).drop("_i")


def from_pairwise(pairs: DataFrame) -> DataFrame:
    """Pairs as games that side 1 won by a margin of 1."""
    rest = [c for c in ("seq", "period") if c in pairs.columns]
    return pairs.select(*rest, F.array("winner").alias("side1"), F.array("loser").alias("side2"), F.lit(1.0).alias("margin"), F.col("weight").cast("double").alias("weight"))


def as_graph(pairs: DataFrame) -> DataFrame:
    """Each loser endorses its winner."""
    return pairs.select(F.col("loser").alias("src"), F.col("winner").alias("dst"), "weight")


def ballots_to_pairwise(ballots: DataFrame) -> DataFrame:
    """Every ordered pair within a ballot, weight 1: a ballot's own items only, never a join."""
    x = ballots.where(F.size("items") >= 2).select(F.posexplode("items").alias("p", "winner"), "items")
    after = F.expr("slice(items, p + 2, greatest(size(items) - p - 1, 0))")
    return x.select("winner", F.explode(after).alias("loser"), F.lit(1.0).alias("weight"))


def period_index(df: DataFrame, bucket: Column) -> DataFrame:
    """Adds ``period``, the dense 1-based number of a row's bucket among those that occur."""
    named = df.withColumn("_bucket", bucket)
    known = named.select("_bucket").distinct()
    # As many rows as there are periods.
    numbered = known.withColumn("period", F.row_number().over(Window.orderBy("_bucket")).cast("int"))
    return named.join(F.broadcast(numbered), "_bucket").drop("_bucket")


# -- aggregates --------------------------------------------------------------------------------------------------------


def both_roles(pairs: DataFrame, win: dict[str, Column], lose: dict[str, Column]) -> DataFrame:
    """A row for each end of a pair: ``entity`` and the named columns."""
    a = F.struct(F.col("winner").alias("entity"), *[c.alias(k) for k, c in win.items()])
    b = F.struct(F.col("loser").alias("entity"), *[c.alias(k) for k, c in lose.items()])
    return pairs.select(F.explode(F.array(a, b)).alias("r")).select("r.*")


def tally(pairs: DataFrame) -> DataFrame:
    """``entity, n_won, w_won, n_lost, w_lost``."""
    one, none, w = F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("weight").cast("double")
    x = both_roles(pairs, {"n_won": one, "w_won": w, "n_lost": none, "w_lost": F.lit(0.0)}, {"n_won": none, "w_won": F.lit(0.0), "n_lost": one, "w_lost": w})
    return x.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("n_won", "w_won", "n_lost", "w_lost")])


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """``winner, loser, w, n``: summed weight and rows of each ordered pair."""
    return pairs.groupBy("winner", "loser").agg(F.sum(F.col("weight").cast("double")).alias("w"), F.count("*").alias("n"))


def pair_table(pairs: DataFrame) -> DataFrame:
    """``i, j, w_ij, w_ji, n_ij, n_ji`` for each unordered pair, i < j: one shuffle, sums within tasks first."""
    first = F.col("winner") < F.col("loser")
    w = F.col("weight").cast("double")
    return pairs.groupBy(F.least("winner", "loser").alias("i"), F.greatest("winner", "loser").alias("j")).agg(
        F.sum(F.when(first, w).otherwise(0.0)).alias("w_ij"),
        F.sum(F.when(first, 0.0).otherwise(w)).alias("w_ji"),
        F.sum(first.cast("long")).alias("n_ij"),
        F.sum((~first).cast("long")).alias("n_ji"),
    )


def out_adjacency(edges: DataFrame) -> DataFrame:
    """``node, neighbours``: targets and weights of each source, sorted."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("node"), "weight"))).alias("neighbours"))


def undirected_adjacency(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return out_adjacency(edges.select("src", "dst", "weight").unionByName(back))


def filter_min_count(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs whose ends both stand in at least ``k`` surviving rows, by repeated removal until nothing changes."""
    if k <= 1:
        return pairs
    disk = Scratch(pairs.sparkSession, "min-count")
    # Row numbers of aggregated pairs decide; the rows themselves are filtered once at the end.
    cells = disk.save(pairs.groupBy("winner", "loser").agg(F.count("*").alias("n")))
    size = cells.count()
    while size:
        n, none = F.col("n"), F.col("n")
        deg = both_roles(cells, {"n": n}, {"n": none}).groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("entity")
        left = cells.join(deg.withColumnRenamed("entity", "winner"), "winner", "left_semi").join(deg.withColumnRenamed("entity", "loser"), "loser", "left_semi")
        kept = disk.save(left)
        was, size = size, kept.count()
        disk.drop(cells)
        cells = kept
        if size == was:
            break
    return pairs.join(cells.select("winner", "loser"), ["winner", "loser"], "left_semi").select(*pairs.columns)


def filter_min_count_games(games: DataFrame, k: int) -> DataFrame:
    """Games whose players all stand in at least ``k`` surviving games."""
    if k <= 1:
        return games
    disk = Scratch(games.sparkSession, "min-count")
    x = disk.save(games.withColumn("_row", F.monotonically_increasing_id()))
    size = x.count()
    while size:
        seats = x.select("_row", F.explode(F.concat("side1", "side2")).alias("p"))
        rare = seats.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") < k).select("p")
        gone = seats.join(rare, "p", "left_semi").select("_row").distinct()
        kept = disk.save(x.join(gone, "_row", "left_anti"))
        was, size = size, kept.count()
        disk.drop(x)
        x = kept
        if size == was:
            break
    return x.select(*games.columns)


# -- sufficient statistics in one memory -------------------------------------------------------------------------------


@dataclasses.dataclass
class Cells:
    """Ordered pairs as arrays: ``a`` beat ``b`` with weight ``w`` in ``n`` rows; ``names`` are sorted by bytes."""

    names: list[str]
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    n: np.ndarray

    @property
    def size(self) -> int:
        return len(self.names)

    def add(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(at, x, self.size)

    def unordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``i < j, w_ij, w_ji``."""
        lo, hi = np.minimum(self.a, self.b), np.maximum(self.a, self.b)
        key, at = np.unique(lo.astype(np.int64) * max(self.size, 1) + hi, return_inverse=True)
        up = self.a < self.b
        return key // max(self.size, 1), key % max(self.size, 1), np.bincount(at, self.w * up, len(key)), np.bincount(at, self.w * ~up, len(key))


def bounded(df: DataFrame, limit: int, what: str) -> pd.DataFrame:
    """The rows of an aggregate as pandas, at most ``limit`` of them."""
    rows = df.limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} {what}; this solver needs them in one memory")
    return rows


def cells_of(p: pd.DataFrame) -> Cells:
    names, at = np.unique(np.concatenate([p["winner"].to_numpy(object), p["loser"].to_numpy(object)]).astype(object), return_inverse=True) if len(p) else (np.array([], object), np.array([], int))
    m = len(p)
    return Cells([str(x) for x in names], at[:m], at[m:], p["w"].to_numpy(float), p["n"].to_numpy(float))


def local_cells(pairs: DataFrame, limit: int | None = None) -> Cells:
    """The aggregated pairs; rows themselves never leave the executors. ``Cells`` are taken as they are."""
    if isinstance(pairs, Cells):
        return pairs
    c = cells_of(bounded(ordered_pairs(clean_pairs(pairs)), LOCAL_PAIRS if limit is None else limit, "ordered pairs"))
    if not c.size:
        raise EmptyDataset("no pair with two ends")
    return c


def _choice(name: str, value: str, of: tuple[str, ...]) -> None:
    if value not in of:
        raise InvalidInput(f"{name} must be one of {', '.join(of)}, got {value}")
