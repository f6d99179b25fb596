"""Writers of result tables as text, in the columns each algorithm shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.model import Model


def lines(model: Model, mu_only: bool = False) -> DataFrame:
    """``value``: one line per entity, best first; sections and sides one after the other."""
    t, c = model.table, F.col
    num = lambda x: x.cast("string")
    four = lambda x: F.format_string("%.4f", x)
    plain = [num(c("score"))]
    shown: dict[str, tuple[list[Column], list[Column]]] = {
        "glicko2": ([four(c("rating"))] if mu_only else [four(c("rating")), four(c("rd")), four(c("rating") - 1.96 * c("rd")), four(c("rating") + 1.96 * c("rd"))], []),
        "weng-lin": ([num(c("mu")), num(c("sigma")), num(c("score"))] if "mu" in t.columns else plain, []),
        "es-rum": ([num(c("score")), num(c("sigma"))] if "sigma" in t.columns else plain, []),
        "bayes-bt": ([num(c(k)) for k in ("score", "lower", "upper") if k in t.columns], []),
        "offense-defense": ([num(c(k)) for k in ("offense", "defense", "score") if k in t.columns], []),
        "btm-mm": (plain, [c("section")] if "section" in t.columns else []),
        "plackett-luce": (plain, [c("section")] if "section" in t.columns else []),
        "birank": (plain, [F.desc("side")] if "side" in t.columns else []),
        "crowd-bt": (plain, [F.desc("side")] if "side" in t.columns else []),
        "value-compare": ([num(c(k)) for k in ("score", "lower", "upper", "n", "n_rep") if k in t.columns], []),
        "bootstrap": ([num(c(k)) for k in ("score", "lower", "upper", "rank", "rank_lower", "rank_upper", "coverage") if k in t.columns], []),
    }
    if model.algorithm == "whr":
        return t.orderBy("entity", "period").select(F.concat_ws(" ", F.concat("entity", F.lit(":")), num(c("period")), num(c("rating")), num(c("sd"))).alias("value"))
    if model.algorithm == "hits":
        return _hits(t)
    cols, first = shown.get(model.algorithm, (plain, []))
    kept = t.where(c("score").isNotNull()) if "score" in t.columns else t
    return kept.orderBy(*first, F.desc("score"), "entity").select(F.concat_ws(" ", F.concat("entity", F.lit(":")), *cols).alias("value"))


def _hits(t: DataFrame) -> DataFrame:
    two = t.select("entity", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("authority").alias("v")), F.struct(F.lit(1).alias("o"), F.col("hub").alias("v")))).alias("x"))
    return two.orderBy("x.o", F.desc("x.v"), "entity").select(F.concat_ws(" ", F.concat("entity", F.lit(":")), F.col("x.v").cast("string")).alias("value"))


def write_text(model: Model, path: str, mu_only: bool = False) -> None:
    """Sorted over all files: their names are in order."""
    lines(model, mu_only).write.mode("overwrite").text(path)


def write_jsonl(model: Model, path: str) -> None:
    model.table.write.mode("overwrite").json(path)


def implied_pair_lines(pairs: DataFrame) -> DataFrame:
    """``value``: tab-separated winner, loser, 1, weight."""
    return pairs.select(F.concat_ws("\t", "winner", "loser", F.lit("1"), F.col("weight").cast("string")).alias("value"))


def write_components_by(components: DataFrame, edges: DataFrame, path: str, folders: int = 100) -> None:
    """The edges with their ``component``, in ``folders`` directories by its number: for more components than there can be directories."""
    c = components.select(F.col("entity").alias("src"), F.col("component").cast("int").alias("component"))
    edges.join(c, "src").withColumn("folder", F.col("component") % folders).write.mode("overwrite").partitionBy("folder").parquet(path)
