"""Readers of the text formats, and of saved datasets.

Line formats are parsed in the JVM. ``strict`` readers raise InvalidInput with the first broken lines; with ``strict=False``
those rows are dropped here and found by ``rejected``. Lines are numbered by the splits they are read in: lines are counted per split, and
what the splits before it hold is added, so a large file is read by many tasks. ``seq`` follows the files' paths and the lines in them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksmith.model import EmptyDataset, InvalidInput
from ranksmith.session import Scratch
from ranksmith.sources.games_lines import parse_lines

#: Words for an outcome.
YES, NO = ("1", "true", "win", "yes"), ("0", "false", "loss", "lose", "no")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, line_no, seq, line``: lines of text files with their 1-based number in the file and their 0-based one in all files.

    A file's splits are read in parallel; a split is one piece of one task, so its rows' running ids are in order. One pass counts the
    lines of each split, and only those counts are added up in order.
    """
    x = spark.read.option("lineSep", "\n").text(path)
    x = x.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"))
    splits = x.groupBy("file", "split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each split.
    splits = splits.withColumn("_file", before(Window.partitionBy("file").orderBy("split"))).withColumn("_all", before(Window.orderBy("file", "split")))
    here = F.col("_id") - F.col("_first")
    return x.join(splits, ["file", "split"]).select("file", "split", (F.col("_file") + here + 1).alias("line_no"), (F.col("_all") + here).alias("seq"), "line")


def numbered_blocks(lines: DataFrame, blank: Column) -> DataFrame:
    """The lines that aren't blank with ``block``, the 1-based number of their block in the file: blank lines part blocks, several of them once.

    Blocks are counted within the splits, and what the splits before hold is added; how a split begins is told by the last line before it.
    """
    split = ["file", "split"]
    order = Window.partitionBy("file").orderBy("split")
    x = lines.withColumn("_blank", blank)
    last = x.groupBy(*split).agg(F.max_by("_blank", "line_no").alias("_b")).select(*split, F.lag("_b", 1, True).over(order).alias("_before"))
    w = Window.partitionBy(*split).orderBy("line_no")
    x = x.join(last, split).withColumn("_start", ~F.col("_blank") & F.coalesce(F.lag("_blank").over(w), "_before"))
    x = x.withColumn("_run", F.sum(F.col("_start").cast("int")).over(w))
    x = Scratch(lines.sparkSession, "blocks").save(x.where("NOT _blank").drop("_blank", "_before"))
    sums = x.groupBy(*split).agg(F.sum(F.col("_start").cast("int")).alias("_n"))
    sums = sums.select(*split, F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return x.join(sums, split).withColumn("block", (F.col("_offset") + F.col("_run")).cast("int")).drop("_start", "_run", "_offset")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select("line", "seq").where(F.btrim("line", F.lit(" \t\r")) != "")


def _fields(line: str = "line") -> Column:
    return F.split(F.btrim(F.col(line), F.lit(" \t\r")), r"[ \t]+")


def _checked(df: DataFrame, ok: Column, out: list[Column], strict: bool) -> DataFrame:
    if strict:
        bad = df.where(~F.coalesce(ok, F.lit(False))).limit(3).collect()
        if bad:
            raise InvalidInput(f"broken lines: {[r.line for r in bad]}")
        if not df.limit(1).count():
            raise EmptyDataset("no line")
    return df.where(ok).select(*out)


def _num(c: Column) -> Column:
    return c.try_cast("double")


def read_games(spark: SparkSession, path: str, periods: bool = False, strict: bool = True) -> DataFrame:
    """``seq, period, side1, side2, margin, weight`` from tab-separated sides, threshold and count; with ``periods`` blank lines begin a new one."""
    x = parse_lines(numbered_lines(spark, path), "line")
    if strict and (bad := x.where("status = 'broken'").select("file", "line_no", "reason").limit(3).collect()):
        raise InvalidInput(f"broken lines: {[tuple(r) for r in bad]}")
    if periods:
        x = numbered_blocks(x.where("status <> 'broken'"), F.col("status") == "blank").withColumnRenamed("block", "period")
    else:
        x = x.where("status = 'game'").withColumn("period", F.lit(1))
    g = F.col("game")
    return x.select("file", (F.col("seq") + 1).alias("seq"), "period", g["side1"].alias("side1"), g["side2"].alias("side2"), g["threshold"].alias("margin"), g["count"].alias("weight"))


def read_graph(spark: SparkSession, path: str, swap: bool = False, strict: bool = True) -> DataFrame:
    """``seq, src, dst, weight``; ``swap`` turns match lines (winner, loser) into endorsements."""
    x = _lines(spark, path).withColumn("f", _fields())
    f, a, b = F.col("f"), *((1, 0) if swap else (0, 1))
    w = F.when(F.size("f") > 2, _num(F.get("f", F.lit(2)))).otherwise(1.0)
    return _checked(x, F.size("f").between(2, 3) & w.isNotNull(), [F.col("seq"), f[a].alias("src"), f[b].alias("dst"), w.alias("weight")], strict)


def read_rankings(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``ballot_id, items``, best first."""
    x = _lines(spark, path).withColumn("f", _fields())
    return _checked(x, (F.size("f") >= 2) & (F.size(F.array_distinct("f")) == F.size("f")), [F.col("seq").alias("ballot_id"), F.col("f").alias("items")], strict)


def read_annotated(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    x = _lines(spark, path).withColumn("f", _fields())
    w = F.when(F.size("f") > 3, _num(F.get("f", F.lit(3)))).otherwise(1.0)
    return _checked(x, F.size("f").between(3, 4) & w.isNotNull(), [F.col("seq"), *[F.col("f")[i].alias(k) for i, k in enumerate(("annotator", "winner", "loser"))], w.alias("weight")], strict)


def read_matchups(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``seq, teams``: teams by ``|``, best first, ties by ``=``; ranks as in competitions (1, 2, 2, 4)."""
    x = _lines(spark, path).withColumn("t", F.split("line", "[|=]")).withColumn("s", F.regexp_extract_all("line", F.lit("([|=])"), 1))
    players = lambda t: F.filter(F.split(t, r"[ \t\r]+"), lambda p: p != "")
    # A team's rank: one more than the teams before the last bar to its left.
    last = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0), lambda a, k: F.when((k > 0) & (F.get("s", k - 1) == "|"), k).otherwise(a))
    x = x.withColumn("teams", F.transform("t", lambda t, i: F.struct((last(i) + 1).alias("rank"), players(t).alias("players"))))
    everyone = F.flatten(F.transform("teams", lambda t: t["players"]))
    ok = (F.size("teams") >= 2) & F.forall("teams", lambda t: F.size(t["players"]) > 0) & (F.size(F.array_distinct(everyone)) == F.size(everyone))
    return _checked(x, ok, [F.col("seq"), F.col("teams")], strict)


def _named_numbers(spark: SparkSession, path: str, names: list[str], strict: bool, default: float | None = None, n_text: int = 1) -> DataFrame:
    x = _lines(spark, path).withColumn("f", _fields())
    text = [F.col("f")[i].alias(k) for i, k in enumerate(names[:n_text])]
    nums = [_num(F.get("f", F.lit(i))) for i in range(n_text, len(names))]
    if default is not None:
        nums[-1] = F.when(F.size("f") < len(names), default).otherwise(nums[-1])
    least = len(names) - (default is not None)
    ok = F.size("f").between(least, len(names))
    for c in nums:
        ok = ok & c.isNotNull()
    return _checked(x, ok, [F.col("seq"), *text, *[c.alias(k) for c, k in zip(nums, names[n_text:], strict=True)]], strict)


def read_rewards(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _named_numbers(spark, path, ["arm", "reward"], strict)


def read_seeds(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _named_numbers(spark, path, ["entity", "weight"], strict, 1.0).drop("seq")


def read_market(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _named_numbers(spark, path, ["outcome", "shares"], strict)


def read_kelly(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _named_numbers(spark, path, ["name", "p", "odds"], strict)


def read_clv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _named_numbers(spark, path, ["label", "taken", "closing"], strict)


def read_forecasts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``source, weight, outcome, prob``, weight 1."""
    x = _named_numbers(spark, path, ["source", "outcome", "prob"], strict, n_text=2)
    return x.select("source", F.lit(1.0).alias("weight"), "outcome", "prob")


def read_features(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``entity, x`` of one width."""
    return _vectors(_lines(spark, path).withColumn("f", _fields()), ["entity"], 1, strict).drop("seq")


def read_contextual(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``seq, arm, reward, x`` of one width."""
    x = _vectors(_lines(spark, path).withColumn("f", _fields()), ["arm"], 1, strict)
    return x.select("seq", "arm", F.col("x")[0].alias("reward"), F.expr("slice(x, 2, size(x) - 1)").alias("x"))


def _vectors(x: DataFrame, names: list[str], skip: int, strict: bool) -> DataFrame:
    x = x.withColumn("x", F.transform(F.slice("f", skip + 1, F.greatest(F.size("f") - skip, F.lit(0))), lambda v: v.try_cast("double")))
    width = x.agg(F.max(F.size("x"))).first()[0]
    ok = (F.size("x") == (width or 0)) & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return _checked(x, ok, [F.col("seq"), *[F.col("f")[i].alias(k) for i, k in enumerate(names)], F.col("x")], strict)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    x = numbered_lines(spark, path).withColumn("s", F.btrim("line", F.lit(" \t\r")))
    return numbered_blocks(x, F.col("s") == "").withColumn("f", F.split("s", r"[ \t]+"))


def read_trajectories(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``episode_id, step, state, reward``: blank lines end an episode, the last needs none."""
    x = _blocks(spark, path)
    reward = _num(F.get("f", F.lit(1)))
    ok = (F.size("f") == 2) & reward.isNotNull() & ~F.isnan(reward) & (F.abs(reward) < float("inf"))
    return _checked(x, ok, [F.concat_ws("#", "file", "block").alias("episode_id"), F.col("line_no").alias("step"), F.col("f")[0].alias("state"), reward.alias("reward")], strict)


def read_odds(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``event_id, outcome, odds``: blank lines part events."""
    x = _blocks(spark, path)
    o = _num(F.get("f", F.lit(1)))
    return _checked(x, (F.size("f") == 2) & (o > 1) & (o < float("inf")), [F.concat_ws("#", "file", "block").alias("event_id"), F.col("f")[0].alias("outcome"), o.alias("odds")], strict)


def read_calibration(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``p, outcome``."""
    x = _lines(spark, path).withColumn("f", _fields())
    p, word = _num(F.get("f", F.lit(0))), F.lower(F.get("f", F.lit(1)))
    return _checked(x, (F.size("f") == 2) & p.between(0, 1) & word.isin(*YES, *NO), [p.alias("p"), word.isin(*YES).alias("outcome")], strict)


SHAPES = ("pairwise", "rewards", "contextual", "graph", "rankings", "trajectories", "annotated", "matchups", "games")


def save_dataset(df: DataFrame, shape: str, path: str) -> None:
    """A dataset as JSON lines with its shape and schema beside it."""
    if shape not in SHAPES:
        raise InvalidInput(f"shape {shape}")
    df.write.mode("overwrite").json(f"{path}/rows", ignoreNullFields=False)
    df.sparkSession.createDataFrame([(json.dumps({"shape": shape, "schema": df.schema.jsonValue()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def load_dataset(spark: SparkSession, path: str, shape: str | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    head = json.loads(spark.read.text(f"{path}/header").first()[0])
    if shape is not None and head["shape"] != shape:
        raise InvalidInput(f"the dataset is of shape {head['shape']}, not {shape}")
    return spark.read.schema(StructType.fromJson(head["schema"])).json(f"{path}/rows")
