"""Streams: any online operator by micro-batches, folds with keyed state, and sessions as episodes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.model import Model
from ranksmith.operators.online import Fold


class StateTable:
    """A model's versions in a folder: batch n reads version n - 1 and writes version n, so a repeated batch changes nothing."""

    def __init__(self, op: Any, path: str):
        self.op, self.path = op, path.rstrip("/")

    def _versions(self, spark: SparkSession) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/header/_SUCCESS"))]
        return sorted(int(n) for n in done)

    def latest(self, spark: SparkSession, before: int | None = None) -> Model:
        known = [v for v in self._versions(spark) if before is None or v < before]
        return Model.load(spark, f"{self.path}/{known[-1]:012d}") if known else self.op.init(spark)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        after = self.op.update(self.latest(spark, batch_id), batch)
        after.save(f"{self.path}/{batch_id:012d}")
        for v in self._versions(spark):
            if v < batch_id - 1:  # the version before stays for a batch that is repeated
                p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v:012d}")
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stream_updates(stream: DataFrame, op: Any, state_path: str, checkpoint: str):
    """A query that keeps ``op``'s model up to date; read it with ``StateTable(op, state_path).latest(spark)``.

    Rows are applied in arrival order between batches and in order of seq within one: history is never replayed.
    """
    return stream.writeStream.foreachBatch(StateTable(op, state_path)).option("checkpointLocation", checkpoint)


def keyed_fold(stream: DataFrame, op: Fold) -> DataFrame:
    """``league, entity, state`` of the entities that a batch changed, by a fold with one state per league.

    The state of a league is a JSON text; within a batch rows go by seq. Use output mode ``update``.
    """
    rows = op.payload(stream).select("league", "seq", F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now: dict[str, list[float]] = json.loads(state.get[0]) if state.exists else {}
        pdf = pd.concat(list(batches)).sort_values(["seq", "payload"], kind="stable")
        was = {k: list(v) for k, v in now.items()}
        for p in pdf["payload"]:
            op.step(now, json.loads(p))
        state.update((json.dumps(now),))
        changed = {k: v for k, v in now.items() if was.get(k) != v}
        yield pd.DataFrame({"league": key[0], "entity": list(changed), "state": [[float(x) for x in v] for v in changed.values()]})

    return rows.groupBy("league").applyInPandasWithState(fold, "league string, entity string, state array<double>", "json string", "update", "NoTimeout")


def sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """``user, start, end, n``: sessions parted by a gap; on a stream a watermark of ``late`` closes them."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late is not None:
        x = x.withWatermark(ts, late)
    g = x.groupBy(F.session_window(ts, gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return g.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def session_episodes(events: DataFrame, user: str, ts: str, state: str, reward: str, gap_seconds: int = 1800) -> DataFrame:
    """``episode_id, step, state, reward``: a user's events with no gap above ``gap_seconds`` are an episode."""
    from pyspark.sql import Window

    w = Window.partitionBy(user).orderBy(ts, *[c for c in ("event_id",) if c in events.columns])
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = (t - F.lag(t).over(w) > gap_seconds * 1_000_000).cast("int")
    x = events.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_step", F.row_number().over(w))
    x = x.withColumn("_e", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(F.concat_ws("/", F.col(user).cast("string"), F.col("_e").cast("string")).alias("episode_id"), F.col("_step").alias("step"), F.col(state).alias("state"), F.col(reward).cast("double").alias("reward"))


def period_updates(games: DataFrame, ts: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Games with the start of their event-time window as ``period``, and a watermark; each batch of a fold by periods takes them as they close."""
    x = games.withWatermark(ts, late)
    return x.withColumn("period", F.unix_timestamp(F.window(ts, width)["start"]).cast("long"))
