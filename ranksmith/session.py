"""Session helpers: tables, and intermediate results in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none (tests, a laptop), a temporary folder is set once;
    a cluster must name its own, as a machine-local folder is not seen by other machines.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="ranksmith-")
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(_remove_local, own[len("file://") :])
    return own


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table."""
        return self.load(self.write(df), df)

    def write(self, df: DataFrame) -> str:
        self._n += 1
        path = f"{self.base}/{self._n:04d}"
        df.write.parquet(path)
        return path

    def load(self, path: str, like: DataFrame) -> DataFrame:
        df = self.spark.read.schema(like.schema).parquet(path)
        df._scratch_path = path  # type: ignore[attr-defined]
        return df

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def close(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the cluster's own cleaner has the rest
            pass


#: A key is hot from one part in HOT_PARTS of all rows on, so there are never more hot keys than this.
HOT_PARTS = 1000
SPREAD = 1 << 12


def lookup(big: DataFrame, key: str, values: DataFrame, values_key: str, value: str, alias: str, hot: DataFrame | None) -> DataFrame:
    """Left join of one value by key that no hot key can unbalance.

    ``values`` has one row per key. ``hot`` holds the hot keys in a column named ``values_key``,
    at most a few thousand by the share that defines them; only their values are broadcast. Rows
    with a hot key get a salt that matches nothing in the shuffled join, so they are spread over
    all tasks there; rows with a null key get no value and are spread as well.
    """
    own = values.select(F.col(values_key).alias("_vk"), F.col(value).alias("_vv"))
    if hot is None:
        out = big.join(own, big[key] == F.col("_vk"), "left").withColumn(alias, F.col("_vv"))
        return out.drop("_vk", "_vv")
    few = own.join(F.broadcast(hot.select(F.col(values_key).alias("_hk0"))), F.col("_vk") == F.col("_hk0"), "left_semi")
    few = few.select(F.col("_vk").alias("_hk"), F.col("_vv").alias("_hv"))
    x = big.join(F.broadcast(few), big[key] == F.col("_hk"), "left")
    elsewhere = F.col("_hk").isNotNull() | F.col(key).isNull()
    salt = F.when(elsewhere, 1 + F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    x = x.withColumn("_salt", salt)
    own = own.withColumn("_vs", F.lit(0).cast("long"))
    x = x.join(own, (x[key] == own["_vk"]) & (x["_salt"] == own["_vs"]), "left")
    return x.withColumn(alias, F.coalesce("_hv", "_vv")).drop("_hk", "_hv", "_salt", "_vk", "_vv", "_vs")


def hot_keys(df: DataFrame, key: str, total: int, alias: str) -> DataFrame:
    """Keys with at least one part in HOT_PARTS of ``total`` rows: never more than HOT_PARTS of them."""
    counted = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(alias)).agg(F.count("*").alias("_n"))
    return counted.where(F.col("_n") * HOT_PARTS >= max(total, HOT_PARTS)).select(alias)


def repo_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
