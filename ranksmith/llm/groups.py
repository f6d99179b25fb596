"""Groups of records from pairwise match results (connected components)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.operators.graph import minimum_labels
from ranksmith.session import HOT_PARTS, Scratch, hot_keys, lookup


def match_groups(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``group_name, record_name``: one row for every non-null name, the group being its smallest linked name.

    Minimum labels are propagated along links, pointers are jumped until they are flat, and the links
    are contracted to the labels reached; every step is a table in the shared folder. It ends when no
    link joins two labels any more, that is, when no label changes.

    A link with a null end links nothing, but its other end is a record; a link from a record to
    itself makes a record. Links in both directions and repeated ones count once. An empty table gives
    no rows. Names compare by byte order, exactly; the columns beside the two ends are not read.
    """
    spark = links.sparkSession
    disk = Scratch(spark, "match-groups")
    ends = links.select(F.col(src).alias("u"), F.col(dst).alias("v"))

    # Records in order of their names: ids keep that order, so the smallest id is the smallest name.
    names = ends.select(F.explode(F.array("u", "v")).alias("name")).where("name IS NOT NULL")
    names = names.groupBy("name").agg(F.count("*").alias("n")).sort("name")
    records = disk.save(names.select("name", F.monotonically_increasing_id().alias("id"), "n"))
    total = records.agg(F.sum("n")).first()[0] or 0
    hot = records.where(F.col("n") * HOT_PARTS >= max(total, HOT_PARTS)).select("name")

    # Names become numbers first, so that repeated links are found by two numbers.
    x = lookup(ends.where("u IS NOT NULL AND v IS NOT NULL AND u <> v"), "u", records, "name", "id", "a", hot).select("a", "v")
    x = lookup(x, "v", records, "name", "id", "b", hot)
    edges = disk.save(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = minimum_labels(disk, edges)
    if labels is None:
        return records.select(F.col("name").alias("group_name"), F.col("name").alias("record_name"))

    out = records.join(labels, records["id"] == labels["v"], "left").select("name", F.coalesce("p", "id").alias("g"))
    heads = records.select(F.col("id"), F.col("name").alias("head"))
    big = hot_keys(labels, "p", labels.count(), "id")
    out = lookup(out, "g", heads, "id", "head", "group_name", big)
    return out.select("group_name", F.col("name").alias("record_name"))
