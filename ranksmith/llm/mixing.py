"""A mix of sources with target shares of its tokens, in a low-discrepancy order of equal-token blocks."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.session import Scratch

#: Fixed value: how the vocabulary's own tokenizer cuts text into words before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GOLDEN = (math.sqrt(5) - 1) / 2
_SEED = 0x5EED


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the tokens of the whole text (0 for a null one)."""
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(count, fields + ", n_tokens long")


class Mix:
    """``plan``: the sources; ``rows``: the mix; ``report``: the shares it reaches."""

    def __init__(self, docs: DataFrame, targets: DataFrame, block_tokens: int = 4096, group_rows: int = 20_000, doc_id: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY):
        """Mix ``docs`` to the shares of ``targets`` (source, target_share, max_repeats).

        The mix is as large as all rows of ``docs`` together, in tokens. Each source gets its share of that, but no document
        more than ``max_repeats`` times: a source short of tokens gives all it has, so the mix is smaller then.
        Each pass over a source is shuffled anew and cut where ``block_tokens`` tokens are full. Slot k of the schedule belongs to the
        source under the point ``frac(k * golden ratio)`` of the cumulative weights; the j-th slot of a source takes its j-th block.
        ``rows`` have the slot and ``at``, the token of its source's stream that a row begins with: the mix in order is that by slot and ``at``.
        A source is ``short`` if what its blocks in the schedule hold is less than its share of all tokens.

        Documents without a source (or one that isn't in ``targets``) count towards the size only; documents with no tokens are
        not mixed. A source named twice in ``targets`` has the sum of its shares and its largest repeats. Null or
        negative shares are 0, null or negative repeats are 0. The list of sources is small; all else is distributed: running
        sums are taken within groups of about ``group_rows`` rows and over the groups' totals, so that no source's
        rows come together in one task.
        """
        spark = docs.sparkSession
        self.disk = disk = Scratch(spark, "mix")
        sized = disk.save(count_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), ["doc_id", "source"], vocabulary=vocabulary))
        share = F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))
        repeats = F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)), F.lit(0)).cast("long")
        wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(share).alias("target_share"), F.max(repeats).alias("max_repeats"))
        have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
        total = have.agg(F.sum("tokens")).first()[0] or 0
        need = F.col("target_share") * F.lit(float(total))
        plan = wanted.join(F.broadcast(have.join(wanted.select("source"), "source", "left_semi")), "source", "left").fillna(0, ["tokens", "docs"])
        plan = plan.withColumn("available", F.col("tokens") * F.col("max_repeats")).withColumn("needed", need)
        plan = disk.save(plan.withColumn("taken", F.least(F.col("needed"), F.col("available").cast("double"))))
        self.plan = plan
        sources = sorted((r for r in plan.collect() if r.taken > 0), key=lambda r: r.source)
        self.rows = self._mixed(sized, sources, block_tokens, group_rows)
        if sources:
            # The mix is written once; what is read of it later is what was mixed.
            self.rows = disk.save(self.rows)
        reached = self.rows.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count("*").alias("mixed_rows"), F.max("copy").alias("copies"))
        everything = self.rows.agg(F.sum("n_tokens")).first()[0] or 0
        # As many rows as the plan has sources.
        x = plan.join(F.broadcast(reached), "source", "left").fillna(0, ["mixed_tokens", "mixed_rows", "copies"])
        self.report = x.select(
            "source", "target_share", "max_repeats", "tokens", "docs", "needed", "mixed_tokens", "mixed_rows", "copies",
            F.when(F.lit(everything > 0), F.col("mixed_tokens") / F.lit(float(max(everything, 1)))).otherwise(0.0).alias("reached_share"),
            # Blocks are taken until the share is reached or the source and its repeats are used up.
            (F.col("mixed_tokens") < F.col("needed")).alias("short"),
        )

    def _mixed(self, sized: DataFrame, sources: list, block_tokens: int, group_rows: int) -> DataFrame:
        spark = sized.sparkSession
        if not sources:
            return sized.where("false").select(F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("at"), "source", "doc_id", F.lit(0).cast("long").alias("copy"), "n_tokens")
        passes = spark.createDataFrame([(r.source, float(r.taken), math.ceil(r.taken / r.tokens - 1e-12), max(1, r.docs // group_rows)) for r in sources], "source string, taken double, passes long, groups long")
        x = sized.where("n_tokens > 0").join(F.broadcast(passes), "source")
        x = x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
        key = F.xxhash64(F.lit(_SEED), F.col("copy"), F.col("doc_id").cast("string"))
        # Groups follow the order of the keys: the upper bits of a key name its group.
        upper = (F.shiftrightunsigned(key, 33) * F.col("groups")).bitwiseAND((1 << 63) - 1)
        x = x.withColumn("key", F.shiftrightunsigned(key, 1)).withColumn("group", F.shiftright(upper, 31))
        at = ["source", "copy", "group"]
        totals = x.groupBy(*at).agg(F.sum("n_tokens").alias("t"))
        w = Window.partitionBy("source").orderBy("copy", "group").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*at, F.coalesce(F.sum("t").over(w), F.lit(0)).alias("before"))
        w = Window.partitionBy(*at).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        x = x.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        x = x.join(before, at).withColumn("start", F.col("before") + F.col("inside"))
        x = x.where(F.col("start") < F.col("taken")).withColumn("block", F.floor(F.col("start") / F.lit(block_tokens)))
        slots = self._slots(sources, block_tokens)
        # A block without a slot is not in the mix.
        x = x.join(slots, (x["source"] == slots["s"]) & (x["block"] == slots["rank"]))
        return x.select(F.col("k").alias("slot"), F.col("start").alias("at"), "source", "doc_id", "copy", "n_tokens")

    def _slots(self, sources: list, block_tokens: int, chunk_log2: int = 16) -> DataFrame:
        """``s, rank, k``: slot k is the rank-th of source s, for every block of each source.

        Points of the sequence fall into an interval as often as its length says but for a few (a logarithm of their number), so a source
        may lack a few slots after as many points as there are blocks. Those follow behind, source by source.
        """
        spark = self.plan.sparkSession
        total = sum(r.taken for r in sources)
        n = math.ceil(total / block_tokens) + 64
        edge, cut = 0.0, []
        for r in sources:
            edge += r.taken / total
            cut.append((edge, r.source))
        # Which source a point belongs to: the first cumulative weight above it, by halving.
        def under(part: list) -> Column:
            if len(part) == 1:
                return F.lit(part[0][1])
            half = len(part) // 2
            return F.when(F.col("x") < F.lit(part[half - 1][0]), under(part[:half])).otherwise(under(part[half:]))

        x = spark.range(n).select(F.col("id").alias("k"), F.pmod(F.lit(0.5) + F.col("id") * F.lit(GOLDEN), F.lit(1.0)).alias("x"))
        x = x.select("k", under(cut).alias("s"), F.shiftright("k", chunk_log2).alias("chunk"))
        per = self.disk.save(x.groupBy("s", "chunk").agg(F.count("*").alias("c")))
        # One row for each source.
        given = {r.s: r.c for r in per.groupBy("s").agg(F.sum("c").alias("c")).collect()}
        blocks = {r.source: math.ceil(r.taken / block_tokens) for r in sources}
        lacking = [(s, rank) for s in sorted(blocks) for rank in range(given.get(s, 0), blocks[s])]
        tail = spark.createDataFrame([(s, rank, n + k) for k, (s, rank) in enumerate(lacking)], "s string, rank long, k long")
        w = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("s", "chunk", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
        w = Window.partitionBy("s", "chunk").orderBy("k")
        x = x.withColumn("inside", F.row_number().over(w) - 1).join(per, ["s", "chunk"])
        return x.select("s", (F.col("before") + F.col("inside")).alias("rank"), "k").unionByName(tail)
