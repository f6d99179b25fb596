"""Text statistics of documents, exact ranks of them by language, and the documents that are no running prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.session import HOT_PARTS, Scratch, lookup

STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "prose_share")
_SYMBOL = re.compile(r"[^\w\s]|_")
_EDGE = ".,;:!?()[]{}\"'«»“”„’‘…-–—*¶"
_ENDS = (".", "!", "?", ":", ";", "…", '."', ".”", ".’", ".»", ".)")
#: A word stands in prose if, among the words from AROUND before to AROUND after it, the part of common words is within COMMON and
#: at least INTACT are made of letters, and no six words from it on are said REPEATS times in the document.
AROUND, COMMON, INTACT, REPEATS = 8, (0.14, 0.65), 0.55, 5


def _prose_share(words: list[str], common: np.ndarray) -> float:
    n = len(words)
    length = np.fromiter(map(len, words), dtype=np.float64, count=n) + 1
    whole = np.fromiter((len(w) > 1 and w.isalpha() for w in words), dtype=bool, count=n) | common
    at = np.arange(n)
    lo, hi = np.maximum(0, at - AROUND), np.minimum(n, at + AROUND + 1)

    def near(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return (total[hi] - total[lo]) / (hi - lo)

    often = near(common)
    good = (often >= COMMON[0]) & (often <= COMMON[1]) & (near(whole) >= INTACT)
    if n >= 6 and good.any():
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        run = np.zeros(n - 5, dtype=np.uint64)
        for k in range(6):
            run = run * np.uint64(1_000_003) + h[k : n - 5 + k]
        _, which, times = np.unique(run, return_inverse=True, return_counts=True)
        again = times[which] >= REPEATS
        for k in range(6):
            good[k : n - 5 + k] &= ~again
    return float((length * good).sum() / length.sum())


def text_statistics(docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang`` and the STATISTICS of each row, over its whole text.

    Words are what stands between white space, their length is in characters; symbols are what is neither letter, digit nor white space, as
    a share of all characters; lines without a character don't count. Common words are compared in lower case without punctuation at their ends,
    by the list of the language that has most of the text's words. That language is the row's ``lang`` too (the first in the alphabet of several); a
    text without any common word keeps its declared one in lower case, or ``und``. ``prose_share`` is the part of the characters of words that
    stand in running prose. A null or blank text has zeros. The word lists are small and go to every task.
    """
    lists: dict[str, int] = {}
    words: dict[str, int] = {}
    known = common_words.where("lang IS NOT NULL AND word IS NOT NULL").select(F.lower("lang").alias("l"), F.lower("word").alias("w")).distinct()
    for r in sorted(known.collect()):
        words[r.w] = words.get(r.w, 0) | 1 << lists.setdefault(r.l, len(lists))
    names = list(lists)
    kind = dict(docs.dtypes)[doc_id]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = words.get
        for batch in batches:
            langs: list[str] = []
            rows: list[tuple[float, ...]] = []
            for declared, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = (t or "").lower().split()
                own = (declared or "").strip().lower() or "und"
                if not found:
                    langs.append(own)
                    rows.append((0.0,) * len(STATISTICS))
                    continue
                bare = [w.strip(_EDGE) for w in found]
                mask = np.fromiter((get(w, 0) for w in bare), dtype=np.int64, count=len(bare))
                counts = [int(np.count_nonzero(mask & (1 << i))) for i in range(len(names))]
                best = int(np.argmax(counts)) if counts else 0
                top = counts[best] if counts else 0
                langs.append(names[best] if top else own)
                lines = [x for x in map(str.rstrip, t.split("\n")) if x]
                n = len(found)
                # Lengths by the text as it is: lower case can have more characters.
                letters = len(t) - sum(map(str.isspace, t)) if not t.isascii() else sum(map(len, found))
                rows.append((float(n), letters / n, len(_SYMBOL.findall(t)) / len(t), sum(x.endswith(_ENDS) for x in lines) / max(1, len(lines)), top / n, _prose_share(bare, mask > 0)))
            columns = [batch.column(0), pa.array(langs, pa.string())]
            columns += [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", *STATISTICS])

    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{s} double" for s in STATISTICS)
    out = docs.select(F.col(doc_id), F.col(lang), F.col(text)).mapInArrow(measure, schema)
    return out.withColumnRenamed("doc_id", doc_id)


def tail_probabilities(values: DataFrame, disk: Scratch, by: tuple[str, ...] = ("lang", "stat"), value: str = "value") -> DataFrame:
    """``k, n, below, above`` for each distinct ``k = struct(*by, value)``: rows of its group, and those not above and not below it.

    Equal values are counted first. The distinct ones are range-partitioned and sorted; a partition's counts are summed
    up within it, and what the partitions before it hold is added as an offset. So no group is sorted in one task, and the
    ranks are exact.
    """
    keys = list(by)
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = disk.save(counted.repartitionByRange(parts, *keys, value).withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part", *keys).agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys).orderBy("part")
    offsets = sums.select(
        "part", *keys,
        F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("c").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = F.sum("c").over(Window.partitionBy("part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    # Partitions times groups: few as long as there are few languages, but languages come from the data.
    offsets = disk.save(offsets)
    few = offsets.count() <= BROADCAST_OFFSETS
    x = ordered.withColumn("inside", inside).join(F.broadcast(offsets) if few else offsets, ["part", *keys])
    below = F.col("offset") + F.col("inside")
    return x.select(F.struct(*keys, value).alias("k"), "c", F.struct("n", below.alias("below"), (F.col("n") - below + F.col("c")).alias("above")).alias("tails"))


#: Offsets of partitions' groups are broadcast up to this many (about 10 MB).
BROADCAST_OFFSETS = 100_000


class Quality:
    """``statistics`` and ``scores`` of documents, and which are no prose."""

    def __init__(self, docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
        self.doc_id = doc_id
        self.disk = Scratch(docs.sparkSession, "quality")
        x = text_statistics(docs, common_words, doc_id, text, lang)
        self.statistics = self.disk.save(x.withColumn("row", F.monotonically_increasing_id()))

    def scores(self, prose: float = 0.5) -> DataFrame:
        """The statistics with ``outlier_score``, ``rarest`` and ``cut``: how far out in its language a document lies.

        For every statistic the parts of the language's documents that lie not above and not below are its two tail probabilities.
        The score adds their negative logarithms up: that of the lower tail of ``prose_share``, and the mean of the rarer tails of the
        others. ``rarest`` is the smallest tail probability of any statistic. Ties share their probabilities. Rounded to nine digits for that.

        ``cut`` is the score that a document of the language with less than ``prose`` of running prose has at least: the negative logarithm of
        the part of its documents up to there. Whoever lies below has a lower tail no larger than that part, and the other statistics only
        add to its logarithm. So it holds for every distribution: for papers that are a third of all, or alike, or alone in their
        language. Null where no document of the language lies so low.
        """
        s = self.statistics
        packed = F.array(*[F.struct(F.lit(n).alias("stat"), (F.round(F.col(n), 9) + F.lit(0.0)).alias("value")) for n in STATISTICS])
        values = s.select("row", "lang", F.explode(packed).alias("v")).select("row", "lang", "v.stat", "v.value")
        total = s.count() * len(STATISTICS)
        tails = self.disk.save(tail_probabilities(values, self.disk))
        hot = tails.where(F.col("c") * HOT_PARTS >= max(total, HOT_PARTS)).select("k")
        x = values.select("row", F.struct("lang", "stat", "value").alias("k"))
        x = lookup(x, "k", tails, "k", "tails", "t", hot)
        left, right = (-F.log(F.col(f"t.{c}") / F.col("t.n")) for c in ("below", "above"))
        low = tails.where((F.col("k.stat") == "prose_share") & (F.col("k.value") <= F.lit(round(prose, 9))))
        cuts = low.groupBy(F.col("k.lang").alias("lang")).agg(F.max("tails.below").alias("b"), F.max("tails.n").alias("n"))
        # A row for each language, written, so that Spark knows its size and how to join it.
        cuts = self.disk.save(cuts.select("lang", (-F.log(F.col("b") / F.col("n"))).alias("cut")))
        x = x.select("row", F.col("k.stat").alias("stat"), left.alias("l"), right.alias("r"))
        part = F.when(F.col("stat") == "prose_share", F.col("l")).otherwise(F.greatest("l", "r") / (len(STATISTICS) - 1))
        sums = x.groupBy("row").agg(F.sum(part).alias("outlier_score"), F.exp(-F.max(F.greatest("l", "r"))).alias("rarest"))
        out = s.join(sums, "row").drop("row")
        return out.join(cuts, "lang", "left").select(*out.columns, "cut")

    def outliers(self, prose: float = 0.5) -> DataFrame:
        """The scored documents that lie as far out in their language as one with less than ``prose`` of running prose must."""
        return self.scores(prose).where(F.col("outlier_score") >= F.col("cut") - F.lit(1e-9))

    def not_prose(self, prose: float = 0.5) -> DataFrame:
        """The ids of documents of which more than half of the characters are not running prose, the furthest outliers first.

        They are sought among the ``outliers``, whose cut-off comes from the exact ranks and loses none of them; the share of running prose
        is then checked of each. Texts without a word are neither prose nor anything else: they are not given.
        """
        x = self.outliers(prose).where((F.col("prose_share") < prose) & (F.col("n_words") > 0))
        return x.orderBy(F.desc("outlier_score"), self.doc_id).select(self.doc_id)
