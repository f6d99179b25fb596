"""Passages of held-out test items in a corpus, found by rare word n-grams and local alignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.session import Scratch, hot_keys, lookup

# A word broken at a line end by a hyphen is one word; soft hyphens and zero-width signs are nothing.
_BROKEN = re.compile(r"[-\u2010\u2011\u00ad][ \t\r]*\n[ \t]*(?=[^\W\d_])")
_NOTHING = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_MARKS = re.compile("[\u0300-\u036f]")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")

MATCH, MISMATCH, GAP = 1, -1, -1


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation and line-end hyphens."""
    text = _BROKEN.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", _NOTHING.sub("", text))).casefold())


#: A task line, or several in a row, has at most this many words; so many words beside it tell if passages are alike.
TASK_WORDS, BESIDE = 20, 5


def ends(text: str) -> Iterator[tuple[str, str, str]]:
    """The lines that a text may begin or end with as a task: the side, their words, and the words of the text beside them."""
    lines = [x for x in (words(line) for line in (text or "").split("\n")) if x]
    for side, order in (("start", 1), ("end", -1)):
        taken: list[str] = []
        for k, line in enumerate(lines[::order]):
            taken = taken + line if order > 0 else line + taken
            rest = [w for x in (lines[k + 1 :] if order > 0 else lines[: -k - 1]) for w in x]
            if len(taken) > TASK_WORDS or not rest:
                break
            yield side, " ".join(taken), " ".join(rest[:BESIDE] if order > 0 else rest[-BESIDE:])


def passage(text: str, tasks: set[tuple[str, str]], least_words: int) -> list[str]:
    """The words of an item without the longest task lines before and after it, if ``least_words`` words are left."""
    w = words(text or "")
    cut = {"start": 0, "end": 0}
    for side, line, _ in ends(text):
        if (side, line) in tasks:
            cut[side] = len(line.split())
    own = w[cut["start"] : len(w) - cut["end"]]
    return own if len(own) >= least_words else w


#: Most bits of a sieve (32 MB); it has 32 for each number until then, and lets more through beyond, but never loses one.
SIEVE_BITS = 1 << 28
#: Words that a task remembers the numbers of.
REMEMBERED = 1 << 19


class Sieve:
    """A Bloom filter of two bits a number, filled by a Spark aggregation; of bounded size however many numbers there are."""

    def __init__(self, numbers: DataFrame, column: str):
        count = numbers.count()
        self.mask = min(SIEVE_BITS, 1 << max(16, (32 * count - 1).bit_length() if count else 0)) - 1
        at = F.explode(F.array(F.col(column).bitwiseAND(self.mask), F.shiftright(column, 31).bitwiseAND(self.mask)))
        bits = numbers.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
        # At most SIEVE_BITS / 32 rows.
        rows = bits.toArrow()
        self.bits = np.zeros((self.mask + 1) // 32, dtype=np.uint32)
        self.bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers > 0) & self._set(numbers & self.mask) & self._set((numbers >> 31) & self.mask)


class Numbers(dict):
    """Words' 63-bit numbers; 0 for a word that the sieve of known words holds back."""

    def __init__(self, known: Sieve | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = (xxhash.xxh3_64_intdigest(word.encode()) >> 1) | 1
        if self.known is not None and not self.known.passes(np.array([n], dtype=np.int64))[0]:
            n = 0
        self[word] = n
        return n


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64), pa.int64()))


def keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 63-bit number for each n-gram of words' numbers; -1 with an unknown word (0 or less) in it."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(m, dtype=np.uint64)
    known = np.ones(m, dtype=bool)
    for k in range(n):
        w = ids[k : k + m]
        known &= w > 0
        h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    out = (h >> np.uint64(1)).astype(np.int64)
    out[~known] = -1
    return out


def found_in(sorted_keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(probe), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, probe), len(sorted_keys) - 1)
    return (sorted_keys[at] == probe) & (probe >= 0)


def rare_grams(k: np.ndarray, seen: np.ndarray, n: int, n_docs: int, least_words: int) -> np.ndarray:
    """The rare ones of an item's n-grams ``k``, which ``seen`` documents hold: those with names and sums in them, not those of phrases everybody uses.

    An item's own n-grams occur in the documents that hold it and hardly elsewhere, so they have about the count that its
    lower quarter has; phrases occur in many more. That is judged by item, so one that very many documents hold keeps its seeds,
    and by each stretch of ``least_words`` words in it, so does one of which they hold a part: an n-gram is rare if it is so in any.
    """
    slack, stretch = max(5, 0.0005 * n_docs), max(1, least_words - n + 1)
    most = np.full(len(k), 2 * np.quantile(seen, 0.25) + slack if len(k) else 0)
    if len(k) > stretch:
        each = 2 * np.quantile(np.lib.stride_tricks.sliding_window_view(seen, stretch), 0.25, axis=1) + slack
        around = np.pad(each, stretch - 1, constant_values=0)
        most = np.maximum(most, np.lib.stride_tricks.sliding_window_view(around, stretch).max(axis=1))
    return np.unique(k[seen <= most])


def align(item: np.ndarray, doc: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, np.ndarray, np.ndarray]:
    """Smith-Waterman with linear gaps: best score, and the aligned positions in the item and the document.

    Only diagonal steps are listed, with equal or unequal words.
    """
    a, b = len(item), len(doc)
    h = np.zeros((a + 1, b + 1), dtype=np.int32)
    slope = np.arange(b + 1, dtype=np.int32) * -gap
    for i in range(1, a + 1):
        row = h[i - 1, :-1] + np.where(doc == item[i - 1], match, mismatch)
        row = np.maximum(np.maximum(row, h[i - 1, 1:] + gap), 0)
        h[i, 1:] = np.maximum.accumulate(row + slope[1:]) - slope[1:]
    best = int(h.max()) if h.size else 0
    if best <= 0:
        return 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    at: list[tuple[int, int]] = []
    while h[i, j] > 0:
        s = match if item[i - 1] == doc[j - 1] else mismatch
        if h[i, j] == h[i - 1, j - 1] + s:
            at.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    x = np.array(at[::-1], dtype=np.int64)
    return best, x[:, 0], x[:, 1]


def held_words(item: np.ndarray, doc: np.ndarray, rare: np.ndarray, n: int, least_words: int = 0) -> int:
    """Words of the item that the document holds in their order, in any number of aligned pieces.

    All words of the item from a piece's first to its last count, single misread ones among them. A piece counts if
    seven in ten of its words are equal and it has a rare n-gram for every six words, two at least; a sentence that
    only sounds alike has none. What a piece covers is taken out of both before the next is sought. As a piece has no more than six words
    for each rare n-gram, what can still be found is known: the search ends, short, when it can't reach ``least_words`` any more.
    """
    at = np.flatnonzero(found_in(rare, keys(doc, n)))
    if not len(at):
        return 0
    # Where the item can lie: each rare n-gram's surroundings, as long as the item and half of it again.
    reach = len(item) + len(item) // 2 + 20
    lo, hi = max(0, int(at[0]) - reach), int(at[-1]) + reach
    item, doc = item.copy(), doc[lo:hi].copy()
    covered = np.zeros(len(item), dtype=bool)
    left = len(at)
    while left >= 2 and covered.sum() + 6 * left >= least_words:
        _, i, j = align(item, doc)
        if not len(i):
            break
        same, span = int((item[i] == doc[j]).sum()), int(i[-1] - i[0] + 1)
        inside = np.unique(keys(doc[j[0] : j[-1] + 1], n))
        if same < 6:
            break
        if same >= 0.7 * span and found_in(rare, inside).sum() >= max(2, span / 6):
            covered[i[0] : i[-1] + 1] = True
        item[i[0] : i[-1] + 1] = -1
        doc[j[0] : j[-1] + 1] = -2
        # Without two rare n-grams outside what is covered, no further piece can count.
        left = int(found_in(rare, keys(np.maximum(doc, 0), n)).sum())
    return int(covered.sum())


#: Rare n-grams that a document and an item must share before they are aligned.
LEAST_SEEDS = 4
#: Up to this many seeds and words of items (8 bytes each) they go to every task; beyond, documents and seeds are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word numbers in a row, with a gap after each document, and each document's first and last place."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False).astype(np.int64)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    first = np.cumsum(np.append(0, length[:-1] + 1)) if len(length) else np.zeros(0, dtype=np.int64)
    flat = np.zeros(int(length.sum()) + len(length), dtype=np.int64)
    doc = np.repeat(np.arange(len(length)), length)
    flat[np.arange(len(values)) + doc] = values
    return flat, first, first + length


def _passages(items: DataFrame, least_words: int, disk: Scratch) -> tuple[DataFrame, DataFrame]:
    """``pid, w``: the distinct passages as words' numbers; and ``pid, i``: the items of each."""
    rows = disk.save(items.withColumn("r", F.monotonically_increasing_id()))

    def read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, side, line, beside) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for side, line, beside in ends(t)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["r", "side", "line", "beside"])

    lines = disk.save(rows.select("r", "t").mapInArrow(read_ends, "r long, side string, line string, beside string").withColumn("key", F.struct("side", "line")))
    # Items of unlike passages share a task line; a repeated passage, or one cut out twice, has the same words beside its lines.
    shared = disk.save(lines.select("key", "beside").distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    marked = lookup(lines, "key", shared, "key", "n", "n", hot_keys(lines, "key", lines.count(), "key")).where("n IS NOT NULL")
    tasks = marked.groupBy("r").agg(F.collect_set("key").alias("tasks"))

    def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        for batch in batches:
            own = [{(x["side"], x["line"]) for x in tasks or ()} for tasks in batch.column(2).to_pylist()]
            w = [np.array([number[x] for x in passage(t, k, least_words)], dtype=np.int64) for t, k in zip(batch.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(w)], ["i", "w"])

    worded = disk.save(rows.join(tasks, "r", "left").select("i", "t", "tasks").mapInArrow(read_words, "i string, w array<long>").where(F.size("w") > 0))
    passages = disk.save(worded.groupBy("w").agg(F.count("*").alias("copies")).withColumn("pid", F.monotonically_increasing_id()))
    members = disk.save(lookup(worded, "w", passages, "w", "pid", "pid", hot_keys(worded, "w", worded.count(), "w")).select("pid", "i"))
    return passages.select("pid", "w"), members


def _item_grams(passages: DataFrame, n: int) -> DataFrame:
    """``pid, at, g``: the n-grams of each passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [keys(np.array(w, dtype=np.int64), n) for w in batch.column(1).to_pylist()]
            length = [len(k) for k in own]
            at = np.concatenate([np.arange(m) for m in length]) if own else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), length)), pa.array(at, pa.int64()), pa.array(np.concatenate(own) if own else at, pa.int64())], ["pid", "at", "g"])

    return passages.select("pid", "w").mapInArrow(cut, "pid long, at long, g long")


def leaked_items(docs: DataFrame, items: DataFrame, least_words: int = 30, n: int = 3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, item_id, words_held``: every document with each test item of which it holds ``least_words`` words in order.

    1. Each document's words are numbered, in one pass over the texts whatever the number of items; words that no item has are 0.
    2. In how many documents each n-gram of the items occurs is counted over the whole corpus.
    3. The rare n-grams are the seeds; a document and an item with four seeds in common are aligned.

    Lines of at most TASK_WORDS words before or after a passage of ``least_words`` words or more that unlike passages share are
    tasks and no part of it. Items of equal passages are looked for once. Texts don't move between tasks; beyond BROADCAST_SEEDS
    the n-grams that occur among the seeds do, and the words of the documents to be aligned. Null texts and
    texts without words hold nothing; an item of fewer words than ``least_words`` can't be held, nor one without an id. Rows with
    equal ids are looked at one by one and give a row each. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    sc, disk = spark.sparkContext, Scratch(spark, "leaks")
    sized = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    passages, members = _passages(sized, least_words, disk)
    grams = disk.save(_item_grams(passages, n))
    words_sieve = sc.broadcast(Sieve(passages.select(F.explode("w").alias("x")).distinct(), "x"))
    grams_sieve = sc.broadcast(Sieve(grams.select("g").distinct(), "g"))
    slim, n_docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), docs.count()
    kind = dict(slim.dtypes)["d"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = Numbers(words_sieve.value), grams_sieve.value
        for batch in batches:
            rows, lists = [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                w = np.fromiter(map(number.__getitem__, words(t or "")), dtype=np.int64)
                # Fewer known n-grams than seeds are asked for: the document can hold no passage.
                if len(w) >= least_words // 2 and known.passes(keys(w, n)).sum() >= LEAST_SEEDS:
                    rows.append(r)
                    lists.append(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), _lists(lists)], ["d", "w"])

    numbered = disk.save(slim.mapInArrow(read, f"d {kind}, w array<long>").withColumn("row", F.monotonically_increasing_id()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = grams_sieve.value
        for batch in batches:
            doc, g = _grams(batch.column(0), n, known)
            g, times = np.unique(g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(times, pa.int64())], ["g", "n"])

    counted = disk.save(numbered.select("w").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
    seen = lookup(grams, "g", counted, "g", "n", "n", hot_keys(grams, "g", grams.count(), "g"))
    seen = seen.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("at", "g", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(2).to_pylist():
                k, m = (np.array([x[c] for x in s or ()], dtype=np.int64) for c in ("g", "n"))
                out.append(rare_grams(k, m.astype(float), n, n_docs, least_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(out)], ["pid", "w", "rare"])

    judged = disk.save(passages.join(seen, "pid", "left").select("pid", "w", "s").mapInArrow(judge, "pid long, w array<long>, rare array<long>"))
    size = judged.agg(F.sum(F.size("w") + F.size("rare"))).first()[0] or 0
    few = size <= BROADCAST_SEEDS
    held = disk.save(_held_by_tasks(numbered, judged, n, least_words, kind) if few else _held_by_join(numbered, judged, n, least_words, kind, disk))
    words_sieve.destroy()
    grams_sieve.destroy()
    out = held.join(members, "pid").select(F.col("d").alias(doc_id), F.col("i").cast(dict(items.dtypes)[item_id]).alias(item_id), "words_held")
    return out


def _grams(lists: pa.ListArray, n: int, known: Sieve) -> tuple[np.ndarray, np.ndarray]:
    """Document and n-gram, each pair once, of the n-grams that pass."""
    flat, first, _ = _flat(lists)
    k = keys(flat, n)
    hit = np.flatnonzero(known.passes(k))
    doc, g = np.searchsorted(first, hit, side="right") - 1, k[hit]
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[new], g[new]


def _held_by_tasks(numbered: DataFrame, judged: DataFrame, n: int, least_words: int, kind: str) -> DataFrame:
    """``d, pid, words_held``, with the seeds and the words of the items in every task."""
    items = judged.toArrow()
    pids = items["pid"].to_numpy()
    texts = [np.array(w, dtype=np.int64) for w in items["w"].to_pylist()]
    rare = [np.array(k, dtype=np.int64) for k in items["rare"].to_pylist()]
    seeds = np.concatenate([*rare, np.zeros(0, dtype=np.int64)])
    order = np.argsort(seeds, kind="stable")
    of = np.repeat(np.arange(len(rare)), [len(k) for k in rare])[order]
    ready = numbered.sparkSession.sparkContext.broadcast((pids, texts, rare, seeds[order], of))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pids, texts, rare, seeds, of = ready.value
        for batch in batches:
            flat, first, last = _flat(batch.column(1))
            k = keys(flat, n)
            hit = np.flatnonzero(found_in(seeds, k))
            doc = np.searchsorted(first, hit, side="right") - 1
            lo = np.searchsorted(seeds, k[hit], side="left")
            some = np.searchsorted(seeds, k[hit], side="right") - lo
            # The join of the documents' n-grams with the seeds: one row for each document, item and seed.
            at = np.repeat(lo, some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            pair = np.repeat(doc, some) * len(texts) + of[at]
            shared = np.unique(np.stack([pair, seeds[at]]), axis=1)
            pairs, times = np.unique(shared[0], return_counts=True)
            got: list[tuple[int, int, int]] = []
            for p in pairs[times >= LEAST_SEEDS].tolist():
                d, i = divmod(p, len(texts))
                held = held_words(texts[i], flat[first[d] : last[d]], rare[i], n, least_words)
                if held >= least_words:
                    got.append((d, pids[i], held))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int32())], ["d", "pid", "words_held"])

    return numbered.select("d", "w").mapInArrow(search, f"d {kind}, pid long, words_held int")


def _held_by_join(numbered: DataFrame, judged: DataFrame, n: int, least_words: int, kind: str, disk: Scratch) -> DataFrame:
    """The same by a join of the documents' n-grams with the seeds, and of the pairs found with both sides' words; hot ones are spread."""
    by_gram = disk.save(judged.select("pid", F.explode("rare").alias("g")).groupBy("g").agg(F.collect_list("pid").alias("pids")))
    sieve = numbered.sparkSession.sparkContext.broadcast(Sieve(by_gram, "g"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, g = _grams(batch.column(1), n, sieve.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(g, pa.int64())], ["row", "g"])

    hits = disk.save(numbered.select("row", "w").mapInArrow(emit, "row long, g long"))
    x = lookup(hits, "g", by_gram, "g", "pids", "pids", hot_keys(hits, "g", hits.count(), "g")).where("pids IS NOT NULL")
    pairs = disk.save(x.select("row", F.explode("pids").alias("pid")).groupBy("row", "pid").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("row", "pid"))
    packed = judged.select("pid", F.struct("w", "rare").alias("item"))
    y = lookup(pairs, "pid", packed, "pid", "item", "item", hot_keys(pairs, "pid", pairs.count(), "pid"))
    y = y.join(numbered, "row").select("d", "pid", F.col("w").alias("doc"), F.col("item.w").alias("w"), F.col("item.rare").alias("rare"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            held = np.array([held_words(*(np.array(x, dtype=np.int64) for x in (w, doc, rare)), n, least_words) for doc, w, rare in rows], dtype=np.int32)
            keep = pa.array(np.flatnonzero(held >= least_words), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(held, pa.int32()).take(keep)], ["d", "pid", "words_held"])

    return y.mapInArrow(search, f"d {kind}, pid long, words_held int")
