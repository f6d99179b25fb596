"""Leaks, mixes and text statistics against brute force and planted cases."""

import random

import numpy as np
import pytest

from ranksmith.llm import leaks, mixing, quality

R = random.Random(11)
VOCAB = ["".join(R.choice("bdfgklmnprstv") + R.choice("aeiou") for _ in range(3)) for _ in range(3000)]
COMMON = "the of and to in a is that it was for on are as with his they at be this from or had by not but what all were we when".split()


def prose(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(COMMON) if r.random() < 0.4 else r.choice(VOCAB))
        if k % 12 == 11:
            out[-1] += "."
    return out


ITEMS = [(f"it{k}", "Read this.\n" + " ".join(prose(90, 1000 + k)) + "\nWho wins?") for k in range(6)]


def noisy(words, seed):
    r = random.Random(seed)
    out = []
    for k, w in enumerate(words):
        if k % 13 == 7:
            w = "████" if r.random() < 0.5 else w[:-1] + "q"
        if k % 11 == 5 and len(w) > 5:
            w = w[:3] + "-\n" + w[3:]
        out.append(w.upper() if k % 3 else w)
        if k % 17 == 9:
            out.append("\n— Court — p. 2/3\n")
    return " ".join(out)


def documents():
    passage = [t.split("\n")[1].split() for _, t in ITEMS]
    docs = [(k, " ".join(prose(200, k))) for k in range(40)]
    docs.append((100, " ".join(prose(80, 51)) + "\n" + " ".join(passage[0]) + " " + " ".join(prose(60, 52))))
    docs.append((101, " ".join(prose(80, 53)) + " " + noisy(passage[1][20:75], 3) + " " + " ".join(prose(50, 54))))
    docs.append((102, " ".join(passage[2][:25]) + " " + " ".join(prose(90, 55)) + " " + " ".join(passage[2][40:70])))
    docs.append((103, " ".join(prose(90, 56)) + " " + " ".join(passage[3][:12]) + " " + " ".join(prose(90, 57))))
    docs.append((104, "Read this. Who wins? " + " ".join(prose(90, 58))))
    docs.append((105, " ".join(passage[4]) + " " + " ".join(passage[5])))
    return docs + [(106, None), (107, ""), (108, "x " * 200_000)]


def test_leaks(spark):
    d = spark.createDataFrame(documents(), "doc_id long, text string")
    i = spark.createDataFrame([*ITEMS, ("none", None), ("short", "two words")], "item_id string, text string")
    got = {(r.doc_id, r.item_id): r.words_held for r in leaks.leaked_items(d, i).collect()}
    assert got.keys() == {(100, "it0"), (101, "it1"), (102, "it2"), (105, "it4"), (105, "it5")}
    assert got[100, "it0"] == 90 and got[101, "it1"] >= 45 and 50 <= got[102, "it2"] <= 60
    assert leaks.leaked_items(d.limit(0), i).count() == 0 and leaks.leaked_items(d, i.limit(0)).count() == 0


def test_an_item_in_many_documents_keeps_its_seeds(spark):
    passage = ITEMS[0][1].split("\n")[1]
    rows = [(k, passage if k % 2 else " ".join(prose(120, k))) for k in range(60)]
    got = leaks.leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, "it0") for k in range(60) if k % 2}


def test_a_part_in_many_documents_keeps_its_seeds(spark):
    part = " ".join(ITEMS[0][1].split("\n")[1].split()[20:70])
    rows = [(k, " ".join(prose(60, 5000 + k)) + " " + (part if k % 3 == 0 else " ".join(prose(60, 6000 + k)))) for k in range(90)]
    got = leaks.leaked_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, "it0") for k in range(0, 90, 3)}


def test_repeated_and_overlapping_items_keep_their_lines(spark, monkeypatch):
    def broken(w):
        return "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))

    a, b, c = (prose(90, 2000 + k) for k in range(3))
    items = [("a1", "Read this.\n" + broken(a)), ("a1", "Read this.\n" + broken(a)), ("a2", broken(a) + "\nWho wins?"), ("b", "Read this.\n" + broken(b)), ("b2", broken(b[27:])), ("c", broken(c) + "\nWho wins?")]
    docs = [(0, " ".join(prose(60, 70) + a[:33])), (1, " ".join(b[60:] + prose(60, 71))), (2, " ".join(prose(60, 72) + c)), (3, "Read this. Who wins? " + " ".join(prose(60, 73)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = {(0, "a1"), (0, "a2"), (1, "b"), (1, "b2"), (2, "c")}
    whole = sorted(leaks.leaked_items(d, i).collect())
    assert {(r.doc_id, r.item_id) for r in whole} == want and len(whole) == 6
    monkeypatch.setattr(leaks, "BROADCAST_SEEDS", 0)
    assert sorted(leaks.leaked_items(d, i).collect()) == whole
    tasks = {("start", "read this"), ("end", "who wins")}
    assert leaks.passage(items[0][1], tasks, 30) == leaks.words(" ".join(a)) and leaks.passage("Read this.\na b c", tasks, 30) == ["read", "this", "a", "b", "c"]


def test_items_of_any_number_give_the_same(spark, monkeypatch):
    d, i = spark.createDataFrame(documents(), "doc_id long, text string"), spark.createDataFrame([*ITEMS, *[(f"x{k}", v) for k, v in ITEMS[:2]]], "item_id string, text string")
    whole = sorted(leaks.leaked_items(d, i).collect())
    assert {(100, "xit0"), (101, "xit1")} <= {(r.doc_id, r.item_id) for r in whole}
    # Seeds joined by a shuffle, and a sieve so small that it lets nearly everything through.
    monkeypatch.setattr(leaks, "BROADCAST_SEEDS", 0)
    assert sorted(leaks.leaked_items(d, i).collect()) == whole
    monkeypatch.setattr(leaks, "SIEVE_BITS", 1 << 6)
    assert sorted(leaks.leaked_items(d, i).collect()) == whole


def test_a_passage_in_many_pieces(spark):
    w = prose(72, 3000)
    docs = [(0, " ".join(x for k in range(0, 72, 9) for x in [*w[k : k + 9], *prose(25, 4000 + k)])), (1, " ".join(x for k in range(0, 56, 7) for x in [*w[k : k + 7], *prose(25, 4100 + k)]))]
    docs += [(10 + k, " ".join(prose(100, 4200 + k))) for k in range(20)]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", " ".join(w)), ("b", " ".join(prose(72, 3001)))], "item_id string, text string"))
    held = {(r.doc_id, r.item_id): r.words_held for r in got.collect()}
    assert held.keys() == {(0, "a"), (1, "a")} and held[0, "a"] >= 70 and held[1, "a"] >= 54


def test_alignment_is_the_best_of_all():
    def best(a, b):
        h, top = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for x in range(1, len(a) + 1):
            for y in range(1, len(b) + 1):
                h[x, y] = max(0, h[x - 1, y - 1] + (1 if a[x - 1] == b[y - 1] else -1), h[x - 1, y] - 1, h[x, y - 1] - 1)
        return h.max()

    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 14))
        score, i, j = leaks.align(a, b)
        assert score == best(a, b) and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_words_fold():
    assert leaks.words("Der Ver-\nlust, Été naïve “x” co­op STRASSE Straße 5,380") == ["der", "verlust", "ete", "naive", "x", "coop", "strasse", "strasse", "5", "380"]


def sources():
    docs = [(k, "big" if k % 10 < 6 else "mid" if k % 10 < 9 else "tiny", " ".join(prose(20 + k % 40, k))) for k in range(300)]
    return docs + [(900, None, "words without a source"), (901, "other", "a b c"), (902, "mid", None), (903, "mid", "")]


def test_mix(spark):
    d = spark.createDataFrame(sources(), "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 3), ("tiny", 0.35, 2), ("gone", 0.05, 4)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t, block_tokens=200, group_rows=10)
    report = {r.source: r for r in m.report.collect()}
    total = sum(r.n_tokens for r in mixing.count_tokens(d, ["doc_id"]).collect())
    assert {k for k, r in report.items() if r.short} == {"tiny", "gone"}
    rows = m.rows.collect()
    per = {}
    for r in rows:
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    assert max(per[k] for k in per) <= 3 and len({(r.doc_id, r["copy"]) for r in rows}) == len(rows)
    for k in ("big", "mid"):
        assert 0.3 * total <= report[k].mixed_tokens <= 0.3 * total + 200
    assert report["tiny"].mixed_tokens == 2 * report["tiny"].tokens and report["gone"].mixed_tokens == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    # Sources come evenly: in the first half of the slots as in all.
    slots = sorted({r.slot for r in rows})
    half = [r for r in rows if r.slot <= slots[len(slots) // 2]]
    for k in ("big", "mid", "tiny"):
        assert abs(sum(r.n_tokens for r in half if r.source == k) / sum(r.n_tokens for r in half) - report[k].reached_share) < 0.08
    again = mixing.Mix(d.repartition(5), t, block_tokens=200, group_rows=1000)
    assert {(r.source, r.mixed_tokens) for r in again.report.collect()} == {(r.source, r.mixed_tokens) for r in report.values()}


def test_shares_come_from_the_schedule(spark, monkeypatch):
    d = spark.createDataFrame(sources(), "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 3), ("tiny", 0.35, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t, block_tokens=200, group_rows=10)
    rows = m.rows.collect()
    # Each source's slots take its blocks in order, and no two sources have a slot in common.
    assert len({r.slot for r in rows}) == len({(r.slot, r.source) for r in rows})
    for s in ("big", "mid", "tiny"):
        mine = sorted((r.slot, r.at) for r in rows if r.source == s)
        assert [a for _, a in mine] == sorted(a for _, a in mine)
    slots = mixing.Mix._slots
    monkeypatch.setattr(mixing.Mix, "_slots", lambda self, *a: slots(self, *a).where("s <> 'big'"))
    assert {r.source for r in mixing.Mix(d, t, block_tokens=200, group_rows=10).report.where("short").collect()} == {"big", "tiny"}


def test_every_block_has_a_slot(spark):
    d = spark.createDataFrame([(k, f"s{k % 7}" if k % 50 else "rare", "a b c d e " * 8) for k in range(700)], "doc_id long, source string, text string")
    t = spark.createDataFrame([(f"s{k}", 0.12, 1) for k in range(7)] + [("rare", 0.01, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t, block_tokens=40)
    assert [r.source for r in m.report.where("short").collect()] == []
    assert all(r.mixed_tokens >= r.needed for r in m.report.collect())


def test_mix_of_nothing(spark):
    d = spark.createDataFrame(sources(), "doc_id long, source string, text string")
    t = spark.createDataFrame([("gone", None, None), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(d, t)
    assert m.rows.count() == 0 and [(r.source, r.short) for r in m.report.collect()] == [("gone", False)]
    assert mixing.Mix(d.limit(0), t).report.count() == 1


def test_tokens_of_a_long_text(spark):
    d = spark.createDataFrame([(1, "ab" * 100_000), (2, None), (3, "<|endoftext|>")], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in mixing.count_tokens(d, ["doc_id"]).collect()}
    assert n[1] > 1000 and n[2] == 0 and n[3] > 1


JUNK = ["\n".join(f"{k}\t{VOCAB[k]}\t{k * 7}" for k in range(80)), " ".join(" ".join(w) for w in prose(60, 3)), "of the and in to be on at as by or it is not from " * 20, "#$%^& *() " * 50, "Registry copy - not for circulation\n" * 30]
WORDS = [("en", w) for w in COMMON]


def corpus():
    docs = [(k, "en" if k % 3 else ("EN" if k % 2 else None), " ".join(prose(150, 300 + k)).replace(". ", ".\n")) for k in range(40)]
    docs += [(100 + k, "en", t) for k, t in enumerate(JUNK)]
    mixed = "\n".join(f"{k} {VOCAB[k]} {k * 3}" for k in range(15)) + "\n" + " ".join(prose(200, 7))
    return docs + [(200, "en", mixed), (201, "en", " ".join(prose(150, 8)).upper()), (202, None, None), (203, "xx", "  \n ")]


def test_quality(spark):
    d = spark.createDataFrame(corpus(), "doc_id long, lang string, text string")
    w = spark.createDataFrame(WORDS, "lang string, word string")
    q = quality.Quality(d, w)
    rows = {r.doc_id: r for r in q.scores().collect()}
    assert len(rows) == len(corpus())
    assert {r.doc_id for r in q.not_prose().collect()} == {100 + k for k in range(len(JUNK))}
    one = rows[0]
    text = dict((x[0], x[2]) for x in corpus())[0]
    found = text.split()
    assert one.n_words == len(found) and one.mean_word_length == pytest.approx(sum(map(len, found)) / len(found))
    assert one.symbol_ratio == pytest.approx(sum(not c.isalnum() and not c.isspace() for c in text) / len(text))
    assert one.common_share == pytest.approx(sum(x.strip(".") in COMMON for x in found) / len(found))
    assert rows[202].n_words == 0 and rows[203].lang == "xx"


def test_papers_that_hide_each_other_are_no_prose(spark):
    page = "of\n" + "\n".join(f"{k} | {VOCAB[k]} | {k * 7}" for k in range(20))
    docs = [(k, "en", " ".join(prose(150, 300 + k))) for k in range(20)] + [(100 + k, "en", page) for k in range(10)]
    docs += [(200, "fr", "le " + page), (201, "de", " ".join(["der", *prose(60, 4)])), (202, "de", "der " + page)]
    w = spark.createDataFrame([*WORDS, ("fr", "le"), ("de", "der")], "lang string, word string")
    few = spark.createDataFrame([(300, "en", page), (301, "en", " ".join(prose(150, 9)))], "doc_id long, lang string, text string")
    q = quality.Quality(spark.createDataFrame(docs, "doc_id long, lang string, text string"), w)
    assert {r.doc_id for r in q.not_prose().collect()} == {*range(100, 110), 200, 202}
    assert max(r.outlier_score for r in q.scores().where("doc_id BETWEEN 100 AND 109").collect()) < 6
    assert [r.doc_id for r in quality.Quality(few, w).not_prose().collect()] == [300]


def test_papers_are_found_by_their_scores(spark, monkeypatch):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(corpus(), "doc_id long, lang string, text string")
    q = quality.Quality(d, spark.createDataFrame(WORDS, "lang string, word string"))
    want = {100 + k for k in range(len(JUNK))}
    # Whoever is no prose lies beyond its language's cut-off, and most others of this corpus don't.
    scored = q.scores().where("n_words > 0").collect()
    assert {r.doc_id for r in scored if r.prose_share < 0.5} == want
    assert all(r.outlier_score >= r.cut for r in scored if r.doc_id in want) and any(r.outlier_score < r.cut for r in scored)
    scores = quality.Quality.scores
    monkeypatch.setattr(quality.Quality, "scores", lambda self, *a: scores(self, *a).withColumn("outlier_score", F.lit(0.0)))
    assert q.not_prose().count() == 0


def test_tail_probabilities_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "ab"[k % 2], "s", float(v)) for k, v in enumerate(rng.integers(0, 9, 400))] + [(900 + k, "a", "t", 0.5) for k in range(50)]
    from ranksmith.session import Scratch

    df = spark.createDataFrame(rows, "row long, lang string, stat string, value double")
    for r in quality.tail_probabilities(df, Scratch(spark, "t")).collect():
        same = [x[3] for x in rows if (x[1], x[2]) == (r.k.lang, r.k.stat)]
        assert (r.tails.n, r.tails.below, r.tails.above, r.c) == (len(same), sum(v <= r.k.value for v in same), sum(v >= r.k.value for v in same), same.count(r.k.value))


def test_quality_of_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, lang string, text string")
    q = quality.Quality(d, spark.createDataFrame(WORDS, "lang string, word string"))
    assert q.scores().count() == 0 and q.not_prose().count() == 0
