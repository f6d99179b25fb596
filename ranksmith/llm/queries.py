"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.llm.groups import match_groups
from ranksmith.llm.leaks import leaked_items
from ranksmith.llm.mixing import Mix
from ranksmith.llm.quality import Quality
from ranksmith.llm.votes import CommunityModel, luce_strengths, stronger_than
from ranksmith.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(table(spark, d, "match_links"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id").distinct()


def p4_strengths(spark: SparkSession, d: str) -> DataFrame:
    x = luce_strengths(table(spark, d, "annotated_pairs"))
    return x.select("item", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("strength", "won", "lost")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return stronger_than(luce_strengths(table(spark, d, "annotated_pairs")), table(spark, d, "anchor_items"))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return CommunityModel(table(spark, d, "annotated_pairs")).consensus()


def p5_annotators(spark: SparkSession, d: str) -> DataFrame:
    return CommunityModel(table(spark, d, "annotated_pairs")).reliability()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return CommunityModel(table(spark, d, "annotated_pairs")).unreliable()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("short").select("source")


def _quality(spark: SparkSession, d: str) -> Quality:
    return Quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).statistics.drop("row")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    x = p8_statistics(spark, d)
    share = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")]
    return x.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *share)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).scores()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).not_prose()


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_strengths": p4_strengths, "p5_found": p5_found, "p5_consensus": p5_consensus, "p5_annotators": p5_annotators, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_counts": p8_counts, "p8_scores": p8_scores, "p8_statistics": p8_statistics}

#: Labels go along links until none falls; each round only those that fell.
_GROUPS = """WITH RECURSIVE n AS (SELECT DISTINCT x FROM (SELECT src x FROM match_links UNION ALL SELECT dst FROM match_links) WHERE x IS NOT NULL),
e AS MATERIALIZED (SELECT src a, dst b FROM match_links WHERE src <> dst UNION SELECT dst, src FROM match_links WHERE src <> dst),
cc(v, g) USING KEY (v) AS (SELECT x, x FROM n UNION
  (SELECT e.b, min(c.g) FROM cc c JOIN e ON e.a = c.v JOIN recurring.cc r ON r.v = e.b WHERE c.g < r.g GROUP BY e.b))
SELECT g AS group_name, v AS record_name FROM cc"""

_EDGES = "'.,;:!?()[]{}\"«»“”„’‘…-–—*¶' || chr(39)"
_COUNTS = f"""WITH d AS (SELECT doc_id, text, [w for w in regexp_split_to_array(lower(text), '[\\s\\pZ]+') if w <> ''] ws, [rtrim(x, ' ' || chr(9) || chr(13)) for x in string_split(text, chr(10))] ls FROM documents),
c AS (SELECT *, [trim(w, {_EDGES}) for w in ws] bare, [x for x in ls if x <> ''] lines FROM d),
l AS (SELECT lang, list(word) known FROM common_words GROUP BY lang),
k AS (SELECT doc_id, max(len([w for w in bare if list_contains(known, w)])) best FROM c, l GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) / len(ws), 6) AS mean_word_length,
  round((length(text) - length(regexp_replace(text, '[^\\pL\\pN\\s\\pZ]', '', 'g'))) / length(text), 6) AS symbol_ratio,
  round(len([x for x in lines if regexp_matches(x, '([.!?:;…]|[.][)"”’»])$')]) / len(lines), 6) AS punctuated_lines,
  round(best / len(ws), 6) AS common_share
FROM c JOIN k USING (doc_id)"""

#: The first loaded row of each vote, the sums of each ordered pair, and one virtual item that everybody wins and loses against a little.
_VOTES = """v AS (SELECT seq, arg_min({'a': annotator, 'w': winner, 'l': loser, 'x': coalesce(weight, 1)}, loaded_at) s FROM annotated_pairs WHERE seq IS NOT NULL GROUP BY seq)"""
_STRENGTHS = f"""WITH RECURSIVE {_VOTES}, op AS (SELECT s.w w, s.l l, sum(s.x) x FROM v WHERE s.w <> s.l AND s.x > 0 AND isfinite(s.x) GROUP BY 1, 2),
tl AS (SELECT e, sum(w) won, sum(l) lost FROM (SELECT w e, x w, 0 l FROM op UNION ALL SELECT l, 0, x FROM op) GROUP BY e),
ar AS MATERIALIZED (SELECT a, b, sum(ab) ab, sum(ba) ba FROM (SELECT w a, l b, x ab, 0 ba FROM op UNION ALL SELECT l, w, 0, x FROM op UNION ALL SELECT e, chr(0), 0.01, 0.01 FROM tl UNION ALL SELECT chr(0), e, 0.01, 0.01 FROM tl) GROUP BY a, b),
it AS (SELECT 0 k, a e, 1.0::DOUBLE x FROM ar GROUP BY a UNION ALL SELECT k + 1, e, x / exp(avg(ln(x)) OVER ()) FROM (SELECT p.k, a e, sum(ab * q.x / (p.x + q.x)) / sum(ba / (p.x + q.x)) x FROM ar JOIN it p ON a = p.e JOIN it q ON b = q.e WHERE p.k < 600 GROUP BY p.k, a)),
st AS (SELECT e item, ln(x) - avg(ln(x)) OVER () strength FROM it WHERE k = 600 AND e <> chr(0))"""
_TOKENS = """WITH d AS (SELECT source, len(regexp_split_to_array(trim(text), '\\s+'))::DOUBLE n FROM documents WHERE text IS NOT NULL), s AS (SELECT source, sum(n) n FROM d GROUP BY source)
SELECT t.source FROM (SELECT source, sum(target_share) share, max(max_repeats) times FROM mix_targets WHERE source IS NOT NULL GROUP BY source) t LEFT JOIN s USING (source) WHERE coalesce(n, 0) * times < share * (SELECT sum(n) FROM d)"""



def _digamma(x: str) -> str:
    """By the recurrence eight steps up, and the asymptotic series there."""
    y = f"({x} + 8)"
    down = " + ".join(f"1 / ({x} + {k})" for k in range(8))
    return f"(ln({y}) - 0.5 / {y} - (1 / 12.0::DOUBLE - (1 / 120.0::DOUBLE - (1 / 252.0::DOUBLE - 1 / 240.0::DOUBLE / ({y} * {y})) / ({y} * {y})) / ({y} * {y})) / ({y} * {y}) - ({down}))"


def _unreliable(rounds: int, k: int = 6) -> str:
    """The community model round by round: sums by annotator, memberships, matrices, and the pairs' chances."""
    sums = "AS MATERIALIZED (SELECT a, said, c.p, c, q FROM c JOIN q{i} USING (p)), n{i} AS MATERIALIZED (SELECT a, sum(CASE WHEN said = 0 THEN c * (1 - q) ELSE 0 END) n00, sum(CASE WHEN said = 1 THEN c * (1 - q) ELSE 0 END) n01, sum(CASE WHEN said = 0 THEN c * q ELSE 0 END) n10, sum(CASE WHEN said = 1 THEN c * q ELSE 0 END) n11 FROM x{i} GROUP BY a)"
    totals = "AS MATERIALIZED (SELECT m, sum(r) z, sum(r * n00) c00, sum(r * n01) c01, sum(r * n10) c10, sum(r * n11) c11 FROM {r} JOIN n{i} USING (a) GROUP BY m)"
    member = "AS MATERIALIZED (SELECT a, m, s / sum(s) OVER (PARTITION BY a) r, e00, e01, e10, e11 FROM (SELECT *, exp(l - max(l) OVER (PARTITION BY a)) s FROM (SELECT a, m, rho + n00 * e00 + n01 * e01 + n10 * e10 + n11 * e11 l, e00, e01, e10, e11 FROM n{i} CROSS JOIN e{j})))"
    sql = f"""WITH {_VOTES}, w AS (SELECT s.a a, least(s.w, s.l) lo, greatest(s.w, s.l) hi, s.w > s.l up FROM v WHERE s.a IS NOT NULL AND s.w <> s.l AND s.w IS NOT NULL AND s.l IS NOT NULL),
c AS MATERIALIZED (SELECT a, p, said, count(*)::DOUBLE c FROM (SELECT a, lo || chr(1) || hi p, CASE WHEN up <> (md5(lo || chr(1) || hi) >= '8') THEN 1 ELSE 0 END said FROM w) GROUP BY ALL),
q0 AS MATERIALIZED (SELECT p, least(greatest(sum(c * said) / sum(c), 0.05), 0.95) q FROM c GROUP BY p), x0 {sums.format(i=0)}, ce AS (SELECT m, 0.15 + 0.8 * m / {k - 1} ce FROM range({k}) t(m)),
r0 AS MATERIALIZED (SELECT a, m, s / sum(s) OVER (PARTITION BY a) r FROM (SELECT a, m, exp(-pow((n00 + n11 + 2) / (n00 + n01 + n10 + n11 + 3) - ce, 2) / 0.02) s FROM n0, ce)), t0 {totals.format(r="r0", i=0)}"""
    lean = {"00": 1.3, "01": 0.7, "10": 0.7, "11": 1.3}
    e = ", ".join(f"{_digamma(f'(c{t}{j} + {lean[t + j]})')} - {_digamma(f'(c{t}0 + c{t}1 + 2)')} e{t}{j}" for t in "01" for j in "01")
    for i in range(rounds):
        sql += f""", e{i} AS MATERIALIZED (SELECT m, {_digamma("(z + 1)")} - {_digamma(f"((SELECT sum(z) FROM t{i}) + {k})")} rho, {e} FROM t{i}), m{i} {member.format(i=i, j=i)},
g{i} AS (SELECT a, sum(r * (e10 - e00)) g0, sum(r * (e11 - e01)) g1 FROM m{i} GROUP BY a), q{i + 1} AS MATERIALIZED (SELECT p, 1 / (1 + exp(-sum(c * CASE WHEN said = 1 THEN g1 ELSE g0 END))) q FROM c JOIN g{i} USING (a) GROUP BY p),
x{i + 1} {sums.format(i=i + 1)}, y{i} {member.format(i=i + 1, j=i)}, t{i + 1} {totals.format(r=f"y{i}", i=i + 1)}"""
    return sql + f" SELECT a AS annotator FROM x{rounds} GROUP BY a HAVING sum(c) >= 20 AND 3 * sum(c * CASE WHEN q = 0.5 THEN 0.5 WHEN (q > 0.5) = (said = 1) THEN 1 ELSE 0 END) < 2 * sum(c)"


ORACLE: dict[str, str] = {
    "p1_found": _GROUPS,
    "p4_strengths": _STRENGTHS + " SELECT item, round(strength, 6) + 0.0 AS strength, round(won, 6) + 0.0 AS won, round(lost, 6) + 0.0 AS lost FROM st JOIN tl ON e = item",
    "p4_found": _STRENGTHS + " SELECT item FROM st WHERE strength > (SELECT s.strength FROM st s JOIN anchor_items a ON a.item = s.item AND a.is_yardstick)",
    "p5_found": _unreliable(40),
    # Any common tokenizer gives the same answer: here, words.
    "p7_found": _TOKENS,
    "p8_counts": _COUNTS,
}
