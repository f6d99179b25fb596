"""SQL of operators that iterate: fixed points as recursive queries, folds in order of seq as list reductions.

Each says in plain steps what the operator's result must be; none follows the way the operator takes.
"""

from __future__ import annotations

from ranksmith.functions import math as fm
from ranksmith.operators import bandits
from ranksmith.plans import base


def loop(head: str, start: str, step: str, rounds: int, last: str, names: str = "e, x") -> str:
    """``step`` reads the rows of the round before from ``it``; ``last`` those of the last round from ``fin``."""
    return f"WITH RECURSIVE {head}, it AS (SELECT 0 k, {names} FROM ({start}) UNION ALL SELECT k + 1, {names} FROM ({step}) WHERE k < {rounds}), fin AS (SELECT * FROM it WHERE k = {rounds}) {last}"


def horner(cs, x: str) -> str:
    out = repr(float(cs[0])) + "::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def cdf(x: str) -> str:
    t = f"(1 / (1 + {fm.ERF_P} * abs({x}) * sqrt(0.5::DOUBLE)))"
    return f"((1 + sign({x}) * (1 - {horner([*reversed(fm.ERF_A), 0.0], t)} * exp(-({x}) * ({x}) / 2))) / 2)"


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"


_OUT = "SELECT e AS entity, round(x, 6) + 0.0 AS score FROM fin"
_LOGS = "SELECT e AS entity, round(ln(x) - avg(ln(x)) OVER (), 6) + 0.0 AS score FROM fin"
_ZERO = "SELECT e, 0.0::DOUBLE x FROM ent"
_ONE = "SELECT e, 1.0::DOUBLE x FROM ent"
ORACLE: dict[str, str] = {}

# -- strengths -----------------------------------------------------------------------------------------------------------

#: Who wins against whom, by the strengths' balance: what comes in equals what goes out.
_BALANCE = "SELECT p.k, a e, sum(ab * q.x / (p.x + q.x)) / sum(ba / (p.x + q.x)) x FROM dir JOIN it p ON a = p.e JOIN it q ON b = q.e GROUP BY p.k, a"
ORACLE["a8_ilsr"] = loop(base.OP, _ONE, _BALANCE, 300, _LOGS)
ORACLE["a4_team_bt"] = loop(base.OP, _ONE, _BALANCE, 300, "SELECT e AS entity, round(x / sum(x) OVER (), 6) + 0.0 AS score FROM fin")


def _centred(sums: str, mean: str, rounds: int, head: str, start: str = _ZERO, digits: int = 6) -> str:
    """Each value from the others, in turns, about a mean that is known."""
    return loop(head, start, f"SELECT k, e, y - avg(y) OVER () + {mean} x FROM ({sums})", rounds, _OUT.replace("6)", f"{digits})"))


ORACLE["b13_colley"] = _centred("SELECT q.k, a e, (1 + sum(ab - ba) / 2 + sum((ab + ba) * q.x)) / (2 + sum(ab + ba)) y FROM dir JOIN it q ON b = q.e GROUP BY q.k, a", "0.5", 300, base.OP, "SELECT e, 0.5::DOUBLE x FROM ent")
ORACLE["b14_hodge_rank"] = _centred("SELECT q.k, a e, sum((ab + ba) * (ln((ab + 0.5) / (ba + 0.5)) + q.x)) / sum(ab + ba) y FROM dir JOIN it q ON b = q.e GROUP BY q.k, a", "0", 300, base.OP)
ORACLE["b12_massey"] = _centred(
    "SELECT q.k, a e, sum(m + n * q.x) / sum(n) y FROM md JOIN it q ON b = q.e GROUP BY q.k, a", "0", 300,
    f"{base.OP}, mg AS (SELECT w a, l b, cents / 100.0::DOUBLE m FROM pw UNION ALL SELECT l, w, -cents / 100.0::DOUBLE FROM pw), md AS (SELECT a, b, sum(m) m, count(*) n FROM mg GROUP BY a, b)", digits=4)
#: The similarity of two is half of (all, plus the products of their signs against the third).
ORACLE["b15_serial_rank"] = loop(
    f"""{base.OP}, sg AS MATERIALIZED (SELECT a, b, sign(ab - ba) c FROM dir), own AS (SELECT e, (SELECT count(*) FROM ent)::DOUBLE n FROM ent),
    cc AS (SELECT x.a, y.a b, sum(x.c * y.c) s FROM sg x JOIN sg y ON x.b = y.b GROUP BY 1, 2), sm AS MATERIALIZED (SELECT p.e a, q.e b, (p.n + coalesce(s, 0)) / 2 s FROM own p CROSS JOIN own q LEFT JOIN cc ON cc.a = p.e AND cc.b = q.e),
    dg AS MATERIALIZED (SELECT a, sum(s) g FROM sm GROUP BY a), net AS MATERIALIZED (SELECT a e, sum(ab - ba) w FROM dir GROUP BY a)""",
    "SELECT e, w - avg(w) OVER () x FROM net",
    "SELECT k, e, z / sqrt(sum(z * z) OVER ()) x FROM (SELECT k, e, y - avg(y) OVER () z FROM (SELECT p.k, p.e, (2 * (SELECT max(g) FROM dg) - any_value(g)) * any_value(p.x) + sum(s * q.x) y FROM it p JOIN sm ON sm.a = p.e JOIN it q ON sm.b = q.e JOIN dg ON dg.a = p.e GROUP BY p.k, p.e))",
    3000, "SELECT e AS entity, round(x * sign((SELECT sum(f.x * w) FROM fin f JOIN net USING (e))), 6) + 0.0 AS score FROM fin")
_D, _ND = "(p.x - q.x)", "(q.x - p.x)"
ORACLE["a5_thurstone"] = loop(
    base.OP, _ZERO,
    f"""SELECT k, e, y - avg(y) OVER () x FROM (SELECT p.k, a e, any_value(p.x) + 0.5 * sum(ab * {pdf(_D)} / {cdf(_D)} - ba * {pdf(_D)} / {cdf(_ND)}) / sum((ab + ba) * {pdf(_D)} * {pdf(_D)} / ({cdf(_D)} * {cdf(_ND)})) y
    FROM dir JOIN it p ON a = p.e JOIN it q ON b = q.e GROUP BY p.k, a)""", 200, _OUT)  # fmt: skip
#: Side 1 is the smaller name. The advantage is settled with the new strengths of a round.
ORACLE["a3_generalized_bt"] = loop(
    f"{base.OP}, hv AS MATERIALIZED (SELECT i h, j v, wi x1, wi + wj t FROM un), won AS (SELECT w e, sum(x) s FROM op GROUP BY w)",
    "SELECT e, 1.0::DOUBLE x, 1.0::DOUBLE g FROM ent",
    """WITH den AS (SELECT e, sum(d) d FROM (SELECT h e, t * p.g / (p.g * p.x + q.x) d FROM hv JOIN it p ON h = p.e JOIN it q ON v = q.e UNION ALL SELECT v, t / (p.g * p.x + q.x) FROM hv JOIN it p ON h = p.e JOIN it q ON v = q.e) GROUP BY e),
    nw AS (SELECT e, s / d / sum(s / d) OVER () x FROM den JOIN won USING (e)), one AS (SELECT any_value(k) k, any_value(g) g FROM it)
    SELECT one.k, e, nw.x, (SELECT o.g * sum(x1) / sum(t * o.g * p.x / (o.g * p.x + q.x)) FROM hv JOIN nw p ON h = p.e JOIN nw q ON v = q.e CROSS JOIN one o GROUP BY o.g) g FROM nw CROSS JOIN one""", 300, _LOGS, "e, x, g")  # fmt: skip

_PL = (
    f"{base.BALLOT}, key AS (SELECT k, string_agg(n, '|' ORDER BY p) s FROM ballot GROUP BY k), many AS (SELECT s, min(k) k, count(*)::DOUBLE c FROM key GROUP BY s), bl AS MATERIALIZED (SELECT b.k, b.n, b.p, b.m, c FROM ballot b JOIN many USING (k)), won AS MATERIALIZED (SELECT n, sum(c) w FROM bl WHERE p < m - 1 GROUP BY n)",
    "SELECT DISTINCT n e, 1.0::DOUBLE x FROM ballot",
    """SELECT k, e, y / sum(y) OVER () x FROM (SELECT r.k, n e, any_value(w) / sum(u) y FROM (SELECT k, n, sum(CASE WHEN p < m - 1 THEN c / s ELSE 0 END) OVER (PARTITION BY bk ORDER BY p) u FROM
    (SELECT it.k, bl.k bk, n, p, m, c, sum(x) OVER (PARTITION BY bl.k ORDER BY p DESC) s FROM bl JOIN it ON n = e)) r JOIN won USING (n) GROUP BY r.k, n)""",
)
ORACLE["a7_plackett_luce"] = loop(*_PL, 120, "SELECT e AS entity, round(x, 6) + 0.0 AS score FROM fin")
ORACLE["a8_ilsr_rankings"] = loop(*_PL, 120, _LOGS)

# -- folds ---------------------------------------------------------------------------------------------------------------

_SEQ = "(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 10000000000 + pw.k) * 1000 + least(x.n_nationkey, y.n_nationkey) * 30 + greatest(x.n_nationkey, y.n_nationkey)"
_GAMES = f"""{base.PW}, gm AS (SELECT {_SEQ} seq, c_mktsegment league, year(o_orderdate) * 12 + month(o_orderdate) period, least(w, l) n1, greatest(w, l) n2, CASE WHEN w < l THEN x.n_nationkey ELSE y.n_nationkey END a, CASE WHEN w < l THEN y.n_nationkey ELSE x.n_nationkey END b, (CASE WHEN w < l THEN 1 ELSE -1 END) * pw.cents / 100.0::DOUBLE m
  FROM pw JOIN orders ON pw.k = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation x ON x.n_name = w JOIN nation y ON y.n_name = l)"""


def _elo(gain: str) -> str:
    d = f"32 * (CASE WHEN g.m > 0 THEN 1.0::DOUBLE WHEN g.m < 0 THEN 0.0 ELSE 0.5 END - 1 / (1 + pow(10.0::DOUBLE, (s.r[g.b + 1] - s.r[g.a + 1]) / 400))) * {gain}"
    return f"""WITH {_GAMES}, fl AS (SELECT league, list_reduce(list_prepend({{'r': [1500.0::DOUBLE for i in range(25)], 'a': 0, 'b': 0, 'm': 0.0::DOUBLE}}, list({{'r': NULL::DOUBLE[], 'a': a, 'b': b, 'm': m}} ORDER BY seq)),
      lambda s, g: {{'r': list_transform(s.r, lambda v, j: CASE WHEN j = g.a + 1 THEN v + {d} WHEN j = g.b + 1 THEN v - {d} ELSE v END), 'a': 0, 'b': 0, 'm': 0.0::DOUBLE}}) f FROM gm GROUP BY league),
    pl AS (SELECT DISTINCT league, e FROM (SELECT league, a e FROM gm UNION ALL SELECT league, b FROM gm))
    SELECT league, n_name AS entity, round(f.r[e + 1], 6) + 0.0 AS score FROM pl JOIN fl USING (league) JOIN nation ON n_nationkey = e"""


ORACLE["c1_elo"] = _elo("1")
ORACLE["c2_elo_mov"] = _elo("(CASE WHEN g.m = 0 THEN 1 ELSE ln(1 + abs(g.m)) / ln(2.0::DOUBLE) END)")


def _weng_lin(omega: str, delta: str) -> str:
    c = "sqrt(s.d[j] * s.d[j] + s.d[q.i] * s.d[q.i] + 2 * (25.0::DOUBLE / 6) * (25.0::DOUBLE / 6))"
    fill = lambda x: x.replace("$X", f"((s.u[j] - s.u[q.i]) / {c})").replace("$T", f"(0.1::DOUBLE / {c})").replace("$W", "sign(q.r - g.t[list_position(g.i, j)].r)").replace("$C", c).replace("$V", "(s.d[j] * s.d[j])")
    others = "list_filter(g.t, lambda q: q.i <> j)"
    row = "{{'u': {u}, 'd': {d}, 'i': {i}, 't': {t}}}"
    none = "[]::STRUCT(r BIGINT, i INTEGER)[]"
    return f"""WITH {base.NAT}, rk AS (SELECT k, n_nationkey + 1 i, rank() OVER (PARTITION BY k ORDER BY cents DESC) r, count(*) OVER (PARTITION BY k) m FROM nat JOIN nation ON n = n_name),
    mt AS (SELECT k, list({{'r': r, 'i': i::INTEGER}} ORDER BY i) t, list(i::BIGINT ORDER BY i) i FROM rk WHERE m > 1 GROUP BY k),
    fl AS (SELECT list_reduce(list_prepend({row.format(u='[25.0::DOUBLE for z in range(25)]', d='[25.0::DOUBLE / 3 for z in range(25)]', i='[]::BIGINT[]', t=none)}, list({row.format(u='NULL::DOUBLE[]', d='NULL::DOUBLE[]', i='i', t='t')} ORDER BY k)),
      lambda s, g: {row.format(
          u=f"list_transform(s.u, lambda v, j: CASE WHEN list_contains(g.i, j) THEN v + list_sum(list_transform({others}, lambda q: {fill(omega)})) ELSE v END)",
          d=f"list_transform(s.d, lambda v, j: CASE WHEN list_contains(g.i, j) THEN v * sqrt(greatest(1 - list_sum(list_transform({others}, lambda q: {fill(delta)})), 1e-4)) ELSE v END)",
          i='[]::BIGINT[]', t=none)}) f FROM mt)
    SELECT '' AS league, n_name AS entity, round(f.u[n_nationkey + 1] - 3 * f.d[n_nationkey + 1], 6) + 0.0 AS score FROM nation CROSS JOIN fl WHERE n_nationkey + 1 IN (SELECT i FROM rk WHERE m > 1)"""


_P = "(1 / (1 + exp(-$X)))"
ORACLE["c4_weng_lin"] = _weng_lin(f"$V / $C * (($W + 1) / 2 - {_P})", f"sqrt($V) / $C * $V / ($C * $C) * {_P} * (1 - {_P})")
_S = "173.7178::DOUBLE"
_F = "(exp(y) * (dl * dl - ph * ph - v - exp(y)) / (2 * (ph * ph + v + exp(y)) * (ph * ph + v + exp(y))) - (y - 2 * ln(sg)) / 0.25)"
ORACLE["c3_glicko2"] = loop(
    f"{_GAMES}, st AS (SELECT dense_rank() OVER (ORDER BY floor(period / 12)) yr, n1 e, n2 o, CASE WHEN m > 0 THEN 1.0::DOUBLE WHEN m < 0 THEN 0.0 ELSE 0.5 END s FROM gm UNION ALL SELECT dense_rank() OVER (ORDER BY floor(period / 12)), n2, n1, CASE WHEN m > 0 THEN 0.0 WHEN m < 0 THEN 1.0 ELSE 0.5 END FROM gm), gs AS MATERIALIZED (SELECT yr, e, o, s, count(*) c FROM st GROUP BY 1, 2, 3, 4)",
    "SELECT DISTINCT e, 1500.0::DOUBLE r, 350.0::DOUBLE d, 0.06::DOUBLE g FROM gs",
    f"""WITH j AS (SELECT p.k, p.e, s, c, (p.r - q.r) / {_S} df, 1 / sqrt(1 + 3 * q.d * q.d / ({_S} * {_S} * pi() * pi())) gj FROM it p JOIN gs ON gs.e = p.e AND gs.yr = p.k + 1 JOIN it q ON q.e = o),
    u AS (SELECT e, 1 / sum(c * gj * gj * h * (1 - h)) v, sum(c * gj * (s - h)) gn FROM (SELECT *, 1 / (1 + exp(-gj * df)) h FROM j) GROUP BY e),
    z AS (SELECT it.*, v, gn, v * gn dl, d / {_S} ph, g sg FROM it LEFT JOIN u USING (e)),
    w AS (SELECT *, list_reduce([{{'lo': 2 * ln(sg) - 60, 'hi': 2 * ln(sg) + 60, 'dl': dl, 'ph': ph, 'v': v, 'sg': sg}} for i in range(90)], lambda s, t: {{'lo': CASE WHEN {_F.replace('y', '((s.lo + s.hi) / 2)').replace('dl', 's.dl').replace('ph', 's.ph').replace(' v', ' s.v').replace('sg', 's.sg')} > 0 THEN (s.lo + s.hi) / 2 ELSE s.lo END, 'hi': CASE WHEN {_F.replace('y', '((s.lo + s.hi) / 2)').replace('dl', 's.dl').replace('ph', 's.ph').replace(' v', ' s.v').replace('sg', 's.sg')} > 0 THEN s.hi ELSE (s.lo + s.hi) / 2 END, 'dl': s.dl, 'ph': s.ph, 'v': s.v, 'sg': s.sg}}) b FROM z),
    n AS (SELECT *, exp(b.lo / 2) ns, 1 / sqrt(1 / (ph * ph + exp(b.lo)) + 1 / v) np FROM w)
    SELECT k, e, CASE WHEN v IS NULL THEN r ELSE r + {_S} * np * np * gn END r, CASE WHEN v IS NULL THEN d ELSE {_S} * np END d, CASE WHEN v IS NULL THEN g ELSE ns END g FROM n""",
    7, "SELECT e AS entity, round(r, 4) + 0.0 AS rating, round(d, 4) + 0.0 AS rd, round(g, 6) + 0.0 AS sigma FROM fin", "e, r, d, g")

_TYPES = "ty AS MATERIALIZED (SELECT e, row_number() OVER (ORDER BY e) j FROM (SELECT DISTINCT event_type e FROM events))"
ORACLE["t2_td_value"] = f"""WITH {base.STEP}, {_TYPES}, nx AS (SELECT step, state, reward, lead(state) OVER (PARTITION BY episode_id ORDER BY step) n FROM st), cd AS (SELECT step, a.j a, b.j b, reward FROM nx JOIN ty a ON a.e = state LEFT JOIN ty b ON b.e = n),
  fl AS (SELECT list_reduce(list_prepend({{'v': [0.0::DOUBLE for i in range((SELECT count(*) FROM ty))], 'a': 0::BIGINT, 'b': 0::BIGINT, 'r': 0.0::DOUBLE}}, list({{'v': NULL::DOUBLE[], 'a': a, 'b': b, 'r': reward}} ORDER BY step)),
    lambda s, g: {{'v': list_transform(s.v, lambda x, j: CASE WHEN j = g.a THEN x + 0.1 * (g.r + CASE WHEN g.b IS NULL THEN 0 ELSE s.v[g.b] END - x) ELSE x END), 'a': 0::BIGINT, 'b': 0::BIGINT, 'r': 0.0::DOUBLE}}) f FROM cd)
  SELECT e AS entity, round(f.v[j], 4) + 0.0 AS score, (SELECT count(*) FROM st WHERE state = e) AS n FROM ty CROSS JOIN fl"""

_ON = "(s.n[j] > 0 OR j = g.a)"
_TOP = f"list_max(list_transform(s.g, lambda v, j: CASE WHEN {_ON} THEN v END))"
_CHANCE = f"(0.9 * exp(x - {_TOP}) / list_sum(list_transform(s.g, lambda v, j: CASE WHEN {_ON} THEN exp(v - {_TOP}) ELSE 0 END)) + 0.1 / list_sum(list_transform(s.n, lambda v, j: CASE WHEN {_ON} THEN 1 ELSE 0 END)))"
ORACLE["e_bandit_exp3"] = f"""WITH {base.REWARD}, {_TYPES},
  fl AS (SELECT list_reduce(list_prepend({{'g': [0.0::DOUBLE for i in range((SELECT count(*) FROM ty))], 'n': [0::BIGINT for i in range((SELECT count(*) FROM ty))], 'a': 0::BIGINT, 'r': 0.0::DOUBLE}}, list({{'g': NULL::DOUBLE[], 'n': NULL::BIGINT[], 'a': j, 'r': reward::DOUBLE}} ORDER BY seq)),
    lambda s, g: {{'g': list_transform(s.g, lambda x, i: CASE WHEN i = g.a THEN x + 0.1 * g.r / {_CHANCE} / list_sum(list_transform(s.n, lambda v, j: CASE WHEN {_ON} THEN 1 ELSE 0 END)) ELSE x END), 'n': list_transform(s.n, lambda x, i: CASE WHEN i = g.a THEN x + 1 ELSE x END), 'a': 0::BIGINT, 'r': 0.0::DOUBLE}}) f FROM rw JOIN ty ON e = arm)
  SELECT e AS entity, f.n[j] AS n, round(0.9 * exp(f.g[j] - list_max(f.g)) / list_sum(list_transform(f.g, lambda v: exp(v - list_max(f.g)))) + 0.1 / len(f.g), 6) + 0.0 AS score FROM ty CROSS JOIN fl"""

# -- bisections ----------------------------------------------------------------------------------------------------------

_C = bandits.Bandit("kl-ucb").c
_KL = "(CASE WHEN p > 0 THEN p * ln(p / q) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * ln((1 - p) / (1 - q)) ELSE 0 END)"
ORACLE["e_bandit_kl_ucb"] = loop(
    f"{base.REWARD}, am AS (SELECT arm e, count(*) n, least(greatest(avg(reward), 0), 1) p FROM rw GROUP BY arm), tt AS (SELECT ln(sum(n)::DOUBLE) l FROM am), ar AS MATERIALIZED (SELECT e, n, p, (l + {_C} * ln(greatest(l, 1e-300))) / n b FROM am, tt)",
    "SELECT e, p lo, 1.0::DOUBLE hi FROM ar",
    f"SELECT k, e, CASE WHEN ok THEN q ELSE lo END lo, CASE WHEN ok THEN hi ELSE q END hi FROM (SELECT *, {_KL} <= b ok FROM (SELECT k, it.e, lo, hi, (lo + hi) / 2 q, p, b FROM it JOIN ar ON ar.e = it.e))",
    52, "SELECT e AS entity, n, round(lo, 6) + 0.0 AS score FROM fin JOIN ar USING (e)", "e, lo, hi")

_ODDS = "cc AS (SELECT n_regionkey g, n_name o, count(*) c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), oo AS (SELECT g, o, sum(c) OVER (PARTITION BY g) / (c * 1.05::DOUBLE) q FROM cc), od AS MATERIALIZED (SELECT g, o, 1 / q r, sum(1 / q) OVER (PARTITION BY g) b FROM oo WHERE q > 1)"


def _devig(prob: str, lo: float, hi: float, more: str) -> str:
    """``prob`` at ``y``; the sum over an event is above 1 on the side of ``more``."""
    return loop(
        _ODDS, f"SELECT DISTINCT g, {lo}::DOUBLE lo, {hi}::DOUBLE hi FROM od",
        f"SELECT k, g, CASE WHEN up THEN lo ELSE y END lo, CASE WHEN up THEN y ELSE hi END hi FROM (SELECT it.k, it.g, any_value(lo) lo, any_value(hi) hi, any_value((lo + hi) / 2) y, sum({prob.replace('y', '((lo + hi) / 2)')}) {more} 1 up FROM it JOIN od ON od.g = it.g GROUP BY it.k, it.g)",
        200, f"SELECT g AS event_id, o AS outcome, round({prob.replace('y', '((lo + hi) / 2)')}, 6) + 0.0 AS prob, round(b, 6) + 0.0 AS booksum FROM fin JOIN od USING (g)", "g, lo, hi")


ORACLE["f1_devig_power"] = _devig("exp(ln(r) / y)", 1e-12, 1.0, ">")
ORACLE["f1_devig_shin"] = _devig("((sqrt(y * y + 4 * (1 - y) * r * r / b) - y) / (2 * (1 - y)))", 0.0, 1 - 1e-9, "<")

#: Three-wide contexts: the inverse by cofactors.
_M = {"11": "n + 1", "12": "xd", "13": "xt", "22": "dd + 1", "23": "dt", "33": "tt + 1"}
_COF = {
    "i11": "(m22 * m33 - m23 * m23)", "i12": "(m13 * m23 - m12 * m33)", "i13": "(m12 * m23 - m13 * m22)",
    "i22": "(m11 * m33 - m13 * m13)", "i23": "(m12 * m13 - m11 * m23)", "i33": "(m11 * m22 - m12 * m12)",
}
ORACLE["e10_lin_ucb"] = f"""WITH s AS (SELECT l_returnflag e, count(*)::DOUBLE n, sum(l_discount) xd, sum(l_tax) xt, sum(l_discount * l_discount) dd, sum(l_discount * l_tax) dt, sum(l_tax * l_tax) tt, sum(l_quantity / 50) y1, sum(l_quantity / 50 * l_discount) y2, sum(l_quantity / 50 * l_tax) y3 FROM lineitem GROUP BY 1),
  c AS (SELECT 1.0::DOUBLE u1, sum(xd) / sum(n) u2, sum(xt) / sum(n) u3 FROM s), m AS (SELECT *, {', '.join(f'{v} m{k}' for k, v in _M.items())} FROM s), i AS (SELECT *, {', '.join(f'{v} {k}' for k, v in _COF.items())} FROM m),
  d AS (SELECT *, m11 * i11 + m12 * i12 + m13 * i13 det FROM i), h AS (SELECT *, (i11 * u1 + i12 * u2 + i13 * u3) / det h1, (i12 * u1 + i22 * u2 + i23 * u3) / det h2, (i13 * u1 + i23 * u2 + i33 * u3) / det h3 FROM d, c)
  SELECT e AS entity, round(h1 * y1 + h2 * y2 + h3 * y3 + sqrt(greatest(h1 * u1 + h2 * u2 + h3 * u3, 0)), 6) + 0.0 AS score FROM h"""

#: Games within a hundred are ties. The weight of ties is settled with the new strengths of a round.
ORACLE["a3_generalized_bt_ties"] = loop(
    f"{_GAMES}, hv AS MATERIALIZED (SELECT n1 h, n2 v, sum(CASE WHEN m >= 100 THEN 1.0::DOUBLE ELSE 0 END) x1, sum(CASE WHEN m <= -100 THEN 1.0::DOUBLE ELSE 0 END) x2, sum(CASE WHEN abs(m) < 100 THEN 1.0::DOUBLE ELSE 0 END) x0 FROM gm GROUP BY 1, 2), ent AS (SELECT h e FROM hv UNION SELECT v FROM hv), won AS (SELECT e, sum(s) s FROM (SELECT h e, x1 + x0 / 2 s FROM hv UNION ALL SELECT v, x2 + x0 / 2 FROM hv) GROUP BY e)",
    "SELECT e, 1.0::DOUBLE / (SELECT count(*) FROM ent) x, 0.5::DOUBLE g FROM ent",
    """WITH d0 AS (SELECT h, v, x1 + x2 + x0 t, p.x a, q.x b, p.g, p.x + q.x + p.g * sqrt(p.x * q.x) d FROM hv JOIN it p ON h = p.e JOIN it q ON v = q.e),
    den AS (SELECT e, sum(y) d FROM (SELECT h e, t * (1 + g * sqrt(b / a) / 2) / d y FROM d0 UNION ALL SELECT v, t * (1 + g * sqrt(a / b) / 2) / d FROM d0) GROUP BY e),
    nw AS (SELECT e, s / d / sum(s / d) OVER () x FROM den JOIN won USING (e)), one AS (SELECT any_value(k) k, any_value(g) g FROM it)
    SELECT one.k, e, nw.x, (SELECT sum(x0) / sum((x1 + x2 + x0) * sqrt(p.x * q.x) / (p.x + q.x + o.g * sqrt(p.x * q.x))) FROM hv JOIN nw p ON h = p.e JOIN nw q ON v = q.e CROSS JOIN one o) g FROM nw CROSS JOIN one""", 300, _LOGS, "e, x, g")  # fmt: skip

# -- graphs --------------------------------------------------------------------------------------------------------------

ORACLE["g7_harmonic"] = f"""WITH RECURSIVE {base.EDGE}, ar AS MATERIALIZED (SELECT DISTINCT s, d FROM ed WHERE s <> d),
  it(q, e, k) USING KEY (q, e) AS (SELECT e, e, 0 FROM nd UNION (SELECT DISTINCT f.q, d, f.k + 1 FROM it f JOIN ar ON s = f.e LEFT JOIN recurring.it r ON r.q = f.q AND r.e = d WHERE r.k IS NULL))
  SELECT e AS entity, round(sum(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END), 6) + 0.0 AS score FROM it GROUP BY e"""
#: Lengths are whole numbers by the nodes' keys; the shortest sums, found by relaxing until none falls.
ORACLE["g7_harmonic_lengths"] = """WITH RECURSIVE ar AS MATERIALIZED (SELECT a.n_name s, b.n_name d, 1.0::DOUBLE + (a.n_nationkey * 5 + b.n_nationkey) % 7 w FROM nation a JOIN nation b ON (a.n_nationkey + 1) % 25 = b.n_nationkey OR (a.n_nationkey * 7) % 25 = b.n_nationkey WHERE a.n_nationkey <> b.n_nationkey),
  it(q, e, x) USING KEY (q, e) AS (SELECT s, s, 0.0::DOUBLE FROM (SELECT s FROM ar UNION SELECT d FROM ar) UNION (SELECT f.q, d, min(f.x + w) FROM it f JOIN ar ON s = f.e LEFT JOIN recurring.it r ON r.q = f.q AND r.e = d WHERE r.x IS NULL OR f.x + w < r.x GROUP BY f.q, d))
  SELECT e AS entity, round(sum(CASE WHEN x > 0 THEN 1 / x ELSE 0 END), 6) + 0.0 AS score FROM it GROUP BY e"""
#: Teleports go to the seeds, and what sinks hold goes there too.
ORACLE["g1_page_rank_seeds"] = loop(
    f"{base.EDGE}, sd AS MATERIALIZED (SELECT nd.e, (CASE WHEN ends_with(nd.e, '3') THEN length(nd.e) ELSE 0 END)::DOUBLE / (SELECT sum(length(e)) FROM nd WHERE ends_with(e, '3')) t, (SELECT count(*) FROM nd)::DOUBLE n FROM nd), arc AS MATERIALIZED (SELECT s, d, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) p FROM ed), sk AS MATERIALIZED (SELECT e FROM nd WHERE e NOT IN (SELECT s FROM ed))",
    "SELECT e, t x FROM sd",
    "SELECT it.k, it.e, 0.15 * t + 0.85 * (coalesce(y, 0) + t * (SELECT coalesce(sum(x), 0) FROM it WHERE e IN (SELECT e FROM sk))) x FROM it JOIN sd ON sd.e = it.e LEFT JOIN (SELECT d e, sum(x * p) y FROM arc JOIN it ON s = e GROUP BY d) i ON i.e = it.e",
    10, "SELECT e AS entity, round(x, 6) + 0.0 AS score FROM fin")
_BI = "bi AS MATERIALIZED (SELECT l_suppkey s, o_custkey d, count(*)::DOUBLE w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), f AS MATERIALIZED (SELECT s, d, w / sqrt(sum(w) OVER (PARTITION BY s) * sum(w) OVER (PARTITION BY d)) f FROM bi), pu AS (SELECT l_suppkey s, count(*)::DOUBLE / 1000 q FROM lineitem GROUP BY 1)"
ORACLE["g5_birank_priors"] = f"""WITH {_BI}, u0 AS (SELECT s, 0.0::DOUBLE x FROM pu), """ + ", ".join(
    f"p{k + 1} AS MATERIALIZED (SELECT d, sum(f * x) x FROM f JOIN u{k} USING (s) GROUP BY d), u{k + 1} AS MATERIALIZED (SELECT s, 0.5 * sum(f * x) + 0.5 * any_value(q) x FROM f JOIN p{k + 1} USING (d) JOIN pu USING (s) GROUP BY s)" for k in range(40)
) + " SELECT 'src' AS side, CAST(s AS VARCHAR) AS entity, round(x, 5) + 0.0 AS score FROM u40 UNION ALL SELECT 'dst', CAST(d AS VARCHAR), round(x, 5) + 0.0 FROM p40"
ORACLE["g8_k_core"] = loop(
    f"{base.EDGE}, bo AS MATERIALIZED (SELECT s, d FROM ed WHERE s <> d UNION SELECT d, s FROM ed WHERE s <> d)",
    "SELECT s e, count(*) x FROM bo GROUP BY s",
    "SELECT k, s e, max(least(x, r)) x FROM (SELECT k, s, x, row_number() OVER (PARTITION BY s ORDER BY x DESC) r FROM bo JOIN it ON d = e) GROUP BY k, s",
    60, "SELECT nd.e AS entity, coalesce(x, 0)::DOUBLE AS score FROM nd LEFT JOIN fin USING (e)")
ORACLE["g9_components"] = """WITH RECURSIVE n AS (SELECT DISTINCT x FROM (SELECT src x FROM match_links WHERE dst IS NOT NULL UNION ALL SELECT dst FROM match_links WHERE src IS NOT NULL) WHERE x IS NOT NULL),
  e AS MATERIALIZED (SELECT src a, dst b FROM match_links WHERE src <> dst UNION SELECT dst, src FROM match_links WHERE src <> dst),
  cc(v, g) USING KEY (v) AS (SELECT x, x FROM n UNION (SELECT e.b, min(c.g) FROM cc c JOIN e ON e.a = c.v JOIN recurring.cc r ON r.v = e.b WHERE c.g < r.g GROUP BY e.b)),
  sz AS (SELECT g, count(*) size FROM cc GROUP BY g), nr AS (SELECT g, size, row_number() OVER (ORDER BY size DESC, g) - 1 c FROM sz)
  SELECT c AS component, size, v AS entity FROM cc JOIN nr USING (g)"""

# -- broken lines --------------------------------------------------------------------------------------------------------


def broken_lines(games: str, num: str) -> str:
    """The first field at fault and why, of the lines that ``games`` finds not ok."""

    def field(i: int, name: str, good: str, why: str) -> str:
        quoted = f"(CASE WHEN fs[{i}][1] = '\"' THEN regexp_full_match(fs[{i}], '\"([^\"]|\"\")*\"') ELSE NOT contains(fs[{i}], '\"') END)"
        value = f"(CASE WHEN fs[{i}][1] = '\"' THEN replace(fs[{i}][2:-2], '\"\"', '\"') ELSE fs[{i}] END)"
        return f"WHEN NOT {quoted} THEN '{name}/broken quoting' WHEN NOT {good.replace('$', value)} THEN '{name}/{why}'"

    player, number = "(len([y for y in string_split($, ' ') if y <> '']) > 0)", f"regexp_full_match($, '{num}')"
    cases = [field(1, "side1", player, "no player"), field(2, "side2", player, "no player"), field(3, "threshold", number, "not a number"), field(4, "count", f"(fs[4] IS NULL OR {number})", "not a number").replace("WHEN NOT (CASE", "WHEN fs[4] IS NOT NULL AND NOT (CASE", 1)]
    return games + f""", w AS (SELECT file_name, line_no, CASE WHEN s IS NULL THEN '/no line' WHEN NOT len(fs) BETWEEN 3 AND 4 THEN '/wrong number of fields' {' '.join(cases)}
      WHEN len(list_distinct(s1 || s2)) < len(s1 || s2) THEN 'side2/player twice' WHEN t IS NULL OR NOT isfinite(t) THEN 'threshold/not finite' WHEN c IS NULL OR NOT isfinite(c) THEN 'count/not finite' ELSE 'count/not above zero' END y FROM g WHERE NOT ok)
    SELECT file_name, line_no, nullif(split_part(y, '/', 1), '') AS broken_field, split_part(y, '/', 2) AS reason FROM w"""
