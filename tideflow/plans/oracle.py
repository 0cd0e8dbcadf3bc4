"""SQL that gives the rows of the registered queries, built from shared table expressions."""

from __future__ import annotations

import re

LAGS = 20
_MOVES = ", ".join(f"({t})" for t in (1, 2, 4, 8, 16, 32, 64))
_CTE: dict[str, str] = {}

# bars
_CTE["ev"] = """SELECT 'events' AS series, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, ts, event_id, hour(ts) AS hour, ts::DATE AS day, value AS volume,
  CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE -value END AS flow, event_type IN ('purchase', 'signup') AS buy FROM events"""
_CTE["eh0"] = """SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  sum(value) AS volume, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END) AS tb_base, count(*)::DOUBLE AS trades FROM events GROUP BY 1"""
_CTE["eh"] = "SELECT 'events' AS series, *, row_number() OVER (ORDER BY ts) - 1 AS idx FROM eh0"
_CTE["ld0"] = """SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS volume, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS tb_base,
  count(*)::DOUBLE AS trades, sum(l_extendedprice) / sum(l_quantity) AS open FROM lineitem GROUP BY 1"""
_CTE["ld1"] = "SELECT *, lead(open) OVER (ORDER BY ts) AS close FROM ld0"
_CTE["ld"] = "SELECT 'lineitem' AS series, row_number() OVER (ORDER BY ts) - 1 AS idx, * FROM ld1 WHERE close IS NOT NULL"
_IMB = "CASE WHEN volume > 0 THEN greatest(-1, least(1, (2 * tb_base - volume) / volume)) ELSE 0 END"
_CTE["x"] = f"SELECT series, idx, {_IMB} AS x, ln(open) AS p FROM ld"
_CTE["r"] = "SELECT series, idx, r FROM (SELECT series, idx, lead(ln(close)) OVER (ORDER BY idx) - ln(close) AS r FROM ld) WHERE r IS NOT NULL"

# block sums
_CTE["tg"] = f"SELECT * FROM (VALUES {_MOVES}) v(T)"
_CTE["q"] = "SELECT series, T, idx // T AS block, sum(x) AS q FROM x, tg GROUP BY 1, 2, 3 HAVING count(*) = T"
_CTE["qm"] = "SELECT series, T, avg(q) AS m, count(*)::DOUBLE AS n FROM q GROUP BY 1, 2"
_CTE["qs"] = "SELECT series, T, n, m, sum((q - m) ** 2) AS s2, sum((q - m) ** 3) AS s3, sum((q - m) ** 4) AS s4 FROM q JOIN qm USING (series, T) GROUP BY 1, 2, 3, 4"
_CTE["k"] = """SELECT series, T, n, m AS k1, s2 / (n - 1) AS k2, n * s3 / ((n - 1) * (n - 2)) AS k3,
  (n * (n + 1) * s4 - 3 * (n - 1) * s2 * s2) / ((n - 1) * (n - 2) * (n - 3)) AS k4 FROM qs WHERE n >= 30"""


def _slope_error(y: str, x: str) -> str:
    return f"sqrt(greatest(regr_syy({y}, {x}) - regr_sxy({y}, {x}) ** 2 / regr_sxx({y}, {x}), 0) / (greatest(count(*) - 2, 1) * regr_sxx({y}, {x})))"


# symmetry
def _symmetry(table: str, keys: str, least: int) -> str:
    return f"""SELECT {keys}, bin, w * (bin + 0.5) AS centre, ln(p / m) AS s, sqrt(1.0 / p + 1.0 / m) AS se FROM (
  SELECT {keys}, w, bin, count(*) FILTER (WHERE q > 0)::DOUBLE AS p, count(*) FILTER (WHERE q < 0)::DOUBLE AS m FROM (
    SELECT t.*, w, b AS bin FROM {table} t JOIN (SELECT {keys}, quantile_cont(abs(q), 0.99) / 15 AS w, count(*) AS rows FROM {table} WHERE q IS NOT NULL GROUP BY ALL) e USING ({keys}), range(15) g(b)
    WHERE w > 0 AND rows >= {4 * least} AND q <> 0 AND abs(q) > w * b AND abs(q) <= w * (b + 1)) GROUP BY ALL) WHERE p >= {least} AND m >= {least}"""


def _affinity(sym: str, keys: str) -> str:
    return f"""SELECT {keys}, n_bins, CASE WHEN n_bins >= 3 THEN qs / q2 END AS a, CASE WHEN n_bins >= 3 THEN 1 / sqrt(q2) END AS se_a,
  CASE WHEN n_bins >= 3 THEN (ss - qs * qs / q2) / (n_bins - 1) END AS chi2_dof, CASE WHEN n_bins >= 4 THEN (q2 * q3s - q4 * qs) / (q2 * q6 - q4 * q4) END AS c3,
  CASE WHEN n_bins >= 4 THEN sqrt(greatest(q2 / (q2 * q6 - q4 * q4), 0)) END AS se_c3 FROM (
  SELECT {keys}, count(*) AS n_bins, sum(w * c * c) AS q2, sum(w * c ** 4) AS q4, sum(w * c ** 6) AS q6, sum(w * c * s) AS qs, sum(w * c ** 3 * s) AS q3s, sum(w * s * s) AS ss
  FROM (SELECT {keys}, centre AS c, s, 1 / (se * se) AS w FROM {sym}) GROUP BY {keys})"""


_CTE["q1"] = "SELECT * FROM q WHERE T = 1"
_CTE["sym"] = _symmetry("q1", "series, T", 10)
_CTE["fit"] = _affinity("sym", "series, T")
_CTE["q3"] = "SELECT * FROM q WHERE T IN (1, 4, 16)"
_CTE["sym3"] = _symmetry("q3", "series, T", 3)
_CTE["fit3"] = _affinity("sym3", "series, T")

# lag correlations
_CTE["lags"] = f"SELECT lag::INT AS lag FROM range(1, {LAGS + 1}) t(lag)"
_CTE["xc"] = "SELECT series, idx, p, x - avg(x) OVER () AS c, var_pop(x) OVER () AS v FROM x"
_CTE["acf"] = "SELECT a.series, lag, CASE WHEN count(*) > 30 THEN avg(a.c * b.c) / max(a.v) END AS c, count(*) AS pairs FROM xc a, lags JOIN xc b ON b.idx = a.idx + lag GROUP BY 1, 2"
_CTE["resp"] = "SELECT a.series, lag, CASE WHEN count(*) > 30 THEN avg((b.p - a.p) * a.c) / max(a.v) END AS r, count(*) AS pairs FROM xc a, lags JOIN xc b ON b.idx = a.idx + lag GROUP BY 1, 2"


def _teff(keys: str, resp: str, acf: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY lag)"
    return f"""SELECT {keys}, lag, r, c, CASE WHEN abs(r) > 1e-12 THEN -dc / r END AS t_eff FROM (SELECT {keys}, lag, r, c,
  CASE WHEN lag(lag) {w} IS NULL THEN lead(c) {w} - c WHEN lead(lag) {w} IS NULL THEN c - lag(c) {w} ELSE (lead(c) {w} - lag(c) {w}) / 2 END AS dc
  FROM {resp} JOIN {acf} USING ({keys}, lag))"""


_CTE["teff"] = _teff("series", "resp", "acf")
_CTE["ends"] = "SELECT e.t AS t_w FROM range(499, 1000000, 250) e(t) WHERE e.t <= (SELECT max(idx) FROM x)"
_CTE["wx"] = "SELECT t_w, idx, p, x - avg(x) OVER (PARTITION BY t_w) AS c, var_pop(x) OVER (PARTITION BY t_w) AS v FROM ends JOIN x ON idx BETWEEN t_w - 499 AND t_w"
_CTE["wacf"] = "SELECT a.t_w, lag, avg(a.c * b.c) / max(a.v) AS c FROM wx a, lags JOIN wx b ON b.t_w = a.t_w AND b.idx = a.idx + lag GROUP BY 1, 2"
_CTE["wresp"] = "SELECT a.t_w, lag, avg((b.p - a.p) * a.c) / max(a.v) AS r FROM wx a, lags JOIN wx b ON b.t_w = a.t_w AND b.idx = a.idx + lag GROUP BY 1, 2"
_CTE["wteff"] = _teff("t_w", "wresp", "wacf")
_CTE["wviol"] = "SELECT 'lineitem' AS series, t_w, stddev_pop(t_eff) / quantile_cont(abs(t_eff), 0.5) AS v, quantile_cont(abs(t_eff), 0.5) AS level FROM wteff GROUP BY t_w"
_CTE["evd"] = "SELECT series, idx, flow - avg(flow) OVER (PARTITION BY hour) AS x FROM ev"
_CTE["evc"] = "SELECT series, idx, x - avg(x) OVER () AS c, var_pop(x) OVER () AS v FROM evd"

# two-time surface: direct sums over each window
_CTE["sl"] = "SELECT lag::INT AS lag FROM range(1, 11) t(lag)"
_CTE["a"] = "SELECT series, idx, abs(r) AS x FROM r"
_CTE["win"] = "SELECT series, idx AS t_w, x, list(x) OVER (ORDER BY idx ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS xs FROM a"
_CTE["winc"] = "SELECT series, t_w, list_transform(xs, lambda v: v - list_avg(xs)) AS d FROM win WHERE t_w >= 249"
_CTE["surf"] = """SELECT series, t_w, t_w - 249 AS k, lag, list_sum(list_transform(range(1, 251 - lag), lambda i: d[i] * d[i + lag])) / list_sum(list_transform(d, lambda v: v * v)) AS rho
  FROM winc, sl"""
_CTE["surf50"] = "SELECT * FROM surf WHERE k % 50 = 0"
_CTE["tau"] = """SELECT series, t_w, CASE WHEN cut IS NULL OR cut > 1 THEN (SELECT sum(rho) FROM surf s WHERE s.t_w = c.t_w AND (cut IS NULL OR s.lag < cut)) END AS tau
  FROM (SELECT series, t_w, min(lag) FILTER (WHERE rho <= 0) AS cut FROM surf GROUP BY 1, 2) c"""
_CTE["mus"] = "SELECT * FROM (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) v(mu)"
_CTE["age0"] = "SELECT series, mu, rho, lag / pow(t_w, mu) AS x FROM surf50, mus"
_CTE["age1"] = f"SELECT series, mu, quantile_cont(x, [{', '.join(f'{i}/30::DOUBLE' for i in range(31))}]) AS e FROM age0 GROUP BY 1, 2"
_CTE["age2"] = "SELECT series, mu, rho, least(greatest(len(list_filter(e, lambda v: v <= x)) - 1, 0), 29) AS bin FROM age0 JOIN age1 USING (series, mu)"
_CTE["aging"] = "SELECT series, mu, sum(ss) / sum(n) AS residual FROM (SELECT series, mu, bin, var_pop(rho) * count(*) AS ss, count(*) AS n FROM age2 GROUP BY 1, 2, 3) GROUP BY 1, 2"

# volatility
_CTE["rv"] = """SELECT series, idx, CASE WHEN idx < n - 5 THEN sqrt(avg(r * r) OVER (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) END AS rv
  FROM (SELECT *, count(*) OVER () AS n FROM r)"""
_CTE["ew"] = """SELECT 0::BIGINT AS idx, (SELECT var_pop(r) FROM r WHERE idx < 50) AS v UNION ALL
  SELECT ew.idx + 1, 0.94 * v + (1 - 0.94) * r * r FROM ew JOIN r ON r.idx = ew.idx WHERE ew.idx < (SELECT max(idx) FROM r)"""
_CTE["ewma"] = "SELECT series, idx, r, sqrt(v) AS sigma FROM ew JOIN r USING (idx)"
_CTE["ga"] = """SELECT 0::BIGINT AS idx, 2e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.90::DOUBLE) AS v UNION ALL
  SELECT ga.idx + 1, 2e-6::DOUBLE + 0.05::DOUBLE * r * r + 0.90::DOUBLE * v FROM ga JOIN r ON r.idx = ga.idx WHERE ga.idx < (SELECT max(idx) FROM r)"""
_CTE["garch"] = "SELECT series, idx, r, sqrt(v) AS sigma FROM ga JOIN r USING (idx)"
_QL = "CASE WHEN rv > 0 AND {s} > 0 THEN rv * rv / ({s} * {s}) - ln(rv * rv / ({s} * {s})) - 1 END"


def _dm(losses: str, horizon: int = 5) -> str:
    """series, n, m, dm of (idx, la, lb)."""
    lags = "".join(f" + 2 * (1 - {k} / {horizon}::DOUBLE) * coalesce(sum(c * c{k}), 0) / n" for k in range(1, horizon))
    cols = "".join(f", lag(c, {k}) OVER (ORDER BY idx) AS c{k}" for k in range(1, horizon))
    return f"""SELECT 'lineitem' AS series, n, m, m / sqrt(CASE WHEN lrv > 0 THEN lrv WHEN g0 > 0 THEN g0 ELSE 1e-12 END / n) AS dm FROM (
  SELECT n, m, sum(c * c) / n AS g0, sum(c * c) / n{lags} AS lrv FROM (SELECT *{cols} FROM (
    SELECT idx, la - lb - avg(la - lb) OVER () AS c, avg(la - lb) OVER () AS m, count(*) OVER () AS n FROM {losses} WHERE la - lb IS NOT NULL)) GROUP BY n, m)"""


_CTE["l1"] = f"SELECT idx, {_QL.format(s='e.sigma')} AS la, {_QL.format(s='g.sigma')} AS lb FROM ewma e JOIN rv USING (idx) JOIN garch g USING (idx)"
_CTE["dm1"] = _dm("l1")
_CTE["l2"] = f"SELECT idx, {_QL.format(s='e.sigma')} AS la, {_QL.format(s='(1.1 * e.sigma)')} AS lb FROM ewma e JOIN rv USING (idx)"
_CTE["dm2"] = _dm("l2")
# the normal density integrated by Simpson's rule, up to 10, beyond which erfc is below 1e-44
_ERFC = "2 / sqrt(pi()) * (10 - z) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-((z + (10 - z) * i / 2000) ** 2))))"
_CTE["cut"] = "SELECT count(*) AS n, floor(count(*) * 0.6::DOUBLE)::BIGINT AS cut FROM r"
_CTE["tt0"] = "SELECT series, idx, rv / sigma AS ratio, idx < greatest(cut - 5, 0) AS train FROM ewma JOIN rv USING (series, idx), cut"
_CTE["tt"] = "SELECT series, idx, ratio, (SELECT quantile_cont(ratio, 0.8) FROM tt0 WHERE train) AS theta FROM tt0"


def _standard(rows: str) -> str:
    """Adds x to rows (train, v)."""
    return f"""SELECT t.*, (c - m) / s AS x FROM (SELECT *, avg(CASE WHEN train THEN c END) OVER () AS m, stddev_pop(CASE WHEN train THEN c END) OVER () AS s FROM (
  SELECT t.*, CASE WHEN v = 0 THEN lo WHEN v > 0 THEN greatest(least(ln(v), hi), lo) END AS c
  FROM {rows} t, (SELECT quantile_cont(ln(v), 0.01) AS lo, quantile_cont(ln(v), 0.99) AS hi FROM {rows} WHERE train AND v > 0))) t"""


_CTE["ws0"] = "SELECT series, idx, volume AS v, idx < greatest((SELECT floor(count(*) * 0.6::DOUBLE) FROM ld) - 5, 0) AS train FROM ld"
_CTE["ws"] = _standard("ws0")
_CTE["fc0"] = "SELECT e.series, e.idx, e.sigma, rv, volume AS v, e.idx < greatest(cut - 5, 0) AS train, e.idx >= cut AS oos FROM ewma e JOIN rv USING (idx) LEFT JOIN ld ON ld.idx = e.idx, cut"
_CTE["fc1"] = _standard("fc0")
_CTE["fc"] = "SELECT *, ln(rv) AS y, ln(sigma) AS ls FROM fc1 WHERE rv > 0 AND sigma > 0 AND x IS NOT NULL"
_CTE["fb0"] = "SELECT count(*) AS n_train, avg(ls) AS ml, avg(x) AS mx, avg(y) AS my, covar_pop(ls, ls) AS ll, covar_pop(ls, x) AS lx, covar_pop(x, x) AS xx, covar_pop(ls, y) AS ly, covar_pop(x, y) AS xy FROM fc WHERE train"
_CTE["fb"] = "SELECT *, ly / ll AS b, (xx * ly - lx * xy) / (ll * xx - lx * lx) AS b1, (ll * xy - lx * ly) / (ll * xx - lx * lx) AS b2 FROM fb0"
_CTE["fo"] = "SELECT idx, rv, x, y, sigma, exp(my - b * ml + b * ls) AS s1, exp(my - b1 * ml - b2 * mx + b1 * ls + b2 * x) AS s2 FROM fc, fb WHERE oos"
_CTE["fq"] = f"SELECT idx, x, y, {_QL.format(s='sigma')} AS q0, {_QL.format(s='s1')} AS q1, {_QL.format(s='s2')} AS q2 FROM fo"
_CTE["fl1"] = "SELECT idx, q0 AS la, q1 AS lb FROM fq"
_CTE["fl2"] = "SELECT idx, q1 AS la, q2 AS lb FROM fq"
_CTE["fd1"] = _dm("fl1")
_CTE["fd2"] = _dm("fl2")

# events
_CTE["ratio"] = "SELECT series, idx, abs(r) / sigma AS ratio, count(*) OVER () AS n FROM ewma"
_CTE["thr"] = "SELECT quantile_cont(ratio, 0.97) AS threshold FROM ratio"
_CTE["cand"] = "SELECT series, idx, ratio, threshold FROM ratio, thr WHERE ratio > threshold AND idx >= 50 AND idx < n - 60"
_CTE["sh"] = "SELECT min(idx) AS idx FROM cand UNION ALL SELECT (SELECT min(c.idx) FROM cand c WHERE c.idx >= sh.idx + 60) FROM sh WHERE sh.idx IS NOT NULL"
_CTE["shock"] = "SELECT 'lineitem' AS series, idx FROM sh WHERE idx IS NOT NULL"
_CTE["field"] = """SELECT s.series, s.idx AS shock, u::INT AS u, abs(b.r) / a.sigma AS w FROM shock s JOIN ewma a ON a.idx = s.idx, range(1, 41) g(u)
  JOIN ewma b ON b.idx = s.idx + u WHERE s.idx + 40 <= (SELECT max(idx) FROM r)"""
_CTE["ens"] = "SELECT series, u, avg(w) AS m, stddev_samp(w) AS sd, count(*) AS n FROM field GROUP BY 1, 2"
_CTE["dw"] = "SELECT shock, u, w - m AS dw, sd FROM field JOIN ens USING (u)"
_CTE["age"] = """SELECT 'lineitem' AS series, age_bin, lag, avg(rho) AS rho, count(*) AS n_ages FROM (
  SELECT a.u, lag, avg(a.dw * b.dw) / (max(a.sd) * max(b.sd)) AS rho, CASE WHEN a.u - 1 < 5 THEN 0 WHEN a.u - 1 < 10 THEN 1 WHEN a.u - 1 < 20 THEN 2 WHEN a.u - 1 < 30 THEN 3 END AS age_bin
  FROM dw a, sl JOIN dw b ON b.shock = a.shock AND b.u = a.u + lag GROUP BY a.u, lag HAVING count(*) >= 5) WHERE age_bin IS NOT NULL GROUP BY 2, 3"""
_CTE["atau"] = """SELECT series, age_bin, CASE WHEN cut IS NULL OR cut > 1 THEN (SELECT sum(rho) FROM age s WHERE s.age_bin = c.age_bin AND (cut IS NULL OR s.lag < cut)) END AS tau
  FROM (SELECT series, age_bin, min(lag) FILTER (WHERE rho <= 0) AS cut FROM age GROUP BY 1, 2) c"""
_U32 = "('0x' || substr(md5({k}), 1, 8))::BIGINT"
_CTE["bs0"] = "SELECT shock, row_number() OVER (ORDER BY shock) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT shock FROM field)"
_CTE["bs"] = f"""SELECT 0::BIGINT AS draw, shock, 1 AS weight FROM bs0 UNION ALL
  SELECT draw, b.shock, count(*) FROM (SELECT draw, {_U32.format(k="'7:' || draw || ':' || k")} % n AS pick FROM bs0, range(1, 21) g(draw)) p JOIN bs0 b ON b.k = p.pick GROUP BY 1, 2"""
# as many random places as shocks, taken in the order of their random numbers where they keep the distance
_CTE["rp"] = f"SELECT draw, idx, {_U32.format(k="'7:' || draw || ':lineitem:' || idx")} AS u FROM r, range(1, 6) g(draw) WHERE idx >= 50 AND idx < (SELECT max(idx) + 1 FROM r) - 60"
_CTE["rg"] = """SELECT draw, []::BIGINT[] AS taken FROM range(1, 6) g(draw) UNION ALL
  SELECT draw, list_append(taken, best) FROM (SELECT g.draw, g.taken, arg_min(p.idx, (p.u, p.idx)) AS best FROM rg g JOIN rp p ON p.draw = g.draw
  WHERE len(g.taken) < (SELECT count(*) FROM shock) AND len(list_filter(g.taken, lambda t: abs(t - p.idx) < 60)) = 0 GROUP BY g.draw, g.taken)"""
_CTE["rplace"] = "SELECT draw, unnest(taken) AS idx FROM (SELECT draw, arg_max(taken, len(taken)) AS taken FROM rg GROUP BY draw)"
_CTE["rfield"] = """SELECT s.draw, s.idx AS shock, u::INT AS u, abs(b.r) / a.sigma AS w FROM rplace s JOIN ewma a ON a.idx = s.idx, range(1, 41) g(u)
  JOIN ewma b ON b.idx = s.idx + u WHERE s.idx + 40 <= (SELECT max(idx) FROM r)"""
_CTE["rdw"] = "SELECT draw, shock, u, w - avg(w) OVER (PARTITION BY draw, u) AS dw, stddev_samp(w) OVER (PARTITION BY draw, u) AS sd FROM rfield"
_CTE["rage"] = """SELECT draw, age_bin, lag, avg(rho) AS rho FROM (
  SELECT a.draw, a.u, lag, avg(a.dw * b.dw) / (max(a.sd) * max(b.sd)) AS rho, CASE WHEN a.u - 1 < 5 THEN 0 WHEN a.u - 1 < 10 THEN 1 WHEN a.u - 1 < 20 THEN 2 WHEN a.u - 1 < 30 THEN 3 END AS age_bin
  FROM rdw a, sl JOIN rdw b ON b.draw = a.draw AND b.shock = a.shock AND b.u = a.u + lag GROUP BY a.draw, a.u, lag HAVING count(*) >= 5) WHERE age_bin IS NOT NULL GROUP BY 1, 2, 3"""
_CTE["rtau"] = """SELECT draw, age_bin, CASE WHEN cut IS NULL OR cut > 1 THEN (SELECT sum(rho) FROM rage s WHERE s.draw = c.draw AND s.age_bin = c.age_bin AND (cut IS NULL OR s.lag < cut)) END AS tau
  FROM (SELECT draw, age_bin, min(lag) FILTER (WHERE rho <= 0) AS cut FROM rage GROUP BY 1, 2) c"""
_CTE["rnull"] = """SELECT draw, corr(a, b) AS spearman, count(*) AS n FROM (SELECT draw, rank() OVER (PARTITION BY draw ORDER BY age_bin) AS a, rank() OVER (PARTITION BY draw ORDER BY tau) AS b
  FROM rtau WHERE tau IS NOT NULL) GROUP BY draw"""
_CTE["seen"] = "SELECT corr(a, b) AS spearman FROM (SELECT rank() OVER (ORDER BY age_bin) AS a, rank() OVER (ORDER BY tau) AS b FROM atau WHERE tau IS NOT NULL)"

# phase of day
_CTE["ph0"] = "SELECT series, idx, day, hour, flow AS e, lead(cum) OVER (ORDER BY idx) - cum AS dp, flow AS raw, 1.0::DOUBLE AS trades, volume FROM (SELECT *, sum(flow) OVER (ORDER BY idx) AS cum FROM ev)"
_CTE["ph1"] = "SELECT * FROM ph0 WHERE dp IS NOT NULL"
_CTE["phl"] = "SELECT quantile_cont(abs(dp), 0.995) AS ld, quantile_cont(abs(raw), 0.99) AS lr, quantile_cont(volume / trades, 0.5) AS q_bar FROM ph1"
_CTE["ph"] = "SELECT series, idx, day, hour, e, greatest(least(dp, ld), -ld) AS dp, greatest(least(raw, lr), -lr) AS raw, trades, q_bar FROM ph1, phl"


def _observables(table: str, keys: str, least: int = 500) -> tuple[str, str, str]:
    sym = _symmetry(f"(SELECT {keys}, hour // 3 AS bin8, e AS q FROM {table})", f"{keys}, bin8", 10)
    fit = _affinity(f"({sym})", f"{keys}, bin8")
    obs = f"""SELECT {keys}, o.bin8 AS bin, printf('%02d-%02d', o.bin8 * 3, o.bin8 * 3 + 3) AS hours, n, CASE WHEN n >= {least} THEN m END AS bias, CASE WHEN n >= {least} THEN sd / sqrt(n) END AS se_bias,
  CASE WHEN n >= {least} THEN act END AS activity, CASE WHEN n >= {least} THEN a END AS a1, CASE WHEN n >= {least} THEN se_a END AS se_a1, CASE WHEN n >= {least} THEN r1 END AS r1, CASE WHEN n >= {least} THEN f1 END AS f1 FROM (
  SELECT {keys}, bin8, count(*) AS n, avg(e) AS m, stddev_samp(e) AS sd, var_samp(e) AS ve, avg(trades) AS act, avg(dp * (e - em)) / avg((e - em) ** 2) AS r1, var_samp(raw) / (max(q_bar) ** 2 * avg(trades)) AS f1
  FROM (SELECT *, hour // 3 AS bin8, avg(e) OVER (PARTITION BY {keys}, hour // 3) AS em FROM {table}) GROUP BY {keys}, bin8) o LEFT JOIN ({fit}) USING ({keys}, bin8)"""
    return sym, fit, obs


_CTE["obs"] = _observables("ph", "series")[2]
_MOD = "SELECT {k}, 'bias' AS observable, CASE WHEN count(bias) >= 3 THEN var_pop(bias) END AS modulation FROM {t} GROUP BY {k}" + "".join(
    f" UNION ALL SELECT {{k}}, '{o}', CASE WHEN count({o}) >= 3 THEN var_pop({o}) END FROM {{t}} GROUP BY {{k}}" for o in ("activity", "a1", "r1", "f1")
)
_CTE["mod"] = _MOD.format(k="series", t="obs")
_CTE["hp0"] = f"""SELECT series, idx, hour(ts) AS hour, ts::DATE AS day, e, lead(p) OVER (ORDER BY idx) - p AS dp, raw, trades, volume, lead(idx) OVER (ORDER BY idx) AS nxt
  FROM (SELECT *, {_IMB} AS e, CASE WHEN open > 0 THEN ln(open) END AS p, 2 * tb_base - volume AS raw FROM eh)"""
_CTE["hp1"] = "SELECT * FROM hp0 WHERE nxt IS NOT NULL"
_CTE["hpl"] = "SELECT quantile_cont(trades, 0.99) AS lt, quantile_cont(abs(dp), 0.995) AS ld, quantile_cont(abs(raw), 0.99) AS lr, quantile_cont(volume / trades, 0.5) AS q_bar FROM hp1"
_CTE["hp"] = "SELECT series, idx, day, hour, e, greatest(least(dp, ld), -ld) AS dp, greatest(least(raw, lr), -lr) AS raw, least(trades, lt) AS trades, q_bar FROM hp1, hpl"
_CTE["hobs"] = _observables("hp", "series", 50)[2]
_CTE["hb"] = "SELECT *, hour // 3 AS bin FROM hp WHERE e IS NOT NULL AND dp IS NOT NULL"
_CTE["hband"] = "SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT quantile_cont(trades, 0.1) AS lo, quantile_cont(trades, 0.9) AS hi FROM hb GROUP BY bin)"
_CTE["hm0"] = """SELECT series, bin, count(*) AS n, regr_slope(dp, e) AS r1, count(*) FILTER (WHERE trades BETWEEN lo AND hi) AS n_matched, avg(trades) FILTER (WHERE trades BETWEEN lo AND hi) AS activity,
  regr_slope(dp, e) FILTER (WHERE trades BETWEEN lo AND hi) AS r1_matched FROM hb, hband GROUP BY 1, 2"""
_CTE["hm"] = "SELECT series, bin, n, CASE WHEN n >= 50 THEN r1 END AS r1, n_matched, CASE WHEN n_matched >= 50 THEN activity END AS activity, CASE WHEN n_matched >= 50 THEN r1_matched END AS r1_matched FROM hm0"
_CTE["rot"] = f"""SELECT series, draw, e, dp, raw, trades, q_bar, (hour + CASE WHEN draw = 0 THEN 0 ELSE {_U32.format(k="'7:' || draw || ':' || strftime(day, '%Y-%m-%d')")} % 24 END) % 24 AS hour
  FROM ph, range(0, 21) g(draw)"""
_CTE["robs"] = _observables("rot", "series, draw")[2]
_CTE["rmod"] = _MOD.format(k="series, draw", t="robs")
_CTE["emp"] = """SELECT o.series, o.observable, (1 + count(*) FILTER (WHERE round(n.modulation, 6) >= round(o.modulation, 6)))::DOUBLE / (1 + count(n.modulation)) AS p, count(n.modulation) AS draws
  FROM rmod o JOIN rmod n ON n.observable = o.observable AND n.draw > 0 WHERE o.draw = 0 GROUP BY 1, 2, o.modulation"""

# detrended fluctuations
_CTE["prof"] = "SELECT idx, sum(x - m) OVER (ORDER BY idx) AS y FROM (SELECT idx, x, avg(x) OVER () AS m FROM x)"
_CTE["dfa"] = """SELECT T, count(*) AS boxes, avg(r) AS f2 FROM (
  SELECT T, idx // T AS box, (regr_syy(y, idx % T) - regr_sxy(y, idx % T) ** 2 / regr_sxx(y, idx % T)) / T AS r FROM prof, (VALUES (8), (16), (32), (64), (128)) g(T) GROUP BY T, box HAVING count(*) = T) GROUP BY T HAVING count(*) >= 4"""

# nulls
_CTE["flip"] = f"SELECT draw, idx, CASE WHEN draw = 0 THEN x WHEN {_U32.format(k="'7:' || draw || ':' || idx")} % 2 = 0 THEN abs(x) ELSE -abs(x) END AS x FROM x, range(0, 21) g(draw)"
# random order: halves of a number turn six times, numbers that leave the series go on
_CTE["pn"] = "SELECT n, a, ceil(n / a)::BIGINT AS b FROM (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM (SELECT max(idx) + 1 AS n FROM x))"
_CTE["pkey"] = f"SELECT draw, round, {_U32.format(k="'7:lineitem:' || draw || ':' || round")} AS key FROM range(1, 21) g(draw), range(0, 6) h(round)"
_HASH = "((r * 1664525 + key) & 4294967295)"
_HASH = f"((xor({_HASH}, {_HASH} >> 15) * 1103515245) & 4294967295)"
_HASH = f"xor({_HASH}, {_HASH} >> 16)"
_CTE["pwalk"] = f"""SELECT draw, idx, 0 AS round, idx % a AS l, idx // a AS r FROM x, pn, range(1, 21) g(draw) UNION ALL
  SELECT w.draw, idx, CASE WHEN w.round = 6 THEN 1 ELSE w.round + 1 END, r, (l + {_HASH}) % CASE WHEN w.round % 2 = 0 THEN a ELSE b END
  FROM pwalk w JOIN pkey k ON k.draw = w.draw AND k.round = w.round % 6, pn WHERE w.round < 6 OR r * a + l >= n"""
_CTE["perm"] = """SELECT 0::BIGINT AS draw, idx, x FROM x UNION ALL SELECT draw, r * a + l, x FROM pwalk JOIN x USING (idx), pn WHERE round = 6 AND r * a + l < n"""


def _null_slopes(table: str) -> str:
    return f"""SELECT 'lineitem' AS series, draw, regr_slope(ln(v), ln(T)) AS slope_k2 FROM (SELECT draw, T, var_samp(q) AS v FROM (
  SELECT draw, T, idx // T AS block, sum(x) AS q FROM {table}, tg WHERE T <= 16 GROUP BY 1, 2, 3 HAVING count(*) = T) GROUP BY 1, 2) GROUP BY draw"""


_CTE["pslope"] = _null_slopes("perm")
_CTE["pc"] = "SELECT draw, idx, x - avg(x) OVER (PARTITION BY draw) AS c, var_pop(x) OVER (PARTITION BY draw) AS v FROM perm"
_CTE["cells"] = "SELECT a.draw, lag::VARCHAR AS cell, round(avg(a.c * b.c) / max(a.v), 9) AS stat FROM pc a, lags JOIN pc b ON b.draw = a.draw AND b.idx = a.idx + lag WHERE lag <= 5 GROUP BY a.draw, lag"
_CTE["xx"] = f"SELECT series, idx, x FROM x UNION ALL SELECT series, idx, {_IMB} FROM eh"
_CTE["csum"] = "SELECT series, b.idx - a.idx AS lag, sum(a.x * b.x) AS s, count(a.x * b.x) AS pairs FROM xx a JOIN xx b USING (series) WHERE b.idx >= a.idx GROUP BY 1, 2"
_CTE["kc"] = "SELECT lag::DOUBLE AS lag, c FROM acf WHERE c IS NOT NULL"


def _kernel_best(pairs: str) -> str:
    return f"""SELECT f, s, n, af, asl, rest, total FROM (SELECT *, cc - af * xc - asl * yc AS rest, cc - sc * sc / n AS total FROM (
      SELECT *, (xc * yy - yc * xy) / (xx * yy - xy * xy) AS af, (yc * xx - xc * xy) / (xx * yy - xy * xy) AS asl FROM (
      SELECT f, s, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * c) AS xc, sum(y * c) AS yc, sum(c * c) AS cc, sum(c) AS sc
      FROM (SELECT f, s, c, lag ** (-f / 1250.0::DOUBLE) AS x, lag ** (-s / 1250.0::DOUBLE) AS y FROM kc, ({pairs})) GROUP BY f, s HAVING count(*) >= 6))) WHERE isfinite(rest) ORDER BY rest, f, s LIMIT 1"""


_CTE["k0"] = _kernel_best("SELECT f.u * 125 AS f, s.u * 125 AS s FROM range(1, 31) f(u), range(1, 31) s(u) WHERE f.u > s.u")
for _i, _step in ((1, 25), (2, 5), (3, 1)):
    _CTE[f"k{_i}"] = _kernel_best(f"SELECT f + {_step} * i.d AS f, s + {_step} * j.d AS s FROM k{_i - 1}, range(-5, 6) i(d), range(-5, 6) j(d) WHERE s + {_step} * j.d > 0 AND f + {_step} * i.d - s - {_step} * j.d >= 125")
_CTE["tops"] = "SELECT draw, max(stat) AS t FROM cells WHERE draw > 0 GROUP BY draw"
_CTE["xd"] = "SELECT series, idx, x + 1.0 * (idx / (SELECT max(idx) FROM x)::DOUBLE) AS x FROM x"

# wavelets: circular filters, first octave, and the pyramid for two taps
_CTE["x0"] = "SELECT series, idx, x - avg(x) OVER () AS x, count(*) OVER () AS n FROM x"
_S = 0.7071067811865475


def _octave(src: str, h: list[float]) -> str:
    """idx, n, a, d of the next octave of src (idx, n, x)."""
    size = len(h)
    g = [(-1) ** k * h[size - 1 - k] for k in range(size)]
    term = lambda f: " + ".join(f"({f[size - 1 - m]!r}::DOUBLE) * x{m}" for m in range(size))
    joins = " ".join(f"JOIN {src} t{m} ON t{m}.idx = (t0.idx + {m}) % t0.n" for m in range(1, size))
    cols = ", ".join(f"t{m}.x AS x{m}" for m in range(size))
    return f"SELECT idx // 2 AS idx, (n + 1) // 2 AS n, {term(h)} AS a, {term(g)} AS d FROM (SELECT t0.idx, t0.n, {cols} FROM {src} t0 {joins} WHERE t0.idx % 2 = 0)"


def _trimmed(src: str, size: int) -> str:
    trim = f"least({size - 1}, greatest(n // 4, 1))"
    return f"SELECT d FROM {src} WHERE n <= 2 * {trim} OR (idx >= {trim} AND idx < n - {trim})"


_DB3 = [0.33267055295008263, 0.8068915093110924, 0.4598775021184914, -0.13501102001025458, -0.08544127388202666, 0.035226291885709536]
for _name, _h in (("h", [_S, _S]), ("b", _DB3)):
    for _j in range(1, 9):
        _CTE[f"{_name}{_j}"] = _octave("x0" if _j == 1 else f"{_name}{_j - 1}x", _h)
        _CTE[f"{_name}{_j}x"] = f"SELECT idx, n, a AS x FROM {_name}{_j}"
    _CTE[f"{_name}all"] = " UNION ALL ".join(f"SELECT {_j} AS octave, d FROM ({_trimmed(f'{_name}{_j}', len(_h))}) WHERE {_j} <= (SELECT floor(log2(count(*) / {2 * len(_h)}.0)) FROM x)" for _j in range(1, 9))
    _psi = lambda y: f"ln({y}) - 0.5 / ({y}) - (1 / ({y}) ** 2) * (1 / 12.0 - (1 / ({y}) ** 2) * (1 / 120.0 - (1 / ({y}) ** 2) / 252))"
    _psi1 = lambda y: f"1 / ({y}) + 0.5 / ({y}) ** 2 + (1 / 6.0 - (1 / 30.0 - (1 / 42.0) / ({y}) ** 2) / ({y}) ** 2) / ({y}) ** 3"
    _steps = " - ".join(f"1 / (z + {k})" for k in range(8))
    _steps1 = " + ".join(f"1 / (z + {k}) ** 2" for k in range(8))
    _CTE[f"{_name}dia"] = f"""SELECT 'lineitem' AS series, octave, n, log2(e) - (({_psi('(z + 8)')} - {_steps}) / ln(2) - log2(z)) AS y, ({_psi1('(z + 8)')} + {_steps1}) / ln(2) ** 2 AS var
  FROM (SELECT octave, count(*) AS n, count(*) / 2.0::DOUBLE AS z, avg(d * d) AS e FROM {_name}all GROUP BY octave HAVING count(*) >= 8 AND avg(d * d) > 0)"""

_RECURSIVE = {"ew", "ga", "sh", "rg", "pwalk"}


def _uses(text: str) -> set[str]:
    return {w for w in re.findall(r"[A-Za-z_]\w*", text) if w in _CTE}


def _sql(final: str) -> str:
    """``final`` with the table expressions it needs, in their order of definition."""
    need, todo = set(), _uses(final)
    while todo:
        need |= todo
        todo = set().union(*(_uses(_CTE[n]) for n in todo)) - need
    parts = ", ".join(f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({_CTE[n]})" for n in _CTE if n in need)
    return f"WITH RECURSIVE {parts} {final}" if parts else final


def _r(*cols: str, places: int = 6) -> str:
    """Rounded columns; 'expr AS name' or a name."""
    out = []
    for c in cols:
        expr, _, name = c.rpartition(" AS ")
        out.append(f"round(({expr or name})::DOUBLE, {places}) + 0 AS {name}")
    return ", ".join(out)


_FINAL = {
    "bars_hourly": f"SELECT series, idx, ts, {_r('open', 'high', 'low', 'close', 'volume', 'tb_base', 'trades')} FROM eh",
    "bars_daily": f"SELECT series, idx, ts, {_r('open', 'close', 'volume', 'tb_base', 'trades')} FROM ld",
    "bars_dedup_latest": f"SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, max(event_id) AS id, {_r('arg_max(value, event_id) AS price')} FROM events GROUP BY 1",
    "trade_clock_bars": f"SELECT series, idx // 50 AS idx, min(ts) AS ts, {_r('sum(volume) AS volume', 'sum(CASE WHEN buy THEN volume ELSE 0 END) AS tb_base', 'count(*) AS trades')} FROM ev GROUP BY series, idx // 50 HAVING count(*) = 50",
    "flow_imbalance_volume": f"SELECT series, idx, {_r(f'{_IMB} AS x')} FROM eh",
    "flow_imbalance_raw": f"SELECT series, idx, {_r('2 * tb_base - volume AS x')} FROM eh",
    "log_returns": f"SELECT series, idx, {_r('r')} FROM r",
    "volatility_fields": f"SELECT series, idx, {_r('abs(r) AS v_abs', 'r * r AS v_sq', 'r AS v_raw')} FROM r",
    "net_charge_grid": f"SELECT series, T, block, {_r('q')} FROM q",
    "cumulant_scaling": f"SELECT series, T, n::BIGINT AS n, {_r('k1', 'k2', 'k3', 'k4')} FROM k",
    "cumulant_slopes": f"SELECT series, {_r('regr_slope(ln(k2), ln(T)) AS slope_k2', _slope_error('ln(k2)', 'ln(T)') + ' AS se_slope_k2', 'CASE WHEN min(k1) * max(k1) > 0 THEN regr_slope(ln(abs(k1)), ln(T)) END AS slope_k1')}, count(*) AS n FROM k GROUP BY series",
    "gaussian_affinity": f"SELECT series, T, count(*) AS n, {_r('2 * avg(q) / var_samp(q) AS a_gauss')} FROM q GROUP BY 1, 2 HAVING count(*) >= 30",
    "fano_table": f"""SELECT 'lineitem' AS series, T, count(*) AS n, {_r('max(qb) AS q_bar', 'var_samp(q) / (max(qb) ** 2 * avg(tr)) AS fano', 'avg(tr) AS trades_per_block')}
        FROM (SELECT T, idx // T AS block, sum(2 * tb_base - volume) AS q, sum(trades) AS tr FROM ld, tg GROUP BY 1, 2 HAVING count(*) = T), (SELECT quantile_cont(volume / trades, 0.5) AS qb FROM ld) GROUP BY T HAVING count(*) >= 30""",
    "fano_slope": f"""SELECT 'lineitem' AS series, {_r('regr_slope(ln(f), ln(T)) AS slope_fano')}, count(*) AS n FROM (SELECT T, var_samp(q) / avg(tr) AS f
        FROM (SELECT T, idx // T AS block, sum(2 * tb_base - volume) AS q, sum(trades) AS tr FROM ld, tg GROUP BY 1, 2 HAVING count(*) = T) GROUP BY T HAVING count(*) >= 30)""",
    "symmetry_function": f"SELECT series, T, bin::INT AS bin, {_r('centre', 's', 'se')} FROM sym",
    "affinity_fit": f"SELECT series, T, {_r('a', 'se_a', 'chi2_dof')}, n_bins FROM fit",
    "affinity_cubic": f"SELECT series, T, {_r('c3', 'se_c3')} FROM fit",
    "affinity_by_length": f"SELECT series, T, {_r('a', 'se_a')}, n_bins FROM fit3",
    "affinity_dilution": f"SELECT f.series, {_r('g.a / f.a AS observed', '16 * v.k2 / w.k2 AS predicted')} FROM fit3 f, fit3 g, k v, k w WHERE f.T = 1 AND g.T = 16 AND v.T = 1 AND w.T = 16",
    "tranche_stability": f"""SELECT series, piece::INT AS piece, count(*) AS n, {_r('var_samp(q) AS var_q')} FROM (SELECT series, piece, pos // 4 AS block, sum(x) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY piece ORDER BY idx) - 1 AS pos FROM (SELECT *, ntile(4) OVER (ORDER BY idx) AS piece FROM x)) GROUP BY 1, 2, 3 HAVING count(*) = 4) GROUP BY 1, 2""",
    "haar_variance": f"""SELECT series, T, n, {_r('var_d', 'coalesce((f * dn + b * up) / (up + dn), f, b) AS nu')} FROM (SELECT *, (lead(y) OVER w - y) / up AS f, (y - lag(y) OVER w) / dn AS b FROM (
        SELECT *, ln(var_d) AS y, lead(ln(T)) OVER (ORDER BY T) - ln(T) AS up, ln(T) - lag(ln(T)) OVER (ORDER BY T) AS dn FROM (SELECT series, T, count(*) AS n, var_samp(d) AS var_d FROM (
        SELECT series, T, idx // (2 * T) AS pair, sum(CASE WHEN idx % (2 * T) < T THEN -x ELSE x END) AS d FROM x, tg GROUP BY 1, 2, 3 HAVING count(*) = 2 * T) GROUP BY 1, 2 HAVING count(*) >= 16)) WINDOW w AS (ORDER BY T))""",
    "haar_identity": f"""SELECT 'lineitem' AS series, T, {_r('var_d', '4 * v - v2 AS from_blocks')} FROM (SELECT T, var_samp(d) AS var_d FROM (SELECT T, idx // (2 * T) AS pair, sum(CASE WHEN idx % (2 * T) < T THEN -x ELSE x END) AS d
        FROM x, tg GROUP BY 1, 2 HAVING count(*) = 2 * T) GROUP BY T) JOIN (SELECT T, var_samp(q) AS v FROM q GROUP BY T) USING (T) JOIN (SELECT T // 2 AS T, var_samp(q) AS v2 FROM q WHERE T > 1 GROUP BY 1) USING (T) WHERE T <= 8""",
    "nu_blocks": f"SELECT series, {_r('regr_slope(ln(v), ln(T)) AS nu')}, count(*) AS n FROM (SELECT series, T, var_samp(q) AS v FROM q GROUP BY 1, 2) GROUP BY series",
    "flow_autocorrelation": f"SELECT series, lag, {_r('c')}, pairs FROM acf",
    "response_function": f"SELECT series, lag, {_r('r')}, pairs FROM resp",
    "fdt_teff": f"SELECT series, lag, {_r('r', 'c')}, {_r('t_eff', places=3)} FROM teff",
    "fdt_violation": f"SELECT series, {_r('stddev_pop(t_eff) / quantile_cont(abs(t_eff), 0.5) AS fdt_violation', places=4)} FROM teff GROUP BY series",
    "rolling_fdt": f"SELECT series, t_w, {_r('v AS fdt_violation', places=3)} FROM wviol",
    "rolling_teff": f"SELECT series, t_w, {_r('level', places=3)} FROM wviol",
    "gamma_acf": f"SELECT series, CASE WHEN count(*) >= 4 THEN {_r('regr_slope(ln(c), ln(lag)) AS g').split(' AS ')[0]} END AS gamma, CASE WHEN count(*) >= 4 THEN round({_slope_error('ln(c)', 'ln(lag)')}, 6) + 0 END AS se_gamma, count(*) AS n FROM acf WHERE c > 0 GROUP BY series",
    "two_regime_slopes": """SELECT series, CASE WHEN count(*) FILTER (WHERE lag <= 10) >= 5 THEN round(regr_slope(ln(c), ln(lag)) FILTER (WHERE lag <= 10), 6) + 0 END AS slope_fast,
        CASE WHEN count(*) FILTER (WHERE lag >= 10) >= 5 THEN round(regr_slope(ln(c), ln(lag)) FILTER (WHERE lag >= 10), 6) + 0 END AS slope_slow FROM acf WHERE c > 0 GROUP BY series""",
    "deseasonalised_acf": f"SELECT a.series, lag, {_r('avg(a.c * b.c) / max(a.v) AS c')}, count(*) AS pairs FROM evc a, lags JOIN evc b ON b.idx = a.idx + lag GROUP BY 1, 2",
    "k2_closure": f"SELECT series, T, {_r('k2', 'k2_pred', 'k2 / k2_pred AS closure')} FROM k JOIN (SELECT T, (SELECT var_samp(x) FROM x) * (T + 2 * coalesce(sum((T - lag) * c) FILTER (WHERE lag < T), 0)) AS k2_pred FROM tg, acf GROUP BY T) USING (T) WHERE T <= 16",
    "teff_shape": f"""SELECT series, {_r('bt AS b_t', 'bc - 1 - br AS b_pred', '(bt - (bc - 1 - br)) / sqrt(st ** 2 + sc ** 2 + sr ** 2) AS z')} FROM (SELECT series,
        regr_slope(ln(abs(t_eff)), ln(lag)) AS bt, {_slope_error('ln(abs(t_eff))', 'ln(lag)')} AS st, regr_slope(ln(abs(r)), ln(lag)) AS br, {_slope_error('ln(abs(r))', 'ln(lag)')} AS sr FROM teff GROUP BY series)
        JOIN (SELECT series, CASE WHEN count(*) >= 5 THEN regr_slope(ln(c), ln(lag)) END AS bc, CASE WHEN count(*) >= 5 THEN {_slope_error('ln(c)', 'ln(lag)')} END AS sc FROM teff WHERE c > 0 GROUP BY series) USING (series)""",
    "rolling_acf_surface": f"SELECT series, t_w, k, lag, {_r('rho')} FROM surf",
    "mean_profile": f"SELECT series, lag, {_r('avg(rho) AS rho_mean')} FROM surf GROUP BY 1, 2",
    "tti_expanding": f"SELECT series, t_w, {_r('sqrt(sum((rho - ref) ** 2)) / (sqrt(sum(ref * ref)) + 1e-12) AS distance')} FROM (SELECT *, avg(rho) OVER (PARTITION BY lag ORDER BY t_w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM surf) WHERE k >= 20 GROUP BY 1, 2",
    "tti_full": f"SELECT series, t_w, {_r('sqrt(sum((rho - ref) ** 2)) / (sqrt(sum(ref * ref)) + 1e-12) AS distance')} FROM (SELECT *, avg(rho) OVER (PARTITION BY lag) AS ref FROM surf) GROUP BY 1, 2",
    "correlation_time_integral": f"SELECT series, t_w, {_r('tau')} FROM tau",
    "correlation_time_efold": f"""SELECT series, t_w, {_r('coalesce(arg_min(v, lag) FILTER (WHERE rho < exp(-1.0::DOUBLE)), count(*)) AS tau')} FROM (SELECT *, CASE WHEN lag = 1 THEN 0 ELSE lag - 1 + CASE WHEN pr = rho THEN 0 ELSE (pr - exp(-1.0::DOUBLE)) / (pr - rho) END END AS v
        FROM (SELECT *, lag(rho) OVER (PARTITION BY t_w ORDER BY lag) AS pr FROM surf)) GROUP BY 1, 2""",
    "aging_collapse": f"SELECT series, mu, {_r('residual')} FROM aging",
    "aging_best": f"SELECT series, {_r('arg_min(mu, residual) AS mu_best', 'min(residual) AS residual_best', 'max(residual) FILTER (WHERE mu = 0) AS residual_0')} FROM aging GROUP BY series",
    "realized_vol_forward": f"SELECT series, idx, {_r('rv')} FROM rv",
    "ewma_vol": f"SELECT series, idx, {_r('r', 'sigma')} FROM ewma",
    "garch_path": f"SELECT series, idx, {_r('r', 'sigma')} FROM garch",
    "embargo_mask": "SELECT series, idx, idx < greatest(cut - 5, 0) AS train, idx >= cut AS oos FROM r, cut",
    "ffill_align": f"SELECT series, idx - 1 AS idx, {_r('last_value(tau IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v')} FROM (SELECT ld.series, idx, tau FROM ld LEFT JOIN (SELECT * FROM tau WHERE (t_w - 249) % 50 = 0) s ON s.t_w = ld.idx) QUALIFY idx > 0",
    "winsor_standardize": f"SELECT series, idx, {_r('x')} FROM ws",
    "qlike_rmse": f"SELECT 'lineitem' AS series, count(q) AS n, {_r('avg(q) AS qlike', 'sqrt(avg((rv - sigma) ** 2)) AS rmse')} FROM (SELECT rv, sigma, {_QL.format(s='sigma')} AS q FROM ewma JOIN rv USING (idx))",
    "dm_test": f"SELECT series, n, {_r('m AS mean_diff', 'dm')} FROM dm1",
    "dm_pvalue": f"SELECT series, {_r(f'{_ERFC} AS p')} FROM (SELECT series, abs(dm) / sqrt(2.0::DOUBLE) AS z FROM dm2)",
    "walk_forward_folds": "SELECT 'lineitem' AS series, f AS fold, f * 250 AS train_start, f * 250 + 500 AS train_end, f * 250 + 500 AS test_start, f * 250 + 750 AS test_end FROM range(0, 1000) g(f) WHERE f * 250 + 750 <= (SELECT count(*) FROM r)",
    "transition_target": f"SELECT series, idx, (ratio > theta)::INT AS s, {_r('ratio', 'theta')} FROM tt",
    "recal_contrast": f"""SELECT 'lineitem' AS series, max(n_train) AS n_train, count(*) AS n_oos, {_r('max(b2) AS coef_x', 'avg(q0) AS qlike_raw', 'avg(q1) AS qlike_recal', 'avg(q2) AS qlike_full', 'corr(x, y) AS corr_x', 'max(fd1.dm) AS dm_context', 'max(fd2.dm) AS dm_decisive')} FROM fq, fb, fd1, fd2""",
    "shock_candidates": f"SELECT series, idx, {_r('ratio', 'threshold')} FROM cand",
    "shocks_greedy": "SELECT series, idx FROM shock",
    "post_shock_field": f"SELECT series, shock, u, {_r('w')} FROM field",
    "ensemble_mean": f"SELECT series, u, {_r('m', 'sd')}, n FROM ens",
    "age_correlation": f"SELECT series, age_bin, lag, {_r('rho')}, n_ages FROM age",
    "age_tau_c": f"SELECT series, age_bin, {_r('tau')} FROM atau",
    "random_event_places": "SELECT 'lineitem' AS series, draw, idx FROM rplace",
    "random_event_null": f"SELECT 'lineitem' AS series, draw, {_r('spearman')}, n FROM rnull",
    "ageing_verdict": f"""SELECT 'lineitem' AS series, {_r('observed', '"limit"')}, coalesce(observed > "limit", false) AS verdict
  FROM (SELECT (SELECT spearman FROM seen) AS observed, quantile_cont(round(spearman, 6), 0.975) AS "limit" FROM rnull)""",
    "spearman_age": f"SELECT series, {_r('corr(a, b) AS spearman')}, count(*) AS n FROM (SELECT series, rank() OVER (ORDER BY age_bin) AS a, rank() OVER (ORDER BY tau) AS b FROM atau WHERE tau IS NOT NULL) GROUP BY series",
    "bootstrap_ensemble": f"SELECT 'lineitem' AS series, draw, u, {_r('sum(w * weight) / sum(weight) AS m')} FROM field JOIN bs USING (shock) GROUP BY draw, u",
    "phase_observables": f"SELECT series, bin::INT AS bin, hours, n, {_r('bias', 'se_bias', 'activity', 'a1', 'se_a1', 'r1', 'f1')} FROM obs",
    "phase_modulation": f"SELECT series, observable, {_r('modulation')} FROM mod",
    "phase_rotation_null": f"SELECT series, draw, observable, {_r('modulation')} FROM rmod",
    "empirical_p": f"SELECT series, observable, {_r('p')}, draws FROM emp",
    "phase_verdict": "SELECT observable, count(*) FILTER (WHERE p < 0.05) AS hits, count(*) AS n, count(*) FILTER (WHERE p < 0.05) >= count(*) * 0.75 AS verdict FROM emp GROUP BY observable",
    "gaussian_transfer": f"SELECT o.series, bin::INT AS bin, {_r('(a1 - 2 * m / v) / se_a1 AS z')} FROM obs o JOIN (SELECT hour // 3 AS bin, avg(e) AS m, var_samp(e) AS v FROM ph GROUP BY 1) USING (bin)",
    "signflip_null": f"SELECT series, draw, {_r('slope_k2')} FROM ({_null_slopes('flip')})",
    "permutation_null": f"SELECT series, draw, {_r('slope_k2')} FROM pslope",
    "null_summary": f"SELECT series, {_r('max(slope_k2) FILTER (WHERE draw = 0) AS observed', *[f'quantile_cont(slope_k2, {q}) FILTER (WHERE draw > 0) AS {n}' for q, n in ((0.025, 'q025'), (0.5, 'median'), (0.975, 'q975'))])} FROM pslope GROUP BY series",
    "maxt_correction": f"SELECT cell, {_r('stat', '(1 + (SELECT count(*) FROM tops WHERE t >= stat)) / 21.0::DOUBLE AS p')} FROM cells WHERE draw = 0",
    "maxt_summary": f"SELECT {_r('avg(t) AS mean_max', 'stddev_pop(t) AS sd_max', 'quantile_cont(t, 0.95) AS q95_max')}, count(*) AS draws, (SELECT cell FROM cells WHERE draw = 0 ORDER BY stat DESC, cell LIMIT 1) AS best_cell, round((SELECT max(stat) FROM cells WHERE draw = 0), 6) AS best_stat FROM tops",
    "drift_control": f"SELECT 'lineitem' AS series, {_r('regr_slope(ln(v), ln(T)) AS nu')}, count(*) AS n FROM (SELECT T, var_samp(q) AS v FROM (SELECT T, idx // T AS block, sum(x) AS q FROM xd, tg GROUP BY 1, 2 HAVING count(*) = T) GROUP BY T)",
    "drift_sweep": f"""SELECT 'lineitem' AS series, amplitude, {_r('nu', 'nu - (max(nu) FILTER (WHERE amplitude = 0) OVER ()) AS shift')}, abs(nu - max(nu) FILTER (WHERE amplitude = 0) OVER ()) >= 0.2 AS moved FROM (
      SELECT amplitude, regr_slope(ln(v), ln(T)) AS nu FROM (SELECT amplitude, T, var_samp(q) AS v FROM (SELECT amplitude, T, idx // T AS block, sum(x + amplitude * idx / mx) AS q
        FROM (SELECT idx, x, max(idx) OVER () AS mx FROM x), tg, (SELECT unnest([0.0::DOUBLE, 0.3, 0.6, 1.0, 1.5, 2.0, 3.0]) AS amplitude) GROUP BY 1, 2, 3 HAVING count(*) = T) GROUP BY 1, 2) GROUP BY 1)""",
    "ensemble_curve": f"SELECT series, u, {_r('m', 'sd')}, n, greatest((SELECT count(*) FROM ens) // 15, 1) AS step FROM ens WHERE (u - 1) % greatest((SELECT count(*) FROM ens) // 15, 1) = 0",
    "gamma_gph": f"""SELECT 'lineitem' AS series, {_r('-b AS d', '1 + 2 * b AS gamma', '2 * se AS se')}, n FROM (
      SELECT regr_slope(y, g) AS b, sqrt(greatest(regr_syy(y, g) - regr_sxy(y, g) ** 2 / regr_sxx(y, g), 0) / ((count(*) - 2) * regr_sxx(y, g))) AS se, count(*) AS n FROM (
        SELECT ln((sum(c * cos(w)) ** 2 + sum(c * sin(w)) ** 2) / (2 * pi() * any_value(n))) AS y, ln(4 * sin(pi() * k / any_value(n)) ** 2) AS g FROM (
          SELECT k, n, c, 2 * pi() * ((k * idx) % n) / n AS w FROM (SELECT idx, x - avg(x) OVER () AS c, count(*) OVER () AS n FROM x) z, range(1, 200) r(k) WHERE k <= floor(sqrt(n))) GROUP BY k))""",
    "phase_observables_hourly": f"SELECT series, bin::INT AS bin, hours, n, {_r('bias', 'se_bias', 'activity', 'a1', 'se_a1', 'r1', 'f1')} FROM hobs",
    "phase_matched_response": f"SELECT series, bin::INT AS bin, n, {_r('r1', 'activity', 'r1_matched')}, n_matched FROM hm",
    "phase_matched_spread": f"""SELECT series, count(*) AS bins, {_r(*[f"CASE WHEN count(*) >= 3 THEN max({c}) - min({c}) END AS spread{e}" for c, e in (('r1', ''), ('r1_matched', '_matched'))], *[f"CASE WHEN count(*) >= 3 AND min({c}) > 0 THEN max({c}) / min({c}) END AS ratio{e}" for c, e in (('r1', ''), ('r1_matched', '_matched'))])}
      FROM hm WHERE r1 IS NOT NULL AND r1_matched IS NOT NULL GROUP BY series""",
    "two_component_kernel": f"SELECT 'lineitem' AS series, {_r('f / 1250.0::DOUBLE AS a_fast', 'af AS amp_fast', 's / 1250.0::DOUBLE AS a_slow', 'asl AS amp_slow', '1 - rest / total AS r2')}, n FROM k3",
    "kernel_temperature": f"SELECT series, lag, {_r('CASE WHEN abs(r) > 1e-12 THEN (f / 1250.0::DOUBLE * af * lag ** (-1 - f / 1250.0::DOUBLE) + s / 1250.0::DOUBLE * asl * lag ** (-1 - s / 1250.0::DOUBLE)) / r END AS t_eff')} FROM resp, k3",
    "correlation_sums": f"SELECT series, lag, {_r('s / pairs AS c')}, pairs FROM csum",
    "pooled_correlation": f"SELECT lag, {_r('sum(s) / sum(pairs) AS c')}, sum(pairs)::BIGINT AS pairs FROM csum GROUP BY lag",
    "fluctuation": f"SELECT 'lineitem' AS series, T, boxes, {_r('f2')} FROM dfa",
    "gamma_dfa": f"""SELECT 'lineitem' AS series, {_r('b AS hurst', '2 - 2 * b AS gamma', '2 * se AS se')}, n FROM (
      SELECT regr_slope(y, g) AS b, sqrt(greatest(regr_syy(y, g) - regr_sxy(y, g) ** 2 / regr_sxx(y, g), 0) / ((count(*) - 2) * regr_sxx(y, g))) AS se, count(*) AS n FROM (SELECT ln(f2) / 2 AS y, ln(T) AS g FROM dfa))""",
    "transfer_verdict": "SELECT count(*) FILTER (WHERE abs(z) < 2) AS hits, count(z) AS n, count(z) > 0 AND count(*) FILTER (WHERE abs(z) < 2) >= count(z) * 30 / 32.0 AS verdict FROM (SELECT (a1 - 2 * m / v) / se_a1 AS z FROM obs o JOIN (SELECT hour // 3 AS bin, avg(e) AS m, var_samp(e) AS v FROM ph GROUP BY 1) USING (bin))",
    "haar_details": f"SELECT 'lineitem' AS series, 1 AS octave, {_r('d')} FROM ({_trimmed('h1', 2)})",
    "db3_details": f"SELECT 'lineitem' AS series, 1 AS octave, {_r('d')} FROM ({_trimmed('b1', 6)})",
    "haar_octave_diagram": f"SELECT series, octave, n, {_r('y', 'var')} FROM hdia",
    "db3_octave_diagram": f"SELECT series, octave, n, {_r('y', 'var')} FROM bdia",
    "gamma_wavelet": f"""SELECT 'lineitem' AS series, {_r('a AS alpha', '1 - a AS gamma', '(1 + a) / 2 AS hurst', 'sqrt(s0 / det) AS se', '(syy - a * sjy - (s2 * sy - s1 * sjy) / det * sy) / (n - 2) AS chi2_dof')}, n FROM (SELECT *, (s0 * sjy - s1 * sy) / det AS a FROM (SELECT *, s0 * s2 - s1 * s1 AS det FROM (
        SELECT count(*) AS n, sum(1 / var) AS s0, sum(octave / var) AS s1, sum(octave * octave / var) AS s2, sum(y / var) AS sy, sum(octave * y / var) AS sjy, sum(y * y / var) AS syy FROM bdia WHERE octave >= 2)))""",
    "nu_wavelet": f"SELECT 'lineitem' AS series, {_r('regr_slope(y, octave) + 1 AS nu')}, count(*) AS n FROM hdia WHERE octave BETWEEN 2 AND 6",
    "drift_moving_average": f"SELECT series, idx, {_r('sum(x) OVER (ORDER BY idx ROWS BETWEEN 32 PRECEDING AND 31 FOLLOWING) / 64 AS slow')} FROM x",
    "json_report": """SELECT series, '[' || string_agg('{"T":' || T || ',"n":' || n::BIGINT || '}', ',' ORDER BY T) || ']' AS report FROM k WHERE T <= 4 GROUP BY series""",
}

SQL: dict[str, str] = {name: _sql(final) for name, final in _FINAL.items()}
