"""T1-T30, R1-R9, J6, J7, A17-A21 on the weekly panel, decisions and headline series."""

from pyspark.sql import functions as F

from barloom.frames import row_index
from barloom.operators import evaluate as E
from barloom.operators import samples as R
from barloom.operators import segments as S
from barloom.operators import stats as T
from barloom.operators import universe as U
from barloom.operators import windows as Wn
from barloom.session import pin
from barloom.workload import eval_queries as Q
from barloom.workload import views as V
from barloom.workload.eval_queries import H, KEYS, NP, ir_sql
from barloom.workload.registry import query
from barloom.workload.views import WCFG, WEEK, cte, rd, rq, sql

TL = S.timeline(WCFG)
SEG = "PARTITION BY symbol, segment_id ORDER BY bar_open_ms"
PAIRS = ((4, 5), (2, 1), (4, 3), (4, 2), (3, 1))
B = 10_000


def u_sql(text):
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def cell_series(head):
    return head.groupBy("cell", "period").agg(F.avg("r").alias("r"))


def cell_pairs(head):
    return T.pair_series(pin(cell_series(head)), PAIRS)


cte("cells", "SELECT cell, period, avg(r) AS r FROM head GROUP BY 1, 2", "head")
cte("cpairs", """SELECT ca || '-' || cb AS pair, x.period, x.r AS a, y.r AS b FROM (VALUES (4, 5), (2, 1), (4, 3), (4, 2), (3, 1)) p(ca, cb)
 JOIN cells x ON x.cell = ca JOIN cells y ON y.cell = cb AND y.period = x.period""", "cells")


@query("pair_join", sql(f"SELECT pair, period, {rq('a')} AS a, {rq('b')} AS b FROM cpairs", "cpairs"))
def pair_join(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    return cell_pairs(head).select("pair", "period", rd("a").alias("a"), rd("b").alias("b"))


@query("rank_ic", sql(
    f"""SELECT symbol, count(*) AS n, {rq('corr(x_7, y)')} AS ic, {rq('corr(rx, ry)')} AS rank_ic FROM (SELECT symbol, x_7, y, rank() OVER (PARTITION BY symbol
 ORDER BY x_7) + (count(*) OVER (PARTITION BY symbol, x_7) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER
 (PARTITION BY symbol, y) - 1) / 2.0 AS ry FROM labelled WHERE y IS NOT NULL) GROUP BY 1""", "labelled"))
def rank_ic(spark, sf_dir):
    out = T.rank_ic(Q.labelled(spark, sf_dir).select("symbol", "x_7", "y"), ["symbol"], "x_7", "y")
    return out.select("symbol", "n", rd("ic").alias("ic"), rd("rank_ic").alias("rank_ic"))


_BLOCK, _SCREEN_B = 26, 1000
_HORIZONS = (1, 5, 15, 60)
_DIMS = tuple(range(13))


def _screen_rows(h):
    v = (f"coalesce(sum(raw_ret_close) OVER ({SEG} ROWS BETWEEN 2 FOLLOWING AND {max(h, 2)} FOLLOWING), 0)" if h >= 2
         else f"lead(raw_ret_close) OVER ({SEG})")
    return f"""SELECT symbol, unnest([{', '.join(f"'x_{d}'" for d in _DIMS)}]) AS feature, {h}::INT AS h, bar_open_ms,
 unnest([{', '.join(f'CASE WHEN m_{d} = 0 THEN round(x_{d}, 9) END' for d in _DIMS)}]::DOUBLE[]) AS x, y FROM (SELECT *, CASE WHEN seg_pos < n - {h} THEN v END AS y FROM
 (SELECT *, {v} AS v, count(*) OVER (PARTITION BY symbol, segment_id) AS n FROM panel))"""


cte("screen", "SELECT * FROM (" + " UNION ALL ".join(_screen_rows(h) for h in _HORIZONS) + ") WHERE x IS NOT NULL AND y IS NOT NULL", "panel")
cte("sranks", """SELECT *, rank() OVER (PARTITION BY symbol, feature, h ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, h, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY symbol, feature, h ORDER BY y) + (count(*) OVER (PARTITION BY symbol, feature, h, y) - 1) / 2.0 AS ry,
 row_number() OVER (PARTITION BY symbol, feature, h ORDER BY bar_open_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol, feature, h) AS t FROM screen""", "screen")
_SUMS = {"sa": "rx", "sb": "ry", "saa": "rx * rx", "sbb": "ry * ry", "sab": "rx * ry"}
# totals before each row and after the last: a block is the difference of two
cte("spre", f"""SELECT symbol, feature, h, t, i, {', '.join(f'coalesce(sum({e}) OVER (PARTITION BY symbol, feature, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {n}' for n, e in _SUMS.items())}
 FROM (SELECT symbol, feature, h, t, i, rx, ry FROM sranks UNION ALL SELECT symbol, feature, h, t, t, 0, 0 FROM sranks WHERE i = 0)""", "sranks")
cte("sboot", f"""SELECT symbol, feature, h, rep, CASE WHEN va > 0 AND vb > 0 THEN (sab / n - sa / n * sb / n) / (sqrt(va) * sqrt(vb)) END AS r FROM (SELECT *, greatest(saa / n - pow(sa / n, 2), 0) AS va, greatest(sbb / n - pow(sb / n, 2), 0) AS vb FROM
 (SELECT d.symbol, d.feature, d.h, rep, sum(len) AS n, {', '.join(f'sum(e.{c} - b.{c}) AS {c}' for c in _SUMS)} FROM (SELECT symbol, feature, h, rep, floor(u * (t - len + 1))::BIGINT AS st, len FROM
 (SELECT symbol, feature, h, t, least({_BLOCK}, t) AS len FROM (SELECT DISTINCT symbol, feature, h, t FROM sranks)) s JOIN (SELECT rep, j, {u_sql("'11:' || rep || ':' || j")} AS u FROM range({_SCREEN_B}) r(rep), range(20) k(j)) ON j < ceil(t / len)) d
 JOIN spre b ON b.symbol = d.symbol AND b.feature = d.feature AND b.h = d.h AND b.i = d.st JOIN spre e ON e.symbol = d.symbol AND e.feature = d.feature AND e.h = d.h AND e.i = d.st + d.len GROUP BY 1, 2, 3, 4))""", "sranks", "spre")
cte("spoint", """SELECT symbol, feature, h, count(*) AS n, stddev_pop(x) AS sd, corr(x, y) AS ic, corr(rx, ry) AS rank_ic FROM sranks GROUP BY 1, 2, 3""", "sranks")
cte("sout", """SELECT p.*, quantile_cont(b.r, 0.025) AS lo, quantile_cont(b.r, 0.975) AS hi FROM spoint p LEFT JOIN (SELECT * FROM sboot WHERE r IS NOT NULL) b ON p.symbol = b.symbol
 AND p.feature = b.feature AND p.h = b.h GROUP BY ALL""", "spoint", "sboot")


def _screen_long(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir))
    both = None
    for h in _HORIZONS:
        one = Wn.forward_returns(p, TL, h, rule="screen").withColumn("h", F.lit(h))
        both = one if both is None else both.unionByName(one)
    cells = F.explode(F.array(*[F.struct(F.lit(f"x_{d}").alias("feature"), F.when(F.col(f"m_{d}") == 0, F.round(f"x_{d}", 9)).alias("x")) for d in _DIMS]))
    return both.select("symbol", "h", "bar_open_ms", "y", cells.alias("e")).select("symbol", "e.feature", "h", "bar_open_ms", "e.x", "y")


@query("ic_screen", sql(
    f"""SELECT symbol, feature, h, n, {rq('CASE WHEN ok THEN ic END')} AS ic, {rq('CASE WHEN ok THEN rank_ic END')} AS rank_ic, {rq('CASE WHEN ok THEN lo END', 5)} AS ci_low,
 {rq('CASE WHEN ok THEN hi END', 5)} AS ci_high FROM (SELECT *, n >= 50 AND sd > 0 AS ok FROM sout)""", "sout"))
def ic_screen(spark, sf_dir):
    out = T.ic_screen(_screen_long(spark, sf_dir), ["symbol"], "bar_open_ms", WEEK, _BLOCK, _SCREEN_B, 11, least=50)
    return out.select("symbol", "feature", "h", "n", rd("ic").alias("ic"), rd("rank_ic").alias("rank_ic"), rd("ci_low", 5).alias("ci_low"),
                      rd("ci_high", 5).alias("ci_high"))


@query("screen_verdict", sql(
    """SELECT s.symbol, s.feature, CASE WHEN max(sd) < 1e-8 OR min(fc) > 0.99 THEN 'dead' WHEN bool_or(coalesce(n >= 50 AND sd > 0 AND (lo > 0 OR hi < 0), false))
 THEN 'carries-signal' ELSE 'live-no-signal' END AS verdict FROM sout s JOIN (SELECT symbol, feature, h, max(c) / sum(c) AS fc FROM (SELECT symbol, feature, h, x,
 count(*) AS c FROM screen GROUP BY ALL) GROUP BY 1, 2, 3) f ON s.symbol = f.symbol AND s.feature = f.feature AND s.h = f.h GROUP BY 1, 2""", "sout", "screen"))
def screen_verdict(spark, sf_dir):
    return T.screen_verdict(T.ic_screen(_screen_long(spark, sf_dir), ["symbol"], "bar_open_ms", WEEK, _BLOCK, _SCREEN_B, 11, least=50), ["symbol"])


@query("moving_block_ci", sql(
    f"""SELECT symbol, {rq('quantile_cont(r, 0.025)', 5)} AS ci_low, {rq('quantile_cont(r, 0.975)', 5)} AS ci_high FROM (SELECT symbol, rep, corr(x_7, x_8) AS r FROM
 (SELECT d.symbol, d.rep, p.x_7, p.x_8 FROM (SELECT symbol, rep, j, floor({u_sql("'5:' || rep || ':' || j")} * (t - 20 + 1))::BIGINT AS st FROM (SELECT symbol, count(*)
 AS t FROM panel GROUP BY 1), range({B}) r(rep), range(200) k(j) WHERE j < ceil(t / 20)) d JOIN panel p ON p.symbol = d.symbol AND p.row_idx >= d.st AND p.row_idx < d.st + 20)
 GROUP BY 1, 2) GROUP BY 1""", "panel"))
def moving_block_ci(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir).select("symbol", "row_idx", "x_7", "x_8"))
    out = T.moving_block_ci(p, ["symbol"], "row_idx", "x_7", "x_8", 20, B, 5)
    return out.select("symbol", rd("ci_low", 5).alias("ci_low"), rd("ci_high", 5).alias("ci_high"))


cte("vols", "SELECT symbol, bar_open_ms, sigma - avg(sigma) OVER (PARTITION BY symbol) AS d FROM panel", "panel")


cte("nvols", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_open_ms) AS r, count(*) OVER (PARTITION BY symbol) AS n, sum(d * d) OVER (PARTITION BY symbol) AS den FROM vols", "vols")


@query("effective_n", sql(
    f"""SELECT symbol, n, {rq('least(CASE WHEN 1 + 2 * acc > 0 AND n >= 3 AND den > 0 THEN n / (1 + 2 * acc) ELSE n END, n)', 4)} AS n_eff, lags_used FROM (SELECT symbol, any_value(n) AS n,
 any_value(den) AS den, coalesce(sum((1 - lag / n) * rho) FILTER (WHERE lag < stop), 0) AS acc, (count(*) FILTER (WHERE lag < stop))::INT AS lags_used FROM (SELECT *, coalesce(min(CASE WHEN abs(rho) <
 1.96 / sqrt(n) THEN lag END) OVER (PARTITION BY symbol), 1000000) AS stop FROM (SELECT a.symbol, b.r - a.r AS lag, any_value(a.n) AS n, any_value(a.den) AS den, sum(a.d * b.d) / any_value(a.den) AS rho FROM nvols a JOIN nvols b
 ON a.symbol = b.symbol AND b.r > a.r AND b.r <= a.r + 1440 GROUP BY 1, 2)) GROUP BY 1)""", "nvols"))
def effective_n(spark, sf_dir):
    p = V.panel(spark, sf_dir).select("symbol", "row_idx", "sigma")
    out = T.effective_n(p, ["symbol"], "sigma")
    return out.select("symbol", "n", rd("n_eff", 4).alias("n_eff"), "lags_used")


@query("mde_from_neff", sql(
    f"SELECT symbol, {rq('1 / sqrt(n)')} AS se, {rq('1.96 / sqrt(n)')} AS mde_single, {rq('1.96 * sqrt(2) / sqrt(n)')} AS mde_two_cell FROM "
    "(SELECT symbol, count(*) AS n FROM panel GROUP BY 1)", "panel"))
def mde_from_neff(spark, sf_dir):
    n = V.panel(spark, sf_dir).groupBy("symbol").agg(F.count("*").cast("double").alias("n"))
    return n.select("symbol", *[rd(v).alias(k) for k, v in T.mde_from_neff(F.col("n")).items()])


cte("pret", f"""SELECT symbol, (bar_open_ms - {Q.VLO}) // {WEEK} AS period, raw_ret_close AS y FROM panel WHERE bar_open_ms >= {Q.VLO} AND seg_pos > 0""", "panel")


def period_rows(spark, sf_dir):
    return V.panel(spark, sf_dir).filter((F.col("bar_open_ms") >= Q.VLO) & (F.col("seg_pos") > 0)).select(
        "symbol", F.floor((F.col("bar_open_ms") - Q.VLO) / WEEK).alias("period"), F.col("raw_ret_close").alias("y"))


@query("pairwise_corr", sql(
    f"SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, {rq('corr(a.y, b.y)')} AS rho FROM pret a JOIN pret b ON a.period = b.period AND a.symbol < b.symbol "
    "GROUP BY 1, 2 HAVING count(*) >= 100", "pret"))
def pairwise_corr(spark, sf_dir):
    # small tiles and period blocks, so that several of each are combined
    return T.pairwise_corr(pin(period_rows(spark, sf_dir)), "symbol", "period", "y", 100, tile=8, span=64).withColumn("rho", rd("rho"))


_Z = "2.4864748605243863"  # normal quantiles of 0.95 and 0.80 added


def _rho(col):
    return (f"(SELECT avg(c) FROM (SELECT corr(a.{col}, b.{col}) AS c FROM prm a JOIN prm b ON a.period = b.period AND a.symbol < b.symbol "
            "GROUP BY a.symbol, b.symbol HAVING count(*) >= 100))")


cte("prm", "SELECT *, y - m AS e FROM (SELECT *, avg(y) OVER (PARTITION BY period) AS m FROM pret)", "pret")


@query("portfolio_mde", sql(
    f"""SELECT t, {rq('te', 3)} AS t_eff, {rq('ac')} AS ac1, {rq('rr')} AS rho_raw, {rq('re')} AS rho_residual, {rq('br', 4)} AS breadth, {rq('br / (1 + (br - 1) * greatest(rr, 0))', 4)}
 AS breadth_eff, {rq(f'{_Z} * sqrt(2 / greatest(te, 1)) * sqrt({525_600 / H!r}::DOUBLE)', 4)} AS mde FROM (SELECT *, t * (1 - ac) / (1 + ac) AS te FROM (SELECT count(*) AS t, avg(breadth) AS br,
 greatest(CASE WHEN count(*) > 100 THEN corr(p, m) ELSE 0 END, 0) AS ac, {_rho('y')} AS rr, {_rho('e')} AS re FROM (SELECT *, lag(m) OVER (ORDER BY period) AS p FROM
 (SELECT period, avg(y) AS m, count(*) AS breadth FROM pret GROUP BY 1))))""", "pret", "prm"))
def portfolio_mde(spark, sf_dir):
    out = T.portfolio_mde(period_rows(spark, sf_dir), "symbol", 100, H)
    digits = {"t_eff": 3, "ac1": 6, "rho_raw": 6, "rho_residual": 6, "breadth": 4, "breadth_eff": 4, "mde": 4}
    return out.withColumns({c: rd(c, d) for c, d in digits.items()})


@query("sharpe_moments", sql(
    f"""SELECT cell, n, {rq('m / sd')} AS sharpe, {rq('s3 / pow(sd, 3)')} AS skew, {rq('s4 / pow(sd, 4)')} AS kurt, {rq('(m / sd) * sqrt(n - 1) / sqrt(1 - s3 / pow(sd, 3) * m / sd + (s4 / pow(sd, 4) - 1) / 4 * (m / sd) * (m / sd))', 5)}
 AS psr_z FROM (SELECT cell, count(*) AS n, any_value(m) AS m, sqrt(avg(d * d)) AS sd, avg(d * d * d) AS s3, avg(d * d * d * d) AS s4 FROM (SELECT *, r - avg(r) OVER (PARTITION BY cell) AS d,
 avg(r) OVER (PARTITION BY cell) AS m FROM cells) GROUP BY 1)""", "cells"))
def sharpe_moments(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    m = T.sharpe_moments(cell_series(head), ["cell"])
    return m.select("cell", "n", rd("sharpe").alias("sharpe"), rd("skew").alias("skew"), rd("kurt").alias("kurt"), rd(T.psr_z(F.lit(0.0)), 5).alias("psr_z"))


@query("psr_dsr")
def psr_dsr(spark, sf_dir):
    head, irs = Q.headline_with_trials(spark, sf_dir)
    _, var_sr, n = T.dsr_trials(irs, H)
    return T.psr_dsr(T.sharpe_moments(cell_series(head), ["cell"]), var_sr, n)


@query("dsr_basis", sql(
    f"SELECT count(DISTINCT (cell, kappa)) AS n_trials, {rq(f'var_pop(ir / {Q.PPY}) FILTER (WHERE cell = 5)')} AS var_sr FROM virs", "virs"))
def dsr_basis(spark, sf_dir):
    vw = pin(E.with_kappas(Q.predictions(Q.decisions(Q.labelled(spark, sf_dir), Q.VLO, Q.VHI))))
    _, var_sr, n = T.dsr_trials(pin(E.information_ratio(Q.pool(vw, Q.NV), [*KEYS, "kappa"], H)), H)
    return spark.createDataFrame([(n, var_sr)], "n_trials long, var_sr double").select("n_trials", rd("var_sr").alias("var_sr"))


@query("dsr_trials", sql(
    f"SELECT cell, seed, kappa, {rq(f'ir / {Q.PPY}')} AS trial FROM virs", "virs"))
def dsr_trials(spark, sf_dir):
    vw = pin(E.with_kappas(Q.predictions(Q.decisions(Q.labelled(spark, sf_dir), Q.VLO, Q.VHI))))
    irs = pin(E.information_ratio(Q.pool(vw, Q.NV), [*KEYS, "kappa"], H))
    return T.dsr_trials(irs, H)[0].select("cell", "seed", "kappa", rd("trial").alias("trial"))


_PRE = {"sa": "a", "qa": "a * a", "sb": "b", "qb": "b * b"}
cte("cpre", f"""SELECT pair, period, {', '.join(f'coalesce(sum({e}) OVER (PARTITION BY pair ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {n}' for n, e in _PRE.items())}
 FROM (SELECT pair, period, a, b FROM cpairs UNION ALL SELECT pair, max(period) + 1, 0, 0 FROM cpairs GROUP BY 1)""", "cpairs")
cte("boot7", f"""SELECT d.pair, rep, sum(size) AS n, {', '.join(f'sum(y.{c} - x.{c}) AS {c}' for c in _PRE)} FROM (SELECT pair, rep, floor(u * (t - len + 1))::BIGINT AS st, CASE WHEN j = k - 1 THEN t - (k - 1) * len ELSE len END AS size FROM
 (SELECT *, ceil(t / len)::BIGINT AS k FROM (SELECT pair, count(*) AS t, ceil(sqrt(count(*)))::BIGINT AS len FROM cpairs GROUP BY 1)) JOIN (SELECT rep, j, {u_sql("'9:' || rep || ':' || j")} AS u FROM range({B}) r(rep), range(200) q(j)) ON j < k) d
 JOIN cpre x ON x.pair = d.pair AND x.period = d.st JOIN cpre y ON y.pair = d.pair AND y.period = d.st + d.size GROUP BY 1, 2""", "cpairs", "cpre")


def _rep(s, q):
    return f"({s} / n) / (sqrt(greatest({q} / n - ({s} / n) * ({s} / n), 0)) + 1e-12) * {Q.PPY}"


cte("paired", f"""SELECT x.pair, x.delta_ir, y.lo AS ci_lower, y.hi AS ci_upper, y.se AS se_boot FROM (SELECT pair, {ir_sql('a')} - {ir_sql('b')} AS delta_ir FROM cpairs GROUP BY 1) x JOIN
 (SELECT pair, quantile_cont(d, 0.05) AS lo, quantile_cont(d, 0.95) AS hi, stddev_samp(d) AS se FROM (SELECT pair, {_rep('sa', 'qa')} - {_rep('sb', 'qb')} AS d FROM boot7) GROUP BY 1) y
 ON x.pair = y.pair""", "cpairs", "boot7")


def paired(head):
    return pin(T.paired_delta_ir(pin(cell_pairs(head)), ["pair"], H, B, 9))


@query("paired_delta_ir", sql(
    f"SELECT pair, {rq('delta_ir', 3)} AS delta_ir, {rq('ci_lower', 3)} AS ci_lower, {rq('ci_upper', 3)} AS ci_upper, {rq('se_boot', 3)} AS se_boot FROM paired", "paired"))
def paired_delta_ir(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    return paired(head).select("pair", *[rd(c, 3).alias(c) for c in ("delta_ir", "ci_lower", "ci_upper", "se_boot")])


def seed_deltas(head):
    irs = E.information_ratio(head, KEYS, H).select("cell", "seed", "ir")
    p = F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(a).alias("ca"), F.lit(b).alias("cb")) for a, b in PAIRS]))
    x = irs.withColumn("_p", p)
    per = x.groupBy(F.col("_p.pair").alias("pair"), "seed").agg(
        (F.max(F.when(F.col("cell") == F.col("_p.ca"), F.col("ir"))) - F.max(F.when(F.col("cell") == F.col("_p.cb"), F.col("ir")))).alias("d"))
    return per.groupBy("pair").agg((F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se_train"), F.count("d").alias("n_seeds"))


@query("seed_errors", sql(
    f"""SELECT pair, {rq('stddev_samp(d) / sqrt(count(*))', 4)} AS se_train, count(*) AS n_seeds, {rq('any_value(nu)', 3)} AS nu FROM (SELECT p.pair, d, pow(vb + vt, 2) / (vb * vb / {B - 1} + vt * vt / 2) AS nu FROM
 (SELECT ca || '-' || cb AS pair, x.ir - y.ir AS d, pow(stddev_samp(x.ir - y.ir) OVER (PARTITION BY ca, cb), 2) / 3 AS vt FROM (VALUES (4, 5), (2, 1), (4, 3), (4, 2), (3, 1)) q(ca, cb) JOIN hirs x ON x.cell = ca
 JOIN hirs y ON y.cell = cb AND y.seed = x.seed) p JOIN (SELECT pair, se_boot * se_boot AS vb FROM paired) b ON p.pair = b.pair) GROUP BY 1""", "hirs", "paired"))
def seed_errors(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    m = T.mde_terms(paired(head).join(seed_deltas(head), "pair"))
    return m.select("pair", rd("se_train", 4).alias("se_train"), "n_seeds", rd("nu", 3).alias("nu"))


def paired_mde(head):
    return T.mde_terms(paired(head).join(seed_deltas(head), "pair"))


@query("mde_terms")
def mde_terms(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    return paired_mde(head).select("pair", "delta_ir", "nu", "multiplier", "se_total", "mde")


@query("mde_sweep")
def mde_sweep(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    return T.mde_sweep(paired(head).select("pair", "se_boot"), [i / 4 for i in range(0, 13)], 100.0, 5, B).select(
        "pair", "ratio", "mde", "rises", "first_at_floor")


@query("pbo_cscv", sql(
    f"""SELECT cell, seed, {rq('avg((rk <= 0.5)::INT)')} AS pbo, count(*) AS n_splits FROM (SELECT cell, seed, mask, count(*) FILTER (WHERE o <= best) / (count(*) + 1) AS rk FROM
 (SELECT *, first_value(o) OVER (PARTITION BY cell, seed, mask ORDER BY i DESC, kappa) AS best FROM (SELECT cell, seed, kappa, mask, round(coalesce(avg(r) FILTER (WHERE ins) / nullif(stddev_pop(r) FILTER (WHERE ins), 0), 0), 10) AS i,
 round(coalesce(avg(r) FILTER (WHERE NOT ins) / nullif(stddev_pop(r) FILTER (WHERE NOT ins), 0), 0), 10) AS o FROM (SELECT s.*, mask, (mask >> b) % 2 = 1 AS ins FROM (SELECT *, """
    + " + ".join(f"(period >= {NP * i // 8})::INT" for i in range(1, 8)) + """ AS b FROM series) s, range(256) m(mask) WHERE bit_count(mask::INT) = 4) GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3) GROUP BY 1, 2""", "series"))
def pbo_cscv(spark, sf_dir):
    s = Q.pool(pin(E.with_kappas(Q.predictions(Q.decisions(Q.labelled(spark, sf_dir))))), NP)
    return R.pbo_cscv(s, KEYS, "kappa", NP).withColumn("pbo", rd("pbo"))


# ---- sampling ---------------------------------------------------------------------------------------------------

cte("starts", f"""SELECT symbol, row_idx, row_number() OVER (PARTITION BY symbol ORDER BY bar_open_ms) - 1 AS win FROM (SELECT *, lead(bar_open_ms, 15) OVER ({SEG}) AS l FROM panel)
 WHERE l IS NOT NULL AND seg_pos % 4 = 0""", "panel")
cte("cumw", f"""SELECT symbol, n, (sum(sqrt(n)) OVER w - sqrt(n)) / sum(sqrt(n)) OVER () AS lo, sum(sqrt(n)) OVER w / sum(sqrt(n)) OVER () AS hi FROM (SELECT symbol, count(*) AS n,
 {u_sql("'order:' || symbol")} AS h FROM starts GROUP BY 1) WINDOW w AS (ORDER BY h, symbol ROWS UNBOUNDED PRECEDING)""", "starts")


def starts(spark, sf_dir):
    s = pin(Wn.window_starts(V.panel(spark, sf_dir), TL, 16, 4).select("symbol", "bar_open_ms", "row_idx"))
    return row_index(s, TL, "win").select("symbol", "row_idx", "win")


@query("sample_windows", sql(
    f"""SELECT draw, d.symbol, d.win, s.row_idx FROM (SELECT draw, symbol, floor({u_sql("'3:window:' || draw")} * n)::BIGINT AS win FROM range(2000) r(draw) JOIN cumw c ON
 {u_sql("'3:symbol:' || draw")} >= lo AND {u_sql("'3:symbol:' || draw")} < hi) d JOIN starts s ON s.symbol = d.symbol AND s.win = d.win""", "cumw", "starts"))
def sample_windows(spark, sf_dir):
    return R.sample_windows(pin(starts(spark, sf_dir)), 2000, 3).select("draw", "symbol", "win", "row_idx")


@query("cap_per_group", sql(
    f"SELECT symbol, bar_open_ms FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {u_sql(chr(39) + '4:' + chr(39) + ' || symbol || ' + chr(39) + ':' + chr(39) + ' || bar_open_ms')}, symbol, bar_open_ms) AS r "
    "FROM decs) WHERE r <= 25", "decs"))
def cap_per_group(spark, sf_dir):
    d = Q.decisions(Q.labelled(spark, sf_dir)).select("symbol", "bar_open_ms")
    return R.cap_per_group(d, ["symbol"], 25, 4, ["symbol", "bar_open_ms"])


cte("permuted", f"""SELECT a.* EXCLUDE ({', '.join(f'x_{d}, m_{d}' for d in range(7, 13))}), {', '.join(f'b.x_{d}, b.m_{d}' for d in range(7, 13))} FROM panel a JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, segment_id
 ORDER BY {u_sql("'17:' || symbol || ':' || segment_id || ':' || seg_pos")}, seg_pos) - 1 AS p FROM panel) b ON a.symbol = b.symbol AND a.segment_id = b.segment_id AND a.seg_pos = b.p""", "panel")


@query("block_time_permute", sql(
    f"SELECT symbol, bar_open_ms, {rq('x_0')} AS x_0, {rq('x_7')} AS x_7, m_7, {rq('x_12')} AS x_12, m_12 FROM permuted", "permuted"))
def block_time_permute(spark, sf_dir):
    out = R.block_time_permute(pin(V.panel(spark, sf_dir)), 17)
    return out.select("symbol", "bar_open_ms", rd("x_0").alias("x_0"), rd("x_7").alias("x_7"), "m_7", rd("x_12").alias("x_12"), "m_12")


@query("phase_randomize")
def phase_randomize(spark, sf_dir):
    return R.phase_randomize(V.panel(spark, sf_dir).select("symbol", "segment_id", "seg_pos", "x_7", "x_8"), ["x_7", "x_8"], 1)


@query("stratified_blocked_split", sql(
    """SELECT symbol, bar_open_ms, row_idx < greatest(1, floor(take * 0.8)) AS is_train FROM (SELECT p.*, least(4000 // k + (o < 4000 % k)::INT, ns) AS take FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS ns FROM panel) p
 JOIN (SELECT symbol, row_number() OVER (ORDER BY min(bar_open_ms), symbol) - 1 AS o, count(*) OVER () AS k FROM panel GROUP BY 1) s ON p.symbol = s.symbol) WHERE row_idx < take""", "panel"))
def stratified_blocked_split(spark, sf_dir):
    from barloom.frames import global_rank
    p = pin(V.panel(spark, sf_dir).select("symbol", "bar_open_ms", "row_idx"))
    strata = p.groupBy("symbol").agg(F.min("bar_open_ms").alias("_f"))
    strata = pin(global_rank(strata, "_f", ["symbol"]).select("symbol", (F.col("rank") - 1).alias("order")))
    return R.stratified_blocked_split(p, "symbol", "row_idx", strata, 4000).select("symbol", "bar_open_ms", "is_train")


_ARM_SQL = """SELECT w.symbol, w.row_idx AS start_idx, 'micro' AS arm, avg(p.x_7) AS m7, avg(p.x_0) AS m0 FROM starts w JOIN panel p ON p.symbol = w.symbol AND p.row_idx >= w.row_idx AND p.row_idx < w.row_idx + 16
 GROUP BY 1, 2"""


@query("windows_by_arm", sql(
    f"SELECT symbol, start_idx, arm, {rq('m7')} AS m7, {rq('m0')} AS m0 FROM (" + _ARM_SQL + " UNION ALL " + _ARM_SQL.replace("'micro'", "'placebo'").replace("panel p", "permuted p")
    + " UNION ALL " + _ARM_SQL.replace("'micro'", "'constant'").replace("avg(p.x_7)", "0.0") + ")", "starts", "panel", "permuted"))
def windows_by_arm(spark, sf_dir):
    """Every arm sees the same windows; a window is a frame of its arm, taken where it starts."""
    p = pin(V.panel(spark, sf_dir))
    arms = {"micro": p, "placebo": R.block_time_permute(p, 17), "constant": U.constant_micro(p)}
    cols = ["symbol", "bar_open_ms", "segment_id", "seg_pos", "row_idx", "x_0", "x_7"]
    x = None
    for name, t in arms.items():
        part = t.select(*cols, F.lit(name).alias("arm"))
        x = part if x is None else x.unionByName(part)
    tl = S.timeline(WCFG, ("symbol", "arm"))
    f = Wn.framed(x, tl, 0, 15)
    w = tl.by_segment().rowsBetween(0, 15)
    out = f.withColumns({"m7": F.avg("x_7").over(w), "m0": F.avg("x_0").over(w), "_n": F.count("*").over(w)})
    return Wn.done(out).filter("_n = 16 and seg_pos % 4 = 0").select("symbol", F.col("row_idx").alias("start_idx"), "arm", rd("m7").alias("m7"), rd("m0").alias("m0"))


# ---- forecast diagnostics -------------------------------------------------------------------------------------------

cte("volp", f"SELECT *, abs(y) AS rv, sigma * 2.0 AS hat, sigma_bar * 2.0 AS base, -0.5 * sigma AS q10, 0.5 * sigma AS q90 FROM decs WHERE y IS NOT NULL", "decs")


def vol_rows(spark, sf_dir):
    d = Q.decisions(Q.labelled(spark, sf_dir)).filter("y is not null")
    return d.withColumns({"rv": F.abs("y"), "hat": F.col("sigma") * 2.0, "base": F.col("sigma_bar") * 2.0, "q10": F.col("sigma") * -0.5, "q90": F.col("sigma") * 0.5})


@query("vol_mae_r2", sql(
    f"""SELECT symbol, {rq('avg(abs(hat - rv))')} AS mae, {rq('1 - sum((rv - hat) * (rv - hat)) / (var_pop(rv) * count(*))')} AS r2_vs_mean, {rq('1 - sum((rv - hat) * (rv - hat)) / sum((rv - base) * (rv - base))')}
 AS r2_vs_baseline, {rq('avg(abs(base - rv))')} AS mae_baseline FROM volp GROUP BY 1""", "volp"))
def vol_mae_r2(spark, sf_dir):
    out = T.vol_mae_r2(vol_rows(spark, sf_dir), ["symbol"], "hat", "rv", "base")
    return out.select("symbol", *[rd(c).alias(c) for c in out.columns if c != "symbol"])


def _pin(q, c):
    return f"avg(CASE WHEN y >= {c} THEN {q} * (y - {c}) ELSE ({q} - 1) * (y - {c}) END)"


@query("mean_pinball", sql(f"SELECT symbol, {rq(f'({_pin(0.1, chr(113) + str(10))} + {_pin(0.9, chr(113) + str(90))}) / 2')} AS mean_pinball FROM volp GROUP BY 1", "volp"))
def mean_pinball(spark, sf_dir):
    return T.mean_pinball(vol_rows(spark, sf_dir), ["symbol"], "y", {0.1: "q10", 0.9: "q90"}).withColumn("mean_pinball", rd("mean_pinball"))


@query("picp_mpiw", sql(
    f"SELECT symbol, {rq('avg((q10 <= y AND y <= q90)::INT)')} AS picp, {rq('avg(q90 - q10)')} AS mpiw, {rq('abs(avg((q10 <= y AND y <= q90)::INT) - 0.8)')} AS calibration_error "
    "FROM volp GROUP BY 1", "volp"))
def picp_mpiw(spark, sf_dir):
    out = T.picp_mpiw(vol_rows(spark, sf_dir), ["symbol"], "y", "q10", "q90", 0.8)
    return out.select("symbol", *[rd(c).alias(c) for c in ("picp", "mpiw", "calibration_error")])


@query("recon_mae", sql(
    "SELECT dim, n, " + rq("mae") + " AS mae, " + rq("huber") + " AS huber, " + rq("mean_mae") + " AS mean_mae, mae < 0.9 * mean_mae AS non_degenerate FROM (" + " UNION ALL ".join(
        f"SELECT {d}::INT AS dim, count(*) AS n, avg(abs(x - r)) AS mae, avg(CASE WHEN abs(x - r) < 1 THEN 0.5 * (x - r) * (x - r) ELSE abs(x - r) - 0.5 END) AS huber, avg(abs(x - m)) AS mean_mae FROM "
        f"(SELECT x_{d} AS x, round(x_{d} * 2) / 2 AS r, avg(x_{d}) OVER () AS m FROM panel WHERE m_{d} = 0)" for d in range(7)) + ")", "panel"))
def recon_mae(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir))
    coarse = p.select("symbol", "bar_open_ms", *[(F.round(F.col(f"x_{d}") * 2) / 2).alias(f"x_{d}") for d in range(7)])
    out = T.recon_errors(p, coarse, range(7))
    return out.select("dim", "n", rd("mae").alias("mae"), rd("huber").alias("huber"), rd("mean_mae").alias("mean_mae"), "non_degenerate")


@query("decode_agreement", sql(
    f"""SELECT symbol, {rq('avg((sign(o) = sign(w))::INT)')} AS sign_agreement, {rq('var_pop(o) / var_pop(w)')} AS variance_ratio, var_pop(o) <= 1e-8 * var_pop(w) OR stddev_pop(o) <= 1e-8 AS degenerate,
 {rq('avg(abs(o - w)) / stddev_pop(w)')} AS delta_over_sd FROM (SELECT symbol, x_0 AS w, round(x_0 * 2 + x_7) / 2 AS o FROM panel) GROUP BY 1""", "panel"))
def decode_agreement(spark, sf_dir):
    p = V.panel(spark, sf_dir).select("symbol", F.col("x_0").alias("w"), (F.round(F.col("x_0") * 2 + F.col("x_7")) / 2).alias("o"))
    out = T.decode_agreement(p, ["symbol"], "o", "w")
    return out.select("symbol", rd("sign_agreement").alias("sign_agreement"), rd("variance_ratio").alias("variance_ratio"), "degenerate", rd("delta_over_sd").alias("delta_over_sd"))


@query("welch_test")
def welch_test(spark, sf_dir):
    _, head = Q.headline(spark, sf_dir)
    return T.welch_test(E.information_ratio(head, KEYS, H), "ir", 4, 5)


_CB = [(a, b) for a in range(7, 13) for b in range(7)]


@query("cross_block_dependence", sql(
    f"SELECT arm, {rq('list_avg(c)')} AS mean_abs_corr FROM (" + " UNION ALL ".join(
        f"SELECT '{arm}' AS arm, [{', '.join(f'abs(corr(x_{a}, x_{b}))' for a, b in _CB)}] AS c FROM {src}" for arm, src in (("before", "panel"), ("after", "permuted"))) + ")", "panel", "permuted"))
def cross_block_dependence(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir))
    out = [T.cross_block_dependence(t).select(F.lit(n).alias("arm"), rd("mean_abs_corr").alias("mean_abs_corr"))
           for n, t in (("before", p), ("after", R.block_time_permute(p, 17)))]
    return out[0].unionByName(out[1])


@query("copula_deficit")
def copula_deficit(spark, sf_dir):
    p = V.panel(spark, sf_dir)
    value = T.copula_deficit(p, [f"x_{d}" for d in _DIMS])
    return p.agg(F.count("*").alias("n")).withColumn("deficit", F.lit(value))


@query("subsample_drift", sql(
    f"""SELECT cell, seed, {rq('greatest(hi - w, w - lo)')} AS max_drift, greatest(hi - w, w - lo) <= 0.15 AS stable FROM (SELECT cell, seed, max(fn) FILTER (WHERE s = 'all') AS w, max(fn) AS hi, min(fn) AS lo FROM (SELECT cell, seed, 'all' AS s,
 avg((mu < 0)::INT) AS fn FROM preds GROUP BY 1, 2 UNION ALL SELECT cell, seed, 'capped', avg((mu < 0)::INT) FROM (SELECT *, row_number() OVER (PARTITION BY cell, seed, symbol ORDER BY {u_sql("'6:' || symbol || ':' || bar_open_ms")},
 symbol, bar_open_ms) AS r FROM preds) WHERE r <= 20 GROUP BY 1, 2 UNION ALL SELECT cell, seed, 'fewer', avg((mu < 0)::INT) FROM preds WHERE symbol < 'Brand#2' GROUP BY 1, 2) GROUP BY 1, 2)""", "preds"))
def subsample_drift(spark, sf_dir):
    p = pin(Q.predictions(Q.decisions(Q.labelled(spark, sf_dir))).select(*Q.UNIT, "bar_open_ms", "mu"))
    subsets = {"all": p, "capped": R.cap_per_group(p, Q.UNIT, 20, 6, ["symbol", "bar_open_ms"]), "fewer": p.filter("symbol < 'Brand#2'")}
    x = None
    for n, t in subsets.items():
        part = t.groupBy(*KEYS).agg(F.avg((F.col("mu") < 0).cast("double")).alias("fn")).withColumn("subset", F.lit(n))
        x = part if x is None else x.unionByName(part)
    return T.drift(x, "fn", KEYS).select(*KEYS, rd("max_drift").alias("max_drift"), "stable")


# ---- guards and verdict ------------------------------------------------------------------------------------------------

cte("units", """SELECT h.cell, h.seed, h.ir, d.fn AS frac_negative, a.act AS activity FROM hirs h JOIN (SELECT cell, seed, avg((mu < 0)::INT) AS fn FROM preds GROUP BY 1, 2) d ON h.cell = d.cell AND h.seed = d.seed
 JOIN (SELECT cell, seed, avg((side <> 0)::INT) AS act FROM headpreds GROUP BY 1, 2) a ON h.cell = a.cell AND h.seed = a.seed""", "hirs", "preds", "headpreds")


def units(rows, head):
    act = rows.groupBy(*KEYS).agg(F.avg((F.col("side") != 0).cast("double")).alias("activity"), F.avg((F.col("mu") < 0).cast("double")).alias("frac_negative"))
    return pin(E.information_ratio(head, KEYS, H).select(*KEYS, "ir").join(act, KEYS))


@query("degeneracy_guard", sql(
    f"""SELECT cell, {rq('avg(frac_negative)')} AS frac_negative, {rq('avg(activity)')} AS activity, avg(frac_negative) NOT BETWEEN 0.05 AND 0.95 OR avg(activity) NOT BETWEEN 1e-15 AND 1 - 1e-15 OR
 bool_or(frac_negative NOT BETWEEN 0.05 AND 0.95 OR activity <= 0 OR activity >= 1) AS degenerate FROM units GROUP BY 1""", "units"))
def degeneracy_guard(spark, sf_dir):
    out = T.degeneracy_guard(units(*Q.headline(spark, sf_dir)))
    return out.select("cell", rd("frac_negative").alias("frac_negative"), rd("activity").alias("activity"), "degenerate")


@query("power_guard", sql(
    f"""SELECT ca AS cell_a, cb AS cell_b, {rq('p.delta_ir', 3)} AS delta, {rq('greatest(ra, rb)', 3)} AS worst_range, greatest(ra, rb) >= abs(p.delta_ir) AS halts FROM paired p JOIN
 (VALUES (4, 5), (2, 1), (4, 2)) c(ca, cb) ON p.pair = ca || '-' || cb JOIN (SELECT cell, max(ir) - min(ir) AS ra FROM units GROUP BY 1) x ON x.cell = ca JOIN (SELECT cell, max(ir) - min(ir) AS rb FROM units GROUP BY 1) y
 ON y.cell = cb""", "paired", "units"))
def power_guard(spark, sf_dir):
    rows, head = Q.headline(spark, sf_dir)
    claims = paired(head).filter("pair in ('4-5', '2-1', '4-2')").select(
        F.split("pair", "-")[0].cast("int").alias("cell_a"), F.split("pair", "-")[1].cast("int").alias("cell_b"), F.col("delta_ir").alias("delta"))
    out = T.power_guard(units(rows, head), claims)
    return out.select("cell_a", "cell_b", rd("delta", 3).alias("delta"), rd("worst_range", 3).alias("worst_range"), "halts")


@query("placebo_tripwire", sql(
    f"""SELECT {rq('p', 3)} AS placebo_range, {rq('m', 3)} AS median_range, m > 0 AND p > 1.5 * m AS fired FROM (SELECT max(r) FILTER (WHERE cell = 5) AS p, median(r) FILTER (WHERE cell <= 3) AS m FROM
 (SELECT cell, max(ir) - min(ir) AS r FROM units GROUP BY 1))""", "units"))
def placebo_tripwire(spark, sf_dir):
    out = T.placebo_tripwire(units(*Q.headline(spark, sf_dir)))
    return out.select(rd("placebo_range", 3).alias("placebo_range"), rd("median_range", 3).alias("median_range"), "fired")


@query("capacity_ratio", sql(
    f"SELECT {rq('a')} AS mae_4, {rq('b')} AS mae_5, {rq('b / a')} AS ratio FROM (SELECT avg(abs(mu - y)) FILTER (WHERE cell = 4) AS a, avg(abs(mu - y)) FILTER (WHERE cell = 5) AS b FROM preds)", "preds"))
def capacity_ratio(spark, sf_dir):
    p = Q.predictions(Q.decisions(Q.labelled(spark, sf_dir))).select("cell", F.abs(F.col("mu") - F.col("y")).alias("mae"))
    out = T.capacity_ratio(p)
    return out.select(rd("mae_4").alias("mae_4"), rd("mae_5").alias("mae_5"), rd("ratio").alias("ratio"))


@query("verdict_clauses")
def verdict_clauses(spark, sf_dir):
    head, irs = Q.headline_with_trials(spark, sf_dir)
    _, var_sr, n = T.dsr_trials(irs, H)
    dsr = T.psr_dsr(T.sharpe_moments(cell_series(head), ["cell"]).filter("cell = 4"), var_sr, n).first()["dsr"]
    return T.verdict_clauses(paired_mde(head), dsr)


@query("null_fallback")
def null_fallback(spark, sf_dir):
    head, irs = Q.headline_with_trials(spark, sf_dir)
    _, var_sr, n = T.dsr_trials(irs, H)
    dsr = T.psr_dsr(T.sharpe_moments(cell_series(head), ["cell"]).filter("cell = 2"), var_sr, n).first()["dsr"]
    return T.null_fallback(paired_mde(head), dsr)


@query("missing_fields", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'o_custkey,seed' ELSE 'seed' END AS missing FROM orders")
def missing_fields(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return T.missing_fields(o, ["o_orderkey", "o_custkey", "seed"]).select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("provenance_groups", """SELECT 'flag' AS field, count(DISTINCT l_linestatus) AS n_values, 0::BIGINT AS n_missing, count(DISTINCT l_linestatus) <> 1 AS refused FROM lineitem UNION ALL
 SELECT 'unit', 1, 0, false UNION ALL SELECT 'tax', count(DISTINCT CASE WHEN l_tax > 0.01 THEN 'high' END), count(*) FILTER (WHERE NOT l_tax > 0.01), true FROM lineitem""")
def provenance_groups(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("flag"), F.lit("kg").alias("unit"), F.when(F.col("l_tax") > 0.01, "high").alias("tax"))
    return T.provenance_groups(li, ["flag", "unit", "tax"])
