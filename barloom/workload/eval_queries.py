"""J3-J6, E1-E21, A6-A10, A15, A16, K8, T25, T28, D4, D5 on decisions of the weekly panel."""

from pyspark.sql import functions as F

from barloom.operators import evaluate as E
from barloom.operators import segments as S
from barloom.operators import stats as T
from barloom.operators import windows as Wn
from barloom.session import pin
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.views import HCFG, HOUR, WCFG, WEEK, cte, rd, rq, sql

TL = S.timeline(WCFG)
# line items span weeks 1304 to 1661 (1995-01-02 to 2001-11-04): validation takes the first 96, the headline the rest
H, SEQ, NP, NV = 4, 16, 66, 24
LO, HI = 1400 * WEEK, 1664 * WEEK
VLO, VHI = 1304 * WEEK, 1400 * WEEK
CELLS, SEEDS, KS = (1, 2, 3, 4, 5), (0, 1, 2), (1.0, 1.5, 2.0, 3.0)
SEG = "PARTITION BY symbol, segment_id ORDER BY bar_open_ms"
PPY = f"sqrt({525_600 / H!r}::DOUBLE)"


def ir_sql(r):
    return f"CASE WHEN count({r}) >= 2 THEN avg({r}) / (stddev_pop({r}) + 1e-12) * {PPY} END"


cte("labelled", f"""SELECT *, CASE WHEN seg_pos < n - {H} AND n - {H} > 1 THEN v END AS y FROM (SELECT *, coalesce(sum(raw_ret_close) OVER ({SEG}
 ROWS BETWEEN 2 FOLLOWING AND {H} FOLLOWING), 0) AS v, count(*) OVER (PARTITION BY symbol, segment_id) AS n, max(row_idx) OVER (PARTITION BY symbol)
 + 1 AS ns, avg(sigma) OVER (PARTITION BY symbol ORDER BY bar_open_ms ROWS UNBOUNDED PRECEDING) AS sigma_bar,
 CASE WHEN symbol < 'Brand#2' THEN 3e-4 ELSE 1e-3 END AS spread FROM panel)""", "panel")


def _dec(lo, hi):
    return f"""SELECT *, (bar_open_ms - {lo}) // {H * WEEK} AS period, 2 * (4e-4 + 0.5 * spread * greatest(1.0, CASE WHEN sigma_bar > 0 THEN
 sigma / sigma_bar ELSE 1.0 END) + 1e-4) AS c_total FROM labelled WHERE bar_open_ms >= {lo} AND bar_open_ms < {hi} AND
 (bar_open_ms - {lo}) % {H * WEEK} = 0 AND row_idx >= {SEQ} AND row_idx + {H} < ns"""


cte("decs", _dec(LO, HI), "labelled")
cte("vdecs", _dec(VLO, VHI), "labelled")
_MU = "0.002 * (0.2 * cell * x_7 - x_0) + 0.0006 * (seed - 1)"
_UNITS = "(SELECT unnest([1, 2, 3, 4, 5]) AS cell) c, (SELECT unnest([0, 1, 2]) AS seed) s"
for _n in ("", "v"):
    cte(f"{_n}preds", f"SELECT d.*, cell::INT AS cell, seed::INT AS seed, {_MU} AS mu FROM {_n}decs d, {_UNITS} WHERE y IS NOT NULL", f"{_n}decs")
    cte(f"{_n}wide", f"""SELECT *, CASE WHEN mu > kappa * c_total THEN 1 WHEN mu < -kappa * c_total THEN -1 ELSE 0 END AS side FROM {_n}preds,
 (SELECT unnest([1.0, 1.5, 2.0, 3.0]::DOUBLE[]) AS kappa)""", f"{_n}preds")
    cte(f"{_n}series", f"""SELECT r.cell, r.seed, r.kappa, p.period::BIGINT AS period, coalesce(x.r, 0.0) AS r, coalesce(x.breadth, 0) AS breadth FROM
 (SELECT DISTINCT cell, seed, kappa FROM {_n}wide) r CROSS JOIN range({NP if not _n else NV}) p(period) LEFT JOIN (SELECT cell, seed, kappa, period,
 avg(side * y - 0.003) AS r, count(*) AS breadth FROM {_n}wide WHERE side <> 0 GROUP BY 1, 2, 3, 4) x ON x.cell = r.cell AND x.seed = r.seed AND
 x.kappa = r.kappa AND x.period = p.period""", f"{_n}wide")
    cte(f"{_n}irs", f"SELECT cell, seed, kappa, {ir_sql('r')} AS ir FROM {_n}series GROUP BY 1, 2, 3", f"{_n}series")
cte("kstar", """SELECT cell, seed, coalesce(arg_max(kappa, (ir, -kappa)) FILTER (WHERE ir IS NOT NULL), 1.0) AS kappa FROM virs GROUP BY 1, 2""", "virs")
cte("head", "SELECT s.* FROM series s JOIN kstar k ON s.cell = k.cell AND s.seed = k.seed AND s.kappa = k.kappa", "series", "kstar")
cte("headpreds", "SELECT w.* FROM wide w JOIN kstar k ON w.cell = k.cell AND w.seed = k.seed AND w.kappa = k.kappa", "wide", "kstar")

KEYS = ["cell", "seed"]
UNIT = [*KEYS, "symbol"]


def labelled(spark, sf_dir):
    """Panel with forward return, causal mean volatility and spread, computed once per query."""
    p = pin(V.panel(spark, sf_dir))
    y = Wn.forward_returns(p, TL, H).withColumn("spread", F.when(F.col("symbol") < "Brand#2", 3e-4).otherwise(1e-3))
    return pin(Wn.expanding_sigma(pin(y), TL))


def decisions(lab, lo=LO, hi=HI):
    d = E.symbol_decisions(lab, lo, hi, H, SEQ, WEEK)
    return d.withColumn("c_total", E.c_total(F.col("spread"), F.col("sigma"), F.col("sigma_bar")))


def predictions(dec):
    """Fifteen (cell, seed) units of simple causal predictors."""
    units = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(s).alias("seed")) for c in CELLS for s in SEEDS]))
    x = dec.filter("y is not null").withColumn("_u", units).select("*", "_u.cell", "_u.seed").drop("_u")
    return x.withColumn("mu", (F.col("cell") * 0.2 * F.col("x_7") - F.col("x_0")) * 0.002 + (F.col("seed") - 1) * 0.0006)


def scored_with_trials(spark, sf_dir):
    """(headline predictions x kappa, headline series, kappa choice, validation IRs at every kappa) of every unit."""
    lab = labelled(spark, sf_dir)
    wide = E.with_kappas(predictions(decisions(lab)))
    vwide = E.with_kappas(predictions(decisions(lab, VLO, VHI)))
    irs = pin(E.information_ratio(pool(vwide, NV), [*KEYS, "kappa"], H))
    wide = pin(wide)
    return wide, pool(wide, NP), pin(E.choose_kappa(irs, KEYS)), irs


def scored(spark, sf_dir):
    return scored_with_trials(spark, sf_dir)[:3]


def pool(wide, n):
    nets = wide.filter("side <> 0").withColumn("net", E.net_return(F.col("side"), F.col("y"), F.lit(0.003)))
    return E.pool_periods(nets, wide, [*KEYS, "kappa"], n)


def headline(spark, sf_dir):
    wide, series, kstar = scored(spark, sf_dir)
    on = [*KEYS, "kappa"]
    return wide.join(kstar, on), pin(series.join(kstar, on))


def headline_with_trials(spark, sf_dir):
    """Headline series at the chosen kappa, and the validation IRs at every kappa."""
    _, series, kstar, irs = scored_with_trials(spark, sf_dir)
    return pin(series.join(kstar, [*KEYS, "kappa"])), irs


@query("decision_grid", sql(
    f"""SELECT g.bar_open_ms, (g.bar_open_ms - lo) // {H * WEEK} AS period, count(p.symbol) AS n_symbols FROM (SELECT unnest(generate_series(min(bar_open_ms)::BIGINT, max(bar_open_ms)::BIGINT,
 {H * WEEK})) AS bar_open_ms, min(bar_open_ms)::BIGINT AS lo FROM wklines) g LEFT JOIN wklines p ON p.bar_open_ms = g.bar_open_ms GROUP BY 1, 2""", "wklines"))
def decision_grid(spark, sf_dir):
    """Grid over the whole span of the bars with the number of symbols present at each instant."""
    k = pin(V.wklines(spark, sf_dir).select("symbol", "bar_open_ms"))
    lo, hi = k.agg(F.min("bar_open_ms"), F.max("bar_open_ms")).first()
    grid = E.decision_grid(spark, lo, hi + 1, H, WEEK)
    return grid.join(k, "bar_open_ms", "left").groupBy("bar_open_ms", "period").agg(F.count("symbol").alias("n_symbols"))


@query("symbol_decisions", sql(f"SELECT symbol, bar_open_ms, period, {rq('y')} AS y FROM decs", "decs"))
def symbol_decisions(spark, sf_dir):
    return decisions(labelled(spark, sf_dir)).select("symbol", "bar_open_ms", "period", rd("y").alias("y"))


@query("trading_cost", sql(f"SELECT symbol, bar_open_ms, {rq('c_total', 9)} AS c_total FROM decs", "decs"))
def trading_cost(spark, sf_dir):
    return decisions(labelled(spark, sf_dir)).select("symbol", "bar_open_ms", rd("c_total", 9).alias("c_total"))


@query("attach_spread", sql(
    "SELECT symbol, bar_open_ms, CASE WHEN symbol < 'Brand#2' THEN 3e-4 ELSE 1e-3 END AS spread FROM panel", "panel"))
def attach_spread(spark, sf_dir):
    p = V.panel(spark, sf_dir).select("symbol", "bar_open_ms")
    tiers = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().withColumn(
        "spread", F.when(F.col("symbol") < "Brand#2", 3e-4).otherwise(1e-3))
    return E.attach_spread(p, tiers)


@query("funding_cost", sql(
    f"""SELECT d.symbol, d.bar_open_ms::BIGINT AS bar_open_ms, {rq('any_value(d.side) * coalesce(sum(f.value), 0)', 8)} AS funding_cost FROM
 (SELECT *, sign(close - open)::INT AS side FROM klines) d LEFT JOIN funding f ON d.symbol = f.symbol AND f.ts_ms > d.bar_open_ms + {HOUR} AND
 f.ts_ms <= d.bar_open_ms + {4 * HOUR} GROUP BY 1, 2""", "klines", "funding"))
def funding_cost(spark, sf_dir):
    d = V.klines(spark, sf_dir).select("symbol", "bar_open_ms", F.signum(F.col("close") - F.col("open")).alias("side"))
    out = E.funding_cost(pin(d), pin(V.funding(spark, sf_dir)), 4, S.timeline(HCFG))
    return out.select("symbol", "bar_open_ms", rd("funding_cost", 8).alias("funding_cost"))


@query("positions", sql("SELECT symbol, bar_open_ms, cell, seed, kappa, side::INT AS side FROM wide", "wide"))
def positions(spark, sf_dir):
    return E.with_kappas(predictions(decisions(labelled(spark, sf_dir)))).select("symbol", "bar_open_ms", "cell", "seed", "kappa", "side")


@query("net_trade_returns", sql(
    f"SELECT symbol, bar_open_ms, cell, seed, kappa, {rq('side * y - c_total')} AS net FROM wide WHERE side <> 0", "wide"))
def net_trade_returns(spark, sf_dir):
    w = E.with_kappas(predictions(decisions(labelled(spark, sf_dir)))).filter("side <> 0")
    return w.select("symbol", "bar_open_ms", "cell", "seed", "kappa", rd(E.net_return(F.col("side"), F.col("y"), F.col("c_total"))).alias("net"))


@query("pool_periods", sql(f"SELECT cell, seed, kappa, period, {rq('r')} AS r, breadth FROM series", "series"))
def pool_periods(spark, sf_dir):
    return pool(pin(E.with_kappas(predictions(decisions(labelled(spark, sf_dir))))), NP).withColumn("r", rd("r"))


@query("information_ratio", sql(
    f"SELECT cell, seed, kappa, {rq(ir_sql('r'), 4)} AS ir, {rq('avg((r <> 0)::INT)')} AS activity, count(*) FILTER (WHERE r = 0) AS n_flat, "
    "count(*) AS n_periods FROM series GROUP BY 1, 2, 3", "series"))
def information_ratio(spark, sf_dir):
    s = pool(pin(E.with_kappas(predictions(decisions(labelled(spark, sf_dir))))), NP)
    return E.information_ratio(s, [*KEYS, "kappa"], H).withColumns({"ir": rd("ir", 4), "activity": rd("activity")})


@query("decision_activity", sql(
    f"SELECT cell, seed, kappa, count(*) AS scored, count(*) FILTER (WHERE side <> 0) AS traded, {rq('avg((side <> 0)::INT)')} AS activity "
    "FROM wide GROUP BY 1, 2, 3", "wide"))
def decision_activity(spark, sf_dir):
    w = E.with_kappas(predictions(decisions(labelled(spark, sf_dir))))
    return E.decision_activity(w, KEYS).withColumn("activity", rd("activity"))


@query("mu_diag", sql(
    f"SELECT cell, seed, {rq('avg(mu)', 9)} AS mean, {rq('stddev_pop(mu)', 9)} AS std, {rq('avg((mu < 0)::INT)')} AS frac_negative, count(*) AS n, "
    f"{rq('corr(mu, y)')} AS corr_y FROM preds GROUP BY 1, 2", "preds"))
def mu_diag(spark, sf_dir):
    out = E.mu_diag(predictions(decisions(labelled(spark, sf_dir))), KEYS)
    return out.withColumns({"mean": rd("mean", 9), "std": rd("std", 9), "frac_negative": rd("frac_negative"), "corr_y": rd("corr_y")})


@query("choose_kappa", sql("SELECT cell, seed, kappa FROM kstar", "kstar"))
def choose_kappa(spark, sf_dir):
    vw = pin(E.with_kappas(predictions(decisions(labelled(spark, sf_dir), VLO, VHI))))
    return E.choose_kappa(E.information_ratio(pool(vw, NV), [*KEYS, "kappa"], H), KEYS)


@query("market_mean", sql(f"SELECT period, {rq('avg(y)')} AS market, count(*) AS breadth FROM decs WHERE y IS NOT NULL GROUP BY 1", "decs"))
def market_mean(spark, sf_dir):
    return E.market_mean(decisions(labelled(spark, sf_dir))).withColumn("market", rd("market"))


cte("stress", f"""SELECT cell, seed, cost, {ir_sql('r2')} AS ir FROM (SELECT *, CASE WHEN r <> 0 THEN r - (cost - 0.003) ELSE 0 END AS r2 FROM head,
 (SELECT unnest([0.001, 0.002, 0.003, 0.1, 0.5]::DOUBLE[]) AS cost)) GROUP BY 1, 2, 3""", "head")
_COSTS = (0.001, 0.002, 0.003, 0.1, 0.5)


@query("cost_stress", sql(f"SELECT cell, seed, cost, {rq('ir', 4)} AS ir FROM stress", "stress"))
def cost_stress(spark, sf_dir):
    _, head = headline(spark, sf_dir)
    return E.cost_stress(head, KEYS, H, 0.003, _COSTS).withColumn("ir", rd("ir", 4))


@query("break_even_cost", sql(
    f"""SELECT cell, seed, CASE WHEN min(ir) > 0 THEN 'above' WHEN max(ir) <= 0 THEN 'below' ELSE 'inside' END AS place, {rq('''CASE WHEN min(ir) > 0 OR
 max(ir) <= 0 THEN 0 ELSE arg_min(root, cost) FILTER (WHERE root IS NOT NULL) END''', 5)} AS c_break FROM (SELECT *, CASE WHEN ni IS NOT NULL AND ir = 0
 THEN cost WHEN (ir > 0 AND ni <= 0) OR (ir < 0 AND ni >= 0) THEN cost + ir / (ir - ni) * (nc - cost) END AS root FROM (SELECT *, lead(ir) OVER w AS ni,
 lead(cost) OVER w AS nc FROM stress WINDOW w AS (PARTITION BY cell, seed ORDER BY cost))) GROUP BY 1, 2""", "stress"))
def break_even_cost(spark, sf_dir):
    _, head = headline(spark, sf_dir)
    out = E.break_even_cost(E.cost_stress(head, KEYS, H, 0.003, _COSTS), KEYS)
    inf = F.lit(float("inf"))
    place = F.when(F.col("c_break") == inf, "above").when(F.col("c_break") == -inf, "below").otherwise("inside")
    return out.select("cell", "seed", place.alias("place"), rd(F.when(place == "inside", F.col("c_break")).otherwise(0.0), 5).alias("c_break"))


@query("gross_series", sql(f"SELECT cell, seed, period, {rq('CASE WHEN r <> 0 THEN r + 0.003 ELSE r END')} AS g FROM head", "head"))
def gross_series(spark, sf_dir):
    _, head = headline(spark, sf_dir)
    return head.select("cell", "seed", "period", rd(E.gross(F.col("r"), 0.003)).alias("g"))


@query("break_even_interval", sql(
    f"""SELECT cell, seed, n AS n_active, {rq('m')} AS c_break, {rq('se')} AS se, {rq('m / se', 5)} AS t_stat, {rq('m - 1.96 * se')} AS ci_low,
 {rq('m + 1.96 * se')} AS ci_high, {rq('l1')} AS lag1 FROM (SELECT cell, seed, count(*) AS n, any_value(m) AS m, stddev_samp(g) / sqrt(count(*)) AS se,
 sum(d * p) / sum(d * d) AS l1 FROM (SELECT *, lag(d) OVER (PARTITION BY cell, seed ORDER BY period) AS p FROM (SELECT *, g - avg(g) OVER (PARTITION BY
 cell, seed) AS d, avg(g) OVER (PARTITION BY cell, seed) AS m FROM (SELECT *, r + 0.003 AS g FROM head WHERE r <> 0))) GROUP BY 1, 2)""", "head"))
def break_even_interval(spark, sf_dir):
    _, head = headline(spark, sf_dir)
    out = E.break_even_interval(head, KEYS, 0.003)
    return out.withColumns({c: rd(c, 5 if c == "t_stat" else 6) for c in ("c_break", "se", "t_stat", "ci_low", "ci_high", "lag1")})


@query("activity_bounds", sql(
    f"SELECT cell, seed, kappa, {rq(f'ir * ir / ({525_600 / H!r}::DOUBLE + ir * ir)', 8)} AS bound, {rq(f'CASE WHEN ir > 0 THEN {H} * 0.003 / ir END', 8)} "
    "AS horizon FROM irs", "irs"))
def activity_bounds(spark, sf_dir):
    s = pool(pin(E.with_kappas(predictions(decisions(labelled(spark, sf_dir))))), NP)
    i = E.information_ratio(s, [*KEYS, "kappa"], H)
    return i.select("cell", "seed", "kappa", rd(E.activity_lower_bound(F.col("ir"), H), 8).alias("bound"),
                    rd(E.required_horizon(F.col("ir"), H, 0.003), 8).alias("horizon"))


@query("score_cell", sql(
    f"""SELECT h.cell, h.seed, any_value(h.kappa) AS kappa, {rq(ir_sql('h.r'), 4)} AS ir, {rq('avg((h.r <> 0)::INT)')} AS activity,
 {rq('any_value(d.fn)')} AS frac_negative, any_value(d.n) AS n FROM head h JOIN (SELECT cell, seed, avg((mu < 0)::INT) AS fn, count(*) AS n FROM preds
 GROUP BY 1, 2) d ON h.cell = d.cell AND h.seed = d.seed GROUP BY 1, 2""", "head", "preds"))
def score_cell(spark, sf_dir):
    rows, head = headline(spark, sf_dir)
    diag = E.mu_diag(rows, KEYS).select(*KEYS, rd("frac_negative").alias("frac_negative"), "n")
    i = E.information_ratio(head, [*KEYS, "kappa"], H).select(*KEYS, "kappa", rd("ir", 4).alias("ir"), rd("activity").alias("activity"))
    return i.join(diag, KEYS)


@query("single_symbol_backtest", sql(
    f"""SELECT cell, seed, symbol, {rq(ir_sql('r'), 4)} AS ir, {rq('avg((r <> 0)::INT)')} AS activity, count(*) AS n_periods FROM (SELECT cell, seed, symbol, CASE WHEN side <> 0
 THEN side * y - c_total ELSE 0.0 END AS r FROM wide WHERE kappa = 1.0) GROUP BY 1, 2, 3""", "wide"))
def single_symbol_backtest(spark, sf_dir):
    w = E.with_kappas(predictions(decisions(labelled(spark, sf_dir))), [1.0])
    w = w.withColumn("r", F.when(F.col("side") != 0, E.net_return(F.col("side"), F.col("y"), F.col("c_total"))).otherwise(0.0))
    return E.information_ratio(w, UNIT, H).select(*UNIT, rd("ir", 4).alias("ir"), rd("activity").alias("activity"), "n_periods")


@query("single_symbol_report", sql(
    f"""SELECT cell, seed, symbol, {rq('corr(mu, y)')} AS ic, {rq('corr(rm, ry)')} AS rank_ic, {rq('avg(abs(abs(y) - s2))')} AS vol_mae,
 {rq('avg((y >= mu - 1.2816 * s2 AND y <= mu + 1.2816 * s2)::INT)')} AS picp, {rq('avg(2 * 1.2816 * s2)')} AS mpiw FROM (SELECT *, sigma * sqrt({H}) AS s2,
 rank() OVER (PARTITION BY cell, seed, symbol ORDER BY mu) + (count(*) OVER (PARTITION BY cell, seed, symbol, mu) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY cell, seed, symbol ORDER BY y)
 + (count(*) OVER (PARTITION BY cell, seed, symbol, y) - 1) / 2.0 AS ry FROM preds) GROUP BY 1, 2, 3""", "preds"))
def single_symbol_report(spark, sf_dir):
    p = pin(predictions(decisions(labelled(spark, sf_dir))).select(*UNIT, "bar_open_ms", "mu", "y", "sigma"))
    p = Wn.average_rank(Wn.average_rank(p, UNIT, "mu", "_rm"), UNIT, "y", "_ry")
    s2 = F.col("sigma") * F.sqrt(F.lit(float(H)))
    band = s2 * 1.2816
    inside = (F.col("y") >= F.col("mu") - band) & (F.col("y") <= F.col("mu") + band)
    return p.groupBy(*UNIT).agg(
        rd(T.pearson("mu", "y")).alias("ic"), rd(T.pearson("_rm", "_ry")).alias("rank_ic"), rd(F.avg(F.abs(F.abs("y") - s2))).alias("vol_mae"),
        rd(F.avg(inside.cast("double"))).alias("picp"), rd(F.avg(band * 2)).alias("mpiw"))


cte("hirs", f"SELECT cell, seed, {ir_sql('r')} AS ir FROM head GROUP BY 1, 2", "head")


@query("ablation_verdict", sql(
    f"""SELECT seed, {rq('c4 - c5', 4)} AS micro_minus_placebo, {rq('c2 - c1', 4)} AS tokenizer_effect, {rq('c4 - c3', 4)} AS micro_effect,
 {rq('c4 - c2', 4)} AS four_minus_two, {rq('c3 - c1', 4)} AS three_minus_one, c4 > c5 AS micro_beats_placebo FROM (SELECT seed, """
    + ", ".join(f"max(ir) FILTER (WHERE cell = {c}) AS c{c}" for c in CELLS) + " FROM hirs GROUP BY 1)", "hirs"))
def ablation_verdict(spark, sf_dir):
    _, head = headline(spark, sf_dir)
    out = E.ablation(E.information_ratio(head, KEYS, H), ["seed"])
    return out.withColumns({c: rd(c, 4) for c in out.columns if c not in ("seed", "micro_beats_placebo")})


@query("skill_vs_bias", sql(
    f"""SELECT cell, seed, {rq(ir_sql('g'), 4)} AS ir_model, {rq(ir_sql('b'), 4)} AS ir_bias, count(*) FILTER (WHERE r <> 0) AS n_active FROM
 (SELECT h.*, CASE WHEN r <> 0 THEN r + 0.003 ELSE r END AS g, CASE WHEN r <> 0 THEN (CASE WHEN fn > 0.5 THEN -1 ELSE 1 END) * coalesce(m.market, 0)
 ELSE 0 END AS b FROM head h JOIN (SELECT cell, seed, avg((mu < 0)::INT) AS fn FROM preds GROUP BY 1, 2) d ON h.cell = d.cell AND h.seed = d.seed
 LEFT JOIN (SELECT period, avg(y) AS market FROM decs WHERE y IS NOT NULL GROUP BY 1) m ON m.period = h.period) GROUP BY 1, 2""", "head", "preds", "decs"))
def skill_vs_bias(spark, sf_dir):
    rows, head = headline(spark, sf_dir)
    one = rows.select("symbol", "period", "y").distinct()
    out = E.skill_vs_bias(head, E.mu_diag(rows, KEYS), E.market_mean(one), KEYS, H, 0.003)
    return out.select("cell", "seed", rd("ir_model", 4).alias("ir_model"), rd("ir_bias", 4).alias("ir_bias"), "n_active")


cte("diag_traded", "SELECT cell, seed, avg((side < 0)::INT) AS frac_negative FROM headpreds GROUP BY 1, 2", "headpreds")


@query("constant_book_lattice", sql(
    """SELECT h.cell, h.seed, CASE WHEN ir = 0 THEN 'flat' WHEN fn = 1 THEN 'all_short' WHEN fn = 0 THEN 'all_long' ELSE 'mixed' END AS direction,
 count(*) OVER (PARTITION BY round(ir, 9)) AS multiplicity, ir = 0 OR max((fn IN (0, 1) OR ir = 0)::INT) OVER (PARTITION BY round(ir, 9)) = 1 AS on_lattice
 FROM hirs h JOIN (SELECT cell, seed, avg((mu < 0)::INT) AS fn FROM preds GROUP BY 1, 2) d ON h.cell = d.cell AND h.seed = d.seed""", "hirs", "preds"))
def constant_book_lattice(spark, sf_dir):
    rows, head = headline(spark, sf_dir)
    units = E.information_ratio(head, KEYS, H).join(E.mu_diag(rows, KEYS), KEYS)
    return E.constant_book_lattice(units).select("cell", "seed", "direction", "multiplicity", "on_lattice")


cte("pairs", """SELECT a.cell, a.seed, a.symbol, a.bar_open_ms, a.y, a.c_total, a.mu AS mu_a, a.mu + 0.0004 * b.x_8 * (b.row_idx % 3) AS mu_b FROM preds a JOIN panel b
 ON a.symbol = b.symbol AND a.bar_open_ms = b.bar_open_ms""", "preds", "panel")


def pairs(spark, sf_dir):
    p = predictions(decisions(labelled(spark, sf_dir)))
    return p.select(*UNIT, "bar_open_ms", "y", "c_total", F.col("mu").alias("mu_a"),
                    (F.col("mu") + F.col("x_8") * 0.0004 * (F.col("row_idx") % 3)).alias("mu_b"))


_THETA = {"low": 0.0005, "mid": 0.0015, "high": 0.003}


def _pos(m):
    return f"CASE WHEN {m} > theta THEN 1 WHEN {m} < -theta THEN -1 ELSE 0 END"


@query("decision_stability", sql(
    f"""SELECT cell, seed, label, theta, count(*) AS n, count(*) FILTER (WHERE pa <> pb) AS flipped, {rq('avg((pa <> pb)::INT)')} AS flip_rate,
 {rq('avg((pa <> 0)::INT)')} AS activity_a, {rq('avg((pb <> 0)::INT)')} AS activity_b, count(*) FILTER (WHERE (pa <> 0) <> (pb <> 0)) = 0 AS same_traded_set,
 count(*) FILTER (WHERE abs(abs(mu_a) - theta) <= gap) > 0 AS discriminates FROM (SELECT *, max(abs(mu_a - mu_b)) OVER (PARTITION BY cell, seed) AS gap, {_pos('mu_a')} AS pa,
 {_pos('mu_b')} AS pb FROM pairs, (VALUES ('low', 0.0005::DOUBLE), ('mid', 0.0015::DOUBLE), ('high', 0.003::DOUBLE)) t(label, theta)) GROUP BY 1, 2, 3, 4""", "pairs"))
def decision_stability(spark, sf_dir):
    out = E.decision_stability(pin(pairs(spark, sf_dir)), _THETA, KEYS)
    return out.withColumns({c: rd(c) for c in ("flip_rate", "activity_a", "activity_b")})


@query("sign_agreement", sql(
    f"""SELECT cell, seed, symbol, count(*) AS n, {rq('avg(((mu_a < 0) = (mu_b < 0))::INT)')} AS agreement, {rq('avg(mu_a - mu_b)', 9)} AS gap_mean,
 {rq('stddev_pop(mu_a - mu_b)', 9)} AS gap_std, {rq('avg(abs(mu_a - mu_b))', 9)} AS gap_abs_mean, avg(((mu_a < 0) = (mu_b < 0))::INT) >= 0.97 AS passes
 FROM pairs WHERE abs(mu_a) > c_total GROUP BY 1, 2, 3""", "pairs"))
def sign_agreement(spark, sf_dir):
    out = E.sign_agreement(pairs(spark, sf_dir), F.abs("mu_a") > F.col("c_total"), UNIT)
    return out.withColumns({c: rd(c, 6 if c == "agreement" else 9) for c in ("agreement", "gap_mean", "gap_std", "gap_abs_mean")})


@query("direction_balance", sql(
    f"""SELECT cell, seed, symbol, n, {rq('md', 9)} AS mean_delta, {rq('md / se', 4)} AS t_stat, n_enter, n_exit, {rq('n_enter / (n_enter + n_exit)')} AS enter_fraction,
 {rq('abs(2 * n_enter / (n_enter + n_exit) - 1) + 1.6448536269514722 / sqrt(n_enter + n_exit)')} AS imbalance_upper95,
 {rq('(n_enter - (n_enter + n_exit) / 2) / (0.5 * sqrt(n_enter + n_exit))')} AS z_balance FROM (SELECT cell, seed, symbol, count(*) AS n, avg(mu_b - mu_a) AS md,
 stddev_samp(mu_b - mu_a) / sqrt(count(*)) AS se, count(*) FILTER (WHERE abs(mu_b) > abs(mu_a)) AS n_enter, count(*) FILTER (WHERE abs(mu_b) < abs(mu_a))
 AS n_exit FROM pairs GROUP BY 1, 2, 3)""", "pairs"))
def direction_balance(spark, sf_dir):
    out = E.direction_balance(pairs(spark, sf_dir), UNIT)
    return out.select(*UNIT, "n", rd("mean_delta", 9).alias("mean_delta"), rd("t_stat", 4).alias("t_stat"), "n_enter", "n_exit",
                      rd("enter_fraction").alias("enter_fraction"), rd("imbalance_upper95").alias("imbalance_upper95"), rd("z_balance").alias("z_balance"))


@query("sign_disagreement", sql(
    f"""SELECT cell, n, {rq('un')} AS unanimity, {rq('p0')} AS p_up_0, {rq('p1')} AS p_up_1, {rq('p2')} AS p_up_2, {rq('a01')} AS agree_0_1, {rq('a02')} AS agree_0_2,
 {rq('a12')} AS agree_1_2, {rq('p0 * p1 * p2 + (1 - p0) * (1 - p1) * (1 - p2)')} AS expected_unanimity FROM (SELECT cell, count(*) AS n, avg((u0 = u1 AND u1 = u2)::INT)
 AS un, avg(u0::INT) AS p0, avg(u1::INT) AS p1, avg(u2::INT) AS p2, avg((u0 = u1)::INT) AS a01, avg((u0 = u2)::INT) AS a02, avg((u1 = u2)::INT) AS a12 FROM
 (SELECT cell, bool_or(mu > 0) FILTER (WHERE seed = 0) AS u0, bool_or(mu > 0) FILTER (WHERE seed = 1) AS u1, bool_or(mu > 0) FILTER (WHERE seed = 2) AS u2
 FROM preds GROUP BY cell, symbol, bar_open_ms) GROUP BY 1)""", "preds"))
def sign_disagreement(spark, sf_dir):
    out = E.sign_disagreement(predictions(decisions(labelled(spark, sf_dir))), SEEDS, ["cell"])
    return out.withColumns({c: rd(c) for c in out.columns if c not in ("cell", "n")})


@query("estimator_majority", sql(
    """SELECT *, min(n_positive * 2 > n_seeds) OVER (PARTITION BY cell) <> max(n_positive * 2 > n_seeds) OVER (PARTITION BY cell) AS disagree FROM
 (SELECT cell, estimator, sum((v > 0)::INT)::BIGINT AS n_positive, count(*) AS n_seeds FROM (SELECT cell, seed, unnest(['mean', 'median']) AS estimator,
 unnest([avg(mu), median(mu)]) AS v FROM preds GROUP BY 1, 2) GROUP BY 1, 2)""", "preds"))
def estimator_majority(spark, sf_dir):
    from barloom.frames import exact_quantiles
    p = pin(predictions(decisions(labelled(spark, sf_dir))).select(*KEYS, "mu"))
    est = p.groupBy(*KEYS).agg(F.avg("mu").alias("mean")).join(exact_quantiles(p, KEYS, "mu", {"median": 0.5}), KEYS)
    return E.estimator_majority(pin(est), ["mean", "median"], ["cell"])


@query("prediction_parity", sql(
    "SELECT symbol, bar_open_ms, row_idx % 5 = 1 AS missing_left, row_idx % 5 = 2 AS missing_right FROM decs WHERE y IS NOT NULL AND row_idx % 5 IN (0, 1, 2)", "decs"))
def prediction_parity(spark, sf_dir):
    p = pin(decisions(labelled(spark, sf_dir)).filter("y is not null").select("symbol", "bar_open_ms", "row_idx", F.col("x_0").alias("mu")))
    a = p.filter("row_idx % 5 <> 1")
    b = p.filter("row_idx % 5 <> 2").withColumn("mu", F.when(F.col("row_idx") % 5 == 0, F.col("mu") + 1).otherwise(F.col("mu")))
    return E.prediction_parity(a, b, ["symbol", "bar_open_ms"], ["mu"])


def _hz(h):
    """Decisions of one horizon with a simple reversal predictor."""
    v = f"coalesce(sum(raw_ret_close) OVER ({SEG} ROWS BETWEEN 2 FOLLOWING AND {max(h, 2)} FOLLOWING), 0)" if h >= 2 else "0.0"
    return f"""SELECT {h}::INT AS h, (bar_open_ms - {LO}) // {h * WEEK} AS period, v AS y, -0.002 * x_0 AS mu, CASE WHEN -0.002 * x_0 > 0.0013 THEN 1
 WHEN -0.002 * x_0 < -0.0013 THEN -1 ELSE 0 END AS side FROM (SELECT *, {v} AS v, count(*) OVER (PARTITION BY symbol, segment_id) AS n, max(row_idx) OVER
 (PARTITION BY symbol) + 1 AS ns FROM panel) WHERE seg_pos < n - {h} AND n - {h} > 1 AND bar_open_ms >= {LO} AND bar_open_ms < {HI} AND
 (bar_open_ms - {LO}) % {h * WEEK} = 0 AND row_idx >= {SEQ} AND row_idx + {h} < ns"""


cte("hz", " UNION ALL ".join(_hz(h) for h in (1, 2, 4)), "panel")


@query("horizon_sweep", sql(
    """SELECT h, activity > 0 AND activity < 1 AS activity_binds, fn BETWEEN 0.05 AND 0.95 AS sign_balanced, ir > 0 AS ir_positive, h = 1 AS void,
 activity > 0 AND activity < 1 AND fn BETWEEN 0.05 AND 0.95 AND ir > 0 AND h <> 1 AS all_three FROM (SELECT h, avg((side <> 0)::INT) AS activity,
 avg((mu < 0)::INT) AS fn FROM hz GROUP BY 1) JOIN (SELECT h, avg(r) / (stddev_pop(r) + 1e-12) AS ir FROM (SELECT h, period, avg(CASE WHEN side <> 0 THEN
 side * y - 0.003 ELSE 0 END) AS r FROM hz GROUP BY 1, 2) GROUP BY 1) USING (h)""", "hz"))
def horizon_sweep(spark, sf_dir):
    """Activity, sign balance and IR per horizon; horizon is a column of one plan."""
    p = pin(V.panel(spark, sf_dir))
    parts = []
    for h in (1, 2, 4):
        y = Wn.forward_returns(p, TL, h).withColumn("h", F.lit(h))
        parts.append(E.symbol_decisions(y, LO, HI, h, SEQ, WEEK).filter("y is not null"))
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("mu", -F.col("x_0") * 0.002)
    x = x.withColumn("side", E.positions(F.col("mu"), F.lit(0.0013)))
    per = x.groupBy("h").agg(F.avg((F.col("side") != 0).cast("double")).alias("activity"), F.avg((F.col("mu") < 0).cast("double")).alias("frac_negative"))
    nets = x.groupBy("h", "period").agg(F.avg(F.when(F.col("side") != 0, F.col("side") * F.col("y") - 0.003).otherwise(0.0)).alias("r"))
    irs = nets.groupBy("h").agg(E.ir("r", 1).alias("ir"))
    return E.upgrade_test(per.join(irs, "h")).select("h", "activity_binds", "sign_balanced", "ir_positive", "void", "all_three")


cte("base_series", """SELECT unnest(['no_trade', 'hold', 'momentum', 'reversal']) AS strategy, unnest([0.0, 1.0, sign(x_0), -sign(x_0)]::DOUBLE[]) AS s,
 period, y FROM decs WHERE y IS NOT NULL""", "decs")


@query("naive_baselines", sql(
    f"""SELECT strategy, {rq('ir', 4)} AS ir, {rq('ir - max(ir) OVER ()', 4)} AS incremental_over_best FROM (SELECT strategy, {ir_sql('r')} AS ir FROM
 (SELECT strategy, p.period, coalesce(r, 0.0) AS r FROM (SELECT DISTINCT strategy FROM base_series) b CROSS JOIN range({NP}) p(period) LEFT JOIN (SELECT strategy AS st,
 period AS pd, avg(s * y - 0.003) AS r FROM base_series WHERE s <> 0 GROUP BY 1, 2) x ON x.st = b.strategy AND x.pd = p.period) GROUP BY 1)""", "base_series"))
def naive_baselines(spark, sf_dir):
    d = decisions(labelled(spark, sf_dir)).filter("y is not null")
    s = F.signum("x_0")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), v.cast("double").alias("side")) for n, v in (
        ("no_trade", F.lit(0.0)), ("hold", F.lit(1.0)), ("momentum", s), ("reversal", -s))]))
    x = pin(d.withColumn("_k", kinds).select("period", "y", "_k.strategy", "_k.side"))
    nets = x.filter("side <> 0").withColumn("net", F.col("side") * F.col("y") - 0.003)
    out = E.information_ratio(E.pool_periods(nets, x, ["strategy"], NP), ["strategy"], H).select("strategy", "ir")
    best = out.agg(F.max("ir")).first()[0]
    return out.select("strategy", rd("ir", 4).alias("ir"), rd(F.col("ir") - best, 4).alias("incremental_over_best"))


@query("symbol_net_quantiles", sql(
    "SELECT cell, seed, symbol, " + ", ".join(f"{rq(f'quantile_cont(net, {q})')} AS p{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
    + " FROM (SELECT cell, seed, symbol, side * y - 0.003 AS net FROM wide WHERE kappa = 1.0 AND side <> 0) GROUP BY 1, 2, 3", "wide"))
def symbol_net_quantiles(spark, sf_dir):
    w = E.with_kappas(predictions(decisions(labelled(spark, sf_dir))), [1.0]).filter("side <> 0")
    out = E.symbol_quantiles(pin(w.select(*UNIT, E.net_return(F.col("side"), F.col("y"), F.lit(0.003)).alias("net"))), keys=UNIT)
    return out.select(*UNIT, *[rd(c).alias(c) for c in out.columns if c not in UNIT])
