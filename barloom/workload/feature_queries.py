"""Feature pipeline: W-1..W-4, W-7..W-11, F0-F16, P14, P19, P20, C2."""

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.config import N_FEATURES
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import segments as S
from barloom.session import pin
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.views import HCFG, HOUR, WCFG, cte, rd, rq, sql

SEGW = "PARTITION BY symbol, segment_id ORDER BY bar_open_ms"


def full_bars(spark, sf_dir):
    """Hourly bars with flow, funding and open interest."""
    tl = S.timeline(HCFG)
    return B.asof_marks(V.bars(spark, sf_dir), {"funding": V.funding(spark, sf_dir), "oi": V.open_interest(spark, sf_dir)}, tl)


cte("fbars", f"""SELECT b.*, coalesce(f.value, 0) AS funding, CASE WHEN f.value IS NULL THEN 1 ELSE 0 END AS funding_missing,
 coalesce(o.value, 0) AS oi, CASE WHEN o.value IS NULL THEN 1 ELSE 0 END AS oi_missing FROM bars b
 ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.bar_open_ms + {HOUR} >= f.ts_ms
 ASOF LEFT JOIN oi o ON b.symbol = o.symbol AND b.bar_open_ms + {HOUR} >= o.ts_ms""", "bars", "funding", "oi")
cte("fsegs", V._segs("fbars", HCFG), "fbars")


def _rets(src):
    return f"SELECT *, CASE WHEN seg_pos = 0 THEN 0.0 ELSE ln(close / pc) END AS ret FROM {src}"


def _mads(src, cfg):
    return f"""SELECT *, CASE WHEN len(past) >= {cfg.mad_min} THEN list_aggregate([abs(v - list_aggregate(past, 'median'))
   FOR v IN past], 'median') END AS mad FROM (SELECT *, list(ret) OVER ({SEGW} ROWS BETWEEN {cfg.mad_window} PRECEDING AND
   1 PRECEDING) AS past FROM {src})"""


def _clips(src, cfg):
    return f"""SELECT *, CASE WHEN up THEN top * (1 + thr) ELSE high END AS high_c, CASE WHEN down THEN bot * (1 - thr) ELSE low
   END AS low_c, (up OR down)::INT AS clipped FROM (SELECT *, coalesce(top > 0 AND (high - top) / top > thr, false) AS up,
   coalesce(bot > 0 AND (bot - low) / bot > thr, false) AS down FROM (SELECT *, greatest(open, close) AS top,
   least(open, close) AS bot, CASE WHEN mad > 0 THEN mad * {cfg.mad_k} END AS thr FROM {src}))"""


for _p, _cfg, _src in (("", HCFG, "segs"), ("w", WCFG, "wsegs"), ("f", HCFG, "fsegs")):
    cte(f"{_p}rets", _rets(_src), _src)
    cte(f"{_p}mads", _mads(f"{_p}rets", _cfg), f"{_p}rets")
    cte(f"{_p}clips", _clips(f"{_p}mads", _cfg), f"{_p}mads")


def _decayed(src, name, expr, decay, lagged):
    frame = "UNBOUNDED PRECEDING AND 1 PRECEDING" if lagged else "UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT * EXCLUDE (l), coalesce(list_sum(list_transform(l, lambda v, i: v * pow({decay!r}, len(l) - i))), 0)
   AS {name} FROM (SELECT *, list({expr}) OVER ({SEGW} ROWS BETWEEN {frame}) AS l FROM {src})"""


def _zscore(src, col, out, cfg, half):
    """Emit-before-update z-score with the running mean and variance folded through ordered lists."""
    a = cfg.alpha(half)
    first = f"(SELECT *, {col} - first({col}) OVER ({SEGW}) AS g FROM {src})"
    m = _decayed(first, "m1", f"{a!r} * g", 1 - a, True)
    m = _decayed(f"({m})", "m2", f"{a!r} * g * g", 1 - a, True)
    warm = max(cfg.warm(half), 1)
    return f"""SELECT * EXCLUDE (g, m1, m2), CASE WHEN seg_pos < {warm} THEN 0.0 ELSE
   greatest(least((g - m1) / sqrt(greatest(m2 - m1 * m1, 0) + 1e-8), 5.0), -5.0) END AS {out},
   (seg_pos < {warm})::INT AS {out}_warm FROM ({m})"""


cte("wrolls", f"""SELECT *, CASE WHEN seg_pos < {WCFG.n_warm} THEN 0.0 ELSE greatest(least((ret - avg(ret) OVER p) /
 sqrt(var_pop(ret) OVER p + 1e-8), 5.0), -5.0) END AS z, sqrt(avg(ret * ret) OVER v + 1e-8) AS vol FROM wrets
 WINDOW p AS ({SEGW} ROWS BETWEEN {WCFG.z_window} PRECEDING AND 1 PRECEDING),
 v AS ({SEGW} ROWS BETWEEN {WCFG.vol_window - 1} PRECEDING AND CURRENT ROW)""", "wrets")


def _framed_returns(spark, sf_dir, back):
    return S.with_segments(V.wbars(spark, sf_dir), WCFG, back).withColumn("ret", X.log_return(WCFG))


@query("rolling_zscore", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('z', 5)} AS z FROM wrolls", "wrolls"))
def rolling_zscore(spark, sf_dir):
    # one row more than the window: the oldest return of the window needs its own predecessor
    df = _framed_returns(spark, sf_dir, WCFG.z_window + 1).withColumn("z", X.rolling_zscore("ret", WCFG))
    return df.filter("_core").select("symbol", "bar_open_ms", rd("z", 5).alias("z"))


@query("rolling_vol", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('vol')} AS vol FROM wrolls", "wrolls"))
def rolling_vol(spark, sf_dir):
    df = _framed_returns(spark, sf_dir, WCFG.vol_window + 1).withColumn("vol", X.rolling_vol("ret", WCFG))
    return df.filter("_core").select("symbol", "bar_open_ms", rd("vol").alias("vol"))


@query("ewma_vol", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('sqrt(s + 1e-8)')} AS sigma, "
    f"(seg_pos < {WCFG.warm_vol})::INT AS vol_warm FROM (" + _decayed(
        "wrets", "s", f"{1 - WCFG.lam!r} * ret * ret", WCFG.lam, False) + ")", "wrets"))
def ewma_vol(spark, sf_dir):
    df = X.ewma_vol(S.local_segments(V.wbars(spark, sf_dir), WCFG).withColumn("ret", X.log_return(WCFG)), WCFG)
    return df.select("symbol", "bar_open_ms", rd("sigma").alias("sigma"), "vol_warm")


@query("ewma_zscore", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('z', 5)} AS z, z_warm FROM ("
    + _zscore("wrets", "ret", "z", WCFG, WCFG.half_life_fast) + ")", "wrets"))
def ewma_zscore(spark, sf_dir):
    df = X.ewma_zscores(S.local_segments(V.wbars(spark, sf_dir), WCFG).withColumn("ret", X.log_return(WCFG)), WCFG, {"z": ("ret", WCFG.half_life_fast)})
    return df.select("symbol", "bar_open_ms", rd("z", 5).alias("z"), "z_warm")


@query("badtick_clip", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('high_c', 4)} AS high_c, {rq('low_c', 4)} AS low_c, clipped "
    "FROM clips", "clips"))
def badtick_clip(spark, sf_dir):
    bars = pin(V.klines(spark, sf_dir))
    df = X.clip_wicks(bars.join(X.trailing_mad(bars, HCFG), X.KEY, "left"), HCFG)
    return df.select("symbol", "bar_open_ms", rd("high_c", 4).alias("high_c"), rd("low_c", 4).alias("low_c"), "clipped")


_STALE = replace(HCFG, stale_bars=2)
# every third price level is coarse and its volume ignored, which makes flat idle runs
cte("qbars", """SELECT symbol, bar_open_ms, floor(open / 200) AS open, floor(high / 200) AS high, floor(low / 200) AS low,
 floor(close / 200) AS close, CASE WHEN v_kline < 200 THEN 0 ELSE v_kline END AS v_kline FROM klines""", "klines")


@query("stale_flag", sql(
    f"""SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, (count(*) OVER w = 2 AND min((open = high AND high = low AND
 low = close AND v_kline = 0)::INT) OVER w = 1 AND min(close) OVER w = max(close) OVER w)::INT AS is_stale FROM qbars
 WINDOW w AS (PARTITION BY symbol ORDER BY bar_open_ms ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""", "qbars"))
def stale_flag(spark, sf_dir):
    k = V.klines(spark, sf_dir)
    q = k.select("symbol", "bar_open_ms", *[F.floor(F.col(c) / 200).cast("double").alias(c) for c in ("open", "high", "low", "close")],
                 F.when(F.col("v_kline") < 200, 0.0).otherwise(F.col("v_kline")).alias("v_kline"))
    return X.stale_flags(q, _STALE)


cte("taus", f"""SELECT *, CASE WHEN seg_pos >= {HCFG.w_tau} AND len(pool) > 0 THEN CASE WHEN t >= 0.5
   THEN hi - (hi - lo) * (1 - t) ELSE lo + (hi - lo) * t END END AS tau FROM
 (SELECT *, pool[floor(vi)::BIGINT + 1] AS lo, pool[least(floor(vi)::BIGINT + 2, len(pool))] AS hi, vi - floor(vi) AS t FROM
 (SELECT *, {HCFG.q_tau}::DOUBLE * (len(pool) - 1) AS vi FROM
 (SELECT s.symbol, s.segment_id, s.bar_open_ms, s.seg_pos, list_sort(flatten(list(coalesce(k.kept, [])) OVER
   (PARTITION BY s.symbol, s.segment_id ORDER BY s.bar_open_ms ROWS BETWEEN {HCFG.w_tau} PRECEDING AND 1 PRECEDING))) AS pool
  FROM fsegs s LEFT JOIN kept k ON s.symbol = k.symbol AND s.bar_open_ms = k.bar_open_ms)))""", "fsegs", "kept")
cte("kept", f"""SELECT symbol, bar_open_ms, CASE WHEN len(a) <= {HCFG.pool_cap} THEN a ELSE
 [a[(round_even(i * (len(a) - 1) / {HCFG.pool_cap - 1}.0, 0))::BIGINT + 1] FOR i IN range({HCFG.pool_cap})] END AS kept FROM
 (SELECT symbol, ts_ms // {HOUR} * {HOUR} AS bar_open_ms, list_sort(list(quantity)) AS a FROM trades GROUP BY 1, 2)""", "trades")
cte("larges", f"""SELECT t.symbol, t.bar_open_ms, count(*) FILTER (WHERE q.quantity >= t.tau) AS n_large FROM taus t JOIN
 (SELECT symbol, ts_ms // {HOUR} * {HOUR} AS bar_open_ms, quantity FROM trades) q
 ON q.symbol = t.symbol AND q.bar_open_ms = t.bar_open_ms WHERE t.tau IS NOT NULL GROUP BY 1, 2""", "taus", "trades")


@query("large_trade_share", sql(
    f"""SELECT b.symbol, b.bar_open_ms::BIGINT AS bar_open_ms, {rq('coalesce(l.n_large, 0) / (b.v_agg + 1e-9)')} AS share
 FROM fbars b LEFT JOIN larges l ON b.symbol = l.symbol AND b.bar_open_ms = l.bar_open_ms WHERE b.v_agg > 0""", "fbars", "larges"))
def large_trade_share(spark, sf_dir):
    bars = pin(V.bars(spark, sf_dir))
    out = bars.join(X.large_trades(bars, V.trades(spark, sf_dir), HCFG), X.KEY, "left").filter("v_agg > 0")
    return out.select("symbol", "bar_open_ms", rd(F.coalesce("n_large", F.lit(0)) / (F.col("v_agg") + 1e-9)).alias("share"))


def _raw_sql(src):
    return f"""SELECT c.*, ln(high_c / low_c) AS f_1, (close - open) / (high_c - low_c + 1e-8) AS f_2,
 (high_c - greatest(open, close)) / (high_c - low_c + 1e-8) AS f_3, (least(open, close) - low_c) / (high_c - low_c + 1e-8) AS f_4,
 ln(v_kline + 1) AS f_5, ln(quote_volume + 1) AS f_6, (v_buy - v_sell) / (v_agg + 1e-9) AS f_7,
 (n_buy - n_sell) / (n_buy + n_sell + 1e-9) AS f_8, ln(n_trades + 1) AS f_9, ln(v_agg / (n_trades + 1) + 1e-9) AS f_10,
 CASE WHEN n_trades >= 2 THEN size_std / (size_mean + 1e-9) ELSE 0 END AS f_11,
 coalesce(l.n_large, 0) / (v_agg + 1e-9) AS f_12, funding AS f_13, ln(oi + 1) AS f_14, ret AS f_0,
 coalesce(ln((oi + 1) / (lag(oi) OVER (PARTITION BY c.symbol, c.segment_id ORDER BY c.bar_open_ms) + 1)), 0) AS f_15,
 lead(ret) OVER (PARTITION BY c.symbol, c.segment_id ORDER BY c.bar_open_ms) AS next_ret
 FROM {src} c LEFT JOIN larges l ON c.symbol = l.symbol AND c.bar_open_ms = l.bar_open_ms"""


cte("raws", _raw_sql("fclips"), "fclips", "larges")


def _features_sql():
    """x, m, sigma, target and flags on top of the raw features."""
    inner = _decayed("raws", "s", f"{1 - HCFG.lam!r} * ret * ret", HCFG.lam, False)
    for d in X.Z_DIMS:
        half = HCFG.half_life_fast if d in X.FAST_DIMS else HCFG.half_life_slow
        inner = _zscore(f"({inner})", f"f_{d}", f"x_{d}", HCFG, half)
    xs = ", ".join(f"greatest(least(f_{d}, 5.0), -5.0) AS x_{d}" for d in X.BOUNDED_DIMS)
    return f"SELECT *, {xs}, sqrt(s + 1e-8) AS sigma, (seg_pos < {HCFG.warm_vol}) AS vol_warm FROM ({inner})"


cte("feats", _features_sql(), "raws")


def _mask_sql():
    z = {d: f"x_{d}_warm = 1" for d in X.Z_DIMS}
    parts = []
    for d in range(N_FEATURES):
        conds = [z[d]] if d in z else []
        if d in (0, 15):
            conds.append("seg_pos = 0")
        if d == 12:
            conds.append(f"seg_pos < {HCFG.w_tau}")
        if 5 <= d <= 12:
            conds.append("v_kline = 0")
        if 7 <= d <= 12:
            conds.append("abs(v_agg - v_kline) / (v_kline + 1e-9) > 0.01")
        if d == 13:
            conds.append("funding_missing = 1")
        if d in (14, 15):
            conds.append("oi_missing = 1")
        parts.append(f"({' OR '.join(conds) or 'false'})::INT AS m_{d}")
    return ", ".join(parts)


cte("masked", f"""SELECT *, {_mask_sql()}, next_ret IS NOT NULL AND NOT vol_warm AS target_valid,
 CASE WHEN next_ret IS NOT NULL AND NOT vol_warm THEN next_ret / (sigma + 1e-8) END AS target,
 (count(*) OVER st = {HCFG.stale_bars} AND min((open = high AND high = low AND low = close AND v_kline = 0)::INT) OVER st = 1
  AND min(close) OVER st = max(close) OVER st)::INT AS is_stale FROM feats
 WINDOW st AS (PARTITION BY symbol ORDER BY bar_open_ms ROWS BETWEEN {HCFG.stale_bars - 1} PRECEDING AND CURRENT ROW)""", "feats")

_X = range(N_FEATURES)
_D = {d: 4 if d in X.Z_DIMS else 6 for d in _X}  # digits compared


@query("raw_features", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, " + ", ".join(f"{rq(f'f_{d}')} AS f_{d}" for d in _X) + " FROM raws",
    "raws"))
def raw_features(spark, sf_dir):
    bars = pin(full_bars(spark, sf_dir))
    side = bars.join(X.trailing_mad(bars, HCFG), X.KEY, "left").join(
        X.large_trades(bars, V.trades(spark, sf_dir), HCFG), X.KEY, "left")
    df = X.raw_features(X.clip_wicks(S.with_segments(side, HCFG, 1), HCFG), HCFG).filter("_core")
    return df.select("symbol", "bar_open_ms", *[rd(f"f_{d}").alias(f"f_{d}") for d in _X])


def features(spark, sf_dir):
    return X.compute_features(full_bars(spark, sf_dir), HCFG, V.trades(spark, sf_dir))


@query("compute_features", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, segment_id, " + ", ".join(f"{rq(f'x_{d}', _D[d])} AS x_{d}" for d in _X)
    + f", {rq('sigma')} AS sigma, {rq('target', 4)} AS target, target_valid FROM masked", "masked"))
def compute_features(spark, sf_dir):
    df = features(spark, sf_dir)
    return df.select("symbol", "bar_open_ms", "segment_id", *[rd(f"x_{d}", _D[d]).alias(f"x_{d}") for d in _X],
                     rd("sigma").alias("sigma"), rd("target", 4).alias("target"), "target_valid")


@query("mask_assemble", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, " + ", ".join(f"m_{d}" for d in _X) + " FROM masked", "masked"))
def mask_assemble(spark, sf_dir):
    return features(spark, sf_dir).select("symbol", "bar_open_ms", *[f"m_{d}" for d in _X])


@query("dq_flags", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, clipped + 2 * is_stale + 4 * (brk - gap) + 16 * (v_kline = 0)::INT "
    "AS dq_flags FROM masked", "masked"))
def dq_flags(spark, sf_dir):
    return features(spark, sf_dir).select("symbol", "bar_open_ms", "dq_flags")


@query("vol_scaled_target", sql(
    f"""SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('CASE WHEN ok THEN nr / (sqrt(s + 1e-8) + 1e-8) END', 5)} AS target,
 ok AS target_valid FROM (SELECT *, lead(ret) OVER ({SEGW}) AS nr, seg_pos >= {WCFG.warm_vol} AND lead(ret) OVER ({SEGW})
 IS NOT NULL AS ok FROM (""" + _decayed("wrets", "s", f"{1 - WCFG.lam!r} * ret * ret", WCFG.lam, False) + "))", "wrets"))
def vol_scaled_target(spark, sf_dir):
    tl = S.timeline(WCFG)
    df = S.local_segments(V.wbars(spark, sf_dir), WCFG, 1, 1).withColumn("ret", X.log_return(WCFG))
    df = df.withColumn("next_ret", F.lead("ret").over(tl.by_segment())).filter("_core")
    df = X.ewma_vol(df, WCFG)
    ok = F.col("next_ret").isNotNull() & (F.col("vol_warm") == 0)
    return df.select("symbol", "bar_open_ms", rd(F.when(ok, F.col("next_ret") / (F.col("sigma") + 1e-8)), 5).alias("target"),
                     ok.alias("target_valid"))


@query("tau_warm", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, (seg_pos < {HCFG.w_tau})::INT AS tau_warm FROM segs", "segs"))
def tau_warm(spark, sf_dir):
    return S.assign_segments(V.bars(spark, sf_dir), HCFG).select(
        "symbol", "bar_open_ms", (F.col("seg_pos") < HCFG.w_tau).cast("int").alias("tau_warm"))


_RCFG = replace(HCFG, estimator="rolling")
_PAST = f"({SEGW} ROWS BETWEEN {HCFG.z_window} PRECEDING AND 1 PRECEDING)"


def _rolling_sql():
    half = {d: HCFG.half_life_fast if d in X.FAST_DIMS else HCFG.half_life_slow for d in X.Z_DIMS}
    zs = ", ".join(f"""CASE WHEN seg_pos < {max(HCFG.warm(h), 1)} THEN 0.0 ELSE greatest(least((f_{d} - avg(f_{d}) OVER {_PAST}) / sqrt(var_pop(f_{d}) OVER {_PAST} + 1e-8), 5.0), -5.0) END AS x_{d}"""
                   for d, h in half.items())
    return f"""SELECT *, {zs}, sqrt(avg(ret * ret) OVER ({SEGW} ROWS BETWEEN {HCFG.vol_window - 1} PRECEDING AND CURRENT ROW) + 1e-8) AS sigma,
 next_ret IS NOT NULL AND seg_pos >= {HCFG.warm_vol} AS target_valid FROM raws"""


@query("compute_features_rolling", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, " + ", ".join(f"{rq(f'x_{d}', 4)} AS x_{d}" for d in X.Z_DIMS)
    + f", {rq('sigma')} AS sigma, {rq('CASE WHEN target_valid THEN next_ret / (sigma + 1e-8) END', 4)} AS target, target_valid FROM ({_rolling_sql()})", "raws"))
def compute_features_rolling(spark, sf_dir):
    df = X.compute_features(full_bars(spark, sf_dir), _RCFG, V.trades(spark, sf_dir))
    return df.select("symbol", "bar_open_ms", *[rd(f"x_{d}", 4).alias(f"x_{d}") for d in X.Z_DIMS], rd("sigma").alias("sigma"), rd("target", 4).alias("target"), "target_valid")


_VCFG = replace(HCFG, vol_scaled_inputs=True)


def _scaled_sql():
    inner = _decayed("raws", "s", f"{1 - HCFG.lam!r} * ret * ret", HCFG.lam, False)
    inner = f"(SELECT * REPLACE (f_0 / (sqrt(s + 1e-8) + 1e-8) AS f_0, f_1 / (sqrt(s + 1e-8) + 1e-8) AS f_1) FROM ({inner}))"
    for d in (0, 1):
        inner = "(" + _zscore(inner, f"f_{d}", f"x_{d}", HCFG, HCFG.half_life_fast) + ")"
    return inner


@query("vol_scaled_inputs", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('x_0', 4)} AS x_0, {rq('x_1', 4)} AS x_1, (x_0_warm = 1 OR seg_pos = 0 OR seg_pos < {HCFG.warm_vol})::INT AS m_0 FROM {_scaled_sql()}", "raws"))
def vol_scaled_inputs(spark, sf_dir):
    df = X.compute_features(full_bars(spark, sf_dir), _VCFG, V.trades(spark, sf_dir))
    return df.select("symbol", "bar_open_ms", rd("x_0", 4).alias("x_0"), rd("x_1", 4).alias("x_1"), "m_0")


DCFG = replace(WCFG, bar_ms=V.DAY, chunk=512)
cte("dtrades", """SELECT 'S' || l_suppkey AS symbol, epoch_ms(l_shipdate) AS ts_ms, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS trade_id,
  l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_linestatus = 'F' AS is_buyer_maker FROM lineitem""")
cte("dklines", V._klines("dtrades", V.DAY), "dtrades")
cte("dflow", V._flow("dtrades", V.DAY), "dtrades")
cte("dbars", V._bars("dklines", "dflow"), "dklines", "dflow")
cte("dsegs", V._segs("dbars", DCFG), "dbars")
cte("drets", _rets("dsegs"), "dsegs")


def dbars(spark, sf_dir):
    """Daily bars of every supplier: many symbols with many gaps."""
    li = V.table(spark, sf_dir, "lineitem").withColumn("_day", F.unix_date(F.col("l_shipdate").cast("date")))
    t = li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), V.millis("l_shipdate").alias("ts_ms"),
                  V.line_key().alias("trade_id"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), (F.col("l_linestatus") == "F").alias("is_buyer_maker"))
    return B.bars_from_trades(t, V.DAY, F.col("trade_id"))


@query("daily_bar_zscores", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, segment_id, {rq('(v_buy - v_sell) / (v_agg + 1e-9)')} AS tfi, {rq('z', 4)} AS z, {rq('sqrt(s + 1e-8)')} AS sigma FROM ("
    + _decayed("(" + _zscore("drets", "ret", "z", DCFG, DCFG.half_life_fast) + ")", "s", f"{1 - DCFG.lam!r} * ret * ret", DCFG.lam, False) + ")", "drets"))
def daily_bar_zscores(spark, sf_dir):
    x = S.local_segments(dbars(spark, sf_dir), DCFG).withColumn("ret", X.log_return(DCFG))
    x = X.ewma_zscores(x, DCFG, {"z": ("ret", DCFG.half_life_fast)}, vol="ret")
    return x.select("symbol", "bar_open_ms", "segment_id", rd((F.col("v_buy") - F.col("v_sell")) / (F.col("v_agg") + 1e-9)).alias("tfi"),
                    rd("z", 4).alias("z"), rd("sigma").alias("sigma"))


@query("flow_summary", sql(
    f"""SELECT symbol, count(*) AS n_bars, count(DISTINCT segment_id) AS n_segments, {rq('avg(tfi)')} AS mean_tfi, {rq('avg((abs(z) > 2)::INT)')} AS share_extreme FROM (SELECT *, CASE WHEN seg_pos < {HCFG.n_warm} THEN 0.0 ELSE
 (tfi - avg(tfi) OVER p) / sqrt(var_pop(tfi) OVER p + 1e-8) END AS z FROM (SELECT *, (v_buy - v_sell) / (v_agg + 1e-9) AS tfi FROM segs) WINDOW p AS ({SEGW} ROWS BETWEEN {HCFG.z_window} PRECEDING AND 1 PRECEDING)) GROUP BY 1""", "segs"))
def flow_summary(spark, sf_dir):
    """Per symbol: bars, segments, mean order-flow imbalance and the share of extreme z-scores."""
    x = S.with_segments(V.bars(spark, sf_dir), HCFG, HCFG.z_window + 1)
    x = x.withColumn("tfi", (F.col("v_buy") - F.col("v_sell")) / (F.col("v_agg") + 1e-9)).withColumn("z", X.rolling_zscore("tfi", HCFG)).filter("_core")
    return x.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.countDistinct("segment_id").alias("n_segments"), rd(F.avg("tfi")).alias("mean_tfi"),
                                   rd(F.avg((F.abs("z") > 2).cast("double"))).alias("share_extreme"))
