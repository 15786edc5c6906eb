"""Reduction, joins and segments (operators A1, J1, J2, P1, P18, W-5, W-6, A2, D1, D7, U1, P28)."""

from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import segments as S
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.views import HCFG, HOUR, WCFG, rd, rq, sql

_FLOW = f"""SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('v_buy')} AS v_buy, {rq('v_sell')} AS v_sell,
 n_buy, n_sell, {rq('v_agg')} AS v_agg, n_trades, {rq('size_mean')} AS size_mean, {rq('size_std')} AS size_std FROM """


def _flow_out(df):
    return df.select("symbol", "bar_open_ms", rd("v_buy").alias("v_buy"), rd("v_sell").alias("v_sell"), "n_buy", "n_sell",
                     rd("v_agg").alias("v_agg"), "n_trades", rd("size_mean").alias("size_mean"),
                     rd("size_std").alias("size_std"))


@query("reduce_trades", sql(_FLOW + "flow", "flow"))
def reduce_trades(spark, sf_dir):
    return _flow_out(B.reduce_trades(V.trades(spark, sf_dir), HOUR))


@query("attach_trades", sql(_FLOW + "bars", "bars"))
def attach_trades(spark, sf_dir):
    return _flow_out(V.bars(spark, sf_dir))


@query("klines_from_trades", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, open, high, low, close, v_kline, "
    f"{rq('quote_volume', 4)} AS quote_volume FROM klines", "klines"))
def klines_from_trades(spark, sf_dir):
    return V.klines(spark, sf_dir).withColumn("quote_volume", rd("quote_volume", 4))


@query("bar_id", "SELECT event_id, (epoch_us(ts) // 1000) // 60000 AS bar_id FROM events")
def bar_id(spark, sf_dir):
    return V.trades(spark, sf_dir).select(F.col("trade_id").alias("event_id"), B.bar_id("ts_ms").alias("bar_id"))


@query("vol_recon_err", sql(
    f"SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, {rq('abs(v_agg - v_kline) / (v_kline + 1e-9)')} AS err "
    "FROM bars WHERE v_kline > 0", "bars"))
def vol_recon_err(spark, sf_dir):
    return V.bars(spark, sf_dir).filter("v_kline > 0").select("symbol", "bar_open_ms", rd(B.vol_recon_err()).alias("err"))


@query("assign_segments", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, segment_id, seg_pos, row_idx, brk - gap AS structural FROM segs",
    "segs"))
def assign_segments(spark, sf_dir):
    out = S.with_segments(V.bars(spark, sf_dir), HCFG).filter("_core")
    return out.select("symbol", "bar_open_ms", "segment_id", "seg_pos", "row_idx",
                      (F.col("_brk") - F.col("_gap")).alias("structural"))


@query("segment_bounds", sql(
    "SELECT symbol, segment_id, min(row_idx) AS start_idx, max(row_idx) + 1 AS end_idx FROM segs GROUP BY 1, 2", "segs"))
def segment_bounds(spark, sf_dir):
    return S.segment_bounds(S.assign_segments(V.bars(spark, sf_dir), HCFG))


@query("segment_catalog", sql(
    "SELECT symbol, segment_id, min(bar_open_ms)::BIGINT AS lo_ms, max(bar_open_ms)::BIGINT AS hi_ms, count(*) AS n_bars "
    "FROM wsegs GROUP BY 1, 2 HAVING count(*) >= 32", "wsegs"))
def segment_catalog(spark, sf_dir):
    return S.segment_catalog(S.assign_segments(V.wbars(spark, sf_dir), WCFG), 32)


@query("coverage", sql(
    "SELECT symbol, count(*) AS n_bars, strftime(epoch_ms(min(bar_open_ms)::BIGINT), '%Y-%m-%d') AS first_date, "
    "strftime(epoch_ms(max(bar_open_ms)::BIGINT), '%Y-%m-%d') AS last_date, count(DISTINCT segment_id) AS n_segments "
    "FROM segs GROUP BY 1", "segs"))
def coverage(spark, sf_dir):
    from barloom.operators.quality import coverage as cov
    return cov(S.assign_segments(V.bars(spark, sf_dir), HCFG))


_ASOF = f"""SELECT b.symbol, b.bar_open_ms::BIGINT AS bar_open_ms, {rq('coalesce(e.value, 0)', 8)} AS funding,
 (CASE WHEN e.value IS NULL THEN 1 ELSE 0 END) AS funding_missing
 FROM bars b ASOF LEFT JOIN funding e ON b.symbol = e.symbol AND b.bar_open_ms + {HOUR} >= e.ts_ms"""


@query("asof_ffill", sql(_ASOF, "bars", "funding"))
def asof_ffill(spark, sf_dir):
    out = B.asof_ffill(V.bars(spark, sf_dir), V.funding(spark, sf_dir), "funding", S.timeline(HCFG))
    return out.select("symbol", "bar_open_ms", rd("funding", 8).alias("funding"), "funding_missing")


@query("bars_with_flow_funding_oi", sql(
    f"""SELECT b.symbol, b.bar_open_ms::BIGINT AS bar_open_ms, b.close, b.n_trades, {rq('coalesce(f.value, 0)', 8)} AS funding,
 {rq('coalesce(o.value, 0)')} AS oi FROM bars b
 ASOF LEFT JOIN funding f ON b.symbol = f.symbol AND b.bar_open_ms + {HOUR} >= f.ts_ms
 ASOF LEFT JOIN oi o ON b.symbol = o.symbol AND b.bar_open_ms + {HOUR} >= o.ts_ms""", "bars", "funding", "oi"))
def bars_with_flow_funding_oi(spark, sf_dir):
    tl = S.timeline(HCFG)
    out = B.asof_marks(V.bars(spark, sf_dir), {"funding": V.funding(spark, sf_dir), "oi": V.open_interest(spark, sf_dir)}, tl)
    return out.select("symbol", "bar_open_ms", "close", "n_trades", rd("funding", 8).alias("funding"), rd("oi").alias("oi"))


@query("concat_streams", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, close FROM klines", "klines"))
def concat_streams(spark, sf_dir):
    k = V.klines(spark, sf_dir).select("symbol", "bar_open_ms", "close")
    split = 1_705_276_800_000  # 2024-01-15, the seam between two parts
    return B.concat_streams([k.filter(F.col("bar_open_ms") < split), k.filter(F.col("bar_open_ms") >= split)])


@query("order_violations", sql(
    "SELECT symbol, sum(n - 1)::BIGINT AS n_repeated, min(bar_open_ms)::BIGINT AS first_repeated FROM "
    f"(SELECT symbol, ts_ms // {HOUR} * {HOUR} AS bar_open_ms, count(*) AS n FROM trades GROUP BY 1, 2) "
    "WHERE n > 1 GROUP BY 1", "trades"))
def order_violations(spark, sf_dir):
    t = V.trades(spark, sf_dir).withColumn("bar_open_ms", B.bar_open("ts_ms", HOUR))
    return B.order_violations(t)


@query("size_samples", sql(
    f"""SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, len(s) AS n_kept, {rq('list_sum(s)')} AS kept_sum,
 {rq('s[1]')} AS smallest, {rq('s[-1]')} AS largest FROM (SELECT symbol, bar_open_ms,
 CASE WHEN len(a) <= 4 THEN a ELSE [a[(round_even(i * (len(a) - 1) / 3.0, 0))::BIGINT + 1] FOR i IN range(4)] END AS s FROM
 (SELECT symbol, ts_ms // {HOUR} * {HOUR} AS bar_open_ms, list_sort(list(quantity)) AS a FROM trades GROUP BY 1, 2))""", "trades"))
def size_samples(spark, sf_dir):
    out = B.size_samples(V.trades(spark, sf_dir), HOUR, 4)
    return out.select("symbol", "bar_open_ms", F.size("sample").cast("bigint").alias("n_kept"),
                      rd(F.aggregate("sample", F.lit(0.0), lambda a, x: a + x)).alias("kept_sum"),
                      rd(F.array_min("sample")).alias("smallest"), rd(F.array_max("sample")).alias("largest"))


@query("pick_evenly", sql(
    f"""SELECT symbol, {rq('list_sum(s)')} AS picked_sum, len(s) AS n_picked FROM (SELECT symbol,
 [a[(round_even(i * (len(a) - 1) / 15.0, 0))::BIGINT + 1] FOR i IN range(16)] AS s FROM
 (SELECT symbol, list_sort(list(price)) AS a FROM trades GROUP BY 1))""", "trades"))
def pick_evenly(spark, sf_dir):
    from barloom.operators.samples import pick_evenly_rows
    out = pick_evenly_rows(V.trades(spark, sf_dir), ["symbol"], "price", 16)
    return out.groupBy("symbol").agg(rd(F.sum("price")).alias("picked_sum"), F.count("*").alias("n_picked"))


@query("ohlcv_only_stream", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, coalesce(v_kline, 0) AS v_kline, 0.0::DOUBLE AS v_buy, "
    "0::BIGINT AS n_trades, false AS is_perp FROM klines", "klines"))
def ohlcv_only_stream(spark, sf_dir):
    return B.ohlcv_only(V.klines(spark, sf_dir)).select("symbol", "bar_open_ms", "v_kline", "v_buy", "n_trades", "is_perp")
