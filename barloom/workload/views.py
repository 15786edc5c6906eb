"""Market-bar views over the driver's tables, and the same definitions as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import FeatureConfig
from barloom.operators import bars as B
from barloom.session import ensure_conf

HOUR = 3_600_000
DAY = 86_400_000
WEEK = 7 * DAY

# hourly bars of the event stream: short windows, small chunks so that every carry and halo is exercised
HCFG = FeatureConfig(bar_ms=HOUR, half_life_fast=8, half_life_slow=16, n_warm=4, w_tau=6, pool_cap=4, mad_window=12,
                     mad_k=3.0, mad_min=4, stale_bars=3, structural=50.0, lam=0.94, vol_window=8, n_warm_vol=4,
                     z_window=12, chunk=96)
# weekly bars per brand: long contiguous series
WCFG = FeatureConfig(bar_ms=WEEK, half_life_fast=16, half_life_slow=32, n_warm=8, w_tau=12, pool_cap=8, mad_window=24,
                     mad_k=6.0, mad_min=8, stale_bars=3, structural=50.0, lam=0.94, vol_window=12, n_warm_vol=8,
                     z_window=24, chunk=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_conf(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str) -> Column:
    return F.unix_millis(F.col(col).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a trade of the symbol ``event_type``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), millis("ts").alias("ts_ms"), F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("quantity"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"), "user_id")


def klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.klines_from_trades(trades(spark, sf_dir), HOUR)


def stated(spark: SparkSession, sf_dir: str, ticks: DataFrame | None = None) -> DataFrame:
    """Klines of an exchange that in every seventh hour states a tenth more volume than its trades have."""
    hour = F.floor(F.col("bar_open_ms") / HOUR)
    k = klines(spark, sf_dir) if ticks is None else B.klines_from_trades(ticks, HOUR)
    return k.withColumn("v_kline", F.when(hour % 7 == 3, F.col("v_kline") * 1.1).otherwise(F.col("v_kline")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.attach_trades(stated(spark, sf_dir), B.reduce_trades(trades(spark, sf_dir), HOUR))


def line_key() -> Column:
    """Orders line items by day, then by their keys."""
    return B.sort_key("_day", ("l_orderkey", 11), ("l_linenumber", 1), ("l_partkey", 9), ("l_suppkey", 8), ("l_quantity", 3))


def wtrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades of their part's brand."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus",
        "l_shipdate")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = li.withColumn("_day", F.unix_date(F.col("l_shipdate").cast("date")))
    return li.join(part, "l_partkey").select(
        F.col("p_brand").alias("symbol"), millis("l_shipdate").alias("ts_ms"),
        line_key().alias("trade_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        (F.col("l_linestatus") == "F").alias("is_buyer_maker"))


def wklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.klines_from_trades(wtrades(spark, sf_dir), WEEK, F.col("trade_id"))


def wbars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars_from_trades(wtrades(spark, sf_dir), WEEK, F.col("trade_id"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an irregular funding mark of its symbol."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), millis("ts").alias("ts_ms"), (F.col("value") / 1e4).alias("value"))


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), millis("ts").alias("ts_ms"), (F.col("value") * 100).alias("value"))


# ---- SQL twins -----------------------------------------------------------------------------------------
_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTE[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _CTE[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order) + "\n" + body


def rd(expr: Column | str, digits: int = 6) -> Column:
    """Rounded, with NaN as NULL and no negative zero."""
    col = F.col(expr) if isinstance(expr, str) else expr
    return F.round(F.when(F.isnan(col), None).otherwise(col), digits) + F.lit(0.0)


def rq(expr: str, digits: int = 6) -> str:
    return f"(round(CASE WHEN isnan(({expr})::DOUBLE) THEN NULL ELSE ({expr})::DOUBLE END, {digits}) + 0.0)"


cte("trades", """SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS ts_ms, event_id AS trade_id, value AS price,
  CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS quantity, user_id % 2 = 0 AS is_buyer_maker, user_id
  FROM events""")


def _klines(src: str, step: int) -> str:
    return f"""SELECT symbol, ts_ms // {step} * {step} AS bar_open_ms, arg_min(price, (ts_ms, trade_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, (ts_ms, trade_id)) AS close, sum(quantity) AS v_kline,
  sum(price * quantity) AS quote_volume FROM {src} GROUP BY 1, 2"""


def _flow(src: str, step: int) -> str:
    return f"""SELECT symbol, ts_ms // {step} * {step} AS bar_open_ms,
  sum(CASE WHEN is_buyer_maker THEN 0.0::DOUBLE ELSE quantity END) AS v_buy,
  sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0.0::DOUBLE END) AS v_sell,
  count(*) FILTER (WHERE NOT is_buyer_maker) AS n_buy, count(*) FILTER (WHERE is_buyer_maker) AS n_sell,
  sum(quantity) AS v_agg, count(*) AS n_trades, avg(quantity) AS size_mean, stddev_pop(quantity) AS size_std
  FROM {src} GROUP BY 1, 2"""


def _bars(k: str, f: str) -> str:
    zero = ", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in B.FLOW_ZERO)
    return f"""SELECT k.*, {zero} FROM {k} k LEFT JOIN {f} f
  ON k.symbol = f.symbol AND k.bar_open_ms = f.bar_open_ms"""


cte("klines", _klines("trades", HOUR), "trades")
cte("flow", _flow("trades", HOUR), "trades")
cte("stated", f"SELECT * REPLACE (CASE WHEN bar_open_ms // {HOUR} % 7 = 3 THEN v_kline * 1.1::DOUBLE ELSE v_kline END AS v_kline) FROM klines", "klines")
cte("bars", _bars("stated", "flow"), "stated", "flow")
cte("wtrades", """SELECT p_brand AS symbol, epoch_ms(l_shipdate) AS ts_ms,
  (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS trade_id,
  l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_linestatus = 'F' AS is_buyer_maker
  FROM lineitem JOIN part ON l_partkey = p_partkey""")
cte("wklines", _klines("wtrades", WEEK), "wtrades")
cte("wflow", _flow("wtrades", WEEK), "wtrades")
cte("wbars", _bars("wklines", "wflow"), "wklines", "wflow")
cte("funding", """SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS ts_ms, value / 1e4 AS value FROM events""")
cte("oi", """SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS ts_ms, value * 100 AS value FROM events""")


def _segs(src: str, cfg: FeatureConfig) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) - 1 AS seg_pos FROM (
  SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY bar_open_ms ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS segment_id FROM (
    SELECT *, CASE WHEN pts IS NULL OR bar_open_ms - pts > {cfg.bar_ms} OR (pc <> 0 AND abs(close / pc - 1) >= {cfg.structural})
        THEN 1 ELSE 0 END AS brk,
      CASE WHEN pts IS NULL OR bar_open_ms - pts > {cfg.bar_ms} THEN 1 ELSE 0 END AS gap
    FROM (SELECT *, lag(bar_open_ms) OVER w AS pts, lag(close) OVER w AS pc,
            row_number() OVER w - 1 AS row_idx FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY bar_open_ms))))"""


cte("segs", _segs("bars", HCFG), "bars")
cte("wsegs", _segs("wbars", WCFG), "wbars")


# ---- panel: weekly bars per brand in the stored feature layout, with simple causal features ---------------------
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table like the lake: x_*, m_*, returns, volatility, flags, segments and row numbers."""
    from barloom.operators import features as X
    from barloom.operators import segments as S

    x = S.with_segments(wbars(spark, sf_dir), WCFG, WCFG.vol_window + 1)
    x = x.withColumn("raw_ret_close", X.log_return(WCFG))
    x = x.withColumn("sigma", X.rolling_vol("raw_ret_close", WCFG)).filter("_core")
    c = F.col
    span = c("high") - c("low") + 1e-8
    xs = {
        "x_0": F.greatest(F.least(c("raw_ret_close"), F.lit(5.0)), F.lit(-5.0)), "x_1": F.log(c("high") / c("low")),
        "x_2": (c("close") - c("open")) / span, "x_3": (c("high") - F.greatest("open", "close")) / span,
        "x_4": (F.least("open", "close") - c("low")) / span, "x_5": F.log(c("v_kline") + 1),
        "x_6": F.log(c("quote_volume") + 1), "x_7": (c("v_buy") - c("v_sell")) / (c("v_agg") + 1e-9),
        "x_8": (c("n_buy") - c("n_sell")) / (c("n_trades") + 1e-9), "x_9": F.log(c("n_trades") + 1.0),
        "x_10": F.log(c("v_agg") / (c("n_trades") + 1.0) + 1e-9),
        "x_11": F.when(c("n_trades") >= 2, c("size_std") / (c("size_mean") + 1e-9)).otherwise(0.0),
        "x_12": c("n_buy") / (c("v_agg") + 1e-9),
        **{f"x_{d}": F.lit(0.0) for d in (13, 14, 15)},
    }
    warm, sparse = c("seg_pos") < 8, c("n_trades") < 5
    ms = {f"m_{d}": (warm if d in (0, 1, 5, 6) else (warm | sparse) if d in (9, 10, 11) else sparse if d in (7, 8, 12)
                     else F.lit(d > 12)).cast("int") for d in range(16)}
    qa = {"is_stale": (c("n_trades") <= 3).cast("int"), "vol_warm": (c("seg_pos") < 8).cast("int"),
          "dq_flags": ((c("n_trades") <= 3).cast("int") * 2 + (c("n_trades") < 2).cast("int") * 16)}
    return x.select("symbol", "bar_open_ms", "segment_id", "seg_pos", "row_idx", "close", "v_kline", "n_trades",
                    "raw_ret_close", "sigma", *[v.alias(k) for k, v in {**xs, **ms, **qa}.items()])


def _panel_sql() -> str:
    ms = ", ".join(
        ("(seg_pos < 8)" if d in (0, 1, 5, 6) else "(seg_pos < 8 OR n_trades < 5)" if d in (9, 10, 11)
         else "(n_trades < 5)" if d in (7, 8, 12) else "(true)" if d > 12 else "(false)") + f"::INT AS m_{d}"
        for d in range(16))
    return f"""SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, segment_id, seg_pos, row_idx, close, v_kline, n_trades,
 ret AS raw_ret_close, sqrt(avg(ret * ret) OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms
   ROWS BETWEEN {WCFG.vol_window - 1} PRECEDING AND CURRENT ROW) + 1e-8) AS sigma,
 greatest(least(ret, 5.0), -5.0) AS x_0, ln(high / low) AS x_1, (close - open) / (high - low + 1e-8) AS x_2,
 (high - greatest(open, close)) / (high - low + 1e-8) AS x_3, (least(open, close) - low) / (high - low + 1e-8) AS x_4,
 ln(v_kline + 1) AS x_5, ln(quote_volume + 1) AS x_6, (v_buy - v_sell) / (v_agg + 1e-9) AS x_7,
 (n_buy - n_sell) / (n_trades + 1e-9) AS x_8, ln(n_trades + 1) AS x_9, ln(v_agg / (n_trades + 1) + 1e-9) AS x_10,
 CASE WHEN n_trades >= 2 THEN size_std / (size_mean + 1e-9) ELSE 0 END AS x_11, n_buy / (v_agg + 1e-9) AS x_12,
 0.0::DOUBLE AS x_13, 0.0::DOUBLE AS x_14, 0.0::DOUBLE AS x_15, {ms}, (n_trades <= 3)::INT AS is_stale, (seg_pos < 8)::INT AS vol_warm,
 (n_trades <= 3)::INT * 2 + (n_trades < 2)::INT * 16 AS dq_flags FROM wrets"""


cte("wrets", "SELECT *, CASE WHEN seg_pos = 0 THEN 0.0 ELSE ln(close / pc) END AS ret FROM wsegs", "wsegs")
cte("panel", _panel_sql(), "wrets")
