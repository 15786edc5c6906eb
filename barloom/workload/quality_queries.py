"""A3-A5, A14, A22, A23, P10-P16, P23-P26, P2, P3, P17, P22, D2 and the fold operators."""

from pyspark.sql import functions as F

from barloom.frames import Timeline
from barloom.functions import scalars as C
from barloom.operators import quality as Q
from barloom.operators import universe as U
from barloom.session import pin
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.views import HOUR, WEEK, cte, rd, rq, sql

OHLCV_OK = " AND ".join(f"m_{d} = 0" for d in range(7))
MICRO_OK = " AND ".join(f"m_{d} = 0" for d in range(13))
LO, HI = 788_918_400_000, 1_009_843_200_000  # 1995-01-01, 2002-01-01
BOUNDARY = U.calendar_boundary(LO, HI)

cte("dq", f"""SELECT symbol, count(*) AS n_bars, count(DISTINCT segment_id) AS n_segments, count(*) FILTER (WHERE {OHLCV_OK}) AS
 usable_ohlcv, count(*) FILTER (WHERE {MICRO_OK}) AS usable_micro, 100 * avg(is_stale) AS stale_pct,
 100 * avg(dq_flags // 16 % 2) AS zerovol_pct FROM panel GROUP BY 1""", "panel")


@query("data_quality_report", sql(
    f"""SELECT symbol, n_bars, n_segments, usable_ohlcv, usable_micro, {rq('stale_pct')} AS stale_pct, {rq('zerovol_pct')} AS zerovol_pct,
 {rq('CASE WHEN usable_ohlcv > 0 THEN usable_micro / usable_ohlcv ELSE 0 END')} AS micro_ratio,
 usable_ohlcv < 0.5 * (SELECT median(usable_ohlcv) FROM dq) OR stale_pct > 10 AS thin,
 CASE WHEN usable_ohlcv > 0 THEN usable_micro / usable_ohlcv ELSE 0 END < 0.7 AS low_micro FROM dq""", "dq"))
def data_quality_report(spark, sf_dir):
    out = Q.quality_flags(pin(Q.data_quality(V.panel(spark, sf_dir))))
    return out.withColumns({c: rd(c) for c in ("stale_pct", "zerovol_pct", "micro_ratio")})


@query("quality_totals", sql(
    f"""SELECT coalesce(symbol, '*') AS symbol, count(*) AS n_bars, count(*) FILTER (WHERE {OHLCV_OK}) AS usable_ohlcv,
 count(*) FILTER (WHERE {MICRO_OK}) AS usable_micro FROM panel GROUP BY ROLLUP (symbol)""", "panel"))
def quality_totals(spark, sf_dir):
    return Q.quality_totals(V.panel(spark, sf_dir))


@query("usable_bars", sql(
    f"SELECT symbol, bar_open_ms, ({OHLCV_OK}) AS ohlcv, ({MICRO_OK}) AS micro FROM panel", "panel"))
def usable_bars(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "bar_open_ms", Q.usable("ohlcv").alias("ohlcv"), Q.usable("micro").alias("micro"))


_LOOKBACK = 100 * WEEK


@query("train_liquidity", sql(
    f"""SELECT symbol, count(*) AS n_bars, {rq(f'count(*) FILTER (WHERE bar_open_ms >= {BOUNDARY - _LOOKBACK} AND is_stale = 0 AND m_5 = 0) / 100')}
 AS active_share FROM panel WHERE bar_open_ms < {BOUNDARY} GROUP BY 1""", "panel"))
def train_liquidity(spark, sf_dir):
    return Q.train_liquidity(V.panel(spark, sf_dir), BOUNDARY, _LOOKBACK, WEEK).withColumn("active_share", rd("active_share"))


@query("micro_density", sql(
    "SELECT dim, sum(n)::BIGINT AS total, min(n) AS smallest, count(*) FILTER (WHERE n < 330) AS n_thin, count(*) FILTER (WHERE n = 0) "
    "AS n_zero FROM (" + " UNION ALL ".join(
        f"SELECT symbol, {d}::INT AS dim, count(*) FILTER (WHERE m_{d} = 0) AS n FROM panel GROUP BY 1" for d in range(7, 13))
    + ") GROUP BY 1", "panel"))
def micro_density(spark, sf_dir):
    return Q.micro_density(V.panel(spark, sf_dir), range(7, 13), 330)


@query("frac_constant", sql(
    " UNION ALL ".join(f"SELECT 'x_{d}' AS feature, {rq('max(n) / sum(n)')} AS frac_constant FROM (SELECT round(x_{d}, 9), count(*) AS n FROM panel "
                       "GROUP BY 1)" for d in range(16)), "panel"))
def frac_constant(spark, sf_dir):
    # rounded, so that values that two engines compute alike count as one
    p = V.panel(spark, sf_dir).select(*[F.round(f"x_{d}", 9).alias(f"x_{d}") for d in range(16)])
    return Q.frac_constant(p, p.columns).withColumn("frac_constant", rd("frac_constant"))


@query("nonfinite_scan", sql(
    " UNION ALL ".join(f"SELECT 'x_{d}' AS feature, count(*) FILTER (WHERE NOT isfinite(x_{d})) AS n_nonfinite FROM panel"
                       for d in range(16)), "panel"))
def nonfinite_scan(spark, sf_dir):
    return Q.nonfinite_scan(V.panel(spark, sf_dir), [f"x_{d}" for d in range(16)])


@query("surface_stats", sql(
    " UNION ALL ".join(
        f"SELECT {d}::INT AS dim, {rq(f'stddev_pop(x_{d})')} AS stddev, count(*) FILTER (WHERE NOT isfinite(x_{d})) AS n_nonfinite, "
        f"{rq(f'avg(m_{d})')} AS mask_share, stddev_pop(x_{d}) = 0 AS x_degenerate, avg(m_{d}) IN (0, 1) AS m_degenerate FROM panel"
        for d in range(16)), "panel"))
def surface_stats(spark, sf_dir):
    return Q.surface_stats(V.panel(spark, sf_dir), range(16)).withColumns({c: rd(c) for c in ("stddev", "mask_share")})


@query("target_surface", sql(
    """SELECT count(*) FILTER (WHERE ok) AS n_valid, count(*) FILTER (WHERE ok AND row_idx < 120) AS n_valid_head,
 count(DISTINCT CASE WHEN ok AND row_idx < 120 THEN symbol END) AS symbols_with_valid_head FROM (SELECT *, seg_pos >= 8 AND
 lead(row_idx) OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) IS NOT NULL AS ok FROM panel)""", "panel"))
def target_surface(spark, sf_dir):
    return Q.target_surface(V.panel(spark, sf_dir), 8, 120)


@query("perp_unmasked", sql(
    "SELECT count(*) FILTER (WHERE NOT (m_13 = 1 AND m_14 = 1 AND m_15 = 1)) AS n_unmasked FROM panel", "panel"))
def perp_unmasked(spark, sf_dir):
    return Q.perp_unmasked(V.panel(spark, sf_dir))


_MODEL = ["bar_open_ms", "raw_ret_close", *[f"x_{d}" for d in range(7)]]


@query("model_columns", sql("SELECT " + ", ".join(
    c if c == "bar_open_ms" else f"{rq(c)} AS {c}" for c in _MODEL) + " FROM panel", "panel"))
def model_columns(spark, sf_dir):
    allowed = Q.model_columns(V.panel(spark, sf_dir))
    Q.assert_no_qa(allowed.columns)
    return allowed.select(*[c if c == "bar_open_ms" else rd(c).alias(c) for c in _MODEL])


@query("select_arm_ohlcv", sql("SELECT symbol, bar_open_ms, " + ", ".join(
    f"{rq(f'x_{d}')} AS x_{d}, m_{d}" for d in range(7)) + " FROM panel", "panel"))
def select_arm_ohlcv(spark, sf_dir):
    return U.select_arm(V.panel(spark, sf_dir), "ohlcv").withColumns({f"x_{d}": rd(f"x_{d}") for d in range(7)})


@query("constant_micro", sql("SELECT symbol, bar_open_ms, " + ", ".join(
    f"{'0.0::DOUBLE' if 7 <= d <= 12 else rq(f'x_{d}')} AS x_{d}, m_{d}" for d in range(16)) + " FROM panel", "panel"))
def constant_micro(spark, sf_dir):
    out = U.select_arm(U.constant_micro(V.panel(spark, sf_dir)), "micro")
    return out.withColumns({f"x_{d}": rd(f"x_{d}") for d in range(16)})


@query("clip_finite", """SELECT event_id, """ + rq("CASE WHEN d = 0 THEN NULL ELSE greatest(least((value - 50) / d, 5.0), -5.0) END", 9)
       + """ AS z FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS d FROM events)""")
def clip_finite(spark, sf_dir):
    t = V.trades(spark, sf_dir)
    ratio = F.when(F.col("quantity") == 0, F.lit(float("inf"))).otherwise((F.col("price") - 50) / F.nullif("quantity", F.lit(0.0)))
    return t.select(F.col("trade_id").alias("event_id"), rd(C.clip_finite(ratio), 9).alias("z"))


@query("calendar_keys", """SELECT event_id, (hour(ts) * 60 + minute(ts))::INT AS minute_of_day, hour(ts)::INT AS hour,
 (isodow(ts) - 1)::INT AS dow, (day(ts) - 1)::INT AS dom, (month(ts) - 1)::INT AS month FROM events""")
def calendar_keys(spark, sf_dir):
    t = V.trades(spark, sf_dir)
    return t.select(F.col("trade_id").alias("event_id"), *[c.alias(n) for n, c in C.calendar_keys("ts_ms").items()])


@query("dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_ms(date_trunc('day', ts)) AS midnight_ms FROM events")
def dates(spark, sf_dir):
    t = V.trades(spark, sf_dir).select(F.col("trade_id").alias("event_id"), C.ms_to_date("ts_ms").alias("day"))
    return t.withColumn("midnight_ms", C.date_to_ms("day"))


# times written the ways user files write them
cte("stamps", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN ((epoch_us(ts) // 1000) // 1000)::VARCHAR WHEN 1 THEN (epoch_us(ts) // 1000)::VARCHAR
 WHEN 2 THEN ((epoch_us(ts) // 1000) * 1000)::VARCHAR WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
 WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '+02:00' ELSE 'n/a' END AS text, ts FROM events""")


@query("parse_timestamp", sql(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 WHEN 1 THEN (epoch_us(ts) // 1000) WHEN 2 THEN (epoch_us(ts) // 1000)
 WHEN 3 THEN (epoch_us(ts) // 1000) // 1000 * 1000 WHEN 4 THEN (epoch_us(ts) // 1000) // 1000 * 1000 - 7200000 ELSE -1 END AS ms FROM stamps""", "stamps"))
def parse_timestamp(spark, sf_dir):
    t, kind = V.trades(spark, sf_dir), F.col("trade_id") % 6
    sec = F.timestamp_millis("ts_ms")
    text = (F.when(kind == 0, F.floor(F.col("ts_ms") / 1000).cast("string")).when(kind == 1, F.col("ts_ms").cast("string"))
            .when(kind == 2, (F.col("ts_ms") * 1000).cast("string"))
            .when(kind == 3, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(kind == 4, F.date_format(sec, "yyyy-MM-dd HH:mm:ss'+02:00'")).otherwise("n/a"))
    return t.select(F.col("trade_id").alias("event_id"), F.coalesce(C.parse_timestamp_ms(text), F.lit(-1)).alias("ms"))


# user bars: some rows broken on purpose by arithmetic on the event
_BROKEN = ("CASE WHEN event_id % 17 = 3 THEN -value WHEN event_id % 19 = 4 THEN NULL ELSE value END AS open, value AS close, "
           "CASE WHEN event_id % 23 = 5 THEN value * 0.9 ELSE value * 1.1 END AS high, value * 0.8 AS low")
cte("user_bars", f"SELECT event_id, event_type AS symbol, (epoch_us(ts) // 1000) AS ts_ms, {_BROKEN} FROM events")


def user_bars(spark, sf_dir):
    e, v = F.col("trade_id"), F.col("price")
    return V.trades(spark, sf_dir).select(
        e.alias("event_id"), "symbol", "ts_ms", F.when(e % 17 == 3, -v).when(e % 19 == 4, None).otherwise(v).alias("open"),
        v.alias("close"), F.when(e % 23 == 5, v * 0.9).otherwise(v * 1.1).alias("high"), (v * 0.8).alias("low"),
        F.when(e % 29 == 1, None).otherwise(F.col("quantity")).alias("volume"))


@query("validate_bars", sql(
    """SELECT symbol, reason, count(*) AS n, min(event_id) AS first_line FROM (SELECT *, CASE WHEN open IS NULL THEN 'not numeric'
 WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'not positive' WHEN high < low - 1e-9 OR high < greatest(open, close) - 1e-9
 OR low > least(open, close) + 1e-9 THEN 'not a bar' END AS reason FROM user_bars) WHERE reason IS NOT NULL GROUP BY 1, 2""", "user_bars"))
def validate_bars(spark, sf_dir):
    return Q.reject_report(user_bars(spark, sf_dir), ["symbol"], "event_id")


@query("dedup_by_time", sql(
    f"""SELECT symbol, h AS ts_ms, event_id, close FROM (SELECT *, ts_ms // {HOUR} * {HOUR} AS h, row_number() OVER (PARTITION BY symbol,
 ts_ms // {HOUR} ORDER BY event_id) AS rn FROM user_bars) WHERE rn = 1""", "user_bars"))
def dedup_by_time(spark, sf_dir):
    b = user_bars(spark, sf_dir).select("symbol", F.floor(F.col("ts_ms") / HOUR).alias("h"), "event_id", "close")
    b = b.withColumn("ts_ms", F.col("h") * HOUR).drop("h")
    return Q.dedup_by_time(b, ["symbol"], "ts_ms", "event_id")


@query("dedup_report", sql(
    f"""SELECT symbol, count(DISTINCT h) AS n_kept, count(*) - count(DISTINCT h) AS n_dropped, count(DISTINCT h) >= 680 AS enough FROM
 (SELECT symbol, ts_ms // {HOUR} AS h FROM user_bars) GROUP BY 1""", "user_bars"))
def dedup_report(spark, sf_dir):
    b = user_bars(spark, sf_dir).withColumn("h", F.floor(F.col("ts_ms") / HOUR))
    return Q.dedup_report(b, ["symbol"], "h", 680)


@query("infer_interval", sql(
    f"""SELECT symbol, {rq('median(d)')} AS interval_ms FROM (SELECT symbol, bar_open_ms - lag(bar_open_ms) OVER (PARTITION BY symbol
 ORDER BY bar_open_ms) AS d FROM klines) GROUP BY 1""", "klines"))
def infer_interval(spark, sf_dir):
    k = pin(V.klines(spark, sf_dir).select("symbol", "bar_open_ms"))
    return Q.infer_interval(k, Timeline(step=HOUR, chunk=96)).withColumn("interval_ms", rd("interval_ms"))


@query("series_warnings", sql(
    """SELECT symbol, count(*) AS n, count(DISTINCT close) AS n_distinct, min(close) = max(close) AS refused,
 array_to_string(list_filter([CASE WHEN count(DISTINCT close) < greatest(10, count(*) // 500) THEN 'near constant' END,
 CASE WHEN count(*) FILTER (WHERE event_id % 29 = 1) > 0 THEN 'unparsable volume' END, 'interval'], lambda x: x IS NOT NULL), ',') AS warnings
 FROM user_bars GROUP BY 1""", "user_bars"))
def series_warnings(spark, sf_dir):
    b = user_bars(spark, sf_dir)
    interval = b.groupBy("symbol").agg((F.max("ts_ms") - F.min("ts_ms")).cast("double").alias("interval_ms"))
    return Q.series_warnings(b, ["symbol"], interval).withColumn("warnings", F.array_join("warnings", ","))


@query("canonical_json", """SELECT event_id, '{"event_type":"' || event_type || '","k":' || regexp_extract(props, '"k": ([0-9]+)', 1) ||
 ',"user_id":' || user_id || '}' AS doc FROM events""")
def canonical_json(spark, sf_dir):
    from barloom.operators.hashing import canonical_json as cj
    t = V.trades(spark, sf_dir).select(F.col("trade_id").alias("event_id"), F.col("symbol").alias("event_type"),
                                       F.col("quantity").cast("int").alias("k"), "user_id")
    return t.select("event_id", cj(["user_id", "k", "event_type"]).alias("doc"))


@query("train_bar_counts", sql(f"SELECT symbol, count(*) AS n_train FROM panel WHERE bar_open_ms < {BOUNDARY} GROUP BY 1", "panel"))
def train_bar_counts(spark, sf_dir):
    return U.train_bar_counts(V.panel(spark, sf_dir), BOUNDARY)


@query("fold_plan", sql(
    """SELECT symbol, row_idx, CASE WHEN row_idx < te THEN -1 ELSE (SELECT max(i) FROM range(6) r(i) WHERE row_idx >= te + (n - te) * i // 6)
 END::INT AS block, row_idx + 60 < te AS purged_train, row_idx < te - 120 AS embargoed_train FROM (SELECT symbol, row_idx, n,
 floor(0.7::DOUBLE * n)::BIGINT AS te FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM panel))""", "panel"))
def fold_plan(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir).select("symbol", "row_idx"))
    n = p.groupBy("symbol").agg(F.count("*").alias("n"))
    return U.fold_plan(p.join(n, "symbol"), "n").select("symbol", "row_idx", "block", "purged_train", "embargoed_train")


@query("calendar_block", sql(
    "SELECT symbol, bar_open_ms, CASE " + " ".join(
        f"WHEN bar_open_ms >= {lo} THEN {i}" for i, (lo, _) in reversed(list(enumerate(U.eval_blocks(LO, HI))))) + " ELSE -1 END::INT AS block "
    "FROM panel", "panel"))
def calendar_block(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "bar_open_ms", U.calendar_block("bar_open_ms", LO, HI).alias("block"))


@query("quadrant", sql(
    f"""SELECT symbol, bar_open_ms, CASE WHEN symbol < 'Brand#2' AND bar_open_ms < {BOUNDARY} THEN 'Q1' WHEN symbol < 'Brand#2' THEN 'Q2'
 WHEN bar_open_ms < {BOUNDARY} THEN 'Q3' ELSE 'Q4' END AS quadrant FROM panel""", "panel"))
def quadrant(spark, sf_dir):
    return V.panel(spark, sf_dir).select("symbol", "bar_open_ms", U.quadrant(
        F.col("symbol") < "Brand#2", F.col("bar_open_ms") < BOUNDARY).alias("quadrant"))


@query("assemble_window", sql(
    f"SELECT bar_open_ms, segment_id, {rq('x_0')} AS x_0, m_0 FROM panel WHERE symbol = 'Brand#7' AND bar_open_ms >= {BOUNDARY} "
    f"AND bar_open_ms < {HI}", "panel"))
def assemble_window(spark, sf_dir):
    out = U.assemble_window(V.panel(spark, sf_dir), "Brand#7", BOUNDARY, HI)
    return out.select("bar_open_ms", "segment_id", rd("x_0").alias("x_0"), "m_0")


@query("tail_rows", sql(
    f"""SELECT symbol, bar_open_ms FROM (SELECT *, count(*) FILTER (WHERE bar_open_ms < {BOUNDARY}) OVER (PARTITION BY symbol) AS nb
 FROM panel) WHERE row_idx >= greatest(nb - 50, 0)""", "panel"))
def tail_rows(spark, sf_dir):
    return U.tail_rows(pin(V.panel(spark, sf_dir).select("symbol", "bar_open_ms", "row_idx")), BOUNDARY, 50).select("symbol", "bar_open_ms")
