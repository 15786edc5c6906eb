"""W-12..W-28, K10, P27 on the weekly panel."""

from pyspark.sql import functions as F

from barloom.operators import segments as S
from barloom.operators import windows as Wn
from barloom.session import pin
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.views import WCFG, WEEK, rd, rq, sql

TL = S.timeline(WCFG)
SEG = "PARTITION BY symbol, segment_id ORDER BY bar_open_ms"
SYM = "PARTITION BY symbol ORDER BY bar_open_ms"
KEYS = "symbol, bar_open_ms"


def _fwd(h, lo):
    return (f"coalesce(sum(raw_ret_close) OVER ({SEG} ROWS BETWEEN {lo} FOLLOWING AND {max(h, lo)} FOLLOWING), 0)")


for _h in (1, 4):
    _value = _fwd(_h, 2) if _h >= 2 else "0.0"

    @query(f"forward_returns_eval_h{_h}", sql(
        f"""SELECT {KEYS}, CASE WHEN seg_pos < n - {_h} AND n - {_h} > 1 THEN {rq('v')} END AS y FROM (SELECT *, {_value} AS v,
 count(*) OVER (PARTITION BY symbol, segment_id) AS n FROM panel)""", "panel"))
    def _eval(spark, sf_dir, h=_h):
        return Wn.forward_returns(V.panel(spark, sf_dir), TL, h).select("symbol", "bar_open_ms", rd("y").alias("y"))

    _value = _fwd(_h, 2) if _h >= 2 else f"lead(raw_ret_close) OVER ({SEG})"

    @query(f"forward_returns_screen_h{_h}", sql(
        f"""SELECT {KEYS}, CASE WHEN seg_pos < n - {_h} THEN {rq('v')} END AS y FROM (SELECT *, {_value} AS v,
 count(*) OVER (PARTITION BY symbol, segment_id) AS n FROM panel)""", "panel"))
    def _screen(spark, sf_dir, h=_h):
        return Wn.forward_returns(V.panel(spark, sf_dir), TL, h, rule="screen").select(
            "symbol", "bar_open_ms", rd("y").alias("y"))


@query("period_returns", sql(
    f"""SELECT {KEYS}, CASE WHEN seg_pos < n - 4 AND row_idx > 0 THEN {rq('v')} END AS y FROM (SELECT *, {_fwd(4, 1)} AS v,
 count(*) OVER (PARTITION BY symbol, segment_id) AS n FROM panel)""", "panel"))
def period_returns(spark, sf_dir):
    return Wn.forward_returns(V.panel(spark, sf_dir), TL, 4, rule="period").select("symbol", "bar_open_ms", rd("y").alias("y"))


@query("expanding_sigma", sql(
    f"SELECT {KEYS}, {rq(f'avg(sigma) OVER ({SYM} ROWS UNBOUNDED PRECEDING)')} AS sigma_bar FROM panel", "panel"))
def expanding_sigma(spark, sf_dir):
    return Wn.expanding_sigma(pin(V.panel(spark, sf_dir)), TL).select("symbol", "bar_open_ms", rd("sigma_bar").alias("sigma_bar"))


@query("window_starts", sql(
    f"SELECT symbol, row_idx FROM (SELECT *, lead(bar_open_ms, 15) OVER ({SEG}) AS l FROM panel) "
    "WHERE l IS NOT NULL AND seg_pos % 8 = 0", "panel"))
def window_starts(spark, sf_dir):
    return Wn.window_starts(V.panel(spark, sf_dir), TL, 16, 8).select("symbol", "row_idx")


_BOUNDARY = 925_000_000_000  # 1999-04-25


@query("fold_valid_starts", sql(
    f"SELECT symbol, row_idx FROM (SELECT *, lead(bar_open_ms, 15) OVER ({SEG}) AS l FROM panel) "
    f"WHERE l < {_BOUNDARY - 120 * WEEK} AND seg_pos % 4 = 0", "panel"))
def fold_valid_starts(spark, sf_dir):
    return Wn.fold_valid_starts(V.panel(spark, sf_dir), TL, 16, 4, _BOUNDARY).select("symbol", "row_idx")


@query("chunk_ranges", sql(
    "SELECT symbol, segment_id, seg_pos // 32 AS part, min(row_idx) AS start_idx, max(row_idx) + 1 AS end_idx FROM panel "
    "GROUP BY 1, 2, 3", "panel"))
def chunk_ranges(spark, sf_dir):
    return Wn.chunk_ranges(V.panel(spark, sf_dir), 32)


@query("longest_run", sql(
    """SELECT symbol, segment_id, max(run) AS longest_run, sum(run)::BIGINT AS n_hits FROM (SELECT symbol, segment_id, count(*)
 AS run FROM (SELECT *, rn - row_number() OVER (PARTITION BY symbol, segment_id ORDER BY rn) AS isl FROM (SELECT *, row_number()
 OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) AS rn FROM panel) WHERE x_7 > 0) GROUP BY 1, 2, isl) GROUP BY 1, 2""",
    "panel"))
def longest_run(spark, sf_dir):
    return Wn.longest_run(pin(V.panel(spark, sf_dir)), TL, F.col("x_7") > 0)


@query("trailing_run", sql(
    """SELECT symbol, segment_id, count(*) AS trailing, max(seg_len) AS seg_len FROM (SELECT symbol, segment_id, bar_open_ms,
 max(CASE WHEN NOT x_7 > 0 THEN bar_open_ms END) OVER (PARTITION BY symbol, segment_id) AS last_ok, count(*) OVER
 (PARTITION BY symbol, segment_id) AS seg_len FROM panel) WHERE last_ok IS NULL OR bar_open_ms > last_ok GROUP BY 1, 2""", "panel"))
def trailing_run(spark, sf_dir):
    return Wn.trailing_run(V.panel(spark, sf_dir), F.col("x_7") > 0)


@query("lag_correlation", sql(
    f"""SELECT symbol, n_pairs, {rq('r0')} AS r0, {rq('r_next')} AS r_next, {rq('r_prev')} AS r_prev,
 r0 > greatest(r_next, r_prev) + 0.02 AS passes FROM (SELECT symbol, count(*) FILTER (WHERE near) AS n_pairs,
 corr(x_5, b) FILTER (WHERE ok) AS r0, corr(pa, b) FILTER (WHERE near) AS r_next, corr(x_5, pb) FILTER (WHERE near) AS r_prev
 FROM (SELECT *, ok AND lag(ok) OVER ({SYM}) AND bar_open_ms - lag(bar_open_ms) OVER ({SYM}) = {WEEK} AS near,
 lag(x_5) OVER ({SYM}) AS pa, lag(b) OVER ({SYM}) AS pb FROM (SELECT *, x_9 + x_10 AS b, m_5 = 0 AND m_9 = 0 AND m_10 = 0 AS ok
 FROM panel)) GROUP BY 1) WHERE n_pairs >= 20""", "panel"))
def lag_correlation(spark, sf_dir):
    p = V.panel(spark, sf_dir).withColumn("b", F.col("x_9") + F.col("x_10"))
    ok = (F.col("m_5") == 0) & (F.col("m_9") == 0) & (F.col("m_10") == 0)
    out = Wn.lag_correlation(p, TL, "x_5", "b", ok, ["symbol"])
    return out.select("symbol", "n_pairs", rd("r0").alias("r0"), rd("r_next").alias("r_next"), rd("r_prev").alias("r_prev"), "passes")


_LAGS = (1, 5, 15, 30)


@query("acf", sql(
    "SELECT symbol, lag::INT AS lag, " + rq("sum(d * nd) / max(den)") + " AS rho FROM (" + " UNION ALL ".join(
        f"SELECT symbol, {k} AS lag, d, lead(d, {k}) OVER ({SYM}) AS nd, sum(d * d) OVER (PARTITION BY symbol) AS den FROM "
        "(SELECT *, raw_ret_close - avg(raw_ret_close) OVER (PARTITION BY symbol) AS d FROM panel)" for k in _LAGS)
    + ") GROUP BY 1, 2", "panel"))
def acf(spark, sf_dir):
    return Wn.acf(pin(V.panel(spark, sf_dir)), ["symbol"], "raw_ret_close", _LAGS, 64).withColumn("rho", rd("rho"))


@query("acf_summary", sql(
    "SELECT kind, lag, " + rq("avg(rho)") + " AS mean_rho, " + rq("max(abs(rho))") + " AS max_abs FROM (SELECT kind, symbol, lag, "
    "sum(d * nd) / max(den) AS rho FROM (" + " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, symbol, {k}::INT AS lag, d, lead(d, {k}) OVER ({SYM}) AS nd, sum(d * d) OVER (PARTITION BY symbol) AS den "
        f"FROM (SELECT *, {e} - avg({e}) OVER (PARTITION BY symbol) AS d FROM panel)"
        for kind, e in (("signed", "raw_ret_close"), ("absolute", "abs(raw_ret_close)")) for k in _LAGS)
    + ") GROUP BY 1, 2, 3) GROUP BY 1, 2", "panel"))
def acf_summary(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir))
    parts = p.select("symbol", "row_idx", F.explode(F.array(
        F.struct(F.lit("signed").alias("kind"), F.col("raw_ret_close").alias("v")),
        F.struct(F.lit("absolute").alias("kind"), F.abs("raw_ret_close").alias("v")))).alias("e")).select(
        "symbol", "row_idx", F.col("e.kind").alias("kind"), F.col("e.v").alias("v"))
    out = Wn.acf(parts, ["kind", "symbol"], "v", _LAGS, 64)
    return out.groupBy("kind", "lag").agg(rd(F.avg("rho")).alias("mean_rho"), rd(F.max(F.abs("rho"))).alias("max_abs"))


@query("lag1_autocorr", sql(
    f"""SELECT symbol, {rq('corr(p, raw_ret_close)')} AS ac_pairs, {rq('sum((raw_ret_close - m) * (p - m)) / sum((raw_ret_close - m) * (raw_ret_close - m))')}
 AS ac_full FROM (SELECT *, lag(raw_ret_close) OVER ({SYM}) AS p, avg(raw_ret_close) OVER (PARTITION BY symbol) AS m FROM panel)
 GROUP BY 1""", "panel"))
def lag1_autocorr(spark, sf_dir):
    out = Wn.lag1_autocorr(pin(V.panel(spark, sf_dir)), ["symbol"], "row_idx", "raw_ret_close", 64)
    return out.select("symbol", rd("ac_pairs").alias("ac_pairs"), rd("ac_full").alias("ac_full"))


V.cte("tokens", "SELECT symbol, bar_open_ms, segment_id, seg_pos, row_idx, (n_trades % 11)::INT AS b_c, (v_kline % 13)::INT AS b_f "
      "FROM panel", "panel")


def tokens(spark, sf_dir):
    """Two coarse integer codes per bar, standing in for a token stream."""
    return V.panel(spark, sf_dir).select(
        "symbol", "bar_open_ms", "segment_id", "seg_pos", "row_idx", (F.col("n_trades") % 11).cast("int").alias("b_c"),
        (F.col("v_kline") % 13).cast("int").alias("b_f"))


@query("persistence_accuracy", sql(
    f"""SELECT symbol, {rq('avg((b_c = p)::INT)')} AS accuracy, count(*) AS n FROM (SELECT *, lag(b_c) OVER (PARTITION BY symbol,
 segment_id, seg_pos // 16 ORDER BY row_idx) AS p FROM tokens) WHERE p IS NOT NULL GROUP BY 1""", "tokens"))
def persistence_accuracy(spark, sf_dir):
    return Wn.persistence_accuracy(tokens(spark, sf_dir), 16).withColumn("accuracy", rd("accuracy"))


@query("lagged_features", sql(
    f"SELECT {KEYS}, " + ", ".join(f"coalesce(lag(b_{c}, {k}) OVER ({SEG}), -1) AS b_{c}_lag{k}" for c in "cf" for k in (1, 2, 4))
    + " FROM tokens", "tokens"))
def lagged_features(spark, sf_dir):
    out = Wn.lagged_features(tokens(spark, sf_dir), TL, ["b_c", "b_f"], [1, 2, 4])
    return out.select("symbol", "bar_open_ms", *[F.coalesce(f"b_{c}_lag{k}", F.lit(-1)).alias(f"b_{c}_lag{k}") for c in "cf" for k in (1, 2, 4)])


@query("seq_context", sql(
    f"""SELECT {KEYS}, array_to_string(list(b_c) OVER w, ',') AS ids, len(list(b_c) OVER w)::INT AS n FROM tokens
 WINDOW w AS ({SYM} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""", "tokens"))
def seq_context(spark, sf_dir):
    out = Wn.seq_context(tokens(spark, sf_dir), 16, ["b_c"], block=64)
    return out.select("symbol", "bar_open_ms", F.array_join(F.transform("context", lambda r: r["b_c"].cast("string")), ",").alias("ids"),
                      F.size("context").alias("n"))


@query("average_rank", sql(
    f"SELECT {KEYS}, rank() OVER (PARTITION BY symbol ORDER BY n_trades) + (count(*) OVER (PARTITION BY symbol, n_trades) - 1) / 2.0::DOUBLE "
    "AS rank FROM panel", "panel"))
def average_rank(spark, sf_dir):
    p = pin(V.panel(spark, sf_dir).select("symbol", "bar_open_ms", "n_trades"))
    return Wn.average_rank(p, ["symbol"], "n_trades").select("symbol", "bar_open_ms", "rank")


@query("path_quantiles", """SELECT coalesce(seed, -1)::BIGINT AS seed, step, """ + ", ".join(
    f"{rq(f'quantile_cont(value, {q / 100})')} AS p{q}" for q in (10, 25, 50, 75, 90)) + """ FROM (SELECT user_id % 3 AS seed,
 CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 8 AS step, value FROM events) GROUP BY GROUPING SETS ((seed, step), (step))""")
def path_quantiles(spark, sf_dir):
    t = V.trades(spark, sf_dir)
    paths = t.select((F.col("user_id") % 3).alias("seed"), (F.col("quantity").cast("bigint") % 8).alias("step"),
                     F.col("price").alias("value"))
    out = Wn.path_quantiles(paths)
    return out.select("seed", "step", *[rd(f"p{q}").alias(f"p{q}") for q in (10, 25, 50, 75, 90)])
