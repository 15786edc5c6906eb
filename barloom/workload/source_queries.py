"""S1-S15, C1, C3-C5, D3, D6, E13, V5 and J10 as round trips through files that Spark writes and reads."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import features as X
from barloom.operators import hashing as H
from barloom.operators import segments as S
from barloom.operators import windows as Wn
from barloom.plans import build as Bld
from barloom.plans import predict as P
from barloom.session import pin, scratch
from barloom.sources import files as Fl
from barloom.sources import lake as Lk
from barloom.workload import eval_queries as Q
from barloom.workload import feature_queries as FQ
from barloom.workload import token_queries as Tq
from barloom.workload import universe_queries as Uq
from barloom.workload import views as V
from barloom.workload.registry import query
from barloom.workload.stats_queries import u_sql
from barloom.workload.views import HCFG, HOUR, WCFG, WEEK, cte, rd, rq, sql

TL = S.timeline(WCFG)
_TICKS = f"SELECT symbol, count(*) AS n, {rq('sum(price)', 2)} AS price, sum(quantity)::BIGINT AS quantity, min(ts_ms) AS first_ms FROM trades GROUP BY 1"


def _tick_files(spark, sf_dir, header):
    t = V.trades(spark, sf_dir)
    root = scratch(spark)
    out = t.select("symbol", F.col("trade_id").alias("agg_trade_id"), "price", "quantity", F.col("trade_id").alias("first_trade_id"),
                   F.col("trade_id").alias("last_trade_id"), F.col("ts_ms").alias("transact_time"), "is_buyer_maker")
    out.write.partitionBy("symbol").csv(root, header=header)
    return root


def _tick_sums(df):
    return df.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.sum("price"), 2).alias("price"), F.sum("quantity").cast("bigint").alias("quantity"), F.min("ts_ms").alias("first_ms"))


@query("read_trades_plain", sql(_TICKS, "trades"))
def read_trades_plain(spark, sf_dir):
    return _tick_sums(Fl.read_trades(spark, _tick_files(spark, sf_dir, False)))


@query("read_trades_header", sql(_TICKS, "trades"))
def read_trades_header(spark, sf_dir):
    return _tick_sums(Fl.read_trades(spark, _tick_files(spark, sf_dir, True)))


@query("read_klines", sql(
    f"SELECT symbol, count(*) AS n, {rq('sum(close)', 2)} AS close, sum(v_kline)::BIGINT AS v_kline, max(bar_open_ms)::BIGINT AS last_ms FROM klines GROUP BY 1", "klines"))
def read_klines(spark, sf_dir):
    k, root, zero = V.klines(spark, sf_dir), scratch(spark), F.lit(0)
    k.select("symbol", "bar_open_ms", "open", "high", "low", "close", "v_kline", (F.col("bar_open_ms") + HOUR - 1).alias("t"), "quote_volume",
             *[zero.alias(c) for c in "abcd"]).write.partitionBy("symbol").csv(root, header=True)
    out = Fl.read_klines(spark, root)
    return out.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.sum("close"), 2).alias("close"), F.sum("v_kline").cast("bigint").alias("v_kline"), F.max("bar_open_ms").alias("last_ms"))


@query("read_ohlcv_csv", sql(
    f"SELECT count(*) AS n, {rq('sum(close)', 2)} AS close, {rq('sum(high)', 2)} AS high, {rq('sum(close * v_kline)', 1)} AS amount, sum(bar_open_ms)::HUGEINT::DOUBLE AS ts FROM klines", "klines"))
def read_ohlcv_csv(spark, sf_dir):
    """Two header styles and column orders side by side."""
    k, root = V.klines(spark, sf_dir), scratch(spark)
    a = k.filter("symbol < 'm'").select(F.col("bar_open_ms").alias("Open_Time"), "open", "high", "low", "close", F.col("v_kline").alias("Volume"))
    b = k.filter("symbol >= 'm'").select(F.col("close").alias("C"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("L"),
                                         F.date_format(F.timestamp_millis("bar_open_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date"), F.col("v_kline").alias("V"))
    a.write.csv(f"{root}/a", header=True)
    b.write.csv(f"{root}/b", header=True)
    out = Fl.read_ohlcv_csv(spark, root)
    return out.agg(F.count("*").alias("n"), rd(F.sum("close"), 2).alias("close"), rd(F.sum("high"), 2).alias("high"), rd(F.sum("amount"), 1).alias("amount"),
                   F.sum(F.col("ts_ms").cast("double")).alias("ts"))


_LAKE = "SELECT symbol, count(*) AS n_bars, count(DISTINCT segment_id) AS n_segments, sum(n_trades)::BIGINT AS n_trades, min(bar_open_ms)::BIGINT AS first_ms FROM segs GROUP BY 1"


def _lake_rows(spark, sf_dir):
    return S.assign_segments(V.bars(spark, sf_dir), HCFG).select("symbol", "bar_open_ms", "segment_id", "n_trades", F.lit(0).alias("m_9"), F.log("close").alias("x_0"))


def _lake_sums(df):
    return df.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(
        F.count("*").alias("n_bars"), F.countDistinct("segment_id").alias("n_segments"), F.sum("n_trades").alias("n_trades"), F.min("bar_open_ms").alias("first_ms"))


@query("write_lake", sql(_LAKE, "segs"))
def write_lake(spark, sf_dir):
    root = scratch(spark)
    Lk.write_lake(_lake_rows(spark, sf_dir), root, "1h", by="date")
    return _lake_sums(Lk.connect_lake(spark, root))


@query("compact_lake", sql(_LAKE, "segs"))
def compact_lake(spark, sf_dir):
    root = scratch(spark)
    Lk.write_lake(_lake_rows(spark, sf_dir), f"{root}/day", "1h", by="date")
    Lk.compact_lake(spark, f"{root}/day", f"{root}/month")
    return _lake_sums(spark.read.parquet(f"{root}/month"))


@query("reduce_shards", sql(
    f"SELECT symbol, strftime(epoch_ms(bar_open_ms::BIGINT), '%Y-%m') AS month, count(*) AS n_bars, sum(n_trades)::BIGINT AS n_trades FROM flow GROUP BY 1, 2", "flow"))
def reduce_shards(spark, sf_dir):
    """A run in which one symbol has another name, then the true ticks: only its shards are rebuilt, those of the old name go."""
    from barloom.operators.bars import reduce_trades
    t, root = V.trades(spark, sf_dir), scratch(spark)
    run = lambda x: reduce_trades(x, HOUR)
    other = t.withColumn("symbol", F.when(F.col("symbol") == "view", "gone").otherwise(F.col("symbol")))
    Lk.reduce_shards(other, root, run, HOUR)
    rebuilt = Lk.reduce_shards(t, root, run, HOUR)
    assert rebuilt.filter("symbol <> 'view'").count() == 0
    store = Lk.shard_store(root).read(spark)
    return store.groupBy("symbol", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n_bars"), F.sum("n_trades").alias("n_trades"))


@query("ledger", sql("SELECT DISTINCT symbol FROM months WHERE substr(month, 6, 2)::INT % 3 = 0", "months"))
def ledger(spark, sf_dir):
    root = scratch(spark)
    rows = Uq.ledger(spark, sf_dir)
    Lk.append_ledger(rows.filter("event <> 'lake_built'"), root)
    Lk.append_ledger(rows.filter("event = 'lake_built'"), root)
    return Lk.built_symbols(spark, root)


@query("verify_inventory", """WITH s AS (SELECT event_type AS symbol, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))
SELECT symbol, CASE i % 5 WHEN 0 THEN 'SHORT' WHEN 1 THEN 'CONTENT MISMATCH' ELSE 'EXTRA' END AS status FROM s WHERE i % 5 < 4 UNION ALL SELECT 'no ' || symbol, 'MISSING' FROM s WHERE i % 5 = 3""")
def verify_inventory(spark, sf_dir):
    """One file a symbol, against a manifest with other sizes, other contents, files left out and files renamed."""
    root = scratch(spark)
    V.trades(spark, sf_dir).repartition("symbol").write.partitionBy("symbol").parquet(root)
    symbol = lambda: F.regexp_extract("path", "symbol=([^/]*)/", 1)
    inv = pin(Fl.inventory(spark, root).filter(F.col("path").endswith(".parquet")))
    i = F.col("i") % 5
    listed = inv.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(symbol())) - 1).filter(i != 2)  # one row per symbol
    manifest = listed.select(F.when(i == 3, F.regexp_replace("path", "symbol=", "symbol=no ")).otherwise(F.col("path")).alias("path"),
                             (F.col("size") + F.when(i == 0, 1).otherwise(0)).alias("size"), F.when(i == 1, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    return Fl.verify_inventory(inv, manifest).select(symbol().alias("symbol"), "status")


@query("subset_manifest", sql("SELECT 'S' || split_part(symbol, 'S', 2) AS symbol, count(*) AS n_files, sum(bytes)::BIGINT AS size FROM months WHERE symbol LIKE 'S1%USDT' GROUP BY 1", "months").replace(
    "'S' || split_part(symbol, 'S', 2)", "symbol"))
def subset_manifest(spark, sf_dir):
    m = Uq.months(spark, sf_dir)
    files = m.select(F.concat(F.lit("lake/symbol="), "symbol", F.lit("/month="), "month", F.lit("/part.parquet")).alias("path"), F.col("bytes").alias("size"))
    wanted = m.select("symbol").filter("symbol like 'S1%USDT'").distinct()
    return Fl.subset_manifest(files, wanted).groupBy("symbol").agg(F.count("*").alias("n_files"), F.sum("size").alias("size"))


@query("token_stream", sql("SELECT symbol, count(*) AS n, sum(b_c)::BIGINT AS b_c, sum(b_f)::BIGINT AS b_f FROM ptok GROUP BY 1", "ptok"))
def token_stream(spark, sf_dir):
    root = scratch(spark)
    t = pin(Tq.panel_tokens(spark, sf_dir).select("symbol", "bar_open_ms", "b_c", "b_f"))
    hashes = pin(H.dataset_hash(t, TL, H.row_text(["b_c", "b_f"])))
    Lk.write_token_stream(t, root, "tok-1", hashes, 512)
    out = Lk.load_token_stream(spark, root, "tok-1", hashes, 512)
    return out.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.count("*").alias("n"), F.sum("b_c").alias("b_c"), F.sum("b_f").alias("b_f"))


@query("eval_artifacts", """SELECT o_orderkey AS unit, 'missing' AS problem FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey + 100000000, 'extra' FROM orders WHERE o_orderkey % 13 = 0 UNION ALL
 SELECT o_orderkey, 'altered' FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 11 <> 0""")
def eval_artifacts(spark, sf_dir):
    """Stored units with some absent, some unexpected and some altered after they were hashed."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("ir"))
    present = o.filter("unit % 11 <> 0").unionByName(o.filter("unit % 13 = 0").withColumn("unit", F.col("unit") + 100_000_000))
    root = scratch(spark)
    cols = ["unit", "ir"]
    Lk.write_eval_artifacts(present, f"{root}/true", cols)
    spark.read.parquet(f"{root}/true").withColumn("ir", F.when((F.col("unit") % 17 == 0) & (F.col("unit") < 100_000_000), F.col("ir") + 1).otherwise(F.col("ir"))).write.parquet(f"{root}/held")
    return Lk.load_eval_artifacts(spark, f"{root}/held", o, ["unit"], cols)[1]


_SHARES = (10, 25, 50, 75, 90)


@query("forecast_export", f"""SELECT seed, step, 'p' || q AS quantile, {rq('v')} AS value FROM (SELECT coalesce(seed, -1)::BIGINT AS seed, step::BIGINT AS step, unnest({list(_SHARES)}) AS q, unnest([{', '.join(f'quantile_cont(value, {q / 100})' for q in _SHARES)}]) AS v FROM
 (SELECT user_id % 3 AS seed, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 8 AS step, value FROM events) GROUP BY GROUPING SETS ((seed, step), (step)))""")
def forecast_export(spark, sf_dir):
    """The exported file, read back."""
    from barloom.workload.window_queries import path_quantiles
    root = scratch(spark)
    q = pin(path_quantiles(spark, sf_dir))
    Fl.forecast_export(q, q.agg(F.count("*").alias("rows")), root)
    out = spark.read.schema("seed long, step long, quantile string, value double").csv(f"{root}/quantiles", header=True)
    return out.withColumn("value", rd("value"))


@query("load_universe_spec", sql("SELECT symbol, 'um' AS market, listing_date, true AS perp_available FROM spec", "spec"))
def load_universe_spec(spark, sf_dir):
    root = scratch(spark)
    Uq.spec(spark, sf_dir).write.json(root)
    return Fl.load_universe_spec(spark, root).select("symbol", "market", "listing_date", "perp_available")


# ---- composed pipelines ---------------------------------------------------------------------------------------------

@query("build_features", sql(
    "SELECT symbol, bar_open_ms::BIGINT AS bar_open_ms, " + ", ".join(f"{rq(f'x_{d}', FQ._D[d])} AS x_{d}" for d in range(16)) + f", {rq('sigma')} AS sigma FROM masked", "masked"))
def build_features(spark, sf_dir):
    ticks = V.trades(spark, sf_dir)
    out = Bld.build_features(ticks, V.stated(spark, sf_dir, ticks), HCFG, V.funding(spark, sf_dir), V.open_interest(spark, sf_dir))
    return out.select("symbol", "bar_open_ms", *[rd(f"x_{d}", FQ._D[d]).alias(f"x_{d}") for d in range(16)], rd("sigma").alias("sigma"))


# hourly symbols with live spans of their own
cte("hspec", """SELECT DISTINCT event_type AS symbol, CASE WHEN event_type < 'm' THEN '2024-01-04' END AS listing_date, CASE WHEN event_type > 'r' THEN '2024-01-25' END AS delisting_date FROM events""")


def hspec(spark, sf_dir):
    e = F.col("event_type")
    return V.table(spark, sf_dir, "events").select(e.alias("symbol"), F.when(e < "m", "2024-01-04").alias("listing_date"), F.when(e > "r", "2024-01-25").alias("delisting_date")).distinct()


@query("build_universe", sql(
    """SELECT k.symbol, count(*) AS n_bars, any_value(listing_date IS NOT NULL) AS head_truncated, any_value(delisting_date IS NOT NULL) AS tail_truncated FROM klines k JOIN hspec s ON k.symbol = s.symbol WHERE
 bar_open_ms >= epoch_ms(coalesce(listing_date, '2024-01-02')::DATE::TIMESTAMP) AND bar_open_ms < epoch_ms(coalesce(delisting_date, '2024-01-29')::DATE::TIMESTAMP) GROUP BY 1""", "klines", "hspec"))
def build_universe(spark, sf_dir):
    cov, _ = Bld.build_universe(V.bars(spark, sf_dir), hspec(spark, sf_dir), ("2024-01-02", "2024-01-29"), HCFG, scratch(spark))
    return cov.select(F.col("symbol").cast("string").alias("symbol"), "n_bars", "head_truncated", "tail_truncated")


@query("rollup_manifest", sql(
    """SELECT p.symbol, count(*) AS n_bars, count(DISTINCT segment_id) AS n_segments, any_value(coalesce(listing_date, '')) AS listing_date, any_value(dataset_hash) AS dataset_hash FROM panel p JOIN brand_spec s
 ON p.symbol = s.symbol JOIN dhash d ON d.symbol = p.symbol GROUP BY 1""", "panel", "brand_spec", "dhash"))
def rollup_manifest(spark, sf_dir):
    p = V.panel(spark, sf_dir)
    out = Bld.rollup_manifest(p, Uq.dataset_hashes(spark, sf_dir), Uq.brand_spec(spark, sf_dir), (Uq.START, Uq.END))
    return out.select("symbol", "n_bars", "n_segments", F.coalesce("listing_date", F.lit("")).alias("listing_date"), "dataset_hash")


@query("build_manifest", sql(
    """SELECT sha256(string_agg(h, ';' ORDER BY g)) AS manifest_hash FROM (SELECT ('0x' || substr(md5(symbol), 1, 2))::INT AS g, sha256(string_agg('{"dataset_hash":"' || dataset_hash || '","n_bars":' || n || ',"symbol":"' || symbol || '"}', ';' ORDER BY symbol)) AS h
 FROM (SELECT d.symbol, dataset_hash, n FROM dhash d JOIN (SELECT symbol, count(*) AS n FROM panel GROUP BY 1) c ON c.symbol = d.symbol) GROUP BY 1)""", "dhash", "panel"))
def build_manifest(spark, sf_dir):
    n = V.panel(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars"))
    m = Uq.dataset_hashes(spark, sf_dir).join(n, "symbol").withColumn("built_at", F.current_timestamp())
    return Bld.build_manifest(m)


@query("verify_lake_identity", """SELECT lake, unnest(['n_symbols', 'n_bars', 'every_symbol_present', 'universe_hash']) AS "check", unnest(CASE lake WHEN 'whole' THEN [true, true, true, true] WHEN 'without a symbol' THEN [false, false, false, true]
 WHEN 'without a row' THEN [true, false, true, true] ELSE [true, true, true, false] END) AS holds FROM (SELECT unnest(['whole', 'without a symbol', 'without a row', 'with another hash']) AS lake)""")
def verify_lake_identity(spark, sf_dir):
    """The lake as pinned, and with a symbol lost, a row lost and the hash of one symbol changed."""
    p, h = pin(V.panel(spark, sf_dir)), pin(Uq.dataset_hashes(spark, sf_dir))
    pinned = {"n_symbols": h.count(), "n_bars": p.count(), "universe_hash": H.universe_hash(h).first()[0]}
    one = p.select(F.min(F.struct("symbol", "bar_open_ms")).alias("k")).first()["k"]
    first = F.col("symbol") == one["symbol"]
    cases = {"whole": (p, h), "without a symbol": (p.filter(~first), h), "without a row": (p.filter(~(first & (F.col("bar_open_ms") == one["bar_open_ms"]))), h),
             "with another hash": (p, h.withColumn("dataset_hash", F.when(first, F.reverse("dataset_hash")).otherwise(F.col("dataset_hash"))))}
    out = None
    for name, (lake, manifest) in cases.items():
        part = Bld.verify_lake_identity(lake, manifest, pinned).select(F.lit(name).alias("lake"), "check", "holds")
        out = part if out is None else out.unionByName(part)
    return out


@query("symbol_windows", sql(
    f"SELECT symbol, row_idx FROM (SELECT *, lead(bar_open_ms, 15) OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) AS l FROM panel) WHERE l < {925_000_000_000 - 120 * WEEK} AND seg_pos % 4 = 0", "panel"))
def symbol_windows(spark, sf_dir):
    return Bld.symbol_windows(pin(V.panel(spark, sf_dir)), WCFG, "micro_placebo", 16, 4, 925_000_000_000, 17).select("symbol", "row_idx")


_FB = 1500 * WEEK
_FZ = FQ._decayed("(SELECT *, ret - first(ret) OVER (PARTITION BY symbol, segment_id ORDER BY bar_open_ms) AS g FROM wrets)", "m1", f"{WCFG.alpha(16)!r} * g", 1 - WCFG.alpha(16), False)
_FZ = FQ._decayed(f"({_FZ})", "m2", f"{WCFG.alpha(16)!r} * g * g", 1 - WCFG.alpha(16), False)


@query("frozen_stats", sql(
    f"""SELECT r.symbol, r.bar_open_ms::BIGINT AS bar_open_ms, {rq('greatest(least((r.ret - mu) / sqrt(var + 1e-8), 5.0), -5.0)', 5)} AS z FROM wrets r JOIN (SELECT symbol, arg_max(ret - g + m1, bar_open_ms) AS mu,
 arg_max(greatest(m2 - m1 * m1, 0), bar_open_ms) AS var FROM ({_FZ}) WHERE bar_open_ms < {_FB} GROUP BY 1) s ON s.symbol = r.symbol WHERE r.bar_open_ms >= {_FB}""", "wrets"))
def frozen_stats(spark, sf_dir):
    x = S.with_segments(V.wbars(spark, sf_dir), WCFG, 1).withColumn("ret", X.log_return(WCFG)).filter("_core")
    return Bld.frozen_stats(pin(x), WCFG, {"ret": 16}, _FB).select("symbol", "bar_open_ms", rd("z_ret", 5).alias("z"))


@query("field_dropout", sql(
    "SELECT symbol, bar_open_ms, " + ", ".join(f"{rq(f'''CASE WHEN {u_sql(f'chr(48) || chr(58) || symbol || chr(58) || bar_open_ms || chr(58) || chr(120) || chr(95) || {d}')} < 0.05 THEN 0.0 ELSE x_{d} END''')} AS x_{d}" for d in (5, 6)) + " FROM panel", "panel"))
def field_dropout(spark, sf_dir):
    out = Bld.field_dropout(V.panel(spark, sf_dir))
    return out.select("symbol", "bar_open_ms", rd("x_5").alias("x_5"), rd("x_6").alias("x_6"))


@query("attach_predictions", sql(
    "SELECT d.symbol, d.bar_open_ms, " + rq("m") + " AS mu, " + rq("d.sigma * 2") + " AS sigma_hat FROM decs d JOIN (SELECT symbol, bar_open_ms, avg(raw_ret_close) OVER (PARTITION BY symbol ORDER BY bar_open_ms ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS m "
    "FROM panel) p ON p.symbol = d.symbol AND p.bar_open_ms = d.bar_open_ms", "decs", "panel"))
def attach_predictions(spark, sf_dir):
    lab = Q.labelled(spark, sf_dir)
    out = P.attach_predictions(lab, Q.decisions(lab), P.mean_return, 16, 4, block=64)
    return out.select("symbol", "bar_open_ms", rd("mu").alias("mu"), rd("sigma_hat").alias("sigma_hat"))


cte("reflow", f"""SELECT symbol, bar_open_ms, bar_open_ms // 86400000 AS day, greatest(abs(x_7::REAL::DOUBLE - tfi), abs(x_8::REAL::DOUBLE - sci)) AS gap FROM panel JOIN (SELECT symbol, ts_ms // {WEEK} * {WEEK} AS bar_open_ms,
 sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) / (sum(quantity) + 1e-9) AS tfi, sum(CASE WHEN is_buyer_maker THEN -1 ELSE 1 END) / (count(*) + 1e-9) AS sci FROM wtrades GROUP BY 1, 2)
 USING (symbol, bar_open_ms)""", "panel", "wtrades")


@query("flow_audit", sql(
    "SELECT symbol, day, count(*) AS n, round(max(gap + CASE WHEN symbol < 'Brand#2' THEN 0.01 ELSE 0 END), 4) AS max_diff, max(gap + CASE WHEN symbol < 'Brand#2' THEN 0.01 ELSE 0 END) <= 2e-6 AS passes FROM reflow GROUP BY 1, 2",
    "reflow"))
def flow_audit(spark, sf_dir):
    """Stored order-flow features against an independent recomputation from the ticks; the first brands' are moved away from it."""
    from barloom.operators.quality import flow_audit as audit
    p = V.panel(spark, sf_dir)
    p = Lk.storage_types(p.withColumn("x_7", F.col("x_7") + F.when(F.col("symbol") < "Brand#2", 0.01).otherwise(0.0)))
    return audit(p, V.wtrades(spark, sf_dir), WEEK).select("symbol", "day", "n", F.round("max_diff", 4).alias("max_diff"), "passes")


@query("flow_alignment_audit", sql(
    f"""SELECT count(*) AS n_groups, min(p::INT) AS lags, (SELECT count(DISTINCT (symbol, day)) FROM reflow) AS n_days, (SELECT (max(gap) <= 2e-6)::INT FROM reflow) AS "values" FROM (SELECT symbol, r0 > greatest(r_next, r_prev) + 0.02 AS p FROM (SELECT symbol, count(*) FILTER (WHERE near) AS n_pairs,
 corr(x_5, b) FILTER (WHERE ok) AS r0, corr(pa, b) FILTER (WHERE near) AS r_next, corr(x_5, pb) FILTER (WHERE near) AS r_prev FROM (SELECT *, ok AND lag(ok) OVER w AND bar_open_ms - lag(bar_open_ms) OVER w = {WEEK} AS near,
 lag(x_5) OVER w AS pa, lag(b) OVER w AS pb FROM (SELECT *, x_9 + x_10 AS b, m_5 = 0 AND m_9 = 0 AND m_10 = 0 AS ok FROM panel) WINDOW w AS (PARTITION BY symbol ORDER BY bar_open_ms)) GROUP BY 1) WHERE n_pairs >= 20)""", "panel", "reflow"))
def flow_alignment_audit(spark, sf_dir):
    from barloom.operators.quality import flow_alignment_audit as both
    from barloom.operators.quality import flow_audit as audit
    from barloom.workload.window_queries import lag_correlation
    values = audit(Lk.storage_types(V.panel(spark, sf_dir)), V.wtrades(spark, sf_dir), WEEK)
    return both(lag_correlation(spark, sf_dir), values).select("n_groups", "lags", "n_days", "values")


@query("finite_guard", sql(
    """SELECT unnest(['clean', 'nan', 'infinite', 'null']) AS planted, unnest([false, true, true, true]) AS refused, unnest([count(*), 0, 0, 0]) AS n FROM panel""", "panel"))
def finite_guard(spark, sf_dir):
    """The guard over the panel as it is, and with one bad cell in a column that is not read afterwards."""
    p = pin(V.panel(spark, sf_dir))
    one = p.select(F.min(F.struct("symbol", "bar_open_ms")).alias("k")).first()["k"]
    here = (F.col("symbol") == one["symbol"]) & (F.col("bar_open_ms") == one["bar_open_ms"])
    rows = []
    for name, bad in (("clean", F.col("x_3")), ("nan", F.lit(float("nan"))), ("infinite", F.lit(float("inf"))), ("null", F.lit(None).cast("double"))):
        planted = X.guard_finite(p.withColumn("x_3", F.when(here, bad).otherwise(F.col("x_3"))), [f"x_{d}" for d in range(16)])
        try:
            rows.append((name, False, planted.select("symbol").count()))
        except Exception as e:  # noqa: BLE001
            if "non-finite" not in str(e):
                raise
            rows.append((name, True, 0))
    return spark.createDataFrame(rows, "planted string, refused boolean, n long")


@query("calibration_slice", sql(
    "SELECT symbol, count(*) AS n FROM panel WHERE bar_open_ms >= 928101024000 AND bar_open_ms < 943565760000 GROUP BY 1", "panel"))
def calibration_slice(spark, sf_dir):
    """The last tenth of the train region; its borders are plan-time literals, so the filter reaches the scan."""
    from barloom.operators import universe as U
    lo = 788_918_400_000
    hi = U.calendar_boundary(lo, 1_009_843_200_000)
    cut = U.calibration_boundary(lo, hi)
    return V.panel(spark, sf_dir).filter((F.col("bar_open_ms") >= cut) & (F.col("bar_open_ms") < hi)).groupBy("symbol").agg(F.count("*").alias("n"))


@query("universe_totals", sql("SELECT count(*) AS n_symbols, sum(n)::BIGINT AS total_bars FROM (SELECT symbol, count(*) AS n FROM panel GROUP BY 1)", "panel"))
def universe_totals(spark, sf_dir):
    from barloom.operators import universe as U
    return U.universe_totals(V.panel(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_bars")))
