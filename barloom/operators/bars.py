"""Ticks to bars: flow reduction, kline building, joins of trades and irregular events onto the bar spine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import BAR_MS, EPS_SZ
from barloom.frames import Timeline, last_known
from barloom.session import pin


def bar_open(ts: str | Column, step: int = BAR_MS) -> Column:
    """Open time of the bar holding a millisecond timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(step).cast("bigint"))


def bar_id(ts: str | Column, step: int = BAR_MS) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / step)


def sort_key(first: str, *rest: tuple[str, int]) -> Column:
    """Integer columns packed into one decimal, most significant first, each with its number of digits.

    Aggregation buffers of fixed width keep a hash aggregate with map-side combine; ordering by a struct would force
    Spark to sort all ticks before it can reduce any.
    """
    wide = "decimal(38,0)"
    key = F.col(first).cast(wide)
    for name, digits in rest:
        key = (key * F.lit(str(10**digits)).cast(wide) + F.col(name).cast(wide)).cast(wide)
    return key


def _flow() -> list[Column]:
    buy, q, zero = ~F.col("is_buyer_maker"), F.col("quantity"), F.lit(0.0)
    return [
        F.sum(F.when(buy, q).otherwise(zero)).alias("v_buy"), F.sum(F.when(buy, zero).otherwise(q)).alias("v_sell"),
        F.count_if(buy).alias("n_buy"), F.count_if(~buy).alias("n_sell"), F.sum(q).alias("v_agg"), F.count("*").alias("n_trades"),
        F.avg(q).alias("size_mean"), F.stddev_pop(q).alias("size_std"),
    ]


def _ohlcv(key: Column | None) -> list[Column]:
    key = sort_key("ts_ms", ("trade_id", 19)) if key is None else key
    return [
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
        F.sum("quantity").alias("v_kline"), F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"),
    ]


def reduce_trades(trades: DataFrame, step: int = BAR_MS) -> DataFrame:
    """Order flow per (symbol, bar). All outputs are partial aggregates: no trade list is built."""
    return trades.groupBy("symbol", bar_open("ts_ms", step).alias("bar_open_ms")).agg(*_flow())


def klines_from_trades(trades: DataFrame, step: int = BAR_MS, key: Column | None = None) -> DataFrame:
    """OHLCV bars from ticks; ``key`` orders ticks without ties, (time, trade id) by default."""
    return trades.groupBy("symbol", bar_open("ts_ms", step).alias("bar_open_ms")).agg(*_ohlcv(key))


def bars_from_trades(trades: DataFrame, step: int = BAR_MS, key: Column | None = None) -> DataFrame:
    """OHLCV and order flow of one tape in a single pass, for when both come from the same ticks."""
    return trades.groupBy("symbol", bar_open("ts_ms", step).alias("bar_open_ms")).agg(*_ohlcv(key), *_flow())


FLOW_ZERO = {"v_buy": 0.0, "v_sell": 0.0, "n_buy": 0, "n_sell": 0, "v_agg": 0.0, "n_trades": 0,
             "size_mean": 0.0, "size_std": 0.0}


def attach_trades(klines: DataFrame, flow: DataFrame) -> DataFrame:
    """Left join of the reduced trades on the bar spine; bars without trades carry zeros."""
    return klines.join(flow, ["symbol", "bar_open_ms"], "left").na.fill(FLOW_ZERO)


def size_samples(trades: DataFrame, step: int = BAR_MS, cap: int = 64) -> DataFrame:
    """Per bar at most ``cap`` evenly spaced order statistics of its trade sizes, as an ascending array.

    Equal sizes are merged before the shuffle, so a bar with very many trades travels as its distinct sizes.
    """
    w = Window.partitionBy("symbol", "bar_open_ms").orderBy("quantity")
    steps = (trades.groupBy("symbol", bar_open("ts_ms", step).alias("bar_open_ms"), "quantity")
             .agg(F.count("*").alias("n"))
             .withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("m", F.sum("n").over(Window.partitionBy("symbol", "bar_open_ms"))))
    picks = F.when(F.col("m") <= cap, F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).otherwise(
        evenly_spaced(F.col("m"), cap))
    below = F.col("upto") - F.col("n")
    hits = F.size(F.filter(picks, lambda i: (i >= below) & (i < F.col("upto"))))
    return (steps.withColumn("hits", hits).filter("hits > 0")
            .groupBy("symbol", "bar_open_ms")
            .agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("quantity", F.col("hits"))))).alias("sample")))


def evenly_spaced(m: Column, n: int) -> Column:
    """Indices of ``n`` evenly spaced positions in 0..m-1, halves rounded to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.bround(i * (m - 1) / F.lit(float(max(n - 1, 1)))).cast("bigint"))


def pick_evenly(values: Column, n: int) -> Column:
    """Evenly spaced order statistics of an array; arrays no longer than ``n`` come back sorted and whole."""
    ordered = F.sort_array(values)
    return F.when(F.size(values) <= n, ordered).otherwise(
        F.transform(evenly_spaced(F.size(values), n), lambda i: F.element_at(ordered, (i + 1).cast("int"))))


def asof_marks(bars: DataFrame, marks: Mapping[str, DataFrame], tl: Timeline) -> DataFrame:
    """Bars with the last mark of every series at or before their close, plus a ``<name>_missing`` flag per series.

    ``marks`` holds (symbol, ts_ms, value) per name and may carry ``seq``, their order of arrival: of marks with one time the last
    to arrive wins, without ``seq`` the largest. NULL values are no marks. Where bars carry ``is_perp``, symbols
    without a perpetual get 0 and the missing flag.

    Bars and all series are one time-ordered union, forward filled once per (symbol, chunk) with the state of earlier chunks
    carried in: no side is joined by range, a busy symbol is spread over its chunks, and bars are not joined back to
    themselves.
    """
    names = list(marks)
    value = lambda n, of=None: F.lit(None).cast("double").alias(n) if of is None else of.cast("double").alias(n)
    rows = bars.select(*tl.keys, (F.col(tl.ts) + tl.step).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"), value("_tie"),
                       *[value(n) for n in names], F.struct(*[F.col(f"`{c}`") for c in bars.columns]).alias("_bar"))
    for n, df in marks.items():
        seq = F.col("seq").cast("bigint") if "seq" in df.columns else F.lit(0).cast("bigint")
        rows = rows.unionByName(df.filter("value is not null").select(
            *tl.keys, F.col("ts_ms").alias("_t"), F.lit(0).alias("_kind"), seq.alias("_seq"), value("_tie", F.col("value")),
            *[value(m, F.col("value") if m == n else None) for m in names], F.lit(None).cast(rows.schema["_bar"].dataType).alias("_bar")))
    filled = last_known(pin(rows), Timeline(tl.keys, "_t", tl.step, tl.chunk), ["_t", "_kind", "_seq", "_tie"], names).filter("_kind = 1")
    known = {n: F.col(n).isNotNull() & F.coalesce(F.col("_bar.is_perp"), F.lit(False)) if "is_perp" in bars.columns else F.col(n).isNotNull() for n in names}
    kept = [F.col(f"_bar.`{c}`") for c in bars.columns if c not in {*names, *(f"{n}_missing" for n in names)}]
    return filled.select(*kept, *[F.when(known[n], F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in names],
                         *[F.when(known[n], 0).otherwise(1).alias(f"{n}_missing") for n in names])


def asof_ffill(bars: DataFrame, events: DataFrame, name: str, tl: Timeline) -> DataFrame:
    """``asof_marks`` of one series."""
    return asof_marks(bars, {name: events}, tl)


def ohlcv_only(klines: DataFrame) -> DataFrame:
    """Bars without a trade tape: flow fields are zero, volume NaN becomes 0, no perpetual."""
    zeros = {k: F.lit(v) if isinstance(v, float) else F.lit(v).cast("bigint") for k, v in FLOW_ZERO.items()}
    return (klines.withColumn("v_kline", F.coalesce(F.nanvl("v_kline", F.lit(0.0)), F.lit(0.0)))
            .withColumns(zeros).withColumn("is_perp", F.lit(False)))


def vol_recon_err(v_agg: str = "v_agg", v_kline: str = "v_kline") -> Column:
    return F.abs(F.col(v_agg) - F.col(v_kline)) / (F.col(v_kline) + EPS_SZ)


def concat_streams(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_violations(df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "bar_open_ms") -> DataFrame:
    """Keys with repeated times. Stitched parts must not overlap, and a set of distinct times is strictly
    increasing once ordered, so one aggregate replaces the ordered comparison."""
    return (df.groupBy(*keys, ts).agg(F.count("*").alias("n")).filter("n > 1")
            .groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("n_repeated"), F.min(ts).alias("first_repeated")))


def assert_strictly_increasing(df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "bar_open_ms") -> DataFrame:
    bad = order_violations(df, keys, ts).first()
    if bad is not None:
        raise ValueError(f"times repeat: {bad.asDict()}")
    return df
