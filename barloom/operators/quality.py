"""Coverage, quality reports, surface scans and input validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ms_to_date(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def coverage(bars: DataFrame) -> DataFrame:
    """Bars, first and last date and number of segments per symbol in one aggregation."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), ms_to_date(F.min("bar_open_ms")).alias("first_date"),
        ms_to_date(F.max("bar_open_ms")).alias("last_date"), F.countDistinct("segment_id").alias("n_segments"))


def _all_zero(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c) == 0)
    return out


def usable(arm: str = "ohlcv") -> Column:
    """A bar is usable for an arm when every mask bit of the arm is 0."""
    return _all_zero([f"m_{d}" for d in range(7 if arm == "ohlcv" else 13)])


def zero_volume(flags: str = "dq_flags") -> Column:
    return F.floor(F.col(flags) / 16) % 2


def data_quality(bars: DataFrame) -> DataFrame:
    """Coverage plus usable counts, stale and zero-volume percentages per symbol, in one aggregation."""
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.countDistinct("segment_id").alias("n_segments"),
        F.count_if(usable("ohlcv")).alias("usable_ohlcv"), F.count_if(usable("micro")).alias("usable_micro"),
        (F.avg(F.col("is_stale").cast("double")) * 100).alias("stale_pct"),
        (F.avg(zero_volume().cast("double")) * 100).alias("zerovol_pct"))


def quality_flags(report: DataFrame, thin_share: float = 0.5, stale_pct: float = 10.0, micro_ratio: float = 0.7) -> DataFrame:
    """Thin and low-micro candidates against the universe median; the report has one row per symbol."""
    med = report.agg(F.percentile("usable_ohlcv", 0.5)).first()[0] or 0.0
    ratio = F.when(F.col("usable_ohlcv") > 0, F.col("usable_micro") / F.nullif("usable_ohlcv", F.lit(0))).otherwise(0.0)
    return report.withColumns({
        "micro_ratio": ratio,
        "thin": (F.col("usable_ohlcv") < F.lit(thin_share * med)) | (F.col("stale_pct") > stale_pct),
        "low_micro": ratio < micro_ratio})


def quality_totals(bars: DataFrame) -> DataFrame:
    """Per symbol and universe rows from one rollup; the universe row has symbol '*'."""
    return bars.rollup("symbol").agg(
        F.count("*").alias("n_bars"), F.count_if(usable("ohlcv")).alias("usable_ohlcv"),
        F.count_if(usable("micro")).alias("usable_micro")).withColumn("symbol", F.coalesce("symbol", F.lit("*")))


def train_liquidity(bars: DataFrame, boundary_ms: int, lookback_ms: int, step: int) -> DataFrame:
    """Active share over the calendar-common end of the train region and rows before the boundary."""
    lo = boundary_ms - lookback_ms
    active = (F.col("bar_open_ms") >= lo) & (F.col("is_stale") == 0) & (F.col("m_5") == 0)
    out = bars.filter(F.col("bar_open_ms") < boundary_ms).groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.count_if(active).alias("_active"), F.max("bar_open_ms").alias("_max"))
    late = F.raise_error(F.lit("train rows reach the boundary")).cast("double")
    return out.select("symbol", "n_bars", F.when(F.col("_max") >= boundary_ms, late).otherwise(
        F.col("_active") / F.lit(lookback_ms / step)).alias("active_share"))


def micro_density(bars: DataFrame, dims: Sequence[int], floor: int) -> DataFrame:
    """Unmasked bars per dimension: total, smallest symbol, symbols below the floor and symbols with none."""
    per = bars.groupBy("symbol").agg(*[F.count_if(F.col(f"m_{d}") == 0).alias(str(d)) for d in dims])
    long = per.unpivot(["symbol"], [str(d) for d in dims], "dim", "n")
    return long.groupBy(F.col("dim").cast("int").alias("dim")).agg(
        F.sum("n").alias("total"), F.min("n").alias("smallest"), F.count_if(F.col("n") < floor).alias("n_thin"),
        F.count_if(F.col("n") == 0).alias("n_zero"))


def frac_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of the most frequent value per column; values are counted before anything is gathered."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                         for c in columns])).alias("e")).select("e.*")
    counts = long.groupBy("feature", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("frac_constant"))


def _finite(c: Column) -> Column:
    return ~(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))


def nonfinite_scan(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values per column, one pass."""
    sums = bars.agg(*[F.count_if(~_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    return sums.unpivot([], list(columns), "feature", "n_nonfinite")


def surface_stats(bars: DataFrame, dims: Sequence[int]) -> DataFrame:
    """Deviation, non-finite count and mask share per feature, with degenerate flags; one wide aggregate."""
    wide = bars.agg(*[e for d in dims for e in (
        F.stddev_pop(f"x_{d}").alias(f"s{d}"), F.count_if(~_finite(F.col(f"x_{d}").cast("double"))).alias(f"n{d}"),
        F.avg(F.col(f"m_{d}").cast("double")).alias(f"m{d}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(d).alias("dim"), F.col(f"s{d}").alias("stddev"), F.col(f"n{d}").alias("n_nonfinite"),
        F.col(f"m{d}").alias("mask_share")) for d in dims])).alias("e")
    return wide.select(rows).select("e.*").withColumns({
        "x_degenerate": F.coalesce(F.col("stddev") == 0, F.lit(True)),
        "m_degenerate": (F.col("mask_share") == 0) | (F.col("mask_share") == 1)})


def target_surface(bars: DataFrame, warm: int, head: int) -> DataFrame:
    """Valid targets over the whole table and over the first ``head`` rows of each symbol.

    A row has a next row in its segment unless it is the last of the segment, so counts and maxima suffice.
    """
    per = bars.groupBy("symbol", "segment_id").agg(F.max("seg_pos").alias("_last"), F.min("row_idx").alias("_first"))
    valid = F.greatest(F.col("_last") - warm, F.lit(0))
    in_head = F.greatest(F.least(F.col("_last"), head - F.col("_first")) - warm, F.lit(0))
    return per.agg(F.sum(valid).alias("n_valid"), F.sum(in_head).alias("n_valid_head"),
                   F.countDistinct(F.when(in_head > 0, F.col("symbol"))).alias("symbols_with_valid_head"))


def perp_unmasked(bars: DataFrame) -> DataFrame:
    """Rows whose perpetual dimensions are not masked; must be 0."""
    return bars.agg(F.count_if(~((F.col("m_13") == 1) & (F.col("m_14") == 1) & (F.col("m_15") == 1))).alias("n_unmasked"))


def assert_perp_masked(bars: DataFrame) -> DataFrame:
    n = perp_unmasked(bars).first()[0]
    if n:
        raise ValueError(f"{n} rows carry unmasked perpetual features")
    return bars


# ---- fixed values: columns a model may read, and columns kept for quality checks only
MODEL_ALLOWED = [*[f"x_{d}" for d in range(16)], *[f"m_{d}" for d in range(16)], "bar_open_ms", "raw_ret_close", "raw_range"]
QA_COLUMNS = ("is_stale", "dq_flags", "vol_recon_err", "segment_id", "symbol")


def model_columns(df: DataFrame) -> DataFrame:
    """Only the columns a model may read."""
    return df.select(*[c for c in df.columns if c in MODEL_ALLOWED])


def assert_no_qa(columns: Sequence[str]) -> None:
    bad = [c for c in columns if c in QA_COLUMNS or c not in MODEL_ALLOWED]
    if bad:
        raise ValueError(f"columns a model must not read: {bad}")


# ---- user bars -----------------------------------------------------------------------------------------------

def validate_bars(df: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Adds ``reasons``: an array naming what is wrong with a bar, empty for a good one."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    number = F.lit(True)
    for x in (o, h, low, c):
        number = number & F.coalesce(_finite(x), F.lit(False))
    positive = (o > 0) & (h > 0) & (low > 0) & (c > 0)
    bad_shape = (h < low - eps) | (h < F.greatest(o, c) - eps) | (low > F.least(o, c) + eps)
    none = F.lit(None).cast("string")
    return df.withColumn("reasons", F.array_compact(F.array(
        F.when(~number, "not numeric").otherwise(none),
        F.when(number & ~positive, "not positive").otherwise(none),
        F.when(number & positive & bad_shape, "not a bar").otherwise(none))))


def split_bars(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_bars(df)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def reject_report(df: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Rejected rows per key and reason with the first offending line."""
    return (validate_bars(df).select(*keys, line, F.explode("reasons").alias("reason"))
            .groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.min(line).alias("first_line")))


def dedup_by_time(df: DataFrame, keys: Sequence[str], ts: str, line: str) -> DataFrame:
    """First row in file order for each time; a hash aggregate, no sort of the series."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    return (df.groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), F.col(line)).alias("_r"))
            .select(*keys, ts, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def dedup_report(df: DataFrame, keys: Sequence[str], ts: str, min_rows: int = 1232) -> DataFrame:
    """Rows kept and dropped per key, and whether the row floor still holds after dropping."""
    return df.groupBy(*keys).agg(
        F.countDistinct(ts).alias("n_kept"), (F.count("*") - F.countDistinct(ts)).alias("n_dropped")
    ).withColumn("enough", F.col("n_kept") >= min_rows)


def series_warnings(df: DataFrame, keys: Sequence[str], interval: DataFrame | None = None, step: int = 60_000) -> DataFrame:
    """What a reader of a forecast must know about the input series."""
    agg = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("close").alias("_lo"), F.max("close").alias("_hi"),
        F.countDistinct("close").alias("n_distinct"), F.count_if(F.col("volume").isNull()).alias("_no_volume"),
        F.max("volume").alias("_max_volume"))
    if interval is not None:
        agg = agg.join(interval, list(keys), "left")
    else:
        agg = agg.withColumn("interval_ms", F.lit(float(step)))
    none = F.lit(None).cast("string")
    return agg.select(*keys, "n", "n_distinct", (F.col("_lo") == F.col("_hi")).alias("refused"), F.array_compact(F.array(
        F.when(F.col("n_distinct") < F.greatest(F.lit(10), F.floor(F.col("n") / 500)), "near constant").otherwise(none),
        F.when(F.col("_no_volume") == F.col("n"), "no volume").when(F.col("_no_volume") > 0, "unparsable volume")
        .when(F.col("_max_volume") == 0, "zero volume").otherwise(none),
        F.when(F.col("interval_ms") != step, "interval").otherwise(none))).alias("warnings"))


def infer_interval(df: DataFrame, tl) -> DataFrame:
    """Median difference of consecutive times per key.

    The previous time crosses chunk edges through the chunk table, and the median comes from exact value ranks.
    """
    from barloom.frames import CHUNK, before, carry, exact_quantiles, with_chunks

    base = with_chunks(df.select(*tl.keys, tl.ts), tl)
    prior = carry(base, tl, {"_t": F.max(tl.ts)}, {"_p": F.max("_t").over(before(tl))})
    w = tl.by_chunk()
    diffs = base.withColumn("_l", F.lag(tl.ts).over(w)).join(prior, tl.on_chunk).select(
        *tl.keys, (F.col(tl.ts) - F.coalesce("_l", "_p")).cast("double").alias("_d")).filter("_d is not null")
    return exact_quantiles(diffs, list(tl.keys), "_d", {"interval_ms": 0.5})




def flow_audit(lake: DataFrame, trades: DataFrame, step: int, limit: float = 2e-6) -> DataFrame:
    """Largest difference of stored flow features (x_7, x_8) from their recomputation out of ticks, per symbol and day."""
    sign = F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)
    again = trades.groupBy("symbol", (F.floor(F.col("ts_ms") / step) * step).alias("bar_open_ms")).agg(
        (F.sum(sign * F.col("quantity")) / (F.sum("quantity") + 1e-9)).alias("_tfi"), (F.sum(sign) / (F.count("*") + 1e-9)).alias("_sci"))
    j = lake.select("symbol", "bar_open_ms", "x_7", "x_8").join(again, ["symbol", "bar_open_ms"])
    gap = F.greatest(F.abs(F.col("x_7") - F.col("_tfi")), F.abs(F.col("x_8") - F.col("_sci")))
    day = F.floor(F.col("bar_open_ms") / 86_400_000).alias("day")
    return j.groupBy("symbol", day).agg(F.count("*").alias("n"), F.max(gap).alias("max_diff")).withColumn("passes", F.col("max_diff") <= limit)


def flow_alignment_audit(correlations: DataFrame, differences: DataFrame, least_groups: int = 20, least_days: int = 3) -> DataFrame:
    """Both legs: enough groups whose aligned lag wins everywhere, enough days whose recomputation agrees."""
    a = correlations.agg(F.count("*").alias("n_groups"), F.coalesce(F.min(F.col("passes").cast("int")), F.lit(0)).alias("lags"))
    b = differences.agg(F.count("*").alias("n_days"), F.coalesce(F.min(F.col("passes").cast("int")), F.lit(0)).alias("values"))
    x = a.withColumn("_j", F.lit(0)).join(b.withColumn("_j", F.lit(0)), "_j").drop("_j")
    return x.withColumn("passes", (F.col("n_groups") >= least_groups) & (F.col("lags") == 1) & (F.col("n_days") >= least_days) & (F.col("values") == 1))
