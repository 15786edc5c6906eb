"""Universe selection, listings, active windows, plans, shards, ledgers and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import BAR_MS, MAJORS, SPREADS, TOP_TIER
from barloom.frames import global_rank
from barloom.functions.scalars import date_to_ms, month_index, months_between, ms_to_date, shift_month
from barloom.session import pin

# ---- fixed values: size anchors in MB per month, reduction speed in MB per core second ------------------
KLINE_MB = 1.8
TICK_MB = {"major": 400.0, "top20": 70.0, "mid": 22.0, "tail": 9.0}
REDUCE_MB_PER_CORE_SEC = 16.8
BARS_PER_MONTH = 44_640
BYTES_PER_BAR = 88.0
TOP20_SAMPLE = ("SOLUSDT", "BNBUSDT", "XRPUSDT", "DOGEUSDT", "ADAUSDT")
LISTING_PATTERN = r"([A-Z0-9]+)/\1-aggTrades-(\d{4}-\d{2})\.zip$"


# ---- listings ----------------------------------------------------------------------------------------------

def scan_listing(listing: DataFrame) -> DataFrame:
    """(key, size) rows -> one row per (symbol, month) with its bytes; other keys are ignored."""
    found = listing.select(F.regexp_extract("key", LISTING_PATTERN, 1).alias("symbol"),
                           F.regexp_extract("key", LISTING_PATTERN, 2).alias("month"), "size").filter("symbol <> ''")
    return found.groupBy("symbol", "month").agg(F.sum("size").alias("bytes"))


def listing_index(months: DataFrame) -> DataFrame:
    """Sorted months (bounded by the calendar) and total bytes per symbol."""
    return months.groupBy("symbol").agg(F.sort_array(F.collect_set("month")).alias("months"),
                                        F.sum("bytes").alias("total_bytes"))


def derive_listing(months: DataFrame, lag_months: int = 1) -> DataFrame:
    """Listing = first month; delisting = month after the last one unless the symbol only trails by the lag."""
    span = months.groupBy("symbol").agg(F.min("month").alias("_first"), F.max("month").alias("_last"))
    latest = months.agg(F.max("month")).first()[0]
    live = month_index("_last") >= month_index(F.lit(latest)) - max(0, lag_months)
    return span.select("symbol", F.concat("_first", F.lit("-01")).alias("listing_date"),
                       F.when(~live, F.concat(shift_month("_last", 1), F.lit("-01"))).alias("delisting_date"))


# ---- active windows --------------------------------------------------------------------------------------------

def active_window(spec: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """Half-open live span inside the window; no listing means always listed, no delisting never delisted."""
    lo, hi = date_to_ms(F.lit(window_start)), date_to_ms(F.lit(window_end))
    out = spec.withColumns({
        "lo_ms": F.greatest(F.coalesce(date_to_ms("listing_date"), lo), lo),
        "hi_ms": F.least(F.coalesce(date_to_ms("delisting_date"), hi), hi)})
    return out.withColumn("is_live", F.col("hi_ms") > F.col("lo_ms"))


def active_months(spec: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """(symbol, month) rows of the live span."""
    live = active_window(spec, window_start, window_end).filter("is_live")
    whole = F.ceil(F.col("hi_ms") / BAR_MS) * BAR_MS
    return live.select("symbol", F.explode(months_between(ms_to_date("lo_ms"), ms_to_date(whole))).alias("month"))


def slice_active(bars: DataFrame, spec: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """Bars inside the live span with the truncation flags of their symbol."""
    spans = active_window(spec, window_start, window_end)
    lo, hi = date_to_ms(F.lit(window_start)), date_to_ms(F.lit(window_end))
    spans = spans.select("symbol", "lo_ms", "hi_ms", (F.col("lo_ms") > lo).alias("head_truncated"),
                         (F.col("hi_ms") < hi).alias("tail_truncated"))
    return bars.join(spans, "symbol").filter(
        (F.col("bar_open_ms") >= F.col("lo_ms")) & (F.col("bar_open_ms") < F.col("hi_ms"))).drop("lo_ms", "hi_ms")


def slice_events(events: DataFrame, kept: DataFrame, spec: DataFrame, window_start: str, window_end: str,
                 step: int = BAR_MS) -> DataFrame:
    """Events from the start of the live span to the close of the symbol's last kept bar."""
    ends = kept.groupBy("symbol").agg((F.max("bar_open_ms") + step).alias("_end"))
    spans = active_window(spec, window_start, window_end).select("symbol", "lo_ms").join(ends, "symbol")
    return events.join(spans, "symbol").filter(
        (F.col("ts_ms") >= F.col("lo_ms")) & (F.col("ts_ms") <= F.col("_end"))).drop("lo_ms", "_end")


def assert_all_live(kept: DataFrame, spec: DataFrame) -> DataFrame:
    lost = spec.select("symbol").join(kept.select("symbol"), "symbol", "left_anti").first()
    if lost is not None:
        raise ValueError(f"no live bars for {lost[0]}")
    return kept


# ---- selection ------------------------------------------------------------------------------------------------

def rank_by_volume(volumes: DataFrame, top_n: int) -> DataFrame:
    return volumes.orderBy(F.col("volume").desc(), "symbol").limit(max(0, top_n))


def bootstrap_universe(volumes: DataFrame, spec: DataFrame, window_start: str, window_end: str, top_n: int,
                       include_delisted: bool = True) -> DataFrame:
    """Largest live symbols with metadata."""
    known = active_window(spec, window_start, window_end).filter("is_live")
    if not include_delisted:
        known = known.filter(F.col("delisting_date").isNull())
    return rank_by_volume(volumes.join(known, "symbol"), top_n)


def bootstrap_from_index(months: DataFrame, window_start: str, window_end: str, top_n: int, quote: str = "USDT",
                         min_live_days: int = 30, include_delisted: bool = True, lag_months: int = 1) -> DataFrame:
    """Selection straight from a listing: quote suffix, live span, enough months, largest estimated bytes."""
    spec = active_window(derive_listing(months, lag_months), window_start, window_end).filter("is_live")
    if not include_delisted:
        spec = spec.filter(F.col("delisting_date").isNull())
    window = F.array_contains(months_between(F.lit(window_start), F.lit(window_end)), F.col("month"))
    sized = months.filter(F.col("symbol").endswith(quote)).groupBy("symbol").agg(
        F.sum("bytes").alias("_bytes"), F.count("*").alias("_all"), F.count_if(window).alias("n_months"))
    chosen = sized.join(spec, "symbol").filter(F.col("n_months") >= max(1, min_live_days // 30)).withColumn(
        "est_bytes", F.floor(F.col("_bytes") * F.col("n_months") / F.col("_all")))
    return chosen.select("symbol", "listing_date", "delisting_date", "n_months", "est_bytes").orderBy(
        F.col("est_bytes").desc(), "symbol").limit(top_n)


def assign_spread_tiers(stats: DataFrame, majors: Sequence[str] = MAJORS, top: int = TOP_TIER) -> DataFrame:
    """Majors by name, then the most liquid symbols, then the tail; adds the spread fraction."""
    named = F.col("symbol").isin(*majors)
    n_major = stats.filter(named).count()
    rest = stats.filter(~named).withColumns({"_p": -F.col("active_share"), "_b": -F.col("n_bars")})
    ranked = global_rank(rest, "_p", ["_b", "symbol"], rank="_rank").drop("_p", "_b")
    tiers = ranked.withColumn("tier", F.when(F.col("_rank") <= max(0, top - n_major), "top20").otherwise("tail")).drop("_rank")
    out = tiers.unionByName(stats.filter(named).withColumn("tier", F.lit("major")))
    return out.withColumn("spread", spread_of("tier"))


def spread_of(tier: str) -> Column:
    out = F.when(F.col(tier) == "major", SPREADS["major"])
    for name in ("top20", "tail"):
        out = out.when(F.col(tier) == name, SPREADS[name])
    return out


def select_subset(sized: DataFrame, budget: float, max_symbols: int | None = None, delisted: bool = True) -> DataFrame:
    """Smallest symbols first while the running size fits; with ``delisted`` one delisted symbol is guaranteed.

    The running sum is monotone, so the prefix is a filter on it. The first symbol is always kept.
    """
    ranked = pin(global_rank(sized, "size", ["symbol"], weight="size"))
    keep = (F.col("running") <= budget) | (F.col("rank") == 1)
    if max_symbols:
        keep = keep & (F.col("rank") <= max_symbols)
    chosen = ranked.filter(keep)
    if not delisted:
        return chosen.select(*sized.columns)
    state = chosen.agg(F.max("rank"), F.count_if(F.col("delisting_date").isNotNull())).first()
    if state[1] == 0:
        spare = ranked.filter(F.col("delisting_date").isNotNull()).orderBy("rank").limit(1)
        if spare.first() is not None:
            chosen = chosen.filter(F.col("rank") < state[0]).unionByName(spare)
    return chosen.select(*sized.columns)


def top_symbols_by_count(bars: DataFrame, n: int) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars")).orderBy(F.col("n_bars").desc(), "symbol").limit(n)


# ---- plans, shards, ledger ----------------------------------------------------------------------------------------

def volume_tier(symbol: str = "symbol") -> Column:
    s = F.col(symbol)
    return F.when(s.isin(*MAJORS), "major").when(s.isin(*TOP20_SAMPLE), "top20").otherwise("mid")


def tick_mb(tier: Column) -> Column:
    out = F.when(tier == "major", TICK_MB["major"])
    for name in ("top20", "mid", "tail"):
        out = out.when(tier == name, TICK_MB[name])
    return out


def ingest_plan(spec: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """(symbol, month, stream) items with estimated bytes."""
    months = active_months(spec, window_start, window_end)
    items = months.withColumn("stream", F.explode(F.array(F.lit("klines"), F.lit("aggTrades"))))
    size = F.when(F.col("stream") == "klines", KLINE_MB * 1e6).otherwise(tick_mb(volume_tier()) * 1e6)
    return items.withColumn("est_bytes", size.cast("bigint"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("stream").agg(F.count("*").alias("n_files"), (F.sum("est_bytes") / 1e9).alias("gb"))


def perp_lists(spec: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """Symbols that need funding, and those whose open interest is masked for lack of history."""
    live = active_window(spec, window_start, window_end).filter("is_live and perp_available")
    return live.select("symbol", F.lit(True).alias("fetch_funding"), F.col("oi_coverage_start").isNull().alias("oi_masked"))


def estimate_cost(tiers: DataFrame, months_per_symbol: float) -> DataFrame:
    """Sizes and core hours of a universe from one row per symbol with its tier."""
    per = tiers.agg(F.count("*").alias("n_symbols"), F.sum(tick_mb(F.col("tier"))).alias("_mb"))
    m, n = F.lit(months_per_symbol), F.col("n_symbols")
    agg_gb = F.col("_mb") * m / 1e3
    return per.select("n_symbols", (agg_gb + n * m * KLINE_MB / 1e3).alias("download_gb"),
                      (n * m * BARS_PER_MONTH).alias("total_bars"),
                      (n * m * BARS_PER_MONTH * BYTES_PER_BAR / 1e9).alias("lake_gb"),
                      (agg_gb * 1e3 / REDUCE_MB_PER_CORE_SEC / 3600).alias("core_hours"))


def universe_totals(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count("*").alias("n_symbols"), F.sum("n_bars").alias("total_bars"))


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count("*").alias("n_symbols"))


def shard_plan(units: DataFrame, n_shards: int, order: str, ties: Sequence[str]) -> DataFrame:
    """Strided shards over the sorted units."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    return global_rank(units, order, ties).withColumn("shard", (F.col("rank") - 1) % n_shards).drop("rank")


def exact_cover(units: DataFrame, shards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units not covered exactly once, with the number of shards that hold them; empty means an exact cover."""
    want = units.select(*keys).distinct().withColumn("_want", F.lit(1))
    have = shards.groupBy(*keys).agg(F.count("*").alias("n"))
    return want.join(have, list(keys), "full_outer").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("_want").isNotNull().alias("planned")
    ).filter("n <> 1 or not planned")


def pending(plan: DataFrame, ledger: DataFrame, keys: Sequence[str], state: str = "lake_built") -> DataFrame:
    """Planned units without a commit marker in the append-only ledger."""
    return plan.join(ledger.filter(F.col("event") == state).select(*keys).distinct(), list(keys), "left_anti")


def key_set_diff(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and extra keys."""
    a, b = expected.select(*keys).distinct(), present.select(*keys).distinct()
    return a.exceptAll(b).withColumn("status", F.lit("missing")).unionByName(
        b.exceptAll(a).withColumn("status", F.lit("extra")))


def plan_existing(plan: DataFrame, dumps: DataFrame, keys: Sequence[str] = ("symbol", "month")) -> DataFrame:
    """Only months that exist are planned."""
    return plan.join(dumps.select(*keys).distinct(), list(keys), "left_semi")


def months_in_window(months: DataFrame, window_start: str, window_end: str) -> DataFrame:
    window = months.sparkSession.range(1).select(
        F.explode(months_between(F.lit(window_start), F.lit(window_end))).alias("month"))
    return months.select("month").intersect(window)


def manifest_rows(built: DataFrame, spec: DataFrame, coverage: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """Built symbols with their spec and coverage; truncated means bounded by the symbol's own life."""
    lo, hi = date_to_ms(F.lit(window_start)), date_to_ms(F.lit(window_end))
    out = built.join(spec, "symbol", "left").join(coverage, "symbol", "left")
    return out.withColumns({
        "head_truncated": F.coalesce(date_to_ms("listing_date") > lo, F.lit(False)),
        "tail_truncated": F.coalesce(date_to_ms("delisting_date") < hi, F.lit(False)),
        "n_bars": F.coalesce("n_bars", F.lit(0))})


# ---- folds and boundaries: literals computed from the configuration -------------------------------------------

def calendar_boundary(lo_ms: int, hi_ms: int, share: float = 0.7) -> int:
    return int(lo_ms + share * (hi_ms - lo_ms))


def eval_blocks(lo_ms: int, hi_ms: int, k: int = 6, share: float = 0.7) -> list[tuple[int, int]]:
    b = calendar_boundary(lo_ms, hi_ms, share)
    edges = [b + (hi_ms - b) * i // k for i in range(k)] + [hi_ms]
    return list(zip(edges[:-1], edges[1:]))


def calibration_boundary(lo_ms: int, hi_ms: int, share: float = 0.10) -> int:
    """Start of the last tenth of the train region."""
    if not 0 < share < 1 or hi_ms <= lo_ms:
        raise ValueError("need 0 < share < 1 and a non-empty train region")
    return int(hi_ms - int((hi_ms - lo_ms) * share))


def calendar_block(ts: str, lo_ms: int, hi_ms: int, k: int = 6) -> Column:
    """-1 before the boundary, else the block holding the time; pure arithmetic on literals."""
    out = F.lit(-1)
    for i, (start, _) in enumerate(eval_blocks(lo_ms, hi_ms, k)):
        out = F.when(F.col(ts) >= start, i).otherwise(out)
    return out


def quadrant(in_symbols: Column, in_time: Column) -> Column:
    return (F.when(in_symbols & in_time, "Q1").when(in_symbols, "Q2").when(in_time, "Q3").otherwise("Q4"))


def fold_plan(df: DataFrame, n: str, index: str = "row_idx", share: float = 0.7, k: int = 6, purge: int = 60,
              embargo: int = 120) -> DataFrame:
    """Block of each row, and whether it is a legal train row under purge and embargo."""
    t, total = F.col(index), F.col(n)
    train_end = F.floor(total * F.lit(share))
    span = total - train_end
    block = F.lit(0)
    for i in range(1, k):
        block = F.when(t >= train_end + F.floor(span * i / k), i).otherwise(block)
    return df.withColumns({
        "block": F.when(t < train_end, -1).otherwise(block),
        "purged_train": t + purge < train_end, "embargoed_train": t < train_end - embargo})


def train_bar_counts(bars: DataFrame, split_ms: int) -> DataFrame:
    return bars.filter(F.col("bar_open_ms") < split_ms).groupBy("symbol").agg(F.count("*").alias("n_train"))


def assemble_window(bars: DataFrame, symbol: str, lo_ms: int, hi_ms: int) -> DataFrame:
    """Model columns of one symbol in a half-open range, in time order."""
    keep = [c for c in bars.columns if c.startswith(("x_", "m_"))]
    return (bars.filter((F.col("symbol") == symbol) & (F.col("bar_open_ms") >= lo_ms) & (F.col("bar_open_ms") < hi_ms))
            .select("bar_open_ms", "segment_id", *keep).orderBy("bar_open_ms"))


def tail_rows(bars: DataFrame, boundary_ms: int, tail: int | None) -> DataFrame:
    """Rows from ``tail`` rows before the boundary on; all rows when ``tail`` is None."""
    if tail is None:
        return bars
    first = bars.groupBy("symbol").agg(
        F.greatest(F.count_if(F.col("bar_open_ms") < boundary_ms) - tail, F.lit(0)).alias("_lo"))
    return bars.join(first, "symbol").filter(F.col("row_idx") >= F.col("_lo")).drop("_lo")


def select_arm(df: DataFrame, arm: str, keep: Sequence[str] = ("symbol", "bar_open_ms")) -> DataFrame:
    """``ohlcv`` keeps dimensions 0-6, every micro arm all sixteen."""
    dims = range(7) if arm == "ohlcv" else range(16)
    return df.select(*keep, *[f"x_{d}" for d in dims], *[f"m_{d}" for d in dims])


def constant_micro(df: DataFrame) -> DataFrame:
    return df.withColumns({f"x_{d}": F.lit(0.0) for d in range(7, 13)})
