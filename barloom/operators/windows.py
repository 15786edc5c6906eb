"""Window operators over a stored feature table: (symbol, bar_open_ms, segment_id, seg_pos, row_idx, ...)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import EMBARGO_BARS
from barloom.frames import CHUNK, CORE, LSEG, Timeline, average_ranks, dealt_groups, last_known, row_halo, running_sums, whole_groups, with_halo
from barloom.session import pin


def framed(df: DataFrame, tl: Timeline, back: int = 0, ahead: int = 0) -> DataFrame:
    """Chunk frame whose local segments are the stored ones."""
    return with_halo(df, tl, back, ahead).withColumn(LSEG, F.col("segment_id"))


def done(df: DataFrame) -> DataFrame:
    return df.filter(CORE).drop(CHUNK, CORE, LSEG)


# ---- forward returns ------------------------------------------------------------------------------------

def forward_returns(df: DataFrame, tl: Timeline, h: int, ret: str = "raw_ret_close", out: str = "y",
                    rule: str = "eval") -> DataFrame:
    """Return from the next bar to h bars ahead inside the segment, NULL where it does not exist.

    ``eval``: sum of returns 2..h; a segment of h+1 or fewer rows has none. ``screen``: the next return for h=1,
    otherwise the same sum without that exception. ``period``: returns 1..h, never from the first row of a symbol.
    """
    w = tl.by_segment()
    x = framed(df, tl, 0, h + 1)
    reach = F.lead(F.lit(1), h).over(w).isNotNull()
    span = lambda lo: F.coalesce(F.sum(ret).over(w.rowsBetween(lo, max(h, lo))), F.lit(0.0))
    if rule == "eval":
        value = span(2) if h >= 2 else F.lit(0.0)
        ok = reach & ((F.col("seg_pos") > 0) | F.lead(F.lit(1), h + 1).over(w).isNotNull())
    elif rule == "screen":
        value, ok = (span(2) if h >= 2 else F.lead(ret, 1).over(w)), reach
    else:
        value, ok = span(1), reach & (F.col("row_idx") > 0)
    return done(x.withColumn(out, F.when(ok, value)))


def expanding_sigma(df: DataFrame, tl: Timeline, sigma: str = "sigma", out: str = "sigma_bar") -> DataFrame:
    """Mean of sigma over all rows of the symbol up to the current one."""
    sums = running_sums(df, tl, {"_ss": F.col(sigma), "_sn": F.lit(1)})
    return sums.withColumn(out, F.col("_ss") / F.col("_sn")).drop("_ss", "_sn")


# ---- training windows -------------------------------------------------------------------------------------

def window_starts(df: DataFrame, tl: Timeline, length: int, stride: int = 1) -> DataFrame:
    """Rows that start a window of ``length`` rows inside their segment, every ``stride`` rows from its start."""
    if stride > length:
        raise ValueError("stride must not exceed the window length")
    x = framed(df, tl, 0, length - 1)
    last = F.lead(tl.ts, length - 1).over(tl.by_segment()) if length > 1 else F.col(tl.ts)
    return done(x.withColumn("last_ts", last)).filter(
        F.col("last_ts").isNotNull() & (F.col("seg_pos") % stride == 0))


def fold_valid_starts(df: DataFrame, tl: Timeline, length: int, stride: int, boundary_ms: int) -> DataFrame:
    return window_starts(df, tl, length, stride).filter(
        F.col("last_ts") < boundary_ms - EMBARGO_BARS * tl.step)


def chunk_ranges(df: DataFrame, window: int) -> DataFrame:
    """Non-overlapping ranges of at most ``window`` rows inside a segment."""
    return df.withColumn("part", F.floor(F.col("seg_pos") / window)).groupBy("symbol", "segment_id", "part").agg(
        F.min("row_idx").alias("start_idx"), (F.max("row_idx") + 1).alias("end_idx"))


# ---- runs ----------------------------------------------------------------------------------------------------

def longest_run(df: DataFrame, tl: Timeline, hit: Column) -> DataFrame:
    """Longest stretch of consecutive hits per (symbol, segment), with the number of hits."""
    x = df.select(*tl.keys, tl.ts, "segment_id", "row_idx", hit.alias("_hit"))
    x = x.withColumn("_miss", F.when(~F.col("_hit"), F.col("row_idx")))
    x = last_known(x, tl, [tl.ts], ["_miss"]).filter("_hit")
    runs = x.groupBy(*tl.keys, "segment_id", F.coalesce("_miss", F.lit(-1)).alias("_miss")).agg(F.count("*").alias("n"))
    return runs.groupBy(*tl.keys, "segment_id").agg(F.max("n").alias("longest_run"), F.sum("n").alias("n_hits"))


def trailing_run(df: DataFrame, hit: Column) -> DataFrame:
    """Rows after the last non-hit of each segment; a plain aggregate over row numbers."""
    per = df.groupBy("symbol", "segment_id").agg(
        F.max(F.when(~hit, F.col("row_idx"))).alias("_miss"), F.max("row_idx").alias("_last"),
        F.min("row_idx").alias("_first"), F.count("*").alias("seg_len"))
    trail = F.col("_last") - F.coalesce(F.col("_miss"), F.col("_first") - 1)
    return per.select("symbol", "segment_id", trail.alias("trailing"), "seg_len").filter("trailing > 0")


# ---- lagged statistics -----------------------------------------------------------------------------------------

def lag_correlation(df: DataFrame, tl: Timeline, a: str, b: str, usable: Column, group: Sequence[str],
                    margin: float = 0.02, least: int = 20) -> DataFrame:
    """corr(a, b) at lags 0 and +-1 over adjacent usable bars; the aligned lag must win by ``margin``."""
    x = with_halo(df.withColumn("_ok", usable), tl, 1, 0)
    w = tl.by_chunk()
    near = F.col("_ok") & F.lag("_ok").over(w) & (F.col(tl.ts) - F.lag(tl.ts).over(w) == tl.step)
    x = x.withColumns({"_near": F.coalesce(near, F.lit(False)), "_pa": F.lag(a).over(w), "_pb": F.lag(b).over(w)})
    x = x.filter(CORE)
    out = x.groupBy(*group).agg(
        F.count_if("_near").alias("n_pairs"),
        F.corr(F.when(F.col("_ok"), F.col(a)), F.col(b)).alias("r0"),
        F.corr(F.when(F.col("_near"), F.col("_pa")), F.col(b)).alias("r_next"),
        F.corr(F.when(F.col("_near"), F.col(a)), F.col("_pb")).alias("r_prev"))
    best = F.greatest("r_next", "r_prev")
    return out.filter(F.col("n_pairs") >= least).withColumns({
        "lag_margin": F.col("r0") - best, "passes": F.col("r0") > best + margin})


def lag_products(df: DataFrame, keys: Sequence[str], index: str, value: str, max_lag: int, block: int = 10_080) -> DataFrame:
    """(keys, lag, s) for lags 0 to ``max_lag``: sum over rows of value(i) * value(i + lag); NULL and NaN values count as 0.

    A block of rows, with ``max_lag`` rows of its successor as halo, gives all its lags in one pass.
    """
    x = row_halo(df.select(*keys, index, F.col(value).cast("double").alias("_v")), keys, index, 0, max_lag, max(block, max_lag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            g, core, v = t["_g"].to_numpy(), t[CORE].to_numpy(zero_copy_only=False), np.nan_to_num(t["_v"].to_numpy(zero_copy_only=False))
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sums, own = [], []
            for lo, hi in zip(starts, np.append(starts[1:], len(g))):
                n = int(core[lo:hi].sum())  # halo rows come after the block's own
                if not n:
                    continue
                own.append(lo)
                ahead = np.concatenate([v[lo:hi], np.zeros(max(0, n + max_lag - (hi - lo)))])[:n + max_lag]
                sums.append(np.correlate(ahead, v[lo:lo + n], "valid"))
            first = t.take(pa.array(own, pa.int64())).select(list(keys))
            yield from first.append_column("_s", pa.array(sums, pa.list_(pa.float64()))).combine_chunks().to_batches()

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    parts = dealt_groups(x, [*keys, CHUNK], index).mapInArrow(run, f"{kinds}, _s array<double>")
    return parts.select(*keys, F.posexplode("_s").alias("lag", "_p")).groupBy(*keys, "lag").agg(F.sum("_p").alias("s"))


def _autocorrelations(df: DataFrame, keys: Sequence[str], value: str, max_lag: int, block: int) -> DataFrame:
    """(keys, n, sd, lag, rho) for lags 0 to ``max_lag`` in the order of row_idx; NULL for a constant key or a lag beyond its rows."""
    sizes = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count("*").alias("n"), F.stddev_pop(value).alias("sd"))
    centred = df.select(*keys, "row_idx", value).join(sizes, list(keys)).withColumn("_d", F.col(value) - F.col("_mean"))
    sums = lag_products(centred, keys, "row_idx", "_d", max_lag, block).join(sizes, list(keys))
    den = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(*keys))  # max_lag + 1 rows a key
    return sums.withColumn("_den", den).select(*keys, "n", "sd", "lag", F.when((F.col("_den") > 0) & (F.col("lag") < F.col("n")), F.col("s") / F.col("_den")).alias("rho"))


def acf(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], block: int = 10_080) -> DataFrame:
    """Autocorrelation per key and lag in row order, global mean and full-sum denominator."""
    return _autocorrelations(df, keys, value, max(lags), block).filter(F.col("lag").isin(list(lags))).select(*keys, "lag", "rho")


def effective_n(df: DataFrame, keys: Sequence[str], value: str, max_lag: int = 1440, block: int = 10_080) -> DataFrame:
    """N deflated by the autocorrelations up to the first one inside the white-noise band.

    One pass gives all lags of all keys; a key's lags, at most ``max_lag``, then meet in one array.
    """
    rhos = _autocorrelations(pin(df.select(*keys, "row_idx", value)), keys, value, max_lag, block)
    per = rhos.groupBy(*keys).agg(F.max("n").alias("n"), F.max("sd").alias("_sd"), F.array_sort(F.collect_list(F.when(
        (F.col("lag") > 0) & (F.col("lag") < F.col("n")), F.struct("lag", "rho")))).alias("_r"))
    band = 1.96 / F.sqrt("n")
    stop = F.array_min(F.transform(F.filter("_r", lambda r: F.abs(r["rho"]) < band), lambda r: r["lag"]))
    used = F.filter("_r", lambda r: F.col("_stop").isNull() | (r["lag"] < F.col("_stop")))
    weighted = F.aggregate("_u", F.lit(0.0), lambda s, r: s + F.coalesce((1 - r["lag"] / F.col("n")) * r["rho"], F.lit(0.0)))
    out = per.withColumn("_stop", stop).withColumn("_u", used).withColumn("_acc", weighted)
    factor = 1 + 2 * F.col("_acc")
    raw = F.when((factor > 0) & (F.col("n") >= 3) & (F.col("_sd") > 0), F.col("n") / F.nullif(factor, F.lit(0.0))).otherwise(F.col("n"))
    return out.select(*keys, "n", F.least(raw, F.col("n").cast("double")).alias("n_eff"), F.size("_u").alias("lags_used"))


def lag1_autocorr(df: DataFrame, keys: Sequence[str], index: str, value: str, block: int = 10_080) -> DataFrame:
    """Two conventions at lag 1: plain correlation of neighbours, and centred products over the full sum."""
    x = row_halo(df, keys, index, 1, 0, block)
    w = Window.partitionBy(*keys, CHUNK).orderBy(index)
    x = x.withColumn("_prev", F.lag(value).over(w)).filter(CORE)
    means = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    x = x.join(means, list(keys))
    d, p = F.col(value) - F.col("_m"), F.col("_prev") - F.col("_m")
    return x.groupBy(*keys).agg(F.corr("_prev", value).alias("ac_pairs"), (F.sum(d * p) / F.sum(d * d)).alias("ac_full"))


# ---- sequence features --------------------------------------------------------------------------------------------

def persistence_accuracy(tokens: DataFrame, window: int, token: str = "b_c") -> DataFrame:
    """Share of tokens equal to their predecessor inside non-overlapping windows of a segment."""
    w = Window.partitionBy("symbol", "segment_id", "_part").orderBy("row_idx")
    x = tokens.withColumn("_part", F.floor(F.col("seg_pos") / window))
    x = x.withColumn("_prev", F.lag(token).over(w)).filter(F.col("_prev").isNotNull())
    return x.groupBy("symbol").agg(F.avg((F.col(token) == F.col("_prev")).cast("double")).alias("accuracy"),
                                   F.count("*").alias("n"))


def lagged_features(df: DataFrame, tl: Timeline, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """``<column>_lag<k>`` inside the segment, NULL before its start."""
    x = framed(df, tl, max(lags), 0)
    w = tl.by_segment()
    return done(x.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags}))


def seq_context(df: DataFrame, length: int, columns: Sequence[str], out: str = "context", block: int = 10_080) -> DataFrame:
    """The last ``length`` rows of the symbol, the current one included, oldest first."""
    x = row_halo(df, ["symbol"], "row_idx", length - 1, 0, max(block, length))
    w = Window.partitionBy("symbol", CHUNK).orderBy("row_idx").rowsBetween(-(length - 1), 0)
    return x.withColumn(out, F.collect_list(F.struct(*columns)).over(w)).filter(CORE).drop(CHUNK, CORE)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """1-based rank per key with ties at their mean rank; rows without a value are left out."""
    return average_ranks(df, keys, value, out)


def path_quantiles(paths: DataFrame, shares: Sequence[float] = (0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """Pointwise quantiles per (seed, step), and per step over all seeds (seed -1)."""
    from barloom.frames import exact_quantiles

    both = paths.select("seed", "step", "value").unionByName(paths.select(F.lit(-1).cast("bigint").alias("seed"), "step", "value"))
    return exact_quantiles(both, ["seed", "step"], "value", {f"p{round(q * 100)}": q for q in shares})
