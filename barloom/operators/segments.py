"""Segments: maximal runs of bars without a time gap or a structural jump, found chunk by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import FeatureConfig
from barloom.frames import CHUNK, CORE, LSEG, Timeline, before, carry, with_halo


def timeline(cfg: FeatureConfig, keys: tuple[str, ...] = ("symbol",)) -> Timeline:
    return Timeline(keys, "bar_open_ms", cfg.bar_ms, cfg.chunk)


def is_break(prev_ts: Column, prev_close: Column, ts: Column, close: Column, cfg: FeatureConfig) -> Column:
    jump = F.when(prev_close != 0, F.abs(close / F.nullif(prev_close, F.lit(0.0)) - 1) >= cfg.structural).otherwise(False)
    return prev_ts.isNull() | (ts - prev_ts > cfg.bar_ms) | jump


def local_segments(bars: DataFrame, cfg: FeatureConfig, back: int = 1, ahead: int = 0,
                   keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Chunked bars with a local segment number, exact for frames of at most ``back``/``ahead`` rows.

    Inside a segment bars are contiguous in time, so a look-back of k rows is a look-back of k steps and the
    time halo holds it. A previous bar outside the halo is further away than one step, which is a break anyway.
    """
    tl = timeline(cfg, keys)
    w = tl.by_chunk()
    framed = with_halo(bars, tl, max(back, 1), ahead)
    framed = framed.withColumns({"_pts": F.lag(tl.ts).over(w), "_pc": F.lag("close").over(w)})
    framed = framed.withColumn("_brk", is_break(F.col("_pts"), F.col("_pc"), F.col(tl.ts), F.col("close"), cfg)
                               .cast("int"))
    framed = framed.withColumn("_gap", (F.col("_pts").isNull() | (F.col(tl.ts) - F.col("_pts") > cfg.bar_ms))
                               .cast("int"))
    return framed.withColumn(LSEG, F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_pts", "_pc")


def local_position(tl: Timeline) -> Column:
    """0-based row number in the local segment; exact up to the halo length, a lower bound beyond it."""
    return F.row_number().over(tl.by_segment()) - 1


def with_segments(bars: DataFrame, cfg: FeatureConfig, back: int = 1, ahead: int = 0,
                  keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``local_segments`` plus, for core rows, ``segment_id`` (from 0 per symbol), ``seg_pos`` and ``row_idx``.

    The narrow branch (time and close only) reduces each chunk to its number of breaks and rows and the place of
    its last break; a scan over that chunk table gives the state entering each chunk.
    """
    tl = timeline(cfg, keys)
    narrow = local_segments(bars.select(*keys, tl.ts, "close"), cfg, 1, 0, keys)
    w = tl.by_chunk()
    at = F.sum(F.col(CORE).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    prior = carry(
        narrow.withColumn("_at", at), tl,
        {"_tb": F.sum("_brk"), "_tn": F.count("*"), "_tl": F.max(F.when(F.col("_brk") == 1, F.col("_at")))},
        {"_cb": F.coalesce(F.sum("_tb").over(before(tl)), F.lit(0)),
         "_cn": F.coalesce(F.sum("_tn").over(before(tl)), F.lit(0)), "_tl": F.col("_tl")},
    )
    # row index of the segment that is open when the chunk starts
    prior = prior.withColumn("_co", F.last(F.col("_cn") + F.col("_tl") - 1, ignorenulls=True).over(before(tl))).drop("_tl")
    wide = local_segments(bars, cfg, back, ahead, keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumns({
        "_nb": F.sum(F.when(F.col(CORE), F.col("_brk")).otherwise(0)).over(upto),
        "_at": F.sum(F.col(CORE).cast("int")).over(upto),
    })
    wide = wide.withColumn("_lb", F.max(F.when(F.col(CORE) & (F.col("_brk") == 1), F.col("_at"))).over(upto))
    out = wide.join(prior, tl.on_chunk)
    return out.withColumns({
        "segment_id": F.col("_cb") + F.col("_nb") - 1,
        "row_idx": F.col("_cn") + F.col("_at") - 1,
        "seg_pos": F.col("_cn") + F.col("_at") - 1 - F.coalesce(F.col("_cn") + F.col("_lb") - 1, F.col("_co")),
    }).drop("_nb", "_at", "_lb", "_cb", "_cn", "_co")


def assign_segments(bars: DataFrame, cfg: FeatureConfig) -> DataFrame:
    out = with_segments(bars, cfg)
    return out.filter(CORE).drop(CHUNK, CORE, LSEG, "_brk", "_gap")


def segment_bounds(segmented: DataFrame) -> DataFrame:
    """Half-open row range of each segment."""
    return segmented.groupBy("symbol", "segment_id").agg(
        F.min("row_idx").alias("start_idx"), (F.max("row_idx") + 1).alias("end_idx"))


def segment_catalog(segmented: DataFrame, min_bars: int = 128) -> DataFrame:
    return segmented.groupBy("symbol", "segment_id").agg(
        F.min("bar_open_ms").alias("lo_ms"), F.max("bar_open_ms").alias("hi_ms"), F.count("*").alias("n_bars")
    ).filter(F.col("n_bars") >= min_bars)
