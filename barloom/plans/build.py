"""Ticks to feature lake: the composed pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import FeatureConfig
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import hashing as H
from barloom.operators import quality as Q
from barloom.operators import segments as S
from barloom.functions.scalars import clip_finite
from barloom.operators import universe as U
from barloom.session import pin
from barloom.sources.lake import write_lake


def build_features(trades: DataFrame, klines: DataFrame, cfg: FeatureConfig, funding: DataFrame | None = None,
                   open_interest: DataFrame | None = None) -> DataFrame:
    """All symbols at once: reduce ticks, join onto bars, attach events, compute features.

    Repeated bars and non-finite features fail the job that reads the result; the input is read once for checks and result.
    """
    bars = B.attach_trades(klines, B.reduce_trades(trades, cfg.bar_ms))
    marks = {n: df for n, df in (("funding", funding), ("oi", open_interest)) if df is not None}
    if marks:
        bars = B.asof_marks(bars, marks, S.timeline(cfg))
    return X.guard_finite(X.compute_features(bars, cfg, trades), [f"x_{d}" for d in range(16)])


def hash_text() -> Column:
    """Stored float32 values and masks of a row as text."""
    return H.row_text([*[f"x_{d}" for d in range(16)], *[f"m_{d}" for d in range(16)]])


def build_universe(bars: DataFrame, spec: DataFrame, window: tuple[str, str], cfg: FeatureConfig, root: str,
                   trades: DataFrame | None = None, by: str = "month") -> tuple[DataFrame, DataFrame]:
    """Slice every symbol to its live span, compute features, write the lake; (coverage with hashes, universe hash)."""
    kept = pin(U.slice_active(bars, spec, *window))
    U.assert_all_live(kept, U.active_window(spec, *window).filter("is_live").join(bars.select("symbol").distinct(), "symbol", "left_semi"))
    flags = kept.groupBy("symbol").agg(F.first("head_truncated").alias("head_truncated"), F.first("tail_truncated").alias("tail_truncated"))
    feats = X.compute_features(kept.drop("head_truncated", "tail_truncated"), cfg, trades)
    feats = X.guard_finite(feats, [f"x_{d}" for d in range(16)])
    write_lake(feats, root, by=by)
    lake = bars.sparkSession.read.parquet(root)
    hashes = H.dataset_hash(lake, S.timeline(cfg), hash_text())
    cov = Q.coverage(lake).join(hashes, "symbol").join(flags, "symbol")
    return cov, H.universe_hash(hashes)


def rollup_manifest(lake: DataFrame, hashes: DataFrame, spec: DataFrame, window: tuple[str, str]) -> DataFrame:
    """Coverage of every built symbol with its spec, from one aggregation over the lake."""
    return U.manifest_rows(hashes.select("symbol", "dataset_hash"), spec, Q.coverage(lake), *window)


def build_manifest(manifest: DataFrame) -> DataFrame:
    """Hash of the manifest content; wall-clock and raw-file columns do not take part."""
    keep = [c for c in manifest.columns if c not in ("built_at", "raw_files")]
    g = F.conv(F.substring(F.md5("symbol"), 1, 2), 16, 10).cast("int")
    rows = manifest.select("symbol", g.alias("g"), F.to_json(F.struct(*sorted(keep))).alias("doc"))
    level = rows.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("symbol", "doc"))), lambda r: r["doc"]), ";"), 256).alias("h"))
    return level.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda r: r["h"]), ";"), 256).alias("manifest_hash"))


def verify_lake_identity(lake: DataFrame, manifest: DataFrame, pinned: dict[str, object]) -> DataFrame:
    """Counts of the lake and the manifest against pinned values, one row per check."""
    have = lake.groupBy("symbol").agg(F.count("*").alias("n"))
    got = have.agg(F.count("*").alias("n_symbols"), F.sum("n").alias("n_bars")).first()
    absent = manifest.select("symbol").join(have.select("symbol"), "symbol", "left_anti").count()
    tree = H.universe_hash(manifest.select("symbol", "dataset_hash")).first()[0]
    rows = [("n_symbols", got["n_symbols"] == pinned["n_symbols"]), ("n_bars", got["n_bars"] == pinned["n_bars"]),
            ("every_symbol_present", absent == 0), ("universe_hash", tree == pinned["universe_hash"])]
    return lake.sparkSession.createDataFrame(rows, "check string, holds boolean")


def symbol_windows(lake: DataFrame, cfg: FeatureConfig, arm: str, length: int, stride: int, boundary_ms: int, seed: int) -> DataFrame:
    """Fold-legal window starts of an arm: the micro transform comes before the columns are cut."""
    from barloom.operators.samples import block_time_permute
    from barloom.operators.windows import fold_valid_starts

    x = lake
    if arm == "micro_placebo":
        x = block_time_permute(x, seed)
    elif arm == "micro_constant":
        x = U.constant_micro(x)
    x = U.select_arm(x, "ohlcv" if arm == "ohlcv" else "micro", keep=("symbol", "bar_open_ms", "segment_id", "seg_pos", "row_idx"))
    return fold_valid_starts(x, S.timeline(cfg), length, stride, boundary_ms)


def frozen_stats(features: DataFrame, cfg: FeatureConfig, columns: dict[str, int], boundary_ms: int) -> DataFrame:
    """Static z-scores after the boundary from the EWMA state of each symbol at its last row before it.

    ``features`` are core rows with the chunk columns; ``columns`` maps a raw feature to its half-life.
    """
    from barloom.frames import Term, affine_scan, segment_first

    tl = S.timeline(cfg)
    x = segment_first(features, tl, {f"_o_{c}": c for c in columns})
    terms = {}
    for c, half in columns.items():
        a = cfg.alpha(half)
        terms[f"_m1_{c}"] = Term(1 - a, f"({c} - _o_{c}) * {a!r}D")
        terms[f"_m2_{c}"] = Term(1 - a, f"({c} - _o_{c}) * ({c} - _o_{c}) * {a!r}D")
    x = pin(affine_scan(x, tl, terms))
    state = {}
    for c in columns:
        state[f"mu_{c}"] = F.col(f"_o_{c}") + F.col(f"_m1_{c}")
        state[f"var_{c}"] = F.greatest(F.col(f"_m2_{c}") - F.col(f"_m1_{c}") ** 2, F.lit(0.0))
    at = x.filter(F.col(tl.ts) < boundary_ms).groupBy("symbol").agg(
        *[F.max_by(v, tl.ts).alias(k) for k, v in state.items()])
    after = x.filter(F.col(tl.ts) >= boundary_ms).join(at, "symbol")
    return after.select("symbol", tl.ts, *[clip_finite((F.col(c) - F.col(f"mu_{c}")) / F.sqrt(F.col(f"var_{c}") + 1e-8)).alias(f"z_{c}")
                                           for c in columns])


def field_dropout(df: DataFrame, columns: tuple[str, ...] = ("x_5", "x_6"), p: float = 0.05, seed: int = 0) -> DataFrame:
    """Normalised volume fields set to 0 at random, decided by (seed, row, field) alone."""
    from barloom.operators.samples import uniform

    return df.withColumns({c: F.when(uniform(seed, "symbol", "bar_open_ms", F.lit(c)) < p, 0.0).otherwise(F.col(c)) for c in columns})

