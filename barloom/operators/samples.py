"""Sampling, permutation and resampling with draws that depend only on (seed, key), never on the layout."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.frames import Timeline, dealt_groups, running_sums, value_ranks, whole_groups
from barloom.session import pin


def uniform(seed: int | str | Column, *key: str | Column) -> Column:
    """Portable uniform in [0, 1) from the first 32 bits of an md5 of ``seed:key``."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", head.cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pick_evenly_rows(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """``n`` evenly spaced order statistics of a column per key, found through distributed ranks."""
    ranks = value_ranks(df, keys, value)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                     lambda i: F.bround(i * (F.col("total") - 1) / F.lit(float(max(n - 1, 1)))).cast("bigint"))
    hits = F.size(F.filter(at, lambda i: (i >= F.col("below")) & (i < F.col("below") + F.col("n"))))
    return (ranks.withColumn("_hits", hits).filter("_hits > 0")
            .select(*keys, F.explode(F.array_repeat(value, F.col("_hits"))).alias(value)))


def hash_rank(df: DataFrame, keys: Sequence[str], u: str, size: str, ties: Sequence[str], out: str = "hash_rank",
              per_bucket: int = 10_000) -> DataFrame:
    """0-based rank of a uniform draw per key.

    The draw is uniform, so equal slices of [0, 1) are balanced buckets and need no sampling; ``size`` is the key's
    row count and sets how many slices a key gets.
    """
    x = df.withColumn("_b", F.floor(F.col(u) * F.ceil(F.col(size) / per_bucket)))
    inside = Window.partitionBy(*keys, "_b").orderBy(u, *ties)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).select(
        *keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    return (x.withColumn("_l", F.row_number().over(inside)).join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_o") + F.col("_l") - 1).drop("_b", "_l", "_o"))


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int, seed: int, ident: Sequence[str], salts: int = 64) -> DataFrame:
    """At most n rows per key, chosen by the smallest draws.

    The n smallest of a key are among the n smallest of each of its salts, so a hot key is cut down in parallel first.
    """
    x = df.withColumn("_u", uniform(seed, *ident)).withColumn("_s", F.floor(F.col("_u") * 1_000_003) % salts)
    first = Window.partitionBy(*keys, "_s").orderBy("_u", *ident)
    x = x.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
    final = Window.partitionBy(*keys).orderBy("_u", *ident)
    return x.withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n).drop("_u", "_s", "_r")


def block_time_permute(df: DataFrame, seed: int, dims: Sequence[int] = range(7, 13)) -> DataFrame:
    """Move (value, mask) of the dimensions together to other rows of the same segment.

    The row at position p of a segment receives the row whose draw ranks p-th: one shuffle join on (segment, rank).
    """
    keys = ["symbol", "segment_id"]
    moved = [f"{p}_{d}" for d in dims for p in "xm"]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    source = df.select(*keys, "seg_pos", *moved).join(sizes, keys).withColumn("_u", uniform(seed, "symbol", "segment_id", "seg_pos"))
    source = hash_rank(source, keys, "_u", "_size", ["seg_pos"], "_to").select(*keys, F.col("_to").alias("seg_pos"), *moved)
    return df.drop(*moved).join(source, [*keys, "seg_pos"])


def phase_randomize(df: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """Fourier phase surrogate per channel and segment of four rows or more; the power spectrum is kept.

    A transform needs its whole segment, and a segment holds at most one row per bar of the calendar (ten million for
    twenty years of minutes, 80 MB per channel), so a group is one (symbol, segment, channel).
    """
    import numpy as np
    import pandas as pd

    long = df.unpivot(["symbol", "segment_id", "seg_pos"], list(columns), "channel", "value")

    def surrogate(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        pdf = pdf.sort_values("seg_pos")
        n = len(pdf)
        if n >= 4:
            spectrum = np.fft.rfft(pdf["value"].to_numpy())
            name = f"{seed}:{pdf['symbol'].iloc[0]}:{pdf['segment_id'].iloc[0]}:{pdf['channel'].iloc[0]}"
            phase = np.exp(2j * np.pi * np.random.default_rng(zlib.crc32(name.encode())).random(len(spectrum)))
            phase[0] = 1.0
            if n % 2 == 0:
                phase[-1] = 1.0
            pdf = pdf.assign(value=np.fft.irfft(np.abs(spectrum) * phase, n=n))
        return pdf

    return long.groupBy("symbol", "segment_id", "channel").applyInPandas(surrogate, long.schema)


def stratified_blocked_split(df: DataFrame, stratum: str, position: str, strata: DataFrame, n: int) -> DataFrame:
    """The first rows of each stratum up to an equal quota, the first 80 % of them marked train.

    ``strata`` holds one row per stratum with its 0-based ``order``; the remainder goes to the earliest strata.
    """
    k = strata.count()
    quota = F.lit(n // max(1, k)) + F.when(F.col("order") < n % max(1, k), 1).otherwise(0)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    take = strata.join(sizes, stratum).select(stratum, F.least(quota, "_size").alias("_take"))
    return (df.join(take, stratum).filter(F.col(position) < F.col("_take"))
            .withColumn("is_train", F.col(position) < F.greatest(F.lit(1), F.floor(F.col("_take") * 0.8))).drop("_take"))


def sample_windows(starts: DataFrame, n: int, seed: int, alpha: float = 0.5, first: int = 0, slices: int = 1024) -> DataFrame:
    """n draws of (symbol, window): symbols by n_windows**alpha, windows uniformly; ``first`` resumes a run.

    ``starts`` has ``symbol`` and a 0-based ``win``. The cumulative weights are cut into slices of [0, 1), which turns
    the range lookup into an equi-join, and a heavy symbol simply owns many slices.
    """
    from barloom.frames import global_rank

    weights = pin(starts.groupBy("symbol").agg(F.count("*").alias("n_windows")).withColumns(
        {"_w": F.pow(F.col("n_windows").cast("double"), alpha), "_h": uniform("order", "symbol")}))
    total = weights.agg(F.sum("_w")).first()[0] or 1.0
    cum = global_rank(weights, "_h", ["symbol"], weight="_w").select(
        "symbol", "n_windows", ((F.col("running") - F.col("_w")) / total).alias("_lo"), (F.col("running") / total).alias("_hi"))
    cum = cum.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("_lo") * slices),
                                                        F.least(F.floor(F.col("_hi") * slices), F.lit(slices - 1)))))
    draws = starts.sparkSession.range(first, first + n).withColumnRenamed("id", "draw")
    draws = draws.withColumns({"_u": uniform(seed, F.lit("symbol"), "draw"), "_v": uniform(seed, F.lit("window"), "draw")})
    draws = draws.withColumn("_slice", F.floor(F.col("_u") * slices))
    hit = draws.join(cum, "_slice").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    hit = hit.withColumn("win", F.floor(F.col("_v") * F.col("n_windows"))).select("draw", "symbol", "win")
    return hit.join(starts, ["symbol", "win"])


# ---- block bootstrap -------------------------------------------------------------------------------------------

_DRAWS: dict[str, np.ndarray] = {}


def _drawn(seed: str, reps: int, blocks: int) -> np.ndarray:
    """(reps, blocks) of the uniforms that ``uniform(seed, rep, block)`` gives, kept per worker: they depend on nothing else."""
    have = _DRAWS.get(seed, np.zeros((0, 0)))
    if have.shape[0] < reps or have.shape[1] < blocks:
        rows, cols = max(reps, have.shape[0]), max(blocks, have.shape[1])
        out = np.empty((rows, cols), dtype=np.uint32)
        out[:have.shape[0], :have.shape[1]] = have
        for r in range(rows):
            done = have.shape[1] if r < have.shape[0] else 0
            text = b"".join(hashlib.md5(f"{seed}:{r}:{j}".encode()).digest()[:4] for j in range(done, cols))
            out[r, done:] = np.frombuffer(text, ">u4")
        _DRAWS.clear()  # one seed at a time
        _DRAWS[seed] = have = out
    return have[:reps, :blocks]


def tile_sums(u: np.ndarray, spread: int, first: int, whole: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(reps, sums): what each replicate takes from the starts first, first + 1... of a tile, whose block sums are the rows of ``whole``.

    ``u`` holds a replicate's uniforms in a row; its last block is cut, with sums ``cut``. The product of the matrix that counts
    a replicate's draws of each start with the block sums, formed without the matrix.
    """
    out = np.zeros((len(u), whole.shape[1]))
    step = max(1, (1 << 20) // u.shape[1])
    for lo in range(0, len(u), step):
        at = np.floor(u[lo:lo + step] / 4294967296.0 * spread).astype(np.int64) - first
        inside = (at >= 0) & (at < len(whole))
        at = np.where(inside, at, 0)
        for sums, part in ((whole, slice(0, -1)), (cut, slice(-1, None))):
            held = sums[at[:, part]]
            held[~inside[:, part]] = 0.0
            out[lo:lo + step] += held.sum(axis=1)
    return out


def block_bootstrap(series: DataFrame, keys: Sequence[str], index: str, sums: dict[str, Column], length: Column, reps: int,
                    seed: int, truncate: bool, tile: int = 16_384) -> DataFrame:
    """Sums of resampled overlapping blocks per (key, replicate), with the number of rows ``n``.

    Prefix sums turn a block into two lookups. ``length`` may use the column ``t``, the rows of the key. With ``truncate`` the
    last block is cut so that every replicate has exactly t rows. Starts depend on (seed, replicate, block) only: series sharing a length
    share them.

    All replicates of a key meet its block sums in tiles of ``tile`` starts, so draws are never rows: a tile gives one row per
    replicate that takes something from it, and a key of any length is many tiles.
    """
    sizes = series.groupBy(*keys).agg(F.count("*").cast("bigint").alias("t"))
    sizes = sizes.withColumn("_len", F.least(length.cast("bigint"), F.col("t")))
    sizes = sizes.withColumn("_k", F.ceil(F.col("t") / F.col("_len")))
    sizes = sizes.withColumn("_cut", F.col("t") - (F.col("_k") - 1) * F.col("_len") if truncate else F.col("_len"))
    names = list(sums)
    prefix = running_sums(series.select(*keys, index, *[e.cast("double").alias(n) for n, e in sums.items()]),
                          Timeline(tuple(keys), index, 1, 4096), {n: F.col(n) for n in names})
    prefix = pin(prefix.join(sizes, list(keys)))
    low = prefix.select(*keys, (F.col(index) + 1).alias("_start"), *[F.col(n).alias(f"_lo_{n}") for n in names])
    ends = F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("_len").alias("size")), F.struct(F.lit(1).alias("cut"), F.col("_cut").alias("size"))))
    high = prefix.withColumn("_e", ends).select(*keys, "t", "_len", "_k", (F.col(index) + 1 - F.col("_e.size")).alias("_start"), F.col("_e.cut").alias("_last"), F.col("_e.size").alias("_size"), *names)
    blocks = high.filter("_start >= 0 and _start <= t - _len").join(low, [*keys, "_start"], "left").select(
        *keys, "t", "_len", "_k", "_start", "_last", F.col("_size").cast("double").alias("_size"), F.floor(F.col("_start") / tile).alias("_tile"),
        *[(F.col(n) - F.coalesce(f"_lo_{n}", F.lit(0.0))).alias(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            g, last, start = (t[c].to_numpy() for c in ("_g", "_last", "_start"))
            value = np.column_stack([t[c].to_numpy() for c in ("_size", *names)])
            edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            rows, length_of, blocks_of = (t[c].to_numpy() for c in ("t", "_len", "_k"))
            for lo, hi in zip(edges, np.append(edges[1:], len(g))):
                first = int(start[lo])
                whole, cut = (np.zeros((int(start[hi - 1]) - first + 1, value.shape[1])) for _ in range(2))
                for sums_of, kind in ((whole, 0), (cut, 1)):  # a start without rows adds nothing
                    of = lo + np.flatnonzero(last[lo:hi] == kind)
                    sums_of[start[of] - first] = value[of]
                got = tile_sums(_drawn(str(seed), reps, int(blocks_of[lo])), int(rows[lo] - length_of[lo] + 1), first, whole, cut)
                met = np.flatnonzero(got[:, 0] > 0)
                columns = [t[k].combine_chunks().take(pa.array(np.full(len(met), lo))) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(met.astype(np.int32)), *(pa.array(c) for c in got[met].T)], [*keys, "rep", "n", *names])

    kinds = ", ".join(f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys)
    tiles = dealt_groups(blocks, [*keys, "_tile"], "_start").mapInArrow(run, f"{kinds}, rep int, n double, " + ", ".join(f"{n} double" for n in names))
    return tiles.groupBy(*keys, "rep").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(n).alias(n) for n in names])


def pbo_cscv(series: DataFrame, keys: Sequence[str], config: str, n_periods: int, splits: int = 8) -> DataFrame:
    """Share of symmetric splits whose in-sample best configuration ranks at or below the out-of-sample median.

    Blocks are reduced to (n, sum, sum of squares) before the splits are formed.
    """
    from itertools import combinations

    if splits < 2 or splits % 2:
        raise ValueError("splits must be even and at least 2")
    edges = [n_periods * i // splits for i in range(1, splits)]
    block = sum((F.when(F.col("period") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    stats = series.groupBy(*keys, config, block.alias("_b")).agg(
        F.count("*").alias("_n"), F.sum("r").alias("_s"), F.sum(F.col("r") * F.col("r")).alias("_q"))
    halves = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(b) for b in c]).alias("inside"))
                                 for i, c in enumerate(combinations(range(splits), splits // 2))]))
    x = stats.withColumn("_h", halves).select("*", F.col("_h.id").alias("_split"),
                                              F.array_contains("_h.inside", F.col("_b")).alias("_in")).drop("_h")

    def sharpe(side: Column) -> Column:
        n, s, q = (F.sum(F.when(side, F.col(c))) for c in ("_n", "_s", "_q"))
        sd = F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
        # rounded, so that equal series tie whatever order their sums were formed in
        return F.round(F.when(sd > 0, s / n / F.nullif(sd, F.lit(0.0))).otherwise(0.0), 10)

    per = x.groupBy(*keys, config, "_split").agg(sharpe(F.col("_in")).alias("_is"), sharpe(~F.col("_in")).alias("_oos"))
    best = per.groupBy(*keys, "_split").agg(F.max_by("_oos", F.struct("_is", -F.col(config))).alias("_best"), F.count("*").alias("_cfg"))
    ranked = per.join(best, [*keys, "_split"]).groupBy(*keys, "_split").agg(
        (F.count_if(F.col("_oos") <= F.col("_best")) / (F.max("_cfg") + 1)).alias("_rank"))
    return ranked.groupBy(*keys).agg(F.avg((F.col("_rank") <= 0.5).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))
