"""Correlations, screens, deflated statistics, diagnostics, guards and the verdict."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import EPS_IR, MINUTES_PER_YEAR
from barloom.frames import Timeline, exact_quantiles, row_index, value_ranks
from barloom.functions.special import EULER_GAMMA, norm_cdf_udf, norm_ppf, norm_ppf_udf, t_ppf_udf, welch_df
from barloom.operators.evaluate import ir, ppy
from barloom.operators.samples import block_bootstrap
from barloom.operators.windows import average_rank, effective_n
from barloom.session import pin


def pearson(a: str, b: str) -> Column:
    """Correlation, NULL for a constant side. Not by ``corr``, whose own division fails there in ANSI mode before a guard is read."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def rank_ic(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and rank correlation per key; ranks are distributed, ties at their mean."""
    df = pin(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()))
    ranked = average_rank(average_rank(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), pearson(x, y).alias("ic"), pearson("_rx", "_ry").alias("rank_ic"))


def moving_block_ci(df: DataFrame, keys: Sequence[str], index: str, a: str, b: str, length: int, reps: int, seed: int,
                    lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval of corr(a, b) under an overlapping block bootstrap of whole blocks."""
    x, y = F.col(a), F.col(b)
    sums = {"sa": x, "sb": y, "saa": x * x, "sbb": y * y, "sab": x * y}
    boot = block_bootstrap(df, keys, index, sums, F.lit(length), reps, seed, truncate=False)
    n = F.col("n")
    cov = F.col("sab") / n - F.col("sa") / n * F.col("sb") / n
    va = F.greatest(F.col("saa") / n - F.pow(F.col("sa") / n, 2), F.lit(0.0))
    vb = F.greatest(F.col("sbb") / n - F.pow(F.col("sb") / n, 2), F.lit(0.0))
    den = F.sqrt(va) * F.sqrt(vb)
    r = boot.withColumn("r", F.when(den > 0, cov / F.nullif(den, F.lit(0.0))))
    return r.groupBy(*keys).agg(F.percentile("r", lo).alias("ci_low"), F.percentile("r", hi).alias("ci_high"))


def ic_screen(long: DataFrame, keys: Sequence[str], ts: str, step: int, day: int, reps: int, seed: int, least: int = 1000) -> DataFrame:
    """RankIC, IC, interval and verdict per (keys, feature) over all horizons, as one grouped plan.

    ``long`` has keys, feature, h, the time, ``x`` and ``y``; one row per usable observation.
    """
    on = [*keys, "feature", "h"]
    usable = pin(long.filter("x is not null and y is not null"))
    ranked = pin(average_rank(average_rank(usable, on, "x", "rx"), on, "y", "ry"))
    point = ranked.groupBy(*on).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("std"), pearson("x", "y").alias("ic"),
                                    pearson("rx", "ry").alias("rank_ic"))
    top = usable.groupBy(*on, "x").agg(F.count("*").alias("_c")).groupBy(*on).agg((F.max("_c") / F.sum("_c")).alias("frac_constant"))
    indexed = row_index(ranked.select(*on, ts, "rx", "ry"), Timeline(tuple(on), ts, step, 4096))
    ci = moving_block_ci(indexed, on, "row_idx", "rx", "ry", day, reps, seed)
    out = point.join(top, on).join(ci, on)
    enough = (F.col("n") >= least) & (F.col("std") > 0)
    for c in ("ic", "rank_ic", "ci_low", "ci_high"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    return out.withColumn("significant", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))


def screen_verdict(screen: DataFrame, keys: Sequence[str]) -> DataFrame:
    agg = screen.groupBy(*keys, "feature").agg(F.max("std").alias("_s"), F.min("frac_constant").alias("_f"), F.bool_or("significant").alias("_c"))
    return agg.select(*keys, "feature", F.when((F.col("_s") < 1e-8) | (F.col("_f") > 0.99), "dead")
                      .when(F.col("_c"), "carries-signal").otherwise("live-no-signal").alias("verdict"))


def mde_from_neff(n_eff: Column, z: float = 1.96) -> dict[str, Column]:
    se = 1 / F.sqrt(F.greatest(n_eff, F.lit(1.0)))
    return {"se": se, "mde_single": se * z, "mde_two_cell": se * z * math.sqrt(2.0)}


def pairwise_corr(returns: DataFrame, key: str, index: str, value: str, least: int, tile: int = 64, span: int = 4096) -> DataFrame:
    """Correlation of every pair of keys over their common periods, at least ``least`` of them.

    Rows never meet pair by pair: (tile x tile x period block) groups of bounded size are dense matrices whose products
    give all partial sums at once, and partial sums are added up by pair.
    """
    n_tiles = max(1, math.ceil(returns.select(key).distinct().count() / tile))
    x = returns.filter(F.col(value).isNotNull()).select(
        F.col(key).alias("k"), F.col(index).alias("p"), F.col(value).cast("double").alias("v"),
        F.pmod(F.hash(key), F.lit(n_tiles)).alias("_t"), F.floor(F.col(index) / span).alias("_b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))
    x = x.withColumn("_o", other).withColumns({"ta": F.least("_t", "_o"), "tb": F.greatest("_t", "_o")})

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        ta, tb = pdf["ta"].iloc[0], pdf["tb"].iloc[0]
        grid = pdf.pivot(index="k", columns="p", values="v")
        names, m = grid.index.to_numpy(), (~grid.isna()).to_numpy(dtype=float)
        v = grid.fillna(0.0).to_numpy()
        own = pdf.drop_duplicates("k").set_index("k")["_t"].reindex(names).to_numpy()
        i, j = np.nonzero(names[:, None] < names[None, :])
        if ta != tb:
            cross = own[i] != own[j]
            i, j = i[cross], j[cross]
        parts = {"n": m @ m.T, "sa": v @ m.T, "sb": m @ v.T, "saa": (v * v) @ m.T, "sbb": m @ (v * v).T, "sab": v @ v.T}
        out = pd.DataFrame({"a": names[i], "b": names[j], **{c: w[i, j] for c, w in parts.items()}})
        return out[out["n"] > 0]

    kind = returns.schema[key].dataType.simpleString()
    sums = x.groupBy("ta", "tb", "_b").applyInPandas(
        products, f"a {kind}, b {kind}, n double, sa double, sb double, saa double, sbb double, sab double")
    tot = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).filter(F.col("n") >= least)
    n = F.col("n")
    den = F.sqrt((n * F.col("saa") - F.col("sa") ** 2) * (n * F.col("sbb") - F.col("sb") ** 2))
    return tot.select("a", "b", n.cast("bigint").alias("n"),
                      F.when(den > 0, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.nullif(den, F.lit(0.0))).alias("rho"))


def portfolio_mde(returns: DataFrame, key: str, least: int, h: int, alpha: float = 0.05, power: float = 0.80, long_enough: int = 100) -> DataFrame:
    """Detectable annualised IR of a pooled book: serial dependence shrinks T, common moves shrink breadth."""
    r = pin(returns.filter("y is not null").select(key, "period", "y"))
    market = pin(r.groupBy("period").agg(F.avg("y").alias("m"), F.count("*").alias("breadth")))
    resid = r.join(market, "period").withColumn("e", F.col("y") - F.col("m"))
    raw = pairwise_corr(r, key, "period", "y", least).agg(F.avg("rho").alias("rho_raw"))
    res = pairwise_corr(resid, key, "period", "e", least).agg(F.avg("rho").alias("rho_residual"))
    w = Window.partitionBy(F.lit(0)).orderBy("period")  # one row per calendar period
    ser = market.withColumn("_p", F.lag("m").over(w)).agg(F.count("*").alias("t"), F.avg("breadth").alias("breadth"), F.corr("_p", "m").alias("_ac"))
    out = ser.withColumn("_j", F.lit(0)).join(raw.withColumn("_j", F.lit(0)), "_j").join(res.withColumn("_j", F.lit(0)), "_j")
    ac = F.greatest(F.when(F.col("t") > long_enough, F.coalesce("_ac", F.lit(0.0))).otherwise(0.0), F.lit(0.0))
    out = out.withColumn("ac1", ac).withColumn("t_eff", F.col("t") * (1 - F.col("ac1")) / (1 + F.col("ac1")))
    z = norm_ppf(1 - alpha) + norm_ppf(power)
    return out.select("t", "t_eff", "ac1", "rho_raw", "rho_residual", "breadth",
                      (F.col("breadth") / (1 + (F.col("breadth") - 1) * F.greatest("rho_raw", F.lit(0.0)))).alias("breadth_eff"),
                      (F.sqrt(F.lit(2.0) / F.greatest("t_eff", F.lit(1.0))) * z * math.sqrt(ppy(h))).alias("mde"))


# ---- deflated Sharpe ----------------------------------------------------------------------------------------

def sharpe_moments(series: DataFrame, keys: Sequence[str], r: str = "r") -> DataFrame:
    sd = F.stddev_pop(r)
    return series.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(sd > 0, F.avg(r) / F.nullif(sd, F.lit(0.0))).otherwise(0.0).alias("sharpe"),
        F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))


def psr_z(benchmark: Column) -> Column:
    """The normal score of the probabilistic Sharpe ratio."""
    s = F.col("sharpe")
    den = F.sqrt(F.greatest(F.lit(1e-300), 1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s))
    return (s - benchmark) * F.sqrt(F.col("n") - 1) / den


def expected_max_sharpe(var_sr: float, n_trials: int) -> float:
    n = max(2, int(n_trials))
    return math.sqrt(max(0.0, var_sr)) * ((1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e)))


def psr_dsr(moments: DataFrame, var_sr: float, n_trials: int) -> DataFrame:
    sr0 = expected_max_sharpe(var_sr, n_trials)
    return moments.withColumns({"psr": norm_cdf_udf(psr_z(F.lit(0.0))), "sr0": F.lit(sr0), "dsr": norm_cdf_udf(psr_z(F.lit(sr0)))})


def dsr_trials(val_irs: DataFrame, h_primary: int, placebo: int = 5, config: Sequence[str] = ("cell", "kappa")) -> tuple[DataFrame, float, int]:
    """De-annualised validation IRs of every unit; their population variance over the placebo cell, seeds included; the number of
    configurations tried, in which seeds are replicates and do not count."""
    trials = val_irs.withColumn("trial", F.col("ir") / math.sqrt(ppy(h_primary)))
    var_sr, n = trials.agg(F.var_pop(F.when(F.col("cell") == placebo, F.col("trial"))), F.count_distinct(*config)).first()
    return trials, var_sr or 0.0, n


# ---- paired bootstrap and detectable effects ---------------------------------------------------------------------

def paired_delta_ir(pairs: DataFrame, keys: Sequence[str], h: int, reps: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """IR difference of two series per key with bootstrap interval and error; starts are shared by both series.

    ``pairs`` has ``period``, ``a`` and ``b``; blocks of ceil(sqrt(T)) rows, the last one cut to T.
    """
    a, b = F.col("a"), F.col("b")
    boot = block_bootstrap(pairs, keys, "period", {"sa": a, "qa": a * a, "sb": b, "qb": b * b}, F.ceil(F.sqrt("t")), reps, seed, truncate=True)

    def rep_ir(s: str, q: str) -> Column:
        m = F.col(s) / F.col("n")
        return m / (F.sqrt(F.greatest(F.col(q) / F.col("n") - m * m, F.lit(0.0))) + EPS_IR) * math.sqrt(ppy(h))

    deltas = boot.withColumn("d", rep_ir("sa", "qa") - rep_ir("sb", "qb"))
    spread = deltas.groupBy(*keys).agg(F.percentile("d", alpha).alias("ci_lower"), F.percentile("d", 1 - alpha).alias("ci_upper"),
                                       F.stddev_samp("d").alias("se_boot"), F.count("*").alias("b"))
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    short = F.raise_error(F.lit("series too short or not finite for a block bootstrap")).cast("double")
    point = pairs.groupBy(*keys).agg(F.when((F.count("*") < 8) | (F.count_if(bad) > 0), short).otherwise(ir("a", h) - ir("b", h)).alias("delta_ir"),
                                     F.count("*").alias("t"))
    return point.join(spread, list(keys))


def pair_series(series: DataFrame, pairs: Sequence[tuple[int, int]], unit: str = "cell") -> DataFrame:
    """Two units' series side by side on the period index, one block of rows per named pair; lengths must agree."""
    p = F.explode(F.array(*[F.struct(F.lit(f"{x}-{y}").alias("pair"), F.lit(x).alias("ca"), F.lit(y).alias("cb")) for x, y in pairs]))
    tagged = series.withColumn("_p", p).filter((F.col(unit) == F.col("_p.ca")) | (F.col(unit) == F.col("_p.cb")))
    return tagged.groupBy(F.col("_p.pair").alias("pair"), "period").agg(
        F.max(F.when(F.col(unit) == F.col("_p.ca"), F.col("r"))).alias("a"), F.max(F.when(F.col(unit) == F.col("_p.cb"), F.col("r"))).alias("b"))


def mde_terms(df: DataFrame, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Detectable effect from se_boot (df b-1) and, if positive, se_train (df n_seeds-1)."""
    st, sb = F.coalesce("se_train", F.lit(0.0)), F.col("se_boot")
    nu = F.when(st > 0, welch_df(sb, F.col("b") - 1, st, F.col("n_seeds") - 1)).otherwise(F.col("b") - 1)
    out = df.withColumns({"nu": nu.cast("double"), "se_total": F.sqrt(sb * sb + st * st)})
    z = norm_ppf(1 - alpha) + norm_ppf(power)
    t_mult = t_ppf_udf(F.lit(1 - alpha), "nu") + t_ppf_udf(F.lit(power), "nu")
    return out.withColumn("multiplier", F.when(st > 0, t_mult).otherwise(z)).withColumn("mde", F.col("multiplier") * F.col("se_total"))


def mde_sweep(df: DataFrame, ratios: Sequence[float], floor: float, n_seeds: int, b: int) -> DataFrame:
    """Detectable effect over a grid of se_train/se_boot ratios, its monotonicity and the first ratio at the floor."""
    x = df.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    x = x.withColumns({"se_train": F.col("se_boot") * F.col("ratio"), "n_seeds": F.lit(n_seeds), "b": F.lit(b)})
    keys = [c for c in df.columns if c != "se_boot"]
    w = Window.partitionBy(*keys).orderBy("ratio")
    m = mde_terms(x)
    m = m.withColumn("rises", F.coalesce(F.col("mde") >= F.lag("mde").over(w), F.lit(True)))
    return m.withColumn("first_at_floor", F.min(F.when(F.col("mde") >= floor, F.col("ratio"))).over(Window.partitionBy(*keys)))


# ---- forecast diagnostics -----------------------------------------------------------------------------------------

def vol_mae_r2(df: DataFrame, keys: Sequence[str], hat: str, true: str, base: str) -> DataFrame:
    h, t, b = F.col(hat), F.col(true), F.col(base)
    res, tot, off = F.sum((t - h) ** 2), F.var_pop(t) * F.count(t), F.sum((t - b) ** 2)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(h - t)).alias("mae"), F.when(tot > 0, 1 - res / F.nullif(tot, F.lit(0.0))).alias("r2_vs_mean"),
        F.when(off > 0, 1 - res / F.nullif(off, F.lit(0.0))).alias("r2_vs_baseline"), F.avg(F.abs(b - t)).alias("mae_baseline"))


def pinball(y: Column, q_pred: Column, level: float) -> Column:
    d = y - q_pred
    return F.when(d >= 0, d * level).otherwise(d * (level - 1))


def mean_pinball(df: DataFrame, keys: Sequence[str], y: str, preds: dict[float, str]) -> DataFrame:
    parts = [F.avg(pinball(F.col(y), F.col(c), q)) for q, c in preds.items()]
    return df.groupBy(*keys).agg((sum(parts[1:], parts[0]) / len(parts)).alias("mean_pinball"))


def picp_mpiw(df: DataFrame, keys: Sequence[str], y: str, lo: str, hi: str, nominal: float) -> DataFrame:
    inside = ((F.col(lo) <= F.col(y)) & (F.col(y) <= F.col(hi))).cast("double")
    return df.groupBy(*keys).agg(F.avg(inside).alias("picp"), F.avg(F.col(hi) - F.col(lo)).alias("mpiw"),
                                 F.abs(F.avg(inside) - nominal).alias("calibration_error"))


def recon_errors(truth: DataFrame, recon: DataFrame, dims: Sequence[int], delta: float = 1.0) -> DataFrame:
    """Per dimension masked MAE, Huber loss and the MAE of predicting the mean, from two aligned tables."""
    on = ["symbol", "bar_open_ms"]
    j = truth.select(*on, *[f"x_{d}" for d in dims], *[f"m_{d}" for d in dims]).join(
        recon.select(*on, *[F.col(f"x_{d}").alias(f"r_{d}") for d in dims]), on)
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"x_{d}").alias("x"), F.col(f"r_{d}").alias("r"),
                                        F.col(f"m_{d}").alias("m")) for d in dims]))
    long = pin(j.select(*on, rows.alias("e")).select(*on, "e.*").filter("m = 0"))
    means = long.groupBy("dim").agg(F.avg("x").alias("_mean"))
    err = F.abs(F.col("r") - F.col("x"))
    huber = F.when(err < delta, err * err * 0.5 / delta).otherwise(err - 0.5 * delta)
    return long.join(means, "dim").groupBy("dim").agg(
        F.count("*").alias("n"), F.avg(err).alias("mae"), F.avg(huber).alias("huber"), F.avg(F.abs(F.col("x") - F.col("_mean"))).alias("mean_mae")
    ).withColumn("non_degenerate", F.col("mae") < F.col("mean_mae") * 0.9)


def decode_agreement(df: DataFrame, keys: Sequence[str], one: str, full: str) -> DataFrame:
    """Sign agreement of two decodes; a collapsed one is flagged because its agreement means nothing."""
    o, w = F.col(one), F.col(full)
    vo, vw = F.var_pop(o), F.var_pop(w)
    return df.groupBy(*keys).agg(
        F.avg((F.signum(o) == F.signum(w)).cast("double")).alias("sign_agreement"), F.when(vw > 0, vo / F.nullif(vw, F.lit(0.0))).alias("variance_ratio"),
        ((vo <= F.greatest(vw, F.lit(1e-30)) * 1e-8) | (F.sqrt(vo) <= 1e-8)).alias("degenerate"),
        (F.avg(F.abs(o - w)) / F.greatest(F.sqrt(vw), F.lit(1e-30))).alias("delta_over_sd"))


def welch_test(units: DataFrame, value: str, cell_a: int, cell_b: int) -> DataFrame:
    """Welch t of two cells' seed values, NULL where it cannot be formed, with the 95 % quantile."""
    g = lambda c, f: f(F.when(F.col("cell") == c, F.col(value)))
    x = units.agg(g(cell_a, F.avg).alias("ma"), g(cell_b, F.avg).alias("mb"), g(cell_a, F.stddev_samp).alias("sa"),
                  g(cell_b, F.stddev_samp).alias("sb"), F.least(g(cell_a, F.count), g(cell_b, F.count)).alias("n"))
    ea, eb = F.col("sa") / F.sqrt("n"), F.col("sb") / F.sqrt("n")
    se = F.sqrt(ea * ea + eb * eb)
    x = x.withColumns({"diff": F.abs(F.col("ma") - F.col("mb")), "se": se, "df": welch_df(ea, F.col("n") - 1, eb, F.col("n") - 1)})
    x = x.withColumns({"t": F.col("diff") / F.nullif("se", F.lit(0.0)), "t_crit": t_ppf_udf(F.lit(0.95), "df")})
    return x.select("diff", "se", "df", "t", "t_crit", (F.col("t") > F.col("t_crit")).alias("significant"))


def cross_block_dependence(df: DataFrame, left: Sequence[int] = range(7, 13), right: Sequence[int] = range(0, 7)) -> DataFrame:
    """Mean absolute correlation between two groups of dimensions, one pass of correlation aggregates."""
    names = [(a, b) for a in left for b in right]
    wide = df.agg(*[F.abs(pearson(f"x_{a}", f"x_{b}")).alias(f"c_{a}_{b}") for a, b in names])
    return wide.select(F.explode(F.array(*[F.col(f"c_{a}_{b}") for a, b in names])).alias("c")).agg(F.avg("c").alias("mean_abs_corr"))


def copula_deficit(df: DataFrame, columns: Sequence[str]) -> float:
    """-log det(corr of normal scores) / 2d; the d x d matrix is the only thing on the driver."""
    x = pin(df.select(*columns).na.drop().withColumn("_id", F.monotonically_increasing_id()))
    n = x.count()
    for c in columns:
        x = average_rank(x, [], c, f"_r_{c}").withColumn(f"_z_{c}", norm_ppf_udf((F.col(f"_r_{c}") - 0.5) / n))
    x = pin(x)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    row = x.agg(*[F.corr(f"_z_{columns[i]}", f"_z_{columns[j]}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        m[i, j] = m[j, i] = row[f"c{i}_{j}"]
    return float(-0.5 * np.linalg.slogdet(m)[1] / len(columns))


def drift(per_subset: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 0.15) -> DataFrame:
    """Largest distance of a statistic on the subsets from its value on the whole ('all'), per key."""
    whole = F.max(F.when(F.col("subset") == "all", F.col(value)))
    agg = per_subset.groupBy(*keys).agg(whole.alias("w"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    d = F.greatest(F.col("hi") - F.col("w"), F.col("w") - F.col("lo"))
    return agg.select(*keys, d.alias("max_drift"), (d <= limit).alias("stable"))


# ---- guards and verdict --------------------------------------------------------------------------------------------

def degeneracy_guard(units: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Cells whose book has one direction or never filters, on the seed mean or any seed; unreadable inputs halt."""
    fn, act = F.col("frac_negative"), F.col("activity")
    unreadable = fn.isNull() | act.isNull() | F.isnan(fn) | F.isnan(act)
    locked = lambda c: (c < lo) | (c > hi)
    idle = lambda c: (c <= 0) | (c >= 1)
    per = units.groupBy("cell").agg(
        F.avg(fn).alias("frac_negative"), F.avg(act).alias("activity"), F.bool_or(F.coalesce(locked(fn) | idle(act), F.lit(False))).alias("_any"),
        F.count_if(unreadable).alias("n_unreadable"))
    bad = locked(F.col("frac_negative")) | idle(F.col("activity")) | F.col("_any")
    return per.withColumn("degenerate", F.coalesce(bad, F.lit(False))).withColumn(
        "halts", F.col("degenerate") | (F.col("n_unreadable") > 0)).drop("_any")


def power_guard(units: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims no larger than the seed-to-seed range of the cells they are built from; claims has cell_a, cell_b, delta."""
    spread = units.groupBy("cell").agg((F.max("ir") - F.min("ir")).alias("range"), F.count_if(F.col("ir").isNull() | F.isnan("ir")).alias("bad"))
    a = spread.select(F.col("cell").alias("cell_a"), F.col("range").alias("_ra"), F.col("bad").alias("_ba"))
    b = spread.select(F.col("cell").alias("cell_b"), F.col("range").alias("_rb"), F.col("bad").alias("_bb"))
    x = claims.join(a, "cell_a", "left").join(b, "cell_b", "left").withColumn("worst_range", F.greatest("_ra", "_rb"))
    unreadable = F.col("worst_range").isNull() | F.col("delta").isNull() | (F.col("_ba") > 0) | (F.col("_bb") > 0)
    return x.select("cell_a", "cell_b", "delta", "worst_range",
                    (F.coalesce(F.col("worst_range") >= F.abs("delta"), F.lit(False)) | unreadable).alias("halts"))


def placebo_tripwire(units: DataFrame, placebo: int = 5, reference: Sequence[int] = (1, 2, 3), factor: float = 1.5) -> DataFrame:
    """Seed range of the placebo cell against the median range of the reference cells."""
    spread = units.groupBy("cell").agg((F.max("ir") - F.min("ir")).alias("range"))
    out = spread.agg(F.max(F.when(F.col("cell") == placebo, F.col("range"))).alias("placebo_range"),
                     F.percentile(F.when(F.col("cell").isin(*reference), F.col("range")), 0.5).alias("median_range"))
    return out.withColumn("fired", F.coalesce((F.col("median_range") > 0) & (F.col("placebo_range") > F.col("median_range") * factor), F.lit(False)))


def capacity_ratio(recon: DataFrame) -> DataFrame:
    """Placebo over treatment reconstruction error; recon has cell and mae."""
    m = lambda c: F.avg(F.when(F.col("cell") == c, F.col("mae")))
    return recon.agg(m(4).alias("mae_4"), m(5).alias("mae_5")).withColumn("ratio", F.when(F.col("mae_4") > 0, F.col("mae_5") / F.nullif("mae_4", F.lit(0.0))))


def missing_fields(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that lack a required field, with the fields."""
    none = F.lit(None).cast("string")
    lacking = [F.lit(c) if c not in rows.columns else F.when(F.col(c).isNull(), c).otherwise(none) for c in required]
    return rows.withColumn("missing", F.array_compact(F.array(*lacking))).filter(F.size("missing") > 0)


def provenance_groups(artifacts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Number of distinct values per identity field; more than one or a missing value refuses."""
    long = artifacts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("e")).select("e.*")
    # counted first, so a field with many values never sits in one set
    per = long.groupBy("field", "value").agg(F.count("*").alias("_n")).groupBy("field").agg(
        F.count("value").alias("n_values"), F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("n_missing"))
    return per.withColumn("refused", (F.col("n_values") != 1) | (F.col("n_missing") > 0))


def verdict_clauses(paired: DataFrame, dsr: float, floor: float = 0.5, dsr_bar: float = 0.95) -> DataFrame:
    """One row per clause from the paired table (pair, delta_ir, ci_lower, mde); all must pass to survive."""
    get = lambda pair, c: F.max(F.when(F.col("pair") == pair, F.col(c)))
    x = paired.agg(get("4-5", "ci_lower").alias("ci45"), get("4-5", "delta_ir").alias("d45"), get("4-5", "mde").alias("mde45"),
                   get("4-2", "ci_lower").alias("ci42"))
    rows = [("paired_ci", F.col("ci45"), F.lit(0.0), F.col("ci45") > 0), ("paired_mde", F.col("d45"), F.col("mde45"), F.col("d45") >= F.col("mde45")),
            ("placebo_validity", F.col("ci42"), F.lit(0.0), F.col("ci42") > 0), ("economic_floor", F.col("d45"), F.lit(floor), F.col("d45") >= floor),
            ("dsr", F.lit(float(dsr)), F.lit(dsr_bar), F.lit(bool(dsr >= dsr_bar)))]
    out = x.select(F.explode(F.array(*[F.struct(F.lit(n).alias("clause"), v.alias("value"), t.cast("double").alias("threshold"), p.alias("passes"))
                                       for n, v, t, p in rows])).alias("e")).select("e.*")
    alive = out.agg(F.min(F.coalesce("passes", F.lit(False)).cast("int"))).first()[0]
    return out.withColumn("outcome", F.lit("SURVIVES" if alive else "NULL"))


def null_fallback(paired: DataFrame, dsr: float, floor: float = 0.5, dsr_bar: float = 0.95) -> DataFrame:
    """What may still be claimed for cell 2 over cell 1 when the primary is NULL."""
    p = paired.filter("pair = '2-1'")
    return p.select("pair", "delta_ir", (F.col("ci_lower") > 0).alias("ci"), (F.col("delta_ir") >= F.col("mde")).alias("mde_met"),
                    (F.col("delta_ir") >= floor).alias("floor_met"), F.lit(bool(dsr >= dsr_bar)).alias("dsr_met"))
