"""Decisions, costs, positions, pooled period returns and the measures taken on them.

Everything up to pooling is row work or a hash aggregate on (run, period). A pooled series has one row per period of
a fixed calendar, so windows over one run are bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import EPS_IR, FEE_SIDE, IMPACT, KAPPAS, MINUTES_PER_YEAR, Q_OVER_ADV
from barloom.frames import Timeline, running_sums
from barloom.operators.bars import asof_ffill


# ---- decisions ---------------------------------------------------------------------------------------------

def decision_grid(spark, lo_ms: int, hi_ms: int, h: int, step: int) -> DataFrame:
    """One row per calendar instant lo, lo+h*step, ... below hi."""
    return spark.range(lo_ms, hi_ms, h * step).select(F.col("id").alias("bar_open_ms"),
                                                      F.floor((F.col("id") - lo_ms) / (h * step)).alias("period"))


def symbol_decisions(df: DataFrame, lo_ms: int, hi_ms: int, h: int, seq_len: int, step: int) -> DataFrame:
    """Rows that lie on the grid, have ``seq_len`` earlier rows and a row h later; the grid test is arithmetic."""
    ends = df.groupBy("symbol").agg((F.max("row_idx") + 1).alias("_n"))
    on_grid = df.filter((F.col("bar_open_ms") >= lo_ms) & (F.col("bar_open_ms") < hi_ms)
                        & ((F.col("bar_open_ms") - lo_ms) % (h * step) == 0) & (F.col("row_idx") >= seq_len))
    return (on_grid.join(ends, "symbol").filter(F.col("row_idx") + h < F.col("_n")).drop("_n")
            .withColumn("period", F.floor((F.col("bar_open_ms") - lo_ms) / (h * step))))


def attach_spread(decisions: DataFrame, tiers: DataFrame) -> DataFrame:
    """Spread fraction by symbol; a symbol without one fails the job."""
    missing = F.raise_error(F.concat(F.lit("no spread for "), F.col("symbol"))).cast("double")
    joined = decisions.join(tiers.select("symbol", F.col("spread").alias("_sp")), "symbol", "left")
    return joined.withColumn("spread", F.when(F.col("_sp").isNull(), missing).otherwise(F.col("_sp"))).drop("_sp")


def c_side(spread: Column, sigma: Column, sigma_bar: Column, q_over_adv: float = Q_OVER_ADV) -> Column:
    ratio = F.when(sigma_bar > 0, sigma / F.nullif(sigma_bar, F.lit(0.0))).otherwise(1.0)
    return FEE_SIDE + spread * 0.5 * F.greatest(F.lit(1.0), ratio) + IMPACT * max(0.0, q_over_adv)


def c_total(spread: Column, sigma: Column, sigma_bar: Column) -> Column:
    return c_side(spread, sigma, sigma_bar) * 2


def funding_cost(decisions: DataFrame, events: DataFrame, h: int, tl: Timeline, out: str = "funding_cost") -> DataFrame:
    """side times the sum of rates settling after the next bar opens and up to h bars ahead.

    Running sums of the rates are looked up as-of both ends, so decisions and events never meet in a range join.
    """
    rates = events.groupBy("symbol", "ts_ms").agg(F.sum("value").alias("value"))
    paid = running_sums(rates, Timeline(tl.keys, "ts_ms", tl.step, tl.chunk), {"value": F.col("value")})
    shift = (h - 1) * tl.step
    near = asof_ffill(decisions, paid, "_a", tl).drop("_a_missing")
    far = asof_ffill(near.withColumn("bar_open_ms", F.col("bar_open_ms") + shift), paid, "_b", tl).drop("_b_missing")
    return far.withColumns({"bar_open_ms": F.col("bar_open_ms") - shift,
                            out: F.col("side") * (F.col("_b") - F.col("_a"))}).drop("_a", "_b")


def positions(mu: Column, theta: Column) -> Column:
    return F.when(mu > theta, 1).when(mu < -theta, -1).otherwise(0)


def net_return(side: Column, y: Column, cost: Column, funding: Column | None = None) -> Column:
    net = side * y - cost
    return net if funding is None else net - funding


def with_kappas(df: DataFrame, kappas: Sequence[float] = KAPPAS) -> DataFrame:
    """Every decision once per filter multiple, with its position; a generator, not a join."""
    out = df.withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in kappas])))
    return out.withColumn("side", positions(F.col("mu"), F.col("kappa") * F.col("c_total")))


# ---- pooled series --------------------------------------------------------------------------------------------

def pool_periods(trades: DataFrame, runs: DataFrame, keys: Sequence[str], n_periods: int, net: str = "net") -> DataFrame:
    """Equal-weight mean of the active symbols per period on the full calendar, flat periods 0.0, with breadth."""
    pooled = trades.groupBy(*keys, "period").agg(F.avg(net).alias("r"), F.count("*").alias("breadth"))
    calendar = runs.select(*keys).distinct().withColumn(
        "period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_periods - 1).cast("bigint"))))
    return calendar.join(pooled, [*keys, "period"], "left").na.fill({"r": 0.0, "breadth": 0})


def ppy(h: int) -> float:
    return MINUTES_PER_YEAR / h


def ir(r: str | Column, h: int) -> Column:
    """Annualised mean over population deviation; NULL below two rows."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when(F.count(r) >= 2, F.avg(r) / (F.stddev_pop(r) + EPS_IR) * ppy(h) ** 0.5)


def information_ratio(series: DataFrame, keys: Sequence[str], h: int, r: str = "r") -> DataFrame:
    return series.groupBy(*keys).agg(ir(r, h).alias("ir"), F.avg((F.col(r) != 0).cast("double")).alias("activity"),
                                     F.count_if(F.col(r) == 0).alias("n_flat"), F.count("*").alias("n_periods"))


def incremental_ir(series: DataFrame, keys: Sequence[str], h: int, bench: str = "bench") -> DataFrame:
    return series.groupBy(*keys).agg((ir("r", h) - ir(bench, h)).alias("incremental_ir"))


def decision_activity(expanded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traded over scored decisions per run and kappa."""
    return expanded.groupBy(*keys, "kappa").agg(F.count("*").alias("scored"), F.count_if(F.col("side") != 0).alias("traded"),
                                                F.avg((F.col("side") != 0).cast("double")).alias("activity"))


def mu_diag(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.avg("mu").alias("mean"), F.stddev_pop("mu").alias("std"),
        F.avg((F.col("mu") < 0).cast("double")).alias("frac_negative"), F.count("*").alias("n"), F.corr("mu", "y").alias("corr_y"))


def choose_kappa(val_ir: DataFrame, keys: Sequence[str], first: float = KAPPAS[0]) -> DataFrame:
    """kappa with the largest finite IR, ties to the smallest, the first kappa if none is finite."""
    finite = F.when(F.col("ir").isNotNull() & ~F.isnan("ir"), F.struct(F.col("ir"), -F.col("kappa")))
    return val_ir.groupBy(*keys).agg(F.coalesce(F.max_by("kappa", finite), F.lit(first)).alias("kappa"))


def market_mean(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return decisions.filter("y is not null").groupBy(*keys, "period").agg(F.avg("y").alias("market"), F.count("*").alias("breadth"))


# ---- costs of a series ------------------------------------------------------------------------------------------

def renet(r: Column, from_cost: float | Column, to_cost: float | Column) -> Column:
    """Same positions at another flat cost; flat periods stay 0."""
    shift = F.lit(to_cost) - F.lit(from_cost) if not isinstance(to_cost, Column) else to_cost - F.lit(from_cost)
    return F.when(r != 0, r - shift).otherwise(0.0)


def gross(r: Column, cost: float) -> Column:
    return F.when(r != 0, r + cost).otherwise(r)


def cost_stress(series: DataFrame, keys: Sequence[str], h: int, headline: float, costs: Sequence[float]) -> DataFrame:
    x = series.withColumn("cost", F.explode(F.array(*[F.lit(c) for c in costs])))
    return x.withColumn("r", renet(F.col("r"), headline, F.col("cost"))).groupBy(*keys, "cost").agg(ir("r", h).alias("ir"))


def break_even_cost(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First zero crossing of the IR-cost curve by linear interpolation; the curve has a handful of points per run."""
    w = Window.partitionBy(*keys).orderBy("cost")
    x = curve.withColumns({"_nc": F.lead("cost").over(w), "_ni": F.lead("ir").over(w)})
    i, n = F.col("ir"), F.col("_ni")
    crosses = ((i > 0) & (n <= 0)) | ((i < 0) & (n >= 0))
    at = F.when(F.col("_nc").isNotNull() & (i == 0), F.col("cost")).when(
        crosses, F.col("cost") + i / (i - n) * (F.col("_nc") - F.col("cost")))
    out = x.withColumn("_at", at).groupBy(*keys).agg(
        F.min("ir").alias("_lo"), F.max("ir").alias("_hi"), F.min_by("_at", F.when(F.col("_at").isNotNull(), F.col("cost"))).alias("_root"),
        F.max("cost").alias("_last"), F.count_if(i.isNull() | F.isnan(i)).alias("_bad"))
    whole = F.col("_bad") == 0
    return out.select(*keys, F.when(whole & (F.col("_lo") > 0), float("inf")).when(whole & (F.col("_hi") <= 0), float("-inf"))
                      .otherwise(F.coalesce("_root", "_last")).alias("c_break"))


def break_even_interval(series: DataFrame, keys: Sequence[str], cost: float) -> DataFrame:
    """Mean gross return per active period with its error, t, 95 % interval and lag-1 autocorrelation.

    The cost at which the IR vanishes equals this mean exactly, so no solver is needed.
    """
    active = series.filter("r <> 0").withColumn("g", gross(F.col("r"), cost))
    means = active.groupBy(*keys).agg(F.avg("g").alias("c_break"), F.count("*").alias("n_active"), F.stddev_samp("g").alias("_sd"))
    w = Window.partitionBy(*keys).orderBy("period")
    d = active.join(means, list(keys)).withColumn("_d", F.col("g") - F.col("c_break"))
    ac = d.withColumn("_p", F.lag("_d").over(w)).groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_p")) / F.sum(F.col("_d") * F.col("_d"))).alias("lag1"))
    se = F.col("_sd") / F.sqrt("n_active")
    return means.join(ac, list(keys)).filter("n_active >= 3").select(
        *keys, "n_active", "c_break", se.alias("se"), (F.col("c_break") / se).alias("t_stat"),
        (F.col("c_break") - 1.96 * se).alias("ci_low"), (F.col("c_break") + 1.96 * se).alias("ci_high"), "lag1")


def activity_lower_bound(ir_col: Column, h: int) -> Column:
    return ir_col * ir_col / (ppy(h) + ir_col * ir_col)


def required_horizon(edge: Column, h: int, cost: float) -> Column:
    """Horizon at which a linearly growing edge pays the cost; NULL without a positive edge."""
    return F.when(edge > 0, F.lit(h * cost) / F.nullif(edge, F.lit(0.0)))


# ---- comparisons of runs -------------------------------------------------------------------------------------------

def ablation(irs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Named IR differences between cells 1..5, and whether real micro beats its placebo."""
    wide = irs.groupBy(*keys).pivot("cell", [1, 2, 3, 4, 5]).agg(F.first("ir"))
    c = lambda n: F.col(f"`{n}`")
    return wide.select(*keys, (c(4) - c(5)).alias("micro_minus_placebo"), (c(2) - c(1)).alias("tokenizer_effect"),
                       (c(4) - c(3)).alias("micro_effect"), (c(4) - c(2)).alias("four_minus_two"), (c(3) - c(1)).alias("three_minus_one"),
                       (c(4) > c(5)).alias("micro_beats_placebo"))


def skill_vs_bias(series: DataFrame, diag: DataFrame, market: DataFrame, keys: Sequence[str], h: int, cost: float) -> DataFrame:
    """Model gross IR against a constant position at the modal sign on the same active periods."""
    x = series.join(diag.select(*keys, "frac_negative"), list(keys)).join(market.select("period", "market"), "period", "left")
    sign = F.when(F.col("frac_negative") > 0.5, -1.0).otherwise(1.0)
    x = x.withColumns({"_g": gross(F.col("r"), cost), "_b": F.when(F.col("r") != 0, sign * F.coalesce("market", F.lit(0.0))).otherwise(0.0)})
    out = x.groupBy(*keys).agg(ir("_g", h).alias("ir_model"), ir("_b", h).alias("ir_bias"), F.count_if(F.col("r") != 0).alias("n_active"))
    return out.withColumn("bias_share", F.when(F.col("ir_model") != 0, F.col("ir_bias") / F.nullif("ir_model", F.lit(0.0))))


def constant_book_lattice(units: DataFrame, digits: int = 9) -> DataFrame:
    """Direction of each unit's book, how many units share its IR and whether that IR belongs to a constant book."""
    kind = (F.when(F.col("ir") == 0, "flat").when(F.col("frac_negative") == 1, "all_short")
            .when(F.col("frac_negative") == 0, "all_long").otherwise("mixed"))
    x = units.withColumns({"direction": kind, "_k": F.round("ir", digits)})
    points = x.groupBy("_k").agg(F.count("*").alias("multiplicity"), F.max((F.col("direction") != "mixed").cast("int")).alias("_on"))
    return x.join(points, "_k").withColumn("on_lattice", (F.col("_on") == 1) | (F.col("_k") == 0)).drop("_k", "_on")


def decision_stability(pairs: DataFrame, thresholds: dict[str, float], keys: Sequence[str] = (), a: str = "mu_a", b: str = "mu_b") -> DataFrame:
    """Flips between two prediction columns at several thresholds, and whether the data could show one, per key.

    A row within the key's largest gap of a threshold could flip; without such rows the rate says nothing.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("theta")) for k, v in thresholds.items()]))
    gap = F.coalesce(F.max(F.abs(F.col(a) - F.col(b))), F.lit(0.0)).alias("_gap")
    widest = pairs.groupBy(*keys).agg(gap)
    x = (pairs.join(widest, list(keys)) if keys else pairs.crossJoin(F.broadcast(widest))).withColumn("_t", levels).select("*", "_t.label", "_t.theta")
    pa, pb = positions(F.col(a), F.col("theta")), positions(F.col(b), F.col("theta"))
    near = F.abs(F.abs(F.col(a)) - F.col("theta")) <= F.col("_gap")
    return x.groupBy(*keys, "label", "theta").agg(
        F.count("*").alias("n"), F.count_if(pa != pb).alias("flipped"), F.avg((pa != pb).cast("double")).alias("flip_rate"),
        F.avg((pa != 0).cast("double")).alias("activity_a"), F.avg((pb != 0).cast("double")).alias("activity_b"),
        (F.count_if((pa != 0) != (pb != 0)) == 0).alias("same_traded_set"), (F.count_if(near) > 0).alias("discriminates"))


def sign_agreement(pairs: DataFrame, traded: Column, keys: Sequence[str], band: float = 0.97) -> DataFrame:
    """Sign agreement and gap of two estimators on traded rows."""
    gap = F.col("mu_a") - F.col("mu_b")
    agree = F.avg(((F.col("mu_a") < 0) == (F.col("mu_b") < 0)).cast("double"))
    return pairs.filter(traded).groupBy(*keys).agg(
        F.count("*").alias("n"), agree.alias("agreement"), F.avg(gap).alias("gap_mean"), F.stddev_pop(gap).alias("gap_std"),
        F.avg(F.abs(gap)).alias("gap_abs_mean")).withColumn("passes", F.col("agreement") >= band)


def sign_disagreement(predictions: DataFrame, seeds: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Unanimity of the seeds, the rate independent signs would give, and the pairwise agreement, per key."""
    wide = predictions.groupBy(*keys, "symbol", "bar_open_ms").pivot("seed", list(seeds)).agg(F.first("mu")).na.drop()
    up = {s: (F.col(f"`{s}`") > 0).cast("double") for s in seeds}
    total = sum((up[s] for s in seeds), F.lit(0.0))
    pairs = [(a, b) for i, a in enumerate(seeds) for b in seeds[i + 1:]]
    out = wide.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(total.isin(0.0, float(len(seeds))).cast("double")).alias("unanimity"),
                   *[F.avg(up[s]).alias(f"p_up_{s}") for s in seeds],
                   *[F.avg((up[a] == up[b]).cast("double")).alias(f"agree_{a}_{b}") for a, b in pairs])
    p, q = F.lit(1.0), F.lit(1.0)
    for s in seeds:
        p, q = p * F.col(f"p_up_{s}"), q * (1 - F.col(f"p_up_{s}"))
    return out.withColumn("expected_unanimity", p + q)


def direction_balance(pairs: DataFrame, keys: Sequence[str] = (), half_width: float = 0.05, z95: float = 1.6448536269514722) -> DataFrame:
    """Mean shift of predictions and whether enter and exit moves balance, with a one-sided 95 % bound."""
    d, m = F.col("mu_b") - F.col("mu_a"), F.abs("mu_b") - F.abs("mu_a")
    agg = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_delta"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"),
        F.count_if(m > 0).alias("n_enter"), F.count_if(m < 0).alias("n_exit"))
    moved = F.col("n_enter") + F.col("n_exit")
    out = agg.withColumns({"t_stat": F.col("mean_delta") / F.nullif("se", F.lit(0.0)),
                           "enter_fraction": F.col("n_enter") / F.nullif(moved, F.lit(0))})
    out = out.withColumn("imbalance", F.abs(2 * F.col("enter_fraction") - 1))
    out = out.withColumns({"imbalance_upper95": F.col("imbalance") + z95 / F.sqrt(moved),
                           "z_balance": (F.col("n_enter") - moved / 2) / (F.sqrt(moved) * 0.5)})
    return out.withColumns({"balanced": F.col("imbalance_upper95") <= half_width, "zero_mean": F.abs("t_stat") <= 3})


def estimator_majority(estimates: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Seeds with a positive sign per estimator, and whether the majorities of a key's estimators differ."""
    long = estimates.unpivot([*keys, "seed"], list(names), "estimator", "value")
    per = long.groupBy(*keys, "estimator").agg(F.sum((F.col("value") > 0).cast("bigint")).alias("n_positive"), F.count("*").alias("n_seeds"))
    up = (F.col("n_positive") * 2 > F.col("n_seeds")).cast("int")
    w = Window.partitionBy(*keys)  # one row per estimator
    return per.withColumn("disagree", F.min(up).over(w) != F.max(up).over(w))


def upgrade_test(per_h: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Three legs per horizon; horizon 1 can never count because its label is identically 0."""
    legs = {"activity_binds": (F.col("activity") > 0) & (F.col("activity") < 1),
            "sign_balanced": F.col("frac_negative").between(lo, hi), "ir_positive": F.coalesce(F.col("ir") > 0, F.lit(False))}
    out = per_h.withColumns(legs).withColumn("void", F.col("h") == 1)
    return out.withColumn("all_three", F.col("activity_binds") & F.col("sign_balanced") & F.col("ir_positive") & ~F.col("void"))


def prediction_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Decisions on which two prediction tables differ (missing on one side included)."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    return left.join(right, list(keys), "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *keys, F.col("_a").isNull().alias("missing_left"), F.col("_b").isNull().alias("missing_right"))


def symbol_quantiles(nets: DataFrame, shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    from barloom.frames import exact_quantiles

    return exact_quantiles(nets, list(keys), "net", {f"p{round(q * 100)}": q for q in shares})
