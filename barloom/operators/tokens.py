"""Code arithmetic on latent arrays, token statistics and linear probes of tokens."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------
FSQ_LEVELS = (11, 9, 9, 7, 7, 5, 5)
BSQ_BITS = (10, 10)
BITS_BAND = (19.5, 20.5)
MAX_BITS_DELTA = 0.5


# ---- code book layout, computed at plan time ---------------------------------------------------------------

def coarse_fine(levels: Sequence[int]) -> tuple[list[int], list[int]]:
    """Indices of the two groups: levels descending, cut where the bits of both sides are closest."""
    order = sorted(range(len(levels)), key=lambda i: -levels[i])
    # bits of a group are the logarithm of its number of codes
    gap = lambda k: abs(math.log2(math.prod(levels[i] for i in order[:k])) - math.log2(math.prod(levels[i] for i in order[k:])))
    cut = min(range(1, len(levels)), key=gap)
    return order[:cut], order[cut:]


def vocab_sizes(levels: Sequence[int]) -> tuple[int, int]:
    c, f = coarse_fine(levels)
    return math.prod(levels[i] for i in c), math.prod(levels[i] for i in f)


def layout_table(spark, layouts: dict[str, Sequence[int]]) -> DataFrame:
    rows = []
    for name, levels in layouts.items():
        vc, vf = vocab_sizes(levels)
        rows.append((name, len(levels), vc, vf, math.log2(vc * vf)))
    return spark.createDataFrame(rows, "layout string, dims int, v_c int, v_f int, bits double")


def parity_check(layouts: DataFrame, a: str, b: str) -> DataFrame:
    """Two layouts are comparable when both lie in the band and differ by at most half a bit."""
    bits = lambda n: F.max(F.when(F.col("layout") == n, F.col("bits")))
    lo, hi = BITS_BAND
    x = layouts.agg(bits(a).alias("bits_a"), bits(b).alias("bits_b"))
    return x.select("*", F.abs(F.col("bits_a") - F.col("bits_b")).alias("delta")).withColumn(
        "passes", F.col("bits_a").between(lo, hi) & F.col("bits_b").between(lo, hi) & (F.col("delta") <= MAX_BITS_DELTA))


# ---- quantisers ------------------------------------------------------------------------------------------------

def _levels(levels: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in levels])


def fsq_codes(z: Column, levels: Sequence[int] = FSQ_LEVELS, gamma: float = 1.0) -> Column:
    """Per-dimension codes 0..L-1: half-even rounding of the squashed latent on an odd grid; a NaN has no code (NULL)."""
    return F.zip_with(F.slice(z, 1, len(levels)), _levels(levels),
                      lambda v, n: (F.bround((n - 1) / 2.0 * F.tanh(v.cast("double") * gamma)) + (n - 1) / 2).try_cast("int"))


def fsq_values(codes: Column, levels: Sequence[int] = FSQ_LEVELS) -> Column:
    return F.zip_with(codes, _levels(levels), lambda c, n: c - (n - 1) / 2.0)


def bsq_codes(z: Column) -> Column:
    return F.transform(z, lambda v: (v >= 0).cast("int"))


def bsq_commitment(z: Column) -> Column:
    """Mean squared distance of the unit latent from its corner."""
    d = z
    norm = F.greatest(F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))), F.lit(1e-8))
    k = F.size(d).cast("double")
    off = F.transform(d, lambda v: F.pow(v.cast("double") / norm - F.when(v >= 0, 1.0).otherwise(-1.0) / F.sqrt(k), 2))
    return F.aggregate(off, F.lit(0.0), lambda a, v: a + v) / k


def flatten_codes(codes: Column, group: Sequence[int], levels: Sequence[int]) -> Column:
    """Big-endian mixed-radix id of the codes of a group."""
    out = F.lit(0).cast("bigint")
    for i in group:
        out = out * int(levels[i]) + codes[i]
    return out


def unflatten_codes(token: Column, group: Sequence[int], levels: Sequence[int]) -> Column:
    """Codes of a group from its id, in group order."""
    rest, out = token, []
    for i in reversed(group):
        out.append((rest % int(levels[i])).cast("int"))
        rest = F.floor(rest / int(levels[i]))
    return F.array(*reversed(out))


def coarse_only(values: Column, fine: Sequence[int]) -> Column:
    """Fine dimensions pinned to the centre of the grid."""
    return F.transform(values, lambda v, i: F.when(i.isin(*[int(k) for k in fine]), 0.0).otherwise(v))


def digit_columns(levels: Sequence[int] = FSQ_LEVELS) -> dict[str, Column]:
    """One column per digit from (b_c, b_f)."""
    c, f = coarse_fine(levels)
    out = {}
    for token, group in (("b_c", c), ("b_f", f)):
        digits = unflatten_codes(F.col(token), group, levels)
        out.update({f"digit_{i}": digits[k] for k, i in enumerate(group)})
    return out


def digit_onehots(df: DataFrame, levels: Sequence[int] = FSQ_LEVELS) -> DataFrame:
    """0/1 columns ``d<digit>_<code>``."""
    return df.withColumns(digit_columns(levels)).withColumns(
        {f"d{i}_{v}": (F.col(f"digit_{i}") == v).cast("int") for i, n in enumerate(levels) for v in range(n)})


# ---- token statistics --------------------------------------------------------------------------------------------

def codebook_usage(tokens: DataFrame, keys: Sequence[str], token: str, vocab: int) -> DataFrame:
    """Used codes, entropy and perplexity; ids outside the code book fail the job."""
    bad = F.raise_error(F.lit(f"token outside [0, {vocab})")).cast("bigint")
    ids = F.when((F.col(token) < 0) | (F.col(token) >= vocab), bad).otherwise(F.col(token))
    counts = tokens.groupBy(*keys, ids.alias("_id")).agg(F.count("*").alias("_n"))
    # H = log2 N - sum(n log2 n) / N needs no second pass for the total
    out = counts.groupBy(*keys).agg(F.sum("_n").alias("n_tokens"), F.count("*").alias("n_used"),
                                    F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))).alias("_s"))
    h = F.greatest(F.log2(F.col("n_tokens").cast("double")) - F.col("_s") / F.col("n_tokens"), F.lit(0.0))
    return out.select(*keys, "n_tokens", "n_used", (F.col("n_used") / vocab).alias("utilization"), h.alias("entropy_bits"),
                      F.lit(math.log2(vocab)).alias("capacity_bits"), (h / math.log2(vocab)).alias("efficiency"),
                      F.pow(F.lit(2.0), h).alias("perplexity"), (F.lit(vocab) - F.col("n_used")).alias("dead_codes"))


def marginal_ce_acc(train: DataFrame, val: DataFrame, token: str, vocab: int, alpha: float = 1.0) -> DataFrame:
    """Cross entropy and accuracy of the smoothed train marginal on validation tokens, through counts only."""
    counts = train.groupBy(token).agg(F.count("*").alias("_c"))
    n, mode = train.count(), counts.orderBy(F.col("_c").desc(), token).first()[0]
    v = val.groupBy(token).agg(F.count("*").alias("_v")).join(counts, token, "left")
    p = (F.coalesce("_c", F.lit(0)) + alpha) / (n + alpha * vocab)
    return v.agg((-F.sum(F.col("_v") * F.log(p)) / F.sum("_v")).alias("ce"),
                 (F.sum(F.when(F.col(token) == mode, F.col("_v")).otherwise(0)) / F.sum("_v")).alias("accuracy"))


def mutual_information(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Plug-in mutual information in nats from joint and marginal counts."""
    total = lambda cols: df.groupBy(*keys, *cols).agg(F.count("*").alias("_".join(["n", *cols])))
    x = total([a, b]).join(total([a]), [*keys, a]).join(total([b]), [*keys, b])
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    x = x.join(n, list(keys)) if keys else x.withColumn("_n", F.lit(df.count()))
    pab = F.col(f"n_{a}_{b}") / F.col("_n")
    return x.groupBy(*keys).agg(F.sum(pab * F.log(F.col(f"n_{a}_{b}") * F.col("_n") / (F.col(f"n_{a}") * F.col(f"n_{b}")))).alias("mi"))


def channel_info(source: DataFrame, level: str, channel: Sequence[Sequence[float]], carrier: DataFrame, target: str) -> DataFrame:
    """Information a redraw channel carries under the measured source marginal, and how it shifts the target marginal.

    Two group-bys give the marginals (one row per level); the sums run over the channel's fixed entries.
    """
    n, m = source.count(), carrier.count()
    p = source.groupBy(F.col(level).alias("s")).agg((F.count("*") / n).alias("p"))
    q = carrier.groupBy(F.col(target).alias("v")).agg((F.count("*") / m).alias("q"))
    cells = F.explode(F.array(*[F.array(*[F.struct(F.lit(v).alias("v"), F.lit(float(d)).alias("d")) for v, d in enumerate(row)]) for row in channel])[F.col("s")])
    x = p.withColumn("_c", cells).select("s", "p", "_c.v", "_c.d")
    out = x.groupBy("v").agg(F.sum(F.col("p") * F.col("d")).alias("m"))
    info = x.join(out, "v").filter("d > 0").agg(F.sum(F.col("p") * F.col("d") * F.log(F.col("d") / F.col("m"))).alias("info"))
    both = out.join(q, "v", "full_outer").na.fill({"m": 0.0, "q": 0.0})
    xlogx = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log(c)).otherwise(0.0))
    shift = both.agg(F.sum(F.when(F.col("m") > 0, F.col("m") * F.log(F.col("m") / F.nullif("q", F.lit(0.0)))).otherwise(0.0)).alias("kl"),
                     (xlogx("q") - xlogx("m")).alias("entropy_shift"))
    return info.withColumn("_j", F.lit(0)).join(shift.withColumn("_j", F.lit(0)), "_j").drop("_j")


def noisy_map(levels_in: int, levels_out: int, width: float) -> list[list[float]]:
    """Rows of a discretised Gaussian around a monotone map of the source level."""
    rows = []
    for s in range(levels_in):
        centre = (levels_out - 1) * s / (levels_in - 1)
        w = [math.exp(-0.5 * ((v - centre) / width) ** 2) for v in range(levels_out)]
        rows.append([x / sum(w) for x in w])
    return rows


def noisy_plant(df: DataFrame, tl, source: str, target: str, channel: Sequence[Sequence[float]], seed: int, lag: int = 2, out: str = "planted") -> DataFrame:
    """Target digit redrawn from the channel row of the source digit ``lag`` rows earlier; the first rows keep theirs."""
    from barloom.operators.samples import uniform
    from barloom.operators.windows import done, framed

    x = framed(df, tl, lag, 0)
    x = x.withColumn("_s", F.lag(source, lag).over(tl.by_segment())).withColumn("_u", uniform(seed, *tl.keys, tl.ts))
    cdf = []
    for row in channel:
        run, acc = [], 0.0
        for v in row:
            acc += v
            run.append(acc)
        cdf.append(F.array(*[F.lit(c) for c in run]))
    drawn = F.size(F.filter(F.array(*cdf)[F.col("_s")], lambda c: c <= F.col("_u")))
    top = len(channel[0]) - 1
    return done(x.withColumn(out, F.when(F.col("_s").isNull(), F.col(target)).otherwise(F.least(drawn, F.lit(top))))).drop("_s", "_u")


# ---- probes -----------------------------------------------------------------------------------------------------

def _fit_sign(df: DataFrame, features: Sequence[str], value: str, iters: int = 50) -> tuple[float, float]:
    """Train and validation accuracy of a logistic sign probe; one-hot digits stay sparse."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    x = df.withColumn("label", (F.col(value) > 0).cast("double"))
    stages = [OneHotEncoder(inputCols=list(features), outputCols=[f"{c}_v" for c in features], handleInvalid="keep"),
              VectorAssembler(inputCols=[f"{c}_v" for c in features], outputCol="v"),
              LogisticRegression(featuresCol="v", labelCol="label", maxIter=iters, regParam=1e-6)]
    scored = Pipeline(stages=stages).fit(x.filter("is_train")).transform(x)
    acc = {r["is_train"]: r["a"] for r in scored.groupBy("is_train").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).collect()}
    return acc.get(True, float("nan")), acc.get(False, float("nan"))


def legibility_gate(tokens: DataFrame, dims: Sequence[int], least: int = 10_000, bar: float = 0.9, levels: Sequence[int] = FSQ_LEVELS) -> DataFrame:
    """Per dimension: sign accuracy of its value from the bar's own digits; too few rows means unmeasured, a failure.

    ``tokens`` has b_c, b_f, x_*, m_* and ``is_train`` (first 80 % in time of each symbol).
    """
    x = tokens.withColumns(digit_columns(levels))
    digits = [f"digit_{i}" for i in range(len(levels))]
    base = x.agg(*[e for d in dims for e in (F.count_if(F.col(f"m_{d}") == 0).alias(f"n{d}"),
                                             F.avg(F.when(F.col(f"m_{d}") == 0, (F.col(f"x_{d}") > 0).cast("double"))).alias(f"p{d}"))]).first()
    rows = []
    for d in dims:
        n = base[f"n{d}"]
        acc = _fit_sign(x.filter(F.col(f"m_{d}") == 0).select(*digits, f"x_{d}", "is_train"), digits, f"x_{d}")[1] if n >= least else None
        rows.append((d, n, base[f"p{d}"], acc, n >= least, acc is not None and acc >= bar))
    return tokens.sparkSession.createDataFrame(rows, "dim int, n long, base_rate double, accuracy double, measured boolean, passes boolean")


def window_context_probe(tokens: DataFrame, tl, dim: int, lags: Sequence[int], levels: Sequence[int] = FSQ_LEVELS) -> DataFrame:
    """The probe with the digits of earlier bars added; it must not fit the train rows worse than the plain one."""
    from barloom.operators.windows import lagged_features
    from barloom.session import pin

    digits = [f"digit_{i}" for i in range(len(levels))]
    x = pin(lagged_features(tokens.withColumns(digit_columns(levels)), tl, digits, lags))
    wide = [*digits, *[f"{c}_lag{k}" for c in digits for k in lags]]
    x = x.na.drop(subset=wide).filter(F.col(f"m_{dim}") == 0)
    rows = []
    for name, cols in (("own", digits), ("window", wide)):
        rows.append((name, *_fit_sign(x.select(*cols, f"x_{dim}", "is_train"), cols, f"x_{dim}")))
    ok = rows[1][1] >= rows[0][1] - 0.01
    return tokens.sparkSession.createDataFrame([(n, a, b, ok) for n, a, b in rows], "probe string, train_accuracy double, accuracy double, dominates boolean")


def discriminative_score(real: DataFrame, synth: DataFrame, columns: Sequence[str], seed: int = 0) -> float:
    """Distance from a coin flip of a logistic classifier telling real rows from synthetic ones on a held-out half."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from barloom.operators.samples import uniform

    x = real.select("id", *columns).withColumn("label", F.lit(0.0)).unionByName(synth.select("id", *columns).withColumn("label", F.lit(1.0)))
    x = x.withColumn("_half", uniform(seed, "label", "id") < 0.5)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="v", withMean=True),
                             LogisticRegression(featuresCol="v", labelCol="label", maxIter=50)]).fit(x.filter("_half"))
    acc = model.transform(x.filter("not _half")).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return abs((acc or 0.5) - 0.5)


def tstr_trtr(real: DataFrame, synth: DataFrame, test: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rank correlation on real test rows of linear probes trained on real and on synthetic rows, and their ratio."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from barloom.operators.stats import rank_ic

    out = {}
    for name, train in (("trtr", real), ("tstr", synth)):
        model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="v"), LinearRegression(featuresCol="v", labelCol=target)]).fit(train)
        out[name] = rank_ic(model.transform(test).select("prediction", target), [], "prediction", target).first()["rank_ic"]
    a, b = out["trtr"], out["tstr"]
    ratio = b / a if a and b is not None and abs(a) > 1e-9 else None
    return test.sparkSession.createDataFrame([(a, b, ratio)], "trtr double, tstr double, ratio double")
