"""Chunked windows against plain pandas, over several chunk sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.frames import (
    LSEG, Term, Timeline, affine_scan, average_ranks, exact_quantiles, global_rank, last_known, row_index, running_sums, value_ranks,
    with_chunks,
)


def series(seed=0, n=300, keys=("a", "b")):
    """A hot key with gaps and a small one."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, size in zip(keys, (n, n // 10)):
        t = np.sort(rng.choice(n * 2, size=size, replace=False))
        rows += [(k, int(x) * 10, float(v)) for x, v in zip(t, rng.normal(size=size))]
    return pd.DataFrame(rows, columns=["symbol", "ts", "v"])


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_row_index_and_running_sum(spark, chunk):
    pdf = series()
    tl = Timeline(("symbol",), "ts", 10, chunk)
    df = spark.createDataFrame(pdf).repartition(7)
    idx = row_index(df, tl).toPandas().sort_values(["symbol", "ts"])
    assert (idx["row_idx"].to_numpy() == pdf.groupby("symbol").cumcount().to_numpy()).all()
    sums = running_sums(df, tl, {"s": F.col("v")}).toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(sums["s"], pdf.groupby("symbol")["v"].cumsum())


@pytest.mark.parametrize("chunk", [4, 1000])
def test_last_known_crosses_chunks(spark, chunk):
    pdf = series(1)
    pdf["v"] = pdf["v"].where(pdf["v"] > 1.0)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = last_known(df, Timeline(("symbol",), "ts", 10, chunk), ["ts"], ["v"]).toPandas().sort_values(["symbol", "ts"])
    want = pdf.groupby("symbol")["v"].ffill()
    assert np.allclose(got["v"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("chunk", [3, 17, 500])
def test_affine_scan_equals_the_recursion(spark, chunk):
    pdf = series(2)
    pdf["_brk"] = (pdf.groupby("symbol")["ts"].diff().fillna(99) > 20).astype(int)
    a = 0.9
    want, lagged, s, prev = [], [], 0.0, None
    for r in pdf.itertuples():
        if r._asdict().get("_4", r[4]) == 1 or r.symbol != prev:
            s = 0.0
        lagged.append(s)
        s = a * s + r.v
        want.append(s)
        prev = r.symbol
    tl = Timeline(("symbol",), "ts", 10, chunk)
    df = with_chunks(spark.createDataFrame(pdf), tl)
    df = df.withColumn(LSEG, F.expr("sum(_brk) over (partition by symbol, _chunk order by ts)"))
    out = affine_scan(df, tl, {"s": Term(a, "v"), "p": Term(a, "v", True)}).toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(out["s"], want, atol=1e-12)
    assert np.allclose(out["p"], lagged, atol=1e-12)


def test_too_long_chunk_is_refused(spark):
    df = with_chunks(spark.createDataFrame(series()), Timeline(("symbol",), "ts", 10, 10_000))
    with pytest.raises(ValueError, match="too long"):
        affine_scan(df, Timeline(("symbol",), "ts", 10, 10_000), {"s": Term(0.5, "v")})


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["x"] * 900 + ["y"] * 100, "v": np.round(rng.normal(size=1000), 1)})
    df = spark.createDataFrame(pdf)
    got = value_ranks(df, ["k"], "v", buckets=8).toPandas()
    for r in got.itertuples():
        of = pdf.loc[pdf["k"] == r.k, "v"]
        assert (r.n, r.below, r.total) == ((of == r.v).sum(), (of < r.v).sum(), len(of))
    q = exact_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).toPandas().set_index("k")
    for k, of in pdf.groupby("k")["v"]:
        assert np.allclose(q.loc[k, ["p10", "p50", "p90"]].astype(float), np.percentile(of, [10, 50, 90]))


def test_global_rank_without_one_big_window(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(500), "v": rng.integers(0, 40, size=500), "w": rng.integers(1, 9, size=500)})
    got = global_rank(spark.createDataFrame(pdf), "v", ["id"], weight="w", buckets=8).toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["running"].tolist() == want["w"].cumsum().tolist()


@pytest.mark.parametrize("keys", [["k"], []])
def test_average_ranks_of_ties_that_span_ranges(spark, keys):
    rng = np.random.default_rng(5)
    v = np.where(rng.random(2000) < 0.5, 3.0, rng.integers(0, 9, size=2000)).astype(float)
    pdf = pd.DataFrame({"id": range(2000), "k": np.where(rng.random(2000) < 0.8, "hot", "cold"), "v": v})
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all ranges apart
    try:
        df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 50 > 0, F.col("v")))
        got = average_ranks(df, keys, "v").toPandas().set_index("id")["rank"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    held = pdf[pdf["id"] % 50 > 0].set_index("id")
    want = (held.groupby("k")["v"] if keys else held["v"]).rank(method="average")
    assert len(got) == len(want) and np.array_equal(got.sort_index(), want.sort_index())


def test_lag_products_and_effective_n(spark):
    from barloom.operators.windows import effective_n, lag_products

    rng = np.random.default_rng(6)
    rows, series_of = [], {}
    for k, n, a in (("hot", 700, 0.97), ("cold", 60, 0.5), ("flat", 9, 0.0), ("two", 2, 0.0)):
        v = np.zeros(n)
        for i in range(1, n):
            v[i] = a * v[i - 1] + (rng.normal() if k != "flat" else 0.0)
        series_of[k] = v
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol string, row_idx long, v double").repartition(5)
    for block in (50, 1000):
        got = {(r["symbol"], r["lag"]): r["s"] for r in lag_products(df, ["symbol"], "row_idx", "v", 40, block).collect()}
        for k, v in series_of.items():
            assert all(abs(got[k, lag] - float(v[:len(v) - lag] @ v[lag:] if lag < len(v) else 0.0)) < 1e-8 for lag in range(41))
    got = {r["symbol"]: r for r in effective_n(df, ["symbol"], "v", max_lag=300, block=300).collect()}
    for k, v in series_of.items():
        n, d, acc, used = len(v), v - v.mean(), 0.0, 0
        if d @ d > 0:
            for lag in range(1, min(n, 301)):
                rho = float(d[:n - lag] @ d[lag:]) / float(d @ d)
                if abs(rho) < 1.96 / n**0.5:
                    break
                acc, used = acc + (1 - lag / n) * rho, used + 1
        want = n if n < 3 or d @ d == 0 or 1 + 2 * acc <= 0 else min(n, n / (1 + 2 * acc))
        assert got[k]["n_eff"] == pytest.approx(want, rel=1e-9) and (d @ d == 0 or got[k]["lags_used"] == used)
