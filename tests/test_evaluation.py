"""Statistics, sampling, costs, codes and audits: published values, brute force, negative controls."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import special as Sp
from barloom.operators import evaluate as E
from barloom.operators import samples as R
from barloom.operators import stats as T
from barloom.operators import tokens as K
from barloom.operators import universe as U


@pytest.mark.parametrize("p,nu,want", [(0.95, 4, 2.131847), (0.975, 10, 2.228139), (0.8, 4, 0.940965), (0.95, 2.5, 2.558219)])
def test_t_quantiles(p, nu, want):
    assert abs(Sp.t_ppf(p, nu) - want) < 2e-5
    assert abs(Sp.t_cdf(Sp.t_ppf(p, nu), nu) - p) < 1e-9


def test_code_layout_is_the_canonical_one():
    assert K.vocab_sizes(K.FSQ_LEVELS) == (891, 1225)
    assert abs(math.log2(math.prod(K.vocab_sizes(K.FSQ_LEVELS))) - 20.06) < 0.01


def test_code_round_trip(spark):
    df = spark.range(2000).select(F.array(*[F.rand(i) * 6 - 3 for i in range(7)]).alias("z"))
    c, f = K.coarse_fine(K.FSQ_LEVELS)
    df = df.withColumn("codes", K.fsq_codes(F.col("z")))
    df = df.withColumns({"b_c": K.flatten_codes(F.col("codes"), c, K.FSQ_LEVELS), "b_f": K.flatten_codes(F.col("codes"), f, K.FSQ_LEVELS)})
    back = F.concat(K.unflatten_codes(F.col("b_c"), c, K.FSQ_LEVELS), K.unflatten_codes(F.col("b_f"), f, K.FSQ_LEVELS))
    row = df.agg(F.min((back == F.col("codes")).cast("int")), F.min("b_c"), F.max("b_c"), F.max("b_f")).first()
    assert row[0] == 1 and row[1] >= 0 and row[2] < 891 and row[3] < 1225


def test_token_outside_the_book_fails(spark):
    with pytest.raises(Exception, match="outside"):
        K.codebook_usage(spark.createDataFrame([(9,)], "t int"), [], "t", 5).collect()


def test_break_even_cases(spark):
    curves = {"cross": [3.0, 1.0, -1.0], "above": [3.0, 2.0, 1.0], "below": [-1.0, -2.0, -3.0], "exact": [1.0, 0.0, -1.0]}
    rows = [(k, c, v) for k, vs in curves.items() for c, v in zip((0.001, 0.002, 0.003), vs)]
    got = {r["run"]: r["c_break"] for r in E.break_even_cost(spark.createDataFrame(rows, "run string, cost double, ir double"), ["run"]).collect()}
    assert abs(got["cross"] - 0.0025) < 1e-12 and got["above"] == math.inf and got["below"] == -math.inf and abs(got["exact"] - 0.002) < 1e-12


def test_pairwise_correlation_by_brute_force(spark):
    rng = np.random.default_rng(0)
    wide = pd.DataFrame(rng.normal(size=(150, 9)), columns=[f"s{i}" for i in range(9)]).mask(rng.random((150, 9)) < 0.2)
    long = wide.reset_index(names="p").melt("p", var_name="k", value_name="v").dropna()
    got = T.pairwise_corr(spark.createDataFrame(long), "k", "p", "v", 50, tile=2, span=32).toPandas()
    assert len(got) == 36
    for r in got.itertuples():
        ok = wide[[r.a, r.b]].dropna()
        assert r.n == len(ok) and abs(r.rho - ok[r.a].corr(ok[r.b])) < 1e-12


def test_bootstrap_blocks_cover_the_series_length(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    boot = R.block_bootstrap(df, ["k"], "i", {"s": F.col("v")}, F.ceil(F.sqrt("t")), 40, 1, truncate=True).toPandas()
    assert len(boot) == 40 and (boot["n"] == 50).all() and np.allclose(boot["s"], 50.0)


@pytest.mark.parametrize("truncate", [True, False])
def test_bootstrap_equals_drawing_row_by_row(spark, truncate):
    rng = np.random.default_rng(3)
    series = {k: rng.normal(size=n) for k, n in (("a", 83), ("b", 300), ("c", 9))}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, i long, v double")
    got = R.block_bootstrap(df, ["k"], "i", {"s": F.col("v"), "q": F.col("v") * F.col("v")}, F.ceil(F.sqrt("t")), 30, 5, truncate, tile=32).toPandas().set_index(["k", "rep"])
    assert len(got) == 90
    for k, v in series.items():
        t = len(v)
        length = math.ceil(math.sqrt(t))
        blocks = math.ceil(t / length)
        for rep in range(30):
            rows = []
            for j in range(blocks):
                u = int(hashlib.md5(f"5:{rep}:{j}".encode()).hexdigest()[:8], 16) / 2**32
                at = math.floor(u * (t - length + 1))
                rows += list(v[at:at + (t - (blocks - 1) * length if truncate and j == blocks - 1 else length)])
            r = got.loc[(k, rep)]
            assert r["n"] == len(rows) and r["s"] == pytest.approx(sum(rows), abs=1e-9) and r["q"] == pytest.approx(sum(x * x for x in rows), abs=1e-9)


def test_short_series_is_refused(spark):
    df = spark.range(5).select(F.lit("a").alias("k"), F.col("id").alias("period"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    with pytest.raises(Exception, match="too short"):
        T.paired_delta_ir(df, ["k"], 5, 10).collect()


def test_permutation_keeps_pairs_and_moves_only_micro(spark):
    n = 500
    cols = {f"x_{d}": F.col("seg_pos") * 10.0 + d for d in range(13)} | {f"m_{d}": (F.col("seg_pos") % 7 == d % 7).cast("int") for d in range(13)}
    df = spark.range(n).select(F.lit("s").alias("symbol"), (F.col("id") % 2).alias("segment_id"), F.floor(F.col("id") / 2).alias("seg_pos")).withColumns(cols)
    out = R.block_time_permute(df, 3).toPandas()
    assert np.allclose(out["x_0"], out["seg_pos"] * 10)
    source = (out["x_7"] - 7) / 10
    assert sorted(source[out["segment_id"] == 0]) == list(range(n // 2)) and (source != out["seg_pos"]).mean() > 0.9
    assert all(np.allclose(out[f"x_{d}"], source * 10 + d) for d in range(7, 13)) and (out["m_7"] == (source % 7 == 0)).all()


def test_cap_and_draws_do_not_depend_on_layout(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("symbol"), F.col("id").alias("i"))
    a, b = (sorted(map(tuple, R.cap_per_group(df.repartition(p), ["symbol"], 30, 5, ["i"]).collect())) for p in (1, 40))
    assert a == b and max(pd.DataFrame(a).groupby(0).size()) == 30


def test_phase_surrogate_keeps_the_spectrum(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "s", "segment_id": 0, "seg_pos": range(64), "x_7": rng.normal(size=64)})
    out = R.phase_randomize(spark.createDataFrame(pdf), ["x_7"], 1).toPandas().sort_values("seg_pos")
    assert np.allclose(np.abs(np.fft.rfft(out["value"])), np.abs(np.fft.rfft(pdf["x_7"]))) and not np.allclose(out["value"], pdf["x_7"])


def test_subset_guarantees_a_delisted_symbol(spark):
    rows = [("a", 10, None), ("b", 20, None), ("c", 500, "2020-01-01")]
    got = U.select_subset(spark.createDataFrame(rows, "symbol string, size long, delisting_date string"), 100).toPandas()
    assert sorted(got["symbol"]) == ["a", "c"]


def test_subset_without_the_guarantee_is_the_prefix(spark):
    rows = [("a", 10, None), ("b", 20, None), ("c", 500, "2020-01-01")]
    got = U.select_subset(spark.createDataFrame(rows, "symbol string, size long, delisting_date string"), 100, delisted=False).toPandas()
    assert sorted(got["symbol"]) == ["a", "b"]


def test_subset_query_holds_a_delisted_symbol(spark, tmp_path):
    """The prefix of suppliers 1 and 2 has no delisted symbol: 6, the smaller of the delisted ones, takes the place of 2."""
    import datetime

    import duckdb

    import __spark_entry__ as entry

    day = lambda m: datetime.datetime(1998, m, 3)
    rows = [(1, day(6), 10_000.0), (2, day(6), 20_000.0), (5, day(1), 600_000.0), (6, day(1), 500_000.0), (8, day(6), 550_000.0)]
    li = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double").withColumn("l_extendedprice", F.lit(1.0))
    li.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, entry.queries()["select_subset"](spark, str(tmp_path)).collect()))
    assert got == [("S1USDT", 10_000_000), ("S6USDT", 500_000_000)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.execute(entry.oracle_sql()["select_subset"]).fetchall()) == got


def test_missing_spread_fails(spark):
    d = spark.createDataFrame([("a",), ("b",)], "symbol string")
    with pytest.raises(Exception, match="no spread"):
        E.attach_spread(d, spark.createDataFrame([("a", 1e-4)], "symbol string, spread double")).collect()
