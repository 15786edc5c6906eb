"""Bars, segments and features: known answers, reference recursions, layout invariance."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import SMALL
from barloom.operators import bars as B
from barloom.operators import features as X
from barloom.operators import segments as S
from barloom.operators.quality import flow_audit
from barloom.session import pin

MIN = 60_000
CFG = replace(SMALL, mad_window=24, w_tau=20, half_life_fast=16, half_life_slow=32, n_warm=6, n_warm_vol=6, vol_window=12, z_window=24,
              stale_bars=4, pool_cap=3, chunk=64)


def ticks(n=400, seed=0):
    """Two symbols, one with most of the trades; a gap, a jump and an idle stretch."""
    rng = np.random.default_rng(seed)
    rows, tid = [], 0
    for sym, bars in (("hot", n), ("cold", n // 5)):
        price = 100.0
        for b in range(bars):
            if sym == "hot" and 150 <= b < 153:
                continue
            price *= 1.8 if (sym == "hot" and b == 250) else math.exp(rng.normal(0, 0.002))
            for _ in range(rng.integers(1, 9)):
                rows.append((sym, b * MIN + int(rng.integers(0, MIN)), tid, price * math.exp(rng.normal(0, 0.001)), float(rng.integers(1, 50)), bool(rng.integers(0, 2))))
                tid += 1
    return pd.DataFrame(rows, columns=["symbol", "ts_ms", "trade_id", "price", "quantity", "is_buyer_maker"])


@pytest.fixture(scope="module")
def tape(spark):
    return pin(spark.createDataFrame(ticks()))


@pytest.fixture(scope="module")
def bars(spark, tape):
    return pin(B.attach_trades(B.klines_from_trades(tape), B.reduce_trades(tape)))


def test_reduce_trades_known_answer(spark):
    df = spark.createDataFrame([("s", 1_000, 1, 10.0, 2.0, False), ("s", 2_000, 2, 11.0, 3.0, True), ("s", 61_000, 3, 12.0, 5.0, True)],
                               "symbol string, ts_ms long, trade_id long, price double, quantity double, is_buyer_maker boolean")
    got = {r["bar_open_ms"]: r for r in B.reduce_trades(df).collect()}
    assert (got[0]["v_buy"], got[0]["v_sell"], got[0]["n_buy"], got[0]["n_sell"], got[0]["size_std"]) == (2.0, 3.0, 1, 1, 0.5)
    assert (got[MIN]["v_buy"], got[MIN]["v_sell"], got[MIN]["n_trades"]) == (0.0, 5.0, 1)
    spine = spark.createDataFrame([("s", 0), ("s", 2 * MIN)], "symbol string, bar_open_ms long")
    empty = B.attach_trades(spine, B.reduce_trades(df)).filter(f"bar_open_ms = {2 * MIN}").first()
    assert (empty["n_trades"], empty["v_agg"]) == (0, 0.0)


def test_segments_known_answer(spark):
    rows = [("s", i * MIN, c) for i, c in ((0, 10.0), (1, 10.1), (5, 10.2), (6, 18.0), (7, 18.1))]
    df = spark.createDataFrame(rows, "symbol string, bar_open_ms long, close double")
    for chunk in (1, 2, 64):
        got = S.assign_segments(df, replace(CFG, chunk=chunk)).orderBy("bar_open_ms").collect()
        assert [r["segment_id"] for r in got] == [0, 0, 1, 2, 2]
        assert [r["seg_pos"] for r in got] == [0, 1, 0, 0, 1]
        assert [r["row_idx"] for r in got] == [0, 1, 2, 3, 4]


def test_zscore_equals_the_recursion(bars):
    df = S.with_segments(bars, CFG, 1).withColumn("ret", X.log_return(CFG)).filter("_core")
    got = X.ewma_zscores(pin(df), CFG, {"z": ("ret", 16)}, vol="ret").toPandas().sort_values(["symbol", "bar_open_ms"])
    a, lam = CFG.alpha(16), CFG.lam
    for _, seg in got.groupby(["symbol", "segment_id"]):
        mu = var = s = 0.0
        for i, r in enumerate(seg.itertuples()):
            f = r.ret
            z = 0.0 if i < max(CFG.warm(16), 1) else max(-5, min(5, (f - mu) / math.sqrt(var + 1e-8)))
            if i == 0:
                mu, var = f, 0.0
            else:
                d = f - mu
                mu, var = mu + a * d, (1 - a) * (var + a * d * d)
            s = lam * s + (1 - lam) * f * f
            assert abs(r.z - z) < 1e-7 and abs(r.sigma - math.sqrt(s + 1e-8)) < 1e-10


def test_wick_thresholds_and_tau_by_brute_force(bars, tape):
    seg = S.assign_segments(bars, CFG).toPandas().sort_values(["symbol", "bar_open_ms"])
    mad = X.trailing_mad(bars, CFG).toPandas().set_index(X.KEY)["mad"]
    tau = X.trailing_tau(bars, tape, CFG).toPandas().set_index(X.KEY)["tau"]
    sizes = ticks().assign(b=lambda d: d["ts_ms"] // MIN * MIN).groupby(["symbol", "b"])["quantity"].apply(lambda v: np.sort(v.to_numpy()))
    for (sym, _), g in seg.groupby(["symbol", "segment_id"]):
        close, ts = g["close"].to_numpy(), g["bar_open_ms"].to_numpy()
        r = np.concatenate([[0.0], np.log(close[1:] / close[:-1])])
        for p in range(len(g)):
            past = r[max(0, p - CFG.mad_window):p]
            have = mad.get((sym, ts[p]))
            if len(past) < CFG.mad_min:
                assert have is None or np.isnan(have)
            else:
                assert abs(have - np.median(np.abs(past - np.median(past)))) < 1e-12
            if p >= CFG.w_tau:
                pool = [s if len(s) <= CFG.pool_cap else s[np.linspace(0, len(s) - 1, CFG.pool_cap).round().astype(int)]
                        for s in (sizes.get((sym, t), np.empty(0)) for t in ts[p - CFG.w_tau:p])]
                assert abs(tau[(sym, ts[p])] - np.percentile(np.concatenate(pool), 90)) < 1e-9


def test_features_do_not_depend_on_layout(bars, tape):
    def run(chunk, parts):
        cfg = replace(CFG, chunk=chunk)
        out = X.compute_features(bars.repartition(parts), cfg, tape).toPandas()
        return out.sort_values(["symbol", "bar_open_ms"]).reset_index(drop=True)

    a, b = run(64, 3), run(512, 50)
    num = [c for c in a.columns if c not in ("symbol", "target_valid")]
    assert np.allclose(a[num].astype(float), b[num].astype(float), atol=1e-9, equal_nan=True)
    assert (a["target_valid"] == b["target_valid"]).all()
    assert set(a["dq_flags"] % 8 // 4) == {0, 1}  # the planted jump is a structural start


def test_flow_audit_passes_and_can_fail(bars, tape):
    x = bars.withColumns({"x_7": (F.col("v_buy") - F.col("v_sell")) / (F.col("v_agg") + 1e-9),
                          "x_8": (F.col("n_buy") - F.col("n_sell")) / (F.col("n_trades") + 1e-9)})
    assert all(r["passes"] for r in flow_audit(x, tape, MIN).collect())
    shifted = x.withColumn("bar_open_ms", F.col("bar_open_ms") + MIN)
    assert not any(r["passes"] for r in flow_audit(shifted, tape, MIN).collect())


def test_non_finite_features_fail_loudly(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x_0 double")
    with pytest.raises(Exception, match="non-finite"):
        X.guard_finite(df, ["x_0"]).collect()


def test_missing_and_non_finite_values_are_refused(spark):
    from barloom.functions.scalars import clip_finite, log_ratio

    rows = [(1, 1.0, None), (2, 2.0, 3.0), (3, 0.0, 9.0), (4, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r["k"]: (r["c"], r["l"]) for r in df.select("k", clip_finite("b").alias("c"), log_ratio("a", "b").alias("l")).collect()}
    assert got[1][0] != got[1][0] and got[1][1] is None and got[2][0] == 3.0 and got[3][0] == 5.0
    assert got[4][0] != got[4][0] and got[3][1] != got[3][1]
    for bad in ("k = 1", "k = 4"):
        with pytest.raises(Exception, match="non-finite"):
            X.guard_finite(df.filter(bad), ["a", "b"]).select("k").collect()  # the bad column is not selected
    assert X.guard_finite(df.filter("k = 2"), ["a", "b"]).count() == 1


def test_zero_close_gives_nan_returns(spark):
    from barloom.config import FeatureConfig
    from barloom.operators.segments import local_segments

    cfg = FeatureConfig(bar_ms=1, chunk=8, structural=50.0)
    bars = spark.createDataFrame([("s", t, c) for t, c in enumerate([5.0, 0.0, 5.0, 10.0])], "symbol string, bar_open_ms long, close double")
    r = [x["r"] for x in local_segments(bars, cfg, 2).select("bar_open_ms", X.log_return(cfg).alias("r")).orderBy("bar_open_ms").collect()]
    assert r[0] == 0.0 and r[3] == pytest.approx(0.6931, abs=1e-4) and r[1] != r[1]


def test_hash_text_tells_rows_apart(spark):
    from barloom.operators.hashing import canonical_json, row_text

    df = spark.createDataFrame([("x", None, "y"), ("x", "y", None), ("x|y", "", ""), ("x", "y|", ""), ("é😀", None, "q")], "a string, b string, c string")
    got = df.select(row_text(["a", "b", "c"]).alias("t"), canonical_json(["a", "b", "c"]).alias("j")).collect()
    assert len({r["t"] for r in got}) == 5
    assert got[4]["j"] == '{"a":"\\u00e9\\ud83d\\ude00","b":null,"c":"q"}' and got[0]["j"] == '{"a":"x","b":null,"c":"y"}'


def test_repeated_bars_stay_as_many(spark):
    from barloom.operators.bars import asof_ffill
    from barloom.frames import Timeline

    bars = spark.createDataFrame([("s", 10)] * 3 + [("s", 20)], "symbol string, bar_open_ms long")
    marks = spark.createDataFrame([("s", 5, 1.5)], "symbol string, ts_ms long, value double")
    assert asof_ffill(bars, marks, "funding", Timeline(step=10, chunk=4)).count() == 4


def test_repeated_bars_fail_the_job(bars, tape):
    from barloom.plans.build import build_features

    good = build_features(tape, bars.select("symbol", "bar_open_ms", "open", "high", "low", "close", "v_kline", "quote_volume"), CFG)
    assert good.count() == bars.count()
    twice = bars.select("symbol", "bar_open_ms", "open", "high", "low", "close", "v_kline", "quote_volume")
    twice = twice.unionByName(twice.filter("symbol = 'cold' and bar_open_ms = 600000"))
    with pytest.raises(Exception, match="times repeat: cold 600000"):
        build_features(tape, twice, CFG).select("symbol").collect()  # the checked columns are not selected


def test_marks_of_several_series_and_ties(spark):
    from barloom.frames import Timeline

    bars = spark.createDataFrame([("s", t, t < 40) for t in (10, 20, 30, 40, 50)] + [("z", 10, True)], "symbol string, bar_open_ms long, is_perp boolean")
    funding = spark.createDataFrame([("s", 15, 1.0, 1), ("s", 25, 5.0, 2), ("s", 25, 3.0, 3), ("s", 41, None, 4)], "symbol string, ts_ms long, value double, seq long")
    oi = spark.createDataFrame([("s", 30, 7.0), ("s", 30, 9.0), ("q", 1, 2.0)], "symbol string, ts_ms long, value double")
    for chunk in (1, 2, 64):
        got = {(r["symbol"], r["bar_open_ms"]): (r["funding"], r["funding_missing"], r["oi"], r["oi_missing"])
               for r in B.asof_marks(bars, {"funding": funding, "oi": oi}, Timeline(step=10, chunk=chunk)).collect()}
        assert got[("s", 10)] == (1.0, 0, 0.0, 1)  # a mark on the way to the close counts, one at the next close does not
        assert got[("s", 20)] == (3.0, 0, 9.0, 0)  # the last to arrive wins; without an order the largest
        assert got[("s", 30)] == (3.0, 0, 9.0, 0)
        assert got[("s", 40)] == (0.0, 1, 0.0, 1)  # no perpetual
        assert got[("z", 10)] == (0.0, 1, 0.0, 1)


def test_audit_meets_every_bar_and_catches_a_lost_one(spark, tape, bars):
    from barloom.operators import leakage as L

    cfg = replace(CFG, mad_window=6, w_tau=5, half_life_fast=4, half_life_slow=6, n_warm=3, n_warm_vol=3, vol_window=4, z_window=6, chunk=32)
    some = (F.col("symbol") == "hot") & (F.col("bar_open_ms") < 60 * MIN)
    none = spark.createDataFrame([("hot", 5 * MIN, 1.0)], "symbol string, ts_ms long, value double")
    t = L.Tape(bars.filter(some).select("symbol", "bar_open_ms", "open", "high", "low", "close", "v_kline", "quote_volume"),
               tape.filter("symbol = 'hot' and ts_ms < 3600000"), none, none).pinned()
    sl = L.Slices(16, 12, 3)
    got = {r["output"]: r for r in L.audit(t, cfg, sl).collect()}
    assert all(r["n_checks"] == 60 and r["n_failures"] == 0 and r["n_anchors"] == r["n_bars"] == 60 for r in got.values()) and len(got) == len(L.OUTPUTS)

    def forgetful(replayed, c):  # the replays of one bar come back without it
        return L.feature_pipeline(replayed, c).filter(~F.col("symbol").endswith(f"@{20 * MIN}") | (F.col("bar_open_ms") != 20 * MIN))

    lost = {r["output"]: r for r in L.audit(t, cfg, sl, pipeline=forgetful, outputs={"x_0": 0, "target": 1}).collect()}
    assert lost["x_0"]["n_failures"] == 1 and lost["x_0"]["n_anchors"] == 59 and lost["target"]["n_failures"] == 0
    with pytest.raises(Exception, match="does not cover"):
        L.assert_covered(L.audit(t, cfg, sl, pipeline=forgetful, outputs={"x_0": 0})).collect()
    at = 13 * MIN
    flagged = L.caught_leaks(t, cfg, sl, {"sigma_next": at}).first()
    assert flagged["n_failures"] > 0 and "sigma" in flagged["outputs"]


def test_a_low_of_zero_scores_the_bound(spark):
    """An infinite range scores 5, so do the later rows whose past holds it, in other chunks too; the job does not fail."""
    cfg = replace(CFG, bar_ms=1, chunk=16, structural=50.0, n_warm=2, half_life_fast=4, half_life_slow=4, z_window=6, vol_window=4, n_warm_vol=2, mad_window=4)
    rows = [("s", t, 10.0, 11.0 + t % 3, 0.0 if t in (0, 60) else 9.0, 10.0, 5.0, 50.0) for t in [*range(10), *range(50, 80)]]
    bars = spark.createDataFrame(rows, "symbol string, bar_open_ms long, open double, high double, low double, close double, v_kline double, quote_volume double")
    flow = B.reduce_trades(spark.createDataFrame([("s", 0, 1, 10.0, 2.0, False)], "symbol string, ts_ms long, trade_id long, price double, quantity double, is_buyer_maker boolean"), 1)
    bars = B.attach_trades(bars, flow)
    got = {r["bar_open_ms"]: r for r in X.guard_finite(X.compute_features(bars, cfg), [f"x_{d}" for d in range(16)]).collect()}
    assert len(got) == len(rows) and got[60]["raw_range"] == math.inf
    assert {got[t]["x_1"] for t in [*range(2, 10), *range(60, 80)]} == {5.0} and abs(got[59]["x_1"]) < 5
    rolling = {r["bar_open_ms"]: r["x_1"] for r in X.compute_features(bars, replace(cfg, estimator="rolling")).collect()}
    assert {rolling[t] for t in range(60, 67)} == {5.0} and all(abs(rolling[t]) < 5 for t in [*range(52, 60), *range(67, 80)])


def test_audits_stand_zero_prices_and_reduce_ticks_once(spark, tape, bars):
    """Every mode passes on a tape with a low of zero, and a source's ticks count for every replay that holds it as its own would."""
    from barloom.operators import leakage as L

    cfg = replace(CFG, mad_window=6, w_tau=5, half_life_fast=4, half_life_slow=6, n_warm=3, n_warm_vol=3, vol_window=4, z_window=6, chunk=32)
    k = bars.filter((F.col("symbol") == "hot") & (F.col("bar_open_ms") < 40 * MIN)).select("symbol", "bar_open_ms", "open", "high", "low", "close", "v_kline", "quote_volume")
    k = k.withColumn("low", F.when(F.col("bar_open_ms") == 25 * MIN, 0.0).otherwise(F.col("low")))
    marks = spark.createDataFrame([("hot", t * MIN // 2, float(t)) for t in range(80)], "symbol string, ts_ms long, value double")
    ticks_ = tape.filter(f"symbol = 'hot' and ts_ms < {40 * MIN}")
    t, sl = L.Tape(k, ticks_, marks, marks).pinned(), L.Slices(16, 12, 3)
    for mode in ("noise", "signflip"):
        assert all(r["n_checks"] == 40 and r["n_failures"] == 0 for r in L.audit(t, cfg, sl, mode=mode).collect())
    cuts = L._cuts(k.select("symbol", "bar_open_ms"), t, sl, MIN)
    made = L.replays(t, cuts, sl, MIN)
    assert made.trades.count() == ticks_.count()  # as many as there are, not once a replay
    whole = made.sources.join(made.trades.withColumnRenamed("symbol", "source"), "source").drop("source")
    got, want = (sorted(map(tuple, x.select("symbol", "bar_open_ms", "n_large").collect())) for x in (
        X.large_trades(made.klines, made.trades, cfg, made.sources), X.large_trades(made.klines, whole, cfg)))
    assert got == want and len(got) > 40


def _hours(spark, n):
    """Hourly bars, ticks and marks of one symbol."""
    from barloom.operators import leakage as L

    h = 3_600_000
    rows = [("s", i * h, 10.0, 12.0 + i % 5, 8.0 - i % 3, 10.0 + math.sin(i), 5.0, 50.0) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, bar_open_ms long, open double, high double, low double, close double, v_kline double, quote_volume double")
    ticks_ = spark.createDataFrame([("s", i * h + 7, i, 10.0, 2.0 + i % 4, i % 2 == 0) for i in range(n)],
                                   "symbol string, ts_ms long, trade_id long, price double, quantity double, is_buyer_maker boolean")
    marks = spark.createDataFrame([("s", i * h, float(i)) for i in range(0, n, 5)], "symbol string, ts_ms long, value double")
    return L.Tape(bars, ticks_, marks, marks).pinned()


def test_audit_queries_see_far_look_aheads_and_long_histories(spark):
    """A leak of 40 bars ahead, and one that acts only where 30 bars lie before it, are both seen at every bar they touch."""
    from pyspark.sql import Window

    from barloom.operators import leakage as L
    from barloom.workload.leakage_queries import SLICES
    from barloom.workload.views import HCFG

    w = Window.partitionBy("symbol").orderBy("bar_open_ms")
    t = _hours(spark, 72)

    def leaky(replayed, c):
        return replayed.klines.select("symbol", "bar_open_ms", F.lead("close", 40).over(w).alias("far"), F.count("*").over(w).alias("n"),
                                      F.when(F.row_number().over(w) > 30, F.lead("close").over(w)).alias("late"))

    for mode in L.MODES:
        got = {r["output"]: r for r in L.audit(t, HCFG, SLICES, mode=mode, outputs={"far": 0, "late": 0, "n": 0}, pipeline=leaky).collect()}
        assert {r["n_checks"] for r in got.values()} == {72} and got["n"]["n_failures"] == 0
        if mode != "revert":  # replaces three bars only
            assert got["far"]["n_failures"] == 32
        assert got["late"]["n_failures"] == (41 if mode == "truncate" else got["late"]["n_failures"]) > 0
    clean = L.audit(t, HCFG, SLICES).collect()
    assert all(r["n_failures"] == 0 and r["n_checks"] == r["n_anchors"] == 72 for r in clean) and len(clean) == len(L.OUTPUTS)
    cuts = L._cuts(t.klines.select("symbol", "bar_open_ms"), t, SLICES, HCFG.bar_ms)
    made = L.replays(t, cuts, SLICES, HCFG.bar_ms).klines
    assert cuts.count() == 74 and made.count() == sum(range(1, 73)) + 2 * 72  # 73 cuts and one baseline


def test_tokens_hold_every_feature(spark):
    """A change of any one feature changes the token, next to a feature that is no number too."""
    from barloom.workload.leakage_queries import _tokens

    names = ["i", *[f"x_{d}" for d in range(16)]]
    rows = [[-1] + [0.0] * 16, *[[d] + [2.0 if k == d else 0.0 for k in range(16)] for d in range(16)]]
    rows += [[99] + [float("nan")] + [0.0] * 15, [100] + [float("nan")] + [0.0] * 14 + [2.0]]
    got = [str(r["token"]) for r in _tokens(spark.createDataFrame(rows, names)).collect()]
    assert len(set(got)) == 19


def test_a_latent_that_is_no_number_has_no_code(spark):
    from barloom.operators.tokens import fsq_codes

    df = spark.createDataFrame([([float("nan"), 0.0],)], "z array<double>")
    assert df.select(fsq_codes(F.col("z"), [9, 7]).alias("c")).first()["c"] == [None, 3]
