"""Stateful streams: order of arrival, idle keys, restarts."""

from barloom.streaming import live as St


def test_last_mark_in_any_order_of_arrival(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bars = "symbol string, bar_open_ms long, t long"
    marks = "symbol string, t long, seq long, value double"
    runs = [
        ([("a", 900, 1000), ("a", 1900, 2000)], [("a", 1500, 2, 7.0), ("a", 500, 1, 5.0), ("b", 100, 1, 9.0)]),
        # a mark of 1200 comes after one of 1500 and before the watermark has passed 2000; two marks of one time
        ([("a", 2900, 3000), ("a", 3900, 9000)], [("a", 1200, 3, 6.0), ("a", 2500, 5, 8.0), ("a", 2500, 4, 1.0)]),
        ([("b", 59_000, 60_000), ("a", 59_500, 60_500)], [("a", 61_000, 6, 2.0)]),
        ([("b", 99_000, 100_000), ("a", 89_000, 90_000)], []),
        ([("c", 1, 200_000)], []),
    ]
    for i, (b, m) in enumerate(runs):
        spark.createDataFrame(b, bars).write.mode("append").parquet(str(tmp_path / "bars"))
        spark.createDataFrame(m, marks).write.mode("append").parquet(str(tmp_path / "marks"))
        streams = [spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in (("bars", bars), ("marks", marks))]
        out = St.run_to_parquet(St.last_mark_in_stream(*streams, "2 seconds", 30_000), str(tmp_path / "out"), str(tmp_path / "state"))
        if i == 0:
            assert out.count() == 0  # the watermark has not passed any bar
    got = {(r["symbol"], r["t"]): (r["value"], r["mark_t"], r["missing"]) for r in out.collect()}
    assert got == {
        ("a", 1000): (5.0, 500, 0), ("a", 2000): (7.0, 1500, 0), ("a", 3000): (8.0, 2500, 0), ("a", 9000): (8.0, 2500, 0),
        ("b", 60_000): (0.0, None, 1),  # idle for longer than 30 seconds: forgotten
        ("a", 60_500): (0.0, None, 1), ("a", 90_000): (2.0, 61_000, 0), ("b", 100_000): (0.0, None, 1)}


def test_funding_pairs_meet_once_across_slots(spark, tmp_path):
    """Pairs in one slot, over a slot's edge, at the same time and exactly an interval apart (not a pair); slots are part of the join's key."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, times in (("bars", [3500, 3600, 7199, 7300]), ("marks", [10, 3500, 3599, 3600, 7200])):
        spark.createDataFrame([("a", t) for t in times], "symbol string, s long").write.parquet(str(tmp_path / name))
    b, m = (spark.readStream.schema("symbol string, s long").parquet(str(tmp_path / n)) for n in ("bars", "marks"))
    joined = St.funding_in_stream(b.select("symbol", F.timestamp_seconds("s").alias("bar_time")), m.select("symbol", F.timestamp_seconds("s").alias("mark_time"), F.lit(1.0).alias("value")), "1 hour", "2 hours")
    assert "slot" in joined._jdf.queryExecution().analyzed().toString()
    out = St.run_to_parquet(joined, str(tmp_path / "out"), str(tmp_path / "state")).filter("mark_time is not null")
    got = sorted(map(tuple, out.select(F.unix_seconds("bar_time"), F.unix_seconds("mark_time")).collect()))
    assert got == sorted((x, y) for x in (3500, 3600, 7199, 7300) for y in (10, 3500, 3599, 3600, 7200) if x - 3600 < y <= x)


def test_funding_sums_are_the_pairs_summed(spark, tmp_path):
    """Three micro-batches in any order: null, NaN and infinite values, many marks of one time, a bar before its marks; no pair is made."""
    import math

    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    runs = [
        ([("a", 3500), ("a", 7199), ("b", 50)], [("a", 10, 1.0), ("a", 3500, None), ("c", 5, 1.0), (None, 5, 1.0)]),
        ([("a", 3600), ("a", 7300), ("b", 90)], [("a", 3599, 2.0), ("a", 3600, 1e300), ("b", 60, math.inf), *[("a", 7200, 0.5)] * 40]),
        ([("a", 10_900), (None, 5)], [("a", 3599, 4.0), ("a", 7290, 8.0), ("b", 50, -math.inf), ("b", 95, math.nan), ("a", 7301, 16.0)]),
    ]
    for b, m in runs:
        spark.createDataFrame(b, "symbol string, s long").coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
        spark.createDataFrame(m, "symbol string, s long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "marks"))
        x, y = (spark.readStream.schema(k).parquet(str(tmp_path / n)) for n, k in (("bars", "symbol string, s long"), ("marks", "symbol string, s long, value double")))
        summed = St.funding_sums_in_stream(x.select("symbol", F.timestamp_seconds("s").alias("bar_time")), y.select("symbol", F.timestamp_seconds("s").alias("mark_time"), "value"),
                                           3_600_000, "10 hours")
        out = St.run_to_parquet(summed, str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() <= 2 * sum(len(b) for b, _ in runs)
    total = out.groupBy("symbol", F.unix_seconds("bar_time").alias("s")).agg(F.sum("n"), F.sum("n_valued"), F.sum("value"))
    got = {(r[0], r[1]): tuple(r[2:]) for r in total.collect()}
    marks = [m for _, ms in runs for m in ms]
    want = {}
    for symbol, t in [b for bs, _ in runs for b in bs if b[0]]:
        met = [v for s, u, v in marks if s == symbol and t - 3600 < u <= t]
        valued = [v for v in met if v is not None]
        want[symbol, t] = (len(met), len(valued), sum(valued) if valued else None)
    assert repr(sorted(got.items())) == repr(sorted(want.items()))


def test_funding_sums_forget_closed_slots(spark, tmp_path):
    """A mark that the watermark has passed is dropped, as by the join of both streams."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    runs = [([("a", 1000)], [("a", 900)]), ([("a", 90_000)], [("a", 90_000)]), ([("a", 90_010)], [("a", 950), ("a", 90_005)])]
    got = []
    for b, m in runs:
        for name, rows in (("bars", b), ("marks", m)):
            spark.createDataFrame(rows, "symbol string, s long").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        x, y = (spark.readStream.schema("symbol string, s long").parquet(str(tmp_path / n)) for n in ("bars", "marks"))
        out = St.run_to_parquet(St.funding_sums_in_stream(x.select("symbol", F.timestamp_seconds("s").alias("bar_time")), y.select("symbol", F.timestamp_seconds("s").alias("mark_time"),
                                                          F.lit(1.0).alias("value")), 3_600_000, "2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
        got.append(sorted((r["n"], r["value"]) for r in out.collect()))
    assert got == [[(1, 1.0)], [(1, 1.0), (1, 1.0)], [(1, 1.0), (1, 1.0), (2, 2.0)]]
