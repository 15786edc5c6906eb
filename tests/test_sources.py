"""Files in and out, refusals and resume."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from barloom.sources import files as Fl
from barloom.sources import lake as Lk
from barloom.sources.schemas import KLINES

LINE = "{t},1.0,2.0,0.5,1.5,10,{t},15,3,4,5,0\n"


def test_zipped_bars_with_and_without_header(spark, tmp_path):
    for month, head in (("2021-01", ""), ("2021-02", ",".join(KLINES.names) + "\n")):
        folder = tmp_path / "symbol=AAA"
        folder.mkdir(exist_ok=True)
        with zipfile.ZipFile(folder / f"AAA-{month}.zip", "w") as z:
            z.writestr(f"AAA-{month}.csv", head + "".join(LINE.format(t=i * 60_000) for i in range(50)))
    out = Fl.read_klines(spark, str(tmp_path), zipped=True)
    assert out.count() == 100 and out.select("symbol").distinct().first()[0] == "AAA"


def test_user_csv_with_bom_and_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Date,O,H,L,C,V\n2023-11-14T22:13:20Z,1,2,0.5,1.5,10\n2023-11-14T22:13:20-05:00,1,2,0.5,bad,10\n", encoding="utf-8")
    rows = Fl.read_ohlcv_csv(spark, str(tmp_path / "a.csv")).orderBy("ts_ms").collect()
    assert rows[1]["ts_ms"] - rows[0]["ts_ms"] == 5 * 3_600_000
    assert rows[0]["amount"] == 15.0 and rows[1]["close"] is None


def test_user_csv_without_close_is_refused(spark, tmp_path):
    (tmp_path / "b.csv").write_text("timestamp,open,high,low\n1,2,3,4\n")
    with pytest.raises(ValueError, match="missing columns"):
        Fl.read_ohlcv_csv(spark, str(tmp_path / "b.csv"))


def test_user_files_with_many_headers_are_one_plan(spark, tmp_path):
    (tmp_path / "u" / "deep").mkdir(parents=True)
    (tmp_path / "u" / "a.csv").write_text("\ufeffTimestamp,Open,High,Low,Close,Volume,Amount\n1700000000,1,2,0.5,1.5,10,99\n\n1700000060,1,2,0.5,oops,10,\n")
    (tmp_path / "u" / "deep" / "b.csv").write_text('\n C , O ,H,L,V,"Date"\n 2.5 ,1,3,0.5,4,"2023-11-14T22:13:20Z"\n')
    (tmp_path / "u" / "c.csv").write_text("date,open,high,low,close\n1700000000000,7,8,6,7.5\n")
    (tmp_path / "u" / "blank.csv").write_text("\n\n")
    got = {(r["file"].rpartition("/")[2], r["ts_ms"]): (r["close"], r["volume"], r["amount"]) for r in Fl.read_ohlcv_csv(spark, str(tmp_path / "u")).collect()}
    assert got == {("a.csv", 1700000000000): (1.5, 10.0, 99.0), ("a.csv", 1700000060000): (None, 10.0, None), ("b.csv", 1700000000000): (2.5, 4.0, 10.0), ("c.csv", 1700000000000): (7.5, None, None)}


def test_inventory_names_every_problem(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n, text in (("a", "1"), ("b", "22"), ("c", "333"), ("x", "4")):
        (tmp_path / "d" / n).write_text(text)
    inv = Fl.inventory(spark, str(tmp_path)).cache()
    m = inv.filter("path <> 'd/x'").withColumn("size", F.when(F.col("path") == "d/b", 9).otherwise(F.col("size"))).withColumn(
        "sha256", F.when(F.col("path") == "d/c", "0").otherwise(F.col("sha256")))
    m = m.unionByName(m.limit(1).withColumn("path", F.lit("d/gone")))
    got = {r["path"]: r["status"] for r in Fl.verify_inventory(inv, m).collect()}
    assert got == {"d/b": "SHORT", "d/c": "CONTENT MISMATCH", "d/gone": "MISSING", "d/x": "EXTRA"}


def test_shards_keep_bars_that_reach_into_the_next_month(spark, tmp_path):
    from barloom.operators.bars import reduce_trades

    week, day = 7 * 86_400_000, 86_400_000
    rows = [("s", d * day, 1.0, 1.0, d % 2 == 0) for d in range(18_600, 18_700)]
    tape = spark.createDataFrame(rows, "symbol string, ts_ms long, price double, quantity double, is_buyer_maker boolean")
    late = tape.withColumn("quantity", F.when(F.col("ts_ms") == 18_660 * day, 5.0).otherwise(F.col("quantity")))  # 2021-02-02: its bar opens in January
    for t in (tape, late):
        rebuilt = Lk.reduce_shards(t, str(tmp_path / "s"), lambda x: reduce_trades(x, week), week)
    assert [r["month"] for r in rebuilt.collect()] == ["2021-01"]
    want = {(r["bar_open_ms"], r["n_trades"], r["v_agg"]) for r in reduce_trades(late, week).collect()}
    got = Lk.shard_store(str(tmp_path / "s")).read(spark).collect()
    assert {(r["bar_open_ms"], r["n_trades"], r["v_agg"]) for r in got} == want and len(got) == len(want)


def test_months_do_not_follow_the_session_zone(spark):
    from barloom.functions.scalars import ms_to_date, ms_to_month

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            x = spark.createDataFrame([(1_609_459_200_000,), (1_609_459_199_999,), (-1,)], "t long")
            got = [(str(r[0]), r[1]) for r in x.select(ms_to_date("t"), ms_to_month("t")).collect()]
            assert got == [("2021-01-01", "2021-01"), ("2020-12-31", "2020-12"), ("1969-12-31", "1969-12")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_token_stream_refuses_other_provenance(spark, tmp_path):
    t = spark.createDataFrame([("s", 0, 1, 2)], "symbol string, bar_open_ms long, b_c int, b_f int")
    h = spark.createDataFrame([("s", "abc")], "symbol string, dataset_hash string")
    Lk.write_token_stream(t, str(tmp_path / "t"), "tok", h, 8)
    assert Lk.load_token_stream(spark, str(tmp_path / "t"), "tok", h, 8).count() == 1
    with pytest.raises(Exception, match="does not match"):
        Lk.load_token_stream(spark, str(tmp_path / "t"), "other", h, 8).collect()


def test_listing_ignores_keys_whose_names_disagree(spark):
    from barloom.operators.universe import scan_listing

    rows = [("d/AAA/AAA-aggTrades-2021-01.zip", 5), ("d/AAA/BBB-aggTrades-2021-01.zip", 7), ("d/AAA/AAA-klines-2021-01.zip", 9)]
    got = scan_listing(spark.createDataFrame(rows, "key string, size long")).collect()
    assert [(r["symbol"], r["month"], r["bytes"]) for r in got] == [("AAA", "2021-01", 5)]


def _damage(root, how):
    """Lose, add to or change the files of one live shard."""
    import glob
    import shutil

    import pyarrow as pa
    import pyarrow.parquet as pq

    shard = sorted(glob.glob(f"{root}/data/*/symbol=b"))[-1]
    path = glob.glob(f"{shard}/*.parquet")[0]
    if how == "lost":
        shutil.rmtree(shard)
        return
    t = pq.read_table(path, partitioning=None)
    v = t["v"].to_pylist()
    changed = {"added": v + [9], "changed": [v[0] + 1, *v[1:]], "null": [None, *v[1:]], "fewer": v[1:]}[how]
    rows = {"t": t["t"].to_pylist()[: len(changed)] + [99] * (len(changed) - len(v)), "v": changed}
    pq.write_table(pa.table(rows, schema=t.schema), path)
    for crc in glob.glob(f"{shard}/.*.crc"):
        os.remove(crc)


@pytest.mark.parametrize("how", ["lost", "added", "changed", "null", "fewer"])
def test_store_refuses_what_was_not_committed(spark, tmp_path, how):
    from barloom.sources.versions import Store

    root = str(tmp_path / "s")
    store = Store(root, ("symbol",))
    rows = [(s, t, t * t) for s in "abc" for t in range(5)]
    store.commit(spark.createDataFrame(rows, "symbol string, t long, v long").coalesce(1))
    assert sorted(map(tuple, store.read(spark).select("symbol", "t", "v").collect())) == sorted(rows)
    _damage(root, how)
    assert [(r["symbol"], r["problem"]) for r in store.check(spark).collect()] == [("b", "lost" if how == "lost" else "altered")]
    with pytest.raises(ValueError, match="'symbol': 'b'"):
        store.read(spark)


def test_store_versions(spark, tmp_path):
    from barloom.sources.versions import Store

    root = str(tmp_path / "s")
    store = Store(root, ("symbol",))
    make = lambda rows: spark.createDataFrame(rows, "symbol string, v long")
    assert store.manifest(spark) is None
    first = store.commit(make([("a", 1), ("b", 2), ("01", 3)]))
    second = store.commit(make([("b", 5)]))
    read = lambda v=None: sorted((r["symbol"], r["v"]) for r in store.read(spark, v).collect())
    assert read() == [("01", 3), ("a", 1), ("b", 5)] and read(first) == [("01", 3), ("a", 1), ("b", 2)]
    store.commit(make([("c", 7)]), keep=make([("a", 0)]))  # 'b' and '01' have vanished from the source
    assert read() == [("a", 1), ("c", 7)] and read(second) == [("01", 3), ("a", 1), ("b", 5)]
    # a run that dies before its pointer moves is never seen
    make([("a", 100)]).write.partitionBy("symbol").parquet(f"{root}/data/_run=dead")
    assert read() == [("a", 1), ("c", 7)]
    assert store.vacuum(spark) == 2 and read() == [("a", 1), ("c", 7)]
    with pytest.raises(RuntimeError, match="another run"):
        store._point(spark, "late", first)


def test_compaction_and_token_streams_are_checked(spark, tmp_path, monkeypatch):
    rows = [("s", d * 86_400_000, float(d)) for d in range(60)]
    Lk.write_lake(spark.createDataFrame(rows, "symbol string, bar_open_ms long, x_0 double"), str(tmp_path / "day"), by="date")
    Lk.compact_lake(spark, str(tmp_path / "day"), str(tmp_path / "month"))
    assert spark.read.parquet(str(tmp_path / "month")).count() == 60
    monkeypatch.setattr(Lk, "ms_to_month", lambda c: F.when(F.col(c) > 0, F.lit("1970-01")))  # an id that goes astray
    real = Lk.content_digest
    monkeypatch.setattr(Lk, "content_digest", lambda df, keys: real(df.filter("bar_open_ms > 0") if "month" in str(df.inputFiles()) else df, keys))
    with pytest.raises(ValueError, match="changed the content of s"):
        Lk.compact_lake(spark, str(tmp_path / "day"), str(tmp_path / "month2"))

    t = spark.createDataFrame([("s", 0, 1, 2), ("z", 0, 3, 4)], "symbol string, bar_open_ms long, b_c int, b_f int")
    h = spark.createDataFrame([("s", "abc"), ("z", "def")], "symbol string, dataset_hash string")
    with pytest.raises(ValueError, match="same symbols: z"):
        Lk.write_token_stream(t, str(tmp_path / "t"), "tok", h.filter("symbol = 's'"), 8)
    Lk.write_token_stream(t, str(tmp_path / "t"), "tok", h, 8)
    assert Lk.load_token_stream(spark, str(tmp_path / "t"), "tok", h, 8).count() == 2
    for other in (h.filter("symbol = 's'"), h.unionByName(h.limit(1).withColumn("symbol", F.lit("q"))), h.withColumn("dataset_hash", F.lit("abc"))):
        with pytest.raises(ValueError, match="does not match"):
            Lk.load_token_stream(spark, str(tmp_path / "t"), "tok", other, 8)


def test_artifacts_on_another_grid_are_named(spark, tmp_path):
    want = spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.6), (3, 5, None)], "unit int, h int, ir double")
    Lk.write_eval_artifacts(want.withColumn("h", F.when(F.col("unit") == 2, 15).otherwise(F.col("h"))).unionByName(want.filter("unit = 1")), str(tmp_path / "a"), ["unit", "h", "ir"])
    _, problems = Lk.load_eval_artifacts(spark, str(tmp_path / "a"), want, ["unit"], ["unit", "h", "ir"], grid=["h"])
    assert sorted(map(tuple, problems.collect())) == [(1, "repeated"), (2, "grid")]
    with pytest.raises(ValueError, match="refused"):
        Lk.assert_no_problems(problems)
