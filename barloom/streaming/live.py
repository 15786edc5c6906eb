"""Live bars and per-symbol state with Structured Streaming; closed bars equal the batch result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.config import EPS_VAR, EPS_VOL, FeatureConfig
from barloom.operators.bars import sort_key


def read_tick_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Files of ticks as a stream; with ``availableNow`` it is the resumable ingest of new files."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def dedup_ticks(ticks: DataFrame, delay: str) -> DataFrame:
    """First copy of each trade inside the watermark; the state of older ids is dropped."""
    return ticks.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def tumbling_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Bars emitted once closed; the aggregates combine partially before the shuffle, late ticks are dropped."""
    buy, q, pos = ~F.col("is_buyer_maker"), F.col("quantity"), sort_key("ts_ms", ("trade_id", 19))
    return (ticks.withWatermark("event_time", delay).groupBy("symbol", F.window("event_time", width).alias("w")).agg(
        F.min_by("price", pos).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", pos).alias("close"),
        F.sum("quantity").alias("v_kline"), F.sum(F.when(buy, q).otherwise(0.0)).alias("v_buy"), F.sum(F.when(buy, 0.0).otherwise(q)).alias("v_sell"),
        F.count_if(buy).alias("n_buy"), F.count_if(~buy).alias("n_sell"))
        .select("symbol", F.unix_millis(F.col("w.start")).alias("bar_open_ms"), "open", "high", "low", "close", "v_kline", "v_buy", "v_sell", "n_buy", "n_sell"))


def sliding_flow(ticks: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    """Trailing volume and order-flow imbalance in sliding windows."""
    buy, q = ~F.col("is_buyer_maker"), F.col("quantity")
    out = ticks.withWatermark("event_time", delay).groupBy("symbol", F.window("event_time", width, slide).alias("w")).agg(
        F.sum("quantity").alias("volume"), F.sum(F.when(buy, q).otherwise(-q)).alias("flow"))
    return out.select("symbol", F.unix_millis(F.col("w.end")).alias("end_ms"), "volume", (F.col("flow") / (F.col("volume") + 1e-9)).alias("imbalance"))


def gap_sessions(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of ticks without a pause longer than the gap."""
    return (ticks.withWatermark("event_time", delay).groupBy("symbol", F.session_window("event_time", gap).alias("s")).agg(F.count("*").alias("n_trades"))
            .select("symbol", F.unix_millis(F.col("s.start")).alias("start_ms"), F.unix_millis(F.col("s.end")).alias("end_ms"), "n_trades"))


def late_ticks(ticks: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """Batch side count of what the watermark dropped: ticks of a bar beyond those counted in it."""
    seen = ticks.groupBy("symbol", (F.floor(F.col("ts_ms") / step) * step).alias("bar_open_ms")).agg(F.count("*").alias("n_seen"))
    done = bars.select("symbol", "bar_open_ms", (F.col("n_buy") + F.col("n_sell")).alias("n_kept"))
    return seen.join(done, ["symbol", "bar_open_ms"], "left").select(
        "symbol", "bar_open_ms", (F.col("n_seen") - F.coalesce("n_kept", F.lit(0))).alias("n_late")).filter("n_late > 0")


def funding_in_stream(bars: DataFrame, marks: DataFrame, width: str, delay: str) -> DataFrame:
    """Bars joined with the funding marks of the preceding interval; both sides are bounded by watermarks.

    The interval reaches over two slots of its width, so a mark stands in its own slot and the next and a bar in its own: a pair meets
    once, and a row looks through the state of one (symbol, slot), not of the symbol.
    """
    b = bars.withWatermark("bar_time", delay).withColumn("slot", F.window("bar_time", width).start).alias("b")
    m = marks.withWatermark("mark_time", delay).withColumn("own", F.window("mark_time", width))
    m = m.withColumn("slot", F.explode(F.array("own.start", "own.end"))).drop("own").alias("m")
    near = F.expr(f"b.symbol = m.symbol AND b.slot = m.slot AND m.mark_time <= b.bar_time AND m.mark_time > b.bar_time - interval {width}")
    return b.join(m, near, "leftOuter").select("b.symbol", "b.bar_time", "m.mark_time", "m.value")


SUMS_SCHEMA = "symbol string, t long, n long, n_valued long, value double"


def range_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] out of sums of aligned runs: a range costs two runs of each size, and nothing outside it enters its sum."""
    out, lo, hi = np.zeros(len(lo)), lo.copy(), hi.copy()
    with np.errstate(invalid="ignore"):
        while (lo < hi).any():
            first = (lo & 1 == 1) & (lo < hi)
            out[first] += values[lo[first]]
            lo[first] += 1
            last = (hi & 1 == 1) & (lo < hi)
            hi[last] -= 1
            out[last] += values[hi[last]]
            lo, hi = lo >> 1, hi >> 1
            values = np.append(values, np.zeros(len(values) % 2))
            values = values[::2] + values[1::2]
    return out


class IntervalSums(StatefulProcessor):
    """Count and sum of the marks in the interval before each bar of one (symbol, slot), pair by pair but without making the pairs.

    A new bar meets the marks known so far, a known bar the marks that are new; each meeting is one row. The state holds what came in each
    micro-batch as packed arrays, until the watermark has passed the slot's end.
    """

    def __init__(self, width: int, span: int) -> None:
        self.width, self.span = width, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "bars binary, marks binary, vals binary, valued binary")

    def _meet(self, key: Any, bars: np.ndarray, marks: tuple[np.ndarray, ...]) -> pd.DataFrame:
        order = np.argsort(marks[0], kind="stable")
        t, value, valued = (a[order] for a in marks)
        lo, hi = np.searchsorted(t, bars - self.width, "right"), np.searchsorted(t, bars, "right")
        known = np.concatenate([[0], np.cumsum(valued.astype("int64"))])
        return pd.DataFrame({"symbol": key[0], "t": bars, "n": hi - lo, "n_valued": known[hi] - known[lo], "value": range_sums(value, lo, hi)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat([r[["t", "kind", "value", "valued"]] for r in rows])
        is_bar = got["kind"].to_numpy() == 1
        t, value, valued = (got[c].to_numpy(d) for c, d in (("t", "int64"), ("value", "float64"), ("valued", "bool")))
        bars, marks = t[is_bar], (t[~is_bar], value[~is_bar], valued[~is_bar])
        kinds = ("int64", "int64", "float64", "bool")
        held = [[np.frombuffer(b, k) for b, k in zip(piece, kinds)] for piece in self.pieces.get()] if self.pieces.exists() else []
        if not held:
            self.handle.registerTimer((int(key[1]) + 1) * self.span // 1000)
        self.pieces.appendValue(tuple(a.tobytes() for a in (bars, *marks)))
        yield self._meet(key, bars, tuple(np.concatenate([*(p[i + 1] for p in held), m]) for i, m in enumerate(marks)))
        if held and len(marks[0]):
            more = self._meet(key, np.concatenate([p[0] for p in held]), marks)
            yield more[more["n"] > 0]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.pieces.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in SUMS_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def funding_sums_in_stream(bars: DataFrame, marks: DataFrame, width_ms: int, delay: str, widths: int = 6) -> DataFrame:
    """``funding_in_stream`` summed by bar: symbol, bar_time, n marks in the preceding interval, n_valued of them with a value and its sum.

    Pairs grow with the product of both sides, these rows with their sum. A bar comes out once when it arrives, with the marks known
    by then, and again for marks that come later; totals add its rows up. A slot spans so many ``widths``; a mark stands in the slots of the bars
    it can meet.
    """
    width = width_ms * 1000
    span = width * widths
    b = bars.select("symbol", F.col("bar_time").alias("event_time"), F.lit(1).alias("kind"), F.lit(0.0).alias("value"), F.lit(False).alias("valued"))
    m = marks.select("symbol", F.col("mark_time").alias("event_time"), F.lit(0).alias("kind"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
                     F.col("value").isNotNull().alias("valued"))
    both = b.withWatermark("event_time", delay).unionByName(m.withWatermark("event_time", delay)).filter("symbol is not null and event_time is not null")
    both = both.withColumn("t", F.unix_micros("event_time"))
    slot = lambda t: F.floor(t / span)
    slots = F.sequence(slot(F.col("t")), slot(F.col("t") + F.when(F.col("kind") == 1, 0).otherwise(width - 1)))
    out = both.withColumn("slot", F.explode(slots)).groupBy("symbol", "slot").transformWithStateInPandas(
        statefulProcessor=IntervalSums(width, span), outputStructType=SUMS_SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.select("symbol", F.timestamp_micros("t").alias("bar_time"), "n", "n_valued", F.when(F.col("n_valued") > 0, F.col("value")).alias("value"))


OUT_SCHEMA = "symbol string, bar_open_ms long, segment_id long, seg_pos long, ret double, z double, z_warm int, sigma double, vol_warm int, funding double"
STATE_SCHEMA = "prev_ts long, prev_close double, seg long, pos long, mu double, var double, s double, funding double"


class BarState(StatefulProcessor):
    """Segment, EWMA z-score, volatility and last funding of one symbol, kept between micro-batches.

    Input rows are closed bars (``kind`` 1) and funding marks (``kind`` 0) with their time ``t``. The state is eight
    numbers per symbol, so it restores in the middle of a segment.
    """

    def __init__(self, cfg: FeatureConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bar", STATE_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import math

        cfg = self.cfg
        a, lam = cfg.alpha(cfg.half_life_fast), cfg.lam
        warm, warm_vol = max(cfg.warm(cfg.half_life_fast), 1), cfg.warm_vol
        if self.state.exists():
            prev_ts, prev_close, seg, pos, mu, var, s, funding = self.state.get()
        else:
            prev_ts, prev_close, seg, pos, mu, var, s, funding = None, None, -1, -1, 0.0, 0.0, 0.0, 0.0
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "kind"]).itertuples():
            if r.kind == 0:
                funding = float(r.value)
                continue
            ts, close = int(r.bar_open_ms), float(r.close)
            if prev_ts is not None and ts <= prev_ts:
                continue  # a bar at or before the last one came too late: what followed it is already out
            if (prev_ts is None or ts - prev_ts > cfg.bar_ms or (prev_close and abs(close / prev_close - 1) >= cfg.structural)):
                seg, pos, ret, s = seg + 1, 0, 0.0, 0.0
                mu, var, z = ret, 0.0, 0.0
            else:
                # no return without two positive prices: NaN, as in the batch
                pos, ret = pos + 1, math.log(close / prev_close) if close > 0 and prev_close > 0 else math.nan
                z = (ret - mu) / math.sqrt(var + EPS_VAR) if pos >= warm else 0.0
                z = max(-5.0, min(5.0, z)) if math.isfinite(z) else math.nan
                delta = ret - mu
                mu, var = mu + a * delta, (1 - a) * (var + a * delta * delta)
            s = lam * s + (1 - lam) * ret * ret
            out.append((key[0], ts, seg, pos, ret, z, int(pos < warm), math.sqrt(s + EPS_VOL), int(pos < warm_vol), funding))
            prev_ts, prev_close = ts, close
        if prev_ts is not None:
            self.state.update((prev_ts, prev_close, seg, pos, mu, var, s, funding))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def live_features(rows: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Stateful per-symbol features over closed bars and funding marks."""
    return rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=BarState(cfg), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="None")


ASOF_SCHEMA = "symbol string, bar_open_ms long, t long, value double, mark_t long, missing int"


class LastMark(StatefulProcessor):
    """As-of join in a stream: bars get the last mark of their symbol at or before their time, however long ago it came.

    Rows wait until the watermark has passed them, so marks and bars may arrive out of order within the delay; then they are
    settled in order of time, marks first. A mark is forgotten where its symbol has no row for longer than ``idle_ms`` of event time,
    whatever the batches. One event-time timer settles rows of a symbol that gets no more, another drops the state of an idle one. The state
    is the last mark and the rows within the delay.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, kind int, seq long, value double, bar_open_ms long")
        self.last = handle.getValueState("last", "t long, value double, upto long")
        self.seen = handle.getValueState("seen", "t long")

    def _settle(self, key: Any, now: int, new: list[tuple]) -> pd.DataFrame:
        rows = sorted([*(tuple(r) for r in (self.waiting.get() if self.waiting.exists() else ())), *new])
        due = [r for r in rows if r[0] <= now]
        if len(due) < len(rows):
            self.waiting.put(rows[len(due):])
            self.handle.registerTimer(rows[len(due)][0])
        else:
            self.waiting.clear()
        newest = max([r[0] for r in new], default=-1)
        if newest > (self.seen.get()[0] if self.seen.exists() else -1):
            self.seen.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)
        if not due:
            return pd.DataFrame(columns=[c.split()[0] for c in ASOF_SCHEMA.split(", ")])
        before = self.last.get() if self.last.exists() else None
        if before is not None:
            due = [(before[0], 0, -1, before[1], 0), *due]
        t, kind, _, value, opened = (np.array(c) for c in zip(*due))
        reached = np.concatenate([t[:1], t[:-1]])  # the time of the row before
        if before is not None and len(t) > 1:
            reached[1] = before[2]  # the state stands first with its mark's time; its symbol was heard of later
        rows_at = np.arange(len(due))
        since = np.maximum.accumulate(np.where(t - reached > self.idle_ms, rows_at, 0))  # where the last silence ended
        mark = np.maximum.accumulate(np.where(kind == 0, rows_at, -1))  # the last mark up to each row
        mark = np.where(mark >= since, mark, -1)
        if mark[-1] >= 0:
            self.last.update((int(t[mark[-1]]), float(value[mark[-1]]), int(t[-1])))
        else:
            self.last.clear()
        bars = np.flatnonzero(kind == 1)
        at = mark[bars]
        return pd.DataFrame({"symbol": key[0], "bar_open_ms": opened[bars], "t": t[bars], "value": np.where(at >= 0, value[at], 0.0),
                             "mark_t": pd.arrays.IntegerArray(np.where(at >= 0, t[at], 0).astype("int64"), at < 0), "missing": (at < 0).astype("int32")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows))
        new = list(zip(*(got[c].tolist() for c in ("t", "kind", "seq", "value", "bar_open_ms"))))
        yield self._settle(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        yield self._settle(key, now, [])
        if self.seen.exists() and self.seen.get()[0] + self.idle_ms <= now:
            self.last.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


def last_mark_in_stream(bars: DataFrame, marks: DataFrame, delay: str, idle_ms: int) -> DataFrame:
    """``bars`` (symbol, bar_open_ms, t) with the last of ``marks`` (symbol, t, seq, value) at or before t; both may be streams.

    Of marks with one time the largest ``seq`` wins. ``missing`` is 1 where no mark is known.
    """
    common = lambda df, kind, seq, value, opened: df.select("symbol", "t", F.lit(kind).alias("kind"), seq.alias("seq"), value.alias("value"), opened.alias("bar_open_ms"))
    zero = F.lit(0).cast("bigint")
    both = common(bars, 1, zero, F.lit(0.0), F.col("bar_open_ms")).unionByName(common(marks.filter("value is not null"), 0, F.col("seq").cast("bigint"), F.col("value").cast("double"), zero))
    timed = both.withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", delay)
    return timed.groupBy("symbol").transformWithStateInPandas(statefulProcessor=LastMark(idle_ms), outputStructType=ASOF_SCHEMA, outputMode="Append", timeMode="EventTime")


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what is available into a table on shared storage; the sink is exactly-once."""
    query = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.parquet(path)
