"""Ordered computation over long keys without putting a key into one task.

A key (a symbol) may hold a third of all rows, so nothing here partitions by the key alone except the
per-chunk summaries. Bars are unique on a fixed time step, hence a time chunk of ``chunk`` steps holds at
most ``chunk`` rows whatever the key distribution is. Three tools follow from that:

* halo   - rows near a chunk edge are copied to the neighbour, so any bounded frame is exact inside a chunk;
* carry  - running state is reduced per chunk, scanned over the chunk table (1/chunk of the rows), joined back;
* ranks  - order statistics go through value buckets with exact offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import pin

CHUNK = "_chunk"
CORE = "_core"
LSEG = "_lseg"


@dataclass(frozen=True)
class Timeline:
    """Key columns, an integer time column, its step and the chunk length in steps."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "bar_open_ms"
    step: int = 60_000
    chunk: int = 10_080

    @property
    def span(self) -> int:
        return self.step * self.chunk

    @property
    def on_chunk(self) -> list[str]:
        return [*self.keys, CHUNK]

    def by_chunk(self) -> Window:
        return Window.partitionBy(*self.on_chunk).orderBy(self.ts)

    def by_segment(self) -> Window:
        return Window.partitionBy(*self.on_chunk, LSEG).orderBy(self.ts)

    def resized(self, chunk: int) -> Timeline:
        return replace(self, chunk=chunk)


def with_chunks(df: DataFrame, tl: Timeline) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(tl.ts) / tl.span)).withColumn(CORE, F.lit(True))


def with_halo(df: DataFrame, tl: Timeline, back: int = 0, ahead: int = 0) -> DataFrame:
    """Copy the last ``back`` steps of a chunk to the next one and the first ``ahead`` steps to the previous."""
    if back == 0 and ahead == 0:
        return with_chunks(df, tl)
    if max(back, ahead) > tl.chunk:
        raise ValueError(f"a halo of {max(back, ahead)} steps needs chunks at least as long, got {tl.chunk}")
    home = F.floor(F.col(tl.ts) / tl.span)
    offset = F.floor((F.col(tl.ts) - F.col("_home") * tl.span) / tl.step)
    none = F.lit(None).cast("bigint")
    targets = F.array(
        F.col("_home"),
        F.when(offset >= tl.chunk - back, F.col("_home") + 1).otherwise(none),
        F.when(offset < ahead, F.col("_home") - 1).otherwise(none),
    )
    return (
        df.withColumn("_home", home)
        .withColumn(CHUNK, F.explode(F.array_compact(targets)))
        .withColumn(CORE, F.col(CHUNK) == F.col("_home"))
        .drop("_home")
    )


def core(df: DataFrame) -> DataFrame:
    """Drop halo rows and the helper columns."""
    return df.filter(CORE).drop(CORE, CHUNK, LSEG, "_brk")


def carry(df: DataFrame, tl: Timeline, totals: Mapping[str, Column], scans: Mapping[str, Column]) -> DataFrame:
    """Reduce the core rows per chunk, then scan the chunk table.

    ``totals`` are aggregates per chunk; ``scans`` are window expressions over the chunk table, one row per
    (key, chunk), written against ``before()``.
    """
    summary = df.filter(CORE).groupBy(*tl.on_chunk).agg(*[c.alias(n) for n, c in totals.items()])
    return summary.select(*tl.on_chunk, *[c.alias(n) for n, c in scans.items()])


def before(tl: Timeline) -> Window:
    """All earlier chunks of the key."""
    return Window.partitionBy(*tl.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running_sums(df: DataFrame, tl: Timeline, exprs: Mapping[str, Column]) -> DataFrame:
    """Inclusive running sums per key in time order: in-chunk prefix plus the total of earlier chunks."""
    base = with_chunks(df, tl)
    for name, value in exprs.items():
        base = base.withColumn(name, value)
    prior = carry(
        base, tl,
        {f"_t_{n}": F.sum(n) for n in exprs},
        {f"_c_{n}": F.coalesce(F.sum(f"_t_{n}").over(before(tl)), F.lit(0)) for n in exprs},
    )
    w = tl.by_chunk().rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: F.sum(n).over(w) for n in exprs})
    joined = local.join(prior, tl.on_chunk)
    return (joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in exprs})
            .drop(CHUNK, CORE, *[f"_c_{n}" for n in exprs]))


def row_index(df: DataFrame, tl: Timeline, name: str = "row_idx") -> DataFrame:
    """Exact 0-based position of each row in its key."""
    out = running_sums(df, tl, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def row_halo(df: DataFrame, keys: Sequence[str], index: str, back: int = 0, ahead: int = 0,
             block: int = 10_080) -> DataFrame:
    """Halo by row position instead of time, for frames that run across time gaps."""
    return with_halo(df, Timeline(tuple(keys), index, 1, block), back, ahead)


def last_known(df: DataFrame, tl: Timeline, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Forward fill ``values`` per key (last non-null up to and including the row)."""
    base = with_chunks(df, tl)
    pos = F.struct(*[F.col(c) for c in order])
    prior = carry(
        base, tl,
        {f"_t_{v}": F.max_by(F.col(v), F.when(F.col(v).isNotNull(), pos)) for v in values},
        {f"_c_{v}": F.last(f"_t_{v}", ignorenulls=True).over(before(tl)) for v in values},
    )
    w = (Window.partitionBy(*tl.on_chunk).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    filled = base.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
    return (filled.join(prior, tl.on_chunk)
            .withColumns({v: F.coalesce(F.col(v), F.col(f"_c_{v}")) for v in values})
            .drop(CHUNK, CORE, *[f"_c_{v}" for v in values]))


@dataclass(frozen=True)
class Term:
    """One recursion ``s_i = decay*s_(i-1) + u_i``, u as SQL text; ``lagged`` reports the state before row i."""

    decay: float
    u: str
    lagged: bool = False


@dataclass(frozen=True)
class Centred:
    """Decayed mean and second moment of ``column`` before each row, about the first value of its segment, or 0 where that is infinite."""

    column: str
    alpha: float


def segment_states(df: DataFrame, tl: Timeline, terms: Mapping[str, Term] | None = None, centred: Mapping[str, Centred] | None = None) -> DataFrame:
    """Everything that runs through a segment, from one exchange of the rows.

    ``df`` holds chunked rows with ``_brk`` and the local segment number; halo rows are dropped. Adds segment_id (from 0 per
    key), row_idx, seg_pos; per term its value; per centred ``n`` the columns ``_o_n``, ``_m1_n``, ``_m2_n``.

    A chunk acts on the state that enters it as one affine map with a reset where a segment starts inside: so many breaks and rows, and per
    recursion the decay over its last segment and what that segment adds. Maps compose, so the states that enter all chunks come
    from one ordered pass over the chunk maps of a key, 1/chunk of the rows, with a memory of one state; nothing is forgotten by
    rule. Second moments are kept about an origin and moved to another when maps compose. Weights are formed inside one chunk, so
    exponents stay bounded.

    The expressions are SQL text: one string per column is far cheaper to build than a tree of column calls.
    """
    terms, centred = dict(terms or {}), dict(centred or {})
    decays = {**{n: t.decay for n, t in terms.items()}, **{n: 1 - c.alpha for n, c in centred.items()}}
    if decays and tl.chunk * -math.log(min(decays.values())) > 700:
        raise ValueError(f"chunk {tl.chunk} is too long for decay {min(decays.values())}; use config.safe_chunk")
    chunk_keys = ", ".join(tl.on_chunk)
    by_chunk = f"PARTITION BY {chunk_keys} ORDER BY {tl.ts}"
    seg = f"PARTITION BY {chunk_keys}, {LSEG}"
    power = {n: f"pow({d!r}D, {{}})" for n, d in decays.items()}
    keep = [c for c in df.columns if c not in {CORE, "segment_id", "row_idx", "seg_pos", *terms}]
    x = df.filter(CORE) if CORE in df.columns else df
    x = x.selectExpr(*keep, *[f"({t.u}) AS _u_{n}" for n, t in terms.items()],
                     f"row_number() OVER ({seg} ORDER BY {tl.ts}) - 1 AS _at", f"row_number() OVER ({by_chunk}) AS _ix", f"sum(_brk) OVER ({by_chunk}) AS _nb",
                     f"lead(1) OVER ({by_chunk}) IS NULL AS _end", *[f"first(IF(abs({c.column}) = double('infinity'), 0D, {c.column})) OVER ({seg} ORDER BY {tl.ts}) AS _o_{n}" for n, c in centred.items()])
    upto, past = (f"OVER ({seg} ORDER BY {tl.ts} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})" for end in ("CURRENT ROW", "1 PRECEDING"))
    sums = []
    for n, t in terms.items():
        sums.append(f"coalesce(sum(_u_{n} * {power[n].format('-_at')}) {past if t.lagged else upto}, 0D) * {power[n].format('_at - 1' if t.lagged else '_at')} AS _p_{n}")
    for n, c in centred.items():
        g = f"({c.column} - _o_{n})"
        for i, v in ((1, g), (2, f"{g} * {g}")):
            sums.append(f"coalesce(sum({v} * {c.alpha!r}D * {power[n].format('-_at')}) {past}, 0D) * {power[n].format('_at - 1')} AS _p{i}_{n}")
    local = pin(x.selectExpr("*", *sums))
    # the map of a chunk: its last row with that row taken in
    added = [f"_p_{n} * {t.decay!r}D + _u_{n}" if t.lagged else f"_p_{n}" for n, t in terms.items()]
    first = [f"_p1_{n} * {1 - c.alpha!r}D + ({c.column} - _o_{n}) * {c.alpha!r}D" for n, c in centred.items()]
    second = [f"_p2_{n} * {1 - c.alpha!r}D + ({c.column} - _o_{n}) * ({c.column} - _o_{n}) * {c.alpha!r}D" for n, c in centred.items()]
    as_list = lambda v: f"CAST(array({', '.join(v)}) AS array<double>)"
    maps = local.filter("_end").selectExpr(
        *tl.on_chunk, "_nb", "_ix", "_at + 1 AS _tail", f"{as_list(added)} AS _s", f"{as_list([f'_o_{n}' for n in centred])} AS _o", f"{as_list(first)} AS _m1", f"{as_list(second)} AS _m2")
    rates = [np.array([decays[n] for n in names], dtype=float) for names in (terms, centred)]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in tl.keys)
    entering = dealt_groups(maps, tl.keys, CHUNK).mapInArrow(
        _compose(list(tl.keys), *rates), f"{kinds}, {CHUNK} {df.schema[CHUNK].dataType.simpleString()}, _segs long, _rows long, _start long, _s array<double>, _o array<double>, _m1 array<double>, _m2 array<double>")
    entering = entering.select(*tl.on_chunk, "_segs", "_rows", "_start", *[F.col(f"_{c}").alias(f"_in_{c}") for c in ("s", "o", "m1", "m2")])
    goes_on = "_nb = 0 AND _rows > 0"
    out = ["_segs + _nb - 1 AS segment_id", "_rows + _ix - 1 AS row_idx", f"CAST(IF({goes_on}, _rows + _ix - 1 - _start, _at) AS BIGINT) AS seg_pos"]
    for i, (n, t) in enumerate(terms.items()):
        out.append(f"_p_{n} + IF({goes_on}, _in_s[{i}] * {power[n].format('_at' if t.lagged else '_at + 1')}, 0D) AS {n}")
    for i, n in enumerate(centred):
        w, shift = power[n].format("_at"), f"(_o_{n} - _in_o[{i}])"
        out += [f"IF({goes_on}, _in_o[{i}], _o_{n}) AS _o_{n}",
                f"IF({goes_on}, {w} * _in_m1[{i}] + _p1_{n} + {shift} * (1D - {w}), _p1_{n}) AS _m1_{n}",
                f"IF({goes_on}, {w} * _in_m2[{i}] + _p2_{n} + 2D * {shift} * _p1_{n} + {shift} * {shift} * (1D - {w}), _p2_{n}) AS _m2_{n}"]
    return local.join(entering, tl.on_chunk).selectExpr(*keep, *out)


def _compose(keys: list[str], rates: np.ndarray, centred_rates: np.ndarray):
    """Streams chunk maps in order and gives each chunk the state that enters it: breaks and rows so far, where the open segment starts, moments."""

    def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(column), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            g, breaks, rows, tail = (t[c].to_numpy() for c in ("_g", "_nb", "_ix", "_tail"))
            s = matrix(t["_s"], len(rates))
            o, m1, m2 = (matrix(t[c], len(centred_rates)) for c in ("_o", "_m1", "_m2"))
            fade, fade_centred = (np.power(r[None, :], tail[:, None]) for r in (rates, centred_rates))
            counts, outs = np.zeros((3, len(g)), dtype=np.int64), tuple(np.zeros_like(v) for v in (s, o, m1, m2))
            for i in range(len(g)):
                if g[i] != held:
                    held, state = g[i], (0, 0, 0, np.zeros(len(rates)), *(np.zeros(len(centred_rates)) for _ in range(3)))
                segs, n, start, es, eo, e1, e2 = state
                counts[:, i] = segs, n, start
                for v, e in zip(outs, (es, eo, e1, e2)):
                    v[i] = e
                if breaks[i] or not n:
                    state = (segs + breaks[i], n + rows[i], n + rows[i] - tail[i], s[i], o[i], m1[i], m2[i])
                else:
                    shift, w = o[i] - eo, fade_centred[i]
                    state = (segs, n + rows[i], start, es * fade[i] + s[i], eo, w * e1 + m1[i] + shift * (1 - w),
                             w * e2 + m2[i] + 2 * shift * m1[i] + shift * shift * (1 - w))
            as_lists = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) if v.shape[1] else pa.array([[]] * len(v), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), batch[CHUNK], *map(pa.array, counts), *map(as_lists, outs)],
                                             [*keys, CHUNK, "_segs", "_rows", "_start", "_s", "_o", "_m1", "_m2"])

    return run


def affine_scan(df: DataFrame, tl: Timeline, terms: Mapping[str, Term]) -> DataFrame:
    """Decaying recursions inside every segment, all starting from 0: ``segment_states`` of plain terms.

    ``df`` holds core rows with the chunk columns and ``_brk`` (1 on the first row of a segment).
    """
    marked = df if CORE in df.columns else df.withColumn(CORE, F.lit(True))
    own = {"segment_id", "row_idx", "seg_pos"}
    out = segment_states(marked.withColumnsRenamed({c: f"_own_{c}" for c in own & set(df.columns)}), tl, terms)
    out = out.drop(*own).withColumnsRenamed({f"_own_{c}": c for c in own}).withColumn(CORE, F.lit(True))
    return out.select(*df.columns, *[n for n in terms if n not in df.columns])


def segment_first(df: DataFrame, tl: Timeline, values: Mapping[str, str]) -> DataFrame:
    """Value of ``column`` on the first row of the row's segment, as ``name``; core rows with ``_brk``."""
    chunk_keys = ", ".join(tl.on_chunk)
    prior = df.groupBy(*tl.on_chunk).agg(
        *[F.expr(f"max_by({c}, IF(_brk = 1, {tl.ts}, NULL)) AS _t_{n}") for n, c in values.items()])
    earlier = f"PARTITION BY {', '.join(tl.keys)} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    prior = prior.selectExpr(*tl.on_chunk, *[f"last(_t_{n}, true) OVER ({earlier}) AS _c_{n}" for n in values])
    frame = f"PARTITION BY {chunk_keys}, {LSEG} ORDER BY {tl.ts} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    local = df.selectExpr("*", f"max(_brk) OVER ({frame}) AS _in", *[f"first({c}) OVER ({frame}) AS _l_{n}" for n, c in values.items()])
    return local.join(prior, tl.on_chunk).selectExpr(*df.columns, *[f"IF(_in = 1, _l_{n}, _c_{n}) AS {n}" for n in values])


def dealt_groups(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows laid out for ``whole_groups``: a key's rows stand together and in order, with ``_g``, a number per key."""
    return df.withColumn("_g", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, order)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows cut between groups (``_g``), so that a task meets many small groups at once and a group never in parts."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            g = whole["_g"].to_numpy()
            cut = int(np.searchsorted(g == g[-1], True)) if g[0] != g[-1] else 0
            if cut:
                yield whole.slice(0, cut)
            held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64) -> DataFrame:
    """Per (key, value): ``n`` rows, ``below`` rows with a smaller value, ``total`` rows of the key.

    Equal values are merged before the shuffle. Values are spread over buckets cut at approximate quantiles;
    the cut points only decide where rows are counted, offsets and ranks are exact.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if not keys:
        first = counted.agg(F.percentile_approx(value, _shares(buckets), F.lit(buckets * 20))).first()[0] or [0]
        cuts = F.array(*[F.lit(c) for c in sorted(set(first))])
        placed = counted.withColumn("_bucket", F.size(F.filter(cuts, lambda c: c < F.col(value))))
        return _rank_placed(placed, keys, value)
    cuts = pin(counted.groupBy(*keys).agg(
        F.percentile_approx(value, _shares(buckets), F.lit(buckets * 20)).alias("_cuts")))
    placed = counted.join(cuts, list(keys))
    placed = placed.withColumn(
        "_bucket", F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(value)))).drop("_cuts")
    return _rank_placed(placed, keys, value)


def _shares(buckets: int) -> Column:
    return F.array(*[F.lit(i / buckets) for i in range(1, buckets)])


def _rank_placed(placed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    per_bucket = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_nb"))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_nb").over(wk.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_nb").over(wk).alias("total"))
    wb = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_upto", F.sum("n").over(wb))
    return local.join(offsets, [*keys, "_bucket"]).select(
        *keys, value, "n", (F.col("_off") + F.col("_upto") - F.col("n")).alias("below"), "total")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with a value, and its 1-based rank in the key, ties at their mean rank.

    Rows are dealt by range of (keys, value, hash of the row), so a value that half of the rows hold is cut like any other and
    the rank travels with the row. A tie group that spans ranges is the first or last value of each of them, so the first and
    last values of a range, with their counts, are all that ranges need to know of each other.
    """
    held = df.filter(F.col(value).isNotNull())
    order = [*keys, value]
    dealt = pin(held.withColumn("_salt", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).repartitionByRange(*order, "_salt").withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_part")
    ranked = dealt.withColumns({"_below": F.rank().over(local.orderBy(value)) - 1, "_same": F.count("*").over(Window.partitionBy(*keys, "_part", value)),
                                "_first": F.min(value).over(local), "_last": F.max(value).over(local)})
    sizes = dealt.groupBy(*keys, "_part", value).agg(F.count("*").alias("_c"))
    ends = sizes.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"), F.min(F.struct(value, "_c")).alias("_lo"), F.max(F.struct(value, "_c")).alias("_hi"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = pin(ends.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    edge = ends.select(*keys, "_part", F.inline(F.array_distinct(F.array("_lo", "_hi"))))
    earlier = Window.partitionBy(*keys, value).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "_part", value, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_prior"), F.sum("_c").over(Window.partitionBy(*keys, value)).alias("_all"))
    edge = edge.groupBy(*keys, "_part").agg(F.min(F.struct(value, "_prior", "_all")).alias("_lo"), F.max(F.struct(value, "_prior", "_all")).alias("_hi"))
    carried = ends.select(*keys, "_part", "_start").join(edge, [*keys, "_part"])
    x = ranked.join(carried, [*keys, "_part"])
    at_first, at_last = F.col(value) == F.col("_first"), F.col(value) == F.col("_last")
    below = F.col("_start") + F.when(at_first, -F.col("_lo._prior")).otherwise(F.col("_below"))
    ties = F.when(at_first, F.col("_lo._all")).when(at_last, F.col("_hi._all")).otherwise(F.col("_same"))
    return x.select(*df.columns, (below + (ties + 1) / 2).alias(out))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key from the distributed ranks, one column per share."""
    ranks = value_ranks(df.filter(F.col(value).isNotNull()), keys, value)
    last = F.col("total") - 1
    aggs = []
    for name, q in shares.items():
        at = last * F.lit(q)
        lo, hi = F.floor(at), F.ceil(at)
        holds = lambda pos: (F.col("below") <= pos) & (F.col("below") + F.col("n") > pos)
        low, high = F.max(F.when(holds(lo), F.col(value))), F.max(F.when(holds(hi), F.col(value)))
        frac = F.max(at - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return ranks.groupBy(*keys).agg(*aggs)


def global_rank(df: DataFrame, order: str, ties: Sequence[str], weight: str | None = None,
                buckets: int = 64, rank: str = "rank", running: str = "running") -> DataFrame:
    """Row number over the whole table by (order, *ties), and the running sum of ``weight`` in that order.

    A window without partitions would sort the table in one task; here rows go to value buckets whose cut points are
    a bounded list of literals, and a table of at most ``buckets`` offsets finishes the job.
    """
    cuts = df.agg(F.percentile_approx(order, _shares(buckets), F.lit(buckets * 20))).first()[0] or []
    x = df.withColumn("_bucket", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order)))
                      if cuts else F.lit(0))
    w = F.col(weight) if weight else F.lit(1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum(w).alias("_w")).select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_ow"))
    inside = Window.partitionBy("_bucket").orderBy(order, *ties)
    x = x.withColumns({"_ln": F.row_number().over(inside),
                       "_lw": F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(offsets, "_bucket")
    x = x.withColumn(rank, F.col("_on") + F.col("_ln"))
    if weight:
        x = x.withColumn(running, F.col("_ow") + F.col("_lw"))
    return x.drop("_bucket", "_ln", "_lw", "_on", "_ow")
