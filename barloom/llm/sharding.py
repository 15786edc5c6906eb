"""Sharding by balanced label propagation.

Documents hang on hubs (for equal texts: the text's hash). A document's neighbours are the other
members of its hubs, so counts of members per (hub, shard) say where its neighbours are, and no pair of
documents is ever made. In each round a linked document asks for the shard that holds most of its
neighbours; a shard admits as many as its quota and the leavers of the round leave, strongest pull first. Documents
without links are ballast: they cost no cut edge and fill the shards to exact sizes at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage

#: Slices of a hub in joins, so that a hub with a third of all rows spreads over this many tasks.
SALTS = 32
#: Ranges of the random order used for ranks inside a shard.
RANGES = 512


def ranked(df: DataFrame, group: str, order: list, name: str, range_by) -> DataFrame:
    """Gapless ranks from 0 inside `group` in the order (range_by, order), without one task per group.

    `range_by` is a number from 0 to RANGES - 1 or near it: ranks run inside (group, range), and ranges start where
    the counts of those before them end.
    """
    ranged = df.withColumn("__range", range_by)
    sizes = ranged.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    start = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "__range", start.alias("__start"))
    inside = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)) - 1
    return (ranged.withColumn("__inside", inside).join(sizes, [group, "__range"])
            .withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__range", "__inside", "__start"))


def _random(seed: int, *cols):
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(RANGES)).cast("int")


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _case(column, values: list[int]):
    """values[column] as an expression; `values` has one entry per shard."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (column + 1).cast("int"))


def _admissible(flows: list[list[int]], held: list[int], quotas: list[int]) -> list[list[int]]:
    """A part of flows[from][to] to which nothing can be added: cycles of moves between shards, and chains of moves that end in free room."""
    shards = range(len(quotas))
    left, room = [list(f) for f in flows], [q - h for q, h in zip(quotas, held, strict=True)]
    again = True
    while again:
        again = False
        for s in shards:
            for t in shards:
                while left[s][t] > 0:
                    before, queue, end = {t: s}, [t], None
                    while queue and end is None:
                        u = queue.pop(0)
                        if u == s or room[u] > 0:
                            end = u
                        else:
                            new = [v for v in shards if left[u][v] > 0 and v not in before]
                            before |= dict.fromkeys(new, u)
                            queue += new
                    if end is None:
                        break
                    steps = [(before[end], end)]
                    while steps[-1] != (s, t):
                        steps.append((before[steps[-1][0]], steps[-1][0]))
                    n = min([left[i][j] for i, j in steps] + ([] if end == s else [room[end]]))
                    for i, j in steps:
                        left[i][j] -= n
                    room[end] -= n
                    room[s] += n
                    again = True
    return [[f - k for f, k in zip(fs, ks, strict=True)] for fs, ks in zip(flows, left, strict=True)]


def propagate(linked: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """Move linked rows (row_key, hub, shard) towards the shards of their neighbours under `quotas`.

    A round is one aggregation to (hub, shard) counts, one choice per hub and current shard, one join
    of that choice back on (hub, shard, salt), and ranks inside the (from, to) pair. The driver sees one count per pair of shards.
    A shard admits what its free room and its leavers of the round leave. Rounds ask in turn for the fullest shard and for the
    fullest with free room. Every move raises the sum of squared counts, so rounds end: when neither kind moves a row, or after `rounds`.
    """
    shards = len(quotas)
    state, idle, step = linked, 0, 0
    while idle < 2 and (rounds is None or step < rounds):
        by = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
        held = [by.get(s, 0) for s in range(shards)]
        # a shard full of the hub is no aim; in odd rounds only shards with room are
        room = [q - h if step % 2 else 1 for q, h in zip(quotas, held, strict=True)]
        here = state.groupBy("hub", "shard").agg(F.count("*").alias("n"))
        hub = Window.partitionBy("hub")
        aim = (_case(F.col("shard"), room) > 0) & (F.col("n") < _case(F.col("shard"), quotas))
        best = F.max(F.when(aim, F.struct(F.col("n"), F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("to")))).over(hub)
        wish = here.withColumn("best", best).filter(
            F.col("best").isNotNull() & (F.col("best.to") != F.col("shard")) & (F.col("n") < _case(F.col("shard"), quotas))
            & (F.struct(F.col("best.n"), F.col("best.tie")) > F.struct(F.col("n"), F.xxhash64("hub", "shard"))))
        wish = wish.select("hub", "shard", (F.col("shard") * shards + F.col("best.to")).alias("pair"), (F.col("best.n") - F.col("n")).alias("gain"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        movers = stage(state.join(wish, ["hub", "shard", "salt"]).select("row_key", "pair", "gain"))
        flows = [[0] * shards for _ in range(shards)]
        for r in movers.groupBy("pair").agg(F.count("*").alias("n")).collect():  # one row per pair of shards
            flows[r["pair"] // shards][r["pair"] % shards] = r["n"]
        admits = _admissible(flows, held, quotas)
        step += 1
        if not any(map(any, admits)):
            idle += 1
            continue
        idle = 0
        # strongest pull first: ranges go down with the gain's size, and are random among equal gains
        pull = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(62)).cast("int")
        order = (F.lit(62) - pull) * F.lit(RANGES) + _random(step, "row_key")
        admitted = ranked(movers, "pair", ["row_key"], "rank", order).filter(F.col("rank") < _case(F.col("pair"), sum(admits, [])))
        admitted = admitted.select("row_key", (F.col("pair") % shards).alias("to"))
        state = stage(state.join(admitted, "row_key", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return state


def even_shards(rows: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless from 0 in a shard) to rows with a unique `row_key` and a `hub`.

    Law `rows`: counts of shards are at most one apart. A null hub links to nothing. A hub with more rows than a
    shard's quota has to spread; moves end in a local optimum, in which it need not fill whole shards (2,000 rows in 8 shards, a hub of 667: 199, 123, 89 and
    less). An empty table gives an empty result.
    """
    total = rows.count()
    quotas = _quotas(total, shards)
    start = stage(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), F.coalesce(F.col("hub"), F.col("row_key"))), F.lit(shards)).cast("int"))
                  .withColumn("salt", F.pmod(F.xxhash64(F.lit(11), "row_key"), F.lit(SALTS)).cast("int")))
    # linked rows start spread at random, whatever their hub's size; a hub gathers by moves alone
    several = (start.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1")
               .select("hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    linked = start.filter("hub is not null").join(several, ["hub", "salt"], "left_semi")
    linked = linked.withColumn("shard", F.pmod(F.xxhash64(F.lit(13), "row_key"), F.lit(shards)).cast("int")).select("row_key", "hub", "salt", "shard")
    placed = propagate(stage(linked), quotas, rounds)
    merged = (start.select("row_key", "shard").join(placed.select("row_key", F.col("shard").alias("to")), "row_key", "left")
              .select("row_key", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("is_linked")))
    # linked rows come first in a shard, so what exceeds the quota is ballast wherever there is any
    order = F.when(F.col("is_linked"), F.lit(0)).otherwise(F.lit(RANGES)) + _random(17, "row_key")
    seated = stage(ranked(merged, "shard", ["row_key"], "slot", order))
    held = {r["shard"]: r["n"] for r in seated.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    free = [(s, q - held.get(s, 0)) for s, q in enumerate(quotas) if q > held.get(s, 0)]
    fits = seated.filter(F.col("slot") < _case(F.col("shard"), quotas)).select("row_key", "shard", "slot")
    over = seated.filter(F.col("slot") >= _case(F.col("shard"), quotas)).select("row_key", F.lit(0).alias("all"))
    over = ranked(over, "all", ["row_key"], "seat", _random(19, "row_key"))
    ends, total_free = [], 0
    for _, n in free:
        total_free += n
        ends.append(total_free)
    if free:
        # seat k goes to the first shard whose running total of free seats exceeds k
        at = F.lit(None).cast("int")
        slot = F.lit(None).cast("long")
        for (s, n), end in reversed(list(zip(free, ends, strict=True))):
            at = F.when(F.col("seat") < end, F.lit(s)).otherwise(at)
            slot = F.when(F.col("seat") < end, F.col("seat") - (end - n) + held.get(s, 0)).otherwise(slot)
        fits = fits.unionByName(over.select("row_key", at.alias("shard"), slot.cast("long").alias("slot")))
    return rows.join(fits, "row_key")


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; equal texts are linked.

    A null text has size 1, CRC 0 and no links; empty texts are equal texts like any other. Repeated rows get
    slots of their own. Other columns are ignored. The same files read the same way give the same shards. Two texts are equal if their XXH64, CRC and size are.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    # the position tells repeated rows apart; it is written once, so every later step sees the same
    light = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
                              F.crc32(data).cast("long").alias("text_crc32"),
                              F.when(F.col("text").isNotNull(), F.xxhash64("text", F.crc32(data), F.octet_length(data))).alias("hub"),
                              F.monotonically_increasing_id().alias("position")))
    out = even_shards(light.withColumnRenamed("position", "row_key"), shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      "slot", F.lit(None).cast("int").alias("grown_shard"))

