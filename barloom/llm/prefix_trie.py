"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its key is the exclusive or of hashes of (depth, turn) along the sequence, so keys
of all prefixes are running totals in bounded chunks of a conversation. The tour of the trie enters and leaves every
node once: two arcs a node, each with one successor. The list of arcs is ranked by contraction: in each
round arcs whose coin is tails, and whose predecessor's is heads, leave the list and remember how far they are behind it, until a
list of bounded size is left, which is walked; then the rounds are undone in reverse. Leaves and savings are
running totals at the arcs' positions, and a subtree's are the difference between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stage
from barloom.llm.ordering import in_ranges, running_totals

#: Turns of a conversation in one chunk.
CHUNK = 1024
#: Arcs that may be left for the walk of the contracted list.
WALK = 20_000
#: Groups of conversations that share a beginning, and the turns they may share.
GROUP = 5
SHARED = 9


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, part, pos, digest, bytes) of every turn, (conv, part, before, n) of every conversation and range).

    `before` turns of the conversation lie in earlier ranges and n in all, so the position is `before` + `pos`.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    slim = stage(conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = in_ranges(slim, order)
    local = ranged.withColumn("pos", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("conv", "part").agg(F.count("*").alias("here")).select(
        "conv", "part", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("conv")).alias("n"))
    return local.drop("turn"), stage(parts)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, digest, bytes) of every turn after rebuilding, (conv, length) of every conversation).

    A conversation gets the first h turns of the first of its group, then its own turns after its first h.
    """
    turns, parts = ordered_turns(conversations)
    base = F.col("conv") - F.col("conv") % GROUP
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("long")
    counted = parts.groupBy("conv").agg(F.max("n").alias("n")).withColumns({"base": base, "h": shared})
    n_base = counted.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = stage(counted.join(n_base, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv", "base", "n", "h", "m"))
    # per range of a conversation, so that one with very many turns is met by its ranges and not as one key
    placed = stage(turns.join(parts.join(convs.select("conv", "h", "m"), "conv"), ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("pos")).alias("pos"), "digest", "bytes", "h", "m"))
    own = placed.filter("pos > h").select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("depth"), "digest", "bytes")
    first = placed.filter(F.col("pos") < SHARED).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    begun = convs.filter("m > 0").select("conv", "base", "m").join(first, "base").filter("pos <= m").select("conv", F.col("pos").alias("depth"), "digest", "bytes")
    lengths = convs.select("conv", (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    return begun.unionByName(own), lengths


def prefix_keys(turns: DataFrame) -> DataFrame:
    """The turns with the 128-bit key (k1, k2) of the prefix that ends at them and the key (p1, p2) of the one before."""
    own = turns.withColumns({"g1": F.xxhash64(F.lit(1), "depth", "digest"), "g2": F.xxhash64(F.lit(2), "depth", "digest"), "chunk": F.floor((F.col("depth") - 1) / CHUNK)})
    upto = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = own.withColumns({"l1": F.bit_xor("g1").over(upto), "l2": F.bit_xor("g2").over(upto)})
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("conv", "chunk").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2")).select(
        "conv", "chunk", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)])
    keyed = local.join(carried, ["conv", "chunk"]).withColumns({f"k{i}": F.col(f"l{i}").bitwiseXOR(F.col(f"c{i}")) for i in (1, 2)})
    return keyed.select("conv", "depth", "bytes", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)])


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces, joined by commas; rows come sorted by group and piece, memory holds one state."""
    held, state = None, None
    for batch in batches:
        rows = []
        for key, ids in zip(zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth"))), batch["ids"].to_pylist()):
            if key != held:
                if held is not None:
                    rows.append((*held, state.hexdigest()))
                held, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth", "ends_sha256"), r)) for r in rows], _ENDS)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth", "ends_sha256"), (*held, state.hexdigest())))], _ENDS)


_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256: the hash of the ids, ascending, of the conversations that end at a node.

    Ids are joined in blocks of 4,096 numbers first; the hash, which has no parts, then reads one row a block, as a stream.
    """
    blocks = ends.withColumn("block", F.shiftright("conv", 12)).groupBy("k1", "k2", "depth", "block").agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    dealt = blocks.repartition("k1", "k2", "depth").sortWithinPartitions("k1", "k2", "depth", "block")
    return dealt.mapInArrow(_hash_runs, "k1 long, k2 long, depth long, ends_sha256 string")


def trie_nodes(keyed: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes named by (conv, depth), conv being the smallest member: parent, members, saved tokens, children, first child, next sibling.

    keyed: `prefix_keys` of all turns.
    """
    grouped = keyed.groupBy("k1", "k2", "depth").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    none = F.lit(None).cast("long")
    root = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"), "conv", "n_convs", F.lit(0).cast("long").alias("bytes"), none.alias("p1"), none.alias("p2"))
    nodes = stage(grouped.unionByName(root))
    kin = nodes.filter("depth > 0").groupBy("p1", "p2", "depth").agg(F.count("*").alias("n_children"), F.min("conv").alias("child"))
    kin = kin.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), "n_children", "child")
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"))
    full = nodes.join(kin, ["k1", "k2", "depth"], "left").join(above, ["p1", "p2", "depth"], "left").select(
        "k1", "k2", "conv", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "child", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    # siblings in order of their smallest member; a parent of very many children is cut into ranges
    ranged = in_ranges(stage(full), [F.col("depth"), F.col("parent"), F.col("conv")])
    inside = Window.partitionBy("depth", "parent", "part").orderBy("conv")
    firsts = ranged.groupBy("depth", "parent", "part").agg(F.min("conv").alias("first"))
    firsts = firsts.select("depth", "parent", "part", F.lead("first").over(Window.partitionBy("depth", "parent").orderBy("part")).alias("after"))
    linked = ranged.withColumn("beside", F.lead("conv").over(inside)).filter("depth > 0").join(firsts, ["depth", "parent", "part"])
    top = ranged.filter("depth = 0").withColumns({"beside": none, "after": none})
    return stage(linked.unionByName(top.select(linked.columns)).withColumn("sibling", F.coalesce("beside", "after")).drop("beside", "after", "part"))


def arc(conv: Column, depth: Column, side: int) -> Column:
    """Arc that enters (side 0) or leaves (side 1) the node (conv, depth)."""
    return F.struct(conv.cast("long").alias("conv"), depth.cast("long").alias("depth"), F.lit(side).alias("side"))


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs `a` with the next arc of the tour, `nxt`; null after the last."""
    conv, depth = F.col("conv"), F.col("depth")
    entering = nodes.select(arc(conv, depth, 0).alias("a"), F.when(F.col("n_children") > 0, arc(F.col("child"), depth + 1, 0)).otherwise(arc(conv, depth, 1)).alias("nxt"))
    leaving = nodes.select(arc(conv, depth, 1).alias("a"), F.when(F.col("sibling").isNotNull(), arc(F.col("sibling"), depth, 0))
                           .when(depth > 0, arc(F.col("parent"), depth - 1, 1)).alias("nxt"))
    return entering.unionByName(leaving)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = list(frames)
    if not sum(map(len, held)):
        return
    rows = pd.concat(held)
    after = {a: (n, w) for a, n, w in zip(rows["a"], rows["nxt"], rows["w"])}
    at = next(iter(set(after) - {n for n, _ in after.values()}))
    out, pos = [], 0
    while at is not None and at in after:
        out.append((at, pos))
        at, step = after[at]
        pos += step
    yield pd.DataFrame(out, columns=["a", "pos"])


def list_ranks(arcs: DataFrame, n: int, walk: int = WALK) -> DataFrame:
    """Position `pos` from 0 of every arc of one list of `n` arcs (a, nxt).

    A round takes about a quarter of the arcs out, so rounds grow with the logarithm of n and all rounds together handle about 4 n rows. At most
    `walk` arcs are walked in one task.
    """
    def heads(column: str, turn: int) -> Column:
        return F.xxhash64(F.lit(turn), column).bitwiseAND(F.lit(1)) == 1

    held = stage(arcs.withColumn("w", F.lit(1).cast("long")))
    taken_out, turn = [], 0
    while n > walk:
        stay = held.filter(heads("a", turn)).select(F.col("a").alias("sa"), F.col("nxt").alias("sn"), F.col("w").alias("sw"))
        go = held.filter(~heads("a", turn)).select(F.col("a").alias("ga"), F.col("nxt").alias("gn"), F.col("w").alias("gw"))
        met = stage(stay.join(go, F.col("sn") == F.col("ga"), "full_outer"))
        both = F.col("sa").isNotNull() & F.col("ga").isNotNull()
        held = met.select(F.coalesce("sa", "ga").alias("a"), F.when(F.col("ga").isNotNull(), F.col("gn")).otherwise(F.col("sn")).alias("nxt"),
                          (F.coalesce("sw", F.lit(0)) + F.coalesce("gw", F.lit(0))).alias("w"))
        out = met.filter(both).select("ga", "sa", "sw")
        n -= out.count()
        taken_out.append(out)
        turn += 1
    text = F.concat_ws(" ", "a.conv", "a.depth", "a.side")
    after = F.when(F.col("nxt").isNotNull(), F.concat_ws(" ", "nxt.conv", "nxt.depth", "nxt.side"))
    walked = held.select(text.alias("a"), after.alias("nxt"), "w").coalesce(1).mapInPandas(_walk, "a string, pos long")
    part = lambda i: F.split("a", " ").getItem(i)
    ranks = stage(walked.select(F.struct(part(0).cast("long").alias("conv"), part(1).cast("long").alias("depth"), part(2).cast("int").alias("side")).alias("a"), "pos"))
    for out in reversed(taken_out):
        ranks = stage(ranks.unionByName(out.join(ranks, F.col("sa") == F.col("a")).select(F.col("ga").alias("a"), (F.col("pos") + F.col("sw")).alias("pos"))))
    return ranks


def prefix_trie(conversations: DataFrame, walk: int = WALK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns with equal numbers by a digest of role and text. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    turns, lengths = rebuilt_turns(conversations)
    lengths, keyed = stage(lengths), stage(prefix_keys(turns))
    nodes = trie_nodes(keyed, lengths)
    n = 2 * nodes.count()
    ranks = list_ranks(tour(nodes), n, walk)
    values = nodes.select("conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    placed = ranks.select("a.conv", "a.depth", "a.side", "pos").join(values, ["conv", "depth"])
    enters = F.col("side") == 0
    sums = running_totals(stage(placed), "pos", n, {"leaves": F.when(enters, F.col("leaf")).otherwise(0), "savings": F.when(enters, F.col("saved")).otherwise(0)})
    # from before the arc that enters to the arc that leaves
    share = lambda total, own: F.sum(F.when(enters, F.col(own) - F.col(total)).otherwise(F.col(total)))
    below = sums.groupBy("conv", "depth").agg(share("leaves", "leaf").alias("n_leaves"), share("savings", "saved").alias("saved_tokens"))
    last = keyed.join(lengths.filter("length > 0").select("conv", F.col("length").alias("depth")), ["conv", "depth"]).select("k1", "k2", "depth", "conv")
    zero = F.lit(0).cast("long")
    ends = end_hashes(last.unionByName(lengths.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv")))
    out = nodes.join(below, ["conv", "depth"]).join(ends, ["k1", "k2", "depth"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
