"""SimHash near-duplicates with BK-trees, and near copies (keep_one), for which the trees give the first candidates.

Fingerprints within 3 bits of each other agree in at least 2 of 5 bit blocks, so the fingerprints that share a
pair of blocks form a shard, and every link lies inside some shard. In a shard a BK-tree holds the fingerprints: a child
hangs on the edge that carries its Hamming distance to the parent. A search follows only edges whose
distance differs from the query's by the radius at most. A shard's size has no bound, so trees are not broadcast:
Spark brings the searches to the trees by key, and a large shard becomes several trees, each sent to
slices of the shard's searches of a bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of, stage, unstage
from barloom.llm.graph import components

RADIUS = 3
BLOCKS = 5
#: Fingerprints in one tree, and searches sent to one copy of it.
TREE_SIZE = 4096
#: Rows for which trees are built at once in a task.
FOREST_ROWS = 65536
#: Near copies for keep_one: words in a shingle, least similarity (4/5) of two shingle sets, bands and minima in a band.
#: Two texts of similarity s agree in no band with probability (1 - s**5)**30: 7 in a million at 0.8.
SHINGLE = 5
ALIKE = (4, 5)
BANDS = 30
BAND_ROWS = 5
#: Members of a bucket that may list their pairs, and slots of the table that orders shingles by frequency (1 MiB).
SMALL_BUCKET = 8
ORDER_SLOTS = 1 << 17

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = [tuple(np.uint64(xxhash.xxh64_intdigest(b"%d %d" % (i, k), 42) | 1) for k in range(2)) for i in range(BANDS * BAND_ROWS)]


def bit_counts(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, 64) counts of set bits over each document's run of hashes. Every length is at least 1."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # runs of at most 255 hashes, whose counts fit in a byte
    per = -(-lengths // 255)
    owner = np.repeat(np.arange(len(lengths)), per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = starts[owner] + within * 255
    ends = np.append(at[1:], len(hashes))
    out = np.zeros((len(lengths), 64), dtype=np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for lo in range(0, len(at), 1024):
        a, b = at[lo], ends[min(lo + 1024, len(at)) - 1]
        lanes = np.add.reduceat(_LANES[octets[a:b]], at[lo:lo + 1024] - a, axis=0)
        np.add.at(out, owner[lo:lo + 1024], lanes.astype("<u8").view(np.uint8).reshape(-1, 64))
    return out


def _joined(data: bytes) -> tuple[bytes, list[int]]:
    """The words in lower case, joined by blanks, and where the word after each begins."""
    words = data.lower().split()
    return b" ".join(words), list(itertools.accumulate(len(w) + 1 for w in words))


def _runs(joined: bytes, ends: list[int], width: int) -> list[int]:
    if not ends:
        return []
    digest = xxhash.xxh64_intdigest
    if len(ends) <= width:
        return [digest(joined, 42)]
    return [digest(joined[a:b], 42) for a, b in zip(itertools.chain((0,), ends), (e - 1 for e in ends[width - 1:]))]


def shingle_hashes(data: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of every run of `width` words, repeats included; of all words if there are fewer; none without words."""
    return _runs(*_joined(data), width)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text as uint64; 0 for a text without words."""
    return _majorities([shingle_hashes(t) for t in texts])


def _majorities(hashes: list[list[int]]) -> np.ndarray:
    lengths = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    some = lengths > 0
    if some.any():
        flat = np.fromiter(itertools.chain.from_iterable(hashes), dtype=np.uint64, count=int(lengths.sum()))
        ones = bit_counts(flat, lengths[some]) * 2 > lengths[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        found = fingerprints(batch["data"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long); one pass over the texts, no shuffle."""
    return docs_of(docs).mapInArrow(_fingerprint, "doc_id long, fp long")


class Forest:
    """BK-trees, one per group of fingerprints, built and searched level by level for all groups at once."""

    def __init__(self, fps: np.ndarray, roots: np.ndarray):
        """roots[i]: index of the first fingerprint of i's group, the group's root. Fingerprints are distinct inside a group."""
        self.fps = fps
        edges, children = [], []
        active = np.flatnonzero(roots != np.arange(len(fps)))
        parent = roots[active]
        while len(active):
            edge = parent * 65 + np.bitwise_count(fps[active] ^ fps[parent])
            unique, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(unique)
            children.append(active[first])
            rest = np.ones(len(active), dtype=bool)
            rest[first] = False
            parent = active[first][inverse][rest]
            active = active[rest]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.children = self.edges[order], self.children[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, node index) of all nodes of the query's tree within the radius."""
        hits_q, hits_n = [], []
        q, node = np.arange(len(queries)), roots
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            hits_q.append(q[near])
            hits_n.append(node[near])
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right") - lo
            q = np.repeat(q, n)
            node = self.children[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.concatenate(hits_q) if hits_q else q, np.concatenate(hits_n) if hits_n else node


def _union(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the sets of u[i] and v[i]; parent is kept flat, each set's parent its smallest index."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def _spanning_links(groups: np.ndarray, fps: np.ndarray, roles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that connect what lies within the radius, at most one per row. groups is sorted;
    role 0 is in the tree and searches, 1 is in the tree only, 2 searches only."""
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(first, len(groups)))
    keep = np.repeat(sizes > 1, sizes)  # a row alone has nothing to link with
    groups, fps, roles = groups[keep], fps[keep], roles[keep]
    in_tree = np.flatnonzero(roles != 2)
    searching = np.flatnonzero(roles != 1)
    if not len(in_tree) or not len(searching):
        return fps[:0], fps[:0]
    tree_groups = groups[in_tree]
    firsts = np.searchsorted(tree_groups, tree_groups, "left")
    forest = Forest(fps[in_tree], firsts)
    start = np.searchsorted(tree_groups, groups[searching], "left")
    found = start < len(tree_groups)
    found[found] = tree_groups[start[found]] == groups[searching][found]
    searching, start = searching[found], start[found]
    parent = np.arange(len(fps))
    for lo in range(0, len(searching), 512):
        part = searching[lo:lo + 512]
        q, n = forest.search(fps[part], start[lo:lo + 512], radius)
        _union(parent, part[q], in_tree[n])
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked], fps[parent[linked]]


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            groups, fps, roles = (np.concatenate([h[i] for h in held]) for i in range(3))
            cut = len(groups) if last else int(np.searchsorted(groups == groups[-1], True))  # the last group may go on
            if cut:
                u, v = _spanning_links(groups[:cut], fps[:cut].view(np.uint64), roles[:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
            held = [(groups[cut:], fps[cut:], roles[cut:])] if cut < len(groups) else []
            rows = len(groups) - cut

        for batch in batches:
            held.append(tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("shard", "fp", "role")))
            rows += batch.num_rows
            if rows >= FOREST_ROWS:
                yield from flush(False)
        yield from flush(True)

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within `radius` bits, without listing all pairs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bit_blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in itertools.combinations(bit_blocks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shard = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
    keyed = fps.select("fp", shard.alias("key"))
    # shards too large for one tree: their size in trees
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tree_size).select("key", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    keyed = keyed.join(large, "key", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("trees")).cast("int")
    every = F.sequence(F.lit(0), F.col("trees") - 1)
    single = keyed.filter("trees = 1").select(F.col("key").alias("shard"), "fp", F.lit(0).alias("role"))
    split = keyed.filter("trees > 1").withColumn("own", own)
    trees = split.select("key", "fp", F.col("own").alias("tree"), F.explode(every).alias("slice"), F.lit(1).alias("role"))
    searches = split.select("key", "fp", F.explode(every).alias("tree"), F.col("own").alias("slice"), F.lit(2).alias("role"))
    split = trees.unionByName(searches).select(F.xxhash64("key", "tree", "slice").alias("shard"), "fp", "role")
    dealt = single.unionByName(split).repartition("shard").sortWithinPartitions("shard", "role", "fp")
    return dealt.mapInArrow(_link(radius), "u long, v long")


def classes(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every distinct fingerprint."""
    printed = stage(with_fingerprints(docs))
    distinct = stage(printed.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(near_links(distinct.select("fp"), radius))
    rooted = stage(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc"))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return printed, rooted.join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and blank texts have fingerprint 0 and are linked like any other. A component whose documents all
    have null ids has a null component_id. Repeated rows stay. Other columns are ignored; an empty table gives an empty result.
    """
    printed, per_fp = classes(docs, radius)
    return printed.join(per_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_copy_prints(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of all columns), key (equal for equal words, 0 without words), n (distinct shingles), fp and bands of every row."""
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(docs).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInArrow(_band, "doc_id long, row long, key long, n int, fp long, bands array<long>")


def band_keys(shingles: list[list[int]]) -> np.ndarray:
    """(texts, BANDS) hashes of BAND_ROWS smallest shingle hashes each, under as many orders. No list is empty."""
    flat = np.fromiter(itertools.chain.from_iterable(shingles), dtype=np.uint64)
    starts = np.cumsum([0] + [len(s) for s in shingles[:-1]])
    out = np.zeros((len(shingles), BANDS), dtype=np.uint64)
    for i, (a, b) in enumerate(_ORDERS):
        least = np.minimum.reduceat(flat * a + b, starts)
        at = i // BAND_ROWS
        out[:, at] = (out[:, at] ^ (least >> np.uint64(29)) ^ least) * _MIX + np.uint64(at + 1)
    return out


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = [_joined(t) for t in batch["data"].to_pylist()]
        fps = _majorities([_runs(*t, 3) for t in texts])
        shingles = [_runs(*t, SHINGLE) for t in texts]
        some = [i for i, s in enumerate(shingles) if s]
        counts = np.zeros(len(texts) + 1, dtype=np.int32)
        counts[1:] = [BANDS if s else 0 for s in shingles]
        found = band_keys([shingles[i] for i in some]).view(np.int64).ravel() if some else np.zeros(0, dtype=np.int64)
        keys = np.array([xxhash.xxh64_intdigest(joined, 43) if ends else 0 for joined, ends in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["row"], pa.array(keys), pa.array([len(set(s)) for s in shingles], pa.int32()), pa.array(fps.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(found))], ["doc_id", "row", "key", "n", "fp", "bands"])


def _shingle_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = [np.unique(np.array(shingle_hashes(t, SHINGLE), dtype="<u8")).tobytes() for t in batch["data"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(sets, pa.binary())], ["key", "shingles"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        keep = []
        for a, b in zip(batch["su"], batch["sv"]):
            a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns; maps, which have no hash, by their JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def _places(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(11)) & np.uint64(ORDER_SLOTS - 1)


def shingle_order(sets: DataFrame) -> np.ndarray:
    """How many sets hold shingles of each of ORDER_SLOTS hash slots: a table of fixed size that orders shingles from rare to common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_SLOTS, dtype=np.int64)
        for batch in batches:
            for s in batch["shingles"]:
                counts += np.bincount(_places(np.frombuffer(s.as_buffer(), "<u8")).astype(np.int64), minlength=ORDER_SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDER_SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(order: np.ndarray):
    """The rarest shingles of each set, one more than may be missing from a set of similarity 0.8, with their places in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            token, at = [], []
            for s in batch["shingles"]:
                own = np.frombuffer(s.as_buffer(), "<u8")
                ranked = own[np.lexsort((own, order[_places(own).astype(np.int64)]))]
                token.append(ranked[:len(own) - -(-len(own) * ALIKE[0] // ALIKE[1]) + 1].view(np.int64))
                at.append(np.arange(len(token[-1]), dtype=np.int32))
            owner = np.repeat(np.arange(batch.num_rows), [len(t) for t in token])
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(owner)), pa.array(np.concatenate(token)), pa.array(np.concatenate(at))], ["key", "token", "at"])

    return run


def crowded_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v, nu, nv) of members (key, n, root) of different roots that may have similarity 0.8, by prefix filtering.

    Sets of such similarity have one of their rarest fifth of shingles in common, in any one order of all shingles; ordered from rare to
    common, what a crowd shares comes last and makes no pair. Pairs whose sizes or remaining shingles cannot reach the similarity go.
    No pair of that similarity is lost.
    """
    held = stage(sets.join(members.select("key"), "key", "left_semi"))
    rare = stage(held.mapInArrow(_prefixes(shingle_order(held)), "key long, token long, at int").join(members, "key"))
    one, other = (rare.select("token", *[F.col(c).alias(f"{c}{side}") for c in ("key", "n", "root", "at")]) for side in "uv")
    met = one.join(other, "token").filter("keyu < keyv and rootu != rootv")
    met = met.filter(F.least("nu", "nv") * ALIKE[1] >= F.greatest("nu", "nv") * ALIKE[0])
    left = F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv"))  # shingles in common from here on, at most
    met = met.filter(left * sum(ALIKE) >= (F.col("nu") + F.col("nv")) * ALIKE[0])
    return met.select(F.col("keyu").alias("u"), F.col("keyv").alias("v"), "nu", "nv").distinct()


def fingerprint_pairs(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v, nu, nv) of keys: the links that BK-trees give between fingerprints, and each text with one of those of equal fingerprint.

    A fingerprint is searched once, however many texts have it. Texts without words take no part.
    """
    texts = stage(printed.filter("n > 0").select("fp", "key", "n").distinct())
    firsts = stage(texts.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first")).select("fp", "first.*"))
    u, v = (firsts.select(F.col("fp").alias(f"f{at}"), F.col("key").alias(at), F.col("n").alias(f"n{at}")) for at in "uv")
    links = near_links(firsts.select("fp"), radius).select(F.col("u").alias("fu"), F.col("v").alias("fv")).distinct()
    across = links.join(u, "fu").join(v, "fv").select("u", "v", "nu", "nv")
    same = texts.join(u, texts["fp"] == u["fu"]).filter("key != u").select("u", F.col("key").alias("v"), "nu", F.col("n").alias("nv"))
    pairs = stage(across.unionByName(same))
    unstage(texts, firsts)
    return pairs


def near_copy_links(docs: DataFrame, printed: DataFrame) -> DataFrame:
    """Links (u, v) between keys whose sets of five-word shingles have similarity 0.8 or more; they connect what all such pairs would.

    Candidates are texts whose SimHash fingerprints BK-trees find within RADIUS bits, and, as copies of such similarity differ by
    some ten bits on average, also texts that agree in a band; every link is checked exactly. What the trees have joined is not held against each other
    again. A bucket's members are first held against one, then
    against several leaders, which joins a large group of near copies at the cost of its size. Between what is then still apart, buckets of at most
    SMALL_BUCKET members list their pairs; members of larger ones meet by `crowded_pairs`, so texts that merely share a long
    passage are not listed against each other.
    """
    keyed = stage(printed.filter("n > 0").select("key", "n", F.explode("bands").alias("band")).distinct())
    shared = keyed.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1").select("band")
    buckets = stage(keyed.join(shared, "band", "left_semi"))
    close = fingerprint_pairs(printed)
    # the shingles of one row per candidate key
    candidates = buckets.select("key").unionByName(close.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    rows = printed.join(candidates, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    data = docs.select(_row_hash(docs).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    sets = stage(data.join(rows, "row").select("key", "data").mapInArrow(_shingle_set, "key long, shingles binary"))
    unstage(keyed)

    def checked(pairs: DataFrame) -> DataFrame:
        # sizes further apart than the similarity cannot reach it
        pairs = pairs.filter(F.least("nu", "nv") * ALIKE[1] >= F.greatest("nu", "nv") * ALIKE[0])
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        both = pairs.join(sets.select(F.col("key").alias("u"), F.col("shingles").alias("su")), "u").join(
            sets.select(F.col("key").alias("v"), F.col("shingles").alias("sv")), "v")
        return stage(both.mapInArrow(_alike, "u long, v long").distinct())

    def apart(state: DataFrame, bound: str) -> DataFrame:
        some = state.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).filter(f"a != b and {bound}")
        return state.join(some.select("band"), "band", "left_semi")

    def side(df: DataFrame, at: str) -> DataFrame:
        return df.select("band", F.col("key").alias(at), F.col("n").alias(f"n{at}"), F.col("root").alias(f"r{at}"))

    def joined(links: DataFrame) -> DataFrame:
        roots = stage(components(links).distinct())
        return stage(buckets.join(roots, buckets["key"] == roots["node"], "left").select("band", "key", "n", F.coalesce("root", "key").alias("root")))

    links = checked(close)
    unstage(close)
    state = joined(links)
    for leaders in (1, 4):
        # the same order in every band, so that the bands of a group choose the same leaders
        firsts = F.array(*[F.min(F.struct(F.xxhash64(F.lit(23 * leaders + i), "u").alias("order"), "u", "nu", "ru")) for i in range(leaders)])
        some = apart(state, "true")
        one = side(some, "u").groupBy("band").agg(F.array_distinct(firsts).alias("firsts")).select("band", F.inline("firsts")).drop("order").distinct()
        found = checked(one.join(side(some, "v"), "band").filter("ru != rv"))
        links = links.unionByName(found)
        state = joined(links)
    small = apart(state, f"members <= {SMALL_BUCKET}")
    few = side(small, "u").join(side(small, "v"), "band").filter("ru < rv").select("u", "v", "nu", "nv")
    crowd = stage(apart(state, f"members > {SMALL_BUCKET}").select("key", "n", "root").distinct())
    return links.unionByName(checked(few.unionByName(crowded_pairs(crowd, sets))))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component of texts with similarity 0.8 or more one row stays, that with the smallest (id, row hash).

    Rows that share an id stay apart where their texts do; of rows equal in every column one stays. Rows without an id stay only where
    a component has no id at all. Blank and null texts are one component.
    """
    printed = stage(near_copy_prints(docs))
    roots = components(near_copy_links(docs, printed))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row")).alias("best")
    per_key = printed.groupBy("key").agg(best)
    rooted = per_key.join(roots, per_key["key"] == roots["node"], "left").select(F.coalesce("root", "key").alias("root"), "best")
    chosen = stage(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.row").alias("__kept")))
    again = stage(printed.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__id"), F.col("row").alias("__kept")))
    rows = docs.withColumn("__row", _row_hash(docs))

    def of(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        return rows.join(some, (rows["__row"] == some["__kept"]) & rows["doc_id"].cast("long").eqNullSafe(some["__id"]), how)

    kept = of(rows, chosen, "left_semi")
    # only rows that repeat are dealt anew
    return of(kept, again, "left_anti").unionByName(of(kept, again, "left_semi").dropDuplicates(["__row"])).drop("__row")
