"""Token-id files: ids in ascending order of documents, coded by an adaptive context-mixing range coder.

A file is a run of segments, each a whole number of documents: a header, the documents' ids and lengths, and
blocks of a fixed number of token ids. Each block is coded on its own: its models start empty and its bytes
carry a CRC, so a lost or damaged block costs no other. All blocks of a segment are coded side by side as lanes of numpy arrays.

Predictions of an id: the id last seen after the two ids before it (order 2), the id last seen after the one before it
(order 1), and how often each band of ids occurred (order 0). One adaptive distribution, chosen by which predictions there are,
mixes them into one interval: order-2 hit, order-1 hit, or a band, in which the id then follows uniformly. Counts grow with
every id; the parts of the intervals follow them after 1, 2, 4, 8, 16 and then every 32 ids of a block.
"""

from __future__ import annotations

import functools
import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import chunks, docs_of

MODEL, END_ID = "word_bpe_49k.json", 2
MAGIC = b"BTOK2"
BLOCK_IDS, SEGMENT_IDS = 1024, 1 << 21
#: Words whose ids a worker keeps, and the bytes of those words.
CACHE_WORDS, CACHE_BYTES = 800_000, 1 << 25
#: Bands of ids: (first id, bits of the width); short ones where merges are frequent.
BANDS = [(0, 8), (256, 8), (512, 9), (1024, 9), (1536, 9), (2048, 10), (3072, 10), (4096, 11), (6144, 11), (8192, 12), (12288, 12), (16384, 14), (32768, 14), (49152, 14)]
#: Symbols: the order-2 id, the order-1 id, then the bands.
SYMBOLS = 2 + len(BANDS)
BAND_OF = np.repeat(np.arange(2, SYMBOLS), [1 << b for _, b in BANDS]).astype(np.int8)
FIRST = np.array([0, 0] + [a for a, _ in BANDS], dtype=np.uint64)
BITS = np.array([0, 0] + [b for _, b in BANDS], dtype=np.uint64)
GAIN, TABLE = 24, 512
#: Intervals are cut into 2 ** SCALE parts; the parts follow the counts after these many ids of a block.
SCALE = 12
REFRESH = frozenset([1, 2, 4, 8, 16, *range(32, BLOCK_IDS, 32)])
NONE = 0xFFFF  # no id: ids stay below
_WORD = np.uint64(32)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEAST = np.uint64(1 << 32)  # of a span between two ids: 12 and 14 bits leave it wide enough


class Model:
    """The adaptive state of all lanes; a lane whose block has ended stays as it is."""

    def __init__(self, lanes: int):
        self.after2 = np.full(lanes * TABLE, NONE, dtype=np.uint16)
        self.after1 = np.full(lanes * TABLE, NONE, dtype=np.uint16)
        self.counts = np.ones(lanes * 4 * SYMBOLS, dtype=np.int32)  # for each lane, context and symbol
        self.tables, self.rows = np.arange(lanes) * TABLE, np.arange(lanes) * 4 * SYMBOLS
        self.last = np.zeros(lanes, dtype=np.int64)  # the id before
        self.key = self.last * 40503
        self.older = self.key
        self.refresh()

    def refresh(self) -> None:
        """Parts of every context's interval: in proportion to the counts, at least one for each symbol."""
        sums = np.cumsum(self.counts.reshape(-1, SYMBOLS), axis=1, dtype=np.int32)
        ends = sums * np.int32((1 << SCALE) - SYMBOLS) // sums[:, -1:] + np.arange(1, SYMBOLS + 1, dtype=np.int32)
        starts = np.zeros(ends.shape, dtype=np.uint16)
        starts[:, 1:] = ends[:, :-1]
        self.start, self.width = starts.ravel(), (ends.astype(np.uint16) - starts).ravel()

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first n lanes: order-2 id, order-1 id, place of the context's first symbol."""
        self.slot2 = ((self.older[:n] + self.last[:n] * 30103) >> 5 & (TABLE - 1)) + self.tables[:n]
        self.slot1 = (self.key[:n] >> 7 & (TABLE - 1)) + self.tables[:n]
        p2, p1 = self.after2.take(self.slot2), self.after1.take(self.slot1)
        context = (p2 != NONE) + 2 * ((p1 != NONE) & (p1 != p2))
        return p2, p1, self.rows[:n] + context * SYMBOLS

    def update(self, place: np.ndarray, ids: np.ndarray) -> None:
        self.counts[place] = self.counts.take(place) + np.int32(GAIN)
        self.after2[self.slot2] = ids
        self.after1[self.slot1] = ids
        self.older, self.last = self.key, ids.astype(np.int64)
        self.key = self.last * 40503


def _lengths(n: int) -> np.ndarray:
    full, rest = divmod(n, BLOCK_IDS)
    return np.array([BLOCK_IDS] * full + [rest] * (rest > 0), dtype=np.int64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of BLOCK_IDS ids (the last may be shorter), each coded alone."""
    lanes = len(_lengths(len(ids)))
    if not lanes:
        return []
    grid = np.zeros(lanes * BLOCK_IDS, dtype=np.uint16)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK_IDS).T)
    bands = BAND_OF.take(grid)
    offsets = grid - FIRST.take(bands).astype(np.uint16)
    last = len(ids) - (lanes - 1) * BLOCK_IDS
    model = Model(lanes)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, _FULL)
    words = np.zeros((lanes, BLOCK_IDS + 2), dtype=np.uint32)
    at = np.zeros(lanes, dtype=np.int64)
    for t in range(BLOCK_IDS if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        if t in REFRESH:
            model.refresh()
        now = grid[t, :n]
        p2, p1, row = model.predict(n)
        symbol = np.where(p2 == now, 0, np.where(p1 == now, 1, bands[t, :n]))
        place = row + symbol
        part = span[:n] >> np.uint64(SCALE)
        add = part * model.start.take(place)
        part *= model.width.take(place)
        part >>= BITS.take(symbol)
        add += part * np.where(symbol > 1, offsets[t, :n], np.uint16(0))
        span[:n] = part
        low[:n] += add
        carry = np.flatnonzero(low[:n] < add)
        back = at[carry] - 1
        while len(carry):  # one more in the word written last, and in those before it while they overflow
            words[carry, back] += np.uint32(1)
            over = words[carry, back] == 0
            carry, back = carry[over], back[over] - 1
        short = np.flatnonzero(part < _LEAST)
        words[short, at[short]] = low[short] >> _WORD
        at[short] += 1
        low[short] <<= _WORD
        span[short] <<= _WORD
        model.update(place, now)
    lane = np.arange(lanes)
    words[lane, at] = low >> _WORD
    words[lane, at + 1] = low & np.uint64(0xFFFFFFFF)
    return [words[i, :n + 2].astype("<u4").tobytes() for i, n in enumerate(at.tolist())]


def decode_blocks(blocks: list[bytes], n_ids: int) -> np.ndarray:
    """The n_ids ids of the blocks of one segment."""
    lanes = len(_lengths(n_ids))
    if not lanes:
        return np.zeros(0, dtype=np.uint16)
    data = np.zeros((lanes, BLOCK_IDS + 3), dtype=np.uint32)
    for i, b in enumerate(blocks):
        data[i, :len(b) // 4] = np.frombuffer(b, dtype="<u4")
    last = n_ids - (lanes - 1) * BLOCK_IDS
    model = Model(lanes)
    code, span = data[:, 0].astype(np.uint64) << _WORD | data[:, 1], np.full(lanes, _FULL)  # code: how far into the span
    at = np.full(lanes, 2, dtype=np.int64)
    out = np.zeros((BLOCK_IDS, lanes), dtype=np.uint16)
    for t in range(BLOCK_IDS if lanes > 1 else last):
        n = lanes if t < last else lanes - 1
        if t in REFRESH:
            model.refresh()
        p2, p1, row = model.predict(n)
        part = span[:n] >> np.uint64(SCALE)
        value = np.minimum(code[:n] // part, np.uint64((1 << SCALE) - 1))
        place = row
        for step in (8, 4, 2, 1):  # the last symbol that starts at or before the value
            place = place + step * (model.start.take(place + step) <= value)
        symbol = place - row
        code[:n] -= part * model.start.take(place)
        part *= model.width.take(place)
        bits = BITS.take(symbol)
        part >>= bits
        offset = np.minimum(code[:n] // part, (np.uint64(1) << bits) - np.uint64(1))  # 0 where the symbol is no band
        code[:n] -= offset * part
        span[:n] = part
        short = np.flatnonzero(part < _LEAST)
        code[short] = code[short] << _WORD | data[short, at[short]]
        at[short] += 1
        span[short] <<= _WORD
        ids = np.where(symbol == 0, p2, np.where(symbol == 1, p1, (FIRST.take(symbol) + offset).astype(np.uint16)))
        out[t, :n] = ids
        model.update(place, ids)
    return out.T.ravel()[:n_ids]


def pack_segment(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Header; documents (id, whether it has one, length); blocks (size, CRC); the blocks' bytes; all numbers little-endian."""
    blocks = encode_blocks(ids)
    index = np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes() + bytes(d is not None for d in docs) + np.array(lengths, dtype="<u8").tobytes()
    table = np.array([[len(b), zlib.crc32(b)] for b in blocks], dtype="<u4").tobytes()
    head = MAGIC + struct.pack("<QQQ", len(docs), len(ids), len(blocks))
    return head + struct.pack("<I", zlib.crc32(head + index + table)) + index + table + b"".join(blocks)


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids); raises ValueError on a wrong checksum."""
    n_docs, n_ids, n_blocks = struct.unpack_from("<QQQ", data, 5)
    start = 33
    at = start + 17 * n_docs + 8 * n_blocks
    if data[:5] != MAGIC or struct.unpack_from("<I", data, 29)[0] != zlib.crc32(data[:29] + data[start:at]):
        raise ValueError("damaged segment header")
    docs = np.frombuffer(data, "<i8", n_docs, start).tolist()
    has = data[start + 8 * n_docs:start + 9 * n_docs]
    lengths = np.frombuffer(data, "<u8", n_docs, start + 9 * n_docs).astype(np.int64)
    blocks = []
    for size, crc in np.frombuffer(data, "<u4", 2 * n_blocks, start + 17 * n_docs).reshape(-1, 2).tolist():
        blocks.append(data[at:at + size])
        at += size
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError("damaged block")
    return [d if h else None for d, h in zip(docs, has)], lengths, decode_blocks(blocks, n_ids)


#: Printable ASCII without capitals and apostrophes, small letters with accents of Latin-1 (in UTF-8), and the pieces at which the
#: vocabulary cuts a word of these.
SIMPLE = re.compile(rb"(?:[!-&(-@\[-~]|\xc3[\x9f-\xb6\xb8-\xbf])+")
PIECE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xbf])+|[0-9]|[^a-z0-9\xc3]+")


class Words:
    """Ids of texts by the library, which splits at blanks: distinct words are encoded once and kept, up to a bound.

    Simple words are cut into pieces first, and the library meets each distinct piece once, with nothing to normalise. All
    other words (other scripts, contractions, special tokens) take the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > NONE:
            raise ValueError("ids of this vocabulary do not fit in 16 bits")
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(NONE, dtype=bool)  # ids that end a piece
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        (self.mark,) = self._library(self.tokenizer, [b"|"])[0].tolist()

    def _library(self, tokenizer, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint16) for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, words: list[bytes], tokenizer, glue: bytes) -> None:
        """Many words at a time, between blanks or marks; the ids are cut where a piece closes or at the mark."""
        for a in range(0, len(words), 16384):
            lines = [words[b:b + 256] for b in range(a, min(len(words), a + 16384), 256)]
            for line, ids in zip(lines, self._library(tokenizer, [glue.join(x) for x in lines]), strict=True):
                cuts = np.flatnonzero(ids == self.mark if glue.strip() else self.closes[ids])
                ends, skip = ([*cuts.tolist(), len(ids)], 1) if glue.strip() else ((cuts + 1).tolist(), 0)
                octets = ids.tobytes()
                self.known.update(zip(line, (octets[2 * s:2 * e] for s, e in zip([0, *(c + skip for c in ends[:-1])], ends, strict=True)), strict=True))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, words))
        gaps = [i for i, f in enumerate(found) if f is None]
        new = [words[i] for i in gaps]
        pieces, marked, rest = {}, [], []
        for w in new:
            if SIMPLE.fullmatch(w) and b"<|" not in w:
                pieces[w] = PIECE.findall(w)
            else:
                (marked if b"|" in w else rest).append(w)
        parts = list({p: None for x in pieces.values() for p in x if p not in known})
        self._learn(parts, self.plain, b" ")
        known.update((w, b"".join([known[p] for p in x])) for w, x in pieces.items())
        self._learn(rest, self.tokenizer, b" | ")
        for a in range(0, len(marked), 4096):
            known.update(zip(marked[a:a + 4096], (x.tobytes() for x in self._library(self.tokenizer, marked[a:a + 4096])), strict=True))
        self.held += sum(map(len, new)) + sum(map(len, parts))
        for i, w in zip(gaps, new, strict=True):
            found[i] = known[w]
        if len(known) > CACHE_WORDS or self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text: distinct words of the batch are looked up, and their ids gathered."""
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: lower-casing misreads a slice
        special = pc.match_substring(texts, "<|")  # special tokens heed case
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        gc.disable()  # long lists of words, and no cycles: a collection walks them all for nothing
        try:
            octets = self._ids_of(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        finally:
            gc.enable()
        size = np.fromiter(map(len, octets), dtype=np.int64, count=len(octets)) // 2
        flat, word = np.frombuffer(b"".join(octets), dtype=np.uint16), coded.indices.to_numpy()
        n = size[word]
        ends = np.cumsum(np.append(0, n))
        ids = flat[np.repeat((np.cumsum(size) - size)[word] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[np.cumsum(np.append(0, pc.list_value_length(split).to_numpy()))].tolist()
        return [ids[s:e] for s, e in zip(at, at[1:])]


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


SEGMENTS = "file int, segment int, n_docs long, n_ids long, data binary"


def _write(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path or public_tokenizers.path(MODEL))
        file, segment = TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal segment, docs, lengths, held, size
            row = [[file], [segment], [len(docs)], [size], [pack_segment(docs, lengths, np.concatenate(held))]]
            segment, docs, lengths, held, size = segment + 1, [], [], [], 0
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "segment", "n_docs", "n_ids", "data"])

        end = np.array([END_ID], dtype=np.uint16)
        for batch in chunks(batches, 2048):
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["data"]), strict=True):
                docs.append(doc)
                lengths.append(len(ids) + 1)
                held += [ids, end]
                size += len(ids) + 1
                if size >= SEGMENT_IDS:
                    yield out()
        if docs:
            yield out()

    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the ids of every text, each text closed by END_ID, as segments in ascending doc_id order (null ids first).

    Texts are shuffled once, by ranges of (doc_id, hash of the text), so rows that repeat an id spread and keep one order.
    A null text counts as empty. An empty table writes no segment.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("data")]
    ordered = docs_of(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(_write(path), SEGMENTS).write.option("compression", "none").parquet(folder)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 1):
        row = batch.to_pylist()[0]
        docs, lengths, ids = unpack_segment(row["data"])
        ends = np.cumsum(lengths)
        octets = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(octets[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 1):
        row = batch.to_pylist()[0]
        docs, lengths, ids = unpack_segment(row["data"])
        ends = np.cumsum(np.append(0, lengths))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(row["start"] + ends[:-1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                                         ["doc_id", "start", "ids"])


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with the number of ids before them: sums inside a file, and over the files' totals."""
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    shape = segments.select("file", "segment", "n_ids")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = shape.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    starts = shape.withColumn("inside", inside).join(files.select("file", before.alias("before")), "file").select("file", "segment", (F.col("inside") + F.col("before")).alias("start"))
    return segments.join(starts, ["file", "segment"]).select("data", "start")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of every document of a folder of segments."""
    return _placed(spark, folder).mapInArrow(_ids, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the decoded ids."""
    return _placed(spark, folder).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
