"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports, at each position, every piece that ends there, the longest first, through its output
links; each relaxes the best score of the position. The best segmentation maximises the sum of piece
scores; of equal sums the longer last piece wins. A character that no piece covers scores 10 below the
worst piece and becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segmentations kept by a worker, and the longest piece of text kept.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 64


class Pieces:
    """The vocabulary of a model file, its automaton, and a bounded memory of segmentations."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = [0] * 256
        self.surface = [b""] * size
        self.singles = set()
        worst, newline, inner = 0.0, False, False
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                self.automaton.add_word(piece, (i, len(piece), score))
                if len(piece) == 1:
                    self.singles.add(piece)
                worst = min(worst, score)
                self.surface[i] = piece.replace(SPACE, " ").encode()
                newline |= "\n" in piece
                inner |= bool(re.search(f"[^{SPACE}]{SPACE}", piece))
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        # where no piece can cross, texts are cut into chunks whose best segmentations join to the text's
        if inner:
            self.cut = lambda text: [text]
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if newline else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.known: dict[str, tuple[bytes, float]] = {}

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """ids and score of the best segmentation of a text whose blanks are marks already."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int, float]] = [(-1, 1, self.unknown)] * (n + 1)  # (id or -1, length, score)
        if self.singles.issuperset(text):  # every character is a piece: no position is left without one
            for end, node in self.automaton.iter(text):
                end += 1
                value = best[end - node[1]] + node[2]
                if value > best[end]:
                    best[end] = value
                    back[end] = node
        else:
            lone = [c not in self.singles for c in text]
            at = 0  # positions before this one are final
            for end, node in itertools.chain(self.automaton.iter(text), ((n, None),)):
                for at in range(at, end):
                    if lone[at] and best[at] + self.unknown > best[at + 1]:
                        best[at + 1], back[at + 1] = best[at] + self.unknown, (-1, 1, self.unknown)
                at = max(at, end)
                if node is not None:
                    value = best[end + 1 - node[1]] + node[2]
                    if value > best[end + 1]:
                        best[end + 1], back[end + 1] = value, node
        ids: list[int] = []
        while n:
            i, length, _ = back[n]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
            n -= length
        ids.reverse()
        return ids, best[len(text)]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian 32-bit ids of a text, and its score. An empty text has none."""
        if not text:
            return b"", 0.0
        known = self.known
        out, score = [], 0.0
        for chunk in self.cut(SPACE + text.replace(" ", SPACE)):
            got = known.get(chunk)
            if got is None:
                ids, value = self.viterbi(chunk)
                got = (np.array(ids, dtype="<u4").tobytes(), value)
                if len(chunk) <= CACHE_CHARS:
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    known[chunk] = got
            out.append(got[0])
            score += got[1]
        return b"".join(out), score

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and score of every text; a null text has no ids. One pass, no shuffle; the model file lies on every node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_path(path))
        for batch in chunks(batches, 64):
            coded = [pieces.encode(t) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0] + [len(c) // 4 for c, _ in coded], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(c for c, _ in coded), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids, pa.array([s for _, s in coded], pa.float64())], ["doc_id", "ids", "score"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, score double")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_path(path))
        for batch in chunks(batches, 64):
            texts = [None if i is None else pieces.decode(i) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_bytes (ids that are single bytes), ids_crc32 (of little-endian 32-bit ids), score and restored:
    whether the decoded ids are the text (false only where it holds the blank mark itself). Rows may repeat or lack an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(_path(path))
        byte_ids = np.zeros(len(pieces.surface), dtype=bool)
        byte_ids[pieces.byte_ids] = True
        for batch in chunks(batches, 64):
            rows = []
            for text in batch["text"].to_pylist():
                coded, score = pieces.encode(text)
                ids = np.frombuffer(coded, dtype="<u4")
                rows.append((len(ids), int(byte_ids[ids].sum()), zlib.crc32(coded), score, pieces.decode(ids.tolist()) == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "score", "restored"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, score double, restored boolean")
