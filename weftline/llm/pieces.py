"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over the pieces reports, at each position, every piece that ends there; each relaxes the
best score of its end from that of its start. Where no piece spans a place, the text is cut and the parts
are solved alone, which changes nothing and lets frequent parts be remembered (in a bounded table).

Scores: those of the file for a unigram model; a BPE model has only ranks, which become
-log(rank + 1). Characters outside the vocabulary become byte pieces. White space stays as it is and
U+2581 in a text is spelt in bytes, so decoding gives the text back exactly.

Defined cases: null and empty texts have no pieces; repeated rows each give a row; of segmentations
with equal scores the one found first wins, longer last pieces being tried first; extra columns, whatever their names,
are ignored, and an empty table has no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow

SPACE = "▁"
LITERAL = "\ud800"  #: stands for U+2581 of the text while it is cut; no text can hold a lone surrogate
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def load_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """(pieces, scores, ids of the 256 byte pieces) of a SentencePiece file; control pieces are empty strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores, byte_ids = [""] * n, [0.0] * n, [-1] * 256
    for i in range(n):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[i], scores[i] = name, model.get_score(i)
    values = [s for p, s in zip(pieces, scores, strict=True) if p]
    if values and all(s <= 0 and s == int(s) for s in values):  # a BPE model: scores are ranks below zero
        scores = [-math.log(1 - s) for s in scores]
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces, so texts outside its alphabet could not be kept")
    return pieces, scores, byte_ids


class Encoder(dict):
    """Part of a text -> its piece ids as packed 32-bit integers, so a text's ids are one join; also the decoder."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        super().__init__()
        self.byte_ids = byte_ids
        self.fallback = min(scores, default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), i, scores[i]))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.alone = {p for p in pieces if len(p) == 1}
        spans = {c for p in pieces if len(p) > 1 for c in p} - {SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            self.cut = re.compile("(?s).+")
        else:
            body = "".join(map(re.escape, sorted(spans)))
            self.cut = re.compile(f"{SPACE}*[{body}]+|{SPACE}+|(?s:.)") if body else re.compile(f"{SPACE}+|(?s:.)")
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(byte_ids):
            self.raw[i] = bytes([value])

    def best(self, part: str) -> bytes:
        """The best segmentation of one part: one pass of the automaton, relaxing at each reported end."""
        n = len(part)
        score, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        if n > LONGEST_REMEMBERED:  # packed, so that one endless word stays small
            score, back, piece = array("d", score), array("q", back), array("q", piece)
        gaps = () if self.alone.issuperset(part) else [i for i, c in enumerate(part) if c not in self.alone]
        done = 0
        for end, (length, i, value) in self.automaton.iter(part) if len(self.automaton) else ():
            if gaps:
                done = self.bridge(gaps, done, end, score, back)
            top = score[end + 1 - length] + value
            if top > score[end + 1]:
                score[end + 1], back[end + 1], piece[end + 1] = top, end + 1 - length, i
        if gaps:
            self.bridge(gaps, done, n, score, back)
        out, end = [], n
        while end:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                char = {LITERAL: SPACE, SPACE: " "}.get(part[end - 1], part[end - 1])
                out += [self.byte_ids[b] for b in reversed(char.encode())]
            end = back[end]
        return array("i", reversed(out)).tobytes()

    def bridge(self, gaps: list[int], done: int, end: int, score, back) -> int:
        """Relax the byte spellings of characters outside the vocabulary that stand before ``end`` or at it."""
        while done < len(gaps) and gaps[done] <= end:
            at = gaps[done]
            if score[at] + self.fallback > score[at + 1]:
                score[at + 1], back[at + 1] = score[at] + self.fallback, at
            done += 1
        return done

    def __missing__(self, part: str) -> bytes:
        ids = self.best(part)
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        marked = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        return b"".join(map(self.__getitem__, self.cut.findall(marked)))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.packed(text)).cast("i").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("piece_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            ids, same, sizes = [], [], [0]
            for text in batch.column("text").to_pylist():
                ids.append(encoder.packed(text))
                sizes.append(len(ids[-1]) // 4)
                same.append(encoder.decode(memoryview(ids[-1]).cast("i").tolist()) == (text or ""))
            offsets = pa.array(np.cumsum(sizes, dtype=np.int32))
            values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes[1:], pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(same, pa.bool_())], schema=OUT)

    return run


def encode_documents(docs: DataFrame, model: tuple[list[str], list[float], list[int]]) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip) for each row of ``docs`` (doc_id, text); round_trip tells whether
    decoding the ids gives the text back. The vocabulary is broadcast; its size does not grow with the data."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, coder(shared), "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: tuple[list[str], list[float], list[int]]) -> DataFrame:
    """(doc_id, text) from (doc_id, piece_ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            yield batch_of(schema, [batch.column("doc_id").to_pylist(), [encoder.decode(x or []) for x in batch.column("piece_ids").to_pylist()]])

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids"), run, "doc_id long, text string")
