"""Token counts by a linear longest-match automaton.

Greedy word pieces are counted in one pass over each word: a trie of the vocabulary has, at each node,
a failure link and the number of pieces that following it pops, so no piece is ever built and no
character is read twice. Counts of words are remembered per task in a table of bounded size.

Defined cases: a word that pieces cannot cover is one unknown token; null, empty and white texts have no
words; words are what Unicode white space parts, of any length; repeated rows each give a row; extra columns, whatever
their names, are ignored, and an empty table has no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow

REMEMBERED = 500_000
LONGEST_REMEMBERED = 64
UNKNOWN = 1 << 32
ROOT, INNER = 0, 1  #: states before a word and after its first piece


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces inside one) of a SentencePiece model file; each single character of
    the model may do either. Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, inside = set(), set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if "▁" in piece[1:] or piece == "▁":
            continue
        if piece[0] == "▁":
            begin.add(piece[1:])
        else:
            inside.add(piece)
            if len(piece) == 1:
                begin.add(piece)
    return sorted(begin), sorted(inside)


def automaton(begin: Iterable[str], inside: Iterable[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """(moves, failure, popped) by state. failure is -1 where no way on exists; popped counts the pieces that
    are complete once the failure link has been followed."""
    moves: list[dict[str, int]] = [{}, {}]
    ends = [False, False]
    for start, pieces in ((ROOT, begin), (INNER, inside)):
        for piece in pieces:
            at = start
            for char in piece:
                if char not in moves[at]:
                    moves[at][char] = len(moves)
                    moves.append({})
                    ends.append(False)
                at = moves[at][char]
            ends[at] = at not in (ROOT, INNER)
    failure, popped = [-1] * len(moves), [0] * len(moves)
    waiting = deque((ROOT, INNER))
    while waiting:
        parent = waiting.popleft()
        for char, at in moves[parent].items():
            waiting.append(at)
            if ends[at]:
                failure[at], popped[at] = INNER, 1
                continue
            state, count = failure[parent], popped[parent]
            while state >= 0 and char not in moves[state]:
                count += popped[state]
                state = failure[state]
            if state >= 0:
                failure[at], popped[at] = moves[state][char], count
    return moves, failure, popped


def count_word(word: str, moves: list[dict[str, int]], failure: list[int], popped: list[int]) -> int:
    """Pieces of one non-empty word; UNKNOWN + 1 if pieces cannot cover it."""
    at, count = ROOT, 0
    for char in word:
        while char not in moves[at]:
            if failure[at] < 0:
                return UNKNOWN + 1
            count += popped[at]
            at = failure[at]
        at = moves[at][char]
    while at != INNER:
        if failure[at] < 0:
            return UNKNOWN + 1
        count += popped[at]
        at = failure[at]
    return count


class WordCounts(dict):
    """Word -> count, filled on demand, emptied when full."""

    def __init__(self, machine: tuple[list[dict[str, int]], list[int], list[int]]):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        count = count_word(word, *self.machine)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(shared.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or "").split()
                total = sum(map(counts.__getitem__, words))
                out.append((doc_id, len(words), total % UNKNOWN, total // UNKNOWN))
            if out:
                yield batch_of(OUT, list(zip(*out, strict=True)))

    return run


def count_tokens(docs: DataFrame, begin: list[str], inside: list[str]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of ``docs`` (doc_id, text). The automaton is built
    once and broadcast; its size is that of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(begin, inside))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, counter(shared), "doc_id long, n_words long, n_tokens long, n_unknown long")
