"""Benchmark decontamination by spaced seeds.

An item of n words counts as leaked into a text when an aligned stretch, at least IDENTITY of it equal, holds
min(MATCHED, n - n // 4) of its words. Items of under LEAST words are no evidence: a phrase of four words stands in
clean texts by chance.

A seed looks at the words of one of the fixed MASKS and ignores those between, so substituted words there do not matter.
The masks are chosen so that every stretch the rule admits, wherever its substitutions stand, agrees with the item on at
least one seed (the tests prove it by a search over all patterns). Seeds of benchmark and texts are joined by hash; around
every hit the overlap is verified word by word, substitutions allowed.

Where words repeat, a seed that agrees at k places of an item and l places of a text has k x l hits on k + l diagonals. Of
hits that follow each other on a diagonal only the first is looked up: the index tells, for each seed and the seed before
it, which places merely go on. So runs and periods cost their length, not its square.

The benchmark is indexed on the driver in blocks of bounded size, each broadcast once; every CHAIN blocks the documents are
written between. A larger benchmark means more passes over the documents, never a larger broadcast or a lost item.

Defined cases: null and empty texts match nothing; items with a null id or text are left out; items that share an id are
searched alike and named once; repeated rows each give a row; extra columns, whatever their names, are kept by
``remove_contaminated`` and ignored elsewhere; without documents or items nothing matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_arrow, mix, word_hashes

MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 5))  #: the words each seed looks at
LEAST = 5
MATCHED = 13
IDENTITY = (3, 4)
BLOCK_WORDS = 500_000
CHAIN = 4  #: blocks searched before the documents are written
CHUNK = 1_000_000  #: hits or compared words held at once
HASH_BITS = 20  #: of the bitmap before the sorted seeds

NOT_WORD = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])
FACTORS = mix(np.arange(1, len(MASKS[0]) + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
SALTS = mix(np.arange(1, len(MASKS) + 1, dtype=np.uint64))


def words(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in lower case, without ASCII punctuation."""
    return word_hashes((text or "").lower().encode(), NOT_WORD)


def needed(size: int) -> int:
    """Equal words that an item of ``size`` words must show."""
    return min(MATCHED, size - size // IDENTITY[1])


def seeds(w: np.ndarray) -> list[np.ndarray]:
    """For each mask the hash of the words it looks at, at each start where it fits."""
    scaled = [w * f for f in FACTORS]
    out = []
    for k, mask in enumerate(MASKS):
        n = max(len(w) - mask[-1], 0)
        h = np.full(n, SALTS[k])
        for part, at in zip(scaled, mask, strict=True):
            h += part[at : at + n]
        out.append(h)
    return out


def following(h: np.ndarray) -> np.ndarray:
    """Each seed together with the one before it; the first has none."""
    return mix(h + mix(np.concatenate([np.zeros(min(len(h), 1), np.uint64), h[:-1]]) + np.uint64(1)))


class Index:
    """The seeds of a block of items, sorted by hash and, within one hash, by what goes before. Plain arrays, so that it
    is made once on the driver and broadcast."""

    def __init__(self, items: list[tuple[int, str | None]]):
        kept = [(i, w) for i, t in items if len(w := words(t)) >= LEAST]
        self.ids, self.words = [i for i, _ in kept], [w for _, w in kept]
        hashes, pairs, owner, place = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64))
        for k, w in enumerate(self.words):
            for h in seeds(w):
                hashes.append(h)
                pairs.append(following(h))
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        h, p = np.concatenate(hashes), np.concatenate(pairs)
        order = np.lexsort((p, h))
        self.hashes, self.owner, self.place = h[order], np.concatenate(owner)[order].astype(np.int32), np.concatenate(place)[order].astype(np.int32)
        p = p[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (self.hashes[1:] != self.hashes[:-1])])) if len(p) else np.zeros(0, np.int64)
        by = np.argsort(p[first], kind="stable")
        self.pairs, self.pair_low, self.pair_high = p[first][by], first[by], np.append(first[1:], len(p))[by] if len(p) else first
        self.bitmap = np.zeros(1 << HASH_BITS, bool)
        self.bitmap[(h >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = True

    def ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places in the text, first, count): ranges of index rows that agree with a text's seeds, without those that
        only go on where the seed before agreed too."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - HASH_BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, h[at])
        at, low = at[ok := (low < len(self.hashes)) & (self.hashes[np.minimum(low, len(self.hashes) - 1)] == h[at])], low[ok]
        if not len(at):
            return at, low, low
        high = np.searchsorted(self.hashes, h[at], side="right")
        pair = mix(h[at] + mix(np.where(at > 0, h[at - 1], 0) + np.uint64(1)))
        row = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        goes_on = (at > 0) & (self.pairs[row] == pair)
        gap_low, gap_high = np.where(goes_on, self.pair_low[row], high), np.where(goes_on, self.pair_high[row], high)
        gap_low, gap_high = np.clip(gap_low, low, high), np.clip(gap_high, low, high)
        at, low, count = np.concatenate([at, at]), np.concatenate([low, gap_high]), np.concatenate([gap_low - low, high - gap_high])
        return at[count > 0], low[count > 0], count[count > 0]

    def diagonals(self, w: np.ndarray) -> np.ndarray:
        """Distinct (item << 40) + start of the item in the text + 2^39, wherever a seed agrees."""
        found = np.zeros(0, np.int64)
        for h in seeds(w):
            at, low, count = self.ranges(h)
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(np.cumsum(count) // CHUNK)) + 1
            for i, k, n in zip(np.split(at, cuts), np.split(low, cuts), np.split(count, cuts), strict=True):
                row = np.repeat(k - np.cumsum(n) + n, n) + np.arange(n.sum())
                found = np.union1d(found, (self.owner[row].astype(np.int64) << 40) + np.repeat(i, n) - self.place[row] + (1 << 39))
        return found

    def overlaps(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, equal words of its best verified stretch), by item id."""
        w, best = words(text), {}
        found = self.diagonals(w)
        owners = found >> 40
        edges = np.flatnonzero(np.diff(owners, prepend=-1))
        for k, starts in zip(owners[edges].tolist(), np.split((found & ((1 << 40) - 1)) - (1 << 39), edges[1:]), strict=False):
            if matched := best_stretch(self.words[k], w, starts):
                best[self.ids[k]] = max(matched, best.get(self.ids[k], 0))
        return sorted(best.items())


def best_stretch(item: np.ndarray, w: np.ndarray, starts: np.ndarray) -> int:
    """The most equal words of an admitted stretch on any of the diagonals, or 0. Those with most equal words are looked at
    first, until none left has more than the best."""
    size, best = len(item), 0
    step = max(1, CHUNK // size)
    for low in range(0, len(starts), step):
        at = starts[low : low + step, None] + np.arange(size)
        inside = (at >= 0) & (at < len(w))
        same = inside & (w[np.clip(at, 0, len(w) - 1)] == item)
        total = same.sum(1)
        for row in np.argsort(-total, kind="stable"):
            if total[row] <= best or total[row] < needed(size):
                break
            best = max(best, stretch(same[row], size))
    return best


def stretch(same: np.ndarray, size: int) -> int:
    """Equal words of the stretch that has most of them among those with at least IDENTITY of it equal, or 0 if they are
    too few: for each end the farthest start from which the sum of (equal - IDENTITY) is not below 0."""
    equal = np.concatenate([[0], np.cumsum(same)])
    gain = IDENTITY[1] * equal - IDENTITY[0] * np.arange(len(equal))
    lowest = np.minimum.accumulate(gain)
    start = np.searchsorted(-lowest, -gain)  # the first with lowest <= gain, which is the first with gain <= gain there
    most = int((equal - equal[start]).max())
    return most if most >= needed(size) else 0


def blocks_of(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark (item_id, text) in blocks of about BLOCK_WORDS words, one at a time on the driver."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, -(-total // BLOCK_WORDS))
    for k in range(count):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()]


def through_blocks(rows: DataFrame, items: DataFrame, search, schema) -> DataFrame:
    """``rows`` after ``search(index)`` for each block of the benchmark."""
    spark = rows.sparkSession
    for k, block in enumerate(blocks_of(items)):
        if k and k % CHAIN == 0:
            rows = keep(spark, rows, "searched")
        rows = map_arrow(rows, search(spark.sparkContext.broadcast(Index(block))), schema)
    return rows


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_ids, n_items, best_match, contaminated) for each row of ``docs``: the leaked items in order
    and the equal words of the longest overlap (0 without one). No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("array<long>").alias("item_ids"), F.lit(0).cast("long").alias("best"))
    rows = through_blocks(rows, items, finder, "doc_id long, text string, item_ids array<long>, best long")
    found = F.array_distinct(F.coalesce("item_ids", F.array().cast("array<long>")))
    return rows.select("doc_id", F.array_sort(found).alias("item_ids"), F.size(found).cast("long").alias("n_items"), F.col("best").alias("best_match"), (F.size(found) > 0).alias("contaminated"))


def finder(index):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_ids", pa.list_(pa.int64())), ("best", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, best = (batch.column(c).to_pylist() for c in ("text", "item_ids", "best"))
            for i, text in enumerate(texts):
                if found := index.value.overlaps(text):
                    ids[i] = [*(ids[i] or []), *(k for k, _ in found)]
                    best[i] = max(best[i], *(m for _, m in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ids, schema.field(2).type), pa.array(best, pa.int64())], schema=schema)

    return run


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item has leaked into. No shuffle; all columns stay."""
    at = docs.columns.index("text")

    def cleaner(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.overlaps(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    return through_blocks(docs, items, cleaner, docs.schema)
