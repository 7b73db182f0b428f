"""Document fingerprints: improbable-feature digests.

Every window of 32 bytes gets a precedence from how rare its entropy is; the windows that are the
rarest of their surroundings most often become features; features go into a chain of Bloom filters
of 2048 bits; two digests are compared by the bits they share beyond what chance gives.

Defined cases: a null text counts as empty; the empty text has a digest without filters, like only
to itself (1.0), to all others 0.0. A text of under 256 bytes also has features of 8 bytes, and one
shorter than those is one feature, the whole text.
Equal texts have equal digests. Rows that share a doc_id follow each other by the hash of their text; repeated rows each give
a row; extra columns, whatever their names, are ignored; an empty table has no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, batch_of, map_arrow, partitions, prefix_hash, sliding_min, span_hash

WINDOW = 32  #: bytes of a feature
SPAN = 64  #: neighbouring windows that compete
POPULAR = 16  #: times a window must win to be a feature
SHORT, NARROW, NEAR, OFTEN = 256, 8, 8, 2  #: bytes below which a text also has narrow windows; their WINDOW, SPAN, POPULAR
PER_FILTER = 160  #: features of a filter before the chain goes on
BITS = 2048  #: bits of a filter
HASHES = 5  #: bits each feature sets, 11 bits of its hash each
STEPS = 1000  #: steps of the entropy scale
#: Entropy of 32-byte windows in running text, as a share of the scale: mean and spread of the model.
USUAL, SPREAD, LEAST = 740.0, 60.0, 300


def rarity() -> np.ndarray:
    """Precedence by entropy step: modelled frequency, so the rarest come first; -1 below LEAST (padding, runs)."""
    at = np.arange(STEPS + 1)
    rank = np.round(10_000 * np.exp(-(((at - USUAL) / SPREAD) ** 2) / 2)).astype(np.int64)
    rank[at < LEAST] = 1 << 20
    return rank


def entropy_steps(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy of each window on the scale 0..STEPS, in integers, so equal windows always agree."""
    n = len(data)
    c = np.arange(1, window + 1, dtype=np.float64)
    f = np.concatenate([[0.0], c * np.log2(c)])
    gain = np.concatenate([[0], np.round(65536 * np.diff(f))]).astype(np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + window) + order
    index = np.arange(n)
    back, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    back[order] = index - np.searchsorted(key, key - (window - 1)) + 1
    ahead[order] = np.searchsorted(key, key + (window - 1), side="right") - index
    added = np.cumsum(gain[back])
    gone = np.concatenate([[0], np.cumsum(gain[ahead])])
    total = added[window - 1 :] - gone[: n - window + 1]
    return STEPS - total * STEPS // int(gain.sum())


def selected(data: np.ndarray, rank: np.ndarray, window: int = WINDOW, span: int = SPAN, popular: int = POPULAR) -> np.ndarray:
    """Starts of the windows that become features, for a text of ``window`` bytes or more."""
    order = rank[entropy_steps(data, window)]
    m = len(order)
    key = np.full(m + 2 * (span - 1), np.iinfo(np.int64).max)
    key[span - 1 : span - 1 + m] = (order << 40) + np.arange(m)
    winners = sliding_min(key, span) & ((1 << 40) - 1)
    wins = np.bincount(winners, minlength=m)
    starts = np.flatnonzero((wins >= popular) & (order < 1 << 20))
    return starts if len(starts) else np.array([int(np.argmax(wins))])


def features(raw: bytes, rank: np.ndarray) -> np.ndarray:
    """Distinct feature hashes in the order of the text. Long texts go in overlapping segments."""
    if not raw:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    n, lap, out = len(data), WINDOW + 2 * SPAN, []
    if n < SHORT:
        sums, inverse = prefix_hash(data)
        if n < NARROW:
            return span_hash(sums, inverse, np.array([0]), np.array([n]))
        starts = selected(data, rank, NARROW, NEAR, OFTEN)
        out.append(span_hash(sums, inverse, starts, starts + NARROW))
    for at in range(0, n if n >= WINDOW else 0, SEGMENT):
        low, high = max(0, at - lap), min(n, at + SEGMENT + lap)
        part = data[low:high]
        if len(part) < WINDOW:
            continue
        starts = selected(part, rank)
        starts = starts[(starts + low >= at) & (starts + low < at + SEGMENT)]
        sums, inverse = prefix_hash(part)
        out.append(span_hash(sums, inverse, starts, starts + WINDOW))
    h = np.concatenate(out)
    _, first = np.unique(h, return_index=True)
    return h[np.sort(first)]


def digest_bits(h: np.ndarray) -> np.ndarray:
    """The chain of filters as a matrix of bits, one row for each filter."""
    filters = np.zeros((-(-len(h) // PER_FILTER), BITS), bool)
    row = np.arange(len(h)) // PER_FILTER
    for i in range(HASHES):
        filters[row, ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return filters


def digest_text(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def one_way(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over a's filters, by their bits, of the best overlap beyond chance with one of b's filters."""
    na, nb = a.sum(1).astype(np.float64), b.sum(1).astype(np.float64)
    right, best = b.astype(np.float32).T, np.zeros(len(a))
    for i in range(0, len(a), 256):
        common = a[i : i + 256].astype(np.float32) @ right
        chance = na[i : i + 256, None] * nb[None, :] / BITS
        most = np.minimum(na[i : i + 256, None], nb[None, :])
        best[i : i + 256] = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((best * na).sum() / na.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: how much of the shorter digest the other one holds; the same either way round."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) != len(b):
        return min(1.0, one_way(a, b) if len(a) < len(b) else one_way(b, a))
    return 1.0 if (a == b).all() else min(1.0, (one_way(a, b) + one_way(b, a)) / 2)


def fingerprint(text: str | None) -> str:
    """The digest of one text as a string."""
    return digest_text(digest_bits(features((text or "").encode(), rarity())))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following`` (or all)."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket in the order of the documents, each bucket ending with the first of the next."""
    rank, pending, out = rarity(), None, []

    def digest(text: str) -> np.ndarray:
        return digest_bits(features(text.encode(), rank))

    for batch in batches:
        for bucket, part, halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "halo", "doc_id", "text")), strict=True):
            if pending is None and halo:
                continue
            text = text or ""
            own = digest(text)
            if pending is not None and pending[0] == (bucket, part):
                _, before, was, theirs = pending
                new = edited(was, text)
                bits = digest(new)
                out.append((before, len(was), hashlib.sha256(new.encode()).hexdigest(), digest_text(theirs), digest_text(bits), likeness(theirs, bits), likeness(theirs, own)))
            pending = None if halo else ((bucket, part), doc_id, text, own)
        if out:
            yield batch_of(OUT, list(zip(*out, strict=True)))
            out = []


LAST = -(2**63)  #: stands for a null doc_id, which comes last
HASHES_OF_TEXT = 2.0**64


def with_following(docs: DataFrame) -> DataFrame:
    """(bucket, part, halo, doc_id, text, tie): buckets are ranges of doc_id, descending; one whose doc_id (or lack of one)
    holds more than a bucket's share of the rows is cut into parts by the hash of the text. The halo row of a part is the
    document that follows its last one. One shuffle of the texts; the driver sees a few values for each part."""
    spark = docs.sparkSession
    n = partitions(spark)
    count = 4 * n
    order, tie = F.coalesce("doc_id", F.lit(LAST)), F.xxhash64("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("order", order).withColumn("tie", tie).withColumn("key", F.col("order").cast("double"))
    total = keyed.count()
    crowded = keyed.groupBy("order").count().filter(F.col("count") > F.lit(max(total // count, 1))).collect()  # under ``count`` rows
    splits = {*keyed.approxQuantile("key", [i / count for i in range(1, count)], 0.25 / count)}
    splits |= {x for r in crowded for x in (float(r["order"]), float(np.nextafter(float(r["order"]), np.inf)))}
    edges = [-float("inf"), *sorted(splits), float("inf")] if splits else [-float("inf"), 0.0, float("inf")]
    ranged = Bucketizer(splits=edges, inputCol="key", outputCol="range", handleInvalid="keep").transform(keyed)
    part = F.lit(0)
    for r in crowded:  # rows of other ids whose doubles are equal stay before or after all parts
        pieces = -(-r["count"] * count // total)
        own = F.least(F.floor((F.col("tie") / HASHES_OF_TEXT + 0.5) * pieces).cast("int"), F.lit(pieces - 1))
        same_key = F.col("key") == float(r["order"])
        part = F.when(same_key & (F.col("order") == r["order"]), own).when(same_key & (F.col("order") < r["order"]), pieces - 1).otherwise(part)
    ranged = ranged.withColumn("bucket", -F.col("range").cast("int")).withColumn("part", part)
    first = F.max(F.struct("order", F.bitwise_not("tie").alias("minus")))
    tops = [(r["bucket"], r["part"], r["first"]["order"], ~r["first"]["minus"]) for r in ranged.groupBy("bucket", "part").agg(first.alias("first")).orderBy("bucket", "part").collect()]
    rows = ranged.select("bucket", "part", F.lit(False).alias("halo"), "doc_id", "text", "tie")
    if tops:
        goes = [(*tops[(i + 1) % len(tops)][2:], *tops[i][:2]) for i in range(len(tops))]
        halo = spark.createDataFrame(goes, "order long, tie long, bucket int, part int")
        extra = ranged.drop("bucket", "part").filter(F.col("order").isin(sorted({g[0] for g in goes}))).join(F.broadcast(halo), ["order", "tie"])
        rows = rows.union(extra.select("bucket", "part", F.lit(True), "doc_id", "text", "tie"))
    return rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "halo", order.desc(), "tie")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): its digest, that of its edited text, and how alike they are
    to each other and to the next document in descending doc_id (after the last: the first). Rows with the same
    doc_id follow each other by the hash of their text; a null doc_id comes last."""
    return map_arrow(with_following(docs).drop("tie"), compare_in_order, DDL)
