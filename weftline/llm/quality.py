"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature gives a document's score s; ordered thresholds cut the scale into
grades: P(grade > k) = sigmoid(s - threshold_k). Grades here: 0 toxic, 1 of low quality, 2 of good quality.
The expected grade ranks documents; the tail probability P(grade >= 1) selects them.

Learning takes at most SAMPLE rated documents of each grade. Their features are counted by grade where they lie; of the
features that tell grades apart the LEARNED best learn, and only those of each document reach the driver.

Defined cases: null and empty texts have only the features of their length; where nothing is labelled
every document gets the prior of equal grades; a document rated more than once counts with its worst
grade; of rows that repeat a rated doc_id one is learned from; ratings with a null part are ignored; repeated rows each
give a row; extra columns, whatever their names, are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, drop_kept, keep, map_arrow, mix, rows_of, text_bytes, word_hashes

BITS = 18
GRADES = 3
SAMPLE = 4000  #: rated documents of each grade to learn from, at most; those with the smallest hashes
LEARNED = 2048  #: features that learn, at most
STEPS, RATE, FREQUENT, TELLING, DECAY = 1000, 0.1, 0.02, 5.0, 1e-5
PREFIX = 6  #: leading bytes of a word that are a feature besides the word

NOT_LETTER = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])
KIND = np.zeros(256, np.int64)  #: kinds of bytes: other, upper case, digit, punctuation, line end
for _kind, _chars in ((1, range(65, 91)), (2, range(48, 58)), (3, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), (4, b"\n")):
    KIND[list(_chars)] = _kind


def text_features(raw: bytes) -> np.ndarray:
    """Distinct indices of a text: its words in lower case, their first bytes, and the shares of kinds of bytes in steps."""
    data = np.frombuffer(raw, np.uint8)
    n = max(len(data), 1)
    shares = np.bincount(KIND[data], minlength=5)[1:]
    steps = [*np.floor(np.sqrt(shares / n) * 12).astype(int), int(np.log2(n))]
    surface = mix(np.array([(k + 1) * 1000 + v for k, v in enumerate(steps)], np.uint64))
    lower = raw.decode().lower().encode()
    return np.unique(np.concatenate([word_hashes(lower, NOT_LETTER), word_hashes(lower, NOT_LETTER, PREFIX), surface]) >> np.uint64(64 - BITS)).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Up to LEARNED features, sorted, whose frequency on the two sides of some threshold differs by TELLING standard
    errors or more. ``counts``: documents by grade and feature; ``share``: documents by grade."""
    total, best = counts.sum(0), np.zeros(counts.shape[1])
    p = total / max(share.sum(), 1)
    for k in range(len(share) - 1):
        below, above = share[: k + 1].sum(), share[k + 1 :].sum()
        if below and above:
            under = counts[: k + 1].sum(0)
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / below + 1 / above))
            best = np.maximum(best, np.abs(under / below - (total - under) / above) / error)
    order = np.argsort(-best, kind="stable")[:LEARNED]
    return np.sort(order[best[order] >= TELLING])


def fit(features: list[np.ndarray], grades: np.ndarray, grade_count: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient descent with momentum on the likelihood of the cumulative-link model, grades
    weighing alike. ``features`` holds the telling ones of each document; the others do not learn, so documents are not
    learned by heart. Steps are longest for features of about the share FREQUENT of documents. Thresholds stay ordered:
    each is the one before plus an exponential."""
    weights, free = np.zeros(1 << BITS), np.zeros(grade_count - 1)
    if not len(features):
        return weights.astype(np.float32), np.log([(k + 1) / (grade_count - k - 1) for k in range(grade_count - 1)])
    sizes = np.array([len(f) for f in features])
    names, index = np.unique(np.concatenate([np.zeros(0, np.int32), *features]), return_inverse=True)
    owner, learned = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(names))
    share = np.bincount(grades, minlength=grade_count)
    heft = (1 / np.maximum(share, 1) / (share > 0).sum())[grades]
    often = np.bincount(index, weights=heft[owner], minlength=len(names))
    rate = RATE * often / (often + FREQUENT) ** 2
    moved, moved_free = np.zeros_like(learned), np.zeros_like(free)
    free[0] = -1.0
    for _ in range(STEPS):
        s = np.bincount(owner, weights=learned[index], minlength=len(sizes))
        cut = np.concatenate([[-np.inf], free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]), [np.inf]])
        low, high = sigmoid(cut[grades] - s), sigmoid(cut[grades + 1] - s)
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        d_s = heft * (d_high - d_low) / p
        d_cut = np.zeros(grade_count + 1)
        np.add.at(d_cut, grades + 1, -heft * d_high / p)
        np.add.at(d_cut, grades, heft * d_low / p)
        inner = d_cut[1:-1]
        d_free = np.array([inner.sum(), *(np.exp(free[k]) * inner[k:].sum() for k in range(1, grade_count - 1))])
        moved = 0.9 * moved - rate * (np.bincount(index, weights=d_s[owner], minlength=len(names)) + DECAY * learned)
        moved_free = 0.9 * moved_free - 0.2 * d_free
        learned += moved
        free += moved_free
    weights[names.astype(np.int64)] = learned
    return weights.astype(np.float32), free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def grade() -> Column:
    """0 toxic, 1 low quality, 2 good quality."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)


def rated_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, features), written: at most SAMPLE rated documents of each grade, those with the smallest hashes."""
    rated = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade()).alias("grade"))
    picked = None
    for k in range(GRADES):
        part = rated.filter(F.col("grade") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))])
        for batch in batches:
            out = [(i, g, text_features(raw)) for i, g, raw in rows_of([batch], "doc_id", "grade", "raw")]
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    texts = text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "raw")
    rows = map_arrow(texts, run, "doc_id long, grade int, features array<int>").groupBy("doc_id", "grade").agg(F.min("features").alias("features"))
    return keep(docs.sparkSession, rows, "features")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the sample. The driver gets, of each grade, a count for each feature (at most 2^BITS), and of each
    document its telling features (at most LEARNED)."""
    rows = rated_features(docs, labels)
    counts, share = np.zeros((GRADES, 1 << BITS)), np.zeros(GRADES, np.int64)
    for r in rows.groupBy("grade").count().collect():
        share[r["grade"]] = r["count"]
    table = rows.select("grade", F.explode("features").alias("index")).groupBy("grade", "index").count().toArrow()
    counts[table["grade"].to_numpy(), table["index"].to_numpy()] = table["count"].to_numpy()
    told = telling(counts, share).astype(np.int32)
    names = docs.sparkSession.sparkContext.broadcast(told)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(np.array(f, np.int32), names.value, assume_unique=True).tobytes() for f in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(own, pa.binary())], ["doc_id", "grade", "features"])

    found = sorted((r["doc_id"], r["grade"], bytes(r["features"])) for r in map_arrow(rows, chosen, "doc_id long, grade int, features binary").collect())
    drop_kept(rows)
    return fit([np.frombuffer(r[2], np.int32) for r in found], np.array([r[1] for r in found], np.int64))


OUT = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_at_least_1", pa.float64()), ("p_at_least_2", pa.float64()), ("kept", pa.bool_())])


def rate(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_at_least_1, p_at_least_2, kept) for each row of ``docs`` (doc_id, text): kept
    where P(grade >= 1) reaches ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for batch in batches:
            out = []
            for doc_id, raw in rows_of([batch], "doc_id", "raw"):
                tail = sigmoid(float(weights[text_features(raw)].sum(dtype=np.float64)) - cuts)
                out.append((doc_id, float(tail.sum()), float(tail[0]), float(tail[1]), bool(tail[0] >= least)))
            if out:
                yield batch_of(OUT, list(zip(*out, strict=True)))

    return map_arrow(text_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), run, "doc_id long, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")
