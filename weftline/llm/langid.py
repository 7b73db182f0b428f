"""Language ID by a byte convolutional network.

Bytes of the lower-cased text are embedded; filters of three widths run over windows of 128 bytes; the
maximum of each filter, rectified, feeds a softmax. Training is plain numpy on a bounded sample of
labelled documents; prediction reads every window of the whole text and averages log-probabilities.
For prediction each filter's weights are folded into tables by byte, so a filter is a few look-ups.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where
nothing could be learned; a null doc_id is not held out; documents to learn from are picked by a hash of their text, so null
and repeated doc_ids count like others, and equal texts and windows count once; rows that repeat each give a row; of languages
with equal scores the first by name wins; an empty table has no rows; extra columns, whatever their names, are ignored or,
in ``keep_identified``, kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, drop_kept, keep, map_arrow

LENGTH = 128  #: bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 16  #: for each width
DEPTH = 8  #: of the byte embedding
SAMPLE_DOCS = 800  #: labelled documents for each language to learn from, about; taken by hash
SAMPLE_WINDOWS = 4  #: windows of each, evenly spaced over the whole text
LANGUAGES = 100  #: learned, the most frequent ones, at most
STEPS, BATCH, RATE = 500, 96, 0.01
LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> np.ndarray:
    """The whole text as rows of LENGTH bytes, the last filled up with zeros."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    count = -(-len(raw) // LENGTH)
    out = np.zeros(count * LENGTH, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(count, LENGTH)


class Network:
    """Parameters: byte embedding, filters and biases by width, output layer."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (256, DEPTH)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (w * DEPTH) ** -0.5, (w, DEPTH, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)

    def forward(self, x: np.ndarray):
        parts, places = [], []
        for w in WIDTHS:
            tables = self.p["embed"] @ self.p[f"filter{w}"]  # (w, 256, FILTERS)
            total = sum(tables[j].astype(np.float32)[x[:, j : LENGTH - w + 1 + j]] for j in range(w))
            place = total.argmax(1)
            parts.append(np.take_along_axis(total, place[:, None], 1)[:, 0] + self.p[f"bias{w}"])
            places.append(place)
        hidden = np.concatenate(parts, 1)
        logits = np.maximum(hidden, 0) @ self.p["out"] + self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        return hidden, places, logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        hidden, places, logp = self.forward(x)
        delta = np.exp(logp)
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        g = {"out": np.maximum(hidden, 0).T @ delta, "bias": delta.sum(0), "embed": np.zeros((256, DEPTH))}
        back = (delta @ self.p["out"].T) * (hidden > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"bias{w}"] = own.sum(0)
            g[f"filter{w}"] = np.zeros((w, DEPTH, FILTERS))
            for j in range(w):
                byte = x[rows, places[k] + j]
                g[f"filter{w}"][j] = np.einsum("bfd,bf->df", self.p["embed"][byte], own)
                np.add.at(g["embed"], byte, own[:, :, None] * self.p[f"filter{w}"][j].T)
        return g


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> Network:
    """Adam on balanced batches; windows are cut short at random, so short texts are learned too."""
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    groups = [np.flatnonzero(y == c) for c in range(classes)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, STEPS + 1):
        own = rng.integers(0, classes, BATCH)
        rows = np.array([groups[c][rng.integers(len(groups[c]))] for c in own])
        part = x[rows].copy()
        for i in np.flatnonzero(rng.random(BATCH) < 0.3):
            part[i, rng.integers(12, LENGTH) :] = 0
        for k, g in net.gradients(part, own).items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.p[k] -= RATE * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return net


class Classifier:
    """Look-up tables of a trained network; made from plain arrays on each executor."""

    def __init__(self, languages: list[str], params: dict[str, np.ndarray]):
        self.languages, self.params = languages, params
        self.tables = {w: (params["embed"] @ params[f"filter{w}"]).astype(np.float32) for w in WIDTHS} if languages else {}

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), 256):
            part, best = x[at : at + 256], []
            for w in WIDTHS:
                total = self.tables[w][0][part[:, : LENGTH - w + 1]]
                for j in range(1, w):
                    total += self.tables[w][j][part[:, j : LENGTH - w + 1 + j]]
                best.append(total.max(1) + self.params[f"bias{w}"])
            logits = np.maximum(np.concatenate(best, 1), 0) @ self.params["out"] + self.params["bias"]
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of whole texts; windows of many texts go through together."""
        result, rows, owners = [("und", 0.0)] * len(texts), [], []
        for i, text in enumerate(texts):
            if self.languages and text and LETTER.search(text):
                rows.append(windows(text))
                owners.append((i, len(rows[-1])))
        for group in grouped(rows, owners):
            logp, at = self.log_probabilities(np.concatenate([r for r, _ in group])), 0
            for _, (i, count) in group:
                mean = logp[at : at + count].mean(0)
                at += count
                p = np.exp(mean - mean.max())
                top = int(np.argmax(p))
                result[i] = (self.languages[top], float(p[top] / p.sum()))
        return result


def grouped(rows: list[np.ndarray], owners: list[tuple[int, int]], most: int = 8192) -> Iterator[list]:
    group, held = [], 0
    for pair in zip(rows, owners, strict=True):
        group.append(pair)
        held += len(pair[0])
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(3)) == 1, F.lit(False))


def sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("part", pa.binary())])
    for batch in batches:
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if LETTER.search(text):
                all_windows = windows(text)
                out += [(lang, all_windows[i].tobytes()) for i in sorted({len(all_windows) * k // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)})]
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))


def learn(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, parameters) from documents that are not held out. About SAMPLE_DOCS distinct texts of each language, those
    with the smallest hashes, give SAMPLE_WINDOWS windows each; at most twice as many distinct ones a language reach the driver."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in sizes.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return [], {}
    scale = 1 << 30
    share = {lang: min(scale, scale * SAMPLE_DOCS // n + 1) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < limit[F.col("lang")]).distinct()
    parts = keep(docs.sparkSession, map_arrow(picked.select("lang", "text"), sample_windows, "lang string, part binary").distinct(), "windows")
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")))
    found = [(r["lang"], bytes(r["part"])) for r in ranked.filter(F.col("place") <= 2 * SAMPLE_DOCS * SAMPLE_WINDOWS).select("lang", "part").collect()]
    drop_kept(parts)
    languages = sorted({r[0] for r in found})
    if not languages:
        return [], {}
    found.sort()
    x = np.frombuffer(b"".join(r[1] for r in found), np.uint8).reshape(-1, LENGTH)
    y = np.array([languages.index(r[0]) for r in found])
    return languages, train(x, y, len(languages)).p


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(*model)
        for batch in batches:
            found = classifier.predict(batch.column("text").to_pylist())
            yield batch_of(OUT, [batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), [f[0] for f in found], [f[1] for f in found]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], least: float = 0.4) -> DataFrame:
    """``docs`` without the documents whose language stays undecided: ``und`` or a score under ``least``. No shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(*model)
        for batch in batches:
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in classifier.predict(batch.column(at).to_pylist())], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
