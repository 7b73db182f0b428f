"""Secrets by patterns and by a battery of randomness tests.

Patterns give the base spans. The battery adds what no pattern names: tokens that look drawn at random from the alphabet of an
encoding. The encoding of a token is the narrowest alphabet that holds all its signs (hexadecimal of one case, base32, base36,
base62, base64 in both spellings). Against the hypothesis of independent, uniform signs of that alphabet stand three tests:

* chi-squared of the counts of signs, in a gamma law of its exact mean and variance, since a token has few signs;
* runs of values above and below the middle of the alphabet;
* serial correlation of neighbouring values.

Fisher's rule combines their p-values into one score, near 0 for words and uniform for random tokens.

Score alone cannot tell how often a long word or a path passes, and short tokens pass oftener than long ones. So the corpus is asked:
all its ordinary text, without base spans and candidates, is cut into decoys of the tokens' lengths, and for each length
band the share of decoys that score as high is the p-value of a token being text. A step-up rule over the tested tokens of the
corpus then bounds the share of false discoveries (RATE). Counts of (band, score) come from all documents in one aggregation of
a few thousand cells; they give one least score for each band, and a second scan takes the spans. The values under base spans are
tested along with the candidates: they stay whatever the tests say, and those that pass are counted as confirmed.

Defined cases: null texts count as empty and have no spans; values too short or long for the tests are not confirmed; offsets are code points, ends exclusive; spans that start together
come in the order assign, access, hex, random; rows that repeat each give a row, and count as often as they stand in the corpus; an
empty table gives no rows; a corpus without candidates, or whose candidates all look like text, adds no spans; scores on the same
side of a cell's border tie and are taken or left together; other columns, whatever their names, are ignored. A text of any length
costs its length: decoys are tested in groups of GROUP signs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow

KINDS = ("assign", "access", "hex", "random")
RATE = 0.05  #: false discoveries among the added spans, at most

# The patterns of the contract.
ASSIGN = re.compile(r"""(?=[PpSsTtAa])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  #: a shorter run has no longer match inside
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")  #: of which any match holds one
ASSIGNED = 12  #: signs of an assigned value, at least

RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")  #: the look-behind spares starts inside a run
BREAK, NAME = re.compile(r"[+/_-]"), re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+")
LONG = 256  #: a longer token is a file in text form, no secret, and stands among the ordinary text
BANDS = (16, 20, 24, 32, 40, 64)  #: least lengths
DECOYS = (16, 20, 24, 32, 40, 64)  #: lengths of decoys, in turn; the shortest of a band passes most easily
FINE, CELLS = 8, 240  #: cells of a tenfold score, cells of a band
GROUP = 1 << 18

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in the order of their values, narrowest first.
ENCODINGS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _DIGITS + _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
)
SIZES = np.array([len(e) for e in ENCODINGS])
WIDEST = int(SIZES.max())
FITS = np.zeros(256, np.uint16)  #: of each sign, a bit for each alphabet that holds it
VALUE = np.zeros((len(ENCODINGS), 256), np.int64)
for _k, _alphabet in enumerate(ENCODINGS):
    for _v, _c in enumerate(_alphabet):
        FITS[ord(_c)] |= 1 << _k
        VALUE[_k, ord(_c)] = _v


#: A published polynomial for the complementary error function, relative error under 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: np.ndarray) -> np.ndarray:
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = np.full_like(t, ERFC[-1])
    for c in ERFC[-2::-1]:
        power = power * t + c
    upper = t * np.exp(power - x * x) / 2
    return np.where(z >= 0, upper, 1 - upper)


OTHER = bytes(c for c in range(256) if not FITS[c])  #: what no alphabet holds


class Battery(NamedTuple):
    """p-values of each token; ``score`` is the combined one."""

    encoding: np.ndarray
    chi: np.ndarray
    runs: np.ndarray
    serial: np.ndarray
    score: np.ndarray


def battery(signs: np.ndarray, lengths: np.ndarray) -> Battery:
    """The tests over tokens that lie one behind the other in ``signs`` (bytes of the widest alphabet); each of 2 signs or more."""
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fits = np.bitwise_and.reduceat(FITS[signs], starts)
    encoding = np.log2(fits & -fits.astype(np.int32)).astype(int)  # the lowest bit
    size, n = SIZES[encoding].astype(float), lengths.astype(float)
    value = VALUE[encoding[owner], signs]

    counts = np.bincount(owner * WIDEST + value, minlength=len(lengths) * WIDEST).reshape(-1, WIDEST)
    x = size / n * np.einsum("ij,ij->i", counts, counts) - n
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    free = 2 * mean**2 / var  # degrees of freedom of the matched law, whose tail is taken by cube roots
    chi = normal_tail((np.cbrt(np.maximum(x, 0) / mean) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))

    inside = owner[1:] == owner[:-1]
    own = owner[1:][inside]
    high = value >= (size[owner] // 2)
    share = (size - size // 2) / size  # of the values above the middle
    change = 2 * share * (1 - share)
    turns = np.bincount(own[(high[1:] != high[:-1])[inside]], minlength=len(lengths))
    spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (share * (1 - share) * (1 - 4 * share * (1 - share)))
    off = np.maximum(np.abs(turns - (n - 1) * change) - 0.5, 0) / np.sqrt(spread)
    runs = np.minimum(2 * normal_tail(off), 1)

    centred = value - ((size - 1) / 2)[owner]
    product = np.bincount(own, (centred[1:] * centred[:-1])[inside], minlength=len(lengths))
    serial = np.minimum(2 * normal_tail(np.abs(product / ((size**2 - 1) / 12 * np.sqrt(n - 1)))), 1)

    half = -(np.log(np.maximum(chi, 1e-300)) + np.log(np.maximum(runs, 1e-300)) + np.log(np.maximum(serial, 1e-300)))
    return Battery(encoding, chi, runs, serial, np.exp(-half) * (1 + half + half**2 / 2))


def band_of(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, lengths, "right") - 1


def cell_of(score: np.ndarray) -> np.ndarray:
    """0 for the most random scores."""
    return np.minimum(-np.log10(np.maximum(score, 1e-300)) * FINE, CELLS - 1).astype(int)


class Span(NamedTuple):
    """A match, and where its value begins, which ends with it."""

    start: int
    kind: int
    end: int
    value: int


def long_tokens(text: str) -> list[tuple[int, int]]:
    """Runs of 16 signs or more; all hexadecimal and access spans lie inside of them."""
    return [m.span() for m in RUN.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """By start, then kind. ``runs`` are the text's long tokens."""
    lower = text.lower()
    assigned = ASSIGN.finditer(text) if any(w in lower for w in WORDS) else ()
    out = [Span(m.start(), 0, m.end(), m.start(2)) for m in assigned if len(m[2]) >= ASSIGNED]
    for a, b in runs:
        out += [Span(m.start(), 1, m.end(), m.start() + len("AKIA")) for m in ACCESS.finditer(text, a, b)]
        out += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def testable(token: str) -> bool:
    """The battery takes tokens of 16 to LONG signs with a digit and a letter, unless half of one is words and numbers between
    dashes and strokes: paths, dates and file names are no encodings of random bytes, and ordinary text, of which the decoys are
    made, has none to compare them with."""
    if not BANDS[0] <= len(token) <= LONG or token.isalpha() or not any(c in _DIGITS for c in token) or not any(c not in _DIGITS and c not in "+/-_" for c in token):
        return False
    return 2 * sum(len(p) for p in BREAK.split(token) if NAME.fullmatch(p)) < len(token)


def candidates(text: str, runs: list[tuple[int, int]], base: list[Span]) -> list[Span]:
    """Testable tokens that touch no base span, without dashes and strokes around them."""
    out, at, free = [], 0, 0  # ``free``: the furthest end of the base spans before ``at``
    for low, high in runs:
        while at < len(base) and base[at].start < high:
            free = max(free, base[at].end)
            at += 1
        run = text[low:high]
        token = run.strip("+/-_")
        start = low + len(run) - len(run.lstrip("+/-_"))
        if free <= low and testable(token):
            out.append(Span(start, 3, start + len(token), start))
    return out


def value_of(text: str, span: Span) -> str:
    """What the battery tests of a span: the value without dots and the signs that encodings pad with."""
    return text[span.value : span.end].replace(".", "").strip("+/-_=").replace("=", "")


def ordinary(text: str, taken: list[tuple[int, int]]) -> np.ndarray:
    """The signs of ``text`` outside the spans ``taken``, one behind the other."""
    out, at = [], 0
    for a, b in sorted(taken):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    whole = "".join([*out, text[at:]]) if out else text
    return np.frombuffer(whole.encode("ascii", "ignore").translate(None, OTHER), np.uint8)


def decoys(signs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signs, lengths) of the pieces that ordinary text is cut into, in groups; a last piece too short for its turn goes."""
    turn = sum(DECOYS)
    step = GROUP // turn * turn
    for low in range(0, len(signs), step):
        part = signs[low : low + step]
        lengths = np.tile(np.array(DECOYS), len(part) // turn + 1)
        lengths = lengths[np.cumsum(lengths) <= len(part)]
        if len(lengths):
            yield part[: int(lengths.sum())], lengths


def tested(texts: list[str], spans: list[list[Span]]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """((text, span) numbers, bands, cells) of those of ``spans`` whose values the battery takes."""
    tokens = [(i, k, v) for i, own in enumerate(spans) for k, s in enumerate(own) if testable(v := value_of(texts[i], s))]
    if not tokens:
        return [], np.zeros(0, int), np.zeros(0, int)
    lengths = np.array([len(v) for *_, v in tokens])
    score = battery(np.frombuffer("".join(v for *_, v in tokens).encode(), np.uint8), lengths).score
    return [(i, k) for i, k, _ in tokens], band_of(lengths), cell_of(score)


def cells_of(pieces: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Counts of (band, cell) of decoys."""
    if not pieces:
        return np.zeros(len(BANDS) * CELLS, np.int64)
    signs, lengths = (np.concatenate(part) for part in zip(*pieces, strict=True))
    return np.bincount(band_of(lengths) * CELLS + cell_of(battery(signs, lengths).score), minlength=len(BANDS) * CELLS)


def with_candidates(text: str) -> list[Span]:
    runs = long_tokens(text)
    base = base_spans(text, runs)
    return base + candidates(text, runs, base)


def tally(docs: DataFrame) -> DataFrame:
    """(band, cell, tested, decoys) over all of ``docs``: at most len(BANDS) * CELLS rows."""
    schema = pa.schema([("band", pa.int32()), ("cell", pa.int32()), ("tested", pa.int64()), ("decoys", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(BANDS) * CELLS), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [with_candidates(t) for t in texts]
            _, bands, cells = tested(texts, spans)
            seen[0] += np.bincount(bands * CELLS + cells, minlength=seen.shape[1])
            pieces, held = [], 0
            for text, own in zip(texts, spans, strict=True):
                for piece in decoys(ordinary(text, [(s.start, s.end) for s in own])):
                    pieces.append(piece)
                    held += len(piece[0])
                    if held >= GROUP:
                        seen[1] += cells_of(pieces)
                        pieces, held = [], 0
            seen[1] += cells_of(pieces)
        at = np.flatnonzero(seen.any(0))
        yield batch_of(schema, [at // CELLS, at % CELLS, seen[0][at], seen[1][at]])

    parts = map_arrow(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, "band int, cell int, tested long, decoys long")
    return parts.groupBy("band", "cell").agg(F.sum("tested").alias("tested"), F.sum("decoys").alias("decoys"))


def last_cells(counts: np.ndarray, rate: float = RATE) -> list[int]:
    """The last cell of each band whose tokens are discoveries, -1 for none. ``counts`` (2, bands, cells): tested tokens and
    decoys. A token's p-value is the share of its band's decoys in its cell or a more random one; the largest p of which
    p <= rate * (tokens with a p as small) / (all tokens) is the border."""
    found, text = counts
    p = (1 + np.cumsum(text, 1)) / (1 + text.sum(1, keepdims=True))
    total = found.sum()
    order = np.argsort(p, axis=None, kind="stable")
    ranks = np.cumsum(found.ravel()[order])
    ranks = ranks[np.searchsorted(p.ravel()[order], p.ravel()[order], "right") - 1]  # ties count together
    fine = p.ravel()[order] * total <= rate * ranks
    border = p.ravel()[order][fine].max() if total and fine.any() else -1.0
    return [int(np.searchsorted(row, border, "right")) - 1 for row in p]


def learn(docs: DataFrame, rate: float = RATE) -> list[int]:
    """Borders of each band from all of ``docs``."""
    counts = np.zeros((2, len(BANDS), CELLS), np.int64)
    for r in tally(docs).collect():  # a bounded number of cells
        counts[:, r["band"], r["cell"]] = r["tested"], r["decoys"]
    return last_cells(counts, rate)


def all_spans(texts: list[str], borders: list[int]) -> list[tuple[list[Span], list[Span], int]]:
    """(base, all spans, how many of all are confirmed) of each text."""
    spans = [with_candidates(t) for t in texts]
    numbers, bands, cells = tested(texts, spans)
    random = {at for at, good in zip(numbers, cells <= np.array(borders)[bands] if len(numbers) else (), strict=True) if good}
    out = []
    for i, own in enumerate(spans):
        base = [s for s in own if s.kind < 3]
        added = [s for k, s in enumerate(own) if s.kind == 3 and (i, k) in random]
        out.append((base, sorted(base + added), sum((i, k) in random for k in range(len(own)))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())])


def find_secrets(docs: DataFrame, borders: list[int]) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed): counts and digest of the base spans, all spans, and
    how many of them hold a value that the battery takes for random, for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], borders)
            counts = [[sum(s.kind == k for s in base) for base, *_ in found] for k in range(3)]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, *_ in found]
            yield batch_of(OUT, [batch.column("doc_id").to_pylist(), *counts, digests, [joined(every) for _, every, _ in found], [n for *_, n in found]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
