"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field adds what they miss: its nodes are the tokens that hold a digit or
an @; neighbours are chained, and distant tokens that repeat or resemble each other (same letters, same
digits under other punctuation, same mailbox) share a skip potential. Nodes under base spans are clamped, and
loopy belief propagation carries labels through a document, so an entity once recognised is labelled the
same wherever it recurs. Repeats are linked each to the next, so links grow with the tokens.

Weights are learned here, by pseudo-likelihood in numpy: on token sequences of the corpus, labelled by the base spans (at
most CORPUS of those with entities and of those without, picked by hash among about SAMPLE_DOCS documents), and on
generated sequences (seeded) of spellings that the patterns miss.

What the patterns miss by contract, since failing matches are dropped without a retry, is a phone number or a card that
runs into the digits after it; the field, which labels tokens, parts them. It also follows an entity once recognised into
other spellings.

Defined cases: null texts count as empty and have no spans; offsets are code points, ends exclusive; spans that
start together come in the order email, ip, card, phone; repeated rows each give a row; an empty corpus leaves the generated
sequences to learn from; extra columns, whatever their names, are ignored or, in ``mask``, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  #: 0 is none
SURE = 0.95  #: marginal from which a node is a span
ROUNDS, DAMP = 12, 0.3
SAMPLE_DOCS = 20_000  #: documents, about, whose tokens may be learned from
CORPUS, TOKENS, TOKEN_CHARS = 1500, 40, 64  #: sequences of the corpus of either kind, their tokens, a token's characters at most
CLAMP = 12.0  #: log-odds of a node under a base span

# The patterns of the contract. Possessive forms and look-behinds only spare retries that must fail.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DIGIT = re.compile(r"[0-9]")
NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")  #: a token with a digit or @; starts at token starts alone, so an endless word costs one pass


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: of each @, the run of local characters before it, back to the last match, and the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            free = m.end()
            yield start, free
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


FEATURES = 40


def node_features(token: str) -> list[int]:
    """Active features of a token, each below FEATURES."""
    digits, dots = sum(c in "0123456789" for c in token), token.count(".")
    groups = re.findall(r"[0-9]+", token)
    name, _, host = token.partition("@")
    on = [0, 1 + min(digits, 20) // 2, 12 + min(dots, 4), 17 + min(len(groups), 5)]
    if "@" in token:
        on.append(23 + (bool(name) and "." in host))
        on.append(25 + (len(token) - len(token.strip("@.,;:!?")) > 0))
    on += [
        *([27] if token[0] == "+" else ()),
        *([28] if re.search(r"[A-Za-z]", token) else ()),
        *([29] if len(groups) == 4 and all(len(g) <= 3 for g in groups) and dots == 3 else ()),
        *([30] if token.count("-") + token.count("(") >= 2 else ()),
        *([31] if digits >= 12 and luhn("".join(groups)) else ()),
        *([32] if any(len(g) > 4 for g in groups) else ()),
        *([33] if re.search(r"[/:=#$%&_]", token) else ()),
        *([34] if re.fullmatch(r"[0-9a-fA-F]{16,}", token.strip("\"'")) else ()),
        *([35] if re.fullmatch(r"\([0-9]{2,4}\)", token) else ()),
        *([36] if re.fullmatch(r"[0-9]{3}-[0-9]{4}\W*", token) else ()),
        *([37] if re.fullmatch(r"\+[0-9]{1,3}", token) else ()),
    ]
    return on


def link_keys(token: str) -> list[tuple[str, str]]:
    """What makes two tokens similar."""
    plain = token.strip("\"'()[]<>.,;:!?#$%&*").lower()
    keys = [("word", plain)] if len(plain) >= 5 else []
    digits = "".join(re.findall(r"[0-9]+", token))
    if len(digits) >= 7:
        keys.append(("digits", digits))
    if "@" in plain and len(name := plain.partition("@")[0]) >= 3:
        keys.append(("mailbox", name))
    return keys


def graph(text: str, base: list[tuple[int, int, int]]):
    """(nodes as (start, end), features, clamped labels, chain edges, skip edges) of a text."""
    nodes, feats, clamp, chain, skip = [], [], [], [], []
    last: dict[tuple[str, str], int] = {}
    at = 0
    for i, m in enumerate(NODE.finditer(text)):
        nodes.append(m.span())
        feats.append(node_features(m[0]))
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        over = next((k + 1 for s, k, e in base[at : at + 4] if s < m.end() and e > m.start()), 0)
        clamp.append(over)
        if i and m.start() - nodes[i - 1][1] == 1:
            chain.append((i - 1, i))
        keys = link_keys(m[0])
        linked = {last[k] for k in keys if k in last}
        skip += [(j, i) for j in sorted(linked)]
        last |= {k: i for k in keys}
    return nodes, feats, clamp, chain, skip


class Field:
    """unary (FEATURES, LABELS), chain and skip potentials (LABELS, LABELS), both symmetric."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, feats: list[list[int]], clamp: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Loopy sum-product over any number of documents at once; each edge sends a message both ways."""
        score = np.stack([self.unary[f].sum(0) for f in feats])
        held = np.array(clamp)
        score[held > 0] = -CLAMP
        score[held > 0, held[held > 0]] = CLAMP
        pairs = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        table = np.exp(np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)]))
        source, target = pairs.ravel(), pairs[:, ::-1].ravel()
        table = np.repeat(table, 2, 0)
        message = np.zeros((len(source), LABELS))
        back = np.arange(len(source)) ^ 1
        for _ in range(ROUNDS if len(source) else 0):
            belief = score.copy()
            np.add.at(belief, target, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.maximum(np.einsum("el,elk->ek", out, table), 1e-30))
            message = DAMP * message + (1 - DAMP) * (new - new.mean(1, keepdims=True))
        belief = score
        np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def generated(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """A sequence of tokens with their labels: entities in usual and unusual spellings, repeats, and other numbers."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))

    def entity(kind: int) -> list[list[str]]:
        """Spellings of one entity, as token lists."""
        if kind == 1:
            name = f"{word()}.{word()}" if rng.random() < 0.5 else f"{word()}.{word()[:4]}{digits(2)}"
            host = f"{word()}.{('com', 'org', 'net')[rng.integers(3)]}"
            return [[f"{name}@{host}"], [f"{name}@{host}".upper()], [f"<{name}@{host}>,"], [f"{name}@localhost"]]
        if kind == 2:
            p = [str(x) for x in rng.integers(0, 256, 4)]
            return [[".".join(p)], [".".join(p) + ":80"], ["-".join(p)], [f"[{'.'.join(p)}]"]]
        if kind == 3:
            body = digits(15)
            number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
            parts = [number[i : i + 4] for i in range(0, 16, 4)]
            return [[number], parts, ["-".join(parts)], [".".join(parts)], [f"{number}."]]
        a, b, c, d = str(rng.integers(1, 99)), digits(3), digits(3), digits(4)
        return [[f"+{a}", f"({b})", f"{c}-{d}"], [f"+{a}", b, c, d], [f"+{a}-{b}-{c}-{d}"], [f"+{a}{b}{c}{d}"], [f"00{a}{b}{c}{d}"], [f"({b})", f"{c}-{d}"]]

    def other() -> list[str]:
        pick = rng.integers(11)
        n, long = int(rng.integers(1, 9)), digits(int(rng.integers(9, 24)))
        long = long[:-1] + str((int(long[-1]) + luhn(long)) % 10)  # never a card's digits
        return [
            [digits(n)], [f"{digits(2)}.{digits(2)}"], [f"{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}"],
            [f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"], [f"{rng.integers(10, 24)}:{digits(2)}"], [f"${digits(3)},{digits(3)}"],
            [hashlib.sha1(digits(4).encode()).hexdigest()], [f"{word()}{digits(3)}"], [f"@{word()}"], [long], [f"id={digits(10)}"],
        ][pick]

    tokens: list[str] = []
    labels: list[int] = []
    for _ in range(rng.integers(1, 4)):
        if rng.random() < 0.5:
            kind = int(rng.integers(1, LABELS))
            forms = entity(kind)
            for _ in range(rng.integers(1, 4)):
                form = forms[rng.integers(len(forms))]
                apart = ["-"] if rng.random() < 0.7 else []  # else the next one follows at once
                tokens += [*form, *apart]
                labels += [*[kind] * len(form), *[0] * len(apart)]
        else:
            form = other()
            for _ in range(rng.integers(1, 3)):
                tokens += [*form, "-"]
                labels += [0] * (len(form) + 1)
    return tokens, labels


def labelled_tokens(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """The tokens with a digit or @ of a text with the labels of its base spans, as sequences of up to TOKENS; a dash
    stands for what is between tokens that do not touch."""
    base, at, end, tokens, labels = base_spans(text), 0, None, [], []
    for m in NODE.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        if end is not None and m.start() - end != 1:
            tokens.append("-")
            labels.append(0)
        end = m.end()
        tokens.append(m[0][:TOKEN_CHARS])
        labels.append(next((k + 1 for s, k, e in base[at : at + 4] if s < m.end() and e > m.start()), 0))
        if len(tokens) >= TOKENS:
            yield tokens, labels
            tokens, labels = [], []
    if tokens:
        yield tokens, labels


def corpus_sequences(docs: DataFrame) -> list[tuple[list[str], list[int]]]:
    """Distinct labelled sequences of ``docs``, at most CORPUS with an entity and CORPUS without: those with the smallest
    hashes, of documents picked by a hash of their text. Only these reach the driver."""
    schema = pa.schema([("tokens", pa.list_(pa.string())), ("labels", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pair for t in batch.column("text").to_pylist() for pair in labelled_tokens(t)]
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    count, scale = texts.count(), 1 << 30
    picked = texts.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < min(scale, scale * SAMPLE_DOCS // max(count, 1) + 1))
    found = map_arrow(picked, run, "tokens array<string>, labels array<int>").distinct()
    order = [F.xxhash64("tokens"), F.to_json("tokens")]
    some = F.exists("labels", lambda x: x > 0)
    both = found.filter(some).orderBy(*order).limit(CORPUS).collect() + found.filter(~some).orderBy(*order).limit(CORPUS).collect()
    return sorted((r["tokens"], r["labels"]) for r in both)


def train(docs: DataFrame | None = None, sequences: int = 1500, steps: int = 300, seed: int = 11) -> Field:
    """Pseudo-likelihood: each node's label given its features and its neighbours' labels, by Adam."""
    rng = np.random.default_rng(seed)
    feats, truth, pairs = [], [], ([], [])
    for tokens, labels in [*(generated(rng) for _ in range(sequences)), *(corpus_sequences(docs) if docs is not None else ())]:
        text, at, own = " ".join(tokens), 0, {}
        for token, label in zip(tokens, labels, strict=True):
            own[at] = label
            at += len(token) + 1
        nodes, f, _, chain, skip = graph(text, [])
        low = len(feats)
        feats += f
        truth += [own[s] for s, _ in nodes]
        for kind, edges in zip(pairs, (chain, skip), strict=True):
            kind.extend((a + low, b + low) for a, b in edges)
    x, y = np.zeros((len(feats), FEATURES)), np.array(truth)
    for i, f in enumerate(feats):
        x[i, f] = 1
    one = np.eye(LABELS)[y]
    near = []
    for edges in pairs:
        total = np.zeros((len(y), LABELS))
        e = np.array(edges, np.int64).reshape(-1, 2)
        np.add.at(total, e[:, 0], one[e[:, 1]])
        np.add.at(total, e[:, 1], one[e[:, 0]])
        near.append(total)
    design = np.concatenate([x, *near], 1)
    w, m, v = np.zeros((design.shape[1], LABELS)), 0.0, 0.0
    for t in range(1, steps + 1):
        s = design @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = design.T @ (p - one) / len(y) + 1e-4 * w
        for at in (FEATURES, FEATURES + LABELS):  # potentials of pairs are symmetric
            g[at : at + LABELS] = (g[at : at + LABELS] + g[at : at + LABELS].T) / 2
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(w[:FEATURES], w[FEATURES : FEATURES + LABELS], w[FEATURES + LABELS :])


def plausible(kind: int, token: str) -> bool:
    """An added span must hold what its kind cannot lack."""
    digits = sum(c in "0123456789" for c in token)
    return ("@" in token.strip("@"), digits >= 4, 12 <= digits <= 19, 7 <= digits <= 15)[kind]


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base, all spans) of each text; spans are (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    out = [(b, list(b)) for b in base]
    feats, clamp, chain, skip, owners = [], [], [], [], []
    for i, text in enumerate(texts):
        if not base[i] and not NODE.search(text):
            continue
        nodes, f, c, ch, sk = graph(text, base[i])
        low = len(feats)
        feats += f
        clamp += c
        chain += [(a + low, b + low) for a, b in ch]
        skip += [(a + low, b + low) for a, b in sk]
        owners.append((i, low, nodes))
    if not feats:
        return out
    p = field.marginals(feats, clamp, chain, skip)
    label = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    for i, low, nodes in owners:
        text, run = texts[i], None
        for k, (start, end) in enumerate([*nodes, (len(text) + 2, len(text) + 2)]):
            kind = int(label[low + k]) if k < len(nodes) and not clamp[low + k] else 0
            if run and (kind != run[1] or start - run[2] != 1):
                a, which, b = run
                piece = text[a:b]
                a += len(piece) - len(piece.lstrip("\"'()[]<>.,;:!?#$%&*"))
                b -= len(piece) - len(piece.rstrip("\"'()[]<>.,;:!?#$%&*"))
                if a < b and plausible(which - 1, text[a:b]):
                    out[i][1].append((a, which - 1, b))
                run = None
            if kind:
                run = (run[0] if run else start, kind, end)
        out[i][1].sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones, the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all
    spans, for each row of ``docs`` (doc_id, text)."""
    weights = (field.unary, field.chain, field.skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*weights)
        for batch in batches:
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], own)
            counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield batch_of(OUT, [batch.column("doc_id").to_pylist(), *counts, digests, [joined(every) for _, every in found]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` masked and ``n_chars`` (where there is one) counted anew. No shuffle."""
    weights = (field.unary, field.chain, field.skip)
    text_at, count_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*weights)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            new = [t if t is None else masked(t, every) for t, (_, every) in zip(texts, all_spans([t or "" for t in texts], own), strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if count_at is not None:
                counts = [n if t is None else len(t) for t, n in zip(new, columns[count_at].to_pylist(), strict=True)]
                columns[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
