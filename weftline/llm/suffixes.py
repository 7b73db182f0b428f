"""Suffix-array dedup: remove every byte covered by a 400-byte string that also starts elsewhere.

A sparse suffix array: in any two equal 400-byte strings winnowing picks the same core of 192 bytes (the
one with the smallest hash, the leftmost of equal ones), so only suffixes at cores are sorted. A core seen once covers nothing; a core whose whole
surroundings (208 bytes either way) are seen twice covers them all. For the rest, which stand at the
edges of repeated passages, the surroundings of each core are sorted, to the right and, reversed, to
the left, by deep-shallow sorting: multikey quicksort over characters of 8 bytes down to 32 bytes, then
blind tries for the groups that still agree. Two occurrences share the string that takes l bytes to the
left and 208 - l to the right if they stand together in both orders; the array of common prefixes tells.

Groups around one core hold each distinct surrounding once. A group of over HOT surroundings never meets
in one task: its 209 possible strings are halved into ranges with longer cores and smaller surroundings,
counted by hash, and only ranges that stay undecided are cut again, down to the single string; nothing is lost.

Defined cases: a null or empty text has no bytes and keeps the digest of none; texts of under 400 bytes
lose nothing; matches never cross documents; repeated rows are each other's copies; a null doc_id is a
document like others; an empty table has no rows; extra columns, whatever their names, are ignored or, in
``remove_repeats``, kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT, batch_of, drop_kept, keep, map_arrow, partitions, prefix_hash, rows_of, sliding_min, span_hash

LENGTH = 400
CORE = 192
SLACK = LENGTH - CORE
SHALLOW = 4  #: characters of 8 bytes that multikey quicksort looks at
HOT = 500
PARTS = 4  #: ranges that an undecided range of a hot group is cut into
BATCH_ROWS = 10_000


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, core hashes, hashes of the surroundings) of the cores that winnowing picks."""
    data, n = np.frombuffer(raw, np.uint8), len(raw)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n - LENGTH + 1, SEGMENT):
        low, high = max(0, at - SLACK), min(n, at + SEGMENT + 2 * LENGTH)
        part = data[low:high]
        sums, inverse = prefix_hash(part)
        first = at - low  # windows start at first .. last
        last = min(n - LENGTH, at + SEGMENT - 1) - low
        starts = np.arange(first, last + SLACK + 1)
        core = span_hash(sums, inverse, starts, starts + CORE)
        key = (core >> np.uint64(22) << np.uint64(22)) | (starts - first).astype(np.uint64)
        picked = np.unique(sliding_min(key, SLACK + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
        where = picked + first + low
        left, right = np.minimum(where, SLACK), np.minimum(n - where - CORE, SLACK)
        around = span_hash(sums, inverse, where - left - low, where + CORE + right - low)
        around = around + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append((where, core[picked], around))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    where, core, around = (np.concatenate(x) for x in zip(*found, strict=True))
    where, first_of = np.unique(where, return_index=True)
    return where, core[first_of], around[first_of]


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("at", pa.list_(pa.int32())), ("core", pa.list_(pa.int64())), ("around", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("own", pa.list_(pa.int32()))]
)
SIGNED_DDL = "doc_id long, text_key long, n_bytes long, sha256 string, at array<int>, core array<long>, around array<long>, times array<int>, own array<int>"


def once_each(at: np.ndarray, core: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, core, around, times, own): each core with its surroundings once, the first of them, counted up to two; own:
    starts that the text itself repeats. A periodic text has a core at each period, and ships one."""
    if not len(at):
        return at, core, around, at, at
    by = np.lexsort((around, core))
    new = np.concatenate([[True], (core[by][1:] != core[by][:-1]) | (around[by][1:] != around[by][:-1])])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(by)))
    first = by[starts]
    return at[first], core[first], around[first], np.minimum(counts, 2), np.sort(at[by[np.repeat(counts > 1, counts)]])


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, key, raw in rows_of([batch], "doc_id", "text_key", "raw"):
            at, core, around, times, own = once_each(*anchors(raw))
            out.append((doc_id, key, len(raw), hashlib.sha256(raw).hexdigest(), at.astype(np.int32), core.view(np.int64), around.view(np.int64), times.astype(np.int32), own.astype(np.int32)))
        if out:
            yield batch_of(SIGNED, list(zip(*out, strict=True)))


class BlindTrie:
    """Orders the strings (padded to one length) of a group with a long common prefix. Inner nodes know only where
    their strings first differ; an insertion goes down blindly, compares once, and branches where it must."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, text: bytes, row: int) -> None:
        if self.root is None:
            self.root = [self.size, text, [row]]
            return
        node = self.root
        while node[0] < self.size:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        differ = int.from_bytes(text) ^ int.from_bytes(node[1])
        if not differ:
            node[2].append(row)
            return
        depth = self.size - (differ.bit_length() + 7) // 8
        other, parent, node = node[1], None, self.root
        while node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        leaf = [self.size, text, [row]]
        if node[0] == depth:
            node[1][text[depth]] = leaf
            return
        branch = [depth, {text[depth]: leaf, other[depth]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """(rows, length of the prefix that each shares with the row before; 0 for the first)."""
        rows, common = [], []
        waiting = [(self.root, 0)]
        while waiting:
            node, shared = waiting.pop()
            if node[0] == self.size:
                rows += node[2]
                common += [shared, *[self.size] * (len(node[2]) - 1)]
            else:
                children = [node[1][c] for c in sorted(node[1])]
                waiting += [(x, node[0]) for x in children[:0:-1]] + [(children[0], shared)]
        return rows, common


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows of ``strings`` (uint8, width a multiple of 8) by group and then by bytes, and the bytes
    each shares with the row before it, -1 where a group begins."""
    m, width = strings.shape
    chars = strings.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = group[order].astype(np.int64)
    common = np.full(m, -1, np.int64)
    edge = np.concatenate([[True], segment[1:] != segment[:-1]])
    segment = np.cumsum(edge)
    tied = np.arange(m)
    for depth in range(min(SHALLOW, chars.shape[1])):
        size = np.bincount(segment[tied])
        tied = tied[size[segment[tied]] > 1]
        if not len(tied):
            break
        rows = order[tied]
        char = chars[rows, depth]
        by = np.lexsort((char, segment[tied]))
        order[tied], char = rows[by], char[by]
        own = segment[tied]
        inner = np.concatenate([[False], own[1:] == own[:-1]])
        new = inner & np.concatenate([[False], char[1:] != char[:-1]])
        differ = char[new] ^ char[np.flatnonzero(new) - 1]
        common[tied[new]] = 8 * depth + leading_equal(differ)
        edge[tied[new]] = True
        segment = np.cumsum(edge)
    starts = np.flatnonzero(edge)
    sizes = np.diff(np.append(starts, m))
    for start, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        trie = BlindTrie(width)
        for row in order[start : start + size]:
            trie.insert(strings[row].tobytes(), int(row))
        rows, shared = trie.ordered()
        order[start : start + size] = rows
        common[start + 1 : start + size] = shared[1:]
    return order, common


def leading_equal(differ: np.ndarray) -> np.ndarray:
    """Leading zero bytes of non-zero 64-bit values."""
    shift = np.arange(56, -1, -8, dtype=np.uint64)
    return ((differ[:, None] >> shift) & np.uint64(255) != 0).argmax(1) if len(differ) else np.zeros(0, np.int64)


def shared_windows(group: np.ndarray, left: list[bytes], right: list[bytes], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) bytes to the left with which a row's string is shared in its group; most is -1 for none.
    ``left`` strings are reversed. All strings contain the core, so what is covered is one stretch."""
    m, width = len(group), -(-slack // 8) * 8
    least, most = np.full(m, slack + 1), np.full(m, -1)
    classes, sizes = [], []
    for strings in (left, right):
        padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(m, width)
        order, common = deep_shallow(group, padded)
        classes.append((order, common))
        sizes.append(np.array([len(s) for s in strings]))
    name_l, name_r = np.empty(m, np.int64), np.empty(m, np.int64)
    for taken in range(slack + 1):
        fits = np.flatnonzero((sizes[0] >= taken) & (sizes[1] >= slack - taken))
        if len(fits) < 2:
            continue
        for name, (order, common), depth in ((name_l, classes[0], taken), (name_r, classes[1], slack - taken)):
            name[order] = np.cumsum(common < depth)
        code = name_l[fits] * (m + 1) + name_r[fits]
        by = np.argsort(code, kind="stable")
        same = code[by][1:] == code[by][:-1]
        hit = np.zeros(len(fits), bool)
        hit[by[1:]] = same
        hit[by[:-1]] |= same
        rows = fits[hit]
        least[rows] = np.minimum(least[rows], taken)
        most[rows] = taken
    return least, most


EDGE_DDL = "core long, doc_id long, text_key long, at int, left binary, right binary"


def cut_out(hot: bool):
    """Texts and their open cores -> the surroundings of each core of a hot group, or of the others."""
    schema = pa.schema([("core", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("at", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, key, raw, places in rows_of(batches, "doc_id", "text_key", "raw", "open"):
            out = []
            for place in places or ():
                if place["hot"] == hot:
                    at, end = place["at"], place["at"] + CORE
                    out.append((place["core"], doc_id, key, at, raw[max(0, at - SLACK) : at][::-1], raw[end : end + SLACK]))
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    return run


def resolve_hot(spark, edges: DataFrame) -> DataFrame:
    """Covered stretches of hot groups, by counts alone. A row stands for the strings that take low..high bytes to the
    left of its core; what all of them hold is the row's core, what any of them holds its surroundings. Surroundings
    that are seen twice cover the whole range; where a core has several, some of them seen once, the range is cut into
    PARTS and looked at again."""
    taken = lambda side, n: F.substring(side, F.lit(1), n)
    rows = edges.select("*", F.lit(0).alias("low"), F.lit(SLACK).alias("high"))
    found = None
    while True:
        step = F.ceil((F.col("high") - F.col("low") + 1) / PARTS).cast("int")
        parts = rows.withColumn("step", step).withColumn("start", F.explode(F.sequence(F.col("low"), F.col("high"), F.col("step"))))
        parts = parts.withColumn("high", F.least(F.col("start") + F.col("step") - 1, F.col("high"))).withColumn("low", F.col("start")).drop("step", "start")
        parts = parts.filter((F.octet_length("left") >= F.col("low")) & (F.octet_length("right") >= SLACK - F.col("high")))
        inner = F.xxhash64("core", "low", "high", taken("left", F.col("low")), taken("right", SLACK - F.col("high")))
        outer = F.xxhash64(F.col("inner"), taken("left", F.col("high")), taken("right", SLACK - F.col("low")), F.least(F.octet_length("left"), F.col("high")))
        parts = keep(spark, parts.withColumn("inner", inner).withColumn("outer", outer), "hot")
        kinds = keep(spark, parts.groupBy("inner", "outer").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "at")).alias("first")), "hot-kinds")
        undecided = keep(spark, kinds.groupBy("inner").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 and least = 1").select("inner"), "hot-undecided")
        counted = keep(spark, parts.join(kinds, ["inner", "outer"]), "hot-counted")
        sure = counted.filter("times > 1").select("doc_id", "text_key", "at", F.greatest("low", SLACK - F.octet_length("right")).alias("least"), F.least("high", F.octet_length("left")).alias("most")).filter("least <= most")
        found = sure if found is None else found.unionByName(sure)
        first = F.struct("doc_id", "text_key", "at") == F.col("first")  # one of each kind goes on, for the others to meet
        rows = counted.filter(first & F.expr("low < high")).join(undecided, "inner").select(*edges.columns, "low", "high")
        if rows.isEmpty():
            break
    return found.select("doc_id", "text_key", (F.col("at") - F.col("most")).alias("first"), (F.col("at") - F.col("least") + LENGTH).alias("last"))


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings sorted by core -> covered stretches (doc_id, text_key, first, last)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    rows, at, number, groups = [], None, 0, []

    def close():
        least, most = shared_windows(np.array(groups), [r[4] for r in rows], [r[5] for r in rows], SLACK)
        return [(rows[i][1], rows[i][2], rows[i][3] - int(most[i]), rows[i][3] - int(least[i]) + LENGTH) for i in np.flatnonzero(most >= 0)]

    for row in rows_of(batches, "core", "doc_id", "text_key", "at", "left", "right"):
        if row[0] != at:
            if len(rows) >= BATCH_ROWS:
                if out := close():
                    yield batch_of(schema, list(zip(*out, strict=True)))
                rows, groups = [], []
            at, number = row[0], number + 1
        rows.append(row)
        groups.append(number)
    if rows and (out := close()):
        yield batch_of(schema, list(zip(*out, strict=True)))


def union_of(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(stretches):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def stretches_of(n: int, full: list[int], edges: list) -> list[tuple[int, int]]:
    """Maximal covered runs of a text from its wholly repeated cores and its resolved edges."""
    found = [(e["first"], e["last"]) for e in edges]
    for at in full:
        left, right = min(at, SLACK), min(n - at - CORE, SLACK)
        if left + right >= SLACK:
            found.append((at - left, at + CORE + right))
    return union_of(found)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("raw"), *more)


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, texts): facts has a row per document (doc_id, text_key, n_bytes, sha256); texts has, for each distinct
    document that repeats anything, raw, ``full`` (starts of cores that are wholly repeated) and ``edges``."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    signed = keep(spark, map_arrow(keyed(docs), sign, SIGNED_DDL).withColumn("row", F.monotonically_increasing_id()), "signed")
    cores = signed.select("row", F.explode(F.arrays_zip("at", "core", "around", "times")).alias("c")).select("row", "c.at", "c.core", "c.around", "c.times")
    # What a join meets on a hot core is written first: fresh exchanges on both sides can be split.
    often = keep(spark, cores.groupBy("core").agg(F.sum("times").alias("total")).filter("total > 1").select("core"), "often")
    again = keep(spark, cores.join(often.hint("merge"), "core"), "cores")
    kinds = keep(spark, again.groupBy("core", "around").agg(F.sum("times").alias("times"), F.min(F.struct("row", "at")).alias("first")), "kinds")
    open_cores = keep(spark, kinds.groupBy("core").agg(F.count("*").alias("around_count"), F.min("times").alias("least")).filter("around_count > 1 and least = 1").select("core", (F.col("around_count") > HOT).alias("hot")), "open")
    opened = kinds.join(open_cores, "core").select("first.row", "first.at", "core", "hot").groupBy("row").agg(F.collect_list(F.struct("at", "core", "hot")).alias("open"))
    full = again.drop("times").join(kinds.filter("times > 1").select("core", "around"), ["core", "around"]).groupBy("row").agg(F.collect_list("at").alias("full"))
    names = signed.select("row", "doc_id", "text_key", "own")
    wanted = names.join(full.join(opened, "row", "full"), "row").groupBy("doc_id", "text_key").agg(
        # rows that repeat have the same cores, so one of them speaks for all
        F.array_distinct(F.concat(*[F.coalesce(F.first(c, ignorenulls=True), F.array().cast("array<int>")) for c in ("full", "own")])).alias("full"),
        F.array_distinct(F.flatten(F.collect_list("open"))).alias("open"),
    )
    texts = keep(spark, keyed(docs).hint("merge").join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]), "texts")
    drop_kept(often, again, kinds, open_cores)
    undecided = texts.select("doc_id", "text_key", "raw", "open")
    cool = map_arrow(undecided.filter(F.exists("open", lambda x: ~x["hot"])), cut_out(False), EDGE_DDL)
    stretches = map_arrow(cool.repartition(n, "core").sortWithinPartitions("core"), resolve, "doc_id long, text_key long, first int, last int")
    hot = undecided.filter(F.exists("open", lambda x: x["hot"]))
    if not hot.isEmpty():
        stretches = stretches.unionByName(resolve_hot(spark, map_arrow(hot, cut_out(True), EDGE_DDL)))
    found = stretches.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("edges"))
    covered = texts.drop("open").hint("merge").join(found, ["doc_id", "text_key"], "left")
    return signed.select("doc_id", "text_key", "n_bytes", "sha256"), covered


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        out = []
        for doc_id, key, raw, full, edges in rows_of([batch], "doc_id", "text_key", "raw", "full", "edges"):
            if runs := stretches_of(len(raw), full or [], edges or []):
                out.append((doc_id, key, sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest()))
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    starts = [*(a for a, _ in runs), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))


def repeat_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    facts, covered = repeated(docs)
    counts = map_arrow(covered, measure, "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string")
    rows = facts.join(counts, ["doc_id", "text_key"], "left")
    return rows.select(
        F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered bytes cut from ``text``; a character that loses a byte loses all its bytes."""
    _, covered = repeated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("left_text", pa.string())])
        for batch in batches:
            out = [(i, k, without(raw, stretches_of(len(raw), full or [], edges or [])).decode("utf-8", "ignore")) for i, k, raw, full, edges in rows_of([batch], "doc_id", "text_key", "raw", "full", "edges")]
            if out:
                yield batch_of(schema, list(zip(*out, strict=True)))

    cut = map_arrow(covered, run, "doc_id long, text_key long, left_text string").select(F.struct("doc_id", "text_key").alias("_key"), "left_text")
    # All columns of docs travel in one struct, so no name of theirs can meet another.
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row")).withColumn("_key", F.struct(F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(F.col("_row.text").cast("string")).alias("text_key")))
    joined = own.join(cut, "_key", "left")
    return joined.select(*[(F.coalesce("left_text", F.col("_row.text").cast("string")) if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
