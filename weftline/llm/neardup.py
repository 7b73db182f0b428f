"""MinHash near-dedup with min-max hashing.

Each permutation gives two signature values, the minimum and the maximum of the set under it, so 64
evaluations make 128 values: 32 bands of 4. A pair at similarity 0.85 shares no band with probability
5e-11, at 0.8 with 5e-8. Every link is confirmed on the full shingle sets.

Groups of copies never become all pairs: equal sets are one class; each bucket names as its pivot the member that meets
most others, and first each member is compared with its pivots alone, in blocks of bounded size that each get the pivot's
text: texts sent grow with the members. Members that this leaves outside their pivot's component are far ones. They and the
members they could link with meet again in narrower groups, without any signature: shingles are put in one order, rare ones
first, and two sets that reach the similarity must share one of the first few of each (a prefix filter, which is exact). What
documents of one template share is common and comes last, so a template brings no pair together. The new groups are compared
with their pivots in turn, and only what stays outside then meets its whole group, a block with a block at a time; such a task
counts intersections for all its members at once and gives only a star per component found. Pairs within one component need
no link, so none is lost.

Defined cases: texts without words (null, empty, white space) link with nothing; a null doc_id links
with nothing and has a null component; rows that repeat a doc_id count as one document, linked through
each of their texts; an empty table has no rows; extra columns, whatever their names, are ignored or, in ``deduplicate``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, drop_kept, keep, map_arrow, partitions, rows_of, text_bytes
from .components import components
from .shingles import band_hashes, min_max_signature, permutations, set_key, shingle_set

PERMUTATIONS = 64
ROWS = 4
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1_000_000
SLOT_BITS = 20  #: of the table of how common shingles are: 4 MB at every size of the corpus
SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, raw): the key tells apart the texts of a repeated doc_id."""
    return text_bytes(docs, "doc_id").withColumn("text_key", F.xxhash64("raw"))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = permutations(PERMUTATIONS)
    for batch in batches:
        out = []
        for doc_id, text_key, raw in rows_of([batch], "doc_id", "text_key", "raw"):
            s = shingle_set(raw)
            out.append((doc_id, text_key, len(s), set_key(s), band_hashes(min_max_signature(s, a, b), ROWS) if len(s) else []))
        if out:
            yield batch_of(SIGNED, list(zip(*out, strict=True)))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block: rare shingles by pairs, common ones by a matrix product."""
    m = len(sets)
    values, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(first, len(values)))
    group = np.repeat(np.arange(len(first)), counts)
    total = np.zeros(m * m)
    rare = (counts > 1) & (counts < 32)
    at = np.flatnonzero(rare[group])
    for step in range(1, int(counts[rare].max(initial=1))):
        a = at[: -step or None]
        b = a + step
        a, b = a[b < len(group)], b[b < len(group)]
        same = group[a] == group[b]
        if not same.any():
            break
        total += np.bincount(who[a[same]] * m + who[b[same]], minlength=m * m)
    common = np.flatnonzero(counts >= 32)
    column = np.full(len(first), -1)
    column[common] = np.arange(len(common))
    at = np.flatnonzero(column[group] >= 0)
    rows, columns = who[at], column[group[at]]
    for low in range(0, len(common), 4096):
        part = (columns >= low) & (columns < low + 4096)
        dense = np.zeros((m, min(4096, len(common) - low)), np.float32)
        dense[rows[part], columns[part] - low] = 1
        total += np.triu(dense @ dense.T, 1).ravel()
    total = total.reshape(m, m)
    return total + total.T


def block_links(sets: list[np.ndarray], ids: list[int], right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A star for each component among the pairs of a block that reach ``percent``; only pairs with one member
    on either side count where both sides have members."""
    inter, size = shared_counts(sets), np.array([len(s) for s in sets], np.float64)
    near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if right.any() and not right.all():
        near &= right[:, None] != right[None, :]
    np.fill_diagonal(near, False)
    links, free = [], near.any(1)
    while free.any():
        root = int(np.argmax(free))
        reached = np.zeros(len(ids), bool)
        reached[root] = True
        edge = reached
        while edge.any():
            edge = near[edge].any(0) & ~reached
            reached = reached | edge
        links += [(ids[root], ids[i]) for i in np.flatnonzero(reached) if i != root]
        free &= ~reached
    return links


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Of two sorted sets."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


PIVOT = ["pivot", "pivot_key"]
STAR = pa.schema([("pivot", pa.int64()), ("pivot_key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("near", pa.bool_())])
STAR_DDL = "pivot long, pivot_key long, doc_id long, text_key long, n_shingles long, near boolean"


def compare_with_pivots(percent: int, read):
    """Rows come by pivot and block, the pivot's own before the members: whether each reaches ``percent``. ``read`` makes the
    shingle set of a row's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = None
        for batch in batches:
            out = []
            for pivot, pivot_key, doc_id, key, is_pivot, raw in rows_of([batch], *PIVOT, "doc_id", "text_key", "is_pivot", "raw"):
                own = read(raw)
                if is_pivot:
                    center = own
                else:
                    common = intersection_size(center, own)
                    out.append((pivot, pivot_key, doc_id, key, len(own), 100 * common >= percent * (len(own) + len(center) - common)))
            if out:
                yield batch_of(STAR, list(zip(*out, strict=True)))

    return run


def compare_blocks(percent: int):
    """Rows come by pivot, left and right: one block of far members with one block of the group at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sides, sets, out = None, [], [], [], []

        def close():
            if len(ids) > 1:
                out.extend(block_links(sets, ids, np.array(sides), percent))

        for batch in batches:
            for pivot, key, left, right, side, doc_id, raw in rows_of([batch], *PIVOT, "left", "right", "side", "doc_id", "raw"):
                if (pivot, key, left, right) != at:
                    close()
                    at, ids, sides, sets = (pivot, key, left, right), [], [], []
                ids.append(doc_id)
                sides.append(side)
                sets.append(read_set(raw))
            if len(out) > 10_000:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        close()
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    return run


def pivots(reps: DataFrame) -> DataFrame:
    """Written, distinct (pivot, pivot_key, doc_id, text_key, n_shingles): for each bucket of two or more, at least one of them
    ``open``, its members under the member that meets most others over all its buckets. Linear in the members of buckets."""
    spark = reps.sparkSession
    member = reps.select("doc_id", "text_key", "n_shingles", "open", F.explode("bands").alias("bucket"))
    full = keep(spark, member.groupBy("bucket").agg(F.count("*").alias("size"), F.max("open").alias("open")).filter("size > 1 and open").drop("open"), "buckets")
    member = keep(spark, member.drop("open").join(full, "bucket"), "members")
    drop_kept(full)
    met = member.groupBy("doc_id", "text_key").agg(F.sum("size").alias("met"))
    ranked = member.join(met, ["doc_id", "text_key"])
    best = keep(spark, ranked.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("minus"), "text_key")).alias("best")), "best")
    met = keep(spark, member.join(best, "bucket").select((-F.col("best.minus")).alias("pivot"), F.col("best.text_key").alias("pivot_key"), "doc_id", "text_key", "n_shingles").distinct(), "pivots")
    drop_kept(member, best)
    return met


def block_count() -> Column:
    """Blocks of a group of ``docs`` documents with ``shingles`` shingles."""
    return F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")


def block_of(count: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.col(count)).cast("int")


def groups_of(members: DataFrame, count: str) -> DataFrame:
    """(pivot, pivot_key, ``count``): into how many blocks each pivot's members go."""
    return members.groupBy(*PIVOT).agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles")).select(*PIVOT, block_count().alias(count))


def with_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` (doc_id, text_key, ...) with the texts. Merge joins at every size: a broadcast that only small inputs
    allow would hide what the texts cost."""
    key = ["doc_id", "text_key"]
    wanted = placed.select(key).distinct().hint("merge")
    texts = keyed_texts(docs.filter(F.col("doc_id").isNotNull())).join(wanted, key, "left_semi").dropDuplicates(key)
    return placed.join(texts.hint("merge"), key)


def pivot_rows(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(pivot, pivot_key, block, doc_id, text_key, is_pivot): each member once, and the pivot once for each block."""
    members, itself = met.join(groups, PIVOT).withColumn("block", block_of("blocks")), F.expr("doc_id = pivot and text_key = pivot_key")
    own = members.filter(itself).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = [*PIVOT, "block", "doc_id", "text_key"]
    return members.filter(~itself).select(*columns, F.lit(False).alias("is_pivot")).union(own.select(*columns, F.lit(True)))


def far_rows(far: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """(pivot, pivot_key, left, right, side, doc_id, text_key): each far member for every block of its group, and each member of a
    group that has far ones for every block of them."""
    spark = far.sparkSession
    counts = keep(spark, groups_of(far, "lefts").join(groups, PIVOT), "far-groups")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = far.join(counts, PIVOT).select(*PIVOT, block_of("lefts").alias("left"), every("blocks").alias("right"), F.lit(False).alias("side"), "doc_id", "text_key")
    right = members.join(counts, PIVOT).select(*PIVOT, every("lefts").alias("left"), block_of("blocks").alias("right"), F.lit(True).alias("side"), "doc_id", "text_key")
    return left.unionByName(right)


def read_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


SETS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("open", pa.bool_()), ("raw", pa.binary())])
PREFIXES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("open", pa.bool_()), ("bands", pa.list_(pa.int64()))])


def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            out = [(i, key, far, shingle_set(raw).tobytes()) for i, key, far, raw in rows_of([batch], "doc_id", "text_key", "open", "raw")]
            yield batch_of(SETS, list(zip(*out, strict=True)))


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a partition hold a shingle of each slot, added up before anything is sent."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for (raw,) in rows_of(batches, "raw"):
        np.add.at(total, slots(read_set(raw)), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])


def commonness(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each of 2^SLOT_BITS slots are in ``sets``. Slots of rare and common shingles may fall together:
    any order makes the prefix filter exact, a better one only makes its groups smaller."""
    found = map_arrow(sets.select("raw"), count_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint32)
    table[found["slot"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.uint32).max)
    return table


def rare_prefix(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles, rare ones first. Two sets that reach ``percent`` have at least that
    share of either in common, so the first that they share stands in both prefixes. One that no other set holds is left out."""
    count = common[slots(shingles)]
    first = np.lexsort((shingles, count))[: len(shingles) - -(-percent * len(shingles) // 100) + 1]
    return shingles[first[count[first] > 1]]


def prefixes(common, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, far, raw in rows_of([batch], "doc_id", "text_key", "open", "raw"):
                s = read_set(raw)
                out.append((doc_id, key, len(s), far, rare_prefix(s, common.value, percent).view(np.int64)))
            if out:
                yield batch_of(PREFIXES, list(zip(*out, strict=True)))

    return run


def stars_of(met: DataFrame, fetch, read, percent: int) -> tuple[DataFrame, DataFrame]:
    """Written (groups, stars): into how many blocks each pivot's members go, and whether each member reaches ``percent`` with its
    pivot. ``fetch`` adds the bytes that ``read`` makes a set of."""
    spark = met.sparkSession
    groups = keep(spark, groups_of(met, "blocks"), "groups")
    rows = fetch(pivot_rows(met, groups)).repartition(partitions(spark), *PIVOT, "block").sortWithinPartitions(*PIVOT, "block", F.desc("is_pivot"))
    return groups, keep(spark, map_arrow(rows.select(*PIVOT, "doc_id", "text_key", "is_pivot", "raw"), compare_with_pivots(percent, read), STAR_DDL), "stars")


def star_links(stars: DataFrame) -> DataFrame:
    return stars.filter("near").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))


def rooted(found: DataFrame, column: str) -> DataFrame:
    return found.select(F.col("id").alias(column), F.col("root").alias(f"root_{column}"))


def far_members(stars: DataFrame, found: DataFrame) -> DataFrame:
    """Written (pivot, pivot_key, doc_id, text_key, n_shingles): members outside their pivot's component."""
    rows = stars.filter("not near").join(rooted(found, "doc_id"), "doc_id", "left").join(rooted(found, "pivot"), "pivot", "left")
    outside = F.coalesce("root_doc_id", "doc_id") != F.coalesce("root_pivot", "pivot")
    return keep(stars.sparkSession, rows.filter(outside).select(*PIVOT, "doc_id", "text_key", "n_shingles"), "far")


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) of the components ``found`` after further ``links`` (a, b)."""
    for end in ("a", "b"):
        links = links.join(rooted(found, end), end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    again = components(links)
    last = again.select(F.col("id").alias("root"), F.col("root").alias("above"))
    merged = found.join(last, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
    return merged.union(again.join(found.select("id"), "id", "left_anti").select("id", "root"))


def far_sets(docs: DataFrame, far: DataFrame, stars: DataFrame) -> DataFrame:
    """Written (doc_id, text_key, open, raw): the shingle set of each far member (``open``) and of each member of a group that has
    far ones, once each."""
    spark, key = docs.sparkSession, ["doc_id", "text_key"]
    members = stars.join(far.select(*PIVOT).distinct(), PIVOT, "left_semi").select(*key, F.lit(False).alias("open"))
    wanted = members.union(far.select(*key, F.lit(True))).groupBy(key).agg(F.max("open").alias("open"))
    wanted = keep(spark, wanted, "far-wanted")
    return keep(spark, map_arrow(with_texts(docs, wanted).select(*key, "open", "raw"), to_sets, "doc_id long, text_key long, open boolean, raw binary"), "sets")


def prefix_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Members by pivot, as ``pivots`` gives them, over the rare prefixes of ``sets``."""
    spark = sets.sparkSession
    common = spark.sparkContext.broadcast(commonness(sets))
    short = keep(spark, map_arrow(sets, prefixes(common, percent), "doc_id long, text_key long, n_shingles long, open boolean, bands array<long>"), "prefixes")
    common.destroy()
    met = pivots(short)
    drop_kept(short)
    return met


def similar_components(docs: DataFrame, reps: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(id, root) of what full sets show as similar and of the links in ``shared`` (a, b). ``reps``: doc_id, text_key,
    n_shingles, open, bands."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    met = pivots(reps)
    groups, stars = stars_of(met, lambda placed: with_texts(docs, placed), shingle_set, percent)
    found = components(star_links(stars).union(shared))
    far = far_members(stars, found)
    if far.isEmpty():
        return found
    sets = far_sets(docs, far, stars)
    drop_kept(met, groups, stars, far)
    texts = lambda placed: placed.join(sets.select("doc_id", "text_key", "raw").hint("merge"), ["doc_id", "text_key"])
    met = prefix_groups(sets, percent)
    groups, stars = stars_of(met, texts, read_set, percent)
    found = keep(spark, joined(found, star_links(stars)), "found")
    far = far_members(stars, found)
    if far.isEmpty():
        return found
    rows = texts(far_rows(far, stars, groups)).repartition(n, *PIVOT, "left", "right").sortWithinPartitions(*PIVOT, "left", "right")
    late = keep(spark, map_arrow(rows.select(*PIVOT, "left", "right", "side", "doc_id", "raw"), compare_blocks(percent), "a long, b long"), "far-links")
    drop_kept(met, groups, stars, far, sets)
    return joined(found, late)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text). Documents are linked
    where 100 * intersection >= percent * union of their sets of five-word shingles."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(spark, map_arrow(keyed_texts(rows), sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"), "signed")
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = keep(spark, linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = keep(spark, linkable.join(classes, "set_key").filter("doc_id = rep").dropDuplicates(["set_key"]).select("doc_id", "text_key", "n_shingles", F.lit(True).alias("open"), "bands"), "reps")
    repeated = linkable.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).filter("one <> other").select("doc_id")
    shared = linkable.join(repeated, "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = similar_components(rows, reps, shared, percent)
    drop_kept(reps)
    labels = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("label"))
    named = signed.drop("bands", "text_key").join(labels, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the smallest doc_id of their group; all columns stay."""
    gone = near_duplicates(docs, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
