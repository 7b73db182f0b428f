"""Merkle manifest of a dataset: a tree of hashes over the rows of each group and one over the groups' roots.

The hash H is the lower-case hex SHA-256 of its inputs, concatenated; digests go in as hex text. A leaf is H of a row's fields.
While more than one node remains, each run of ARITY consecutive nodes becomes its H; a last run may be shorter, even a single node.

How it is spread:

* leaves are hashed in the scan; only (group, doc_id, digests) are written, put in order by ranges that are drawn once, and
  numbered by the counts of the ranges before;
* a tree is built in rounds of LEVELS levels: a block of ARITY ** LEVELS consecutive leaves is whole subtrees, so it is folded up
  in one row, and its root is a leaf of the next round. A group of any size is many blocks, no task ever holds more than one
  block at a time, and a tree of 10^10 leaves takes three rounds. All groups go through the same rounds, together;
* the nodes are a table (g, level, i, h) in each round. For a proof, a row explodes the coordinates of its siblings from its index
  and the group's size, joins that table, and puts what it gets in order. In a round that is at most 2 * LEVELS coordinates, and a
  node is asked for by the leaves of one block only. What lies above is found once for each block, by the same steps in
  the next round, and joined by block: no node near a root is asked for by a whole group;
* a proof is folded with its leaf, level by level, as one expression.

Defined cases: fields that are null count as ``-``; leaves ascend by doc_id, null first, those of one doc_id by their
digest; rows that repeat are leaves of their own, in places next to each other; groups ascend bytewise, null first, and a null group is
a group like others; a group of one row is its leaf; one group alone is the root; a proof without siblings is H of nothing; an
empty table has no tree and gives no rows; other columns, whatever their names, are ignored; a text of any length costs its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, partitions

ARITY = 3
LEVELS = 7  #: of one round; a block has ARITY ** LEVELS = 2187 leaves, 70 kB of digests
BLOCK = ARITY**LEVELS
POWERS = [ARITY**k for k in range(40)]  #: up to the largest 64-bit integer
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<l:string,r:string>>"  #: of a path: the siblings of a level left and right of one's own node, as hex


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields.values()]), 256)


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of integers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def depth(n: Column) -> Column:
    """Levels above ``n`` leaves: as many as it takes until one node remains."""
    return reduce(lambda a, b: a + b, [(n > p).cast("int") for p in POWERS])


def in_round(n: Column) -> Column:
    """Levels of this round above ``n`` leaves."""
    return F.least(depth(n), F.lit(LEVELS))


def numbered(rows: DataFrame, order: list[str], kind: str) -> DataFrame:
    """``rows`` with ``at``, their place (from 0) by ``order``, nulls first, and ``part``, the range that holds them. Ranges
    are drawn once and written; the counts that shift their places are one row a range."""
    spark, n = rows.sparkSession, max(2, partitions(rows.sparkSession))
    row = F.monotonically_increasing_id()
    laid = keep(spark, rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("row", row), kind)
    part, within = F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND((1 << 33) - 1)
    counts = laid.groupBy(part).agg(F.count("*").alias("count"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    return laid.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("at", within + F.col("shift")).drop("row", "shift")


def subtree(h: Column, n: Column) -> Column:
    """All levels of this round over a block's leaf digests ``h`` (binary, in order), lowest first."""

    def above(levels: Column) -> Column:
        low = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), div(F.size(low) - 1, ARITY).cast("int"))
        return F.transform(runs, lambda k: F.unhex(F.sha2(F.concat_ws("", F.transform(F.slice(low, k * ARITY + 1, ARITY), lambda x: F.lower(F.hex(x)))), 256)))

    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), in_round(n))
    return F.aggregate(steps, F.array(h), lambda levels, _: F.concat(levels, F.array(above(levels))))


def grow(spark: SparkSession, leaves: DataFrame, kind: str) -> list[tuple[DataFrame, DataFrame]]:
    """Rounds from the bottom, each (leaves (g, i, n, h), nodes (g, level, i, h)), all written. The last one has one block a group."""
    rounds = []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        block = div(F.col("i"), BLOCK).alias("block")
        digests = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        blocks = leaves.groupBy("g", block).agg(digests.alias("h"), F.first("n").alias("n"))
        trees = keep(spark, blocks.select("g", "block", "n", subtree(F.col("h"), F.col("n")).alias("levels")), f"{kind}-trees")
        first = div(F.col("block") * BLOCK, F.element_at(F.array(*[F.lit(p) for p in POWERS[: LEVELS + 1]]), F.col("level") + 1))
        nodes = trees.select("g", "block", F.posexplode("levels").alias("level", "row")).select("g", "level", first.alias("low"), F.posexplode("row").alias("k", "h"))
        rounds.append((leaves, nodes.select("g", "level", (F.col("low") + F.col("k")).alias("i"), "h")))
        if most <= BLOCK:
            return rounds
        most = -(-most // BLOCK)
        leaves = trees.select("g", F.col("block").alias("i"), div(F.col("n") + BLOCK - 1, BLOCK).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("h"))


def roots(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, h): what remains of each group."""
    leaves, nodes = rounds[-1]
    top = leaves.filter("i = 0").select("g", in_round(F.col("n")).alias("level"), F.lit(0).cast("long").alias("i"))
    return nodes.join(top, ["g", "level", "i"]).select("g", "h")


def coordinates(i: Column, n: Column) -> Column:
    """(level, i) of the siblings on the way up from leaf ``i`` of ``n``, through this round."""

    def of_level(k: Column) -> Column:
        power = F.element_at(F.array(*[F.lit(p) for p in POWERS[:LEVELS]]), k + 1)
        own, last = div(i, power), div(n - 1, power)
        low = own - own % ARITY
        return F.transform(F.filter(F.sequence(low, F.least(low + ARITY - 1, last)), lambda x: x != own), lambda x: F.struct(k.alias("level"), x.alias("i"), (x < own).alias("left")))

    return F.flatten(F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), in_round(n)), of_level))


def steps(siblings: Column, levels: Column) -> Column:
    """The path of a round from its siblings (level, i, left, h): of each level, left and right."""
    ordered = F.array_sort(siblings)

    def side(k: Column, left: bool) -> Column:
        mine = F.filter(ordered, lambda s: (s["level"] == k) & (s["left"] == F.lit(left)))
        return F.concat_ws("", F.transform(mine, lambda s: F.lower(F.hex(s["h"]))))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), levels), lambda k: F.struct(side(k, True).alias("l"), side(k, False).alias("r")))


def climb(rows: DataFrame, nodes: DataFrame, above: DataFrame | None, more: list[str]) -> DataFrame:
    """(g, i, path, those of ``more`` and of ``above``): the way up of each of ``rows`` (g, i, n, *more). ``above`` (g, block,
    path, ...) has the ways of the blocks' roots. Siblings and rows meet by block, so one exchange serves the gathering and
    the join with what is above."""
    block = div(F.col("i"), BLOCK).alias("block")
    asked = rows.select("g", "i", block, F.explode(coordinates(F.col("i"), F.col("n"))).alias("s")).select("g", "i", "block", F.col("s.level").alias("level"), F.col("s.i").alias("at"), F.col("s.left").alias("left"))
    found = asked.join(nodes.select("g", "level", F.col("i").alias("at"), "h"), ["g", "level", "at"])
    own = F.struct(in_round(F.col("n")).alias("levels"), *more).alias("own")
    both = found.select("g", "block", "i", F.struct("level", F.col("at").alias("i"), "left", "h").alias("s")).unionByName(rows.select("g", block, "i", own), allowMissingColumns=True)
    ways = both.repartition("g", "block").groupBy("g", "block", "i").agg(F.max("own").alias("own"), steps(F.collect_list("s"), F.max("own.levels")).alias("path"))
    ways = ways.select("g", "block", "i", "path", *[f"own.{c}" for c in more])
    if above is None:
        return ways.drop("block")
    kept = [c for c in above.columns if c not in ("g", "block", "path")]
    up = above.select("g", "block", F.col("path").alias("up"), *kept)
    return ways.join(up, ["g", "block"]).select("g", "i", F.concat("path", "up").alias("path"), *more, *kept)


def climb_all(spark: SparkSession, rounds: list[tuple[DataFrame, DataFrame]], rows: DataFrame, top: DataFrame | None, more: list[str], kind: str) -> DataFrame:
    """The ways of ``rows``, leaves of the lowest round, up to their group's root and on along ``top`` (g, path, ...)."""
    above = top.withColumn("block", F.lit(0).cast("long")) if top is not None else None
    for leaves, nodes in reversed(rounds[1:]):
        ways = climb(leaves.select("g", "i", "n"), nodes, above, [])
        above = keep(spark, ways.withColumnRenamed("i", "block"), f"{kind}-ways")
    return climb(rows, rounds[0][1], above, more)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def path_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"]))), 256)


def manifest(rows: DataFrame, group: str = "source") -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]], DataFrame, list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Both trees over ``rows`` (doc_id, leaf, given, ``group``), where ``leaf`` is a binary digest and ``given`` what is to be
    verified: (leaves (g, i, n, h, doc_id, given), rounds of the groups' trees, groups (g, n, h), rounds of the tree above, its
    root (h) as a table). All is written."""
    spark = rows.sparkSession
    placed = numbered(rows.select(F.col(group).cast("string").alias("group"), "doc_id", "leaf", "given"), ["group", "doc_id", "leaf"], "merkle-leaves")
    parts = keep(spark, placed.groupBy("part", "group").agg(F.min("at").alias("low"), F.count("*").alias("count")), "merkle-parts")
    sizes = parts.groupBy("group").agg(F.min("low").alias("start"), F.sum("count").alias("n"))
    groups = keep(spark, numbered(sizes, ["group"], "merkle-order").select("group", "start", "n", F.col("at").alias("g")), "merkle-groups")
    known = parts.select("part", "group").alias("p").join(groups.alias("o"), F.col("p.group").eqNullSafe(F.col("o.group"))).select("p.part", "p.group", "o.start", "o.n", "o.g")
    on = (F.col("l.part") == F.col("k.part")) & F.col("l.group").eqNullSafe(F.col("k.group"))  # a range holds few rows, a group may hold many
    joined = placed.alias("l").join(known.alias("k"), on).select("k.g", (F.col("l.at") - F.col("k.start")).alias("i"), "k.n", F.col("l.leaf").alias("h"), "l.doc_id", "l.given")
    leaves = keep(spark, joined, "merkle-coordinates")
    rounds = grow(spark, leaves.select("g", "i", "n", "h"), "merkle-groups")
    subroots = keep(spark, groups.select("g").join(roots(rounds), "g"), "merkle-subroots")
    count = subroots.count()
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("n"), "h")
    above = grow(spark, tops, "merkle-top")
    return leaves, rounds, subroots, above, roots(above).select("h")


def prove(rows: DataFrame, group: str = "source") -> DataFrame:
    """(doc_id, leaf, given, subroot, root, path): the way of each row to the root. ``path`` has the siblings of each level."""
    spark = rows.sparkSession
    leaves, rounds, subroots, above, root = manifest(rows, group)
    hexed = lambda c: F.lower(F.hex(c))
    ways = climb_all(spark, above, above[0][0].withColumn("subroot", F.col("h")), None, ["subroot"], "merkle-top")
    top = ways.crossJoin(F.broadcast(root.withColumnRenamed("h", "root"))).select(F.col("i").alias("g"), "path", "subroot", "root")  # one row
    every = climb_all(spark, rounds, leaves, keep(spark, top, "merkle-top"), ["doc_id", "h", "given"], "merkle-groups")
    return every.select("doc_id", hexed("h").alias("leaf"), hexed("given").alias("given"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), "path")


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, given): both digests of each of ``docs``, as bytes. ``given`` is the digest after the tampering of
    the contract, which takes the line feeds from the texts of every other document by the checksum of its id."""
    fields = {c: F.col(c) for c in FIELDS}
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
    return docs.select("doc_id", "source", F.unhex(leaf_digest(fields)).alias("leaf"), F.unhex(leaf_digest(fields | {"text": tampered})).alias("given"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of ``docs`` (doc_id, source, lang, n_chars, text)."""
    proven = prove(keep(docs.sparkSession, document_rows(docs), "merkle-digests"))
    folded = proven.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold(F.col("given"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"


#: CRC-32 of a decimal number, digit by digit and bit by bit: -1 stands for a shift.
_SQL_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"""


def _sql_tree(name: str, leaves: str) -> str:
    return f"""{name}(g, level, i, n, h) AS (SELECT g, 0, i, n, h FROM {leaves} UNION ALL SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, i // 3, n)"""


def _sql_ways(tree: str, leaves: str) -> str:
    """(g, i, way): the siblings of each level, left and right."""
    return f"""SELECT g, i, list({{'l': l, 'r': r}} ORDER BY level) AS way FROM (SELECT a.g, a.i, a.level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < a.own), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > a.own), '') AS r
  FROM (SELECT f.g, f.i, t.level, t.i AS own, t.i // 3 AS run FROM {leaves} f JOIN {tree} t ON t.g = f.g AND t.n > 1 AND t.i = f.i // CAST(pow(3, t.level) AS BIGINT)) a JOIN {tree} s ON s.g = a.g AND s.level = a.level AND s.i // 3 = a.run GROUP BY ALL) GROUP BY g, i"""


MERKLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, source, sha256(concat({", ".join(_sql_field(c) for c in FIELDS)})) AS h, sha256(concat({", ".join(_sql_field(c) for c in FIELDS[:-1])}, {_sql_field("(CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END)")})) AS given FROM (SELECT *, {_SQL_CRC} AS crc FROM documents)),
 f AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
 {_sql_tree("t", "f")}, o AS MATERIALIZED (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM t WHERE n = 1), {_sql_tree("u", "o")},
 w AS ({_sql_ways("t", "f")}), v AS ({_sql_ways("u", "o")}),
 p AS (SELECT f.doc_id, f.h, f.given, o.h AS subroot, list_concat(coalesce(w.way, []), coalesce(v.way, [])) AS way FROM f JOIN o ON o.i = f.g LEFT JOIN w ON w.g = f.g AND w.i = f.i LEFT JOIN v ON v.i = f.g),
 r AS (SELECT doc_id, h AS leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_concat([{{'l': given, 'r': ''}}], way), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM p)
 SELECT *, folded_root = root AS verified FROM r"""
