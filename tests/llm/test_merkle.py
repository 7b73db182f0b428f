"""Operator 12 against a tree built with loops and against its oracle, with blocks of production size and with small ones."""

import hashlib
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.conftest import DOCS
from tests.parity import compare, connect
from weftline.llm import merkle as M

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by loops."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = []
    for r in rows:
        text, even = r["text"], r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        given = text.replace("\n", "") if even and text is not None else text
        made.append((r["source"], r["doc_id"], *[H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))) for t in (text, given)]))

    def climb(nodes):
        """The levels of a tree, and the siblings of each leaf by level, left and right."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append([H(*low[k : k + 3]) for k in range(0, len(low), 3)])
        ways = []
        for i in range(len(nodes)):
            way = []
            for low in levels[:-1]:
                run = i // 3 * 3
                way.append(("".join(low[run:i]), "".join(low[i + 1 : run + 3])))
                i //= 3
            ways.append(way)
        return levels[-1][0], ways

    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = sorted({m[0] for m in made}, key=first)
    trees = {}
    for s in sources:
        own = sorted((m for m in made if m[0] == s), key=lambda m: (first(m[1]), m[2]))
        trees[s] = own, *climb([m[2] for m in own])
    root, tops = climb([trees[s][1] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops):
        own, subroot, ways = trees[s]
        for (_, doc_id, leaf, given), way in zip(own, ways):
            folded = given
            for left, right in way + top:
                folded = H(left, folded, right)
            out.append((doc_id, leaf, subroot, root, H(*[a + b for a, b in way + top]), folded, folded == root))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, M.verify_documents(docs).collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)


def test_rows_match_the_oracle(spark, sf_dir, documents):
    assert compare(M.verify_documents(documents), connect(sf_dir), M.MERKLE_SQL) > 0


def test_trees_of_many_rounds(spark, small_blocks):
    """One source of a third of all rows, many small ones, sizes around powers of three, and 30 sources above."""
    rows, k = [], 0
    for s, n in [("hot", 100), *((f"s{j}", 1 + j % 12) for j in range(28)), (None, 27), ("é", 28)]:
        for _ in range(n):
            rows.append(Row(doc_id=k * 7 % 1009, text=f"line {k}\nmore\n" if k % 3 else None, lang="en" if k % 2 else None, source=s, n_chars=k))
            k += 1
    docs = spark.createDataFrame(rows, DOCS_BY_NAME)
    assert got(docs) == plain(rows)


DOCS_BY_NAME = T.StructType([DOCS["doc_id"], DOCS["text"], DOCS["lang"], DOCS["source"], DOCS["n_chars"]])


def test_odd_cases(spark, odd_docs):
    rows = odd_docs.collect()
    wide = odd_docs.withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x")).withColumn("h", F.lit(None).cast("string"))
    assert got(wide) == plain(rows)
    assert got(odd_docs.limit(0)) == []
    one = odd_docs.filter("doc_id = 2")
    assert got(one) == plain(one.collect()) and got(one)[0][4] == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_take_places_of_their_own(spark, small_blocks):
    rows = [Row(doc_id=1, text="a\nb", lang=None, source="s", n_chars=3)] * 40 + [Row(doc_id=1, text="c\nd", lang=None, source="s", n_chars=3)] * 5
    assert got(spark.createDataFrame(rows, DOCS_BY_NAME)) == plain(rows)


def test_a_changed_sibling_or_order_is_noticed(spark, documents):
    """Each row's proof gives the root for its own leaf, and for no other."""
    rows = M.document_rows(documents)
    ways = M.prove(rows.withColumn("given", F.col("leaf")))
    fold = M.fold(F.col("given"), F.col("path")) == F.col("root")
    assert ways.filter(~fold).count() == 0
    other = M.fold(F.sha2(F.col("given"), 256), F.col("path")) == F.col("root")
    assert ways.filter(other).count() == 0


def test_no_node_is_asked_for_by_more_than_a_block(spark, small_blocks):
    """200 rows of one source: each exploded coordinate is asked for by one block's leaves at most."""
    n = 200
    rows = spark.range(n).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
    asked = rows.select("i", F.explode(M.coordinates(F.col("i"), F.col("n"))).alias("s")).groupBy("s.level", "s.i").count()
    assert asked.agg(F.max("count")).first()[0] <= M.BLOCK
