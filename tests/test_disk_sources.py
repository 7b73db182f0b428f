"""Sources that read parts of files: vertex tables in two orders, gzip files of many members, archive records by byte range."""

import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.sources import archive_ranges as AR
from weftline.sources import gzip_lines as GL
from weftline.sources import parsers as P
from weftline.sources.vertices import VertexTable


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vertices(spark, tmp_path_factory):
    rows = spark.range(50_000).select(F.col("id"), F.concat(F.lit("com.d"), F.sha1(F.col("id").cast("string"))).alias("rev_domain"))
    made = VertexTable.build(rows, f"file://{tmp_path_factory.mktemp('vertices')}", buckets=8)
    yield made, rows
    made.drop()


def test_lookups_open_one_bucket(spark, vertices):
    made, rows = vertices
    name = rows.filter("id = 4242").first().rev_domain
    plan = made.find([77], [name])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SelectedBucketsCount: 1 out of 8") == 2 and "EqualTo(id,77)" in plan and "EqualTo(rev_domain," in plan
    assert {tuple(r) for r in made.find([77, 10**9], [name, "com.none"]).collect()} == {tuple(r) for r in rows.filter(F.col("id").isin(77, 4242)).collect()}
    assert made.find().count() == 0
    assert made.find([4242], [name]).count() == 1


def test_buckets_are_sorted_files_with_filters(vertices):
    import pyarrow.parquet as pq

    made, _ = vertices
    for key in ("id", "rev_domain"):
        files = made.by(key).inputFiles()
        assert len(files) == 8
        for f in files:
            keys = pq.read_table(f.removeprefix("file://")).column(key).to_pylist()
            assert keys == sorted(keys)


def test_join_leaves_the_vertices_where_they_lie(spark, vertices):
    made, rows = vertices
    asked = spark.range(0, 60_000, 7).select(F.col("id").alias("src"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = made.resolve(asked, "src")
        plan = plan_of(joined)
        vertex_side = plan[plan.index("by_id") - 1500 :]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, vertex_side
        got = {tuple(r) for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {tuple(r) for r in rows.filter("id % 7 = 0").collect()}


def packed(texts, level=6):
    out = io.BytesIO()
    for t in texts:
        out.write(gzip.compress(t, level))
    return out.getvalue()


def pieces(data, split):
    """Lines by ranges, as the tasks read them."""
    f, out = io.BytesIO(data), []
    for low in range(0, max(len(data), 1), split):
        for block in GL.lines_of(f, low, min(low + split, len(data)), len(data)):
            out += block.split(b"\n")
    return out


def test_ranges_give_every_line_once():
    """Members cut anywhere, also within lines, empty members, lines over several members, members that hold what looks like one."""
    rng = random.Random(8)
    for _ in range(300):
        text = b"".join(rng.choice((b"", b"x" * rng.randrange(40), gzip.compress(b"inner")[: rng.randrange(30)].replace(b"\n", b""), b"\x1f\x8b\x08\x00" * 3)) + b"\n" for _ in range(rng.randrange(1, 60)))
        if rng.random() < 0.3:
            text = text[:-1] + b"y"
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))
        members = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        data = packed(members, rng.choice((0, 1, 6)))
        want = text.removesuffix(b"\n").split(b"\n")
        for split in (7, 23, 64, 10**6):
            assert pieces(data, split) == want, (text, cuts, split)


def test_a_long_line_over_many_members():
    data = packed([b"a\n", b"b" * 50, b"c" * 50, b"d" * 50, b"e\nf\n", b"g"])
    for split in (1, 5, 20, 33, 1000):
        assert pieces(data, split) == [b"a", b"b" * 50 + b"c" * 50 + b"d" * 50 + b"e", b"f", b"g"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    lines = [f"{k}\t{k * 7 % 1000}" for k in range(40_000)]
    text = "\n".join(lines).encode() + b"\n"
    data = packed([text[k : k + 9973] for k in range(0, len(text), 9973)])
    (tmp_path / "edges.gz").write_bytes(data)
    df = GL.read_gzip_lines(spark, f"file://{tmp_path}/edges.gz", 8_000)
    assert df.rdd.getNumPartitions() == -(-len(data) // 8_000) > 10
    assert sorted(r.value for r in df.collect()) == sorted(lines)
    tasks = df.withColumn("t", F.spark_partition_id()).groupBy("t").count().collect()
    assert len(tasks) > 10 and max(r["count"] for r in tasks) < 10_000
    edges = P.read_gzip_edges(spark, f"file://{tmp_path}", 10)
    assert edges.count() == 40_000 and edges.agg(F.sum("dst")).first()[0] == sum(k * 7 % 1000 for k in range(40_000))
    with pytest.raises(Exception):
        GL.read_gzip_lines(spark, f"file://{tmp_path}/none").collect()


class Counted(io.BytesIO):
    opened = reads = 0

    def read(self, n=-1):
        Counted.reads += 1
        return super().read(n)


def test_near_ranges_are_read_at_once():
    """Three files; ranges next to each other or a gap apart are one request, others their own; each file is opened once."""
    files = {}
    wanted = []
    for name in "abc":
        data, at = b"", 0
        for k in range(20):
            member = gzip.compress(f"{name}{k}".encode() * 50)
            wanted.append((name, len(data), len(member), f"{name}{k}".encode() * 50))
            data += member + (b"\0" * 1000 if k % 5 == 4 else b"")
        files[name] = data

    def opener(name):
        Counted.opened += 1
        return Counted(files[name])

    for gap, requests in ((0, 12), (1000, 3)):
        Counted.opened = Counted.reads = 0
        got = list(AR.fetch(iter(w[:3] for w in wanted), gap, 1 << 20, opener))
        assert got == [(w[3], None) for w in wanted] and Counted.opened == 3 and Counted.reads == requests
    Counted.reads = 0
    list(AR.fetch(iter(w[:3] for w in wanted), 1000, 100, opener))
    assert Counted.reads > 12  # a request is bounded


def test_bad_ranges_are_told(spark, tmp_path):
    good = gzip.compress(b"WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody")
    broken = bytearray(good)
    broken[len(good) // 2] ^= 255
    (tmp_path / "x.gz").write_bytes(good + bytes(broken) + b"plain text")
    uri, n = f"file://{tmp_path}/x.gz", len(good)
    rows = [(1, uri, 0, n), (2, uri, n, n), (3, uri, 2 * n, 10), (4, uri, 2 * n, 99), (5, f"file://{tmp_path}/none.gz", 0, 5), (6, uri, 0, n - 3), (7, uri, 0, n)]
    got = {r.id: (bytes(r.record) if r.record is not None else None, r.error is None) for r in AR.read_ranges(spark.createDataFrame(rows, "id long, file string, offset long, length long"), "id").collect()}
    text = gzip.decompress(good)
    assert got == {1: (text, True), 2: (None, False), 3: (b"plain text", True), 4: (None, False), 5: (None, False), 6: (None, False), 7: (text, True)}


def test_archives_round_trip(spark, tmp_path):
    rows = spark.range(0, 500, 1, 3).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"))
    AR.write_archives(rows, "id", "text", f"file://{tmp_path}/warc").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    assert index.select("file").distinct().count() == 3
    got = {r.id: bytes(r.record).decode() for r in AR.read_ranges(index.filter("id % 3 = 0"), "id").collect()}
    assert got == {r.id: r.text for r in rows.filter("id % 3 = 0").collect()}
    first = index.orderBy("file", "offset").first()
    with open(first.file.removeprefix("file://"), "rb") as f:
        f.seek(first.offset)
        assert zlib.decompress(f.read(first.length), wbits=31).decode() == rows.filter(F.col("id") == first.id).first().text


def test_executors_need_no_copy_of_the_package(tmp_path):
    """From another folder, with the package found by the driver alone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(AR.__file__).parents[2]
    (tmp_path / "a.gz").write_bytes(packed([b"1\t2\n", b"3\t4\n"]))
    code = f"import sys; sys.path.insert(0, {str(root)!r}); from weftline.session import build_session; s = build_session(1, 'away'); from weftline.sources import parsers as P; print(P.read_gzip_edges(s, 'file://{tmp_path}/a.gz', 1).count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert done.stdout.strip().endswith("2"), done.stderr[-2000:]
