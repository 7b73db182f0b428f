"""Places, medians and runs against brute force: wide rows, hot keys, null keys, ties and empty tables."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from weftline.operators import journal as J
from weftline.operators import relational as R
from weftline.plans.recompute import with_places
from weftline.session import SHARED, remove_shared


def test_places_of_wide_rows(spark):
    """Columns outside the order must not change the ranges between the counts and the ranks."""
    df = spark.range(0, 120_000, 1, 4).select((F.xxhash64("id") % 1009).alias("v"), "id", F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    got = {r["id"]: r["place"] for r in R.placed(df, [F.col("v"), F.col("id")]).collect()}
    want = sorted((r["v"], r["id"]) for r in df.collect())
    assert got == {i: at for at, (_, i) in enumerate(want, 1)}


def test_places_within_a_hot_or_missing_key(spark):
    df = spark.range(0, 9_000, 1, 6).select(F.when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), (F.col("id") * 7919 % 997).alias("v"), "id")
    got = {r["id"]: r["place"] for r in R.placed(df, [F.col("key"), F.desc("v"), F.col("id")], "key").collect()}
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["key"]].append((-r["v"], r["id"]))
    assert got == {i: at for rows in groups.values() for at, (_, i) in enumerate(sorted(rows), 1)}


def test_places_of_no_rows(spark):
    assert R.placed(spark.range(0).withColumn("v", F.col("id")), [F.col("id")]).columns == ["id", "v", "place"]
    assert R.placed(spark.range(0), [F.col("id")]).count() == 0


def test_upper_median_of_hot_null_and_constant_keys(spark):
    rng = random.Random(3)
    rows = [("hot", rng.choice([None, rng.random() * 1e6, float(rng.randrange(5))])) for _ in range(5000)]
    rows += [(None, float(i)) for i in range(7)] + [("same", 2.5)] * 4 + [("empty", None)] + [("pair", 1.0), ("pair", 9.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    values = defaultdict(list)
    for k, x in rows:
        if x is not None:
            values[k].append(x)
    got = {r["k"]: r["median"] for r in R.upper_median(df, "x", "k").collect()}
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}
    every = sorted(x for _, x in rows if x is not None)
    assert [r["median"] for r in R.upper_median(df, "x").collect()] == [every[len(every) // 2]]
    assert R.upper_median(df.filter("false"), "x").count() == R.upper_median(df.filter("false"), "x", "k").count() == 0


def test_last_runs_are_the_first_of_all_runs(spark):
    rows = spark.range(0, 3_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), F.col("id") % 40)).alias("run_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 700 * 3600).alias("measured_at"))
    every = [tuple(r) for r in J.runs(rows).orderBy("place").collect()]
    assert [r[3] for r in every] == list(range(1, len(every) + 1)) and every == sorted(every, key=lambda r: (r[1], r[0]), reverse=True)
    assert [tuple(r) for r in J.last_runs(rows, 2).orderBy("place").collect()] == every[:2]


def test_folders_of_places_can_be_removed(spark):
    kept = R.placed(spark.range(0, 50), [F.desc("id")])
    assert kept.filter("id = 49").first()["place"] == 1
    folder = SHARED[-1]
    assert kept.inputFiles() and all(f.split("//")[-1].lstrip("/").startswith(folder.split("//")[-1].lstrip("/")) for f in kept.inputFiles())
    mine, SHARED[:] = SHARED[-1:], SHARED[:-1]
    others, SHARED[:] = SHARED[:], mine
    remove_shared(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and not SHARED
    SHARED[:] = others


def test_one_value_reached_by_other_parts_is_a_tie(spark):
    """Weighted sums of other parts reach one value up to its last bits: the domain's name decides, as among equal values."""
    value = 0.26 * 39.51 + 0.74 * 39.52
    rows = [("u3", math.nextafter(value, 0), True), ("u2", value, True), ("u1", math.nextafter(value, 0), True), ("u0", 99.0, False), ("u4", value + 1e-6, True)]
    scores = spark.createDataFrame(rows, "domain string, value double, shown boolean")
    got = {r["domain"]: r["place"] for r in with_places(scores).collect()}
    assert got == {"u4": 1, "u1": 2, "u2": 3, "u3": 4, "u0": None}
