import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.operators import journal as J
from weftline.sources import parsers as P

DDL = "seq long, domain string, metric string, source string, state string, value double, measured_at timestamp_ntz, run_id string, collector string"
T0 = dt.datetime(2024, 1, 1)


def rows(spark, *r):
    return spark.createDataFrame([(i, d, "m", "s", state, value, T0 + dt.timedelta(seconds=at), run, "c") for i, (d, state, value, at, run) in enumerate(r)], DDL)


def test_ties_in_a_second(spark):
    j = rows(spark, ("a", "MEASURED", 1.0, 0, "r"), ("a", "MEASURED", 2.0, 0, "r"))
    assert J.latest(j).first()["value"] == 2.0
    assert J.latest(j, last_wins=False).first()["value"] == 1.0


def test_blind_with_value_is_refused(spark):
    bad = rows(spark, ("a", "BLIND", 42.0, 0, "r"))
    assert J.validate(bad).count() == 1
    with pytest.raises(Exception, match="blind"):
        J.check(bad).collect()


def test_idempotent_write_and_compaction(spark):
    j = rows(spark, ("a", "MEASURED", 1.0, 0, "r"), ("a", "MEASURED", 1.0, 0, "r"), ("a", "MEASURED", 2.0, 0, "r"))
    assert J.new_facts(j.limit(0), j).count() == 2
    assert J.new_facts(j, j).count() == 0
    assert J.compact(j.withColumn("obs_id", F.lit("x"))).first()["value"] == 2.0


def test_run_diff_outcomes(spark):
    j = rows(spark, ("a", "MEASURED", 1.0, 0, "1"), ("b", "MEASURED", 1.0, 0, "1"), ("c", "MEASURED", 1.0, 0, "1"), ("e", "MEASURED", 1.0, 0, "1"), ("b", "MEASURED", 1.0, 9, "2"), ("c", "MEASURED", 5.0, 9, "2"), ("d", "MEASURED", 1.0, 9, "2"), ("e", "BLIND", None, 9, "2"))
    found = {r["domain"]: r["outcome"] for r in J.run_diff(j, "2", "1").collect()}
    assert found == {"a": "gone", "b": "same", "c": "moved", "d": "appeared", "e": "silent"}


def test_unreadable_lines_are_counted(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"seq": 1, "metric": "m"}\n\n{"seq": 2, "met\n')
    found = P.read_journal(spark, str(path)).groupBy("unreadable").count().collect()
    assert {r["unreadable"]: r["count"] for r in found} == {False: 1, True: 1}


def test_rank_zip_and_graph_files(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.csv", "﻿Rank,Domain\n1,a.com\n2,\"b,c.com\"\n")
    assert [r["value"] for r in P.read_rank_zip(spark, str(tmp_path / "r.zip")).collect()] == ["Rank,Domain", "1,a.com", '2,"b,c.com"']
    with gzip.open(tmp_path / "vertices.gz", "wt") as f:
        f.write("0\tcom.a\t1\n1\tcom.b\t1\n")
    with gzip.open(tmp_path / "edges.gz", "wt") as f:
        f.write("0\t1\n")
    vertices, edges = P.read_graph(spark, str(tmp_path))
    assert vertices.count() == 2 and edges.first()["dst"] == 1
