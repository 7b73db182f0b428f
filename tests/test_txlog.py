"""The transaction log: writers that cross, versions, pruning by day, files of dead writers."""

import threading

import pytest
from pyspark.sql import functions as F

from weftline.operators import journal as J
from weftline.operators import tasks as TM
from weftline.sources.store import JournalStore
from weftline.sources.txlog import Conflict, TransactionTable

DDL = "seq long, domain string, metric string, source string, state string, value double, obs_id string, measured_at timestamp_ntz"


def facts(spark, *rows):
    """Rows from (seq, value, day) tuples."""
    made = spark.createDataFrame([(s, "a", "m", "s", "MEASURED", v, f"o{s % 3}", d) for s, v, d in rows], "seq long, domain string, metric string, source string, state string, value double, obs_id string, d string")
    return made.withColumn("measured_at", F.col("d").cast("timestamp_ntz")).drop("d")


def seqs(store, *a):
    return sorted(r.seq for r in store.read(*a).collect())


def test_two_writers_from_one_version(spark, tmp_path):
    """Both have read version 0 and add the same fact; the second is overtaken, works anew and adds only what is new then."""
    path = f"file://{tmp_path}/j"
    one, runs = JournalStore(spark, path), []
    one.append(facts(spark, (1, 1.0, "2024-01-01")))

    def overtake():
        if not runs:
            runs.append(one.append(facts(spark, (2, 2.0, "2024-01-01"))))

    two = JournalStore(spark, path, overtake)
    version = two.append(facts(spark, (3, 2.0, "2024-01-01"), (4, 4.0, "2024-01-01")))
    assert runs == [1] and version == 2 and seqs(one) == [1, 2, 4]
    live = {f.rsplit("/", 1)[0] for f in one.table.snapshot().files}
    assert {str(p.relative_to(tmp_path / "j")) for p in (tmp_path / "j" / "data").glob("*/_part=*")} == live  # the first try left no files


def test_writers_of_other_days_do_not_wait(spark, tmp_path):
    path, tries = f"file://{tmp_path}/j", []
    one = JournalStore(spark, path)
    one.append(facts(spark, (1, 1.0, "2024-01-01")))

    def overtake():
        tries.append(1)
        if len(tries) == 1:
            one.append(facts(spark, (2, 2.0, "2024-01-02")))

    assert JournalStore(spark, path, overtake).append(facts(spark, (3, 3.0, "2024-01-03"))) == 2
    assert len(tries) == 1 and seqs(one) == [1, 2, 3]


def test_compaction_keeps_what_others_append(spark, tmp_path):
    path, tries = f"file://{tmp_path}/j", []
    one = JournalStore(spark, path)
    one.append(facts(spark, (1, 1.0, "2024-01-01"), (4, 2.0, "2024-01-01")))

    def overtake():
        tries.append(1)
        if len(tries) == 1:
            one.append(facts(spark, (7, 3.0, "2024-01-01")))

    JournalStore(spark, path, overtake).compact()
    assert len(tries) == 1 and seqs(one) == [4, 7] and seqs(one, 0) == [1, 4]
    assert [r.kind for r in one.table.history().orderBy("version").collect()] == ["append", "append", "compact"]


def test_two_compactions_do_not_double_rows(spark, tmp_path):
    path, tries = f"file://{tmp_path}/j", []
    one = JournalStore(spark, path)
    one.append(facts(spark, (1, 1.0, "2024-01-01"), (4, 2.0, "2024-01-01"), (2, 5.0, "2024-01-02")))

    def overtake():
        tries.append(1)
        if len(tries) == 1:
            one.compact()

    JournalStore(spark, path, overtake).compact()
    assert len(tries) == 2 and seqs(one) == [2, 4]


def test_many_threads_append(spark, tmp_path):
    """Six writers at once, each with a fact of its own and one that all have: seven rows, and six commits or fewer."""
    path = f"file://{tmp_path}/j"
    JournalStore(spark, path).append(facts(spark, (0, 0.0, "2024-01-01")))
    threads = [threading.Thread(target=JournalStore(spark, path).append, args=(facts(spark, (k, float(k), "2024-01-01"), (k + 100, 99.0, "2024-01-01")),)) for k in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = seqs(JournalStore(spark, path))
    assert got[:7] == list(range(7)) and len(got) == 8 and got[7] > 100


def test_appends_read_their_days_alone(spark, tmp_path):
    store = JournalStore(spark, f"file://{tmp_path}/j")
    store.append(facts(spark, *((k, float(k), f"2024-01-{k:02d}") for k in range(1, 21))))
    files = store.table.read(store.table.snapshot(), {"2024-01-07"}).inputFiles()
    assert len(files) == 1 and "2024-01-07" in files[0]


def test_purge_writes_only_the_days_it_must(spark, tmp_path):
    store = JournalStore(spark, f"file://{tmp_path}/j")
    store.append(facts(spark, *((k, float(k), f"2024-01-{k:02d}") for k in range(1, 11))))
    before = store.table.snapshot().files
    done = store.purge(F.col("value") == 3, "wrong")
    after = store.table.snapshot().files
    assert seqs(store) == [1, 2, 4, 5, 6, 7, 8, 9, 10] and set(before) - set(after) == {f for f, d in before.items() if d == "2024-01-03"} and not set(after) - set(before)
    assert done["removed"] == 1 and seqs(store, done["version"]) == list(range(1, 11)) and store.table.history().filter("kind = 'purge'").first().reason == "wrong"


def test_versions_checkpoints_and_vacuum(spark, tmp_path):
    table = TransactionTable(spark, f"file://{tmp_path}/t", F.lit("p"))
    rows = spark.range(1)
    for k in range(23):
        base = table.snapshot()
        table.commit(base, "replace", table.write(rows.select((F.col("id") + k).alias("id"))), base.files, schema=rows.schema.json())
    assert (tmp_path / "t" / "_log" / f"{20:020d}.checkpoint").exists()
    assert table.read().first().id == 22 and table.read(table.snapshot(5)).first().id == 5 and len(table.snapshot().files) == 1
    assert table.vacuum(keep=2) == 21 and table.read().first().id == 22 and table.read(table.snapshot(21)).first().id == 21


def test_a_dead_writer_leaves_nothing_visible(spark, tmp_path):
    store = JournalStore(spark, f"file://{tmp_path}/j")
    store.append(facts(spark, (1, 1.0, "2024-01-01")))

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        JournalStore(spark, store.path, die).append(facts(spark, (2, 2.0, "2024-01-01")))
    assert seqs(store) == [1] and store.append(facts(spark, (2, 2.0, "2024-01-01"))) == 1 and seqs(store) == [1, 2]


def test_a_commit_number_is_taken_once(spark, tmp_path):
    table = TransactionTable(spark, f"file://{tmp_path}/t", F.lit("p"))
    rows = spark.range(1)
    base = table.snapshot()
    table.commit(base, "first", table.write(rows), schema=rows.schema.json())
    with pytest.raises(Conflict):
        table.commit(base, "first too", table.write(rows), schema=rows.schema.json())
    assert table.read().count() == 1


def test_content_is_exact(spark):
    rows = facts(spark, (1, 0.00001, "2024-01-01"), (2, 0.00002, "2024-01-01"), (3, 1234567.25, "2024-01-01"), (4, 1234567.25, "2024-01-01"))
    assert sorted(r.seq for r in J.new_facts(rows.limit(0), rows).collect()) == [1, 2, 3]


def test_recovery_returns_stale_pages_once(spark, tmp_path):
    queue = TransactionTable(spark, f"file://{tmp_path}/q", F.col("state"))
    rows = spark.createDataFrame([(1, "busy", "2024-01-01 11:49:59"), (2, "busy", "2024-01-01 11:50:00"), (3, "read", "2024-01-01 09:00:00"), (4, "waiting", None)], "seq long, state string, taken_at string").withColumn("taken_at", F.col("taken_at").cast("timestamp_ntz"))
    queue.commit(queue.snapshot(), "fill", queue.write(rows), schema=rows.schema.json())
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert TM.recover(queue, now) == 1 and TM.recover(queue, now) is None
    assert {r.seq: r.state for r in queue.read().collect()} == {1: "waiting", 2: "busy", 3: "read", 4: "waiting"}
