"""Streams that are stopped, killed or fail and go on under their name; leases against a plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.streaming import leases as L
from weftline.streaming import runs as S

DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def files(spark, sf_dir, tmp_path):
    """The events in four files, in order of time, of which ``give(n)`` puts the first n into the stream's folder."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect()
    cut = -(-len(rows) // 4)

    def give(*numbers):
        for k in numbers:
            part = spark.createDataFrame(rows[k * cut : (k + 1) * cut], spark.read.parquet(f"{sf_dir}/events.parquet").schema)
            part.coalesce(1).write.parquet(f"{tmp_path}/made{k}")
            made = next((tmp_path / f"made{k}").glob("*.parquet"))
            (tmp_path / "in").mkdir(exist_ok=True)
            made.rename(tmp_path / "in" / f"events{k}.parquet")
            time.sleep(0.02)

    return give, str(tmp_path / "in"), rows


def test_append_goes_on_under_its_name(spark, files, tmp_path):
    """Two files, then two more and the old ones still there: every row once. A third start finds nothing to do."""
    give, folder, rows = files
    name = f"append-{tmp_path.name}"
    give(0, 1)
    read = lambda: S.finish(S.read_events(spark, folder, 1).select("event_id"), name=name)
    assert read().count() == 2 * -(-len(rows) // 4)
    give(2, 3)
    assert sorted(r[0] for r in read().collect()) == sorted(r.event_id for r in rows)
    assert read().count() == len(rows)


def test_a_stopped_query_goes_on(spark, files, tmp_path):
    """A running query is stopped after some batch and started again: the windows are those of one pass."""
    give, folder, rows = files
    give(0, 1, 2, 3)
    home = S.folder_of(spark, f"stopped-{tmp_path.name}")
    stream = lambda: S.windowed(S.read_events(spark, folder, 1), "1 day")
    query = S.start(stream(), home, "complete", once=False)
    deadline = time.time() + 60
    while (query.lastProgress is None or query.lastProgress["batchId"] < 1) and time.time() < deadline:
        time.sleep(0.05)
    query.stop()
    seen = S.result(spark, home, stream().schema, "complete").agg(F.sum("n")).first()[0] or 0
    assert 0 < seen <= len(rows)
    whole = S.finish(stream(), "complete", name=f"stopped-{tmp_path.name}")
    want = {}
    for r in rows:
        want[r.ts.date(), r.event_type] = want.get((r.ts.date(), r.event_type), 0) + 1
    assert {(r.start.date(), r.event_type): r.n for r in whole.collect()} == want


def test_a_failed_batch_is_replayed(spark, files, tmp_path):
    """The third file cannot be read; the query dies in its batch. Once the file is whole the same batch runs again, and each key
    is given once, those of earlier batches not again."""
    give, folder, rows = files
    give(0, 1, 2, 3)
    good = (tmp_path / "in" / "events2.parquet").read_bytes()
    (tmp_path / "in" / "events2.parquet").write_bytes(good[: len(good) // 2])
    (tmp_path / "in" / ".events2.parquet.crc").unlink(missing_ok=True)
    name = f"failed-{tmp_path.name}"
    stream = lambda: S.deduplicated(S.read_events(spark, folder, 1).withColumn("day", F.to_date("ts")), ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")
    with pytest.raises(Exception):
        S.finish(stream(), name=name)
    (tmp_path / "in" / "events2.parquet").write_bytes(good)
    got = [tuple(r) for r in S.finish(stream(), name=name).collect()]
    assert len(got) == len(set(got)) and set(got) == {(r.user_id, r.event_type, r.ts.date()) for r in rows}


def plain_leases(rows, hold, least, strict):
    """By key, in order of (time, kind, id); a report at the time of its own request counts after it."""
    out, state, reports = {}, {}, {(r[0], r[1], r[3]) for r in rows if r[2] == L.DONE}
    for key, id_, kind, at, pause in sorted(rows, key=lambda r: (r[0], r[3], r[2], r[1])):
        holder, until = state.get(key, (None, None))
        if kind == L.DONE:
            if holder == id_:
                state[key] = holder, at + int(max(least, pause) * 1e6)
            continue
        free = until is None or at > until or (at == until and not strict)
        if free:
            state[key] = id_, at + int((max(least, pause) if (key, id_, at) in reports else hold) * 1e6)
        out[key, id_] = free
    return out


def write_requests(spark, rows, path):
    made = spark.createDataFrame(rows, "key long, id long, kind int, at long, pause double")
    made.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def read_requests(spark, path):
    source = spark.readStream.schema("key long, id long, kind int, at long, pause double").option("maxFilesPerTrigger", 1)
    return source.parquet(path).withColumn("ts", F.timestamp_micros("at"))


def made_requests():
    """Requests to 12 hosts, one of them asked in every third; reports of most; times that fall on the borders of leases."""
    rng, rows = random.Random(4), []
    for i in range(900):
        key, at = (0 if i % 3 == 0 else rng.randrange(1, 12)), 1_700_000_000_000_000 + i * rng.choice((1, 2, 5)) * 1_000_000
        rows.append((key, i, L.REQUEST, at, float(key % 4)))
        if rng.random() < 0.7:
            rows.append((key, i, L.DONE, at + rng.randrange(0, 60) * 1_000_000, float(key % 4)))
    return sorted(rows, key=lambda r: r[3])


@pytest.mark.parametrize("terms", [{}, {"hold": 90.0, "strict": True}])
def test_leases_over_batches_and_a_restart(spark, tmp_path, terms):
    """Three batches in order of time, a stop between the first and the others, timers that clear idle keys: the decisions of a loop."""
    rows = made_requests()
    name, path = f"lease-{tmp_path.name}", f"{tmp_path}/in"
    write_requests(spark, rows[:500], path)
    first = L.leased(read_requests(spark, path), name, **terms).count()
    assert first == sum(r[2] == L.REQUEST for r in rows[:500])
    write_requests(spark, rows[500:1000], path)
    write_requests(spark, rows[1000:], path)
    got = {(r.key, r.id): r.granted for r in L.leased(read_requests(spark, path), name, **terms).collect()}
    assert got == plain_leases(rows, terms.get("hold", 60.0), 2.0, terms.get("strict", False))


def test_expiry_and_politeness(spark, tmp_path):
    """A dead holder frees its host after 60 s; a live one 2 s, or the host's longer pause, after its report; reports of others count for nothing."""
    at = lambda s: 1_700_000_000_000_000 + int(s * 1e6)
    rows = [(1, 1, L.REQUEST, at(0), 0.0), (1, 2, L.REQUEST, at(59.9), 0.0), (1, 3, L.REQUEST, at(60), 0.0)]
    rows += [(2, 1, L.REQUEST, at(0), 0.0), (2, 1, L.DONE, at(5), 0.0), (2, 2, L.REQUEST, at(6.9), 0.0), (2, 3, L.REQUEST, at(7), 0.0)]
    rows += [(3, 1, L.REQUEST, at(0), 9.0), (3, 7, L.DONE, at(1), 9.0), (3, 1, L.DONE, at(5), 9.0), (3, 2, L.REQUEST, at(13.9), 9.0), (3, 3, L.REQUEST, at(14), 9.0)]
    write_requests(spark, rows, f"{tmp_path}/in")
    granted = {(r.key, r.id) for r in L.leased(read_requests(spark, f"{tmp_path}/in")).filter("granted").collect()}
    assert granted == {(1, 1), (1, 3), (2, 1), (2, 3), (3, 1), (3, 3)}


def test_idle_keys_have_no_state(spark, tmp_path):
    """Once the watermark is past the end of a lease, its timer takes the state out."""
    path = f"{tmp_path}/in"
    start = 1_700_000_000_000_000
    write_requests(spark, [(k, k, L.REQUEST, start + k, 0.0) for k in range(50)], path)
    write_requests(spark, [(99, 99, L.REQUEST, start + 3_600_000_000, 0.0)], path)
    query = L.start_leases(read_requests(spark, path), S.folder_of(spark, None))
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) > 50 and kept[-1] <= 4
