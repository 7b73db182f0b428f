"""Selection, carried rows, brackets and claims against loops, with hot keys, far-off values and many ranges."""

import random
import threading
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weftline.operators import relational as R
from weftline.operators import tasks as TM
from weftline.session import SHARED
from weftline.sources.txlog import TransactionTable


def test_a_far_off_value_fills_no_range(spark):
    """One value of 1e15 among 40,000: no range holds over 1 % of the counts, and the medians are those of a sort."""
    df = spark.range(40_000).select(F.when(F.col("id") == 7, 1e15).otherwise(F.rand(3) * 1000).alias("x")).cache()
    values = sorted(r.x for r in df.collect())
    assert R.upper_median(df, "x", parts=200).first()["median"] == values[20_000]
    sizes = [r["count"] for r in spark.read.parquet(SHARED[-1]).groupBy("_range").count().collect()]
    assert len(sizes) > 150 and max(sizes) <= 400
    got = R.median_and_mad(df, "x").first()
    away = sorted(abs(v - values[20_000]) for v in values)
    assert (got["median"], got["mad"]) == (values[20_000], away[20_000])
    df.unpersist()


def test_stride_of_uneven_ids(spark):
    ids = [0, *range(10**9, 10**9 + 500), 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = sorted(r.id for r in R.sample_stride(df, "id", 40).collect())
    assert got == [ids[k * len(ids) // 40] for k in range(40)] and R.sample_stride(df, "id", 10**6).count() == len(ids)


def test_rows_before_are_carried_over(spark):
    """A key with most rows, null keys and null values, over many ranges: the row before, wherever it lies."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, f"k{rng.randrange(30)}"]), rng.randrange(50), i, rng.choice([None, 1, 2])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, t int, s int, v int")
    want, last = {}, {}
    for k, t, s, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[s] = last.get(k)
        last[k] = (s, v)
    for parts in (1, 37):
        got = {r.s: tuple(r.previous) if r.previous else None for r in R.with_previous(df, ["k"], ["t", "s"], ["s", "v"], parts).collect()}
        assert got == want
    hot = Counter(r["_range"] for r in spark.read.parquet(SHARED[-1]).filter("k = 'hot'").collect())
    assert len(hot) > 10  # the hot key lies in many tasks
    assert R.with_previous(df.limit(0), ["k"], ["t", "s"], ["s", "v"]).count() == 0


def search(captures, probes):
    """One page's captures (at, read, present) in order of time."""
    if not captures or probes <= 0:
        return "budget", None, None, 0
    late, early, left = captures[-1], captures[0], probes - 1
    if not late[1]:
        return "unreadable", None, None, 1
    if not late[2]:
        return "absent", None, None, 1
    if early[0] == late[0]:
        return "single", None, late[0], 1
    left -= 1
    if early[1] and early[2]:
        return "before_archive", None, early[0], 2
    lo, hi, sure = 0, len(captures) - 1, early[1]
    while hi - lo > 1 and left > 0:
        mid = (lo + hi) // 2
        left -= 1
        _, read, present = captures[mid]
        if read and present:
            hi = mid
        else:
            lo, sure = mid, sure or read
    return ("coarse" if hi - lo > 1 else "bracketed"), captures[lo][0] if sure else None, captures[hi][0], probes - left


def test_brackets_are_those_of_single_searches(spark):
    """All outcomes; a page with most captures, pages with one, pages without any."""
    rng, rows = random.Random(6), []
    pages = defaultdict(list)
    for k in range(120):
        n = 1500 if k == 0 else rng.choice((1, 2, 3, 9, 40))
        begins = rng.choice((0, n // 2, n - 1, n + 1)) if k else 700
        for i in range(n):
            pages[f"p{k}"].append((10 * i + k % 3, rng.random() < 0.8 or k == 0, i >= begins))
    for p, caps in pages.items():
        rows += [(p, *c) for c in caps]
    rng.shuffle(rows)
    captures = spark.createDataFrame(rows, "page string, at long, read boolean, present boolean")
    targets = spark.createDataFrame([(p,) for p in [*pages, "none"]], "page string")
    seen = set()
    for probes in (8, 16):
        got = {r.page: (r.outcome, r.last_without, r.first_with, r.n_probed) for r in R.bracket_appearance(captures, "page", targets, probes).collect()}
        assert got == {p: search(pages.get(p, []), probes) for p in [*pages, "none"]}
        seen |= {g[0] for g in got.values()}
    assert seen == {"budget", "unreadable", "absent", "single", "before_archive", "coarse", "bracketed"}
    assert {r.outcome for r in R.bracket_appearance(captures, "page", probes=0).collect()} == {"budget"}


def one_by_one(pages, busy, k, low, high):
    """Readers who ask one after the other."""
    taken, hosts = [], set(busy)
    for _ in range(k):
        for a, b in ((low, high), (high + 1, 9)):
            free = [p for p in pages if p[4] == "waiting" and a <= p[2] <= b and p[1] not in hosts]
            if free:
                seq, host, *_ = min(free, key=lambda p: (p[2], p[3], p[0]))
                taken.append(seq)
                hosts.add(host)
                break
    return taken


QUEUE = "seq long, host string, priority int, depth int, state string, taken_at timestamp_ntz"


def made_queue(n=700):
    rng = random.Random(1)
    return [(i, f"h{min(rng.randrange(90), rng.randrange(90))}", rng.randrange(1, 7), rng.randrange(3), rng.choice(("waiting", "waiting", "read")), None) for i in range(n)]


def test_claims_equal_readers_one_by_one(spark):
    pages = made_queue()
    queue, busy = spark.createDataFrame(pages, QUEUE), spark.createDataFrame([(f"h{k}",) for k in range(5)], "host string")
    for k, low, high in ((60, 1, 2), (60, 2, 3), (7, 3, 3), (500, 4, 9)):
        got = [r.seq for r in TM.claim(queue, busy, k, low, high).orderBy("pick").collect()]
        assert got == one_by_one(pages, {f"h{j}" for j in range(5)}, k, low, high)


def test_readers_at_once_never_take_a_page_twice(spark, tmp_path):
    """Three crawlers take at the same time from one stored queue: no page and no host twice."""
    table = lambda: TransactionTable(spark, f"file://{tmp_path}/q", F.pmod(F.xxhash64("host"), F.lit(8)))
    rows = spark.createDataFrame(made_queue(200), QUEUE)
    queue = table()
    queue.commit(queue.snapshot(), "fill", queue.write(rows), schema=rows.schema.json())
    now, got = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), []
    threads = [threading.Thread(target=lambda: got.append(TM.take(table(), now, 8))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = [s for g in got for s in g]
    held = {r.seq: r.host for r in table().read().filter("state = 'busy'").collect()}
    assert len(every) == len(set(every)) == 24 and set(held) == set(every) and len(set(held.values())) == 24
    assert table().read().count() == 200
