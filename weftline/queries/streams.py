"""Streaming queries with their batch twins as oracles, and the crawl queue's state queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import relational as R
from weftline.operators import tasks as TM
from weftline.queries.registry import query
from weftline.session import shared_folder
from weftline.sources.txlog import TransactionTable
from weftline.streaming import leases as L
from weftline.streaming import runs as S

c = F.col


@query("stream_append", sql="SELECT event_type, count(*) AS n, CAST(max(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) AS BIGINT) AS oldest_days FROM events GROUP BY event_type")
def stream_append(spark, sf_dir):
    """Every row is taken, however late; age is the reading's date against the event's."""
    rows = S.finish(S.read_events(spark, sf_dir).select("event_type", F.datediff(F.lit("2024-02-01").cast("date"), S.as_utc(c("ts")).cast("date")).cast("long").alias("age")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("age").alias("oldest_days"))


@query("stream_dedup", sql="SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_dedup(spark, sf_dir):
    keyed = S.read_events(spark, sf_dir).withColumn("day", S.as_utc(c("ts")).cast("date"))
    return S.finish(S.deduplicated(keyed, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"))


@query("stream_tumbling_day", sql="SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_day(spark, sf_dir):
    return S.finish(S.windowed(S.read_events(spark, sf_dir), "1 day"), "complete").withColumn("start", S.as_utc(c("start")))


@query("stream_sliding_hour", sql="SELECT CAST(time_bucket(INTERVAL 6 HOUR, ts) - to_hours(k * 6) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events, range(4) t(k) GROUP BY ALL")
def stream_sliding_hour(spark, sf_dir):
    return S.finish(S.windowed(S.read_events(spark, sf_dir), "24 hours", "6 hours"), "complete").withColumn("start", S.as_utc(c("start")))


@query("stream_rate", sql="""WITH d AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL), l AS (SELECT *, lag(n) OVER w AS before, epoch(h) - epoch(lag(h) OVER w) AS s FROM d WINDOW w AS (PARTITION BY event_type ORDER BY h))
 SELECT CAST(h AS TIMESTAMP) AS start, event_type, CASE WHEN s = 3600 THEN round((n - before) / s + 1e-11, 8) END AS rate FROM l""")  # fmt: skip
def stream_rate(spark, sf_dir):
    """Speed of each counter between two publications, from a stream's hourly counts."""
    hourly = S.finish(S.windowed(S.read_events(spark, sf_dir), "1 hour"), "complete")
    w = Window.partitionBy("event_type").orderBy("start")
    seconds = F.unix_timestamp("start") - F.unix_timestamp(F.lag("start").over(w))
    return hourly.select(S.as_utc(c("start")).alias("start"), "event_type", F.when(seconds == 3600, F.round((c("n") - F.lag("n").over(w)) / seconds + F.lit(1e-11), 8)).alias("rate"))


@query("stream_runs_sessions", sql="""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def stream_runs_sessions(spark, sf_dir):
    return S.finish(S.sessions(S.read_events(spark, sf_dir)), "complete").withColumn("start", S.as_utc(c("start")))


def leases_sql(hold: str, free: str) -> str:
    """Requests of each key in order of time: granted while the last lease has run out. A minute of the table is a second."""
    return f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 60 AS t, {hold} * 1000000 AS hold, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 60, event_id) AS i FROM events),
 r AS (SELECT user_id, event_id, i, true AS granted, t + hold AS free_at FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, o.t {free} r.free_at, CASE WHEN o.t {free} r.free_at THEN o.t + o.hold ELSE r.free_at END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
 SELECT user_id, event_id, granted FROM r"""


def requests(spark, sf_dir, done: bool):
    """Each event as a request to its user's host. The reading takes ``value`` seconds, 60 at most, and reports back; that of an
    error never does. Hosts ask for a pause of 0 to 6 seconds."""
    e = S.read_events(spark, sf_dir).select(c("user_id").alias("key"), c("event_id").alias("id"), (c("user_id") % 7).cast("double").alias("pause"), F.expr("unix_micros(ts) div 60").alias("at"), F.when(c("event_type") != "error", F.least(F.greatest(F.floor(F.coalesce("value", F.lit(0.0))), F.lit(0)), F.lit(60))).alias("took"))
    asked, told = F.struct(F.lit(L.REQUEST).alias("kind"), c("at")), F.struct(F.lit(L.DONE).alias("kind"), (c("at") + c("took") * 1000000).alias("at"))
    rows = e.select("key", "id", "pause", F.explode(F.filter(F.array(asked, told) if done else F.array(asked), lambda x: x["at"].isNotNull())).alias("x"))
    return rows.select("key", "id", "pause", "x.kind", "x.at", F.timestamp_micros("x.at").alias("ts"))


@query("state_host_lease", sql=leases_sql("CASE WHEN event_type = 'error' THEN 60 ELSE CAST(least(greatest(floor(coalesce(value, 0)), 0), 60) AS BIGINT) + greatest(2, user_id % 7) END", ">="))
def state_host_lease(spark, sf_dir):
    """One request at a time to a host: a lock of 60 seconds, which the reader's report moves to its pause, the longer of 2
    seconds and what the host asks for."""
    return L.leased(requests(spark, sf_dir, done=True)).select(c("key").alias("user_id"), c("id").alias("event_id"), "granted")


@query("state_task_lease", sql=f"SELECT user_id, count(*) FILTER (granted) AS n_granted, count(*) AS n FROM ({leases_sql('90', '>')}) GROUP BY user_id")
def state_task_lease(spark, sf_dir):
    """A task is taken by whoever comes more than 90 seconds after the last one who got it."""
    rows = L.leased(requests(spark, sf_dir, done=False), hold=90.0, strict=True)
    return rows.groupBy(c("key").alias("user_id")).agg(F.count(F.when(c("granted"), 1)).alias("n_granted"), F.count("*").alias("n"))


STEPS = "CASE WHEN event_type = 'error' THEN 'wall' WHEN event_type = 'view' THEN 'empty' WHEN value > 50 THEN 'read' ELSE 'mention' END"


@query("state_machine", sql=f"""WITH k AS (SELECT user_id AS task, event_id % 7 AS page, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT user_id AS task, event_id % 7 AS page, {STEPS} AS to_state, event_id FROM events WHERE event_id % 7 <> user_id % 7 AND user_id % 5 <> 0),
 f AS (SELECT task, page, arg_min(to_state, event_id) AS state FROM e WHERE event_id % 2 = 0 GROUP BY ALL), g AS (SELECT task, page, arg_min(to_state, event_id) AS state FROM e WHERE event_id % 2 = 1 GROUP BY ALL),
 c AS (SELECT k.task, k.page, coalesce(f.state, g.state, 'waiting') AS state FROM k LEFT JOIN f USING (task, page) LEFT JOIN g USING (task, page)),
 t AS (SELECT task, count(*) FILTER (state = 'waiting') AS w, count(*) FILTER (state <> 'waiting') AS d, count(*) FILTER (state = 'read') AS r FROM c GROUP BY task)
 SELECT task, CASE WHEN d = 0 THEN 'candidates' WHEN w > 0 THEN 'verification' ELSE 'done' END AS state, w AS n_waiting, d AS n_decided, r AS n_read FROM t""")  # fmt: skip
def state_machine(spark, sf_dir):
    """Candidates of each task through two batches of readings: the first reading decides a page, later ones change nothing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("task", c("user_id")).withColumn("page", c("event_id") % 7)
    read = e.filter("page <> task % 7 AND task % 5 <> 0").select("task", "page", c("event_id").alias("seq"), F.when(c("event_type") == "error", 403).otherwise(200).alias("http"), F.when((c("event_type") != "view") & (c("value") > 50), 1).otherwise(0).alias("links"), F.when(c("event_type") != "view", 1).otherwise(0).alias("mentions"))
    now = e.select("task", "page").distinct().withColumn("state", F.lit("waiting"))
    for k in (0, 1):
        now = TM.step(now, read.filter(c("seq") % 2 == k))
    reads = now.groupBy("task").agg(F.count(F.when(c("state") == "read", 1)).alias("n_read"))
    return TM.task_states(e.select("task").distinct(), now).join(reads, "task")


FREE = "waiting AS (SELECT q.* FROM v_queue q WHERE state = 'waiting' AND NOT EXISTS (SELECT 1 FROM v_hosts h WHERE h.host = q.host AND h.busy_until > TIMESTAMP '2024-01-15 00:00:00'))"


@query("state_queue_pick", "v_queue", "v_hosts", sql=f"""WITH {FREE}, b AS (SELECT * FROM waiting WHERE priority BETWEEN 2 AND 3 QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority, depth, seq) = 1),
 f AS (SELECT * FROM waiting WHERE priority > 3 AND host NOT IN (SELECT host FROM b) QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority, depth, seq) = 1), u AS (SELECT 0 AS late, * FROM b UNION ALL SELECT 1, * FROM f)
 SELECT row_number() OVER (ORDER BY late, priority, depth, seq) AS pick, host, priority, depth, seq FROM u ORDER BY pick LIMIT 60""")  # fmt: skip
def state_queue_pick(q, h):
    """The pages of 60 readers of bands 2 and 3, or of less important ones where these give none: never of a more important one,
    never of a busy host, one a host."""
    return TM.claim(q, h.filter("busy_until > TIMESTAMP_NTZ '2024-01-15 00:00:00'"), 60, 2, 3)


@query("state_host_cap", "v_queue", sql="SELECT seq, host FROM v_queue WHERE state = 'waiting' QUALIFY row_number() OVER (PARTITION BY host ORDER BY priority, depth, seq) <= 1500")
def state_host_cap(q):
    return R.first_rows(q.filter("state = 'waiting'").select("seq", "host", "priority", "depth"), "host", [c("priority"), c("depth"), c("seq")], 1500).select("seq", "host")


@query("crash_recovery", "v_queue", sql="SELECT seq, CASE WHEN state = 'busy' AND taken_at < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 MINUTE THEN 'waiting' ELSE state END AS state FROM v_queue")
def crash_recovery(q):
    """The queue on disk after the start of a crawl: pages that a dead reader held for over ten minutes wait again."""
    queue = TransactionTable(q.sparkSession, shared_folder(q.sparkSession, "queue"), F.concat(c("state"), F.lit("-"), c("taken_at").cast("date")))
    rows = q.select("seq", "host", "state", "taken_at")
    queue.commit(queue.snapshot(), "fill", queue.write(rows), schema=rows.schema.json())
    TM.recover(queue, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return queue.read().select("seq", "state")


@query("cache_ttl", "v_hosts", sql="SELECT host, last_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR AS fresh FROM v_hosts")
def cache_ttl(h):
    return h.select("host", (c("last_at") >= F.expr("TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL 24 HOURS")).alias("fresh"))


@query("freshness_gate", "v_journal", sql="SELECT seq, CASE WHEN measured_at < TIMESTAMP '2024-01-29 22:00:00' THEN NULL ELSE value END AS value, CASE WHEN measured_at < TIMESTAMP '2024-01-29 22:00:00' THEN 'BLIND' ELSE state END AS state FROM v_journal")
def freshness_gate(j):
    """Counters older than two hours are shown as blind."""
    stale = c("measured_at") < F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL 2 HOURS")
    return j.select("seq", F.when(~stale, c("value")).alias("value"), F.when(stale, "BLIND").otherwise(c("state")).alias("state"))
