"""Journal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import journal as J
from weftline.queries.registry import query
from weftline.session import shared_folder
from weftline.sources.store import JournalStore

LATEST = "SELECT * FROM v_journal QUALIFY row_number() OVER (PARTITION BY domain, metric, source ORDER BY measured_at DESC, seq DESC) = 1"
COLUMNS = "domain, metric, source, state, value, measured_at, seq"


@query("latest_snapshot", "v_journal", sql=f"SELECT {COLUMNS} FROM ({LATEST})")
def latest_snapshot(j):
    return J.latest(j).selectExpr(*COLUMNS.split(", "))


@query("latest_snapshot_first_wins", "v_journal", sql=f"SELECT {COLUMNS} FROM v_journal QUALIFY row_number() OVER (PARTITION BY domain, metric, source ORDER BY measured_at DESC, seq) = 1")
def latest_snapshot_first_wins(j):
    return J.latest(j, last_wins=False).selectExpr(*COLUMNS.split(", "))


@query("snapshot_state_counts", "v_journal", sql=f"SELECT kind, state, count(*) AS n FROM ({LATEST}) GROUP BY ALL")
def snapshot_state_counts(j):
    return J.latest(j).groupBy("kind", "state").agg(F.count("*").alias("n"))


KEY = "concat_ws('|', domain, metric, source, CAST(CAST(measured_at AS DATE) AS VARCHAR), state, coalesce(CAST(value AS VARCHAR), 'null'))"


@query(
    "write_idempotent", "v_journal",
    sql=f"""WITH b AS (SELECT *, {KEY} AS key FROM (SELECT * FROM v_journal UNION ALL SELECT * REPLACE (seq + 10000000 AS seq) FROM v_journal WHERE seq % 5 = 0)),
    old AS (SELECT * FROM b WHERE seq % 3 = 0 AND seq < 10000000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1)
    SELECT seq, domain, metric, state, value FROM old UNION ALL SELECT seq, domain, metric, state, value FROM (SELECT * FROM b WHERE seq % 3 <> 0 OR seq >= 10000000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1) WHERE key NOT IN (SELECT key FROM old)""",
)
def write_idempotent(j):
    """What the journal holds after a first batch, a second one that repeats part of it, and the second once more, each in a
    commit of its own."""
    store = JournalStore(j.sparkSession, shared_folder(j.sparkSession, "journal"))
    again = j.filter("seq % 5 = 0").withColumn("seq", F.col("seq") + 10000000)
    second = j.filter("seq % 3 <> 0").unionByName(again)
    for batch in (j.filter("seq % 3 = 0"), second, second):
        store.append(batch)
    return store.read().select("seq", "domain", "metric", "state", "value")


@query("compact", "v_journal", sql="SELECT obs_id, seq, value FROM (SELECT *, CASE WHEN seq % 50 <> 0 THEN domain || metric END AS obs_id FROM v_journal) QUALIFY obs_id IS NULL OR row_number() OVER (PARTITION BY obs_id ORDER BY seq DESC) = 1")
def compact(j):
    """The journal on disk after its compaction, which one commit makes visible."""
    store = JournalStore(j.sparkSession, shared_folder(j.sparkSession, "journal"))
    store.append(j.withColumn("obs_id", F.when(F.col("seq") % 50 != 0, F.concat("domain", "metric"))), allow_repeats=True)
    store.compact()
    return store.read().select("obs_id", "seq", "value")


@query("purge", "v_journal", sql="SELECT kind, count(*) FILTER (NOT coalesce(value > 50, false)) AS kept, count(*) AS backed_up, 'wrong extraction' AS reason FROM v_journal GROUP BY kind")
def purge(j):
    """Rows taken out of the journal on disk; the version before still holds all there were, and the reason is kept."""
    store = JournalStore(j.sparkSession, shared_folder(j.sparkSession, "journal"))
    store.append(j, allow_repeats=True)
    done = store.purge(F.col("value") > 50, "wrong extraction")
    count = lambda rows, name: rows.groupBy("kind").agg(F.count("*").alias(name))
    both = count(store.read(done["version"]), "backed_up").join(count(store.read(), "kept"), "kind", "left")
    return both.select("kind", F.coalesce("kept", F.lit(0)).alias("kept"), "backed_up", F.lit(done["reason"]).alias("reason"))


@query("filter_path", "v_journal", sql="SELECT seq, measured_at, value FROM v_journal WHERE domain = 'u7' AND metric = 'click'")
def filter_path(j):
    return J.series(j, domain="u7", metric="click").select("seq", "measured_at", "value")


@query("filter_state", "v_journal", sql="SELECT kind, count(*) FILTER (state = 'MEASURED') AS n_measured, count(*) FILTER (state = 'BLIND') AS n_blind, avg(CASE WHEN state = 'MEASURED' THEN round(value, 2) END) AS mean FROM v_journal GROUP BY kind")
def filter_state(j):
    return j.groupBy("kind").agg(F.count(F.when(F.col("state") == "MEASURED", 1)).alias("n_measured"), F.count(F.when(F.col("state") == "BLIND", 1)).alias("n_blind"), F.avg(F.when(F.col("state") == "MEASURED", F.round("value", 2))).alias("mean"))


@query("journal_invariants", "v_journal", sql="SELECT 'blind_with_value' AS rule, count(*) FILTER (state = 'BLIND' AND value IS NOT NULL) AS broken, count(*) AS n FROM v_journal")
def journal_invariants(j):
    broken = (F.col("state") == "BLIND") & F.col("value").isNotNull()
    return j.agg(F.lit("blind_with_value").alias("rule"), F.count(F.when(broken, 1)).alias("broken"), F.count("*").alias("n"))


SINCE = "TIMESTAMP '2024-01-20 00:00:00'"


@query(
    "movements", "v_journal",
    sql=f"""WITH b AS (SELECT * FROM v_journal WHERE measured_at < {SINCE} QUALIFY row_number() OVER (PARTITION BY domain, metric, source ORDER BY measured_at DESC, seq DESC) = 1),
    a AS (SELECT * FROM v_journal WHERE measured_at >= {SINCE} QUALIFY row_number() OVER (PARTITION BY domain, metric, source ORDER BY measured_at DESC, seq DESC) = 1)
    SELECT a.domain, a.metric, a.source, CASE WHEN b.seq IS NULL THEN 'appeared' ELSE 'changed' END AS movement, b.value AS before, a.value AS after, b.state AS state_before, a.state AS state_after, a.value - b.value AS delta
    FROM a LEFT JOIN b USING (domain, metric, source) WHERE b.seq IS NULL OR a.value IS DISTINCT FROM b.value OR a.state <> b.state""",
)
def movements(j):
    return J.movements(j, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("runs", "v_journal", sql="SELECT run_id AS run, max(measured_at) AS ended_at, count(*) AS n_rows, row_number() OVER (ORDER BY max(measured_at) DESC, run_id DESC) AS place FROM v_journal GROUP BY run_id")
def runs(j):
    return J.runs(j)


@query("previous_run_window", "v_journal", sql="WITH r AS (SELECT run_id, max(measured_at) AS ended_at FROM v_journal GROUP BY run_id), p AS (SELECT ended_at AS threshold FROM r ORDER BY ended_at DESC LIMIT 1 OFFSET 1) SELECT p.threshold, count(*) AS n_since FROM v_journal, p WHERE measured_at >= p.threshold GROUP BY p.threshold")
def previous_run_window(j):
    threshold = J.last_runs(j, 2).filter("place = 2").select(F.col("ended_at").alias("threshold"))
    return j.join(F.broadcast(threshold), F.col("measured_at") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n_since"))


@query(
    "run_diff", "v_journal",
    sql="""WITH r AS (SELECT run_id, row_number() OVER (ORDER BY max(measured_at) DESC, run_id DESC) AS place FROM v_journal GROUP BY run_id), l AS (SELECT j.*, place FROM v_journal j JOIN r USING (run_id) WHERE place <= 2),
    o AS (SELECT domain, max(value) AS old, true AS in_old FROM l WHERE place = 2 AND state <> 'BLIND' GROUP BY domain), n AS (SELECT domain, max(value) AS new, true AS in_new FROM l WHERE place = 1 AND state <> 'BLIND' GROUP BY domain),
    b AS (SELECT DISTINCT domain, true AS is_blind FROM l WHERE place = 1 AND state = 'BLIND'),
    t AS (SELECT greatest(count(DISTINCT domain) FILTER (place = 2), count(DISTINCT domain) FILTER (place = 1)) >= 500 AS truncated FROM l WHERE state = 'MEASURED')
    SELECT domain, old, new, CASE WHEN in_old IS NULL THEN 'appeared' WHEN in_new IS NULL AND is_blind THEN 'silent' WHEN in_new IS NULL THEN 'gone' WHEN old IS NOT DISTINCT FROM new THEN 'same' ELSE 'moved' END AS outcome, truncated
    FROM o FULL JOIN n USING (domain) LEFT JOIN b USING (domain), t""",
)
def run_diff(j):
    """The last run against the one before."""
    return J.run_diff(j)


@query(
    "run_states", "v_domains", "v_journal",
    sql="""WITH t AS (SELECT 'u' || id AS domain FROM v_domains), r AS (SELECT domain, run_id, max(measured_at) AS ended_at, count(*) AS n, row_number() OVER (PARTITION BY domain ORDER BY max(measured_at) DESC, run_id DESC) AS place FROM v_journal GROUP BY domain, run_id),
    w AS (SELECT domain, state FROM v_journal WHERE metric = 'error' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY measured_at DESC, seq DESC) = 1)
    SELECT t.domain, CASE WHEN a.run_id IS NULL THEN 'never' WHEN b.run_id IS NULL THEN 'first' WHEN w.state = 'BLIND' THEN 'silent' ELSE 'compared' END AS state, a.run_id AS last, b.run_id AS before, coalesce(a.n, 0) AS n
    FROM t LEFT JOIN r a ON a.domain = t.domain AND a.place = 1 LEFT JOIN r b ON b.domain = t.domain AND b.place = 2 LEFT JOIN w ON w.domain = t.domain""",
)
def run_states(d, j):
    """Which domains' last two runs can be compared; the errors stand for the total of a run."""
    return J.run_states(d.select(F.concat(F.lit("u"), "id").alias("domain")), j, F.col("metric") == "error")


@query(
    "series_delta", "v_journal",
    sql="""SELECT domain, metric, source, seq, measured_at, value, CASE WHEN state = 'MEASURED' AND lag(state) OVER w = 'MEASURED' THEN value - lag(value) OVER w END AS delta, coalesce(lag(collector) OVER w <> collector, false) AS collector_changed
    FROM v_journal WINDOW w AS (PARTITION BY domain, metric, source ORDER BY measured_at, seq)""",
)
def series_delta(j):
    return J.series_delta(j)


@query("dedup_collisions", "v_journal", sql="SELECT obs_id, count(DISTINCT state) AS n_contents FROM (SELECT domain || '|' || metric AS obs_id, state FROM v_journal) GROUP BY obs_id HAVING count(DISTINCT state) > 1")
def dedup_collisions(j):
    return J.collisions(j.withColumn("obs_id", F.concat_ws("|", "domain", "metric")), content="state")


@query("fingerprint", "v_journal", sql="SELECT seq, substring(sha1(concat_ws('|', domain, metric, source, coalesce(CAST(k AS VARCHAR), ''), CAST(CAST(measured_at AS DATE) AS VARCHAR))), 1, 16) AS obs_id FROM v_journal")
def fingerprint(j):
    return j.select("seq", J.fingerprint(F.col("domain"), F.col("metric"), F.col("source"), F.col("k"), F.col("measured_at").cast("date")).alias("obs_id"))


@query("freshness_days", "v_journal", sql="SELECT seq, CAST(floor((epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(measured_at)) / 86400 + 0.5) AS BIGINT) AS freshness_days FROM v_journal")
def freshness_days(j):
    seconds = F.timestamp_diff("SECOND", F.col("measured_at"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return j.select("seq", F.floor(seconds / 86400 + 0.5).cast("long").alias("freshness_days"))


@query("ext_rollup_state_kind", "v_journal", sql="SELECT kind, state, count(*) AS n FROM v_journal GROUP BY ROLLUP (kind, state)")
def ext_rollup_state_kind(j):
    """Extension: not in the reference."""
    return j.rollup("kind", "state").agg(F.count("*").alias("n"))


@query("ext_moving_average", "v_journal", sql="SELECT domain, seq, round(avg(value) OVER (PARTITION BY domain ORDER BY measured_at, seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7 FROM v_journal")
def ext_moving_average(j):
    """Extension: not in the reference."""
    from pyspark.sql import Window

    w = Window.partitionBy("domain").orderBy("measured_at", "seq").rowsBetween(-6, 0)
    return j.select("domain", "seq", F.round(F.avg("value").over(w), 6).alias("mean7"))
