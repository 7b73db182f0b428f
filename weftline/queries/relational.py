"""Filters, joins, aggregations, rankings and set operations over the link index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.functions.tristate import js_round
from weftline.operators import relational as R
from weftline.queries.registry import query
from weftline.session import table

def follow():
    return F.col("rel") == "dofollow"


# -- filters -------------------------------------------------------------------------------------
@query("filter_pool", "v_positions", sql="SELECT CASE WHEN CAST(substring(query, 2) AS BIGINT) < 25 THEN 'pool' ELSE 'outside' END AS side, count(*) AS n FROM v_positions GROUP BY ALL")
def filter_pool(p):
    pool = p.select(F.upper("query").alias("query")).distinct().filter("CAST(substring(query, 2) AS BIGINT) < 25").select(F.lower("query").alias("key"))
    keyed = p.withColumn("key", F.lower("query"))
    inside, rest = keyed.join(pool, "key", "left_semi"), keyed.join(pool, "key", "left_anti")
    return inside.agg(F.lit("pool").alias("side"), F.count("*").alias("n")).union(rest.agg(F.lit("outside"), F.count("*")))


@query("filter_rel", "v_links", sql="SELECT target, count(*) FILTER (rel = 'dofollow') AS n_follow, count(*) FILTER (rel <> 'dofollow') AS n_nofollow FROM v_links GROUP BY target")
def filter_rel(l):
    return l.groupBy("target").agg(F.count(F.when(follow(), 1)).alias("n_follow"), F.count(F.when(~follow(), 1)).alias("n_nofollow"))


RAW_DOMAIN = "CASE id % 6 WHEN 0 THEN 'https://www.c' || id || '.com/a?b' WHEN 1 THEN ' C' || id || '.Org:8080 ' WHEN 2 THEN '10.0.0.' || (id % 200) WHEN 3 THEN 'user@c' || id || '.net/x' WHEN 4 THEN 'c' || id || '.local' ELSE 'c' || id END"


@query("filter_domain_valid", "v_domains", sql="SELECT id, CASE id % 6 WHEN 0 THEN 'c' || id || '.com' WHEN 1 THEN 'c' || id || '.org' WHEN 3 THEN 'c' || id || '.net' END AS valid FROM v_domains")
def filter_domain_valid(d):
    return d.select("id", U.valid_domain(F.expr(RAW_DOMAIN)).alias("valid"))


@query("same_site", "v_domains", sql="SELECT id, id % 3 <> 2 AS same FROM v_domains")
def same_site(d):
    other = F.when(F.col("id") % 3 == 0, F.col("domain")).when(F.col("id") % 3 == 1, F.concat(F.lit("www."), "domain")).otherwise(F.concat(F.lit("x"), "domain"))
    return d.select("id", U.same_site(F.col("domain"), other).alias("same"))


@query("true_destination", "v_links", sql="SELECT n % 4 AS kind, n % 4 <> 3 AS counts, count(*) AS n FROM (SELECT CAST(substring(target, 2) AS BIGINT) AS n FROM v_links) GROUP BY ALL")
def true_destination(l):
    n = F.substring("target", 2, 9).cast("long")
    target = F.concat(F.lit("brand"), n, F.lit(".com"))
    url = (
        F.when(n % 4 == 0, F.concat(F.lit("https://www."), target, F.lit("/x")))
        .when(n % 4 == 1, F.concat(F.lit("https://go.net/out/"), target))
        .when(n % 4 == 2, F.concat(F.lit("https://go.net/visit-brand"), n))
        .otherwise(F.concat(F.lit("https://go.net/?u="), target))
    )
    return l.select((n % 4).alias("kind"), U.true_destination(url, target).alias("counts")).groupBy("kind", "counts").agg(F.count("*").alias("n"))


@query("dead_extension", "v_queue", sql="SELECT seq % 3 = 0 AS dead, count(*) AS n FROM v_queue GROUP BY ALL")
def dead_extension(q):
    url = F.concat(F.lit("https://a.com/x"), "seq", F.when(F.col("seq") % 3 == 0, ".PDF?v=1").when(F.col("seq") % 3 == 1, ".html").otherwise("?f=a.pdf"))
    return q.select(U.dead_extension(url).alias("dead")).groupBy("dead").agg(F.count("*").alias("n"))


@query("exclude_hosts", "v_links", sql="SELECT src_domain || '.blog.org' AS host, count(*) AS n FROM v_links WHERE CAST(substring(src_domain, 2) AS BIGINT) % 4 <> 0 GROUP BY ALL")
def exclude_hosts(l):
    hosts = l.select(F.concat("src_domain", F.lit(".blog.org")).alias("host"))
    denied = l.filter("CAST(substring(src_domain, 2) AS BIGINT) % 4 = 0").select(F.concat("src_domain", F.lit(".blog.org")).alias("denied")).distinct()
    return R.not_below(hosts, "host", denied, "denied").groupBy("host").agg(F.count("*").alias("n"))


@query("anti_bot_wall", "v_queue", sql="SELECT CASE seq % 6 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'accepted_empty' WHEN 2 THEN 'interstitial' WHEN 3 THEN 'forbidden' ELSE 'open' END AS wall, count(*) AS n FROM v_queue GROUP BY ALL")
def anti_bot_wall(q):
    http = F.when(F.col("seq") % 6 == 0, 429).when(F.col("seq") % 6 == 1, 202).when(F.col("seq") % 6 == 3, 403).otherwise(200)
    body = F.when(F.col("seq") % 6 == 2, "Just a moment...").otherwise("hello")
    wall = F.when(http == 429, "rate_limited").when(http == 202, "accepted_empty").when(body.rlike("(?i)just a moment|verify you are human"), "interstitial").when(http == 403, "forbidden").otherwise("open")
    return q.select(wall.alias("wall")).groupBy("wall").agg(F.count("*").alias("n"))


# -- joins ---------------------------------------------------------------------------------------
@query("join_sessions", sql="SELECT o_orderkey AS session, c_name AS account FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def join_sessions(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("session"), F.col("c_name").alias("account"))


@query("join_stale_targets", "v_domains", "v_positions", sql="SELECT d.domain, m.last_at FROM v_domains d LEFT JOIN (SELECT domain, max(measured_at) AS last_at FROM v_positions GROUP BY domain) m USING (domain) WHERE last_at IS NULL OR last_at < (SELECT max(measured_at) FROM v_positions) - INTERVAL 90 DAY")
def join_stale_targets(d, p):
    last = p.groupBy("domain").agg(F.max("measured_at").alias("last_at"))
    now = p.agg((F.max("measured_at") - F.expr("INTERVAL 90 DAYS")).alias("bound"))
    return d.select("domain").join(last, "domain", "left").join(F.broadcast(now)).filter("last_at IS NULL OR last_at < bound").select("domain", "last_at")


@query("requeue_stale", "v_hosts", sql="SELECT host FROM v_hosts WHERE last_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY")
def requeue_stale(h):
    return h.filter("last_at < TIMESTAMP_NTZ '2024-01-30 12:00:00' - INTERVAL 1 DAY").select("host")


@query("join_cocited_pages", "v_links", sql="SELECT DISTINCT b2.target AS other, b1.src_domain FROM v_links b1 JOIN v_links b2 ON b1.src_domain = b2.src_domain AND b2.target <> b1.target WHERE b1.target = 't5'")
def join_cocited_pages(l):
    pairs = l.select("target", "src_domain").distinct()
    mine = pairs.filter("target = 't5'").select("src_domain")
    return pairs.filter("target <> 't5'").join(mine, "src_domain").select(F.col("target").alias("other"), "src_domain")


@query("anti_not_confirmed", "v_referents", "v_links", sql="SELECT DISTINCT target, src_domain FROM v_referents r WHERE NOT EXISTS (SELECT 1 FROM v_links l WHERE l.status = 'F' AND l.target = r.target AND l.src_domain = r.src_domain)")
def anti_not_confirmed(r, l):
    return r.select("target", "src_domain").distinct().join(l.filter("status = 'F'").select("target", "src_domain"), ["target", "src_domain"], "left_anti")


@query("anti_busy_host", "v_queue", "v_hosts", sql="SELECT seq, host FROM v_queue q WHERE state = 'waiting' AND NOT EXISTS (SELECT 1 FROM v_hosts h WHERE h.host = q.host AND h.busy_until > TIMESTAMP '2024-01-15 00:00:00')")
def anti_busy_host(q, h):
    busy = h.filter("busy_until > TIMESTAMP_NTZ '2024-01-15 00:00:00'").select("host")
    return q.filter("state = 'waiting'").join(busy, "host", "left_anti").select("seq", "host")


@query("anti_qualified", "v_referents", "v_links", sql="SELECT DISTINCT src_domain FROM v_referents EXCEPT SELECT src_domain FROM v_links WHERE link_score > 98 AND target = 't1'")
def anti_qualified(r, l):
    return r.select("src_domain").distinct().join(l.filter("link_score > 98 AND target = 't1'").select("src_domain"), "src_domain", "left_anti")


@query("join_rank_tables", "v_ranks", sql="SELECT domain, rank_a, rank_b, CASE WHEN rank_b IS NOT NULL THEN 'MEASURED' WHEN asked THEN 'ABSENT' ELSE 'BLIND' END AS state_b FROM v_ranks")
def join_rank_tables(r):
    found = r.filter("rank_b IS NOT NULL").select("domain", "rank_b")
    return R.three_state_join(r.select("domain", "rank_a", "asked"), found, "domain", "rank_b").withColumnRenamed("state", "state_b")


PIVOT = ", ".join(f"arg_max(value, seq) FILTER (metric = '{m}' AND state = 'MEASURED') AS {m}" for m in ("click", "view", "purchase"))


@query("join_issuer_inputs", "v_journal", sql=f"SELECT domain, {PIVOT} FROM v_journal GROUP BY domain")
def join_issuer_inputs(j):
    """The latest value of each metric as a column, in one aggregation."""
    last = lambda m: F.max(F.when((F.col("metric") == m) & (F.col("state") == "MEASURED"), F.struct("seq", "value")))["value"].alias(m)
    return j.groupBy("domain").agg(*map(last, ("click", "view", "purchase")))


@query("join_domain_context", "v_journal", sql="SELECT domain, count(*) AS n_rows, count(DISTINCT source) AS n_sources, max(measured_at) AS last_at, sum(CASE WHEN state = 'BLIND' THEN 1 ELSE 0 END)::BIGINT AS n_blind FROM v_journal GROUP BY domain")
def join_domain_context(j):
    return j.groupBy("domain").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.max("measured_at").alias("last_at"), F.sum(F.when(F.col("state") == "BLIND", 1).otherwise(0)).alias("n_blind"))


@query("join_volume", "v_positions", sql="SELECT seq, p.query, CASE WHEN CAST(substring(p.query, 2) AS BIGINT) % 4 <> 0 THEN CAST(substring(p.query, 2) AS BIGINT) * 100 END AS volume, CAST(substring(p.query, 2) AS BIGINT) % 4 = 0 AS missing FROM v_positions p")
def join_volume(p):
    volumes = p.select("query").distinct().withColumn("n", F.substring("query", 2, 9).cast("long")).filter("n % 4 <> 0").select("query", (F.col("n") * 100).alias("volume"))
    return p.join(volumes, "query", "left").select("seq", "query", "volume", F.col("volume").isNull().alias("missing"))


@query("match_suffix_domain", "v_positions", sql="SELECT query, min(position)::BIGINT AS rank FROM v_positions WHERE CAST(substring(domain, 2) AS BIGINT) % 10 = 3 AND position IS NOT NULL GROUP BY query")
def match_suffix_domain(p):
    results = p.filter("position IS NOT NULL").select("query", "position", F.concat(F.lit("shop."), "domain", F.lit(".com")).alias("host"))
    tracked = p.select("domain").distinct().filter("CAST(substring(domain, 2) AS BIGINT) % 10 = 3").select(F.concat("domain", F.lit(".com")).alias("tracked"))
    return R.suffix_join(results, "host", tracked, "tracked").groupBy("query").agg(F.min("position").cast("long").alias("rank"))


@query("first_seen", "v_links", sql="""WITH u AS (SELECT url_src, min(seen_at) AS url_at FROM v_links WHERE link_score > 90 GROUP BY url_src), d AS (SELECT src_domain, min(seen_at) AS dom_at FROM v_links GROUP BY src_domain)
    SELECT DISTINCT l.url_src, coalesce(url_at, dom_at) AS first_at, CASE WHEN url_at IS NULL THEN 'domain' ELSE 'page' END AS grain FROM v_links l LEFT JOIN u USING (url_src) LEFT JOIN d USING (src_domain)""")  # fmt: skip
def first_seen(l):
    page = l.filter("link_score > 90").groupBy("url_src").agg(F.min("seen_at").alias("url_at"))
    domain = l.groupBy("src_domain").agg(F.min("seen_at").alias("dom_at"))
    both = l.select("url_src", "src_domain").distinct().join(page, "url_src", "left").join(domain, "src_domain", "left")
    return both.select("url_src", F.coalesce("url_at", "dom_at").alias("first_at"), F.when(F.col("url_at").isNull(), "domain").otherwise("page").alias("grain"))


CAPTURES = """c AS (SELECT target, seen_at AS d, CAST(substring(target, 2) AS BIGINT) AS k, count(*) AS m FROM v_links GROUP BY target, seen_at),
 x AS MATERIALIZED (SELECT target, d, k % 10 <> 9 AND (m + day(d)) % 7 <> 0 AS read, d >= DATE '1992-01-01' + CAST(k * 13 % 2600 AS INTEGER) AS present, row_number() OVER (PARTITION BY target ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM c)"""


@query("bracket_appearance", "v_links", sql=f"""WITH RECURSIVE {CAPTURES},
 s AS (SELECT a.target, CASE WHEN NOT z.read THEN 'unreadable' WHEN NOT z.present THEN 'absent' WHEN a.n = 1 THEN 'single' WHEN a.read AND a.present THEN 'before_archive' END AS ended, a.n, a.read AND NOT a.present AS sure, a.d AS early, z.d AS late FROM x a JOIN x z ON z.target = a.target AND z.i = z.n - 1 WHERE a.i = 0),
 h AS (SELECT target, CAST(0 AS BIGINT) AS lo, n - 1 AS hi, sure, 6 AS rest FROM s WHERE ended IS NULL UNION ALL
  SELECT h.target, CASE WHEN x.read AND x.present THEN lo ELSE x.i END, CASE WHEN x.read AND x.present THEN x.i ELSE hi END, sure OR (x.read AND NOT x.present), rest - 1 FROM h JOIN x ON x.target = h.target AND x.i = (h.lo + h.hi) // 2 WHERE hi - lo > 1 AND rest > 0),
 l AS (SELECT target, arg_min(lo, rest) AS lo, arg_min(hi, rest) AS hi, arg_min(sure, rest) AS sure, min(rest) AS rest FROM h GROUP BY target)
 SELECT s.target, coalesce(ended, CASE WHEN hi - lo > 1 THEN 'coarse' ELSE 'bracketed' END) AS outcome, CASE WHEN l.sure THEN a.d END AS last_without, CASE ended WHEN 'single' THEN late WHEN 'before_archive' THEN early ELSE b.d END AS first_with,
 CAST(CASE WHEN ended IN ('unreadable', 'absent', 'single') THEN 1 WHEN ended = 'before_archive' THEN 2 ELSE 8 - rest END AS BIGINT) AS n_probed
 FROM s LEFT JOIN l USING (target) LEFT JOIN x a ON a.target = s.target AND a.i = l.lo LEFT JOIN x b ON b.target = s.target AND b.i = l.hi""")  # fmt: skip
def bracket_appearance(l):
    """When the links of each target appeared, between two captures of the days it was seen on, eight of which may be read; every
    tenth target's archive cannot be, and some days of the others."""
    k = F.substring("target", 2, 10).cast("long")
    days = l.groupBy("target", F.col("seen_at").alias("at")).agg(F.count("*").alias("m"))
    read = (k % 10 != 9) & ((F.col("m") + F.day("at")) % 7 != 0)
    return R.bracket_appearance(days.select("target", "at", read.alias("read"), (F.col("at") >= F.date_add(F.lit("1992-01-01").cast("date"), (k * 13 % 2600).cast("int"))).alias("present")), "target")


# -- aggregations --------------------------------------------------------------------------------
@query("agg_rel_distribution", "v_links", sql="SELECT target, rel, count(*) AS n FROM v_links GROUP BY target, rel")
def agg_rel_distribution(l):
    return l.groupBy("target", "rel").agg(F.count("*").alias("n"))


@query("agg_by_referrer", "v_links", sql="""SELECT target, src_domain, count(*) AS n_links, min(seen_at) AS first_at, sum(CASE WHEN rel = 'dofollow' THEN 1 ELSE 0 END)::BIGINT AS n_follow,
    max(struct_pack(seen_at, url_src)).url_src AS latest_url, max(struct_pack(seen_at, url_src, anchor)) FILTER (anchor <> '').anchor AS latest_anchor FROM v_links GROUP BY ALL""".replace("max(struct_pack(seen_at, url_src)).url_src", "arg_max(url_src, struct_pack(a := seen_at, b := url_src))").replace("max(struct_pack(seen_at, url_src, anchor)) FILTER (anchor <> '').anchor", "arg_max(anchor, struct_pack(a := seen_at, b := url_src)) FILTER (anchor <> '')"))  # fmt: skip
def agg_by_referrer(l):
    return l.groupBy("target", "src_domain").agg(
        F.count("*").alias("n_links"),
        F.min("seen_at").alias("first_at"),
        F.sum(F.when(follow(), 1).otherwise(0)).alias("n_follow"),
        F.max(F.struct("seen_at", "url_src"))["url_src"].alias("latest_url"),
        F.max(F.when(F.col("anchor") != "", F.struct("seen_at", "url_src", "anchor")))["anchor"].alias("latest_anchor"),
    )


@query("agg_scalar_subqueries", "v_links", "v_referents", sql="SELECT (SELECT count(*) FROM v_links) AS n_links, (SELECT count(DISTINCT src_domain) FROM v_links WHERE rel = 'dofollow') AS n_follow_domains, (SELECT count(*) FROM (SELECT target, src_domain FROM v_links WHERE status = 'F' UNION SELECT target, src_domain FROM v_referents)) AS n_either")
def agg_scalar_subqueries(l, r):
    either = l.filter("status = 'F'").select("target", "src_domain").union(r.select("target", "src_domain")).distinct().agg(F.count("*").alias("n_either"))
    return l.agg(F.count("*").alias("n_links"), F.countDistinct(F.when(follow(), F.col("src_domain"))).alias("n_follow_domains")).join(F.broadcast(either))


@query("agg_index_stats", "v_links", sql="SELECT count(*) AS n, count(DISTINCT src_domain) AS n_sources, count(DISTINCT target) AS n_targets FROM v_links")
def agg_index_stats(l):
    return l.agg(F.count("*").alias("n"), F.countDistinct("src_domain").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


@query("agg_state_counts", "v_queue", sql="SELECT state, count(*) AS n FROM v_queue GROUP BY state")
def agg_state_counts(q):
    return q.groupBy("state").agg(F.count("*").alias("n"))


@query("agg_usage_24h", sql="SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY event_type")
def agg_usage_24h(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bound = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("bound"))
    return e.join(F.broadcast(bound), F.col("ts") >= F.col("bound")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg_top_targets_7d", sql="SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id ORDER BY n DESC, user_id LIMIT 40")
def agg_top_targets_7d(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bound = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("bound"))
    return e.join(F.broadcast(bound), F.col("ts") >= F.col("bound")).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(40)


@query("agg_yield_by_source", "v_journal", sql="SELECT source, count(*) AS n FROM v_journal GROUP BY source")
def agg_yield_by_source(j):
    return j.groupBy("source").agg(F.count("*").alias("n"))


@query("agg_quota", sql="SELECT user_id, count(*) AS n, count(*) >= 12 AS refused FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY user_id")
def agg_quota(spark, sf_dir):
    """Clicks of each account in the 24 hours before now, which is the latest event; from 12 on it is refused."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    recent = e.filter("event_type = 'click'").join(F.broadcast(now), F.expr("ts > now - INTERVAL 24 HOURS"))
    return recent.groupBy("user_id").agg(F.count("*").alias("n"), (F.count("*") >= 12).alias("refused"))


@query("agg_omnipresent", "v_links", sql="SELECT src_domain, count(DISTINCT target) AS n_targets FROM v_links GROUP BY src_domain HAVING count(DISTINCT target) > greatest(50, (SELECT count(DISTINCT target) FROM v_links) // 4)")
def agg_omnipresent(l):
    total = l.agg(F.countDistinct("target").alias("total"))
    counts = l.groupBy("src_domain").agg(F.countDistinct("target").alias("n_targets"))
    return counts.join(F.broadcast(total)).filter("n_targets > greatest(50, floor(total / 4))").select("src_domain", "n_targets")


@query("agg_corpus_shape", "v_pages", sql="""WITH p AS (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM v_pages),
    a AS (SELECT count(*) AS n_urls, round(avg(len(s)), 6) AS mean_depth, count(DISTINCT coalesce('/' || s[1] || '/', '(root)')) AS n_folders FROM p)
    SELECT coalesce('/' || s[1] || '/', '(root)') AS folder, count(*) AS n, any_value(n_urls) AS n_urls, any_value(mean_depth) AS mean_depth, any_value(n_folders) AS n_folders FROM p, a GROUP BY ALL ORDER BY n DESC, folder LIMIT 12""")  # fmt: skip
def agg_corpus_shape(p):
    """The twelve largest folders of the first level, with the mean depth, folders and URLs of the whole corpus."""
    s = U.path_segments(U.path_of(F.col("url")))
    folder = F.coalesce(F.concat(F.lit("/"), F.get(s, F.lit(0)), F.lit("/")), F.lit("(root)"))
    folders = p.select(folder.alias("folder"), F.size(s).alias("depth")).groupBy("folder").agg(F.count("*").alias("n"), F.sum("depth").alias("depths"))
    whole = folders.agg(F.sum("n").alias("n_urls"), F.round(F.sum("depths") / F.sum("n"), 6).alias("mean_depth"), F.count("*").alias("n_folders"))
    return folders.drop("depths").orderBy(F.desc("n"), "folder").limit(12).join(F.broadcast(whole))


@query("agg_latest_date", "v_positions", sql="SELECT domain, CASE WHEN max(d) > DATE '1998-06-02' THEN NULL ELSE max(d) END AS latest, max(d) > DATE '1998-06-02' AS in_future FROM (SELECT domain, CAST(measured_at AS DATE) AS d FROM v_positions) GROUP BY domain")
def agg_latest_date(p):
    raw = F.when(F.col("seq") % 7 == 0, "not a date").otherwise(F.col("measured_at").cast("date").cast("string"))
    kept = p.select("domain", raw.try_cast("date").alias("d")).unionByName(p.filter("seq % 7 = 0").select("domain", F.col("measured_at").cast("date").alias("d")))
    late = F.max("d") > F.lit("1998-06-02").cast("date")
    return kept.groupBy("domain").agg(F.when(~late, F.max("d")).alias("latest"), late.alias("in_future"))


@query("agg_max_by_host", "v_links", sql="SELECT src_domain, url_src, link_score FROM v_links QUALIFY row_number() OVER (PARTITION BY src_domain ORDER BY link_score DESC, url_src, url_dest) = 1")
def agg_max_by_host(l):
    return R.first_per_key(l, "src_domain", F.col("link_score").desc(), F.col("url_src"), F.col("url_dest")).select("src_domain", "url_src", "link_score")


@query("agg_union_referrers", "v_referents", sql="SELECT target, count(DISTINCT src_domain) AS n_named, count(DISTINCT src_domain) FILTER (source = 'graph') AS n_graph, count(DISTINCT src_domain) FILTER (source = 'console') AS n_console, max(declared) AS best_declared FROM v_referents GROUP BY target")
def agg_union_referrers(r):
    one = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("src_domain"))).alias(f"n_{s}")
    return r.groupBy("target").agg(F.countDistinct("src_domain").alias("n_named"), one("graph"), one("console"), F.max("declared").alias("best_declared"))


@query("agg_priority_min", "v_links", sql="SELECT src_domain, CAST(min(CASE WHEN target IN ('t1', 't2') THEN 1 WHEN CAST(substring(target, 2) AS BIGINT) < 50 THEN 2 ELSE 5 END) AS BIGINT) AS priority FROM v_links GROUP BY src_domain")
def agg_priority_min(l):
    n = F.substring("target", 2, 9).cast("long")
    return l.groupBy("src_domain").agg(F.min(F.when(F.col("target").isin("t1", "t2"), 1).when(n < 50, 2).otherwise(5)).cast("long").alias("priority"))


@query("agg_measured_weighted_mean", "v_journal", sql="SELECT domain, round(sum(CASE WHEN state = 'MEASURED' THEN (1 + k) * value END) / sum(CASE WHEN state = 'MEASURED' THEN 1 + k END), 6) AS mean FROM v_journal GROUP BY domain")
def agg_measured_weighted_mean(j):
    w = F.when(F.col("state") == "MEASURED", 1 + F.col("k"))
    return j.groupBy("domain").agg(F.round(F.sum(w * F.col("value")) / F.sum(w), 6).alias("mean"))


@query("agg_median_upper", "v_links", sql="SELECT src_domain, list_sort(list(link_score))[count(*) // 2 + 1] AS median FROM v_links GROUP BY src_domain")
def agg_median_upper(l):
    return R.upper_median(l, "link_score", "src_domain")


@query("agg_mad", "v_ranks", sql="WITH r AS (SELECT log10(rank_a / rank_b) AS x FROM v_ranks WHERE rank_b IS NOT NULL), m AS (SELECT list_sort(list(x))[count(*) // 2 + 1] AS median FROM r), d AS (SELECT list_sort(list(abs(x - median)))[count(*) // 2 + 1] AS mad FROM r, m) SELECT round(median, 6) AS median, round(greatest(mad, 0.05), 6) AS mad FROM m, d")
def agg_mad(r):
    return R.median_and_mad(r.filter("rank_b IS NOT NULL").select(F.log10(F.col("rank_a") / F.col("rank_b")).alias("x")), "x").select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("agg_error_summary", "v_queue", sql="WITH c AS (SELECT host, seq % 3 * 100 + 200 AS code, count(*) AS n FROM v_queue GROUP BY ALL) SELECT host, string_agg(code || ' x' || n, ', ' ORDER BY n DESC, code) AS summary, coalesce(max(n) FILTER (code = 200), 0) >= 5 AS answers_all FROM c GROUP BY host")
def agg_error_summary(q):
    """What the pages tried on each host answered. Five of 200 that bear no link make a trap likely: a host that answers
    200 to any address, so that the code proves nothing."""
    counts = q.groupBy("host", (F.col("seq") % 3 * 100 + 200).alias("code")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code", "n")))  # a handful of codes per host
    return counts.groupBy("host").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["code"], F.lit(" x"), x["n"])), ", ").alias("summary"), (F.coalesce(F.max(F.when(F.col("code") == 200, F.col("n"))), F.lit(0)) >= 5).alias("answers_all"))


@query("agg_geo_mean", "v_links", sql="SELECT target, round(exp(avg(ln(link_score))), 6) AS geo_mean FROM v_links GROUP BY target")
def agg_geo_mean(l):
    return l.groupBy("target").agg(F.round(F.exp(F.avg(F.log("link_score"))), 6).alias("geo_mean"))


@query("agg_correlated_interval", "v_positions", sql="SELECT domain, round(sum(price * 0.8), 4) AS low, round(sum(price * 1.3), 4) AS high, round(sqrt(sum(pow(price * 0.25, 2))), 4) AS independent FROM v_positions GROUP BY domain")
def agg_correlated_interval(p):
    return p.groupBy("domain").agg(F.round(F.sum(F.col("price") * 0.8), 4).alias("low"), F.round(F.sum(F.col("price") * 1.3), 4).alias("high"), F.round(F.sqrt(F.sum(F.pow(F.col("price") * 0.25, F.lit(2.0)))), 4).alias("independent"))


@query("agg_rate", "v_journal", sql="""WITH d AS (SELECT domain, seq, k - lag(k) OVER w AS dk, epoch(measured_at) - epoch(lag(measured_at) OVER w) AS dt FROM v_journal WINDOW w AS (PARTITION BY domain ORDER BY measured_at, seq))
    SELECT domain, seq, CASE WHEN dt > 5 AND dt < 3600 THEN round(dk / dt + 1e-9, 6) END AS rate FROM d""")  # fmt: skip
def agg_rate(j):
    """Speed of each counter since the reading before, which may lie in another task."""
    rows = R.with_previous(j.select("domain", "seq", "measured_at", "k"), ["domain"], ["measured_at", "seq"], ["measured_at", "k"])
    dt = F.timestamp_diff("SECOND", F.col("previous.measured_at"), F.col("measured_at"))
    return rows.select("domain", "seq", F.when((dt > 5) & (dt < 3600), F.round((F.col("k") - F.col("previous.k")) / dt + F.lit(1e-9), 6)).alias("rate"))


@query("agg_cadence", sql="SELECT user_id, 24 * count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) AS pages_per_day FROM events GROUP BY user_id")
def agg_cadence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bound = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("bound"))
    return e.join(F.broadcast(bound)).groupBy("user_id").agg((24 * F.count(F.when(F.col("ts") >= F.col("bound"), 1))).alias("pages_per_day"))


@query("agg_kv_pivot", "v_journal", sql="SELECT domain, max(value) FILTER (metric = 'click') AS click, max(value) FILTER (metric = 'view') AS view, max(value) FILTER (metric = 'error') AS error FROM v_journal GROUP BY domain")
def agg_kv_pivot(j):
    return j.groupBy("domain").pivot("metric", ["click", "view", "error"]).agg(F.max("value"))


# -- rankings, top-k, sets -----------------------------------------------------------------------
SHOWN = "id % 4 <> 0 AS displayable, CASE WHEN id % 7 <> 0 THEN id % 100 END AS referring"
ORDERED = "CASE role WHEN 'own' THEN 0 ELSE 1 END, CASE WHEN role = 'own' THEN 0 WHEN displayable THEN balance ELSE -1 END DESC, CASE WHEN role = 'own' THEN 0 ELSE coalesce(referring, -1) END DESC, id"


@query("rank_domains", "v_domains", sql=f"SELECT id, row_number() OVER (ORDER BY {ORDERED}) AS place FROM (SELECT *, {SHOWN} FROM v_domains)")
def rank_domains(d):
    """Every domain: own first, in the order they are configured in, then the others by score where it may be shown (-1 else),
    then by referring domains (-1 if unknown)."""
    own = F.when(F.col("role") == "own", 0).otherwise(1)
    rows = d.selectExpr("id", "role", "balance", *SHOWN.split(", ")).select("id", own.alias("r"), F.when(own == 0, 0.0).when(F.col("displayable"), F.col("balance")).otherwise(-1.0).alias("s"), F.when(own == 0, 0).otherwise(F.coalesce("referring", F.lit(-1))).alias("n"))
    return R.placed(rows, [F.col("r"), F.desc("s"), F.desc("n"), F.col("id")]).select("id", "place")


@query("rank_classement", "v_domains", sql="SELECT role, id, row_number() OVER (PARTITION BY role ORDER BY balance DESC, id) AS place FROM v_domains WHERE (id % 10) / 10.0 >= 0.6")
def rank_classement(d):
    rows = d.filter("(id % 10) / 10.0 >= 0.6").select("role", "id", "balance")
    return R.placed(rows, [F.col("role"), F.desc("balance"), F.col("id")], "role").select("role", "id", "place")


@query("rank_opportunities", "v_links", sql="SELECT src_domain, count(DISTINCT target) AS n_cited, max(link_score) AS score FROM v_links GROUP BY src_domain ORDER BY n_cited DESC, score DESC, src_domain LIMIT 50")
def rank_opportunities(l):
    rows = l.groupBy("src_domain").agg(F.countDistinct("target").alias("n_cited"), F.max("link_score").alias("score"))
    return rows.orderBy(F.desc("n_cited"), F.desc(F.coalesce("score", F.lit(-1.0))), "src_domain").limit(50)


PASSAGE = "CASE WHEN seen_at < DATE '1992-06-01' THEN 0 WHEN seen_at > DATE '1998-06-01' THEN 1 ELSE 2 END"


@query("topk_per_target", "v_links", sql=f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY kind, link_score DESC, url_src, url_dest, seen_at) AS rn FROM (SELECT *, {PASSAGE} AS kind FROM v_links)),
    k AS (SELECT *, rn <= 400 OR kind < 2 OR target IN ('t1', 't2') AS shown FROM n)
    SELECT target, url_src, url_dest, seen_at, kind::BIGINT AS kind, (SELECT count(*) FILTER (NOT shown) FROM k h WHERE h.target = k.target) AS hidden FROM k WHERE shown""")  # fmt: skip
def topk_per_target(l):
    """Gone links first, then new ones, then by count: 400 of each target, besides every gone or new link and all of the own
    targets; how many are hidden is counted, and no target's rows meet in one task."""
    kind = F.expr(PASSAGE).cast("long")
    rows = l.select("target", "url_src", "url_dest", "seen_at", "link_score", kind.alias("kind"))
    always = (F.col("kind") < 2) | F.col("target").isin("t1", "t2")
    return R.capped_with_all(rows, "target", always, [F.col("kind"), F.desc("link_score"), F.col("url_src"), F.col("url_dest"), F.col("seen_at")], 400).select("target", "url_src", "url_dest", "seen_at", "kind", "hidden")


@query("topk_per_host", "v_links", sql="""WITH a AS (SELECT target, src_domain, url_src, url_dest, link_score, row_number() OVER (PARTITION BY target, src_domain ORDER BY link_score DESC, url_src, url_dest) AS rn FROM v_links),
    h AS (SELECT target, src_domain FROM a WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY target ORDER BY link_score DESC, url_src, url_dest) <= 30) SELECT target, src_domain, url_src, url_dest, rn FROM a SEMI JOIN h USING (target, src_domain) WHERE rn <= 3""")  # fmt: skip
def topk_per_host(l):
    """Of each target the 30 hosts with the best links, three links of each."""
    best = [F.desc("link_score"), F.col("url_src"), F.col("url_dest")]
    rn = F.row_number().over(Window.partitionBy("target", "src_domain").orderBy(*best)).cast("long")
    ranked = l.select("target", "src_domain", "url_src", "url_dest", "link_score").withColumn("rn", rn).filter("rn <= 3")
    hosts = ranked.filter("rn = 1").withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(*best))).filter("place <= 30")
    return ranked.join(hosts.select("target", "src_domain"), ["target", "src_domain"], "left_semi").select("target", "src_domain", "url_src", "url_dest", "rn")


@query("cap_per_target", "v_links", sql="""SELECT target, url_src, url_dest, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY target) - 3000, 0) AS overflow, CASE WHEN count(*) OVER (PARTITION BY target) > 3000 THEN 'floor' ELSE 'measured' END AS nature
    FROM v_links WINDOW w AS (PARTITION BY target ORDER BY url_src, url_dest, seen_at) QUALIFY row_number() OVER w <= 3000""")  # fmt: skip
def cap_per_target(l):
    return R.cap_per_key(l, "target", [F.col("url_src"), F.col("url_dest"), F.col("seen_at")]).select("target", "url_src", "url_dest", "place", "overflow", "nature")


@query("sample_stride", "v_pages", sql="WITH r AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM v_pages) SELECT page_id FROM r WHERE i IN (SELECT (k * n) // 40 FROM range(40) t(k), (SELECT max(n) AS n FROM r))")
def sample_stride(p):
    return R.sample_stride(p.select("page_id"), "page_id", 40)


@query("paginate", "v_links", sql="SELECT target, src_domain, url_src, url_dest, seen_at FROM v_links ORDER BY seen_at DESC, url_src, url_dest, target LIMIT 200 OFFSET 400")
def paginate(l):
    return R.page_of(l.select("target", "src_domain", "url_src", "url_dest", "seen_at"), [F.desc("seen_at"), F.col("url_src"), F.col("url_dest"), F.col("target")], 2)


@query("union_referrers", "v_links", "v_referents", sql="SELECT target, src_domain FROM v_links WHERE rel = 'dofollow' UNION SELECT target, src_domain FROM v_referents")
def union_referrers(l, r):
    return l.filter(follow()).select("target", "src_domain").union(r.select("target", "src_domain")).distinct()


@query("set_minus", "v_links", "v_referents", sql="SELECT target, src_domain FROM v_links EXCEPT SELECT target, src_domain FROM v_referents WHERE source = 'graph'")
def set_minus(l, r):
    return l.select("target", "src_domain").subtract(r.filter("source = 'graph'").select("target", "src_domain"))


@query("set_intersection", "v_ranks", sql="SELECT domain FROM v_ranks WHERE asked INTERSECT SELECT domain FROM v_ranks WHERE rank_b IS NOT NULL")
def set_intersection(r):
    return r.filter("asked").select("domain").intersect(r.filter("rank_b IS NOT NULL").select("domain"))


@query("ext_approx_distinct", "v_links", sql="SELECT count(DISTINCT target) BETWEEN 190 AND 210 AS close FROM v_links")
def ext_approx_distinct(l):
    """Extension: not in the reference."""
    return l.agg(F.approx_count_distinct("target", 0.02).between(190, 210).alias("close"))


@query("js_round", "v_links", sql="SELECT url_src, url_dest, floor((link_score - 50) / 8 * 100 + 0.5) / 100 AS r FROM v_links")
def round_js(l):
    return l.select("url_src", "url_dest", js_round((F.col("link_score") - 50) / 8, 2).alias("r"))
