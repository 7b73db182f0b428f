"""Source and sink queries: the driver's tables written as the formats the parsers read, then parsed."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import relational as R
from weftline.queries.registry import query
from weftline.session import shared_folder, shared_out, table
from weftline.sources import archive_ranges as AR
from weftline.sources import parsers as P
from weftline.sources import report as RJ
from weftline.sources import sitemap as SM
from weftline.sources.store import write_batches


@query("scan_journal", "v_journal", sql="""SELECT metric, state, count(*) AS n, false AS unreadable FROM v_journal WHERE seq % 89 <> 0 AND seq % 97 <> 0 GROUP BY ALL
    UNION ALL SELECT NULL, NULL, count(*), true FROM v_journal WHERE seq % 89 <> 0 AND seq % 97 = 0""")  # fmt: skip
def scan_journal(j):
    good = F.to_json(F.struct("seq", "domain", "metric", "state", "value", F.col("measured_at").cast("string").alias("measured_at")))
    line = F.when(F.col("seq") % 89 == 0, "  ").when(F.col("seq") % 97 == 0, F.substring(good, 1, 15)).otherwise(good)
    rows = P.parse_journal(j.select(line.alias("value")))
    return rows.groupBy(F.when(~F.col("unreadable"), F.col("metric")).alias("metric"), F.when(~F.col("unreadable"), F.col("state")).alias("state"), "unreadable").agg(F.count("*").alias("n"))


@query("scan_graph", "v_edges", sql="SELECT src, count(*) AS n_out FROM v_edges GROUP BY src")
def scan_graph(e):
    """Edges written as TSV in gzip files of many members, with lines that are no edge among them, and read back behind the size
    guard, each file by many tasks."""
    path = shared_folder(e.sparkSession, "graph")
    lines = e.select("src", F.concat_ws("\t", "src", "dst").alias("value")).union(e.filter("src % 10 = 0").select("src", F.concat(F.lit("broken "), "dst")))
    members = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(512)).alias("member")).agg(F.concat(F.array_join(F.collect_list("value"), "\n"), F.lit("\n")).alias("text"))
    AR.write_archives(members, "member", "text", f"{path}/edges").write.parquet(f"{path}/members")
    return P.read_gzip_edges(e.sparkSession, f"{path}/edges", least_bytes=100, split=256 << 10).groupBy("src").agg(F.count("*").alias("n_out"))


@query("scan_rank_zip", "v_ranks", sql="""SELECT domain, rank_a AS rank, 'a "b", c' AS note FROM v_ranks""")
def scan_rank_zip(r):
    """Rank tables packed as zip archives, one for each batch of rows, unpacked and parsed."""
    line = F.concat(F.col("rank_a"), F.lit(","), F.col("domain"), F.lit(',"a ""b"", c"'))
    archives = r.select(line.alias("value")).mapInArrow(packed, "path string, content binary")
    fields = P.unzip_lines(archives).filter("value NOT LIKE '%Global_Rank%'").select(P.split_csv(F.col("value")).alias("f")).select(F.col("f")[0].alias("﻿Global_Rank"), F.col("f")[1].alias(" Do-main"), F.col("f")[2].alias("NOTE"))
    return P.normalise_headers(fields, {"globalrank": "rank", "domain": "domain", "note": "note"}).select("domain", F.col("rank").cast("long").alias("rank"), "note")


def packed(batches):
    """Each batch of lines as a zip archive of one CSV file with a header."""
    for k, batch in enumerate(batches):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("table.csv", "\n".join(["\ufeffGlobal_Rank, Do-main,NOTE", *batch.column(0).to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array([f"archive-{k}"]), pa.array([box.getvalue()])], names=["path", "content"])


@query("scan_rank_list", "v_ranks", sql="SELECT domain, rank_a AS rank FROM v_ranks WHERE asked")
def scan_rank_list(r):
    """A rank table with headers written as CSV and read back, only the asked domains."""
    path = shared_folder(r.sparkSession, "ranks")
    r.select(F.col("rank_a").alias("Global_Rank"), F.col("domain").alias(" Do-main"), F.lit('a "b", c').alias("NOTE")).write.option("header", True).option("escape", '"').csv(path)
    rows = P.read_rank_csv(r.sparkSession, path, {"globalrank": "rank", "domain": "domain"}, r.filter("asked").select("domain"))
    return rows.select("domain", F.col("rank").cast("long").alias("rank"))


@query("scan_crux", "v_ranks", sql="SELECT 'https://' || domain || ',x' AS origin, rank_a AS rank FROM v_ranks")
def scan_crux(r):
    origin, rank = P.parse_origin_rank(F.concat(F.lit("https://"), "domain", F.lit(",x,"), "rank_a"))
    return r.select(origin.alias("origin"), rank.alias("rank"))


@query("sitemap_entries", "v_pages", sql="SELECT page_id, url AS loc, CAST(1 AS BIGINT) AS place FROM v_pages UNION ALL SELECT page_id, url || '?b&c', 2 FROM v_pages")
def sitemap_entries(p):
    xml = F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><LOC>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("?b&amp;c\n</LOC></url></urlset>"))
    return p.select("page_id", F.posexplode(P.sitemap_entries(xml)).alias("at", "loc")).select("page_id", "loc", (F.col("at") + 1).cast("long").alias("place"))


def sitemaps_of(p):
    """(domains, fetched) of a site for every 25 pages: every fourth declares a url set of its own (every eighth a missing one); the
    others have an index in one of the usual places with three url sets, of which every fifth site's last is behind a wall and every
    seventh's first is a page of text. The pages say when they were changed."""
    pages = p.select("url", F.floor(F.col("page_id") / 25).alias("d"), (F.col("page_id") % 3).alias("k"), F.format_string("2024-02-%02d", (F.col("page_id") % 28 + 1).cast("int")).alias("day"))
    site = lambda path: F.concat(F.lit("https://d"), "d", F.lit(f".org/{path}"))
    tag = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), "day", F.lit("</lastmod></url>"))
    domains = pages.select("d").distinct()
    parts = domains.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).join(pages.groupBy("d", "k").agg(F.collect_list(tag).alias("tags")), ["d", "k"], "left")  # 25 pages at most
    body = F.concat(F.lit("<urlset>"), F.concat_ws("", "tags"), F.lit("</urlset>"))
    sets = parts.filter("d % 4 <> 0").select(F.concat(site("part-"), "k", F.lit(".xml?a=1&b=2")).alias("url"), F.when((F.col("d") % 5 == 1) & (F.col("k") == 2), 403).otherwise(200).alias("http"), F.when((F.col("d") % 7 == 3) & (F.col("k") == 0), "<html>nothing here</html>").otherwise(body).alias("xml"))
    listed = F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), site(f"part-{k}.xml?a=1&amp;b=2"), F.lit("</loc></sitemap>")) for k in (0, 1, 2, 0)], F.lit("</sitemapindex>"))
    at = F.when(F.col("d") % 3 == 0, site("sitemap_index.xml")).otherwise(site("sitemap.xml"))
    indexes = domains.filter("d % 4 <> 0").select(at.alias("url"), F.lit(200).alias("http"), listed.alias("xml"))
    missing = domains.filter("d % 4 <> 0 AND d % 3 = 0").select(site("sitemap.xml").alias("url"), F.lit(404).alias("http"), F.lit(None).cast("string").alias("xml"))
    own = pages.filter("d % 4 = 0").groupBy("d").agg(F.collect_list(tag).alias("tags")).select(site("own.xml").alias("url"), F.when(F.col("d") % 8 == 0, 404).otherwise(200).alias("http"), body.alias("xml"))
    asked = domains.select(F.concat(F.lit("d"), "d", F.lit(".org")).alias("domain"), F.when(F.col("d") % 4 == 0, F.array(site("own.xml"))).alias("declared"))
    return asked, sets.union(indexes).union(missing).union(own)


@query("scan_sitemap", "v_pages", sql="""WITH p AS (SELECT page_id // 25 AS d, page_id % 3 AS k, '2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS day FROM v_pages),
    m AS (SELECT *, CASE WHEN d % 8 = 0 THEN false WHEN d % 4 <> 0 AND d % 5 = 1 AND k = 2 THEN false WHEN d % 4 <> 0 AND d % 7 = 3 AND k = 0 THEN false ELSE true END AS told FROM p),
    r AS (SELECT d, count(*) FILTER (told) AS n_urls, max(day) FILTER (told) AS newest, CASE WHEN d % 4 = 0 THEN 1 WHEN d % 3 = 0 THEN 5 ELSE 4 END AS n_read, CASE WHEN d % 4 <> 0 AND d % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN d % 4 <> 0 AND d % 7 = 3 THEN 1 ELSE 0 END AS n_walls, CASE WHEN d % 8 = 0 OR (d % 4 <> 0 AND d % 3 = 0) THEN 1 ELSE 0 END AS n_absent FROM m GROUP BY d)
    SELECT 'd' || d || '.org' AS domain, CASE WHEN n_urls > 0 THEN 'MEASURED' WHEN n_walls > 0 THEN 'BLIND' ELSE 'ABSENT' END AS state, n_urls, n_read::BIGINT AS n_read, n_walls::BIGINT AS n_walls, n_absent::BIGINT AS n_absent, n_urls AS n_dated, newest, NULL::VARCHAR AS capped FROM r""")  # fmt: skip
def scan_sitemap(p):
    """Indexes and url sets walked from what robots.txt declares or the usual places, within three budgets."""
    return SM.walk(*sitemaps_of(p)).select("domain", "state", "n_urls", "n_read", "n_walls", "n_absent", "n_dated", "newest", "capped")


@query("scan_search_console", "v_positions", sql="SELECT query, CAST(count(*) AS BIGINT) AS n, sum(CAST(seq % 100 AS BIGINT))::BIGINT AS clicks, round(avg(position + 0.5), 6) AS mean_position FROM v_positions WHERE position IS NOT NULL GROUP BY query")
def scan_search_console(p):
    line = F.concat_ws("|", "query", F.col("seq") % 100, F.lit("1 234"), F.lit("3,5 %"), F.concat(F.col("position"), F.lit(",5")))
    f = F.split(line, r"\|")
    rows = p.filter("position IS NOT NULL").select(f[0].alias("query"), P.locale_number(f[1]).alias("clicks"), P.locale_number(f[4]).alias("position"))
    return rows.groupBy("query").agg(F.count("*").alias("n"), F.sum("clicks").cast("long").alias("clicks"), F.round(F.avg("position"), 6).alias("mean_position"))


@query("scan_gsc_links", "v_referents", sql="SELECT src_domain, max(declared) * 1000 AS links FROM v_referents WHERE src_domain <> 'd7' GROUP BY src_domain")
def scan_gsc_links(r):
    """Lines of a referrer table, ``domain;links`` with local numbers: the most links of each domain, without the own domain,
    the header and malformed names."""
    line = F.concat(F.upper("src_domain"), F.lit(".com ; "), "declared", F.lit(" 000"))
    odd = r.sparkSession.createDataFrame([("Domain;Links",), ("not a domain;5",), ("x.org",), (None,)], "value string")
    rows = P.parse_referrers(r.select(line.alias("value")).union(odd), own="d7.com")
    return rows.select(F.regexp_replace("domain", r"\.com$", "").alias("src_domain"), "links")


@query("scan_magnitude", "v_ranks", sql="SELECT id, CASE id % 4 WHEN 0 THEN id % 90 * 100 + 50 WHEN 1 THEN (id % 90) * 1000000 WHEN 2 THEN (id % 90) * 1000000000 ELSE id % 90 END AS n FROM v_ranks")
def scan_magnitude(r):
    n = F.col("id") % 90
    text = F.when(F.col("id") % 4 == 0, F.concat((n / 10).cast("decimal(10,2)") + F.lit(0.05).cast("decimal(10,2)"), F.lit("K"))).when(F.col("id") % 4 == 1, F.concat(n, F.lit("M"))).when(F.col("id") % 4 == 2, F.concat(n, F.lit(" B"))).otherwise(n.cast("string"))
    return r.select("id", P.magnitude(text).alias("n"))


@query("scan_multi_competitor", "v_ranks", sql="SELECT domain, CAST(1 AS BIGINT) AS place, rank_a % 3 AS links FROM v_ranks WHERE rank_a % 3 > 0 UNION ALL SELECT domain, 2, rank_b % 2 FROM v_ranks WHERE rank_b % 2 > 0")
def scan_multi_competitor(r):
    wide = r.select("domain", (F.col("rank_a") % 3).alias("SimilarSiteCount1"), (F.col("rank_b") % 2).alias("SimilarSiteCount2"))
    return P.unpivot_counts(wide, "domain", "SimilarSiteCount", 2).select("domain", F.col("place").cast("long").alias("place"), "links")


REPORT_SQL = """WITH r AS (SELECT domain, id, rank_a::DOUBLE AS r FROM v_ranks), m(metric, subject, value, state, has) AS (SELECT * FROM (VALUES
    ('authority', NULL, NULL, 'BLIND', 'b'), ('backlinks', NULL, -1.0::DOUBLE, 'MEASURED', 'b'), ('referring_domains', NULL, 12, 'MEASURED', 'b'), ('backlinks_change', NULL, 0.5, 'MEASURED', 'b'), ('backlinks@', '2024-01-01', -1, 'MEASURED', 'b'), ('backlinks@', '2024-02-01', NULL, 'ABSENT', 'b'), ('section_backlinks', NULL, NULL, 'BLIND', 'nb'),
    ('world_rank', NULL, -1, 'MEASURED', ''), ('category_rank', NULL, NULL, 'ABSENT', ''), ('country_rank', NULL, 7, 'MEASURED', ''), ('visits', NULL, NULL, 'ABSENT', ''), ('pages_per_visit', NULL, 2.5, 'MEASURED', ''), ('visit_seconds', NULL, NULL, 'ABSENT', ''), ('bounce_rate', NULL, 0.5, 'MEASURED', ''),
    ('organic_visits', NULL, NULL, 'BLIND', 'h'), ('organic_visits', NULL, NULL, 'ABSENT', 'nh'), ('paid_visits', NULL, 0, 'MEASURED', ''), ('section_searchTraffic', NULL, NULL, 'BLIND', 'h'), ('country_visits', 'fr', -1, 'MEASURED', ''), ('country_share', 'fr', 0.25, 'MEASURED', ''),
    ('position', 'k1', 3, 'MEASURED', ''), ('search_volume', 'k1', NULL, 'ABSENT', ''), ('cost_per_click', 'k1', NULL, 'ABSENT', ''), ('query_share', 'k1', NULL, 'ABSENT', ''), ('visits_from', 'a.org', 9, 'MEASURED', ''), ('ai_visits', 'bot', 4, 'MEASURED', ''), ('desktop_visits@', '2024-01-01', 8, 'MEASURED', ''), ('mobile_visits@', '2024-01-01', NULL, 'ABSENT', ''), ('section_competitors', NULL, NULL, 'BLIND', '')) v)
    SELECT domain, metric, subject, CASE WHEN value = -1 THEN r ELSE value END AS value, state FROM r, m WHERE has = '' OR (has = 'b') = (id % 5 <> 0) AND has IN ('b', 'nb') OR (has = 'h') = (id % 7 = 0) AND has IN ('h', 'nh')"""


@query("scan_report_json", "v_ranks", sql=REPORT_SQL)
def scan_report_json(r):
    """Reports of ten sections: one is missing throughout, one of some domains, one is held back for others. The ranks lie in few
    megabytes, which are one task's as they are read; their rows are shared out before reports are made of them."""
    r = shared_out(r)
    rank = F.col("rank_a").cast("string")
    backlinks = F.concat(F.lit('"backlinks":{"authorityScore":{"value":null},"backlinks":{"value":'), rank, F.lit(',"valueDiffPercent":0.5},"referringDomains":{"value":12},"backlinksHistory":[{"displayDate":"2024-01-01","backlinks":'), rank, F.lit('},{"displayDate":"2024-02-01","backlinks":null}]},'))
    report = F.concat(
        F.lit('{"summary":{"trafficStats":{"globalRank":{"value":'), rank, F.lit('},"categoryRank":{"value":null},"countryRank":{"value":7}}},'), F.when(F.col("id") % 5 != 0, backlinks).otherwise(""),
        F.lit('"visitorEngagement":{"visits":{"value":null},"pagesPerVisit":{"value":2.5},"bounceRate":{"value":0.5}},"searchTraffic":{"visible":'), F.when(F.col("id") % 7 == 0, "false").otherwise("true"),
        F.lit(',"organic":{"value":null},"paid":{"value":0}},"trafficByCountry":{"series":[{"country":"fr","traffic":'), rank,
        F.lit(',"trafficShare":0.25}]},"keywords":{"series":[{"keyword":"k1","position":3,"searchVolume":null}]},"trafficByDevice":{"history":[{"displayDate":"2024-01-01","desktopVisits":8}]},"trafficJourney":{"in":{"items":[{"host":"a.org","value":9}]}},"trafficAi":{"items":[{"id":"bot","traffic":{"value":4}}]}}'),
    )
    return RJ.report_metrics(r.select("domain", report.alias("report")), "domain", "report")


@query("scan_flat_graph_json", "v_ranks", sql="""SELECT domain, '{"a":' || rank_a || ',"b":[' || rank_a || ',' || id || ']}' AS decoded FROM v_ranks""")
def scan_flat_graph_json(r):
    flat = F.concat(F.lit('[{"a":1,"b":2},'), "rank_a", F.lit(",[1,3],"), "id", F.lit("]"))
    return P.decode_indexed_json(r.select("domain", flat.alias("decoded")), "decoded")


@query("scan_cdx", "v_pages", sql="SELECT page_id, url AS original, CAST(strptime('20240101000000', '%Y%m%d%H%M%S') AS TIMESTAMP) + to_seconds(page_id % 60) AS captured_at FROM v_pages")
def scan_cdx(p):
    text = F.to_json(F.array(F.array(F.lit("timestamp"), F.lit("original")), F.array(F.concat(F.lit("202401010000"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0")), "url")))
    rows = p.select("page_id", F.explode(P.parse_cdx(text)).alias("r"))
    return rows.select("page_id", F.col("r")["original"].alias("original"), P.timestamp14(F.col("r")["timestamp"]).alias("captured_at"))


@query("scan_warc", "v_pages", sql="SELECT page_id, 'WARC/1.0' AS warc_head, 'HTTP/1.1 200 OK' AS http_head, CAST(length(html) AS BIGINT) AS body_chars FROM v_pages")
def scan_warc(p):
    """Records out of archives on disk by the byte ranges of an index, cut at their first two blank lines. Between the pages'
    records lie others, which nothing asks for."""
    spark, folder = p.sparkSession, shared_folder(p.sparkSession, "archives")
    record = lambda body: F.concat(F.lit("WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"), body)
    rows = p.select(F.explode(F.array(F.struct((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("é other "), "url").alias("content")), F.struct("page_id", record(F.col("html")).alias("content")))).alias("r")).select("r.*")
    AR.write_archives(rows, "page_id", "content", f"{folder}/warc").write.parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index").filter("page_id >= 0")
    parts = AR.read_ranges(index, "page_id").select("page_id", P.split_warc(F.col("record").cast("string")).alias("w"))
    return parts.select("page_id", "w.warc_head", "w.http_head", F.length("w.body").cast("long").alias("body_chars"))


@query("scan_serp", "v_positions", sql="""WITH u AS (SELECT query, domain, seq, 'https://www.' || domain || '.com/' || (seq % 3) || '?s=' || seq AS url, domain || '.com/' || (seq % 3) AS page FROM v_positions),
    d AS (SELECT query, page, domain || '.com' AS domain, min(seq) AS first_at FROM u GROUP BY ALL)
    SELECT query, domain, page, row_number() OVER (PARTITION BY query ORDER BY first_at) AS rank FROM d""")  # fmt: skip
def scan_serp(p):
    """Results in order of appearance over the pages, each host and path once."""
    url = F.concat(F.lit("https://www."), "domain", F.lit(".com/"), F.col("seq") % 3, F.lit("?s="), "seq")
    host = U.host_of(F.col("url"))
    rows = p.select("query", "seq", url.alias("url")).select("query", "seq", host.alias("domain"), F.concat(host, U.path_of(F.col("url"))).alias("page"))
    first = rows.groupBy("query", "domain", "page").agg(F.min("seq").alias("first_at"))
    return R.placed(first, [F.col("query"), F.col("first_at")], "query").select("query", "domain", "page", F.col("place").alias("rank"))


@query("batched_write", "v_positions", sql="SELECT CAST(sum(n) AS BIGINT) AS n_rows, true AS bounded, CAST(sum(bad) AS BIGINT) AS refused FROM (SELECT count(*) AS n, count(*) FILTER (state = 'BLIND') AS bad FROM v_positions)")
def batched_write(p):
    """Batches of at most 100 values, sent from the executors; a batch the sink refuses is reported with its reason."""
    told = write_batches(p.select("seq", "domain", "query", "position", "state").repartition("state"), refuse_blind)
    return told.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 20).alias("bounded"), F.sum(F.when(~F.col("written"), F.substring_index("error", " ", 1).cast("long")).otherwise(0)).alias("refused"))


def refuse_blind(rows):
    if blind := sum(r[4] == "BLIND" for r in rows):
        raise ValueError(f"{blind} rows are blind")


def upserted(old, new, key, values, order):
    """Merge without a table format: union, the latest row of each key wins."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_o").desc(), *order)
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*key, *values)


@query("upsert_backlink", "v_links", sql="""SELECT target, url_src, url_dest, rel, seen_at FROM (SELECT *, CASE WHEN status = 'O' THEN 1 ELSE 0 END AS o FROM v_links)
    QUALIFY row_number() OVER (PARTITION BY target, url_src, url_dest ORDER BY o DESC, seen_at DESC, rel) = 1""")  # fmt: skip
def upsert_backlink(l):
    return upserted(l.filter("status <> 'O'"), l.filter("status = 'O'"), ("target", "url_src", "url_dest"), ("rel", "seen_at"), (F.col("seen_at").desc(), F.col("rel")))


@query("upsert_do_nothing", "v_referents", sql="""SELECT target, src_domain, max(kept) AS kept FROM (SELECT DISTINCT target, src_domain, 'old' AS kept FROM v_referents WHERE source = 'graph'
    UNION ALL SELECT DISTINCT target, src_domain, 'new' FROM v_referents r WHERE source = 'console' AND NOT EXISTS (SELECT 1 FROM v_referents o WHERE o.source = 'graph' AND o.target = r.target AND o.src_domain = r.src_domain)) GROUP BY ALL""")  # fmt: skip
def upsert_do_nothing(r):
    old, new = (r.filter(F.col("source") == s).select("target", "src_domain").distinct() for s in ("graph", "console"))
    return old.withColumn("kept", F.lit("old")).unionByName(new.join(old, ["target", "src_domain"], "left_anti").withColumn("kept", F.lit("new")))


@query("upsert_monotone", "v_queue", sql="SELECT host, min(priority) AS priority FROM v_queue GROUP BY host")
def upsert_monotone(q):
    """A new priority replaces the stored one only if it is better."""
    old, new = (q.filter(f"seq % 2 = {k}").groupBy("host").agg(F.min("priority").alias(n)) for k, n in ((0, "old"), (1, "new")))
    return old.join(new, "host", "full").select("host", F.least("old", "new").alias("priority"))


@query("ext_unpivot_parts", sql="SELECT p_partkey, 'size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def ext_unpivot_parts(spark, sf_dir):
    """Extension: not in the reference."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "field", "value")
