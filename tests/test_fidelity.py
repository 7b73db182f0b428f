"""Cases worked out by hand from the rules, not from the SQL of the oracles."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.operators import composite as C
from weftline.operators import relational as R
from weftline.operators import tasks as TM
from weftline.operators import traffic as T
from weftline.queries import registry
from weftline.queries.html import spam_inputs
from weftline.sources import parsers as P
from weftline.sources import report, sitemap
from weftline.sources.store import JournalStore, write_batches


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def spam_codes(spark, text, domain="good.org", external=0, hosts=0, size=10_000, http=200):
    signals = H.spam_signals(F.lit(domain), F.lit(text), F.lit(external), F.lit(hosts), F.lit(size), F.lit(http))
    return {(s["code"], s["weight"]) for s in one(spark, signals.alias("s"))["s"]}


def test_spam_price_and_words(spark):
    long = "plain words of a page " * 60
    assert spam_codes(spark, long) == set()
    assert spam_codes(spark, long + "a link costs $150") == {("price_near_link", 22)}
    # the first price alone counts: it stands far from any word of selling, the second does not
    assert spam_codes(spark, "shoes 80 eur " + long + "a link costs $150") == set()
    assert spam_codes(spark, long + "publication payante ici, $150") == {("sells_links", 40)}
    assert spam_codes(spark, long + "un lien pour 200 eur") == {("price_near_link", 22)}
    assert spam_codes(spark, long + "casino") == {("off_topic", 25)}
    assert spam_codes(spark, "y" * 40_000 + " casino") == set()
    assert spam_codes(spark, "short", domain="10.0.0.1") == {("ip_host", 30), ("thin", 15)}
    assert spam_codes(spark, "short", domain="free.nulled.xyz", http=403) == {("risky_tld", 10), ("piracy_name", 35)}
    assert spam_codes(spark, long, hosts=120) == {("saturated", 15)} and spam_codes(spark, long, hosts=300) == {("saturated", 30)}


def allowed(spark, text, path):
    return one(spark, H.robots_allowed(H.robots_rules(F.lit(text).cast("string")), F.lit(path)).alias("x"))["x"]


def test_robots_groups(spark):
    text = "Disallow: /before\nUser-agent: a\nUser-agent: *\nDisallow: /x # why\nAllow: /x/y\nDisallow: /*.php$\nDisallow:\nUser-agent: *\nDisallow: /second"
    for path, want in {"/before": True, "/x": False, "/x/z": False, "/x/y/1": True, "/a.php": False, "/a.php?b": True, "/second": True}.items():
        assert allowed(spark, text, path) is want, path
    assert allowed(spark, None, "/x") and allowed(spark, "User-agent: b\nDisallow: /", "/x")
    assert allowed(spark, "user-agent: *\ndisallow: /same\nallow: /same", "/same")
    assert not allowed(spark, "user-agent: *\ndisallow: /a+b(c)", "/a+b(c)d") and allowed(spark, "user-agent: *\ndisallow: /a+b", "/aab")
    prefix = lambda t, p: one(spark, H.robots_prefix_allowed(F.lit(t), F.lit(p)).alias("x"))["x"]
    assert prefix("User-agent: *\nDisallow: /*x\n", "/yx") and not prefix("User-agent: *\nDisallow: /\n", "/a") and prefix("", "/a")
    assert prefix("User-agent: *\nDisallow: /a\nUser-agent: b\nDisallow: /c", "/c/1") and not prefix("User-agent: *\nDisallow: /a", "/ab")


def test_closed_links_and_internal_pages(spark):
    html = "".join(f'<a href="https://t.org/{i}">text {i}</a>' for i in range(15)) + '<a href="https://t.org/far">' + "x" * 500 + "</a>"
    found = one(spark, H.links_closed(F.lit(html), F.lit("t.org")).alias("l"))["l"]
    assert [x["href"] for x in found] == [f"https://t.org/{i}" for i in range(12)]
    page = '<a href="/blog/a?x=1">1</a><a href="#blog">2</a><a href="https://other.org/blog">3</a><a href="/logo-app.png">4</a><a href="/blog/a">5</a><a href="mailto:blog@x.org">6</a><a href="/">7</a><a href="/nos-avis">8</a><a href="/Outils">9</a><a href="/plain">10</a>'
    assert one(spark, H.internal_likely(F.lit(page), F.lit("own.org")).alias("x"))["x"] == ["https://own.org/blog/a", "https://own.org/nos-avis", "https://own.org/Outils"]


def test_divergence_of_ranks(spark):
    usual = [(f"u{i}", True, 1000 + i, 1000) for i in range(21)]
    rows = [*usual, ("far", True, 100_000, 1000), ("missing", True, None, 1000), ("never asked", False, None, 1000), ("long only", True, 5, None)]
    found = {r.domain: (round(r.divergence, 2), r.nature) for r in R.rank_divergence(spark.createDataFrame(rows, "domain string, asked boolean, o long, m long")).collect()}
    # the median ratio is near 1, so the missing one is expected near rank 1011 of ten million
    assert found == {"far": (2.0, "drift"), "missing": (4.0, "floor")}


def test_mass_label_places_and_caps(spark):
    links = spark.createDataFrame([("t", "a", 100.0), ("t", "a", 50.0), ("t", "b", 50.0), ("t", "b", 50.0), ("u", "a", None)], "target string, domain string, nl double")
    assert {r.target: r.mass for r in C.quadratic_mass(links, "target", "domain", F.col("nl")).collect()} == {"t": pytest.approx(1 + 0.25 * 0.25 + 0.25 + 0.25 * 0.25), "u": 0.0}
    label = lambda text: one(spark, T.guarded_label(F.lit(text)).alias("x"))["x"]
    assert label("estimated clicks on the 9 queries followed") and pytest.raises(Exception, label, "Organic traffic")
    rows = spark.range(3000).selectExpr("id % 2 as k", "id * 7919 % 3001 as v")
    placed = R.placed(rows, [F.col("k"), F.desc("v")], "k").collect()
    for k in (0, 1):
        values = sorted((r.v for r in placed if r.k == k), reverse=True)
        assert [r.v for r in sorted((r for r in placed if r.k == k), key=lambda r: r.place)] == values
        assert sorted(r.place for r in placed if r.k == k) == list(range(1, len(values) + 1))
    capped = R.capped_with_all(rows, "k", F.col("v") < 5, [F.desc("v")], 10).collect()
    total = {k: sum(r.k == k for r in placed) for k in (0, 1)}
    for k in (0, 1):
        mine = [r for r in capped if r.k == k]
        late = {r.v for r in placed if r.k == k and r.v < 5}
        assert {r.v for r in mine} == {r.v for r in placed if r.k == k and r.place <= 10} | late and len(mine) == 10 + len(late)
        assert {r.hidden for r in mine} == {total[k] - len(mine)}
    assert [r.place for r in R.first_rows(rows.filter("k = 0"), "k", [F.desc("v")], 1400).orderBy("place").collect()] == list(range(1, 1401))


def test_budgets_of_the_sitemap_walk(spark):
    urls = lambda n, at="p": "<urlset>" + "".join(f"<url><loc>https://a.org/{at}{i}</loc></url>" for i in range(n)) + "</urlset>"
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    fetched = spark.createDataFrame(
        [("https://a.org/sitemap.xml", 200, index("s1", "nested", "s1")), ("nested", 200, index("s2", "https://a.org/sitemap.xml")), ("s1", 200, urls(3)), ("s2", 200, urls(4)), ("w", 403, None), ("https://c.org/sitemap.xml", 404, None), ("https://c.org/sitemap_index.xml", 200, urls(2))], "url string, http int, xml string"
    )
    domains = spark.createDataFrame([("a.org", None), ("b.org", ["w"]), ("c.org", []), ("d.org", ["gone"])], "domain string, declared array<string>")
    walk = lambda **budget: {r.domain: (r.state, r.n_urls, r.n_read, r.n_walls, r.n_absent, r.capped) for r in sitemap.walk(domains, fetched, **budget).collect()}
    assert walk() == {"a.org": ("MEASURED", 7, 4, 0, 0, None), "b.org": ("BLIND", 0, 1, 1, 0, None), "c.org": ("MEASURED", 2, 2, 0, 1, None), "d.org": ("BLIND", 0, 1, 1, 0, None)}
    assert walk(max_sitemaps=3)["a.org"] == ("BLIND", 3, 3, 0, 0, "sitemaps")
    assert walk(max_urls=3)["a.org"] == ("BLIND", 3, 2, 0, 0, "urls")
    assert walk(max_bytes=1)["a.org"] == ("BLIND", 0, 1, 0, 0, "bytes")
    assert sitemap.walk(domains.limit(0), fetched).count() == 0


def test_report_states(spark):
    text = '{"backlinks":{"authorityScore":{"value":null},"backlinksHistory":[{"displayDate":"2024-01","backlinks":5}]},"visitorEngagement":{"visible":false,"visits":{"value":null},"bounceRate":{"value":0.4}},"searchTraffic":{"organic":{"value":null}}}'
    rows = spark.createDataFrame([("a", text), ("b", "no json"), ("c", None)], "domain string, report string")
    found = {(r.domain, r.metric, r.subject): (r.value, r.state) for r in report.report_metrics(rows, "domain", "report").collect()}
    assert found["a", "authority", None] == (None, "BLIND") and found["a", "backlinks@", "2024-01"] == (5.0, "MEASURED")
    assert found["a", "visits", None] == (None, "BLIND") and found["a", "bounce_rate", None] == (0.4, "MEASURED")
    assert found["a", "organic_visits", None] == (None, "ABSENT") and ("a", "section_summary", None) in found and ("a", "section_backlinks", None) not in found
    assert sum(k[0] == "b" for k in found) == sum(k[0] == "c" for k in found) == len(report.SECTIONS)


def test_price_after_wide_signs(spark):
    """Signs outside the basic plane are one character each where text is cut: the price is found where it stands."""
    at = lambda gap: one(spark, H.spam_signals(F.lit("a.org"), F.lit("😀" * 300 + " a link costs " + gap + "$150 only " + "y" * 900), F.lit(0), F.lit(0), F.lit(5000), F.lit(200)).alias("x"))["x"]
    assert [s["code"] for s in at("")] == ["price_near_link"] and at("." * 200) == []


def test_links_of_a_page_without_host(spark):
    """Every link leaves a page whose address has no host; with one, its own links stay out."""
    hosts = one(spark, *[H.external_hosts(F.lit('<a href="https://b.org/x">x</a><a href="https://www.a.org/">y</a><a href="/z">z</a>'), F.lit(d).cast("string")).alias(n) for n, d in (("none", None), ("own", "a.org"))])
    assert sorted(hosts["none"]) == ["a.org", "b.org"] and hosts["own"] == ["b.org"]


def test_size_of_a_page_is_its_own(spark):
    """The query gives links to other sites to its pages; a page of under 100,000 bytes is not larger for that."""
    html = "<script>" + "x" * 99_900 + '</script><a href="/p">p</a><a href="/q">q</a>'
    assert len(html) < 100_000
    pages = spark.createDataFrame([(1, "https://a.org/", html, "nofollow"), (7, None, "y" * 200 + html, "nofollow")], "page_id long, url string, html string, rel string")
    codes = {r["page_id"]: [s["code"] for s in r["signals"]] for r in spam_inputs(pages).collect()}
    assert codes == {1: ["link_ratio", "thin"], 7: []}


def test_odd_reports(spark):
    """Sections of other kinds, lists within lists, numbers as text, histories without figures."""
    texts = {
        "null": '{"backlinks":null,"keywords":[1],"searchTraffic":"x"}', "text": '{"backlinks":{"visible":"false","backlinks":{"value":"12"}},"competitors":{"items":[{"slug":7,"visits":"3"},null,[1]]}}',
        "bare": '{"visitorEngagement":{"visits":{},"visitsHistory":[{"displayDate":"d"},{"visits":null}]},"trafficByCountry":{"series":{"country":"fr"}}}',
    }
    rows = spark.createDataFrame(list(texts.items()), "domain string, report string")
    found = {(r.domain, r.metric, r.subject): (r.value, r.state) for r in report.report_metrics(rows, "domain", "report").collect()}
    assert found["null", "authority", None] == (None, "ABSENT") and found["null", "organic_visits", None] == (None, "ABSENT") and ("null", "section_summary", None) in found
    assert found["text", "backlinks", None] == (12.0, "MEASURED") and found["text", "authority", None] == (None, "BLIND") and found["text", "section_backlinks", None] == (None, "BLIND")
    assert found["text", "competitor_visits", "7"] == (3.0, "MEASURED") and found["text", "competitor_visits", "unknown"] == (None, "ABSENT")
    assert found["bare", "visits", None] == (None, "ABSENT") and found["bare", "visits@", "d"] == (None, "ABSENT") and not any(k[1] == "country_visits" for k in found)


def test_reports_of_a_small_file_are_shared_out(spark, sf_dir):
    """The ranks are one file of some kilobytes, which is read by one task; their reports must not be."""
    assert spark.read.parquet(f"{sf_dir}/part.parquet").rdd.getNumPartitions() == 1
    assert registry.QUERIES["scan_report_json"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_store_keeps_what_it_replaces(spark, tmp_path):
    store = JournalStore(spark, f"file://{tmp_path}/j")
    rows = spark.createDataFrame([(1, "a", "m", "s", "MEASURED", 1.0, "x"), (2, "a", "m", "s", "MEASURED", 2.0, "x"), (3, "b", "m", "s", "BLIND", None, None)], "seq long, domain string, metric string, source string, state string, value double, obs_id string").withColumn("measured_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    store.append(rows)
    store.append(rows)
    assert store.read().count() == 3
    assert store.compact() == {"before": 3, "after": 2}
    done = store.purge(F.col("value") > 1.5, "wrong")
    assert (done["before"], done["removed"]) == (2, 1) and spark.read.parquet(done["backup"]).count() == 2
    assert [r.seq for r in store.read().collect()] == [3] and spark.read.json(f"{store.path}/PURGES").first()["reason"] == "wrong"


def fails_on_seven(rows):
    if any(r[0] == 7 for r in rows):
        raise ValueError("seven")


def test_lost_batches_are_reported(spark):
    told = write_batches(spark.range(20).selectExpr("id", "id as b"), fails_on_seven, most=10).collect()
    assert sum(r.n_rows for r in told) == 20 and max(r.n_rows for r in told) <= 5
    assert [r.error for r in told if not r.written] == ["seven"]


def test_small_parsers(spark, tmp_path):
    lines = spark.createDataFrame([("A.org; 1 200",), ("a.org;7",), ("own.org;9",), ("bad;1",), ("b.org;x",)], "value string")
    assert {r.domain: r.links for r in P.parse_referrers(lines, "own.org").collect()} == {"a.org": 1200}
    (tmp_path / "r.csv").write_text('Global Rank,Do_main,Note\n7,a.org,"x ""y"", z"\n8,b.org,\n')
    read = P.read_rank_csv(spark, f"file://{tmp_path}/r.csv", {"globalrank": "rank", "domain": "domain", "note": "note"})
    assert [tuple(r) for r in read.orderBy("rank").collect()] == [("7", "a.org", 'x "y", z'), ("8", "b.org", None)]
    (tmp_path / "e").write_text("1\t2\nbroken\n")
    assert P.read_edges(spark, f"file://{tmp_path}/e", 5).count() == 1
    with pytest.raises(ValueError):
        P.read_edges(spark, f"file://{tmp_path}/e", 500)
    days = lambda a: one(spark, P.days_between(F.lit(a), F.lit("2024-01-03T00:00:00Z")).alias("x"))["x"]
    assert days("2024-01-01T12:00:00Z") == 2 and days("2024-01-01T13:00:00Z") == 1 and days("no date") is None


def test_states_only_move_on(spark):
    start = spark.createDataFrame([("t", "p", "waiting"), ("t", "q", "waiting"), ("t", "r", "wall")], "task string, page string, state string")
    read = spark.createDataFrame([("t", "p", 2, 200, 1, 1), ("t", "p", 1, 200, 0, 1), ("t", "r", 3, 200, 1, 1), ("t", "new", 4, None, 0, 0)], "task string, page string, seq int, http int, links int, mentions int")
    after = TM.step(start, read)
    assert {r.page: r.state for r in after.collect()} == {"p": "mention", "q": "waiting", "r": "wall", "new": "wall"}
    tasks = spark.createDataFrame([("t",), ("idle",)], "task string")
    assert {r.task: (r.state, r.n_waiting) for r in TM.task_states(tasks, after).collect()} == {"t": ("verification", 1), "idle": ("waiting", 0)}
    assert TM.task_states(tasks, TM.step(after, read.withColumn("page", F.lit("q")))).filter("task = 't'").first().state == "done"
