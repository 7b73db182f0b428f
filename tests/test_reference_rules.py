"""Goldens worked out from the rules' text: addresses, accents, sitemaps, robots, comparisons of runs."""

import pytest
from pyspark.sql import functions as F

from tests.test_journal_rules import rows
from weftline.functions import html as H
from weftline.functions import urls as U
from weftline.operators import journal as J
from weftline.queries import registry
from weftline.sources import parsers as P
from weftline.sources import sitemap


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_uule_spells_the_length(spark):
    assert value(spark, U.uule(F.lit("Paris,Ile-de-France,France"))) == "w+CAIQICIaUGFyaXMsSWxlLWRlLUZyYW5jZSxGcmFuY2U="
    assert value(spark, U.uule(F.lit("New York,New York,United States"))) == "w+CAIQICIfTmV3IFlvcmssTmV3IFlvcmssVW5pdGVkIFN0YXRlcw=="
    assert value(spark, U.uule(F.lit("x" * 64)))[:10] == "w+CAIQICIA" and value(spark, U.uule(F.lit("é𝄞")))[9] == "D"


@pytest.mark.parametrize("text, want", [
    ("Tiếng Việt", "tieng viet"), ("journée  d’Été", "journee d ete"), ("Ångström Å", "angstrom a"), ("İstanbul ŁÓDŹ", "istanbul odz"), ("ǖ ṩ Ẅ", "u s w"), ("日本 42", "42"), ("straße", "stra e"), ("", ""),
])
def test_accents_never_cut_words(spark, text, want):
    assert value(spark, H.normalize_text(F.lit(text))) == want


def test_terms_are_sought_in_a_text_made_once(spark, sf_dir):
    """A lambda over the terms would take each text apart anew for every term."""
    plan = registry.QUERIES["terms_found"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and "lambdafunction(Contains(" not in plan and "lambdafunction(contains(" not in plan.lower()


@pytest.mark.parametrize("href, want", [
    ("../x", "https://a.org/b/x"), ("./x", "https://a.org/b/c/x"), ("../../../../x", "https://a.org/x"), ("x/../y/./z", "https://a.org/b/c/y/z"), ("..", "https://a.org/b/"), (".", "https://a.org/b/c/"), ("%2E%2e/x", "https://a.org/b/x"),
    ("?q=../a", "https://a.org/b/c/d.html?q=../a"), ("#t", "https://a.org/b/c/d.html?k=1#t"), ("", "https://a.org/b/c/d.html?k=1"), ("  /p  ", "https://a.org/p"), ("/a//b/../c", "https://a.org/a//c"), ("//B.org", "https://b.org/"),
    ("HTTP://X.org:80/y", "http://x.org/y"), ("https://x.org:8443", "https://x.org:8443/"), ("\\p\\q", "https://a.org/p/q"), ("mailto:a@b.c", "mailto:a@b.c"), ("/x\n/y", "https://a.org/x/y"), ("http://", None), ("a..b/...", "https://a.org/b/c/a..b/..."),
])
def test_addresses_are_resolved(spark, href, want):
    assert value(spark, U.absolutize(F.lit("https://a.org/b/c/d.html?k=1#frag"), F.lit(href))) == want


def test_subject_shows_early(spark):
    assert value(spark, H.on_subject(F.lit("x" * 59_996 + "Wort"), ("wort",))) and not value(spark, H.on_subject(F.lit("x" * 59_997 + "wort"), ("wort",)))


def test_robots_summary(spark):
    text = F.lit("User-agent: *\nDisallow: /\n Sitemap: https://a.org/s.xml?a&b \r\nSITEMAP:/t.xml\n# sitemap: /no\nx sitemap: /no\n")
    full = value(spark, H.robots_summary(text, F.lit(200)))
    assert (full.state, full.sitemaps, full.blocks_all) == ("MEASURED", ["https://a.org/s.xml?a&b", "/t.xml"], True)
    for http, state in ((404, "MEASURED"), (403, "BLIND"), (None, "BLIND")):
        got = value(spark, H.robots_summary(text, F.lit(http).cast("int")))
        assert (got.state, got.sitemaps, got.blocks_all) == (state, [], False)


def test_sitemap_entries_and_dates(spark):
    xml = "<urlset><url><loc>\n https://a.org/?a=1&amp;b=2 </loc><lastmod> 2024-01-02 </lastmod></url><URL><LOC>x</LOC><LASTMOD>2024-03-04T00:00:00Z</LASTMOD></URL></urlset>"
    assert value(spark, P.sitemap_entries(F.lit(xml))) == ["https://a.org/?a=1&b=2", "x"]
    assert value(spark, P.sitemap_dates(F.lit(xml))) == ["2024-01-02", "2024-03-04T00:00:00Z"]


def test_a_page_is_no_sitemap(spark):
    """A 200 that is neither kind of sitemap is a wall, not an empty site."""
    fetched = spark.createDataFrame([("s", 200, "<html>none</html>"), ("t", 200, "<urlset></urlset>"), ("u", 200, "<urlset>" + "<url><loc>p</loc><lastmod>2024-01-01</lastmod></url>" * 2 + "</urlset>")], "url string, http int, xml string")
    domains = spark.createDataFrame([("a", ["s"]), ("b", ["t"]), ("c", ["u", "s"])], "domain string, declared array<string>")
    got = {r.domain: (r.state, r.n_urls, r.n_walls, r.n_dated, r.newest) for r in sitemap.walk(domains, fetched).collect()}
    assert got == {"a": ("BLIND", 0, 1, 0, None), "b": ("ABSENT", 0, 0, 0, None), "c": ("MEASURED", 2, 1, 2, "2024-01-01")}


def test_plans_of_deep_walks_stay_short(spark):
    """A chain of 20 indexes: the last level's plan is no longer than the first's."""
    chain = [(f"s{k}", 200, f"<sitemapindex><sitemap><loc>s{k + 1}</loc></sitemap></sitemapindex>") for k in range(20)] + [("s20", 200, "<urlset><url><loc>page</loc></url></urlset>")]
    fetched = spark.createDataFrame(chain, "url string, http int, xml string")
    plans, original = [], sitemap.read_level

    def spy(queue, table):
        plans.append(len(queue._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return original(queue, table)

    sitemap.read_level = spy
    try:
        row = sitemap.walk(spark.createDataFrame([("a", ["s0"])], "domain string, declared array<string>"), fetched).first()
    finally:
        sitemap.read_level = original
    assert (row.state, row.n_urls, row.n_read) == ("MEASURED", 1, 21) and len(plans) == 21 and max(plans) <= plans[0] + 1


def test_states_of_runs(spark):
    j = rows(spark, ("a", "MEASURED", 1.0, 0, "1"), ("a", "MEASURED", 2.0, 9, "2"), ("b", "MEASURED", 1.0, 5, "1"), ("c", "MEASURED", 1.0, 0, "1"), ("c", "BLIND", None, 9, "2"))
    targets = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "domain string")
    got = {r.domain: (r.state, r.last, r.before, r.n) for r in J.run_states(targets, j, F.col("metric") == "m").collect()}
    assert got == {"a": ("compared", "2", "1", 1), "b": ("first", "1", None, 1), "c": ("silent", "2", "1", 1), "d": ("never", None, None, 0)}


def test_one_run_alone_and_a_blind_total(spark):
    j = rows(spark, ("a", "MEASURED", 1.0, 0, "1"), ("b", "MEASURED", 1.0, 0, "1"))
    assert {r.outcome for r in J.run_diff(j).collect()} == {"first"}
    two = j.unionByName(rows(spark, ("a", "MEASURED", 5.0, 9, "2"), ("t", "BLIND", None, 9, "2")))
    total = F.col("domain") == "t"
    assert {r.domain: r.outcome for r in J.run_diff(two, total=total).collect()} == {"a": "silent", "b": "silent"}
    assert {r.domain: r.outcome for r in J.run_diff(two).collect()} == {"a": "moved", "b": "gone"}
    assert J.run_diff(j.limit(0)).count() == 0
