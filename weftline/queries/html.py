"""HTML, URL, robots and text queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import urls as U
from weftline.queries.registry import query
from weftline.sources import parsers as P

c = F.col
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
#: Pages whose relative links become links to other sites with a rel, so that link queries see all kinds.
EXTERNAL = "replace(html, 'href=\"/', 'rel=\"' || coalesce(rel, '') || '\" href=\"https://site' || (page_id * 7 % 23) || '.org/a&amp;b')"


def external(p):
    return p.withColumn("html", F.replace(c("html"), F.lit('href="/'), F.concat(F.lit('rel="'), F.coalesce("rel", F.lit("")), F.lit('" href="https://site'), c("page_id") * 7 % 23, F.lit(".org/a&amp;b"))))


@query("host_of", "v_pages", sql=f"SELECT page_id, {HOST} AS host FROM v_pages")
def host_of(p):
    return p.select("page_id", U.host_of(c("url")).alias("host"))


@query("path_depth", "v_pages", sql=f"SELECT page_id, len(list_filter(string_split({PATH}, '/'), lambda x: x <> '')) AS depth FROM v_pages")
def path_depth(p):
    return p.select("page_id", U.path_depth(c("url")).alias("depth"))


FOLDER = f"regexp_replace({PATH}, '[^/]*$', '')"


@query("absolutize", "v_pages", sql=f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x/y' WHEN 1 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//other.org/z'
 WHEN 2 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {FOLDER} || 'rel.html' WHEN 3 THEN 'https://abs.org/' WHEN 4 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || regexp_replace({FOLDER}, '[^/]+/$', '') || 'up.html?a=../b'
 WHEN 5 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {FOLDER} || 'same/' WHEN 6 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/top' ELSE regexp_replace(url, '#.*$', '') END AS link FROM v_pages""")  # fmt: skip
def absolutize(p):
    hrefs = ("/x/./y", "//other.org/w/../z", "rel.html", "HTTPS://ABS.org:443", "../up.html?a=../b", " ./same/x/.. ", "../../../../../top", "")
    href = F.element_at(F.array(*[F.lit(h) for h in hrefs]), (c("page_id") % 8 + 1).cast("int"))
    return p.select("page_id", U.absolutize(c("url"), href).alias("link"))


PIECES = f"pieces AS (SELECT page_id, rel AS page_rel, unnest(list_slice(string_split_regex({EXTERNAL}, '(?i)<a\\s'), 2, 100000)) AS piece FROM v_pages)"
LINKS = f"""{PIECES}, cut AS (SELECT page_id, regexp_extract(piece, '^([^>]*)>?', 1) AS tag, regexp_replace(piece, '^[^>]*>?', '') AS after FROM pieces),
 bodies AS (SELECT page_id, tag, CASE WHEN strpos(lower(substring(after, 1, 1200)), '</a') > 0 THEN substring(after, 1, strpos(lower(substring(after, 1, 1200)), '</a') - 1) ELSE substring(after, 1, 300) END AS body FROM cut),
 links AS (SELECT DISTINCT page_id, replace(regexp_extract(tag, '(?i)(?:^|\\s)href\\s*=\\s*["'']([^"'']*)["'']', 1), '&amp;', '&') AS href, lower(regexp_extract(tag, '(?i)(?:^|\\s)rel\\s*=\\s*["'']([^"'']*)["'']', 1)) AS rel,
 substring(trim(regexp_replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 160) AS anchor FROM bodies)"""


@query("links_extract", "v_pages", sql=f"WITH {LINKS} SELECT page_id, href, rel, anchor FROM links WHERE href <> ''")
def links_extract(p):
    return external(p).select("page_id", F.inline(H.links(c("html"))))


@query("links_extract_unquoted", "v_pages", sql=f"WITH {PIECES} SELECT page_id, href, count(*) AS n FROM (SELECT page_id, regexp_extract(regexp_extract(piece, '^([^>]*)', 1), '(?i)(?:^|\\s)href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1) AS href FROM pieces) WHERE href <> '' GROUP BY ALL")
def links_extract_unquoted(p):
    return external(p).select("page_id", F.explode(H.links_unquoted(c("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("links_extract_closed", "v_pages", sql=f"WITH {LINKS} SELECT page_id, least(count(*), 12) AS n FROM links WHERE anchor <> '' AND contains(lower(href), '.org/') GROUP BY page_id")
def links_extract_closed(p):
    return external(p).select("page_id", F.size(H.links_closed(c("html"), F.lit(".org/"))).cast("long").alias("n")).filter("n > 0")


@query("links_gateway", "v_pages", sql=f"WITH {LINKS} SELECT page_id, count(*) AS n FROM links WHERE href LIKE '%site7.org%' GROUP BY page_id")
def links_gateway(p):
    return external(p).select("page_id", F.explode(H.links(c("html"))).alias("l")).filter(U.true_destination(c("l.href"), F.lit("site7.org"))).groupBy("page_id").agg(F.count("*").alias("n"))


@query("rel_follow", "v_pages", sql="SELECT page_id, CASE WHEN rel IS NULL THEN 'FOLLOW' ELSE 'NOFOLLOW' END AS follow, CASE page_id % 4 WHEN 1 THEN 'nofollow' WHEN 2 THEN 'ugc' WHEN 3 THEN 'sponsored' ELSE 'dofollow' END AS kind FROM v_pages")
def rel_follow(p):
    kind = H.rel_kind(c("rel"))
    return p.select("page_id", F.when(kind == "dofollow", "FOLLOW").otherwise("NOFOLLOW").alias("follow"), kind.alias("kind"))


@query("rel_canonical", "v_pages", sql="SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'nofollow' WHEN 2 THEN 'nofollow+ugc' WHEN 3 THEN 'sponsored' ELSE 'dofollow' END AS rel FROM v_pages")
def rel_canonical(p):
    return p.select("page_id", H.rel_canonical(c("rel")).alias("rel"))


@query("external_links", "v_pages", sql=f"WITH {LINKS} SELECT DISTINCT page_id, regexp_extract(href, '^https://([^/]+)', 1) AS host FROM links WHERE href LIKE 'https://%'")
def external_links(p):
    return external(p).select("page_id", F.explode(H.external_hosts(c("html"), U.host_of(c("url")))).alias("host"))


@query("agg_distinct_external_hosts", "v_pages", sql=f"WITH {LINKS} SELECT v.page_id, count(DISTINCT regexp_extract(href, '^https://([^/]+)', 1)) FILTER (href LIKE 'https://%') AS n_hosts FROM v_pages v LEFT JOIN links USING (page_id) GROUP BY v.page_id")
def agg_distinct_external_hosts(p):
    return external(p).select("page_id", F.size(H.external_hosts(c("html"), U.host_of(c("url")))).cast("long").alias("n_hosts"))


READABLE = "trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


@query("readable_text", "v_pages", sql=f"SELECT page_id, {READABLE} AS readable FROM v_pages")
def readable_text(p):
    return p.select("page_id", H.readable_text(c("html")).alias("readable"))


@query("indexability", "v_pages", sql="SELECT page_id, noindex OR page_id % 7 = 0 AS noindex, page_id % 7 = 0 AS page_nofollow, CASE WHEN page_id % 3 = 0 THEN url END AS canonical FROM v_pages")
def indexability(p):
    meta = F.concat(F.when(c("noindex"), '<meta name="robots" content="NOINDEX, follow">').otherwise(""), F.when(c("page_id") % 3 == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).otherwise(""))
    header = F.when(c("page_id") % 7 == 0, "noindex, nofollow")
    return p.select("page_id", H.indexability(F.concat(meta, "html"), header).alias("i")).select("page_id", "i.*")


@query("robots_simple", "v_pages", sql="SELECT page_id, page_id % 4 = 0 AND page_id % 5 > 1 AS blocks_all, CASE WHEN page_id % 5 = 0 THEN 'BLIND' ELSE 'MEASURED' END AS state, CASE WHEN page_id % 5 > 1 AND page_id % 4 < 3 THEN url || ' /b.xml' ELSE '' END AS sitemaps FROM v_pages")
def robots_simple(p):
    """Whether a site may be read at all, and the sitemaps it declares."""
    text = F.when(c("page_id") % 4 == 0, "User-agent: *\nCrawl-delay: 2\nDisallow: /\n").when(c("page_id") % 4 == 1, "User-agent: bot\nDisallow: /\n").when(c("page_id") % 4 == 2, "User-agent: *\nDisallow: /private\n").otherwise("")
    http = F.when(c("page_id") % 5 == 0, 503).when(c("page_id") % 5 == 1, 404).otherwise(200)
    text = F.when(text != "", F.concat(text, F.lit("\nSitemap: "), "url", F.lit("\n#Sitemap: /no.xml\n  sitemap:/b.xml \n"))).otherwise(text)
    return p.select("page_id", H.robots_summary(text, http).alias("r")).select("page_id", "r.blocks_all", "r.state", F.array_join("r.sitemaps", " ").alias("sitemaps"))


#: robots.txt of the pages' sites: agents that share a group, another group, comments, a joker, an end, an empty rule.
ROBOTS = "# site\nUser-agent: bot\nDisallow: /\n\nUser-agent: other\nuser-agent: *  # all\nDisallow: /private # not here\nAllow: /private/open\nCrawl-delay: 3\nDisallow: /*.pdf$\nDisallow: /en\nAllow: /en/4\nDisallow:\n\nUser-agent: *\nDisallow: /late\n"


@query("robots_longest_match", "v_pages", sql=f"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/private/open/' || page_id WHEN 1 THEN '/private/x' WHEN 2 THEN '/f' || page_id || '.pdf' WHEN 3 THEN '/a.pdf?x' WHEN 4 THEN '/late' ELSE {PATH} END AS path FROM v_pages)
 SELECT page_id, page_id % 7 = 0 OR CASE WHEN path LIKE '/private/open%' THEN true WHEN path LIKE '/private%' THEN false WHEN path LIKE '%.pdf' THEN false WHEN path LIKE '/en/4%' THEN true WHEN path LIKE '/en%' THEN false ELSE true END AS allowed FROM p""")  # fmt: skip
def robots_longest_match(p):
    """The longest rule of the parsed group that matches wins; allow beats an equally long disallow."""
    m = c("page_id") % 6
    path = F.when(m == 0, F.concat(F.lit("/private/open/"), "page_id")).when(m == 1, "/private/x").when(m == 2, F.concat(F.lit("/f"), "page_id", F.lit(".pdf"))).when(m == 3, "/a.pdf?x").when(m == 4, "/late").otherwise(U.path_of(c("url")))
    text = F.when(c("page_id") % 7 != 0, ROBOTS)
    return p.select("page_id", H.robots_allowed(H.robots_rules(text), path).alias("allowed"))


@query("robots_prefix", "v_pages", sql=f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN false WHEN 1 THEN true ELSE NOT ({PATH} LIKE '/en%' OR {PATH} LIKE '/fr/8%') END AS allowed FROM v_pages")
def robots_prefix(p):
    """Plain prefixes alone forbid; a rule with a joker does not."""
    text = F.when(c("page_id") % 5 == 0, "User-agent: *\nDisallow: /\n").when(c("page_id") % 5 == 1, "User-agent: *\nDisallow: /*\nDisallow:\n\nUser-agent: bot\nDisallow: /\n").otherwise("User-agent: a\nDisallow: /fr\n\nUser-agent: *\n Disallow: /en \nDisallow: /fr/8\n")
    return p.select("page_id", H.robots_prefix_allowed(text, U.path_of(c("url"))).alias("allowed"))


def spam_inputs(p):
    host = U.host_of(c("url"))
    rows = external(p.withColumn("n_bytes", F.octet_length("html"))).select("page_id", host.alias("host"), H.readable_text(c("html")).alias("text"), H.links(c("html")).alias("links"), "n_bytes")
    rows = rows.select("page_id", "host", "text", "n_bytes", H.external_hosts_of(c("links"), c("host")).alias("hosts"))
    domain = F.when(c("page_id") % 11 == 0, "10.2.3.4").when(c("page_id") % 13 == 0, "best-nulled.xyz").when(c("page_id") % 17 == 0, "me.github.io").otherwise(c("host"))
    http = F.when(c("page_id") % 9 == 0, 403).otherwise(200)
    text = F.when(c("page_id") % 6 == 0, F.concat("text", F.lit(" we sell a guest post here"))).when(c("page_id") % 8 == 0, F.concat("text", F.lit(" a link costs $150 only"))).when(c("page_id") % 10 == 0, F.concat("text", F.lit(" casino"))).otherwise(c("text"))
    return rows.select("page_id", http.alias("http"), H.spam_signals(domain, text, F.size("hosts"), F.size(F.array_distinct("hosts")), c("n_bytes"), http).alias("signals"))


SPAM = f"""WITH {LINKS}, n AS (SELECT page_id, count(*) FILTER (href LIKE 'https://%') AS n_links FROM links GROUP BY page_id),
 t AS (SELECT page_id, octet_length(encode(html)) AS n_bytes, CASE WHEN page_id % 9 = 0 THEN 403 ELSE 200 END AS http, CASE WHEN page_id % 11 = 0 THEN '10.2.3.4' WHEN page_id % 13 = 0 THEN 'best-nulled.xyz' WHEN page_id % 17 = 0 THEN 'me.github.io' ELSE {HOST} END AS domain, {READABLE.replace('html,', EXTERNAL + ',', 1)} || CASE WHEN page_id % 6 = 0 THEN ' we sell a guest post here' WHEN page_id % 8 = 0 THEN ' a link costs $150 only' WHEN page_id % 10 = 0 THEN ' casino' ELSE '' END AS text FROM v_pages),
 u AS (SELECT t.*, octet_length(encode(text)) AS size, coalesce(n_links, 0) AS n_links, list_filter(string_split_regex(text, '[.!?]\\s'), lambda s: length(s) > 40) AS sentences FROM t LEFT JOIN n USING (page_id)),
 v AS (SELECT page_id, http, http = 200 AS r, regexp_matches(domain, '^\\d+(\\.\\d+){{3}}$') AS s1, regexp_matches(domain, '\\.(xyz|top|click|link|work)$') AS s2, domain LIKE '%.github.io' AS s3, regexp_matches(domain, '(apk|crack|nulled|warez|torrent|keygen|free-?download)') AS s4,
 CASE WHEN size < 5000 AND n_bytes > 100000 THEN NULL WHEN size > 0 THEN n_links / (size / 1024) END AS ratio, size < 900 AND NOT (size < 5000 AND n_bytes > 100000) AS thin, regexp_matches(text, '(?i)(guest\\s*post|sponsored\\s*post|paid\\s*(post|link|article)|buy\\s*(a\\s*)?link|link\\s*building\\s*service|insertion\\s*de\\s*lien|article\\s*sponsoris|achat\\s*de\\s*lien|publication\\s*payante)') AS sells, regexp_matches(text, 'link costs \\$150') AS price, regexp_matches(substring(text, 1, 40000), '(?i)(casino|betting|poker|viagra|cialis|escort|porn|xxx)') AS off,
 len(sentences) > 12 AND 1 - len(list_distinct(list_transform(sentences, lambda s: substring(s, 1, 60)))) / len(sentences) > 0.35 AS rep FROM u),
 w AS (SELECT page_id, http, (CASE WHEN s1 THEN 30 ELSE 0 END + CASE WHEN s2 THEN 10 ELSE 0 END + CASE WHEN s3 THEN 8 ELSE 0 END + CASE WHEN s4 THEN 35 ELSE 0 END + CASE WHEN r AND ratio > 12 THEN 25 WHEN r AND ratio > 6 THEN 12 ELSE 0 END + CASE WHEN r AND thin THEN 15 ELSE 0 END + CASE WHEN r AND sells THEN 40 WHEN r AND price THEN 22 ELSE 0 END + CASE WHEN r AND off THEN 25 ELSE 0 END + CASE WHEN r AND rep THEN 18 ELSE 0 END) AS total FROM v)"""


@query("spam_signals", "v_pages", sql=f"{SPAM} SELECT page_id, CAST(least(100, total) AS BIGINT) AS score FROM w")
def spam_signals(p):
    return spam_inputs(p).select("page_id", H.spam_score(c("signals")).cast("long").alias("score"))


@query("spam_verdict", "v_pages", sql=f"{SPAM} SELECT CASE WHEN http <> 200 THEN 'UNREAD' WHEN total >= 55 THEN 'SPAM' WHEN total >= 25 THEN 'DOUBTFUL' ELSE 'CLEAN' END AS verdict, count(*) AS n FROM w GROUP BY ALL")
def spam_verdict(p):
    return spam_inputs(p).select(H.spam_verdict(H.spam_score(c("signals")), c("http")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


NORMAL = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_text", "v_texts", sql=f"SELECT doc_id, sha256({NORMAL}) AS digest, CAST(length({NORMAL}) AS BIGINT) AS n FROM v_texts")
def normalize_text(t):
    return t.select("doc_id", H.normalize_text(c("text")).alias("x")).select("doc_id", F.sha2("x", 256).alias("digest"), F.length("x").cast("long").alias("n"))


@query("strip_host", "v_pages", sql="SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'partners ' || page_id ELSE 'about us' END AS slug FROM v_pages")
def strip_host(p):
    slug = F.when(c("page_id") % 2 == 0, F.concat(F.lit("tradehub partners "), "page_id")).otherwise("about tradehub us")
    return p.select("page_id", H.strip_host(slug, F.lit("tradehub.com")).alias("slug"))


TERMS_1, TERMS_2 = ("tion", "ment", "schaft", "ando"), ("the", "eau", "ung", "cion", "ver")


@query("terms_found", "v_texts", sql=f"SELECT doc_id, list_sort(list_filter({list(TERMS_1 + TERMS_2)}, lambda t: contains({NORMAL}, t))) AS terms FROM v_texts".replace("AS terms", "AS t") .replace("SELECT doc_id, list_sort", "SELECT doc_id, array_to_string(list_sort").replace(") AS t ", "), ',') AS terms "))
def terms_found(t):
    x = t.select("doc_id", H.normalize_text(c("text")).alias("x"))
    return x.select("doc_id", F.array_join(F.array_sort(H.terms_found(c("x"), TERMS_1 + TERMS_2)), ",").alias("terms"))


@query("coherence_page", "v_texts", sql=f"SELECT doc_id, round(100 * least(1, len(list_filter({list(TERMS_1)}, lambda t: contains({NORMAL}, t))) / 12 + 0.4::DOUBLE * len(list_filter({list(TERMS_2)}, lambda t: contains({NORMAL}, t))) / 12), 6) AS coherence FROM v_texts")
def coherence_page(t):
    x = t.select("doc_id", H.normalize_text(c("text")).alias("x"))
    n1, n2 = F.size(H.terms_found(c("x"), TERMS_1)), F.size(F.array_except(H.terms_found(c("x"), TERMS_2), H.terms_found(c("x"), TERMS_1)))
    return x.select("doc_id", F.round(100 * F.least(F.lit(1.0), n1 / 12 + 0.4 * n2 / 12), 6).alias("coherence"))


@query("coherence_site", "v_texts", sql=f"WITH s AS (SELECT source, len(list_filter({list(TERMS_1)}, lambda t: contains({NORMAL}, t))) > 0 AS h1, len(list_filter({list(TERMS_2)}, lambda t: contains({NORMAL}, t))) > 0 AS h2 FROM v_texts) SELECT source, round(100 * least(1, avg(CASE WHEN h1 THEN 1 ELSE 0 END) + 0.4 * avg(CASE WHEN h2 AND NOT h1 THEN 1 ELSE 0 END)), 6) AS coherence FROM s GROUP BY source")
def coherence_site(t):
    x = t.select("source", H.normalize_text(c("text")).alias("x"))
    h1, h2 = F.size(H.terms_found(c("x"), TERMS_1)) > 0, F.size(H.terms_found(c("x"), TERMS_2)) > 0
    part = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    return x.groupBy("source").agg(F.round(100 * F.least(F.lit(1.0), part(h1) + 0.4 * part(h2 & ~h1)), 6).alias("coherence"))


@query("subject_filter", "v_texts", sql="SELECT lang, count(*) AS n FROM v_texts WHERE contains(substring(lower(text), 1, 60000), 'tionst') OR contains(substring(lower(text), 1, 60000), 'eaumen') GROUP BY lang")
def subject_filter(t):
    return t.filter(H.on_subject(c("text"), ("tionst", "eaumen"))).groupBy("lang").agg(F.count("*").alias("n"))


@query("candidate_neighbourhood", "v_pages", sql="SELECT page_id, page_id % 3 = 0 AS near FROM v_pages")
def candidate_neighbourhood(p):
    gap = F.when(c("page_id") % 3 == 0, F.lpad(F.lit(""), 100, "x")).otherwise(F.lpad(F.lit(""), 4000, "x"))
    text = F.concat(F.lit("see https://cand.org/a "), gap, F.lit(" target.com "), F.lpad(F.lit(""), 2000, "y"))
    return p.select("page_id", F.array_contains(H.near_target(text, F.lit("target.com")), "https://cand.org/a").alias("near"))


@query("unwrap_redirect", "v_pages", sql="SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://go.net/?x=' || page_id ELSE 'https://t.org/' || page_id END AS target FROM v_pages")
def unwrap_redirect(p):
    encoded = F.url_encode(c("url"))
    wrapped = F.when(c("page_id") % 3 == 0, F.concat(F.lit("https://go.net/l?a=1&uddg="), encoded)).when(c("page_id") % 3 == 1, F.concat(F.lit("https://go.net/?x="), "page_id")).otherwise(F.concat(F.lit("https://go.net/?q=word&u=https%3A%2F%2Ft.org%2F"), "page_id"))
    return p.select("page_id", U.unwrap_redirect(wrapped).alias("target"))


@query("engine_answered", "v_pages", sql="SELECT page_id, strpos(lower(substring(html, 901)), 'article') > 0 AS answered FROM v_pages")
def engine_answered(p):
    return p.select("page_id", H.engine_answered(c("html"), F.lit("Article")).alias("answered"))


LIKELY = "replace(html, 'href=\"/', 'href=\"/' || CASE page_id % 3 WHEN 0 THEN 'Blog/' WHEN 1 THEN 'a-propos/' ELSE 'x/' END)"
LIKELY_WORDS = "(?i)(partenaire|partner|integration|ecosyst|marketplace|annuaire|director|outil|tool|app|logiciel|software|ressource|resource|avis|review|comparat|alternativ|lien|link|blog|actualit|news|presse|press|a-propos|about|nos-|our-)"


@query("internal_likely", "v_pages", sql=f"""WITH h AS (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all({LIKELY}, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) AS href, unnest(range(1, len(regexp_extract_all({LIKELY}, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) + 1)) AS i FROM v_pages),
 u AS (SELECT page_id, min(i) AS i, 'https://' || host || regexp_extract(href, '^([^?#]*)', 1) AS href FROM h WHERE href LIKE '/%' AND href NOT LIKE '//%' AND length(regexp_extract(href, '^([^?#]*)', 1)) <= 90 AND regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '{LIKELY_WORDS}') AND NOT regexp_matches(href, '(?i)\\.(jpe?g|png|gif|webp|svg|pdf|zip|css|js|ico)$') GROUP BY ALL)
 SELECT page_id, href FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 4""")  # fmt: skip
def internal_likely(p):
    """Up to four internal links, in the order of the page, whose path looks like a page of links."""
    word = F.when(c("page_id") % 3 == 0, "Blog/").when(c("page_id") % 3 == 1, "a-propos/").otherwise("x/")
    html = F.replace(c("html"), F.lit('href="/'), F.concat(F.lit('href="/'), word))
    return p.select("page_id", F.explode(H.internal_likely(html, U.host_of(c("url")))).alias("href"))


@query("uule", "v_pages", sql="SELECT page_id, 'w+CAIQICI' || substring('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', 1 + length('Paris,' || url) % 64, 1) || to_base64(encode('Paris,' || url)) AS uule FROM v_pages")
def uule(p):
    return p.select("page_id", U.uule(F.concat(F.lit("Paris,"), "url")).alias("uule"))


@query("ts14_to_iso", "v_queue", sql="SELECT seq, CASE WHEN seq % 9 <> 0 THEN strftime(taken_at, '%Y-%m-%dT%H:%M:%SZ') END AS iso FROM v_queue")
def ts14_to_iso(q):
    """14-digit archive times; anything else is null."""
    text = F.when(c("seq") % 9 == 0, "2024-01").otherwise(F.date_format("taken_at", "yyyyMMddHHmmss"))
    return q.select("seq", P.iso_utc(P.timestamp14(F.when(text.rlike("^[0-9]{14}$"), text))).alias("iso"))


@query("iso_utc", "v_queue", sql="SELECT seq, strftime(taken_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM v_queue")
def iso_utc(q):
    return q.select("seq", P.iso_utc(c("taken_at")).alias("iso"))


@query("days_between", "v_queue", sql="SELECT seq, CAST(floor((epoch(TIMESTAMP '2024-02-10 12:00:00') - floor(epoch(taken_at))) / 86400 + 0.5) AS BIGINT) AS days FROM v_queue")
def days_between(q):
    """Days since an ISO time, rounded: half a day counts as one."""
    return q.select("seq", P.days_between(P.iso_utc(c("taken_at")), F.lit("2024-02-10T12:00:00Z")).alias("days"))
