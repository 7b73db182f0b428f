"""HTML and text functions as Columns, in the regular expressions that Java and RE2 share."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.urls import absolutize, host_of, path_of

#: What names a page or a domain as spam.
RISKY_TLDS = "tk|ml|ga|cf|gq|xyz|top|buzz|click|link|loan|work|bid|win|cam|rest|icu|monster|sbs"
FREE_HOSTS = r"blogspot\.com|wordpress\.com|weebly\.com|wixsite\.com|000webhostapp\.com|github\.io"
PIRACY = "apk|crack|nulled|warez|torrent|keygen|mod-?apk|free-?download"
SELLING = r"guest\s*post|sponsored\s*post|paid\s*(post|link|article)|buy\s*(a\s*)?link|link\s*building\s*service|insertion\s*de\s*lien|article\s*sponsoris|achat\s*de\s*lien|publication\s*payante"
PRICE = r"[$€£]\s?\d{2,5}|\d{2,5}\s?(usd|eur|€|\$)"
NEAR_SELLING = "link|post|article|guest|sponsored|lien|publication|insertion"
LINK_PAGES = "partenaire|partner|integration|ecosyst|marketplace|annuaire|director|outil|tool|app|logiciel|software|ressource|resource|avis|review|comparat|alternativ|lien|link|blog|actualit|news|presse|press|a-propos|about|nos-|our-"
NO_PAGES = "jpe?g|png|gif|webp|svg|pdf|zip|css|js|ico"
OFF_TOPIC_REACH = 40_000  #: characters of a text in which off-topic words count
OFF_TOPIC = r"casino|betting|poker|viagra|cialis|escort|porn|xxx|payday\s*loan|crypto\s*airdrop"

MARKS = "".join(map(chr, range(0x300, 0x370)))  #: combining marks, which go once letters are taken apart
#: Every letter whose canonical decomposition is a letter or digit of ASCII and such marks.
_LETTERS = {chr(c): plain for c in range(0x80, 0x30000) if chr(c) not in MARKS and len(plain := unicodedata.normalize("NFD", chr(c)).translate(dict.fromkeys(map(ord, MARKS)))) == 1 and plain.isascii() and plain.isalnum()}
ACCENTS = ("".join(_LETTERS) + MARKS, "".join(_LETTERS.values()))  #: what has no counterpart is deleted


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]*>", " ")


def readable_text(html: Column) -> Column:
    """Text without scripts, styles and tags; white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style.*?</style>", " ")
    return squeeze(F.replace(strip_tags(x), F.lit("&nbsp;"), F.lit(" ")))


def anchor_pieces(html: Column) -> Column:
    """What follows each opening ``<a``, up to the next one; links need not be closed."""
    pieces = F.split(html, r"(?i)<a\s")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag, '' without."""
    return F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def links(html: Column, reach: int = 1200, fallback: int = 300) -> Column:
    """array<struct(href, rel, anchor)> of every opening tag with a quoted href: the anchor ends at ``</a>`` within
    ``reach`` characters, else it is the first ``fallback``; distinct."""

    def one(piece: Column) -> Column:
        tag = F.regexp_extract(piece, "^([^>]*)>?", 1)
        after = F.regexp_replace(piece, "^[^>]*>?", "")
        closed = F.locate("</a", F.lower(F.substring(after, 1, reach)))
        body = F.when(closed > 0, F.substring(after, F.lit(1), closed - 1)).otherwise(F.substring(after, 1, fallback))
        href = F.replace(attribute(tag, "href"), F.lit("&amp;"), F.lit("&"))
        return F.struct(href.alias("href"), F.lower(attribute(tag, "rel")).alias("rel"), F.substring(squeeze(strip_tags(body)), 1, 160).alias("anchor"))

    return F.array_distinct(F.filter(F.transform(anchor_pieces(html), one), lambda x: x["href"] != ""))


def links_unquoted(html: Column) -> Column:
    """Hrefs with or without quotes, without fragments; page anchors and script, mail, phone and data links go."""
    hrefs = F.transform(anchor_pieces(html), lambda p: F.regexp_extract(F.regexp_extract(p, "^([^>]*)", 1), r"(?i)(?:^|\s)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
    kept = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("(?i)^(#|javascript:|mailto:|tel:|data:)") & (F.length(h) <= 500))
    return F.transform(kept, lambda h: F.regexp_replace(h, "#.*$", ""))


def links_closed(html: Column, target: Column | None = None, reach: int = 400, most: int = 12) -> Column:
    """The first ``most`` links whose ``</a>`` comes within ``reach`` characters, of those whose href names ``target``."""
    closed = F.filter(links(html, reach, 0), lambda x: x["anchor"] != "")
    return F.slice(closed if target is None else F.filter(closed, lambda x: F.contains(F.lower(x["href"]), target)), 1, most)


def internal_likely(html: Column, host: Column, most: int = 4) -> Column:
    """The first ``most`` internal pages, as absolute URLs without query, whose path promises links."""

    def page(href: Column) -> Column:
        url = absolutize(F.concat(F.lit("https://"), host, F.lit("/")), href)
        path = path_of(url)
        ok = ~href.rlike("(?i)^(#|javascript:|mailto:|tel:)") & url.rlike("(?i)^https?://") & (host_of(url) == host)
        ok = ok & (path != "/") & (F.length(path) <= 90) & path.rlike(f"(?i)({LINK_PAGES})") & ~path.rlike(rf"(?i)\.({NO_PAGES})$")
        return F.when(ok, F.concat(F.regexp_extract(url, "^([A-Za-z]+://[^/?#]*)", 1), path))

    hrefs = F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.slice(F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: page(F.trim(h))))), 1, most)


def rel_tokens(rel: Column) -> Column:
    return F.split(F.lower(F.trim(F.coalesce(rel, F.lit("")))), r"\s+")


def rel_canonical(rel: Column) -> Column:
    """nofollow, ugc and sponsored, distinct and sorted, joined by ``+``; without any, dofollow."""
    kept = F.array_sort(F.array_distinct(F.filter(rel_tokens(rel), lambda t: t.isin("nofollow", "ugc", "sponsored"))))
    return F.when(F.size(kept) == 0, "dofollow").otherwise(F.array_join(kept, "+"))


def rel_kind(rel: Column) -> Column:
    """One kind by precedence: sponsored, ugc, nofollow, dofollow."""
    t = rel_tokens(rel)
    has = lambda x: F.array_contains(t, x)
    return F.when(has("sponsored"), "sponsored").when(has("ugc"), "ugc").when(has("nofollow"), "nofollow").otherwise("dofollow")


def external_hosts(html: Column, domain: Column) -> Column:
    """Distinct hosts of absolute links that are not the page's own site."""
    return external_of(links(html), domain)


def external_of(found: Column, domain: Column) -> Column:
    """The same from the links of a page, where they are at hand."""
    return F.array_distinct(external_hosts_of(found, domain))


def external_hosts_of(found: Column, domain: Column) -> Column:
    """The host of each external link: neither the page's own nor below it. To a page without a host every link is external."""
    hosts, domain = F.transform(found, lambda x: host_of(x["href"])), F.coalesce(domain, F.lit(""))
    return F.filter(hosts, lambda h: h.isNotNull() & (h != domain) & ~F.endswith(h, F.concat(F.lit("."), domain)))


def indexability(html: Column, header: Column) -> Column:
    """struct(noindex, page_nofollow, canonical) from meta robots, the robots header and the canonical link."""
    meta = F.lower(F.regexp_extract(html, r"(?i)<meta\s+name=[\"']robots[\"']\s+content=[\"']([^\"']*)[\"']", 1))
    both = F.concat_ws(",", meta, F.lower(header))
    canonical = F.regexp_extract(html, r"(?i)<link\s+rel=[\"']canonical[\"']\s+href=[\"']([^\"']*)[\"']", 1)
    return F.struct(both.rlike(r"\bnoindex\b").alias("noindex"), both.rlike(r"\bnofollow\b").alias("page_nofollow"), F.when(canonical != "", canonical).alias("canonical"))


# -- robots ----------------------------------------------------------------------------------------
def robots_blocks_all(text: Column) -> Column:
    """Whether the group for all agents disallows the root."""
    return F.coalesce(text, F.lit("")).rlike(r"(?im)^user-agent:\s*\*\s*$(?:\s*^(?:allow|crawl-delay|disallow):[^\n]*$)*?\s*^disallow:\s*/\s*$")


ROBOTS_REACH = 200_000  #: characters of a robots.txt that are read


def robots_sitemaps(text: Column) -> Column:
    """The sitemaps that a robots.txt declares, in order, whatever group they stand in."""
    return F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, ROBOTS_REACH), F.lit(r"(?im)^\s*Sitemap:\s*(\S+)"), F.lit(1))


def robots_summary(text: Column, http: Column) -> Column:
    """struct(state, sitemaps, blocks_all): a 404 is a measure, nothing is forbidden then; any other answer than 200 is a wall
    and says nothing, whatever came with it."""
    read = F.coalesce(http == 200, F.lit(False))
    state = F.when(http.isin(200, 404), "MEASURED").otherwise("BLIND")
    return F.struct(state.alias("state"), F.when(read, robots_sitemaps(text)).otherwise(F.array().cast("array<string>")).alias("sitemaps"), (read & robots_blocks_all(F.substring(text, 1, ROBOTS_REACH))).alias("blocks_all"))


RULE = "struct<kind:string,pattern:string>"


def robots_rules(text: Column) -> Column:
    """array<struct(kind, pattern)>: the rules of the first group whose agents include ``*``. Agents that follow each other
    share a group; comments, other lines and rules before any agent say nothing. Null for no text, which allows all."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"(?i)^(user-agent|allow|disallow)\s*:")), lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:\s]+)", 1)).alias("kind"), F.regexp_extract(x, r"^[^:]*:\s*(.*)$", 1).alias("pattern")))
    start = F.struct(F.lit(False).alias("begun"), F.lit(False).alias("mine"), F.lit(False).alias("ruled"), F.lit(False).alias("done"), F.array().cast(f"array<{RULE}>").alias("rules"))

    def step(a: Column, x: Column) -> Column:
        agent, fresh = x["kind"] == "user-agent", ~a["begun"] | a["ruled"]
        star = x["pattern"] == "*"
        return F.struct(
            (a["begun"] | agent).alias("begun"),
            F.when(agent & fresh, star).when(agent, a["mine"] | star).otherwise(a["mine"]).alias("mine"),
            F.when(agent, ~fresh & a["ruled"]).otherwise(a["begun"]).alias("ruled"),
            (a["done"] | (agent & fresh & a["mine"])).alias("done"),
            F.when(~agent & a["mine"] & ~a["done"], F.array_append(a["rules"], x)).otherwise(a["rules"]).alias("rules"),
        )

    return F.when(text.isNotNull() & (text != ""), F.aggregate(pairs, start, step)["rules"])


def robots_allowed(rules: Column, path: Column) -> Column:
    """The longest rule that matches wins, allow before an equally long disallow; an empty disallow forbids nothing."""

    def regex(rule: Column) -> Column:
        ends = rule.endswith("$")
        body = F.when(ends, F.left(rule, F.length(rule) - 1)).otherwise(rule)
        body = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
        return F.concat(F.lit("^"), body, F.when(ends, "$").otherwise(""))

    live = F.filter(rules, lambda r: ((r["pattern"] != "") | (r["kind"] == "allow")) & F.rlike(path, regex(r["pattern"])))
    best = F.array_max(F.transform(live, lambda r: F.struct((F.length(r["pattern"]) + F.when(r["kind"] == "allow", 0.5).otherwise(0.0)).alias("n"), (r["kind"] == "allow").alias("ok"))))
    return F.coalesce(best["ok"], F.lit(True))


def robots_prefix_allowed(text: Column, path: Column) -> Column:
    """The careful reading: of the block of all agents only ``/`` and plain prefixes forbid, rules with ``*`` do not."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)user-agent:\s*\*(.*?)(?=\nuser-agent:|\z)", 1)
    rules = F.regexp_extract_all(block, F.lit(r"(?im)^\s*disallow:\s*(\S+)\s*$"), F.lit(1))
    return ~F.exists(rules, lambda r: (r == "/") | (~F.contains(r, F.lit("*")) & F.startswith(path, r)))


# -- spam ------------------------------------------------------------------------------------------
def spam_signals(domain: Column, text: Column, n_external: Column, n_hosts: Column, html_bytes: Column, http: Column) -> Column:
    """array<struct(code, weight)> of the signals that show. ``text`` is the readable text of the whole page."""
    read = F.coalesce(http == 200, F.lit(False)) & text.isNotNull()
    size = F.octet_length(text)
    scripted = (size < 5000) & (html_bytes > 100_000)
    ratio = F.when(~scripted & (size > 0), n_external / (size / 1024))
    around = F.split(text, f"(?i)(?:{PRICE})", 2)  # the first price alone; a place in a string would count UTF-16 units
    priced = F.length(around[0]) + 1
    start = F.greatest(F.lit(1), priced - 200)
    near_price = (F.size(around) > 1) & F.substring(text, start, priced + 200 - start).rlike(f"(?i){NEAR_SELLING}")
    sells = text.rlike(f"(?i){SELLING}")
    starts = F.transform(F.filter(F.split(text, r"[.!?]\s"), lambda s: F.length(s) > 40), lambda s: F.substring(s, 1, 60))
    repeats = (F.size(starts) > 12) & (1 - F.size(F.array_distinct(starts)) / F.size(starts) > 0.35)
    s = lambda when, code, weight: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(weight).alias("weight")))
    return F.array_compact(
        F.array(
            s(domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip_host", 30),
            s(domain.rlike(rf"(?i)\.({RISKY_TLDS})$"), "risky_tld", 10),
            s(domain.rlike(rf"(?i)\.({FREE_HOSTS})$"), "free_host", 8),
            s(domain.rlike(f"(?i)({PIRACY})"), "piracy_name", 35),
            s(read & (n_hosts >= 300), "saturated", 30),
            s(read & (n_hosts >= 120) & (n_hosts < 300), "saturated", 15),
            s(read & (ratio > 12), "link_ratio", 25),
            s(read & (ratio > 6) & (ratio <= 12), "link_ratio", 12),
            s(read & (size < 900) & ~scripted, "thin", 15),
            s(read & sells, "sells_links", 40),
            s(read & ~sells & near_price, "price_near_link", 22),
            s(read & F.substring(text, 1, OFF_TOPIC_REACH).rlike(f"(?i){OFF_TOPIC}"), "off_topic", 25),
            s(read & repeats, "repetitive", 18),
        )
    )


def spam_score(signals: Column) -> Column:
    return F.least(F.lit(100), F.aggregate(signals, F.lit(0), lambda a, x: a + x["weight"]))


def spam_verdict(score: Column, http: Column) -> Column:
    return F.when(F.coalesce(http, F.lit(0)) != 200, "UNREAD").when(score >= 55, "SPAM").when(score >= 25, "DOUBTFUL").otherwise("CLEAN")


# -- text ------------------------------------------------------------------------------------------
def normalize_text(x: Column) -> Column:
    """Lower case, without accents, all else than a-z and 0-9 a single space. Letters are taken apart and their marks deleted
    before anything becomes a space, or an accent would cut its word in two."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.lower(x), *ACCENTS)), "[^a-z0-9]+", " "))


def strip_host(slug: Column, host: Column) -> Column:
    """A slug without the labels of its own host (three letters or more, not the suffix), as substrings."""
    labels = F.split(host, r"\.")
    own = F.filter(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.length(x) >= 3)
    return squeeze(F.aggregate(own, slug, lambda s, x: F.replace(s, x, F.lit(" "))))


def terms_found(text: Column, terms: tuple[str, ...]) -> Column:
    """Distinct terms that occur as substrings. ``text`` stands outside any lambda, which would work it out once a term; give a
    column of a selection before, not an expression."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), t) for t in terms]))


SUBJECT_REACH = 60_000  #: characters of a text in which its subject must show


def on_subject(text: Column, words: tuple[str, ...]) -> Column:
    head = F.substring(F.lower(text), 1, SUBJECT_REACH)
    return F.lit(True) if not words else F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(head, w))


def near_target(html: Column, target: Column, reach: int = 1500) -> Column:
    """Hrefs that have the target's name within ``reach`` characters on either side. The text is cut at each mention,
    so its length does not matter."""
    parts = F.split(html, F.concat(F.lit(r"\Q"), target, F.lit(r"\E")))
    tail = lambda x: F.when(F.length(x) > reach, F.substring(x, -reach, reach)).otherwise(x)
    around = F.transform(parts, lambda x, i: F.concat(F.when(i > 0, F.substring(x, 1, reach)).otherwise(""), F.lit(" "), F.when(i < F.size(parts) - 1, tail(x)).otherwise("")))
    found = F.transform(around, lambda x: F.regexp_extract_all(x, F.lit("(https?://[^\"'\\s<>]+)"), F.lit(1)))
    return F.when(F.contains(html, target), F.array_distinct(F.flatten(found))).otherwise(F.array().cast("array<string>"))


def engine_answered(html: Column, brand: Column, head: int = 900) -> Column:
    """Whether a result page speaks of the brand after its own search box; brands under three letters say nothing."""
    return (F.length(brand) < 3) | (F.contains(F.lower(F.substring(html, head + 1, 2**31 - 1)), F.lower(brand)))
