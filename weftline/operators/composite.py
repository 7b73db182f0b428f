"""Weighted composites over parts that may be unmeasured.

Parts are rows in long form (key, comp, w, v, state, lo, hi, part). The value is renormalised over the known
parts; the range takes every active part, a blind one at its bounds; the measured share is weighted. One hash
aggregation, no UDF: it scales as any group-by does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.tristate import ABSENT, BLIND, MEASURED, clamp, js_round, known


def aggregate(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, value, low, high, share): null value where nothing is known; weight 0 takes a part out."""
    active = F.col("w") > 0
    ok = known(F.col("v"), F.col("state"), F.col("w"))
    w, v = F.col("w"), F.col("v")
    total = F.sum(F.when(active, w))
    sums = parts.groupBy(*keys).agg(
        (F.sum(F.when(ok, w * v)) / F.sum(F.when(ok, w))).alias("value"),
        (F.sum(F.when(active, w * F.when(ok, v).otherwise(F.col("lo")))) / total).alias("low"),
        (F.sum(F.when(active, w * F.when(ok, v).otherwise(F.col("hi")))) / total).alias("high"),
        F.coalesce(F.sum(F.when(active, w * F.col("part"))) / total, F.lit(0.0)).alias("share"),
    )
    return sums.withColumn("low", F.least("low", "value")).withColumn("high", F.greatest("high", "value"))


def combine(*parts: tuple[float, Column, Column | float, Column | float]) -> tuple[Column, Column, Column]:
    """(value, low, high) of parts (weight, value or null, low, high) inside a component: the value is renormalised
    over the known ones, the bounds are not; a known part has one point, unless its bounds are Columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v, _, _ in parts), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for w, v, _, _ in parts), F.lit(0.0)) / F.when(weight > 0, weight)
    bound = lambda i: sum(((lit(p[i]) if isinstance(p[i], Column) else F.coalesce(p[1], lit(p[i]))) * p[0] for p in parts), F.lit(0.0))
    return value, bound(2), bound(3)


def part(value: Column, state: Column, low: Column, high: Column) -> Column:
    return F.struct(value.alias("value"), state.alias("state"), low.alias("low"), high.alias("high"))


def point(value: Column | float, state: str) -> Column:
    v = value if isinstance(value, Column) else F.lit(float(value))
    return part(v, F.lit(state), v, v)


def whole(value: float | None) -> Column:
    """A blind part that may be anything from 0 to 100, with a working value."""
    return part(F.lit(value).cast("double"), F.lit(BLIND), F.lit(0.0), F.lit(100.0))


# -- inputs of components --------------------------------------------------------------------------
def position_weight(position: Column) -> Column:
    """Worth of a rank; fixed values by band."""
    p = position
    return (
        F.when(p.isNull() | (p < 1), 0.0).when(p == 1, 0.28).when(p == 2, 0.15).when(p == 3, 0.10).when(p <= 6, 0.06).when(p <= 10, 0.02).when(p <= 20, 0.005).otherwise(0.0)
    )


# The thresholds and weights below.
def popularity(rank: Column, http: Column, asked: Column) -> Column:
    """A rank on a log scale, 1 to a million: 100 to 0."""
    score = 100 * clamp((6 - F.log10(rank)) / 4, 0, 1)
    return F.when((http != 200) | ~asked, whole(20.0)).when(rank.isNull(), point(5.0, ABSENT)).otherwise(point(score, MEASURED))


def visibility(weights: Column, divisor: float) -> Column:
    """100 at a sum of position weights of ``divisor`` (3 for a page, 8 for a pool)."""
    return F.when(weights.isNotNull(), 100 * F.least(F.lit(1.0), weights / divisor))


def page_traffic(serp_weights: Column, rank: Column, http: Column, asked: Column) -> Column:
    """T: 0.60 visibility of the page, 0.40 popularity of its domain."""
    tr = popularity(rank, http, asked)
    value, low, high = combine((0.60, visibility(serp_weights, 3), 0, 100), (0.40, tr["value"], tr["low"], tr["high"]))
    return part(value, F.when(serp_weights.isNotNull() & (tr["state"] != BLIND), MEASURED).otherwise(BLIND), low, high)


def coherence(page: Column, site: Column) -> Column:
    """C: 0.65 page, 0.35 site; with one unknown the other stands in, with a wide range."""
    both = point(0.65 * page + 0.35 * site, MEASURED)
    only_page = part(page, F.lit(BLIND), 0.65 * page, 0.65 * page + 35)
    only_site = part(site, F.lit(BLIND), 0.35 * site, 0.35 * site + 65)
    return F.when(page.isNotNull() & site.isNotNull(), both).when(page.isNotNull(), only_page).when(site.isNotNull(), only_site).otherwise(whole(None))


# The thresholds and weights below.
def authors(editorial: Column, distinct: Column, verifiable: Column, pseudonym: Column, pages: Column) -> tuple[Column, Column]:
    """(A, weight): below 30 editorial pages the component leaves the score."""
    one = F.when(pseudonym & ~verifiable, 5.0).when(pages > 800, 30.0).otherwise(60.0)
    score = F.when(distinct >= 4, 100.0).when(distinct == 3, 85.0).when(distinct == 2, 70.0).when(distinct == 1, one).when(verifiable, 45.0).otherwise(10.0)
    blind = part(F.lit(50.0), F.lit(BLIND), F.lit(5.0), F.lit(100.0))
    few = editorial < 30
    value = F.when(few, point(F.lit(0.0), ABSENT)).when(distinct.isNull(), blind).otherwise(point(score, MEASURED))
    return value, F.when(few, 0.0).otherwise(18.0)


# The thresholds and weights below.
def depth(source_depth: Column, external: Column, deep: Column) -> Column:
    """P: 0.40 depth of the page, 0.35 room left by its external links, 0.25 depth of the destination."""
    d = F.when(source_depth >= 2, 100.0).when(source_depth == 1, 70.0).when(source_depth.isNotNull(), 40.0)
    s = F.when(external.isNotNull(), 100 * clamp(1 - (external - 5) / 95, 0, 1))
    t = F.when(deep, 100.0).when(deep.isNotNull(), 55.0)
    value, low, high = combine((0.40, d, 40, 100), (0.35, s, 0, 100), (0.25, t, 55, 100))
    ok = d.isNotNull() & s.isNotNull() & t.isNotNull()
    return part(value, F.when(ok, MEASURED).otherwise(BLIND), F.least(low, value), F.greatest(high, value))


# The thresholds and weights below.
def transmission(read: Column, in_html: Column, rel: Column, noindex: Column, robots_ok: Column, indexed: Column, seen: Column) -> Column:
    """What a link passes on: of all rules that apply, the lowest. Nulls are unknown. Blind where an uncertain rule
    could still go below the winner."""
    made = lambda v, lo, hi, u: F.struct(F.lit(v).alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(u).alias("u"))
    rule = lambda when, value: F.when(when, made(value, value, value, False))
    true = lambda c: F.coalesce(c, F.lit(False))
    rel = F.coalesce(F.lower(rel), F.lit(""))
    page = (
        F.when(true(noindex) | true(~robots_ok), made(0.05, 0.05, 0.05, False))
        .when(true(indexed), made(1.0, 1.0, 1.0, False))
        .when(true(~indexed) & true(seen), made(0.45, 0.45, 0.45, False))
        .otherwise(made(0.70, 0.05, 1.0, True))
    )
    rules = F.array_compact(F.array(rule(true(~in_html), 0.0), rule(rel.contains("sponsored"), 0.15), rule(rel.contains("ugc"), 0.15), rule(rel.contains("nofollow"), 0.10), page))
    win = F.array_min(F.transform(rules, lambda r: r["v"]))
    unsure = F.exists(rules, lambda r: r["u"] & (r["lo"] < win))
    low, high = F.array_min(F.transform(rules, lambda r: r["lo"])), F.array_min(F.transform(rules, lambda r: r["hi"]))
    return F.when(~read, part(F.lit(0.70), F.lit(BLIND), F.lit(0.0), F.lit(1.0))).otherwise(part(win, F.when(unsure, BLIND).otherwise(MEASURED), low, high))


# The thresholds and weights below.
def malus(http: Column, disavowed: Column, price: Column, sponsoring: Column, farm: Column) -> Column:
    """Factor for link selling; looked for only on pages that answer 200, but a disavowal counts always."""
    return (
        F.when(disavowed, point(0.05, MEASURED))
        .when(F.coalesce(http, F.lit(0)) != 200, part(F.lit(1.0), F.lit(BLIND), F.lit(0.05), F.lit(1.0)))
        .when(price & farm, point(0.20, MEASURED))
        .when(price, point(0.55, MEASURED))
        .when(sponsoring, point(0.70, MEASURED))
        .otherwise(point(1.0, MEASURED))
    )


# The thresholds and weights below.
def link_class(score: Column, displayable: Column, passed: Column) -> Column:
    return (
        F.when(score.isNull() | ~displayable, "UNRATED").when(score >= 35, "USEFUL").when(score >= 15, "NEUTRAL").when(passed >= 0.40, "TOXIC").otherwise("NEUTRAL")
    )


LINK_WEIGHTS = {"T": 40.0, "C": 22.0, "P": 20.0}  # fixed values; A weighs 18 or 0


def link_parts(df: DataFrame, key: str, components: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Long form of components {name: (part, weight)}; values are rounded to two decimals before they are added."""
    staged = df.select(key, *[x for n, (p, w) in components.items() for x in (p.alias(f"_{n}"), w.alias(f"_{n}_w"))])  # each part is worked out once
    rows = [
        F.struct(
            F.lit(n).alias("comp"), F.col(f"_{n}_w").alias("w"), js_round(F.col(f"_{n}.value"), 2).alias("v"), F.col(f"_{n}.state").alias("state"), F.col(f"_{n}.low").alias("lo"), F.col(f"_{n}.high").alias("hi"),
            F.when(F.col(f"_{n}.state") == BLIND, 0.0).otherwise(1.0).alias("part"),
        )
        for n in components
    ]
    return staged.select(key, F.inline(F.array(*rows)))


def link_score(base: DataFrame, multipliers: DataFrame, key: str) -> DataFrame:
    """NL: base x transmission x malus, with the range and the measured share; an unread multiplier still
    multiplies with its working value but lowers the share: both known 1, one 0.80, none 0.65."""
    t, m = F.col("t"), F.col("m")
    blind = (t["state"] == BLIND).cast("int") + (m["state"] == BLIND).cast("int")
    share = F.col("share") * F.when(blind == 0, 1.0).when(blind == 1, 0.80).otherwise(0.65)
    rows = base.join(multipliers, key).select(
        key,
        (F.col("value") * t["value"] * m["value"]).alias("score"),
        (F.col("low") * t["low"] * m["low"]).alias("low"),
        (F.col("high") * t["high"] * m["high"]).alias("high"),
        share.alias("share"),
        t["value"].alias("passed"),
    )
    return rows.withColumn("class", link_class(F.col("score"), F.col("share") >= 0.60, F.col("passed")))


def domain_mass(score: Column) -> Column:
    """Over the links of one domain: squares of their scores, the best one fully and the others a quarter. As 0.25 of the
    sum and 0.75 of the maximum it needs no order, so it is added up before any shuffle."""
    square = F.pow(score / 100, F.lit(2.0))
    return 0.25 * F.sum(square) + 0.75 * F.max(square)


def quadratic_mass(links: DataFrame, key: str, domain: str, score: Column) -> DataFrame:
    """(key, mass) of links (key, domain) with a ``score``."""
    by_domain = links.groupBy(key, domain).agg(domain_mass(score).alias("mass"))
    return by_domain.groupBy(key).agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"))


def acquired_authority(links: DataFrame, key: str, known_referrers: DataFrame | None = None) -> DataFrame:
    """AA of each ``key`` from rated links (key, domain, nl, class, disavowed). Only a domain's best useful link counts
    fully, the others a quarter; toxic links above a share of 15 % shrink all. ``known_referrers`` (key, known)
    widens the range by the referrers nobody has read."""
    rated = F.col("class") != "UNRATED"
    useful = F.col("class") == "USEFUL"
    by_domain = links.groupBy(key, "domain").agg(
        domain_mass(F.when(useful, F.col("nl"))).alias("mass"),
        F.sum(F.when(useful, F.col("nl"))).alias("nl"),
        F.count(F.when(useful, 1)).alias("n_useful"),
        F.sum(F.when(F.col("class") == "TOXIC", F.when(F.col("disavowed"), 0.25).otherwise(1.0)).otherwise(0.0)).alias("toxic"),
        F.count(F.when(rated, 1)).alias("rated"),
        F.count(F.when(~rated, 1)).alias("unrated"),
    )
    sums = by_domain.groupBy(key).agg(
        F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mu"),
        F.coalesce(F.sum("nl") / F.when(F.sum("n_useful") > 0, F.sum("n_useful")), F.lit(0.0)).alias("q"),
        F.sum("toxic").alias("toxic"),
        F.sum("rated").alias("rated"),
        F.sum("unrated").alias("unrated"),
        F.count(F.when((F.col("rated") > 0) & F.col("domain").isNotNull(), 1)).alias("domains"),
    )
    sums = sums.withColumn("known", F.lit(None).cast("long")) if known_referrers is None else sums.join(known_referrers, key, "left")
    v = 100 * F.least(F.lit(1.0), F.log(1 + F.col("mu")) / F.log(F.lit(26.0)))
    shrink = lambda share: F.pow(1 - F.greatest(F.lit(0.0), share - 0.15) / 0.85, F.lit(1.5))
    force = 0.45 * F.col("q") + 0.55 * v
    value = force * shrink(F.col("toxic") / F.col("rated"))
    unknown = F.when(F.col("known").isNotNull(), F.greatest(F.lit(0), F.col("known") - F.col("domains"))).when(F.col("unrated") > 0, F.col("unrated"))
    base = F.coalesce("known", F.col("domains") + unknown)
    worst = force * shrink((F.col("toxic") + unknown) / (F.col("rated") + unknown))
    none = F.col("rated") == 0
    return sums.select(
        key,
        F.when(~none, value).alias("value"),
        F.when(none | unknown.isNull() | (unknown / base > 0.20), BLIND).otherwise(MEASURED).alias("state"),
        F.when(none, 0.0).when(unknown > 0, worst).otherwise(value).alias("low"),
        F.when(none | unknown.isNull() | (unknown > 0), 100.0).otherwise(value).alias("high"),
    )


# -- axes of a domain ------------------------------------------------------------------------------
AXES = {"TR": 0.32, "AA": 0.26, "PO": 0.17, "CO": 0.15, "ST": 0.10}  # fixed values


def axis_traffic(weights: Column, rank: Column, http: Column, asked: Column) -> Column:
    tr = popularity(rank, http, asked)
    value, low, high = combine((0.55, tr["value"], tr["low"], tr["high"]), (0.45, visibility(weights, 8), 0, 100))
    return part(value, F.when(weights.isNotNull() & (tr["state"] != BLIND), MEASURED).otherwise(BLIND), low, high)


def axis_positions(positions: DataFrame, key: str) -> DataFrame:
    """PO from (key, position, state): bands exclude each other; blind rows leave the count."""
    p, asked = F.col("position"), F.col("state") != BLIND
    ok = F.col("state") == MEASURED
    points = F.when(ok & (p <= 3), 3.0).when(ok & (p <= 10), 1.5).when(ok & (p <= 20), 0.5).otherwise(0.0)
    n = F.count(F.when(asked, 1))
    return positions.groupBy(key).agg((100 * F.sum(points) / (3 * F.when(n > 0, n))).alias("value"), n.alias("n"))


def axis_coverage(urls: Column, sitemap_ok: Column, indexable: Column) -> Column:
    volume = 100 * F.least(F.lit(1.0), F.log(1 + urls) / F.log(F.lit(1201.0)))
    at = lambda s, i: volume * (0.5 + 0.5 * F.coalesce(sitemap_ok, F.lit(s))) * (0.6 + 0.4 * F.coalesce(indexable, F.lit(i)))
    full = sitemap_ok.isNotNull() & indexable.isNotNull()
    return F.when(urls.isNull(), whole(None)).otherwise(part(at(1.0, 1.0), F.when(full, MEASURED).otherwise(BLIND), at(0.0, 0.0), at(1.0, 1.0)))


# The thresholds and weights below.
def axis_health(root_http: Column, redirects: Column, ttfb: Column, kib: Column, robots: Column, sitemap: Column, cert: Column) -> Column:
    """ST: points got of points that could be asked; nulls could not. The range is in points, as the reports have it."""
    probes = [
        (25.0, root_http, F.when((root_http == 200) & (F.coalesce(redirects, F.lit(0)) <= 1), 25.0).otherwise(0.0)),
        (20.0, ttfb, F.when(ttfb <= 600, 20.0).when(ttfb <= 1200, 15.0).when(ttfb <= 2500, 5.0).otherwise(0.0)),
        (15.0, kib, F.when(kib <= 300, 15.0).when(kib <= 600, 7.0).otherwise(0.0)),
        (15.0, robots, F.when(robots, 15.0).otherwise(0.0)),
        (15.0, sitemap, F.when(sitemap, 15.0).otherwise(0.0)),
        (10.0, cert, F.when(cert, 10.0).otherwise(0.0)),
    ]
    got = sum((F.when(x.isNotNull(), p).otherwise(0.0) for _, x, p in probes), F.lit(0.0))
    able = sum((F.when(x.isNotNull(), m).otherwise(0.0) for m, x, _ in probes), F.lit(0.0))
    value = 100 * got / F.when(able > 0, able)
    return part(value, F.when(able == 100, MEASURED).otherwise(BLIND), F.least(got, value), F.greatest(got + 100 - able, value))


ISSUER_WEIGHTS = {"POP": 35.0, "OPR": 25.0, "RES": 15.0, "PRO": 15.0, "COH": 10.0}  # fixed values


def issuer_parts(df: DataFrame, key: str, rank: Column, asked: Column, opr: Column, subnets: Column, spam: Column, on_topic: Column) -> DataFrame:
    """Long form of an issuer's parts. The open rank is capped at popularity + 25 where popularity is known."""
    pop = F.when(~asked, None).when(rank.isNull(), 5.0).otherwise(100 * clamp((6 - F.log10(rank)) / 4, 0, 1))
    open_rank = F.when(~asked, None).when(opr.isNull(), 8.0).otherwise(F.least(opr * 10, F.coalesce(pop + 25, F.lit(100.0))))
    nets = F.when(~asked, None).when(subnets.isNull(), 5.0).otherwise(F.least(F.lit(100.0), 100 * F.log10(1 + subnets) / F.log10(F.lit(20001.0))))
    clean = 100 - spam
    topic = F.when(on_topic, 100.0).otherwise(45.0)
    rows = [
        F.struct(F.lit(n).alias("comp"), F.lit(ISSUER_WEIGHTS[n]).alias("w"), v.alias("v"), F.when(v.isNull(), BLIND).otherwise(MEASURED).alias("state"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"), F.when(v.isNull(), 0.0).otherwise(1.0).alias("part"))
        for n, v in (("POP", pop), ("OPR", open_rank), ("RES", nets), ("PRO", clean), ("COH", topic))
    ]
    return df.select(key, F.inline(F.array(*rows)))


def issuer_class(score: Column) -> Column:
    return F.when(score.isNull(), "UNRATED").when(score >= 55, "SOLID").when(score >= 30, "MEDIUM").otherwise("WEAK")


def refuse_spots(domains: DataFrame, forced: bool = False) -> DataFrame:
    """``domains`` (role), raising while it runs where a role cannot be scored."""
    if forced:
        return domains
    return domains.withColumn("role", F.when(F.col("role") == "spot", F.raise_error(F.lit("a spot is no domain to score"))).otherwise(F.col("role")))


def to_facts(scores: DataFrame, key: str, metric: str) -> DataFrame:
    """Scores as journal rows: blind ones carry a null value and only their range."""
    state = F.when(F.col("value").isNull() | (F.col("share") < 0.60), BLIND).otherwise(MEASURED)
    return scores.select(F.col(key).alias("subject"), F.lit(metric).alias("metric"), F.when(state == MEASURED, F.col("value")).alias("value"), "low", "high", state.alias("state"), F.lit("derived").alias("nature"))
