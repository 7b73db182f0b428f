"""Traffic queries: estimates for every tracked position."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import traffic as T
from weftline.plans import curves as K
from weftline.queries.registry import query

c = F.col
Z2 = 2 * K.Z90
CURVE_ROWS = ", ".join(f"('{n}', '{v}', {p}, {x}::DOUBLE)" for n, v, p, x in K.all_curves())
CURVES_SQL = f"cv(curve, variant, p, v) AS (VALUES {CURVE_ROWS})"
# every distinct position (fractions included) against every curve variant
X = "x AS (SELECT DISTINCT position + (seq % 2) * 0.5::DOUBLE AS x FROM v_positions WHERE position IS NOT NULL)"
INTERP = """n AS (SELECT x, curve, variant, max(p) FILTER (p <= x) AS lo, min(p) FILTER (p >= x) AS hi FROM x, cv GROUP BY ALL),
 ip AS (SELECT n.x, n.curve, n.variant, CASE WHEN lo = hi THEN a.v ELSE exp(ln(a.v) + ln(n.x / lo) / ln(hi / lo) * ln(b.v / a.v)) END AS v, CASE WHEN lo = hi THEN 'tabulated' WHEN hi - lo > 1 THEN 'gap' ELSE 'interpolated' END AS mode
 FROM n JOIN cv a ON a.curve = n.curve AND a.variant = n.variant AND a.p = lo JOIN cv b ON b.curve = n.curve AND b.variant = n.variant AND b.p = hi)"""
FACTOR = "df AS (SELECT exp(avg(ln(g))) AS f FROM (SELECT x, max(v) / min(v) AS g FROM ip2 GROUP BY x HAVING count(*) > 1))"
RETAIN = f"""r0 AS (SELECT x, count(*) AS n, exp(avg(ln(v))) AS ctr, min(v) AS mn, max(v) AS mx FROM ip WHERE variant IN ('us', 'all') GROUP BY x),
 r AS (SELECT x, n AS curves, ctr, CASE WHEN n > 1 THEN mn ELSE ctr / sqrt({K.typical_disagreement()!r}::DOUBLE) END AS low, CASE WHEN n > 1 THEN mx ELSE ctr * sqrt({K.typical_disagreement()!r}::DOUBLE) END AS high FROM r0)"""


def positions(p):
    return p.filter("position IS NOT NULL").select((c("position") + (c("seq") % 2) * 0.5).alias("x")).distinct()


@query("ctr_curve", sql=f"WITH {CURVES_SQL} SELECT curve, variant, CAST(p AS BIGINT) AS position, v AS percent FROM cv")
def ctr_curve(spark, sf_dir):
    return spark.createDataFrame(K.all_curves(), "curve string, variant string, position long, percent double")


@query("interp_loglog", "v_positions", sql=f"WITH {CURVES_SQL}, {X}, {INTERP} SELECT x, curve, round(v, 6) AS percent, mode FROM ip WHERE variant IN ('us', 'all')")
def interp_loglog(p):
    rows = [F.struct(F.lit(n).alias("curve"), T.interpolated(curve, c("x")).alias("i")) for n, curve in K.CURVES.items()]
    found = positions(p).select("x", F.inline(F.array(*rows))).filter("i.percent IS NOT NULL")
    return found.select("x", "curve", F.round("i.percent", 6).alias("percent"), c("i.mode").alias("mode"))


@query("disagreement", "v_positions", sql=f"WITH {CURVES_SQL}, {X}, {INTERP} SELECT x, round(max(v) / min(v), 6) AS factor FROM ip WHERE variant IN ('us', 'all') GROUP BY x")
def disagreement(p):
    return positions(p).select("x", T.percents(K.CURVES, c("x")).alias("v")).filter(F.size("v") > 0).select("x", F.round(T.spread(c("v")), 6).alias("factor"))


@query("country_gap", "v_positions", sql=f"WITH {CURVES_SQL}, {X}, {INTERP} SELECT x, round(max(v) / min(v), 6) AS gap FROM ip WHERE variant IN ('us', 'gb', 'ca', 'in', 'jp') GROUP BY x")
def country_gap(p):
    return positions(p).select("x", T.percents(K.BY_COUNTRY, c("x")).alias("v")).filter(F.size("v") > 0).select("x", F.round(T.spread(c("v")), 6).alias("gap"))


@query("ctr_retained", "v_positions", sql=f"WITH {CURVES_SQL}, {X}, {INTERP}, {RETAIN} SELECT x, round(ctr, 6) AS ctr, round(low, 6) AS low, round(high, 6) AS high, curves FROM r")
def ctr_retained(p):
    r = positions(p).select("x", T.ctr_retained(c("x")).alias("r")).filter("r.ctr IS NOT NULL")
    return r.select("x", *[F.round(f"r.{k}", 6).alias(k) for k in ("ctr", "low", "high")], "r.curves")


TYPES = "CASE seq % 5 WHEN 0 THEN 'ai_overview' WHEN 1 THEN 'snippet_other' WHEN 2 THEN 'local_pack' END"
SERP_LOW = "greatest(0.2, CASE seq % 5 WHEN 0 THEN 0.42 WHEN 1 THEN 0.65 WHEN 2 THEN 0.45 * 0.42 ELSE 1 END)::DOUBLE"
SERP_HIGH = "greatest(0.2, CASE seq % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 * 0.98 ELSE 1 END)::DOUBLE"


def types():
    m = c("seq") % 5
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.when(m == 0, a("ai_overview")).when(m == 1, a("snippet_other")).when(m == 2, a("local_pack", "ai_overview")).otherwise(a())


@query("serp_multiplier", "v_positions", sql=f"SELECT seq, round({SERP_LOW}, 6) AS low, round({SERP_HIGH}, 6) AS high, round(sqrt({SERP_LOW} * {SERP_HIGH}), 6) AS centre FROM v_positions")
def serp_multiplier(p):
    return p.select("seq", T.serp_multiplier(types()).alias("m")).select("seq", *[F.round(f"m.{k}", 6).alias(k) for k in ("low", "high", "centre")])


@query("sigma_from_range", "v_positions", sql=f"SELECT seq, round(ln((price + 1000) / price) / {Z2}, 6) AS sigma, round(sqrt(price * (price + 1000)), 4) AS centre FROM v_positions")
def sigma_from_range(p):
    return p.select("seq", F.round(T.sigma_from_range(c("price"), c("price") + 1000), 6).alias("sigma"), F.round(T.geo_mean2(c("price"), c("price") + 1000), 4).alias("centre"))


@query("geo_mean2", "v_positions", sql="SELECT seq, round(sqrt((1 + seq % 100) * (10 + seq % 1000)), 6) AS centre FROM v_positions")
def geo_mean2(p):
    return p.select("seq", F.round(T.geo_mean2(1 + c("seq") % 100, 10 + c("seq") % 1000), 6).alias("centre"))


@query("parse_bucket", "v_positions", sql="SELECT seq, (CASE seq % 3 WHEN 0 THEN 100 WHEN 1 THEN 1000 ELSE 10000 END)::DOUBLE AS low, (CASE seq % 3 WHEN 0 THEN 1000 WHEN 1 THEN 10000 ELSE 1000000 END)::DOUBLE AS high FROM v_positions")
def parse_bucket(p):
    text = F.when(c("seq") % 3 == 0, "100 - 1 K").when(c("seq") % 3 == 1, "1 K - 10 K").otherwise("10K - 1M")
    return p.select("seq", T.parse_bucket(text).alias("b")).select("seq", "b.low", "b.high")


VOLUME = f"CASE seq % 3 WHEN 0 THEN 1 + seq % 900 WHEN 1 THEN 10 + seq % 500 ELSE sqrt(greatest(1, seq % 50) * (1000 + seq % 50)) END::DOUBLE"
VOLUME_SIGMA = f"CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN ln(2) / {Z2} ELSE ln((1000 + seq % 50) / greatest(1, seq % 50)) / {Z2} END::DOUBLE"


def volume():
    s = c("seq")
    low = F.when(s % 3 == 2, (s % 50).cast("double"))
    return T.volume_central(F.when(s % 3 == 0, (1 + s % 900).cast("double")), F.when(s % 3 == 1, (10 + s % 500).cast("double")), low, (1000 + s % 50).cast("double"))


@query("volume_central", "v_positions", sql=f"SELECT seq, round({VOLUME}, 6) AS centre, round({VOLUME_SIGMA}, 6) AS sigma FROM v_positions")
def volume_central(p):
    return p.select("seq", volume().alias("v")).select("seq", F.round("v.centre", 6).alias("centre"), F.round("v.sigma", 6).alias("sigma"))


COUNTRY = "CASE WHEN seq % 4 = 0 THEN 'US' ELSE 'FR' END"
EST = f"""WITH {CURVES_SQL}, {X}, {INTERP}, {RETAIN}, g AS (SELECT x, max(v) / min(v) AS gap FROM ip WHERE variant IN ('us', 'gb', 'ca', 'in', 'jp') GROUP BY x),
 q AS (SELECT seq, domain, position + (seq % 2) * 0.5::DOUBLE AS x, {VOLUME} AS vol, {VOLUME_SIGMA} AS vs, {SERP_LOW} AS sl, {SERP_HIGH} AS sh, {COUNTRY} AS country FROM v_positions WHERE position IS NOT NULL),
 e0 AS (SELECT q.*, vol * ctr / 100 * sqrt(sl * sh) AS centre, sqrt(vs * vs + pow(ln(high / low) / {Z2}, 2) + pow(ln(sh / sl) / {Z2}, 2) + CASE WHEN country = 'US' THEN 0 ELSE pow(ln(gap) / {Z2}, 2) END) AS sigma FROM q LEFT JOIN r USING (x) LEFT JOIN g USING (x)),
 e AS (SELECT seq, domain, centre, centre / exp({K.Z90} * sigma) AS low, centre * exp({K.Z90} * sigma) AS high, CASE WHEN centre IS NULL THEN 'BLIND' ELSE 'MEASURED' END AS state FROM e0)"""


def estimates(p):
    country = F.when(c("seq") % 4 == 0, "US").otherwise("FR")
    rows = p.filter("position IS NOT NULL").withColumn("x", c("position") + (c("seq") % 2) * 0.5)
    return rows.select("seq", "domain", T.estimate(volume(), c("x"), country, types()).alias("e")).select("seq", "domain", "e.centre", "e.low", "e.high", "e.state")


@query("estimate_query", "v_positions", sql=f"{EST} SELECT seq, round(centre, 5) AS centre, round(low, 5) AS low, round(high, 4) AS high, state FROM e")
def estimate_query(p):
    return estimates(p).select("seq", F.round("centre", 5).alias("centre"), F.round("low", 5).alias("low"), F.round("high", 4).alias("high"), "state")


@query("estimate_domain", "v_positions", sql=f"{EST} SELECT domain, round(sum(centre), 4) AS centre, round(sum(low), 4) AS low, round(sum(high), 3) AS high, round(sqrt(sum(pow((high - low) / 2, 2))), 3) AS independent, count(*) FILTER (state <> 'BLIND') AS retained, count(*) FILTER (state = 'BLIND') AS excluded FROM e GROUP BY domain")
def estimate_domain(p):
    e = T.estimate_domain(estimates(p), "domain")
    return e.select("domain", F.round("centre", 4).alias("centre"), F.round("low", 4).alias("low"), F.round("high", 3).alias("high"), F.round("independent", 3).alias("independent"), "retained", "excluded")


@query("estimates_excluded", "v_journal", sql="SELECT metric, count(*) AS n FROM v_journal WHERE metric NOT IN ('view', 'signup') GROUP BY metric")
def estimates_excluded(j):
    """Modelled metrics never feed scores."""
    return j.filter(~c("metric").isin("view", "signup")).groupBy("metric").agg(F.count("*").alias("n"))
