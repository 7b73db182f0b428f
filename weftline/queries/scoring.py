"""Scoring queries: each component on inputs derived from orders, then link, domain and issuer scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.tristate import js_round
from weftline.operators import composite as C
from weftline.operators import relational as R
from weftline.operators import traffic as T
from weftline.queries.registry import query
from weftline.session import table

# One row per order; the same text serves both engines.
INPUTS = """SELECT o_orderkey AS id, 'c' || CAST(o_custkey % 300 AS VARCHAR(20)) AS target, 'd' || CAST(o_orderkey % 97 AS VARCHAR(20)) AS domain,
 CASE WHEN o_orderkey % 7 <> 0 THEN 1 + (o_orderkey * 7919) % 2000000 END AS rank, CASE WHEN o_orderkey % 11 = 0 THEN 403 ELSE 200 END AS http, o_orderkey % 13 <> 0 AS asked,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) / 10 END AS serp,
 CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS page_coh, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 83 AS DOUBLE) END AS site_coh,
 o_orderkey % 90 AS editorial, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 6 END AS writers, o_orderkey % 2 = 0 AS verifiable, o_orderkey % 3 = 0 AS pseudonym, o_orderkey % 1600 AS n_pages,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 4 END AS depth, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 130 END AS external, CASE WHEN o_orderkey % 12 <> 0 THEN o_orderkey % 2 = 1 END AS deep,
 o_orderkey % 14 <> 0 AS is_read, CASE WHEN o_orderkey % 15 = 0 THEN false WHEN o_orderkey % 16 <> 0 THEN true END AS in_html, CASE o_orderkey % 6 WHEN 1 THEN 'nofollow' WHEN 2 THEN 'UGC nofollow' WHEN 3 THEN 'sponsored' END AS rel,
 CASE WHEN o_orderkey % 17 = 0 THEN true WHEN o_orderkey % 18 <> 0 THEN false END AS noindex, o_orderkey % 19 <> 0 AS robots_ok, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS indexed, o_orderkey % 3 = 0 AS seen,
 o_orderkey % 50 = 0 AS disavowed, o_orderkey % 10 = 3 AS price, o_orderkey % 10 = 4 AS sponsoring, o_orderkey % 20 = 3 AS farm FROM {orders}"""
DUCK = INPUTS.format(orders="orders").replace("VARCHAR(20)", "VARCHAR")


def inputs(spark, sf_dir):
    return spark.sql(INPUTS.replace("VARCHAR(20)", "STRING"), orders=table(spark, sf_dir, "orders"))


def show(df, part, key="id"):
    return df.select(key, part.alias("p")).select(key, F.round("p.value", 6).alias("value"), F.col("p.state").alias("state"), F.round("p.low", 6).alias("low"), F.round("p.high", 6).alias("high"))


def scored(cte: str) -> str:
    """Oracle of a component: ``cte`` gives id, value, state, low, high from i."""
    return f"WITH i AS ({DUCK}), c AS ({cte}) SELECT id, round(value, 6) AS value, state, round(low, 6) AS low, round(high, 6) AS high FROM c"


c = F.col
POP = "CASE WHEN http <> 200 OR NOT asked THEN 20.0::DOUBLE WHEN rank IS NULL THEN 5.0::DOUBLE ELSE 100 * greatest(0, least(1, (6 - log10(rank)) / 4)) END"
POP_BLIND = "(http <> 200 OR NOT asked)"
POP_STATE = f"CASE WHEN {POP_BLIND} THEN 'BLIND' WHEN rank IS NULL THEN 'ABSENT' ELSE 'MEASURED' END"


@query("pos_weight", "v_positions", sql="SELECT seq, CASE WHEN p IS NULL OR p < 1 THEN 0 WHEN p = 1 THEN 0.28 WHEN p = 2 THEN 0.15 WHEN p = 3 THEN 0.1 WHEN p <= 6 THEN 0.06 WHEN p <= 10 THEN 0.02 WHEN p <= 20 THEN 0.005 ELSE 0 END::DOUBLE AS w FROM (SELECT seq, position / 2 AS p FROM v_positions)")
def pos_weight(p):
    return p.select("seq", C.position_weight(c("position") / 2).alias("w"))


@query("popularity", sql=scored(f"SELECT id, {POP} AS value, {POP_STATE} AS state, CASE WHEN {POP_BLIND} THEN 0 ELSE {POP} END AS low, CASE WHEN {POP_BLIND} THEN 100 ELSE {POP} END AS high FROM i"))
def popularity(spark, sf_dir):
    return show(inputs(spark, sf_dir), C.popularity(c("rank"), c("http"), c("asked")))


@query("visibility", "v_positions", sql="""SELECT domain, round(100 * least(1, sum(wp) / 8), 6) AS pool, round(100 * least(1, sum(wp) / 3), 6) AS page
    FROM (SELECT domain, CASE WHEN position = 1 THEN 0.28 WHEN position = 2 THEN 0.15 WHEN position = 3 THEN 0.10 WHEN position <= 6 THEN 0.06 WHEN position <= 10 THEN 0.02 WHEN position <= 20 THEN 0.005 ELSE 0 END::DOUBLE AS wp FROM v_positions) GROUP BY domain""")  # fmt: skip
def visibility(p):
    """Sum of the position weights over 8 for a pool of queries, over 3 for a page."""
    sums = p.groupBy("domain").agg(F.sum(C.position_weight(c("position"))).alias("w"))
    return sums.select("domain", F.round(C.visibility(c("w"), 8), 6).alias("pool"), F.round(C.visibility(c("w"), 3), 6).alias("page"))


T_VALUE = f"(CASE WHEN serp IS NULL THEN {POP} ELSE 0.6 * (CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 3) END) + 0.4 * {POP} END)"
T_LOW = f"(0.6 * coalesce((CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 3) END), 0) + 0.4 * CASE WHEN {POP_BLIND} THEN 0 ELSE {POP} END)"
T_HIGH = f"(0.6 * coalesce((CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 3) END), 100) + 0.4 * CASE WHEN {POP_BLIND} THEN 100 ELSE {POP} END)"
T_STATE = f"(CASE WHEN serp IS NULL OR {POP_BLIND} THEN 'BLIND' ELSE 'MEASURED' END)"


def t_part():
    return C.page_traffic(c("serp"), c("rank"), c("http"), c("asked"))


@query("comp_page_traffic", sql=scored(f"SELECT id, {T_VALUE} AS value, {T_STATE} AS state, {T_LOW} AS low, {T_HIGH} AS high FROM i"))
def comp_page_traffic(spark, sf_dir):
    return show(inputs(spark, sf_dir), t_part())


C_VALUE = "(CASE WHEN page_coh IS NULL THEN site_coh WHEN site_coh IS NULL THEN page_coh ELSE 0.65 * page_coh + 0.35 * site_coh END)"
C_LOW = "(coalesce(0.65 * page_coh, 0) + coalesce(0.35 * site_coh, 0))"
C_HIGH = "(coalesce(0.65 * page_coh, 65) + coalesce(0.35 * site_coh, 35))"
C_STATE = "(CASE WHEN page_coh IS NULL OR site_coh IS NULL THEN 'BLIND' ELSE 'MEASURED' END)"


@query("comp_coherence", sql=scored(f"SELECT id, {C_VALUE} AS value, {C_STATE} AS state, {C_LOW} AS low, {C_HIGH} AS high FROM i"))
def comp_coherence(spark, sf_dir):
    return show(inputs(spark, sf_dir), C.coherence(c("page_coh"), c("site_coh")))


A_SCORE = "(CASE WHEN editorial < 30 THEN 0 WHEN writers IS NULL THEN 50 WHEN writers >= 4 THEN 100 WHEN writers = 3 THEN 85 WHEN writers = 2 THEN 70 WHEN writers = 1 THEN CASE WHEN pseudonym AND NOT verifiable THEN 5 WHEN n_pages > 800 THEN 30 ELSE 60 END WHEN verifiable THEN 45 ELSE 10 END::DOUBLE)"
A_STATE = "(CASE WHEN editorial < 30 THEN 'ABSENT' WHEN writers IS NULL THEN 'BLIND' ELSE 'MEASURED' END)"
A_LOW = f"(CASE WHEN {A_STATE} = 'BLIND' THEN 5 ELSE {A_SCORE} END)"
A_HIGH = f"(CASE WHEN {A_STATE} = 'BLIND' THEN 100 ELSE {A_SCORE} END)"


def a_part():
    return C.authors(c("editorial"), c("writers"), c("verifiable"), c("pseudonym"), c("n_pages"))


@query("comp_authors", sql=f"WITH i AS ({DUCK}) SELECT id, {A_SCORE} AS value, {A_STATE} AS state, CASE WHEN editorial < 30 THEN 0 ELSE 18 END::DOUBLE AS weight FROM i")
def comp_authors(spark, sf_dir):
    value, weight = a_part()
    return inputs(spark, sf_dir).select("id", value["value"].alias("value"), value["state"].alias("state"), weight.alias("weight"))


P_D = "(CASE WHEN depth >= 2 THEN 100 WHEN depth = 1 THEN 70 WHEN depth = 0 THEN 40 END)"
P_S = "(CASE WHEN external IS NOT NULL THEN 100 * greatest(0, least(1, 1 - (external - 5) / 95)) END)"
P_T = "(CASE WHEN deep THEN 100 WHEN NOT deep THEN 55 END)"
P_VALUE = f"((coalesce(0.4::DOUBLE * {P_D}, 0) + coalesce(0.35::DOUBLE * {P_S}, 0) + coalesce(0.25::DOUBLE * {P_T}, 0)) / nullif(CASE WHEN depth IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN external IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN deep IS NULL THEN 0 ELSE 0.25::DOUBLE END, 0))"
P_LOW = f"least({P_VALUE}, 0.4::DOUBLE * coalesce({P_D}, 40) + 0.35::DOUBLE * coalesce({P_S}, 0) + 0.25::DOUBLE * coalesce({P_T}, 55))"
P_HIGH = f"greatest({P_VALUE}, 0.4::DOUBLE * coalesce({P_D}, 100) + 0.35::DOUBLE * coalesce({P_S}, 100) + 0.25::DOUBLE * coalesce({P_T}, 100))"
P_STATE = "(CASE WHEN depth IS NULL OR external IS NULL OR deep IS NULL THEN 'BLIND' ELSE 'MEASURED' END)"


def p_part():
    return C.depth(c("depth"), c("external"), c("deep"))


@query("comp_depth", sql=scored(f"SELECT id, {P_VALUE} AS value, {P_STATE} AS state, {P_LOW} AS low, {P_HIGH} AS high FROM i"))
def comp_depth(spark, sf_dir):
    return show(inputs(spark, sf_dir), p_part())


RULES = """t0 AS (SELECT i.*, CASE WHEN NOT in_html THEN 0 END AS r1, CASE WHEN lower(rel) LIKE '%sponsored%' THEN 0.15 END AS r2, CASE WHEN lower(rel) LIKE '%ugc%' THEN 0.15 END AS r3, CASE WHEN lower(rel) LIKE '%nofollow%' THEN 0.10 END AS r4,
 CASE WHEN coalesce(noindex, false) OR NOT robots_ok THEN 0.05 WHEN coalesce(indexed, false) THEN 1 WHEN NOT coalesce(indexed, true) AND seen THEN 0.45 ELSE 0.70 END AS r5,
 NOT (coalesce(noindex, false) OR NOT robots_ok) AND NOT coalesce(indexed, false) AND NOT (NOT coalesce(indexed, true) AND seen) AS unsure FROM i),
 t1 AS (SELECT *, least(r1, r2, r3, r4, r5) AS win, least(r1, r2, r3, r4, CASE WHEN unsure THEN 0.05 ELSE r5 END) AS lo, least(r1, r2, r3, r4, CASE WHEN unsure THEN 1 ELSE r5 END) AS hi FROM t0),
 tm AS (SELECT id, CASE WHEN is_read THEN win ELSE 0.7 END::DOUBLE AS tv, CASE WHEN NOT is_read OR (unsure AND 0.05 < win) THEN 'BLIND' ELSE 'MEASURED' END AS ts, CASE WHEN is_read THEN lo ELSE 0 END::DOUBLE AS tl, CASE WHEN is_read THEN hi ELSE 1 END::DOUBLE AS th FROM t1)"""


def t_mult():
    return C.transmission(c("is_read"), c("in_html"), c("rel"), c("noindex"), c("robots_ok"), c("indexed"), c("seen"))


@query("transmission", sql=f"WITH i AS ({DUCK}), {RULES} SELECT id, tv AS value, ts AS state, tl AS low, th AS high FROM tm")
def transmission(spark, sf_dir):
    return show(inputs(spark, sf_dir), t_mult())


MALUS = "mm AS (SELECT id, CASE WHEN disavowed THEN 0.05 WHEN http <> 200 THEN 1 WHEN price AND farm THEN 0.2 WHEN price THEN 0.55 WHEN sponsoring THEN 0.7 ELSE 1 END::DOUBLE AS mv, CASE WHEN NOT disavowed AND http <> 200 THEN 'BLIND' ELSE 'MEASURED' END AS ms FROM i)"


def m_mult():
    return C.malus(c("http"), c("disavowed"), c("price"), c("sponsoring"), c("farm"))


@query("link_malus", sql=f"WITH i AS ({DUCK}), {MALUS} SELECT id, mv AS value, ms AS state, CASE WHEN ms = 'BLIND' THEN 0.05 ELSE mv END::DOUBLE AS low, CASE WHEN ms = 'BLIND' THEN 1 ELSE mv END::DOUBLE AS high FROM mm")
def link_malus(spark, sf_dir):
    return show(inputs(spark, sf_dir), m_mult())


R2 = lambda x: f"floor({x} * 100 + 0.5) / 100"
PARTS = f"""parts AS (SELECT id, 40.0::DOUBLE AS w, {R2(T_VALUE)} AS v, {T_STATE} AS state, {T_LOW} AS lo, {T_HIGH} AS hi FROM i UNION ALL SELECT id, 22, {R2(C_VALUE)}, {C_STATE}, {C_LOW}, {C_HIGH} FROM i
 UNION ALL SELECT id, CASE WHEN editorial < 30 THEN 0 ELSE 18 END, {R2(A_SCORE)}, {A_STATE}, {A_LOW}, {A_HIGH} FROM i UNION ALL SELECT id, 20, {R2(P_VALUE)}, {P_STATE}, {P_LOW}, {P_HIGH} FROM i)"""
AGG = """agg AS (SELECT id, sum(CASE WHEN w > 0 AND state <> 'BLIND' AND v IS NOT NULL THEN w * v END) / sum(CASE WHEN w > 0 AND state <> 'BLIND' AND v IS NOT NULL THEN w END) AS value,
 sum(CASE WHEN w > 0 THEN w * CASE WHEN state <> 'BLIND' AND v IS NOT NULL THEN v ELSE lo END END) / sum(CASE WHEN w > 0 THEN w END) AS low, sum(CASE WHEN w > 0 THEN w * CASE WHEN state <> 'BLIND' AND v IS NOT NULL THEN v ELSE hi END END) / sum(CASE WHEN w > 0 THEN w END) AS high,
 coalesce(sum(CASE WHEN w > 0 AND state <> 'BLIND' THEN w ELSE 0 END) / sum(CASE WHEN w > 0 THEN w END), 0) AS share FROM parts GROUP BY id), base AS (SELECT id, value, least(low, value) AS low, greatest(high, value) AS high, share FROM agg)"""
ALL = f"WITH i AS ({DUCK}), {PARTS}, {AGG}, {RULES}, {MALUS}"


def link_base(df):
    value, weight = a_part()
    lit = lambda x: F.lit(float(x))
    components = {"T": (t_part(), lit(40)), "C": (C.coherence(c("page_coh"), c("site_coh")), lit(22)), "A": (value, weight), "P": (p_part(), lit(20))}
    return C.aggregate(C.link_parts(df, "id", components), "id")


@query("score_aggregate", sql=f"{ALL} SELECT id, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high, round(share, 6) AS share FROM base")
def score_aggregate(spark, sf_dir):
    return link_base(inputs(spark, sf_dir)).select("id", *[F.round(x, 6).alias(x) for x in ("value", "low", "high", "share")])


@query("score_combine", sql=f"WITH i AS ({DUCK}) SELECT id, round((coalesce(0.6 * page_coh, 0) + coalesce(0.4 * site_coh, 0)) / nullif(CASE WHEN page_coh IS NULL THEN 0 ELSE 0.6 END + CASE WHEN site_coh IS NULL THEN 0 ELSE 0.4 END, 0)::DOUBLE, 6) AS value, round(0.6 * coalesce(page_coh, 10) + 0.4 * coalesce(site_coh, 20), 6) AS low, round(0.6 * coalesce(page_coh, 90) + 0.4 * coalesce(site_coh, 80), 6) AS high FROM i")
def score_combine(spark, sf_dir):
    value, low, high = C.combine((0.6, c("page_coh"), 10, 90), (0.4, c("site_coh"), 20, 80))
    return inputs(spark, sf_dir).select("id", F.round(value, 6).alias("value"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("score_measured_share", "v_journal", sql="SELECT domain, round(sum((1 + k) * CASE WHEN state = 'BLIND' THEN 0 ELSE 1 END) / sum(1 + k), 6) AS share FROM v_journal GROUP BY domain")
def score_measured_share(j):
    parts = j.select("domain", (1 + c("k")).cast("double").alias("w"), F.lit(1.0).alias("v"), "state", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.when(c("state") == "BLIND", 0.0).otherwise(1.0).alias("part"))
    return C.aggregate(parts, "domain").select("domain", F.round("share", 6).alias("share"))


NL = """nl AS (SELECT id, value * tv * mv AS score, low * tl * CASE WHEN ms = 'BLIND' THEN 0.05 ELSE mv END AS low, high * th * CASE WHEN ms = 'BLIND' THEN 1 ELSE mv END AS high, share * CASE (ts = 'BLIND')::INT + (ms = 'BLIND')::INT WHEN 0 THEN 1 WHEN 1 THEN 0.8 ELSE 0.65 END AS share, tv
 FROM base JOIN tm USING (id) JOIN mm USING (id)), links AS (SELECT *, CASE WHEN score IS NULL OR share < 0.6 THEN 'UNRATED' WHEN score >= 35 THEN 'USEFUL' WHEN score >= 15 THEN 'NEUTRAL' WHEN tv >= 0.4 THEN 'TOXIC' ELSE 'NEUTRAL' END AS class FROM nl)"""


def link_scores(df):
    return C.link_score(link_base(df), df.select("id", t_mult().alias("t"), m_mult().alias("m")), "id")


@query("link_score", sql=f"{ALL}, {NL} SELECT id, round(score + 3e-8, 5) AS score, round(low + 3e-8, 5) AS low, round(high + 3e-8, 5) AS high, round(share, 6) AS share, class FROM links")
def link_score(spark, sf_dir):
    return link_scores(inputs(spark, sf_dir)).select("id", *[F.round(c(x) + F.lit(3e-8), 5).alias(x) for x in ("score", "low", "high")], F.round("share", 6).alias("share"), "class")


@query("link_class", sql=f"{ALL}, {NL} SELECT class, count(*) AS n FROM links GROUP BY class")
def link_class(spark, sf_dir):
    return link_scores(inputs(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"))


AA = """r AS (SELECT target, domain, class, score AS nl, disavowed FROM links JOIN i USING (id)),
 u AS (SELECT target, domain, nl, row_number() OVER (PARTITION BY target, domain ORDER BY nl DESC) AS rn FROM r WHERE class = 'USEFUL'),
 mu AS (SELECT target, sum(pow(nl / 100, 2) * CASE WHEN rn = 1 THEN 1 ELSE 0.25 END) AS mu, avg(nl) AS q FROM u GROUP BY target),
 s AS (SELECT target, sum(CASE WHEN class = 'TOXIC' THEN CASE WHEN disavowed THEN 0.25 ELSE 1 END ELSE 0 END)::DOUBLE AS toxic, count(*) FILTER (class <> 'UNRATED') AS rated, count(DISTINCT domain) FILTER (class <> 'UNRATED') AS domains FROM r GROUP BY target),
 f AS (SELECT s.*, 10 AS known, 0.45 * coalesce(q, 0) + 0.55 * 100 * least(1, ln(1 + coalesce(mu, 0)) / ln(26)) AS force FROM s LEFT JOIN mu USING (target)),
 aa AS (SELECT target, CASE WHEN rated > 0 THEN force * pow(1 - greatest(0, toxic / rated - 0.15) / 0.85, 1.5) END AS value, CASE WHEN rated = 0 OR greatest(0, known - domains) / known > 0.2 THEN 'BLIND' ELSE 'MEASURED' END AS state,
 CASE WHEN rated = 0 THEN 0 WHEN known > domains THEN force * pow(1 - greatest(0, (toxic + known - domains) / (rated + known - domains) - 0.15) / 0.85, 1.5) ELSE force * pow(1 - greatest(0, toxic / rated - 0.15) / 0.85, 1.5) END AS low,
 CASE WHEN rated = 0 OR known > domains THEN 100 ELSE force * pow(1 - greatest(0, toxic / rated - 0.15) / 0.85, 1.5) END AS high FROM f)"""


def authority(df):
    links = link_scores(df).join(df.select("id", "target", "domain", "disavowed"), "id").select("target", "domain", c("score").alias("nl"), "class", "disavowed")
    return C.acquired_authority(links, "target", df.select("target").distinct().withColumn("known", F.lit(10).cast("long")))


@query("acquired_authority", sql=f"{ALL}, {NL}, {AA} SELECT target, round(value, 4) AS value, state, round(low, 4) AS low, round(high, 4) AS high FROM aa")
def acquired_authority(spark, sf_dir):
    return authority(inputs(spark, sf_dir)).select("target", F.round("value", 4).alias("value"), "state", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


TR_V = f"(CASE WHEN serp IS NULL THEN {POP} ELSE 0.55 * {POP} + 0.45 * (CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 8) END) END)"


@query("axis_traffic", sql=scored(f"SELECT id, {TR_V} AS value, {T_STATE} AS state, 0.55 * CASE WHEN {POP_BLIND} THEN 0 ELSE {POP} END + 0.45 * coalesce((CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 8) END), 0) AS low, 0.55 * CASE WHEN {POP_BLIND} THEN 100 ELSE {POP} END + 0.45 * coalesce((CASE WHEN serp IS NOT NULL THEN 100 * least(1, serp / 8) END), 100) AS high FROM i"))
def axis_traffic(spark, sf_dir):
    return show(inputs(spark, sf_dir), C.axis_traffic(c("serp"), c("rank"), c("http"), c("asked")))


PO = "po AS (SELECT domain, 100 * sum(CASE WHEN state <> 'MEASURED' THEN 0 WHEN position <= 3 THEN 3 WHEN position <= 10 THEN 1.5 WHEN position <= 20 THEN 0.5 ELSE 0 END::DOUBLE) / (3 * nullif(count(*) FILTER (state <> 'BLIND'), 0)) AS value, count(*) FILTER (state <> 'BLIND') AS n FROM v_positions GROUP BY domain)"


@query("axis_positions", "v_positions", sql=f"WITH {PO} SELECT domain, round(value, 6) AS value, n FROM po")
def axis_positions(p):
    return C.axis_positions(p, "domain").select("domain", F.round("value", 6).alias("value"), "n")


CO_AT = lambda s, i: f"100 * least(1, ln(1 + n_pages) / ln(1201)) * (0.5 + 0.5 * coalesce(page_coh / 100, {s})) * (0.6 + 0.4 * coalesce(site_coh / 100, {i}))"


@query("axis_coverage", sql=scored(f"SELECT id, {CO_AT(1, 1)} AS value, CASE WHEN page_coh IS NULL OR site_coh IS NULL THEN 'BLIND' ELSE 'MEASURED' END AS state, {CO_AT(0, 0)} AS low, {CO_AT(1, 1)} AS high FROM i"))
def axis_coverage(spark, sf_dir):
    return show(inputs(spark, sf_dir), C.axis_coverage(c("n_pages"), c("page_coh") / 100, c("site_coh") / 100))


GOT = "(CASE WHEN http = 200 AND depth <= 1 THEN 25 ELSE 0 END + CASE WHEN rank IS NULL THEN 0 WHEN n_pages * 3 <= 600 THEN 20 WHEN n_pages * 3 <= 1200 THEN 15 WHEN n_pages * 3 <= 2500 THEN 5 ELSE 0 END + CASE WHEN external IS NULL THEN 0 WHEN external * 8 <= 300 THEN 15 WHEN external * 8 <= 600 THEN 7 ELSE 0 END + CASE WHEN robots_ok THEN 15 ELSE 0 END + CASE WHEN deep THEN 15 ELSE 0 END + CASE WHEN seen THEN 10 ELSE 0 END)"
ABLE = "(65 - CASE WHEN deep IS NULL THEN 15 ELSE 0 END + CASE WHEN rank IS NULL THEN 0 ELSE 20 END + CASE WHEN external IS NULL THEN 0 ELSE 15 END)"


@query("axis_health", sql=scored(f"SELECT id, 100.0 * {GOT} / {ABLE} AS value, CASE WHEN {ABLE} = 100 THEN 'MEASURED' ELSE 'BLIND' END AS state, least({GOT}::DOUBLE, 100.0 * {GOT} / {ABLE}) AS low, greatest(({GOT} + 100 - {ABLE})::DOUBLE, 100.0 * {GOT} / {ABLE}) AS high FROM (SELECT * REPLACE (coalesce(depth, 0) AS depth) FROM i)"))
def axis_health(spark, sf_dir):
    ttfb = F.when(c("rank").isNotNull(), c("n_pages") * 3)
    return show(inputs(spark, sf_dir), C.axis_health(c("http"), c("depth"), ttfb, c("external") * 8, c("robots_ok"), c("deep"), c("seen")))


DOMAIN_PARTS = """d AS (SELECT domain, role, CAST(substring(domain, 2) AS BIGINT) AS n FROM v_domains), dp AS (SELECT d.domain, role, 0.32::DOUBLE AS w, CASE WHEN n % 5 <> 0 THEN (n % 100)::DOUBLE END AS v, CASE WHEN n % 5 = 0 THEN 'BLIND' ELSE 'MEASURED' END AS state FROM d
 UNION ALL SELECT domain, role, 0.26, CASE WHEN n % 3 <> 0 THEN (n % 90)::DOUBLE END, CASE WHEN n % 3 = 0 THEN 'BLIND' ELSE 'MEASURED' END FROM d UNION ALL SELECT d.domain, role, 0.17, po.value, CASE WHEN po.value IS NULL THEN 'BLIND' ELSE 'MEASURED' END FROM d LEFT JOIN po USING (domain)
 UNION ALL SELECT domain, role, 0.15, (n % 80)::DOUBLE, 'MEASURED' FROM d UNION ALL SELECT domain, role, 0.10, (n % 70)::DOUBLE, 'MEASURED' FROM d)"""
DOMAIN_SCORE = f"""WITH {PO}, {DOMAIN_PARTS}, k AS (SELECT *, state <> 'BLIND' AND v IS NOT NULL AS ok FROM dp)
 SELECT domain, round(sum(CASE WHEN ok THEN w * v END) / sum(CASE WHEN ok THEN w END), 6) AS value, round(least(sum(w * CASE WHEN ok THEN v ELSE 0 END) / sum(w), sum(CASE WHEN ok THEN w * v END) / sum(CASE WHEN ok THEN w END)), 6) AS low,
 round(greatest(sum(w * CASE WHEN ok THEN v ELSE 100 END) / sum(w), sum(CASE WHEN ok THEN w * v END) / sum(CASE WHEN ok THEN w END)), 6) AS high, round(sum(CASE WHEN state <> 'BLIND' THEN w ELSE 0 END) / sum(w), 6) AS share FROM k GROUP BY domain"""


def domain_scores(d, p):
    n = F.substring("domain", 2, 20).cast("long")
    po = C.axis_positions(p, "domain").select("domain", c("value").alias("po"))
    rows = C.refuse_spots(d).join(po, "domain", "left").withColumn("n", n)
    axis = lambda w, v: F.struct(F.lit(w).alias("w"), v.cast("double").alias("v"), F.when(v.isNull(), "BLIND").otherwise("MEASURED").alias("state"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"), F.when(v.isNull(), 0.0).otherwise(1.0).alias("part"))
    values = {"TR": F.when(c("n") % 5 != 0, c("n") % 100), "AA": F.when(c("n") % 3 != 0, c("n") % 90), "PO": c("po"), "CO": c("n") % 80, "ST": c("n") % 70}
    return C.aggregate(rows.select("domain", F.inline(F.array(*[axis(C.AXES[k], v) for k, v in values.items()]))), "domain")


@query("domain_score", "v_domains", "v_positions", sql=DOMAIN_SCORE)
def domain_score(d, p):
    return domain_scores(d, p).select("domain", *[F.round(x, 6).alias(x) for x in ("value", "low", "high", "share")])


@query("score_to_facts", "v_domains", "v_positions", sql=f"WITH q AS ({DOMAIN_SCORE}) SELECT domain AS subject, 'domain_score' AS metric, CASE WHEN share >= 0.6 THEN value END AS value, low, high, CASE WHEN value IS NULL OR share < 0.6 THEN 'BLIND' ELSE 'MEASURED' END AS state, 'derived' AS nature FROM q")
def score_to_facts(d, p):
    rounded = domain_scores(d, p).select("domain", *[F.round(x, 6).alias(x) for x in ("value", "low", "high", "share")])
    return C.to_facts(rounded, "domain", "domain_score")


ISSUER = """WITH p AS (SELECT domain, CASE WHEN NOT asked THEN NULL WHEN rank_b IS NULL THEN 5 ELSE 100 * greatest(0, least(1, (6 - log10(rank_b)) / 4)) END::DOUBLE AS pop, opr, id, asked FROM v_ranks),
 q AS (SELECT *, CASE WHEN NOT asked THEN NULL WHEN id % 9 = 0 THEN 8 ELSE least((id % 11)::DOUBLE * 10, coalesce(pop + 25, 100)) END::DOUBLE AS o, CASE WHEN NOT asked THEN NULL WHEN id % 8 = 0 THEN 5 ELSE least(100, 100 * log10(1 + id) / log10(20001)) END::DOUBLE AS n, CASE WHEN id % 10 <> 0 THEN 100 - id % 101 END::DOUBLE AS s, CASE WHEN id % 2 = 0 THEN 100 ELSE 45 END::DOUBLE AS t FROM p),
 r AS (SELECT domain, (coalesce(35 * pop, 0) + coalesce(25 * o, 0) + coalesce(15 * n, 0) + coalesce(15 * s, 0) + 10 * t) / (CASE WHEN pop IS NULL THEN 0 ELSE 35 END + CASE WHEN o IS NULL THEN 0 ELSE 25 END + CASE WHEN n IS NULL THEN 0 ELSE 15 END + CASE WHEN s IS NULL THEN 0 ELSE 15 END + 10) AS v, (CASE WHEN pop IS NULL THEN 0 ELSE 35 END + CASE WHEN o IS NULL THEN 0 ELSE 25 END + CASE WHEN n IS NULL THEN 0 ELSE 15 END + CASE WHEN s IS NULL THEN 0 ELSE 15 END + 10) / 100 AS share FROM q)
 SELECT domain, floor(round(v, 6) * 10 + 0.5) / 10 AS score, share, CASE WHEN v >= 55 THEN 'SOLID' WHEN v >= 30 THEN 'MEDIUM' ELSE 'WEAK' END AS class, share >= 0.5 AS displayable FROM r"""


@query("issuer_score", "v_ranks", sql=ISSUER)
def issuer_score(r):
    i = c("id")
    parts = C.issuer_parts(r, "domain", c("rank_b"), c("asked"), F.when(i % 9 != 0, (i % 11).cast("double")), F.when(i % 8 != 0, i), F.when(i % 10 != 0, (i % 101).cast("double")), i % 2 == 0)
    s = C.aggregate(parts, "domain")
    return s.select("domain", js_round(F.round("value", 6), 1).alias("score"), "share", C.issuer_class(c("value")).alias("class"), (c("share") >= 0.5).alias("displayable"))


@query("real_dofollow", sql=f"WITH i AS ({DUCK}) SELECT id, is_read AND robots_ok AND (rel IS NULL) AND NOT coalesce(noindex, false) AS real, CAST((NOT is_read)::INT + (NOT robots_ok)::INT + (rel IS NOT NULL)::INT + coalesce(noindex, false)::INT AS BIGINT) AS n_missing FROM i")
def real_dofollow(spark, sf_dir):
    conditions = {"public": c("is_read"), "crawlable": c("robots_ok"), "rel": c("rel").isNull(), "page": ~F.coalesce(c("noindex"), F.lit(False))}
    missing = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in conditions.items()]))
    return inputs(spark, sf_dir).select("id", missing.alias("m")).select("id", (F.size("m") == 0).alias("real"), F.size("m").cast("long").alias("n_missing"))


@query("rank_divergence", "v_ranks", sql="""WITH r AS (SELECT domain, asked, CASE WHEN id % 7 <> 0 THEN rank_a END AS o, rank_b AS m FROM v_ranks), x AS (SELECT domain, log10(o / m) AS l FROM r WHERE o IS NOT NULL AND m IS NOT NULL),
 m AS (SELECT list_sort(list(l))[count(*) // 2 + 1] AS median FROM x), d AS (SELECT greatest(list_sort(list(abs(l - median)))[count(*) // 2 + 1], 0.05) AS mad FROM x, m)
 SELECT domain, round(l - median, 2) + 0.0::DOUBLE AS divergence, 'drift' AS nature FROM x, m, d WHERE abs(l - median) >= 5 * mad
 UNION ALL SELECT domain, round(greatest(log10(10000000 / (r.m * pow(10, median))), 0), 2), 'floor' FROM r, m WHERE asked AND o IS NULL AND r.m IS NOT NULL""")  # fmt: skip
def rank_divergence(r):
    """Domains whose ranks in two tables disagree: by five median deviations where both have one; at least by how far the
    asked table reaches where it has none. A rank in the longer table alone is usual and says nothing."""
    rows = r.select("domain", "asked", F.when(c("id") % 7 != 0, c("rank_a")).alias("o"), c("rank_b").alias("m"))
    return R.rank_divergence(rows).select("domain", (F.round("divergence", 2) + F.lit(0.0)).alias("divergence"), "nature")


@query("agg_quadratic_mass", "v_links", sql="""SELECT target, round(sum(pow(link_score / 100, 2) * CASE WHEN rn = 1 THEN 1 ELSE 0.25 END), 6) AS mass
    FROM (SELECT target, link_score, row_number() OVER (PARTITION BY target, src_domain ORDER BY link_score DESC) AS rn FROM v_links) GROUP BY target""")  # fmt: skip
def agg_quadratic_mass(l):
    """The best link of a domain counts fully, its others a quarter."""
    return C.quadratic_mass(l, "target", "src_domain", c("link_score")).select("target", F.round("mass", 6).alias("mass"))


LABEL = "'estimated clicks on the ' || count(*) || ' queries followed'"


@query("label_guard", "v_positions", sql=f"SELECT domain, {LABEL} AS label FROM v_positions GROUP BY domain")
def label_guard(p):
    """The label a modelled total must carry; a forbidden one raises while the query runs."""
    label = F.concat(F.lit("estimated clicks on the "), F.count("*"), F.lit(" queries followed"))
    return p.groupBy("domain").agg(label.alias("label")).select("domain", T.guarded_label(c("label")).alias("label"))


LATEST = "s AS (SELECT * FROM v_journal QUALIFY row_number() OVER (PARTITION BY domain, metric, source ORDER BY measured_at DESC, seq DESC) = 1)"
CTX = ", ".join(f"max(struct_pack(a := measured_at, b := seq, v := value, s := state)) FILTER (metric = '{m}') AS {m}" for m in ("click", "view", "purchase", "error", "signup"))
GIVEN = lambda m, v: f"CASE WHEN {m}.s IS NULL OR {m}.s = 'BLIND' THEN NULL WHEN {m}.s = 'ABSENT' THEN 5 ELSE least(100, {v}) END::DOUBLE"
RECOMPUTE = f"""WITH {LATEST}, x AS (SELECT domain, {CTX} FROM s GROUP BY domain),
 ax AS (SELECT domain, 0.32::DOUBLE AS w, CASE WHEN click.s IS NULL OR click.s = 'BLIND' THEN NULL WHEN click.s = 'ABSENT' THEN 5 ELSE 100 * greatest(0, least(1, (6 - log10(floor(click.v * 5000) + 1)) / 4)) END::DOUBLE AS v FROM x
 UNION ALL SELECT domain, 0.26, {GIVEN("signup", "signup.v")} FROM x UNION ALL SELECT domain, 0.17, {GIVEN("purchase", "purchase.v / 2")} FROM x
 UNION ALL SELECT domain, 0.15, CASE WHEN view.s = 'MEASURED' THEN 100 * least(1, ln(1 + floor(view.v * 10)) / ln(1201)) END FROM x UNION ALL SELECT domain, 0.10, {GIVEN("error", "100 - least(100, error.v)")} FROM x),
 r AS (SELECT domain, w, floor(v * 100 + 0.5) / 100 AS v FROM ax),
 g AS (SELECT domain, sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) AS value, sum(w * coalesce(v, 0)) / sum(w) AS low, sum(w * coalesce(v, 100)) / sum(w) AS high, coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) / sum(w) AS share FROM r GROUP BY domain)
 SELECT domain, round(value, 6) AS value, round(least(low, value), 6) AS low, round(greatest(high, value), 6) AS high, round(share, 6) AS share, CASE WHEN value IS NOT NULL AND round(share, 9) >= 0.6 THEN row_number() OVER (PARTITION BY value IS NOT NULL AND round(share, 9) >= 0.6 ORDER BY round(value, 9) DESC, domain) END AS place FROM g"""


@query("recompute_scores", "v_journal", sql=RECOMPUTE)
def recompute_scores(j):
    """The flagship: all domain scores from the journal."""
    from weftline.plans.recompute import recompute

    return recompute(j).select("domain", *[F.round(x, 6).alias(x) for x in ("value", "low", "high", "share")], "place")
