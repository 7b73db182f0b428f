"""Web-graph queries over the edges of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.urls import reverse_domain
from weftline.operators import graph as G
from weftline.queries.registry import query
from weftline.session import shared_folder, table
from weftline.sources.vertices import VertexTable

VERTICES = "v_vertices AS (SELECT s_suppkey AS id, 'com.s' || s_suppkey AS rev_domain FROM supplier UNION ALL SELECT 1000000 + p_partkey, 'net.p' || p_partkey FROM part)"


def vertices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("com.s"), "s_suppkey").alias("rev_domain"))
    return s.union(table(spark, sf_dir, "part").select(F.col("p_partkey") + 1000000, F.concat(F.lit("net.p"), "p_partkey"))).withColumn("domain", reverse_domain(F.col("rev_domain")))


def edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))


@query("reverse_domain", sql=f"WITH {VERTICES} SELECT id, split_part(rev_domain, '.', 2) || '.' || split_part(rev_domain, '.', 1) AS domain FROM v_vertices")
def reverse(spark, sf_dir):
    return vertices(spark, sf_dir).select("id", "domain")


TARGETS = "t AS (SELECT 'p' || (p_partkey * 3) || '.net' AS target FROM part)"


@query("join_graph_targets", sql=f"WITH {TARGETS} SELECT target, count(DISTINCT l_suppkey) AS n FROM t JOIN lineitem ON 'p' || l_partkey || '.net' = target GROUP BY target")
def join_graph_targets(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select((F.col("p_partkey") * 3 + 1000000).alias("dst"))
    return edges(spark, sf_dir).join(wanted, "dst").groupBy("dst").agg(F.countDistinct("src").alias("n")).select(F.concat(F.lit("p"), F.col("dst") - 1000000, F.lit(".net")).alias("target"), "n")


@query("referring_domains", sql=f"""WITH {TARGETS}, f AS (SELECT DISTINCT target, l_suppkey AS src FROM t JOIN lineitem ON 'p' || l_partkey || '.net' = target),
    n AS (SELECT target, src, row_number() OVER (PARTITION BY target ORDER BY src) AS place, count(*) OVER (PARTITION BY target) AS total FROM f), k AS (SELECT * FROM n WHERE place <= 3000),
    known AS (SELECT 'p' || p_partkey || '.net' AS target FROM part)
    SELECT t.target, CASE WHEN known.target IS NULL THEN 'BLIND' WHEN total IS NULL THEN 'ABSENT' ELSE 'MEASURED' END AS state, 's' || src || '.com' AS referrer, place, total, CASE WHEN total > 3000 THEN 'floor' WHEN total IS NOT NULL THEN 'measured' END AS nature
    FROM t LEFT JOIN known ON t.target = known.target LEFT JOIN k ON t.target = k.target""")  # fmt: skip
def referring_domains(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey") * 3, F.lit(".net")).alias("target"))
    return G.referring_domains(edges(spark, sf_dir), vertices(spark, sf_dir), targets)


@query("join_resolve_names", sql=f"WITH {VERTICES} SELECT DISTINCT l_suppkey AS src, rev_domain FROM lineitem JOIN v_vertices ON id = l_suppkey")
def join_resolve_names(spark, sf_dir):
    """Names of all domains that link: the vertex table lies by id, and stays where it is."""
    known = VertexTable.build(vertices(spark, sf_dir), shared_folder(spark, "vertices"))
    return known.resolve(edges(spark, sf_dir).select("src").distinct(), "src")


@query("lookup_vertex", sql=f"WITH {VERTICES} SELECT id, rev_domain FROM v_vertices WHERE rev_domain IN ('com.s7', 'net.p42') OR id IN (3, 1000005)")
def lookup_vertex(spark, sf_dir):
    """A few vertices by name or id, each out of the bucket and the pages that can hold it."""
    return VertexTable.build(vertices(spark, sf_dir), shared_folder(spark, "vertices")).find((3, 1000005), ("com.s7", "net.p42"))


@query("in_degree", "v_edges", sql="SELECT dst, count(DISTINCT src) AS degree FROM v_edges GROUP BY dst")
def in_degree(e):
    return G.degrees(e, "dst", "src")


@query("out_degree", "v_edges", sql="SELECT src, count(DISTINCT dst) AS degree FROM v_edges GROUP BY src")
def out_degree(e):
    return G.degrees(e, "src", "dst")


@query("co_citation", "v_links", sql="""WITH l AS (SELECT target, src_domain || '/' || CAST(link_score AS INT) AS url_src FROM v_links), p AS (SELECT DISTINCT url_src FROM l WHERE target IN ('t1', 't2'))
    SELECT target, count(*) AS n FROM l WHERE target NOT IN ('t1', 't2') AND url_src IN (SELECT url_src FROM p) GROUP BY target HAVING count(DISTINCT url_src) <= greatest(50, (SELECT count(*) FROM p) // 4) ORDER BY n DESC, target LIMIT 60""")  # fmt: skip
def co_citation(l):
    return G.co_citation(l.select("target", F.concat("src_domain", F.lit("/"), F.col("link_score").cast("int")).alias("url_src")), F.col("target").isin("t1", "t2"))


@query("neighbours_of_competitors", "v_links", sql="SELECT src_domain, 100 + 10 * count(DISTINCT target) AS weight FROM v_links WHERE target IN ('t10', 't11', 't12', 't13') GROUP BY src_domain")
def neighbours_of_competitors(l):
    return l.filter(F.col("target").isin("t10", "t11", "t12", "t13")).groupBy("src_domain").agg((100 + 10 * F.countDistinct("target")).alias("weight"))


@query("opportunities", "v_links", sql="""SELECT src_domain, count(DISTINCT target) FILTER (target IN ('t10', 't11')) AS n_rivals FROM v_links GROUP BY src_domain
    HAVING count(*) FILTER (target IN ('t1', 't2')) = 0 AND count(DISTINCT target) FILTER (target IN ('t10', 't11')) > 0 AND src_domain NOT IN ('d10', 'd11')""")  # fmt: skip
def opportunities(l):
    t = F.col("target")
    rivals = l.select("src_domain").distinct().filter(F.col("src_domain").isin("d10", "d11"))
    return G.opportunities(l, "src_domain", t.isin("t1", "t2"), t.isin("t10", "t11"), rivals)


@query("page_neighbours", "v_links", sql="SELECT src_domain, count(DISTINCT target) FILTER (target IN ('t10', 't11', 't12')) AS n_rivals FROM v_links GROUP BY src_domain HAVING count(*) FILTER (target = 't1') > 0")
def page_neighbours(l):
    t = F.col("target")
    counts = l.groupBy("src_domain").agg(F.countDistinct(F.when(t.isin("t10", "t11", "t12"), t)).alias("n_rivals"), F.count(F.when(t == "t1", 1)).alias("n_own"))
    return counts.filter("n_own > 0").select("src_domain", "n_rivals")


@query("reciprocal", sql="""WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % (SELECT count(*) FROM supplier) AS b FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier))
    SELECT a, b FROM p WHERE a < b AND EXISTS (SELECT 1 FROM p q WHERE q.a = p.b AND q.b = p.a)""")  # fmt: skip
def reciprocal(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    pairs = table(spark, sf_dir, "lineitem").join(F.broadcast(n)).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % F.col("n")).alias("b"))
    return G.reciprocal(pairs, "a", "b")


@query("seed_priority", "v_links", "v_referents", sql="""SELECT src_domain, min(priority) AS priority FROM (SELECT src_domain, CAST(1 AS BIGINT) AS priority FROM v_links WHERE target = 't1'
    UNION ALL SELECT src_domain, 2 FROM v_referents WHERE target IN ('t10', 't11') UNION ALL SELECT src_domain, 5 FROM v_links) GROUP BY src_domain""")  # fmt: skip
def seed_priority(l, r):
    own = l.filter("target = 't1'").select("src_domain", F.lit(1).cast("long").alias("priority"))
    near = r.filter("target IN ('t10', 't11')").select("src_domain", F.lit(2).cast("long"))
    return own.union(near).union(l.select("src_domain", F.lit(5).cast("long"))).groupBy("src_domain").agg(F.min("priority").alias("priority"))
