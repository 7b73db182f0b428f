"""The driver's tables as the engine's data model. Each view is a Spark DataFrame and the same view in DuckDB SQL;
only modular arithmetic, so both engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.session import table

# name -> (driver table, Spark select list, DuckDB select list, common WHERE)
_SIMPLE = {
    "v_journal": (
        "events",
        "event_id AS seq, concat('u', user_id) AS domain, event_type AS kind, event_type AS metric, CASE event_id % 10 WHEN 0 THEN 'BLIND' WHEN 1 THEN 'ABSENT' ELSE 'MEASURED' END AS state, CASE WHEN event_id % 10 >= 2 THEN value END AS value, concat('s', event_id % 3) AS source, CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS measured_at, CAST(CAST(ts AS DATE) AS STRING) AS run_id, concat('c', event_id % 2) AS collector, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
        "event_id AS seq, 'u' || user_id AS domain, event_type AS kind, event_type AS metric, CASE event_id % 10 WHEN 0 THEN 'BLIND' WHEN 1 THEN 'ABSENT' ELSE 'MEASURED' END AS state, CASE WHEN event_id % 10 >= 2 THEN value END AS value, 's' || (event_id % 3) AS source, date_trunc('second', ts) AS measured_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, 'c' || (event_id % 2) AS collector, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
        "",
    ),
    "v_links": (
        "lineitem",
        "concat('t', l_partkey % 200) AS target, concat('d', l_suppkey) AS src_domain, concat('https://d', l_suppkey, '.com/', l_orderkey, '/', l_linenumber) AS url_src, concat('https://t', l_partkey % 200, '.net/', l_partkey) AS url_dest, CASE l_returnflag WHEN 'A' THEN 'dofollow' WHEN 'N' THEN 'nofollow' ELSE 'nofollow+ugc' END AS rel, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('anchor ', l_linenumber) END AS anchor, l_quantity * 2 AS link_score, l_shipdate AS seen_at, l_linestatus AS status",
        "'t' || (l_partkey % 200) AS target, 'd' || l_suppkey AS src_domain, 'https://d' || l_suppkey || '.com/' || l_orderkey || '/' || l_linenumber AS url_src, 'https://t' || (l_partkey % 200) || '.net/' || l_partkey AS url_dest, CASE l_returnflag WHEN 'A' THEN 'dofollow' WHEN 'N' THEN 'nofollow' ELSE 'nofollow+ugc' END AS rel, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'anchor ' || l_linenumber END AS anchor, l_quantity * 2 AS link_score, l_shipdate AS seen_at, l_linestatus AS status",
        "",
    ),
    "v_referents": (
        "lineitem",
        "concat('t', l_partkey % 200) AS target, concat('d', l_suppkey) AS src_domain, CASE WHEN l_orderkey % 2 = 0 THEN 'graph' ELSE 'console' END AS source, l_shipdate AS seen_at, CAST(l_quantity AS BIGINT) AS declared",
        "'t' || (l_partkey % 200) AS target, 'd' || l_suppkey AS src_domain, CASE WHEN l_orderkey % 2 = 0 THEN 'graph' ELSE 'console' END AS source, l_shipdate AS seen_at, CAST(l_quantity AS BIGINT) AS declared",
        "",
    ),
    "v_edges": ("lineitem", "DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst", "DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst", ""),
    "v_positions": (
        "orders",
        "o_orderkey AS seq, concat('c', o_custkey) AS domain, concat('q', o_orderkey % 40) AS query, CASE WHEN o_orderstatus <> 'P' THEN 1 + o_orderkey % 25 END AS position, CASE WHEN o_orderstatus = 'P' THEN 'BLIND' WHEN o_orderkey % 11 = 0 THEN 'ABSENT' ELSE 'MEASURED' END AS state, o_orderdate AS measured_at, o_totalprice AS price",
        "o_orderkey AS seq, 'c' || o_custkey AS domain, 'q' || (o_orderkey % 40) AS query, CASE WHEN o_orderstatus <> 'P' THEN 1 + o_orderkey % 25 END AS position, CASE WHEN o_orderstatus = 'P' THEN 'BLIND' WHEN o_orderkey % 11 = 0 THEN 'ABSENT' ELSE 'MEASURED' END AS state, o_orderdate AS measured_at, o_totalprice AS price",
        "",
    ),
    "v_domains": (
        "customer",
        "concat('c', c_custkey) AS domain, CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'HOUSEHOLD' THEN 'competitor' WHEN 'MACHINERY' THEN 'competitor' ELSE 'prospect' END AS role, c_acctbal AS balance, c_custkey AS id",
        "'c' || c_custkey AS domain, CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'HOUSEHOLD' THEN 'competitor' WHEN 'MACHINERY' THEN 'competitor' ELSE 'prospect' END AS role, c_acctbal AS balance, c_custkey AS id",
        "",
    ),
    "v_ranks": (
        "part",
        "concat('p', p_partkey, '.com') AS domain, CAST(1 + p_partkey * 7 % 99991 AS BIGINT) AS rank_a, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1 + p_partkey * 13 % 49999 AS BIGINT) END AS rank_b, p_size < 40 AS asked, p_retailprice AS opr, p_partkey AS id",
        "'p' || p_partkey || '.com' AS domain, CAST(1 + p_partkey * 7 % 99991 AS BIGINT) AS rank_a, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1 + p_partkey * 13 % 49999 AS BIGINT) END AS rank_b, p_size < 40 AS asked, p_retailprice AS opr, p_partkey AS id",
        "",
    ),
    "v_queue": (
        "events",
        "concat('/', event_id) AS url, concat('h', user_id) AS host, 1 + event_id % 5 AS priority, event_id % 3 AS depth, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'wall' WHEN 1 THEN 'read' WHEN 2 THEN 'busy' ELSE 'waiting' END AS state, ts AS taken_at",
        "'/' || event_id AS url, 'h' || user_id AS host, 1 + event_id % 5 AS priority, event_id % 3 AS depth, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'wall' WHEN 1 THEN 'read' WHEN 2 THEN 'busy' ELSE 'waiting' END AS state, ts AS taken_at",
        "",
    ),
    "v_hosts": (
        "events",
        "concat('h', user_id) AS host, max(ts) AS last_at, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' ELSE TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS busy_until",
        "'h' || user_id AS host, max(ts) AS last_at, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS busy_until",
        "true GROUP BY user_id",
    ),
    "v_pages": (
        "pages",
        "page_id, url, html, CASE page_id % 4 WHEN 1 THEN 'nofollow' WHEN 2 THEN 'UGC nofollow' WHEN 3 THEN 'sponsored noopener' END AS rel, page_id % 5 = 0 AS noindex",
        "page_id, url, html, CASE page_id % 4 WHEN 1 THEN 'nofollow' WHEN 2 THEN 'UGC nofollow' WHEN 3 THEN 'sponsored noopener' END AS rel, page_id % 5 = 0 AS noindex",
        "",
    ),
    "v_texts": ("documents", "doc_id, text, lang, source", "doc_id, text, lang, source", ""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view as a DataFrame; unused columns are pruned down to the scan."""
    source, select, _, where = _SIMPLE[name]
    where = f"WHERE {where}" if where else ""
    return spark.sql(f"SELECT {select} FROM {{src}} {where}", src=table(spark, sf_dir, source))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put before it."""
    used = [n for n in _SIMPLE if n in sql]
    ctes = [f"{n} AS (SELECT {_SIMPLE[n][2]} FROM {_SIMPLE[n][0]}{' WHERE ' + _SIMPLE[n][3] if _SIMPLE[n][3] else ''})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
