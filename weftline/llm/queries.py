"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fim, fingerprint, langid, merkle, neardup, pieces, pii, quality, secret_scan, suffixes, warc, wordpiece

TOKENIZERS = "/opt/tokenizers"
PIECES = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return wordpiece.count_tokens(read(spark, sf_dir, "documents"), *wordpiece.vocabulary(f"{tokenizers}/{PIECES}"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.train(docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.rate(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_counts(read(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op10_pieces(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents"), pieces.load_model(f"{tokenizers}/{PIECES}"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.learn(docs))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_and_restore(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprint, op2_warc, op3_neardup, op4_token_counts, op5_personal_data, op6_quality, op7_suffixes, op8_decontaminate, op9_langid, op10_pieces, op11_secrets, op12_merkle, op13_fill_in_middle)}


#: Base32 of SHA-1: 40 hex digits are eight groups of 20 bits, four letters each.
BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substring(sha, 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) % 32, 1)), '')"

WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha, url FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
 SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> first THEN first END AS refers_to, regexp_replace(url, '\\s', '%20', 'g') AS uri, 1::INTEGER AS n_metadata, true AS has_request FROM f"""

NEARDUP_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
 x AS (SELECT doc_id, unnest(sh) AS sh FROM s), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n na ON na.doc_id = i.a JOIN n nb ON nb.doc_id = i.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
 ab AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT ab.b, r.c FROM r JOIN ab ON ab.a = r.id WHERE r.c < ab.b),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
 SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.id = n.doc_id"""

#: Texts as hex digits, so a byte is two characters of a string.
REPEATS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), z AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
 w AS MATERIALIZED (SELECT doc_id, s, md5_number(substring(h, 2 * s + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS s FROM z WHERE n >= 400)),
 t AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1), c AS (SELECT doc_id, s FROM w SEMI JOIN t USING (k)),
 g AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS new FROM c),
 r AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g) GROUP BY ALL),
 q AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r UNION ALL SELECT z.doc_id, z.n, coalesce(max(r.b), 0) FROM z LEFT JOIN r USING (doc_id) GROUP BY z.doc_id, z.n),
 kept AS (SELECT q.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, before) AS h FROM q JOIN z USING (doc_id) GROUP BY q.doc_id),
 m AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
 SELECT z.doc_id, z.n AS n_bytes, coalesce(m.removed, 0) AS n_removed, coalesce(m.spans, 0) AS n_spans, sha256(from_hex(kept.h)) AS kept_sha256 FROM z JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express: exact results that need no trained model and no spans of bytes."""
    return {"op2_warc": WARC_SQL, "op3_neardup": NEARDUP_SQL, "op7_suffixes": REPEATS_SQL, "op12_merkle": merkle.MERKLE_SQL, "op13_fill_in_middle": fim.FIM_SQL}
