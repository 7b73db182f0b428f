"""Readers and line parsers. Each reader is a Spark scan plus a parser over Columns, so the same parser serves files,
tables of lines and streams."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.gzip_lines import SPLIT, read_gzip_lines

JOURNAL_SCHEMA = "seq long, domain string, metric string, state string, value double, measured_at string"


# -- journal -------------------------------------------------------------------------------------
def parse_journal(lines: DataFrame, column: str = "value", schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """JSON lines to rows plus ``unreadable``: blank lines are skipped, broken ones marked, never swallowed."""
    parsed = F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.filter(F.trim(column) != "").select(parsed.alias("o")).select("o.*").withColumn("unreadable", F.col("_broken").isNotNull()).drop("_broken")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return parse_journal(spark.read.text(path))


# -- web graph -----------------------------------------------------------------------------------
def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src TAB dst`` lines to (src, dst); lines that are no pair are dropped."""
    parts = F.split(column, "\t")
    return lines.select(parts[0].try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def check_size(spark: SparkSession, path: str, least_bytes: int) -> None:
    """Refuse a file or folder that is smaller than a whole edition can be: a cut download must not pass for a small graph."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    if size < least_bytes:
        raise ValueError(f"{path} has {size} bytes, fewer than {least_bytes}")


def read_edges(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    """(src, dst) of edges in TSV, gzip or not; lines that are no edge are left out."""
    check_size(spark, path, least_bytes)
    return parse_edges(spark.read.text(path))


def read_gzip_edges(spark: SparkSession, path: str, least_bytes: int = 0, split: int = SPLIT) -> DataFrame:
    """The same of gzip files of many members, each of which many tasks read."""
    check_size(spark, path, least_bytes)
    return parse_edges(read_gzip_lines(spark, path, split))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a domain graph in gzip TSV. A gzip file is one task's here: read_gzip_edges() splits those of many
    members; convert others to Parquet once."""
    vertices = spark.read.csv(f"{path}/vertices*", sep="\t", schema="id long, rev_domain string, n long")
    return vertices, spark.read.csv(f"{path}/edges*", sep="\t", schema="src long, dst long")


# -- rank tables ---------------------------------------------------------------------------------
def header_key(name: str) -> str:
    """A header without case, spaces, ``_``, ``-`` and byte order mark."""
    return "".join(c for c in name.lower() if c not in " _-﻿")


def split_csv(line: Column, separator: str = ",") -> Column:
    """Fields of one CSV line by RFC 4180: quotes, doubled quotes, separators in quotes."""
    fields = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(rf'{separator}("(?:[^"]|"")*"|[^{separator}]*)'), F.lit(1))
    return F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def normalise_headers(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Columns by normalised header: {normalised: new name}; the rest is not read."""
    found = {header_key(c): c for c in df.columns}
    return df.select(*[F.col(f"`{found[k]}`").alias(v) for k, v in wanted.items() if k in found])


def read_rank_csv(spark: SparkSession, path: str, wanted: dict[str, str], domains: DataFrame | None = None) -> DataFrame:
    """A rank table; with ``domains`` only theirs are kept, by a semi join that Spark broadcasts if they are few."""
    rows = normalise_headers(spark.read.csv(path, header=True, quote='"', escape='"'), wanted)
    return rows if domains is None else rows.join(domains, "domain", "left_semi")


def unzip_lines(archives: DataFrame) -> DataFrame:
    """(path, value): lines of the files inside zip archives (path, content). An archive is one task's and its packed bytes
    are held, since a zip is read from its end; the lines are streamed out of it."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as raw:
                            part: list[str] = []
                            for line in io.TextIOWrapper(raw, "utf-8-sig", errors="replace"):
                                part.append(line.rstrip("\r\n"))
                                if len(part) == 10_000:
                                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], names=["path", "value"])
                                    part = []
                            if part:
                                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], names=["path", "value"])

    return archives.select("path", "content").mapInArrow(lines, "path string, value string")


def read_rank_zip(spark: SparkSession, path: str) -> DataFrame:
    return unzip_lines(spark.read.format("binaryFile").load(path))


def parse_origin_rank(line: Column) -> tuple[Column, Column]:
    """(origin, rank) split at the last comma."""
    return F.regexp_extract(line, r"^(.*),([0-9]+)$", 1), F.regexp_extract(line, r"^(.*),([0-9]+)$", 2).try_cast("long")


# -- small formats -------------------------------------------------------------------------------
def locale_number(x: Column) -> Column:
    """``1 234,5`` or ``12 %`` as a double; null where it is no number."""
    return F.regexp_replace(F.regexp_replace(x, r"[\s%  ]", ""), ",", ".").try_cast("double")


def magnitude(x: Column) -> Column:
    """``12.3K``, ``4M``, ``1B`` as a whole number."""
    number = F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBkmb]?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(x, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBkmb]?)", 2))
    return F.floor(number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0) + 0.5).cast("long")


def sitemap_entries(xml: Column) -> Column:
    """All ``<loc>`` values, ``&amp;`` read as the sign it stands for."""
    found = F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))


def sitemap_dates(xml: Column) -> Column:
    """All ``<lastmod>`` values."""
    return F.regexp_extract_all(xml, F.lit(r"(?i)<lastmod>\s*([^<]+?)\s*</lastmod>"), F.lit(1))


def parse_referrers(lines: DataFrame, own: str, column: str = "value") -> DataFrame:
    """``domain;links`` lines to (domain, links): the most links of each well-formed domain but the own."""
    parts = F.split(column, ";")
    rows = lines.select(F.lower(F.trim(parts[0])).alias("domain"), locale_number(F.get(parts, F.lit(1))).cast("long").alias("links"))
    return rows.filter((F.col("domain") != own) & F.col("domain").rlike(r"^([a-z0-9-]+\.)+[a-z]{2,}$") & F.col("links").isNotNull()).groupBy("domain").agg(F.max("links").alias("links"))


def byte_range(content: Column, start: Column, size: Column) -> Column:
    """``size`` bytes from ``start`` on (0 is the first)."""
    return F.substring(content, start + 1, size)


def unpivot_counts(df: DataFrame, key: str, prefix: str, n: int) -> DataFrame:
    """Wide ``prefix1..n`` columns as (key, place, count); zero counts are no facts."""
    stack = ", ".join(f"{i}, {prefix}{i}" for i in range(1, n + 1))
    return df.selectExpr(key, f"stack({n}, {stack}) AS (place, links)").filter("links > 0")


def decode_indexed_json(df: DataFrame, column: str) -> DataFrame:
    """JSON whose values are indices into one flat table (each object and list deduplicated) as plain JSON text."""

    def decode(text: str | None) -> str | None:
        if text is None:
            return None
        table = json.loads(text)
        seen: dict[int, object] = {}

        def at(i: int):
            if not isinstance(i, int) or i < 0 or i >= len(table):
                return None
            if i not in seen:
                value = table[i]
                if isinstance(value, dict):
                    seen[i] = {}
                    seen[i].update({k: at(v) for k, v in value.items()})
                elif isinstance(value, list):
                    seen[i] = []
                    seen[i].extend(at(v) for v in value)
                else:
                    seen[i] = value
            return seen[i]

        return json.dumps(at(0), sort_keys=True, separators=(",", ":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            i = batch.schema.get_field_index(column)
            columns[i] = pa.array([decode(x) for x in columns[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def parse_cdx(json_text: Column) -> Column:
    """Archive index JSON, whose first row is the header, as an array of maps."""
    rows = F.from_json(json_text, "array<array<string>>")
    return F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.map_from_arrays(F.element_at(rows, 1), r))


def split_warc(record: Column) -> Column:
    """A WARC record's (header, http header, body): cut at the first two blank lines."""
    parts = F.split(record, "\r\n\r\n", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("warc_head"), F.get(parts, F.lit(1)).alias("http_head"), F.get(parts, F.lit(2)).alias("body"))


def iso_utc(x: Column) -> Column:
    """A UTC time without zone as ``2024-01-31T09:30:15Z``."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_between(early: Column, late: Column) -> Column:
    """Whole days between two ISO times, rounded, halves up."""
    at = lambda x: F.try_to_timestamp(F.regexp_replace(x, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", at(early), at(late)) / 86400 + 0.5).cast("long")


def timestamp14(x: Column) -> Column:
    """14-digit archive time as a timestamp without zone."""
    return F.try_to_timestamp(x, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
