"""Helpers the operators of this subpackage share: byte hashing in numpy and shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15 | 1
ROWS_PER_BATCH = 500


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int = 1) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))


def prefix_hash(data: np.ndarray, base: int = BASE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers) from which span_hash gives the hash of any span in O(1)."""
    n = len(data)
    powers = np.empty(n + 1, np.uint64)
    powers[0] = 1
    powers[1:] = np.uint64(base)
    np.cumprod(powers, out=powers)
    inverse = np.empty(n + 1, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(base, -1, 1 << 64))
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * powers[:n], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = separators(b"\x20\x09\x0a\x0b\x0c\x0d")


def word_spans(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~is_sep[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SEGMENT = 1 << 20


def word_hashes(raw: bytes, is_sep: np.ndarray, first: int | None = None) -> np.ndarray:
    """Hashes of the words of one text, or of their ``first`` bytes, in order. Long texts go in segments cut between words."""
    out, at, n = [], 0, len(raw)
    data = np.frombuffer(raw, np.uint8)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            cut = np.flatnonzero(is_sep[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word of over a segment: take all of it
                more = np.flatnonzero(is_sep[data[end:]])
                end = end + int(more[0]) if len(more) else n
        part = data[at:end]
        starts, ends = word_spans(part, is_sep)
        if len(starts):
            sums, inverse = prefix_hash(part)
            out.append(span_hash(sums, inverse, starts, ends if first is None else np.minimum(ends, starts + first)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, in log2(width) passes."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KEPT: list[str] = []  #: folders made by this driver, for remove_kept


def shared_dir(spark: SparkSession, kind: str = "table") -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share. Where that is unset, one machine sets its own;
    a cluster is told to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints/weftline"
        spark.conf.set("spark.checkpoint.dir", root)
    KEPT.append(f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}-{kind}")
    return KEPT[-1]


def keep(spark: SparkSession, df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Delete tables that keep() has written. Only for those that nothing reads any more: all that was made of them has
    been written itself, so no lost executor can ask for them again."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("weftline-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove_kept(spark: SparkSession) -> None:
    """Delete every folder that this driver's operators have left in the shared folder. Their results are lazy and read
    them, so the caller does this once the results have been written."""
    while KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(KEPT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession) -> None:
    """Batches small enough for long texts: rows of 100 kB make batches of 50 MB. Spark reads the size when it runs a plan,
    so the session's setting is lowered and stays so (README); a lower one is left alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, str(ROWS_PER_BATCH))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow in such batches."""
    arrow_rows(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of a stream of batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def text_bytes(df: DataFrame, *keep_columns: str, text: str = "text") -> DataFrame:
    """Only the columns an operator needs, the text as UTF-8 bytes under the name ``raw`` (null: empty)."""
    return df.select(*keep_columns, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
