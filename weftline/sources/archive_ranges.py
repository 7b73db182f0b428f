"""Records of web archives by byte range, as an archive index names them: (file, offset, length), a packed record each.

The index is put in order of file and offset by ranges, so a task has ranges that lie next to each other, a file that many ask for is
shared among tasks, and each task opens each of its files once. Ranges of a file that are near each other are read in one
request, gaps included, up to a size; a request costs more than the bytes between."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 64 << 10  #: bytes between two ranges that are read together
MOST = 8 << 20  #: bytes of a request, unless one range is longer


def open_file(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def unpacked(data: bytes, length: int) -> tuple[bytes | None, str | None]:
    """(record, error) of one whole gzip member; what is no gzip stays as it is."""
    if len(data) < length:
        return None, f"{len(data)} bytes of {length}"
    if data[:2] != b"\x1f\x8b":
        return data, None
    try:
        box = zlib.decompressobj(wbits=31)
        record = box.decompress(data) + box.flush()
        return (record, None) if box.eof else (None, "the member is cut off")
    except zlib.error as error:
        return None, str(error)


def fetch(wanted: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = MOST, opener: Callable = open_file) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, error) for each of ``wanted`` (file, offset, length), in order; best in order of file and offset."""
    held: list[tuple[str, int, int]] = []
    name, f = None, None

    def flush() -> Iterator[tuple[bytes | None, str | None]]:
        nonlocal name, f
        if not held:
            return
        try:
            if held[0][0] != name:
                if f is not None:
                    f.close()
                name, f = None, opener(held[0][0])
                name = held[0][0]
            low = held[0][1]
            f.seek(low)
            data = f.read(max(o + n for _, o, n in held) - low)
        except OSError as error:
            yield from ((None, str(error)) for _ in held)
            return
        for _, offset, length in held:
            yield unpacked(data[offset - low : offset - low + length], length)

    end = 0
    for file, offset, length in wanted:
        if held and (file != held[0][0] or offset < held[0][1] or offset - end > gap or max(end, offset + length) - held[0][1] > most):
            yield from flush()
            held = []
        end = max(end, offset + length) if held else offset + length
        held.append((file, offset, length))
    yield from flush()
    if f is not None:
        f.close()


def read_ranges(index: DataFrame, key: str, gap: int = GAP, most: int = MOST) -> DataFrame:
    """(key, file, offset, record, error) for each row of ``index`` (key, file, offset, length). A range that cannot be read, or
    holds no whole record, is told with its reason; the others go on."""
    kind = index.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def wanted() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                    waiting.append(row)
                    yield row[1:]

        out, size = [], 0
        for record, error in fetch(wanted(), gap, most):
            row = waiting.pop(0)
            out.append((*row[:3], record, error))
            size += len(record or b"")
            if size > most or len(out) >= 1000:
                yield told(out)
                out, size = [], 0
        if out:
            yield told(out)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = (None, pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "file", "offset", "record", "error"])

    rows = index.select(F.col(key).alias("key"), "file", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    laid = rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return laid.mapInArrow(run, f"key {kind}, file string, offset long, record binary, error string").withColumnRenamed("key", key)


def write_archives(records: DataFrame, key: str, content: str, folder: str) -> DataFrame:
    """Write ``records`` as archives under ``folder``, each packed as a gzip member, a file for each task, and give their index (key,
    file, offset, length). A task that is run again writes a file of another name: only what the index names counts, so the
    caller writes the index before using it."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        uri = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        at = 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                rows = []
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    box = zlib.compressobj(wbits=31)
                    packed = box.compress(data or b"") + box.flush()
                    out.write(packed)
                    rows.append((k, uri, at, len(packed)))
                    at += len(packed)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["key", "file", "offset", "length"])

    return records.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, file string, offset long, length long").withColumnRenamed("key", key)
