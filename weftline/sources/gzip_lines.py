"""A data source for lines of gzip files of many members, such as those that parallel compressors and archives write.

Spark reads a gzip file in one task, since a stream of deflate cannot be entered in its middle. A file of many members can, at
each of them. Every task gets a range of bytes and owns the members that begin in it. It looks for the first one: three bytes
that may stand anywhere, so a place counts only if a whole member can be unpacked from there, its checksum is right, and the file
ends or another member begins behind it: content that holds a packed file as it is does not mislead, unless it holds several in a
row (read such files with one range). From then on members follow each other. A line belongs to the task in whose member it begins: a task leaves out what stands before the first line
end, unless it begins the file, and reads on past its last member up to a line end. Lines are handed on as they are unpacked.

A file of one member stays one task's, whose other ranges are looked through in vain; pack such a file anew once."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.DOTALL)  # fixed values: how a member begins
WINDOW = 1 << 20  #: bytes read at a time
LINES = 4 << 20  #: bytes of lines in a batch, about
SPLIT = 32 << 20


def unpack(f, start: int) -> Iterator[tuple[bytes, int | None]]:
    """The member at ``start``: pieces of its content, the last one with the place of its end. Raises zlib.error where there
    is no whole member."""
    f.seek(start)
    box, at = zlib.decompressobj(wbits=31), start
    while True:
        packed = f.read(WINDOW)
        if not packed:
            raise zlib.error("the member is cut off")
        at += len(packed)
        data = box.decompress(packed)
        if box.eof:
            yield data, at - len(box.unused_data)
            return
        yield data, None


def is_member(f, start: int) -> bool:
    try:
        end = [end for _, end in unpack(f, start)][-1]
    except zlib.error:
        return False
    f.seek(end)
    behind = f.read(4)
    return not behind.strip(b"\0") or MAGIC.match(behind) is not None  # some writers fill up with zeros


def first_member(f, low: int, high: int) -> int | None:
    """Where the first member that begins in [low, high) does."""
    at = low
    while at < high:
        f.seek(at)
        window = f.read(min(WINDOW, high - at) + 3)
        for m in MAGIC.finditer(window):
            if at + m.start() < high and is_member(f, at + m.start()):
                return at + m.start()
        at += WINDOW
    return None


def contents(f, start: int, high: int, size: int) -> Iterator[tuple[bytes, bool]]:
    """(content, owned) of the member at ``start`` and those behind it; what is not owned belongs to a member that begins at
    ``high`` or after it. Ends where no member follows."""
    at = start
    while at < size:
        owned = at < high
        f.seek(at)
        if not MAGIC.match(f.read(4)):
            return
        for data, end in unpack(f, at):
            yield data, owned
            if end is not None:
                at = end


def lines_of(f, low: int, high: int, size: int) -> Iterator[bytes]:
    """The lines of a range in blocks of whole lines, without the last line end."""
    start = 0 if low == 0 else first_member(f, low, high)
    if start is None:
        return
    skipping, rest = low > 0, b""
    for data, owned in contents(f, start, high, size):
        if skipping:
            cut = data.find(b"\n")
            if cut < 0:
                if not owned:
                    return  # the line before fills all that this task owns
                continue
            if not owned:
                return
            data, skipping = data[cut + 1 :], False
        if not owned:
            cut = data.find(b"\n")
            if cut >= 0:
                yield rest + data[:cut]
                return
            rest += data
            continue
        rest += data
        if len(rest) >= LINES and (cut := rest.rfind(b"\n")) >= 0:
            yield rest[:cut]
            rest = rest[cut + 1 :]
    if rest and not skipping:
        yield rest.removesuffix(b"\n")


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int
    size: int


class GzipLinesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        store, path = pafs.FileSystem.from_uri(self.path)
        found = store.get_file_info([path])[0]
        files = store.get_file_info(pafs.FileSelector(path, recursive=True)) if found.type == pafs.FileType.Directory else [found]
        files = [x for x in files if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))]
        if not files:
            raise FileNotFoundError(self.path)
        return [Range(x.path, low, min(low + self.split, x.size), x.size) for x in sorted(files, key=lambda x: x.path) for low in range(0, x.size, self.split)] or [Range(files[0].path, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as f:
            for block in lines_of(f, partition.low, partition.high, partition.size):
                lines = [x.removesuffix("\r") for x in block.decode("utf-8", "replace").split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])


class GzipLines(DataSource):
    """``spark.read.format("gzip_lines").option("splitBytes", n).load(path)``: a file, or a folder of them; one column, value."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return GzipLinesReader(self.options)


def read_gzip_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value): the lines of gzip files, each range of ``split`` packed bytes in a task of its own."""
    spark.dataSource.register(GzipLines)
    return spark.read.format("gzip_lines").option("splitBytes", split).load(path)
