"""Structured Streaming runs: named queries that go on where they stopped, deduplication, windows and sessions.

Streams run with availableNow over a file source. State, offsets and output of a query live under its name in the folder that the
cluster names in spark.checkpoint.dir. A query that was stopped or killed and is started again under its name replays the batch it
was in, from the offsets it had written: the file sink lists each batch's files in its own log once, and a complete result is
written under its batch's number, so no row is lost or doubled. Without a name a run gets a folder of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.session import named_folder, shared_folder


def as_instant(x: Column) -> Column:
    """A time without zone, read as UTC whatever the session's zone, as a timestamp; watermarks need one."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), x).cast("timestamp")


def as_utc(x: Column) -> Column:
    """A timestamp as a UTC time without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), x.cast("timestamp_ntz"))


def read_events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The events table as a stream, its times read as UTC, ``files`` of them in a batch at most."""
    schema = spark.read.parquet(f"{sf_dir}/events*.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    source = source if files is None else source.option("maxFilesPerTrigger", files)
    return source.parquet(f"{sf_dir}/events*.parquet").withColumn("ts", as_instant(F.col("ts")))


def folder_of(spark: SparkSession, name: str | None) -> str:
    return named_folder(spark, f"stream-{name}") if name else shared_folder(spark, "stream")


def start(stream: DataFrame, folder: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Start ``stream`` on the state in ``folder``, to the end of its source or, if not ``once``, until it is stopped."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")
    if mode != "complete":
        return writer.format("parquet").start(f"{folder}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    return writer.foreachBatch(put).start()


def result(spark: SparkSession, folder: str, schema, mode: str = "append") -> DataFrame:
    """What a query has written so far: all appended rows, or the complete result of the last batch that was finished."""
    if mode != "complete":
        return spark.read.schema(schema).parquet(f"{folder}/out")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(p.getName()) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.schema(schema).parquet(f"{folder}/out/{max(numbers)}") if numbers else spark.createDataFrame([], schema)


def finish(stream: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """Run a stream to the end of its source, going on where the query of that name stopped, and give all it has written.
    ``complete`` results replace each other."""
    folder = folder_of(stream.sparkSession, name)
    start(stream, folder, mode).awaitTermination()
    return result(stream.sparkSession, folder, stream.schema, mode)


def deduplicated(stream: DataFrame, key: list[str], late: str = "40 days") -> DataFrame:
    """Once per key: late rows are taken for as long as the watermark reaches, which bounds the state."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by event type in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user that a gap ends."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
