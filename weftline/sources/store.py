"""Durable sinks: a journal under a transaction log, and writes in small batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import journal as J
from weftline.sources.txlog import Conflict, TransactionTable

TRIES = 20  #: of a writer that others keep overtaking


class JournalStore:
    """A journal under ``path``, in files by day of measure. Any number of writers; one that was overtaken by another that
    touched its days works anew on what is there then."""

    def __init__(self, spark: SparkSession, path: str, before_commit: Callable[[], None] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = TransactionTable(spark, path, F.col("measured_at").cast("date"), before_commit)

    def read(self, version: int | None = None) -> DataFrame:
        """The journal now, or as it was at a version."""
        return self.table.read(None if version is None else self.table.snapshot(version))

    def _settle(self, work: Callable[[], object]):
        for _ in range(TRIES):
            try:
                return work()
            except Conflict:
                continue
        raise Conflict(f"overtaken {TRIES} times")

    def append(self, batch: DataFrame, allow_repeats: bool = False) -> int | None:
        """Add the rows of ``batch`` whose content is new; the same batch twice adds nothing the second time. The day is part
        of a row's content, so only the batch's days are read. Gives the version, or None where nothing was new."""

        def work() -> int | None:
            base = self.table.snapshot()
            days = self.table.parts_of(batch)
            adds = self.table.write(J.new_facts(self.table.read(base, days) if base.schema else batch.limit(0), batch, allow_repeats))
            if not adds and base.schema:
                return None
            return self.table.commit(base, "append", adds, read=set() if allow_repeats else days, schema=None if base.schema else batch.schema.json())

        return self._settle(work)

    def compact(self, key: str = "obs_id") -> dict[str, int]:
        """Keep the last row of each id; rows without an id all stay. Rows that others append meanwhile stay too; the files
        of the version before are there until vacuum()."""

        def work() -> dict[str, int]:
            base = self.table.snapshot()
            adds = self.table.write(J.compact(self.table.read(base), key))
            version = self.table.commit(base, "compact", adds, base.files, changes=False)
            return {"before": self.table.read(base).count(), "after": self.read(version).count()}

        return self._settle(work)

    def purge(self, doomed: Column, reason: str = "not stated") -> dict[str, object]:
        """Take out the rows that ``doomed`` says. Only files of the days that hold some are written anew; what they held is
        backed up in a folder that outlives vacuum(), and PURGES and the log keep the reason."""

        def work() -> dict[str, object]:
            base = self.table.snapshot()
            days = self.table.parts_of(self.table.read(base).filter(F.coalesce(doomed, F.lit(False))))
            hit = self.table.read(base, days)
            stays, _ = J.purge(hit, doomed)
            backup = f"{self.path}/backup-{uuid.uuid4().hex}"
            hit.write.parquet(backup)
            adds = self.table.write(stays)
            self.table.commit(base, "purge", adds, [p for p, day in base.files.items() if day in days], read=days, reason=reason)
            before = self.table.read(base).count()
            return {"before": before, "removed": hit.count() - stays.count(), "backup": backup, "reason": reason, "version": base.version}

        facts = self._settle(work)
        self.spark.createDataFrame([tuple(facts.values())], "before long, removed long, backup string, reason string, version long").write.mode("append").json(f"{self.path}/PURGES")
        return facts


MOST_PARAMETERS = 100  #: of one statement of the target


def write_batches(df: DataFrame, sink: Callable[[list[tuple]], None], most: int = MOST_PARAMETERS) -> DataFrame:
    """Hand the rows of ``df`` to ``sink`` in batches of at most ``most`` values, on the executors. Gives a row for each batch
    (n_rows, written, error): one that fails is reported with its reason, not hidden, and the others go on."""
    rows_each = max(1, most // len(df.columns))
    schema = pa.schema([("n_rows", pa.int64()), ("written", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            told = []
            for at in range(0, len(rows), rows_each):
                part = rows[at : at + rows_each]
                try:
                    sink(part)
                    told.append((len(part), True, None))
                except Exception as error:  # a sink may raise anything; the batch is reported
                    told.append((len(part), False, str(error)))
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*told, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, "n_rows long, written boolean, error string")
