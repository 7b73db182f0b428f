"""The vertices of a graph as two tables on disk, one by id and one by name, for look-ups of a few and joins of many.

Each table is cut into buckets by its key and sorted by it within a bucket, one file a bucket. A look-up by key opens the bucket
that can hold it, and in it the pages whose least and greatest key lie around it; where names are looked for that no page
excludes, the Bloom filter of a row group does. A join on the key reads the buckets as they lie: the vertex side, which is the large
one, is neither shuffled nor sorted."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP = 16 << 20  #: bytes of a row group: small ones make look-ups read less
KEYS = {"id": "rev_domain", "rev_domain": "id"}


class VertexTable:
    """Vertices (id, rev_domain) under ``path``, known to the session's catalog under ``name`` for as long as the session lives."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def build(cls, vertices: DataFrame, path: str, buckets: int | None = None, name: str | None = None) -> VertexTable:
        """Write ``vertices`` in both orders. ``buckets`` is the number of parts of a join, that of shuffle partitions if not
        given."""
        spark = vertices.sparkSession
        made = cls(spark, name or f"vertices_{uuid.uuid4().hex}")
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for key in KEYS:
            laid = vertices.select("id", "rev_domain").repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key)
            laid.option("path", f"{path}/by_{key}").option("parquet.block.size", ROW_GROUP).option(f"parquet.bloom.filter.enabled#{key}", "true").format("parquet").saveAsTable(made._table(key))
        return made

    def _table(self, key: str) -> str:
        return f"{self.name}_by_{key}"

    def by(self, key: str) -> DataFrame:
        """All vertices, laid by ``key``: the side of a join on it that stays where it is."""
        return self.spark.table(self._table(key))

    def find(self, ids: Iterable[int] = (), names: Iterable[str] = ()) -> DataFrame:
        """(id, rev_domain) of the ids and names given, each vertex once; those that the graph does not know give no row."""
        ids, names = list(ids), list(names)
        by_id = self.by("id").filter(F.col("id").isin(ids) if ids else F.lit(False))
        by_name = self.by("rev_domain").filter(F.col("rev_domain").isin(names) if names else F.lit(False))
        return by_id.unionByName(by_name).distinct()

    def resolve(self, rows: DataFrame, column: str, key: str = "id") -> DataFrame:
        """``rows`` with what the vertex of their ``column`` has besides ``key``; those of unknown vertices go."""
        other = KEYS[key]
        return rows.join(self.by(key).select(F.col(key).alias(column), other), column)

    def drop(self) -> None:
        """Take both tables out of the catalog; their files stay."""
        for key in KEYS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(key)}")
