"""A stored table of rows by key: overwritten by id, deleted by id, rewritten in part.

Rows lie in folders by a hash of their key.  Changes and tombstones are appended beside them; readers take
the last write of each key.  Compaction rewrites only the folders that changes have touched, by dynamic
partition overwrite, and then drops the change files that it has read: repeated after a failure it
gives the same rows, and changes that come meanwhile stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.session import exists, remove

BUCKET, SEQ, GONE = "_bucket", "_seq", "_gone"


class KeyedStore:
    """Rows of ``schema`` under ``path``, one for each value of ``key``; the write of the largest sequence counts, a tombstone over a row of its own sequence."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.columns = [f.name for f in schema.fields]
        # a tombstone has nothing but its key
        self.schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(SEQ, T.LongType()), T.StructField(GONE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])

    def _append(self, rows: DataFrame, seq: str, gone: bool) -> None:
        others = [F.lit(None).cast(self.schema[c].dataType).alias(c) if c not in rows.columns else F.col(c) for c in self.columns]
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        made = rows.select(*others, F.col(seq).cast("bigint").alias(SEQ), F.lit(gone).alias(GONE), bucket.alias(BUCKET))
        # of a batch's writes of one key only the last is stored
        made = self._last(made) if not gone else made.groupBy(*self.key, GONE, BUCKET).agg(F.max(SEQ).alias(SEQ), *[F.first(c).alias(c) for c in self.columns if c not in self.key])
        made.select(*self.schema.names).write.mode("append").partitionBy(BUCKET).parquet(f"{self.path}/changes")

    def put(self, rows: DataFrame, seq: str) -> None:
        """Adds rows or writes over those of their keys."""
        self._append(rows, seq, False)

    def delete(self, ids: DataFrame, seq: str) -> None:
        """Takes keys away; later writes bring them back."""
        self._append(ids.select(*self.key, seq), seq, True)

    def _last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in self.schema.names if c not in self.key]
        found = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), F.struct(SEQ, GONE)).alias("_row"))
        return found.select(*self.key, *[F.col(f"_row.{c}").alias(c) for c in others])

    def _part(self, name: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def read(self) -> DataFrame:
        """The row of each key as last written, without those deleted."""
        rows = self._part("base").unionByName(self._part("changes"))
        return self._last(rows).where(~F.col(GONE)).select(*self.columns)

    def compact(self) -> list[int]:
        """Rewrites the folders that changes have touched and drops these changes; gives the folders' numbers."""
        if not exists(self.spark, f"{self.path}/changes"):
            return []
        files = self._part("changes").inputFiles()
        if not files:
            return []
        changes = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/changes").parquet(*files)
        touched = sorted(r[BUCKET] for r in changes.select(BUCKET).distinct().collect())
        old = self._part("base").where(F.col(BUCKET).isin(touched))
        staged = f"{self.path}/staged"
        merged = self._last(old.unionByName(changes)).where(~F.col(GONE)).select(*self.schema.names)
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(staged)
        rows = self.spark.read.schema(self.schema).parquet(staged)
        left = {r[BUCKET] for r in rows.select(BUCKET).distinct().collect()}
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/base")
        for bucket in touched:
            if bucket not in left:
                remove(self.spark, f"{self.path}/base/{BUCKET}={bucket}")
        for file in files:
            remove(self.spark, file)
        remove(self.spark, staged)
        return touched
