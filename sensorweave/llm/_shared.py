"""Intermediate tables in the folder that driver and executors share, and joins with a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only after its bytes were summed and are at most so many.
BROADCAST_BYTES = 8 << 20
#: Bytes of an Arrow batch, which JVM and Python worker each hold at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error,
    as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        found = f"file://{tempfile.mkdtemp(prefix='sensorweave-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes of an Arrow batch to ``BATCH_BYTES``, so that long texts do not add up."""
    now = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Neither lost executors nor later stages compute them again, and Spark packs small files into tasks by
    their bytes when it reads them.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The tables that one operator writes on its way; those no longer read can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.path, self.count = spark, scratch(spark, name), 0
        self.places: dict[int, tuple[DataFrame, str]] = {}

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, stored."""
        place, self.count = f"{self.path}/{self.count}", self.count + 1
        df.write.parquet(place)
        found = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(found)] = found, place
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files of tables that ``add`` returned."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.places.pop(id(df))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes the files of all tables but these."""
        kept = {id(df) for df in tables}
        self.drop(*[df for k, (df, _) in list(self.places.items()) if k not in kept])


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""

    def width(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(x), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(x, F.lit(16).cast("bigint"), lambda a, v: a + width(v, kind.elementType)), F.lit(16))
        if isinstance(kind, T.StructType):
            return sum((width(x[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("bigint")


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows' bytes, summed in a pass over it, are within ``limit``, else as it is, to be joined by shuffling."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit else df
