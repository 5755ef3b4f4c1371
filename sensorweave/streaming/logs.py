"""An appended log that a stream writes batch by batch, with rolling retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorweave.operators.retention import ranked
from sensorweave.session import exists, remove


class RollingLog:
    """Rows under ``path``, a folder for each batch, of which the last ``held`` in order of batch and ``seq`` count.

    A batch that is written again after a failure replaces its own folder, so it adds nothing.  Folders
    that hold none of the last rows are dropped after each batch; at most one folder holds rows beyond
    them.  A log belongs to one stream and its checkpoint, whose batch numbers it uses.
    """

    def __init__(self, spark: SparkSession, path: str, held: int, seq: str):
        self.spark, self.path, self.held, self.seq = spark, path.rstrip("/"), held, seq

    def append(self, rows: DataFrame, batch: int) -> None:
        """Writes one batch and drops what no longer counts; only a batch's last ``held`` rows are written."""
        kept = ranked(rows, [], self.seq, self.held) if self.held < 100_000 else rows
        kept.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        self.trim()

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def trim(self) -> None:
        """Drops the folders of batches before the one in which the ``held``-th last row lies."""
        sizes = {r["batch"]: r["n"] for r in self._stored().groupBy("batch").agg(F.count("*").alias("n")).collect()}
        after = 0
        for batch in sorted(sizes, reverse=True):
            if after >= self.held:
                remove(self.spark, f"{self.path}/batch={batch}")
            after += sizes[batch]

    def read(self, n: int | None = None) -> DataFrame:
        """The last ``n`` rows, or all that count."""
        rows = self._stored()
        order = Window.orderBy(F.col("batch").desc(), F.col(self.seq).desc())
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= min(n or self.held, self.held)).drop("_rank", "batch")

    def empty(self) -> None:
        """Drops all rows."""
        if exists(self.spark, self.path):
            remove(self.spark, self.path)

    def follow(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Starts writing the stream's batches; a restart from ``checkpoint`` goes on where it ended."""
        writer = stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
