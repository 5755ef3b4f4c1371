"""Bounded retention: ring buffers, last-N logs, keyed stores, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring_retained(rows: DataFrame, by: list[str], seq: str, size: str, capacity: int = 16, max_bytes: int = 256 << 20) -> DataFrame:
    """What a ring holds after all pushes: the newest rows within both limits; a newest row over the limit stays alone.

    Only the newest ``capacity`` rows of a key can stay, so they are ranked first (Spark keeps the best
    rows of each partition before the shuffle) and sizes are summed over those alone.
    """
    order = Window.partitionBy(*by).orderBy(F.col(seq).desc())
    newest = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= capacity)
    held = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return newest.withColumn("_held", held).where((F.col("_rank") == 1) | (F.col("_held") <= max_bytes)).drop("_rank", "_held")


def ranked(rows: DataFrame, by: list[str], seq: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key by their rank; without a key all rows are ranked in one task."""
    order = Window.partitionBy(*by).orderBy(F.col(seq).desc())
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def newest_bound(rows: DataFrame, seq: str, n: int):
    """The ``n``-th largest value of ``seq``, or None if fewer rows have one.

    Only that column is read.  Partitions are put into groups, which keep their ``n`` largest values apart,
    so that the last task gets ``n`` numbers of a group and not of every partition.
    """
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = rows.select(F.col(seq).alias("_v")).where(F.col("_v").isNotNull()).withColumn("_g", F.spark_partition_id() % groups)
    top = ranked(narrow, ["_g"], "_v", n).orderBy(F.col("_v").desc()).limit(n).agg(F.count("*").alias("n"), F.min("_v").alias("least")).first()
    return top["least"] if top["n"] == n else None


def last_n(rows: DataFrame, by: list[str], seq: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key in order of arrival.

    Without a key the bound of these rows is found first; the rows from it on, which scans can skip to,
    are about ``n`` and go to one task.
    """
    bound = newest_bound(rows, seq, n) if not by else None
    if bound is not None:
        rows = rows.where(F.col(seq) >= F.lit(bound).cast(rows.schema[seq].dataType))
    return ranked(rows, by, seq, n)


def latest(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The last row of each key, by one aggregation."""
    others = [c for c in rows.columns if c not in by]
    found = rows.groupBy(*by).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return found.select(*by, *[F.col(f"_row.{c}").alias(c) for c in others])


def keyed_store(rows: DataFrame, by: list[str], key: str, seq: str, limit: int = 200) -> DataFrame:
    """A store that keeps the last row of each key and evicts smallest keys beyond ``limit``."""
    return last_n(latest(rows, [*by, key], seq), by, key, limit)


def upsert(base: DataFrame, changes: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write wins, over the rows of both."""
    return latest(base.unionByName(changes), key, seq)


def delete_by_id(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ``ids``."""
    return base.join(ids.select(key).distinct(), key, "left_anti")


def newest_first(rows: DataFrame, ts: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), *ties)
