"""Bounded samples of labelled documents for fitting, and the folds."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def held_out(key: str, folds: int, remainder: int) -> Column:
    """True for the rows of the fold that is never learned from; a null key counts as not held out."""
    return F.coalesce(fold(key, folds) == remainder, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, folds: int = 5, remainder: int = 0, key: str = "doc_id", text: str = "text", partitions: int = 24) -> DataFrame:
    """(key, text, label) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hash of their key are taken, so the sample is the same on every run and
    does not follow the order of the data.  Rows whose key or label is null are not learned from; a
    key with several labels takes the largest, and one with several texts the least, so a key is one row
    however often it is repeated.  The sample has a bound, so it is broadcast to find its texts; they are
    dealt to a fixed number of partitions and kept while fitting.
    """
    chosen = (
        labels.select(F.col(key), F.col(label).cast("int").alias(label))
        .where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, folds) != remainder))
        .groupBy(key)
        .agg(F.max(label).alias(label))
        .orderBy(F.xxhash64(key), key)
        .limit(max_rows)
    )
    found = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(chosen), key)
    found = found.groupBy(key).agg(F.min(text).alias(text), F.first(label).alias(label))
    return found.repartition(partitions, F.xxhash64(key)).persist(StorageLevel.MEMORY_AND_DISK)
