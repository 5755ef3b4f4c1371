"""Places of rows in one total order over a whole table."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each piece; they set where pieces are cut, never what a row's place is.
SAMPLED = 20


def places(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Adds the place from 1 of each row in ``order``, nulls first; rows equal in it have adjoining places.

    The table is cut by range into pieces, as many as shuffle partitions, which are sorted apart; a piece
    starts after the rows of those before it.  Only bounds and counts of pieces come to the driver.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * pieces / max(1, rows.count()))
    sample = rows.select(*order).sample(share, seed=0).orderBy(*order).collect()
    bounds = list(dict.fromkeys(sample[i * len(sample) // pieces] for i in range(1, pieces))) if sample else []
    key = F.struct(*order)

    def piece(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        bound = F.struct(*[F.lit(bounds[at][c]).cast(rows.schema[c].dataType).alias(c) for c in order])
        return F.when(key > bound, piece(at + 1, high)).otherwise(piece(low, at))

    cut = rows.withColumn("_piece", piece(0, len(bounds)))
    sizes = {r["_piece"]: r["n"] for r in cut.groupBy("_piece").agg(F.count("*").alias("n")).collect()}
    starts = list(accumulate((sizes.get(i, 0) for i in range(len(bounds))), initial=0))
    start = F.array(*[F.lit(n).cast("bigint") for n in starts])[F.col("_piece")]
    return cut.withColumn(out, start + F.row_number().over(Window.partitionBy("_piece").orderBy(*order))).drop("_piece")
