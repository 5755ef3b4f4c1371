"""Ordered rows of a key cut into pieces by range, so that what depends on all rows before takes many tasks.

A table is cut at bounds in the order of (key, order), so a key with most of the rows lies in many pieces
and a small key in one or two.  Work inside a piece is done apart; what a piece passes on (a count, a
maximum, a last row, a map of states) is one row for each key and piece and is carried over by a window
over those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "_piece"
#: Pieces that a table is cut into at most, and sampled rows for each; the sample sets where cuts lie, never a result.
MOST_PIECES, SAMPLED = 512, 20


def cut(rows: DataFrame, by: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """Adds ``_piece``, which grows with (by, order) and is the same for rows equal in it; only bounds come to the driver."""
    wanted = pieces or min(MOST_PIECES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [*by, *order]
    share = min(1.0, SAMPLED * wanted / max(1, rows.count()))
    sample = rows.select(*at).sample(share, seed=0).orderBy(*at).limit(4 * SAMPLED * wanted).collect()
    bounds = list(dict.fromkeys(sample[i * len(sample) // wanted] for i in range(1, wanted))) if sample else []
    key = F.struct(*at)

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = F.struct(*[F.lit(bounds[middle][c]).cast(rows.schema[c].dataType).alias(c) for c in at])
        return F.when(key > bound, place(middle + 1, high)).otherwise(place(low, middle))

    return rows.withColumn(PIECE, place(0, len(bounds)))


def within(by: list[str], *order: Column | str):
    """The window over the rows of one key in one piece."""
    return Window.partitionBy(*by, PIECE).orderBy(*order)


def carried(cut_rows: DataFrame, by: list[str], summary: dict[str, Column], carry: dict[str, Column], backwards: bool = False) -> DataFrame:
    """(by, _piece, what comes from the pieces before): ``summary`` aggregates each piece, ``carry`` those before it.

    The columns of ``carry`` are aggregates over the columns of ``summary``; with ``backwards`` they
    are over the pieces after.  Pieces without any before have nulls.
    """
    ends = cut_rows.groupBy(*by, PIECE).agg(*[c.alias(name) for name, c in summary.items()])
    order = F.col(PIECE).desc() if backwards else F.col(PIECE)
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*by, PIECE, *[c.over(before).alias(name) for name, c in carry.items()])


def join_carried(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """The rows with what their piece gets; keys may be null."""
    renamed = found.withColumnsRenamed({c: f"_c_{c}" for c in (*by, PIECE)})
    same = F.lit(True)
    for c in (*by, PIECE):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return rows.join(renamed, same, "left").drop(*[f"_c_{c}" for c in (*by, PIECE)])
