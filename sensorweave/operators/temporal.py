"""Alignment of time series: as-of join with interpolation, floor-else-ceiling match, clock reports, trailing windows.

Times are BIGINT (nanoseconds of a monotonic clock, or any other unit); Spark's timestamps would cut
nanoseconds.  Every function takes DataFrames and returns one; nothing comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.operators import pieces


def bracket(probes: DataFrame, samples: DataFrame, by: list[str], ts: str = "ts", values: str = "values", bucket: int | None = None) -> DataFrame:
    """Each probe with ``lo`` and ``hi``: structs (ts, v) of the last sample at or before it and the first one at or after it.

    Samples of equal key and time count once: the one of the largest values.  Without ``bucket`` the
    rows of one key are sorted together; with it, time is cut into pieces of that length, each sorted
    by itself, and the last and first samples of the pieces around are carried over, so that a key
    with very many rows, or no key at all, is no single task.
    """
    samples = samples.groupBy(*by, ts).agg(F.max(values).alias(values))
    piece = (F.floor(F.col(ts) / F.lit(bucket)) if bucket else F.lit(0)).alias("_piece")
    point = F.struct(F.col(ts).alias("ts"), F.col(values).alias("v"))
    extra = [c for c in probes.columns if c not in (*by, ts)]
    asked = probes.select(*by, F.col(ts), piece, F.struct(*[F.col(c) for c in extra] or [F.lit(1).alias("_none")]).alias("_row"), F.lit(None).cast(samples.select(point.alias("x")).schema[0].dataType).alias("_point"), F.lit(1).alias("_kind"))
    given = samples.select(*by, F.col(ts), piece, F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), point.alias("_point"), F.lit(0).alias("_kind"))
    rows = asked.unionByName(given)
    # a sample at the probe's own time stands before it in both orders; two sorts, each of one pass
    up = Window.partitionBy(*by, "_piece").orderBy(F.col(ts), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by, "_piece").orderBy(F.col(ts).desc(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lo", F.last("_point", ignorenulls=True).over(up)).withColumn("hi", F.last("_point", ignorenulls=True).over(down)).where("_kind = 1")
    if bucket:
        ends = given.groupBy(*by, "_piece").agg(F.max_by("_point", ts).alias("_last"), F.min_by("_point", ts).alias("_first"))
        pieces = rows.select(*by, "_piece").distinct().join(ends, [*by, "_piece"], "full")
        order = Window.partitionBy(*by).orderBy("_piece")
        before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("_first", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1))
        around = pieces.select(*by, "_piece", before.alias("_before"), after.alias("_after"))
        rows = rows.join(around, [*by, "_piece"], "left").withColumn("lo", F.coalesce("lo", "_before")).withColumn("hi", F.coalesce("hi", "_after"))
    return rows.select(*by, ts, *[F.col(f"_row.{c}").alias(c) for c in extra], "lo", "hi")


def interpolated(ts: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """(values, is_interpolated) for arrays of floats between two bracketing points.

    One-sided points are taken as they are; between two, each axis is linear in time, computed in
    doubles and stored as float, over the axes that both have.
    """
    alpha = (ts - lo["ts"]).cast("double") / (hi["ts"] - lo["ts"]).cast("double")
    n = F.least(F.size(lo["v"]), F.size(hi["v"]))
    mixed = F.zip_with(F.slice(lo["v"], 1, n), F.slice(hi["v"], 1, n), lambda a, b: (a.cast("double") + (b.cast("double") - a.cast("double")) * alpha).cast("float"))
    between = lo.isNotNull() & hi.isNotNull() & (lo["ts"] != hi["ts"])
    values = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["ts"] == hi["ts"]), lo["v"]).otherwise(mixed)
    return values, F.coalesce(between, F.lit(False))


def align(probes: DataFrame, samples: DataFrame, by: list[str], ts: str = "ts", values: str = "values", bucket: int | None = None) -> DataFrame:
    """As-of join with linear interpolation: probes with ``values`` and ``is_interpolated``."""
    found, flag = interpolated(F.col(ts), F.col("lo"), F.col("hi"))
    return bracket(probes, samples, by, ts, values, bucket).withColumn(values, found).withColumn("is_interpolated", flag).drop("lo", "hi")


def align_two(probes: DataFrame, first: DataFrame, second: DataFrame, by: list[str], names: tuple[str, str] = ("gyro", "accel"), ts: str = "ts", values: str = "values", bucket: int | None = None) -> DataFrame:
    """Both sensors at each probe; interpolated if either is."""
    a = align(probes, first, by, ts, values, bucket).withColumnsRenamed({values: names[0], "is_interpolated": "_i0"})
    return align(a, second, by, ts, values, bucket).withColumnRenamed(values, names[1]).withColumn("is_interpolated", F.col("_i0") | F.col("is_interpolated")).drop("_i0")


def floor_else_ceiling(probes: DataFrame, samples: DataFrame, by: list[str], ts: str = "ts", values: str = "values", bucket: int | None = None) -> DataFrame:
    """Probes with ``matched_ts``: the sample at or before the probe, else the first after; null without samples."""
    return bracket(probes, samples, by, ts, values, bucket).withColumn("matched_ts", F.coalesce(F.col("lo.ts"), F.col("hi.ts"))).drop("lo", "hi")


def clock_report(matched: DataFrame, by: list[str], order: str | None = None, ts: str = "ts", gap: int = 50_000_000, mean_limit: int = 50_000_000) -> DataFrame:
    """Per key: strictly increasing times, mean (cut to a whole number) and largest offset, offsets over ``gap``, verified.

    ``order`` is the column that gives the probes' arrival; without it, repeats of a time break the
    increase.  ``sample_count`` is the number of offsets; a key without any sample counts as increasing
    and not verified, with zeros elsewhere.
    """
    seen = Window.partitionBy(*by).orderBy(*([order] if order else [ts]))
    rows = matched.withColumn("_rise", F.coalesce(F.col(ts) > F.lag(ts).over(seen), F.lit(True))).withColumn("_offset", F.abs(F.col(ts) - F.col("matched_ts")))
    found = rows.groupBy(*by).agg(
        ((F.count("_offset") == 0) | F.bool_and("_rise")).alias("is_monotonic"),
        F.coalesce(F.avg("_offset").cast("bigint"), F.lit(0)).alias("avg_offset"),
        F.coalesce(F.max("_offset"), F.lit(0)).alias("max_offset"),
        F.count_if(F.col("_offset") > gap).alias("missing_intervals"),
        F.count("_offset").alias("sample_count"),
    )
    return found.withColumn("is_verified", F.col("is_monotonic") & (F.col("sample_count") > 0) & (F.col("avg_offset") < mean_limit))


def trailing_window(samples: DataFrame, by: list[str], length: int, ts: str = "ts") -> DataFrame:
    """The rows of each key not older than its newest time less ``length``; the newest times are aggregated first."""
    newest = samples.groupBy(*by).agg(F.max(ts).alias("_newest"))
    return samples.join(newest, by).where(F.col(ts) >= F.col("_newest") - length).drop("_newest")


def retained_window(samples: DataFrame, by: list[str], length: int, arrival: str, ts: str = "ts") -> DataFrame:
    """What a sensor's window holds after all arrivals: each drops what is older than its own time by more than ``length``.

    So a row stays unless one that arrives later is newer by more than ``length``; a late row, which
    drops little, may stay although it is older than the window.  Of rows of one time the last arrival
    stays.  Later arrivals' newest times are found within pieces of a key and carried back from the pieces after.
    """
    last = samples.groupBy(*by, ts).agg(F.max(arrival).alias("_last"))
    rows = pieces.cut(samples, by, [arrival])
    after = pieces.carried(rows, by, {"_m": F.max(ts)}, {"_after": F.max("_m")}, backwards=True)
    own = F.max(ts).over(pieces.within(by, F.col(arrival).desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.join_carried(rows.withColumn("_own", own), after, by)
    newer = F.greatest("_own", "_after")
    kept = rows.where(newer.isNull() | (F.col(ts) >= newer - length)).drop("_own", "_after", pieces.PIECE)
    same = F.col(arrival) == F.col("_last")
    for c in (*by, ts):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return kept.join(last.withColumnsRenamed({c: f"_k_{c}" for c in (*by, ts)}), same, "left_semi")
