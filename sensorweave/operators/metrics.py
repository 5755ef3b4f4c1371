"""Latency summaries by index percentiles, regression verdicts, log filters with redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.operators.retention import last_n, ranked
from sensorweave.sources.catalogs import LOG_LEVELS

REDACTED = "[PIXEL_DATA_REDACTED]"
#: Parts of a key's values, and sampled values for each.
PIECES, SAMPLED = 256, 64


def percentile_index(n: Column, share: float) -> Column:
    """The place (from 0) of an index percentile in a sorted list of ``n``."""
    if share == 0.5:
        return F.expr("0") + F.floor(n / 2).cast("bigint")
    return F.least((n * F.lit(share)).cast("bigint"), n - 1)


def part_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` (fewer than ``PIECES``) are below ``value``, by halving."""
    steps = F.array(*[F.lit(PIECES >> i) for i in range(1, PIECES.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) < value), at + step).otherwise(at))


def parted(counted: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``n``, the rows of the key, and ``_part``, which grows with the value: parts hold about as many values each.

    ``counted`` has each value (``_v``) of a key once, with its count (``_n``).  A sample of the values,
    those of some hashes, sets the cuts; it is the same whenever it is taken, as uses of the parts need.
    """
    sizes = counted.groupBy(*by).agg(F.count("*").alias("_d"), F.sum("_n").alias("n"))
    one_of = F.greatest(F.lit(1), F.floor(F.col("_d") / (PIECES * SAMPLED)))
    sample = counted.join(sizes, by).where(F.pmod(F.xxhash64("_v"), one_of) == 0)
    span = sample.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("_s"), F.first("n").alias("n"))
    every = F.transform(F.sequence(F.lit(1), F.lit(PIECES - 1)), lambda i: F.get("_s", F.floor(i * F.size("_s") / PIECES).cast("int")))
    return counted.join(span.select(*by, "n", every.alias("_cuts")), by).withColumn("_part", part_of(F.col("_v"), F.col("_cuts"))).drop("_cuts")


def index_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key: count and the values at the index percentiles of ``shares``; exact, whatever a key's size.

    Equal values are counted before the shuffle.  A key's values are cut into about ``PIECES`` parts of
    like numbers of values, however they are spread, whose exact counts tell which part holds a place;
    only within a part are values ranked, so a key with most of the rows is spread over its parts.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = parted(counted, by)
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    start = F.coalesce(F.sum("_m").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(parts.select(*by, "_part", start.alias("_start")), [*by, "_part"])
    end = F.col("_start") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("_end", end)

    def at(share: float) -> Column:
        k = percentile_index(F.col("n"), share)
        return F.max(F.when((k >= F.col("_end") - F.col("_n")) & (k < F.col("_end")), F.col("_v")))

    return placed.groupBy(*by).agg(F.max("n").alias("n"), *[at(s).alias(name) for name, s in shares.items()])


def stage_summary(metrics: DataFrame, stage: str = "stage_name", latency: str = "latency_ms", memory: str = "memory_allocated_bytes", baselines: dict[str, float] | None = None) -> DataFrame:
    """Per stage: recordings, median, p95, p99, peak memory, baseline (else the median) and gain in percent as float."""
    found = index_percentiles(metrics, [stage], latency, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    peak = metrics.groupBy(stage).agg(F.max(memory).alias("peak_memory"))
    found = found.join(peak, stage).withColumnRenamed("n", "iterations")
    given = F.lit(None).cast("double")
    for name, value in (baselines or {}).items():
        given = F.when(F.col(stage) == name, F.lit(float(value))).otherwise(given)
    found = found.withColumn("baseline", F.coalesce(given, F.col("median").cast("double")))
    gain = ((F.col("baseline") - F.col("median")) / F.col("baseline") * 100).cast("float")
    return found.withColumn("gain_percent", F.when(F.col("baseline") <= 0, F.lit(0.0).cast("float")).otherwise(gain))


def regression_rows(scenes: DataFrame, measured: DataFrame, slack: float = 0.5) -> DataFrame:
    """Scenes with their measured value (the baseline where none was measured) and whether it regressed."""
    joined = scenes.join(measured, "scene_id", "left").withColumn("measured", F.coalesce(F.col("psnr").cast("float"), F.col("baseline_psnr_min"))).drop("psnr")
    return joined.withColumn("is_regression", F.col("measured") < F.col("baseline_psnr_min") - F.lit(slack).cast("float"))


def regression_verdict(scenes: DataFrame, measured: DataFrame) -> DataFrame:
    """One row: scenes, passed, the sorted ids that regressed, whether none did."""
    return regression_rows(scenes, measured).agg(
        F.count("*").alias("total_scenes"), F.count_if(~F.col("is_regression")).alias("passed_scenes"), F.sort_array(F.collect_list(F.when(F.col("is_regression"), F.col("scene_id")))).alias("regressions"), F.bool_and(~F.col("is_regression")).alias("is_regression_free")
    )


def level_rank(level: Column) -> Column:
    """The order of a log level; null for an unknown one."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(LOG_LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def redact(message: Column) -> Column:
    """Messages that show pixel data are replaced as a whole; case counts."""
    return F.when(message.contains("ByteArray") | message.contains("FramePlane"), F.lit(REDACTED)).otherwise(message)


#: Entries that the structured and the telemetry log hold.
LOGS_HELD, EVENTS_HELD = 1000, 500


def filter_logs(logs: DataFrame, category: str | None = None, min_level: str = "DEBUG", limit: int = 100, seq: str = "timestamp_ns", held: int = LOGS_HELD) -> DataFrame:
    """Of the last ``held`` rows, the redacted ones of a category from a level on, and of those the last ``limit``."""
    kept = last_n(logs, [], seq, held).where(level_rank(F.col("level")) >= LOG_LEVELS.index(min_level))
    if category is not None:
        kept = kept.where(F.col("category") == category)
    return ranked(kept.withColumn("message", redact(F.col("message"))), [], seq, limit)


def log_event(payload: Column, tag: Column, timestamp_ms: Column) -> Column:
    """A map of strings with its tag and time, which replace those that it has."""
    own = F.map_filter(payload, lambda k, v: ~k.isin("tag", "timestamp_ms"))
    return F.map_concat(own, F.create_map(F.lit("tag"), tag, F.lit("timestamp_ms"), timestamp_ms.cast("string")))


def log_metric(name: Column, value: Column, timestamp_ms: Column) -> Column:
    return log_event(F.create_map(F.lit("name"), name, F.lit("value"), value.cast("string")), F.lit("METRIC"), timestamp_ms)


def log_error(tag: Column, message: Column, throwable: Column, stacktrace: Column, timestamp_ms: Column) -> Column:
    """The message and, if there is a throwable, its name and the first 500 characters of its trace."""
    base = F.create_map(F.lit("error_msg"), message)
    more = F.create_map(F.lit("throwable"), throwable, F.lit("stacktrace"), F.substring(stacktrace, 1, 500))
    return log_event(F.when(throwable.isNotNull(), F.map_concat(base, more)).otherwise(base), F.concat(F.lit("ERROR_"), tag), timestamp_ms)


def recent_events(events: DataFrame, seq: str, limit: int = EVENTS_HELD) -> DataFrame:
    """The last ``limit`` rows of a log that holds ``EVENTS_HELD``."""
    return last_n(events, [], seq, min(limit, EVENTS_HELD))
