"""Labels and sizes for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_label(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def ev_label(steps: Column) -> Column:
    """Positive steps with a sign."""
    return F.concat(F.when(steps > 0, F.lit("+")).otherwise(F.lit("")), steps.cast("string"))


def shutter_label(ns: Column) -> Column:
    """An exposure time as a fraction of a second, the denominator whole."""
    return F.concat(F.lit("1/"), F.floor(F.lit(1_000_000_000) / F.greatest(ns, F.lit(1))).cast("string"), F.lit("s"))


def exposure_label(ns: Column) -> Column:
    """Whole milliseconds and the fraction of a second."""
    return F.concat(F.floor(ns / F.lit(1_000_000)).cast("string"), F.lit(" ms ("), shutter_label(ns), F.lit(")"))


def yuv_bytes(width: Column, height: Column) -> Column:
    """Bytes of a 4:2:0 frame."""
    return (width.cast("bigint") * height * F.lit(1.5)).cast("bigint")
