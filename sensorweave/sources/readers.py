"""Readers: JSON artifacts, camera enumeration with defaults and labels, sample streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENSORS = ("GYROSCOPE", "ACCELEROMETER")

# Hardware levels and image formats by code.
HARDWARE_LEVELS = {0: "LIMITED", 1: "FULL", 2: "LEGACY", 3: "LEVEL_3", 4: "EXTERNAL"}
FORMATS = {32: "RAW_SENSOR", 34: "PRIVATE", 35: "YUV_420_888", 37: "RAW10", 38: "RAW12", 256: "JPEG", 1212500294: "HEIC"}
# Dynamic ranges and stream uses by code.
DYNAMIC_RANGES = {2: "HLG10", 4: "HDR10", 8: "HDR10_PLUS", 64: "DOLBY_VISION_10B"}
STREAM_USES = {1: "PREVIEW", 2: "STILL_CAPTURE", 3: "VIDEO_RECORD", 4: "PREVIEW_VIDEO_STILL", 5: "VIDEO_CALL"}
# Codes of the logical camera capability, stabilisation, the night scene, and exposure priorities.
LOGICAL_CAMERA, OIS_ON, NIGHT_SCENE, FACING_FRONT = 11, 1, 5, 0
PRIORITY_MODES = {6: "ISO_PRIORITY", 7: "EXPOSURE_TIME_PRIORITY"}


def json_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that spans lines; damaged parts become nulls."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def label(code: Column, names: dict[int, str], unknown: str) -> Column:
    """The name of a code, or ``unknown`` followed by the code."""
    out = F.concat(F.lit(unknown), code.cast("string"))
    for value, name in names.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def prefixed(codes: Column, prefix: str) -> Column:
    return F.transform(codes, lambda c: F.concat(F.lit(prefix), c.cast("string")))


def _profile() -> list[Column]:
    formats = F.transform("formats", lambda c: label(c, FORMATS, "FORMAT_"))
    return [
        label(F.coalesce("level", F.lit(2)), HARDWARE_LEVELS, "UNKNOWN_").alias("hardware_level"),
        formats.alias("formats"),
        F.struct(F.coalesce("iso_lo", F.lit(100)).alias("lo"), F.coalesce("iso_hi", F.lit(3200)).alias("hi")).alias("iso_range"),
        F.struct(F.coalesce("exposure_lo", F.lit(100_000)).cast("bigint").alias("lo"), F.coalesce("exposure_hi", F.lit(1_000_000_000)).cast("bigint").alias("hi")).alias("exposure_range_ns"),
        F.coalesce("orientation", F.lit(90)).alias("sensor_orientation"),
        F.when(F.coalesce("min_focus", F.lit(0.1)) > 0, 1 / F.coalesce(F.col("min_focus").cast("double"), F.lit(0.1))).otherwise(0.1).alias("focus_distance"),
        prefixed(F.col("ae_modes"), "AE_MODE_").alias("ae_modes"),
        (F.array_contains(formats, "RAW_SENSOR") | F.array_contains(formats, "RAW10")).alias("has_raw"),
    ]


def camera_profiles(raw: DataFrame) -> DataFrame:
    """Discovered cameras (camera_id, level, formats, iso_lo, iso_hi, exposure_lo, exposure_hi, orientation, min_focus, ae_modes) with defaults and labels."""
    return raw.where(F.col("camera_id").isNotNull()).select("camera_id", *_profile())


CAMERA_SCHEMA = (
    "camera_id string, level int, facing int, capabilities array<int>, physical_ids array<string>, active struct<w:int,h:int>, pixels struct<w:int,h:int>, size_mm struct<w:float,h:float>, max_frame_ns bigint, white_level int, "
    "focal_lengths array<float>, apertures array<float>, hyperfocal float, ois array<int>, ae_modes array<int>, af_modes array<int>, awb_modes array<int>, ev_lo int, ev_hi int, ev_step float, ae_lock boolean, awb_lock boolean, "
    "formats array<int>, dynamic_ranges array<bigint>, stream_uses array<bigint>, scene_modes array<int>, orientation int, iso_lo int, iso_hi int, exposure_lo bigint, exposure_hi bigint, min_focus float"
)


def camera_scan(spark: SparkSession, path: str) -> DataFrame:
    """Cameras from JSON lines in ``CAMERA_SCHEMA``; a line that cannot be read, or has no id, is left out and the others stay."""
    parsed = F.from_json("value", f"{CAMERA_SCHEMA}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    return spark.read.text(path).select(parsed.alias("x")).select("x.*").where("_damaged is null and camera_id is not null").drop("_damaged")


def named(codes: Column, names: dict[int, str]) -> Column:
    """The names of the codes that have one, in order of the codes given."""
    found = F.lit(None).cast("string")

    def one(c: Column) -> Column:
        out = found
        for code, name in names.items():
            out = F.when(c == code, F.lit(name)).otherwise(out)
        return out

    return F.filter(F.transform(codes, one), lambda x: x.isNotNull())


def _capabilities(raw: DataFrame) -> list[Column]:
    def codes(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(raw.schema[name].dataType))

    def floats(name: str, usual: float) -> Column:
        return F.coalesce(F.col(name), F.array(F.lit(usual).cast("float")))

    def usual(name: str, value: float | bool, kind: str) -> Column:
        return F.coalesce(F.col(name), F.lit(value).cast(kind))

    def record(name: str, there: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), there.alias("value"), F.when(there, "DISCOVERED").otherwise("UNSUPPORTED").alias("status"), F.lit(True).alias("tested"), F.lit(False).alias("verified"))

    formats = F.transform(codes("formats"), lambda c: label(c, FORMATS, "FORMAT_"))
    asked = codes("dynamic_ranges")  # in the order of the table, the standard range first
    ranges = F.concat(F.array(F.lit("SDR")), F.filter(F.array(*[F.when(F.array_contains(asked, F.lit(k).cast("bigint")), v) for k, v in DYNAMIC_RANGES.items()]), lambda x: x.isNotNull()))
    ois = F.transform(codes("ois"), lambda c: F.when(c == OIS_ON, "ON").otherwise("OFF"))
    logical = F.array_contains(codes("capabilities"), LOGICAL_CAMERA)
    return [
        F.when(F.col("facing") == FACING_FRONT, "FRONT").otherwise("BACK_WIDE").alias("lens_facing"),
        logical.alias("is_logical"),
        F.coalesce("physical_ids", F.array().cast("array<string>")).alias("physical_ids"),
        *[F.coalesce(F.col(c), F.struct(F.lit(4000).alias("w"), F.lit(3000).alias("h"))).alias(c) for c in ("active", "pixels")],
        F.coalesce("size_mm", F.struct(F.lit(6.4).cast("float").alias("w"), F.lit(4.8).cast("float").alias("h"))).alias("size_mm"),
        usual("max_frame_ns", 33_333_333, "bigint").alias("max_frame_ns"),
        F.col("white_level"),
        F.lit("RGGB").alias("color_filter"),
        floats("focal_lengths", 5.59).alias("focal_lengths"),
        floats("apertures", 1.6).alias("apertures"),
        usual("hyperfocal", 0.0, "float").alias("hyperfocal"),
        ois.alias("ois_modes"),
        *[prefixed(codes(f"{x}_modes"), f"{x.upper()}_MODE_").alias(f"{x}_modes") for x in ("ae", "af", "awb")],
        F.struct(usual("ev_lo", -6, "int").alias("lo"), usual("ev_hi", 6, "int").alias("hi")).alias("ev_range"),
        usual("ev_step", 0.333, "float").alias("ev_step"),
        usual("ae_lock", False, "boolean").alias("ae_lock"),
        usual("awb_lock", False, "boolean").alias("awb_lock"),
        ranges.alias("dynamic_ranges"),
        named(codes("stream_uses"), STREAM_USES).alias("stream_uses"),
        named(codes("ae_modes"), PRIORITY_MODES).alias("hybrid_ae_modes"),
        F.array_contains(codes("scene_modes"), NIGHT_SCENE).alias("night_mode"),
        F.array_contains(ranges, "HDR10").alias("ultra_hdr"),
        F.array(record("LOGICAL_MULTI_CAMERA", logical), record("OPTICAL_STABILIZATION", F.array_contains(ois, "ON")), record("RAW_SENSOR", F.array_contains(formats, "RAW_SENSOR") | F.array_contains(formats, "RAW10"))).alias("capabilities"),
    ]


def camera_capabilities(raw: DataFrame) -> DataFrame:
    """What ``camera_profiles`` leaves out, of rows in ``CAMERA_SCHEMA``: sensor, lens, 3A, stream and capability records with their defaults."""
    return raw.where(F.col("camera_id").isNotNull()).select("camera_id", *_capabilities(raw))


def camera_records(raw: DataFrame, keys: list[str]) -> DataFrame:
    """All columns of ``camera_profiles`` and ``camera_capabilities`` by ``keys``, as camera ids repeat between devices."""
    profile = [c for c, name in zip(_profile(), camera_profiles(raw).columns[1:], strict=True) if name != "ae_modes"]
    return raw.where(F.col("camera_id").isNotNull()).select(*keys, "camera_id", *profile, *_capabilities(raw))


ARRIVALS = "stream string, side string, timestamp_ns bigint, arrival_ms bigint"


def arrival_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """Images and capture results as they arrive: a stream of JSON lines in ``ARRIVALS``, so many files a batch."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_each).json(path)


def imu_samples(rows: DataFrame, seq: str | None = None) -> DataFrame:
    """Samples of the two sensors, one by sensor and time; of several the last by ``seq`` counts."""
    known = rows.where(F.col("sensor_type").isin(*SENSORS))
    if seq is None:
        return known.dropDuplicates(["sensor_type", "timestamp_ns"])
    rest = [c for c in rows.columns if c not in ("sensor_type", "timestamp_ns")]
    found = known.groupBy("sensor_type", "timestamp_ns").agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return found.select("sensor_type", "timestamp_ns", *[F.col(f"_row.{c}").alias(c) for c in rest])


def distinct_frames(frames: DataFrame) -> DataFrame:
    """One row by frame sequence, time and physical camera, which make a frame's identity."""
    return frames.dropDuplicates(["frame_sequence", "timestamp_ns", "physical_camera_id"])
