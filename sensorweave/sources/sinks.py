"""Sinks: media bundles, verification bundles as JSON, key-value profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.operators.retention import latest

KEYS = ("profileVersion", "profileId", "manufacturer", "deviceModel", "socFamily", "totalRamBytes", "osVersionSdk", "cameraCount", "isProfileVerifiedAtRuntime")


def media_files(media: DataFrame, seq: str) -> DataFrame:
    """(name, content) of the three files of each media id; of equal ids the last one counts."""
    rows = latest(media, ["media_id"], seq)
    meta = F.concat(F.lit('{"media_id": '), F.to_json(F.array("media_id")).substr(F.lit(2), F.length(F.to_json(F.array("media_id"))) - 2), F.lit(', "capture": '), "capture_json", F.lit(', "processing": '), "processing_json", F.lit("}"))
    files = F.array(
        F.struct(F.concat("media_id", F.lit("_ORIGINAL."), "format").alias("name"), F.col("original").alias("content")),
        F.struct(F.concat("media_id", F.lit("_MASTER."), "format").alias("name"), F.col("master").alias("content")),
        F.struct(F.concat("media_id", F.lit("_META.json")).alias("name"), F.encode(meta, "utf-8").alias("content")),
    )
    return rows.select("media_id", F.col(seq).alias("seq"), F.inline(files))


def write_media(media: DataFrame, seq: str, path: str) -> None:
    """Adds the files to a Parquet table of names and contents; ``read_media`` shows an id's last write, others stay."""
    media_files(media, seq).write.mode("append").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, seq, name, content) of the files of each id as last written."""
    files = spark.read.parquet(path)
    last = files.groupBy("media_id").agg(F.max("seq").alias("seq"))
    return files.join(last, ["media_id", "seq"]).dropDuplicates(["media_id", "seq", "name"])


def json_lines(rows: DataFrame) -> DataFrame:
    """One escaped JSON object by row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_bundle(parts: dict[str, DataFrame], path: str) -> None:
    """Each part as JSON text in a folder of its name."""
    for name, rows in parts.items():
        json_lines(rows).write.mode("overwrite").text(f"{path}/{name}")


def _as_json(fields: dict[str, Column]) -> Column:
    """An object of the fields in their order, nulls written out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _in_order(rows: Column, field: str) -> Column:
    """An array of records by one of their fields; records with maps have no order of their own."""
    return F.array_sort(rows, lambda x, y: F.when(x[field] < y[field], -1).when(x[field] > y[field], 1).otherwise(0))


def _record(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def verification_bundle(devices: DataFrame, cameras: DataFrame, streams: DataFrame, by: str = "device_id") -> DataFrame:
    """(device, name, content) of the six JSON documents of each device.

    ``devices`` has one row by device (timestamp, device_model, manufacturer, brand, product, android_release, sdk_int,
    zero_copy_design, zero_copy_state, buffer_copies, notes), ``cameras`` those of ``camera_records`` with black_level
    and constraints (a map of dynamic ranges to lists), ``streams`` combination, streams, state and latency_ms.
    Cameras stand by id and combinations by name; a device without any has empty lists.  Rows without a device go.
    """
    pair = lambda c, a, b: F.array(F.col(f"{c}.{a}"), F.col(f"{c}.{b}"))
    # The names of the documents and of their fields.
    camera = _record(
        cameraId="camera_id", hardwareLevel="hardware_level", lensFacing="lens_facing", sensorOrientation="sensor_orientation", isLogical="is_logical", physicalCameraIds="physical_ids",
        sensor=_record(
            activeArrayWidth="active.w", activeArrayHeight="active.h", pixelArrayWidth="pixels.w", pixelArrayHeight="pixels.h", physicalWidthMm="size_mm.w", physicalHeightMm="size_mm.h",
            isoRange=pair("iso_range", "lo", "hi"), exposureTimeRangeNs=pair("exposure_range_ns", "lo", "hi"), colorFilterArrangement="color_filter",
        ),
        lens=_record(focalLengthsMm="focal_lengths", apertures="apertures", minimumFocusDistanceMeters="focus_distance", oisModes="ois_modes"),
        threeA=_record(aeModes="ae_modes", afModes="af_modes", awbModes="awb_modes"),
    )
    ranges = _record(key="camera_id", value=_record(supportedProfiles="dynamic_ranges", constraints="constraints"))
    sensor = _record(cameraId="camera_id", activeArray=pair("active", "w", "h"), pixelArray=pair("pixels", "w", "h"), physicalSizeMm=pair("size_mm", "w", "h"), blackLevelPattern="black_level", whiteLevel=F.coalesce("white_level", F.lit(1023)))
    tested = _record(combination="combination", streams="streams", state="state", latencyMs="latency_ms")
    of_cameras = cameras.groupBy(by).agg(F.collect_list(F.struct(camera.alias("camera"), ranges.alias("ranges"), sensor.alias("sensor"), F.col("camera_id"))).alias("_cameras"))
    of_streams = streams.groupBy(by).agg(F.collect_list(tested).alias("_streams"))
    rows = devices.where(F.col(by).isNotNull()).join(of_cameras, by, "left").join(of_streams, by, "left")
    empty = lambda name, frame: F.coalesce(F.col(name), F.array().cast(frame.schema[name].dataType))
    rows = rows.withColumn("_cameras", _in_order(empty("_cameras", of_cameras), "camera_id")).withColumn("_streams", _in_order(empty("_streams", of_streams), "combination"))
    documents = {
        "device_profile.json": {
            "timestamp": F.col("timestamp"), "deviceModel": F.col("device_model"), "manufacturer": F.col("manufacturer"), "brand": F.col("brand"), "product": F.col("product"), "androidRelease": F.col("android_release"), "sdkInt": F.col("sdk_int"),
            "cameraCount": F.size("_cameras"), "zeroCopyDesign": F.col("zero_copy_design"), "zeroCopyHardwareState": F.col("zero_copy_state"),
        },
        "camera_profile.json": {"cameras": F.col("_cameras.camera")},
        "stream_profile.json": {"streamMatrix": F.col("_streams")},
        "dynamic_range_profile.json": {"cameraDynamicRange": F.map_from_entries("_cameras.ranges")},
        "sensor_profile.json": {"sensors": F.col("_cameras.sensor")},
        "verification.json": {
            "phase": F.lit(1), "timestamp": F.col("timestamp"), "status": F.lit("VERIFIED"), "device": F.col("device_model"), "zeroCopyDesign": F.lit("PASS"), "zeroCopyHardware": F.col("zero_copy_state"),
            "actualBufferCopies": F.col("buffer_copies"), "notes": F.col("notes"),
        },
    }
    return rows.select(by, F.inline(F.array(*[F.struct(F.lit(name).alias("name"), _as_json(fields).alias("content")) for name, fields in documents.items()])))


def write_verification(bundle: DataFrame, path: str) -> None:
    """Each document as text in a folder of its device and name; other devices' documents stay."""
    bundle.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*bundle.columns[:2]).text(path)


def to_key_values(profiles: DataFrame, cameras: DataFrame) -> DataFrame:
    """(profile_id, data): nine scalars as text; cameras and backends are left out."""
    counts = cameras.groupBy("profile_id").agg(F.count("*").alias("_n"))
    values = [F.lit("1"), F.col("profile_id"), F.col("manufacturer"), F.col("device_model"), F.col("soc_family"), F.col("total_ram_bytes").cast("string"), F.col("os_version_sdk").cast("string"), F.coalesce("_n", F.lit(0)).cast("string"), F.col("verified").cast("string")]
    pairs = [x for k, v in zip(KEYS, values, strict=True) for x in (F.lit(k), v)]
    return profiles.join(counts, "profile_id", "left").select("profile_id", F.create_map(*pairs).alias("data"))


def from_key_values(data: Column) -> list[Column]:
    """Profile columns from such a map; missing or unreadable values get their defaults."""

    def number(key: str, kind: str, usual: int) -> Column:
        return F.coalesce(F.try_element_at(data, F.lit(key)).try_cast(kind), F.lit(usual).cast(kind))

    def text(key: str, usual: str) -> Column:
        return F.coalesce(F.try_element_at(data, F.lit(key)), F.lit(usual))

    flag = F.try_element_at(data, F.lit("isProfileVerifiedAtRuntime"))
    return [
        text("profileId", "custom-profile").alias("profile_id"), text("manufacturer", "Generic").alias("manufacturer"), text("deviceModel", "Android Device").alias("device_model"), text("socFamily", "Generic SoC").alias("soc_family"),
        number("totalRamBytes", "bigint", 8 << 30).alias("total_ram_bytes"), number("osVersionSdk", "int", 34).alias("os_version_sdk"), number("profileVersion", "int", 1).alias("profile_version"), F.coalesce(flag == "true", F.lit(False)).alias("verified"),
    ]
