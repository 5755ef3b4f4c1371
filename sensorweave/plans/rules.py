"""Decision tables: exposure, capture plans, thermal limits, scheduling, validation, size selection, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorweave.sources.catalogs import CLASSICAL, CPU, GPU, NPU, THERMAL


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def with_scene_flags(df: DataFrame, lux: str = "lux", turn: str = "angular_velocity", delta: str = "delta_x") -> DataFrame:
    return df.withColumn("is_low_light", F.col(lux) < _f(30)).withColumn("is_high_motion", (F.col(turn) > _f(0.4)) | (F.col(delta) > _f(5)))


def with_exposure(df: DataFrame, lux: str = "lux", manual_iso: str = "manual_iso", manual_exposure: str = "manual_exposure_ns") -> DataFrame:
    """ISO and exposure time by light and motion; manual values count only if both are given."""
    manual = F.col(manual_iso).isNotNull() & F.col(manual_exposure).isNotNull()
    iso = F.when(F.col(lux) > _f(1000), 50).when(F.col(lux) > _f(200), 100).when(F.col(lux) > _f(30), 400).when(F.col("is_high_motion"), 1600).otherwise(800)
    time = F.when(F.col(lux) > _f(1000), 1_000_000).when(F.col(lux) > _f(200), 4_000_000).when((F.col(lux) > _f(30)) | F.col("is_high_motion"), 16_000_000).otherwise(40_000_000)
    return df.withColumn("iso", F.when(manual, F.col(manual_iso)).otherwise(iso)).withColumn("exposure_ns", F.when(manual, F.col(manual_exposure)).otherwise(time).cast("bigint"))


def capture_plans(requests: DataFrame, cameras: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests (mode, lux, delta_x, angular_velocity, profile_id, manual_iso, manual_exposure_ns) with their plan."""
    main = cameras.where("camera_id = '0'").select("profile_id", "camera_id", "has_raw")
    df = requests.join(F.broadcast(profiles.select("profile_id", "burst_normal")), "profile_id").join(F.broadcast(main), "profile_id", "left")
    df = with_exposure(with_scene_flags(df)).withColumn("_raw", F.coalesce("has_raw", F.lit(False)))
    mode, fast, low = F.col("mode"), F.col("is_high_motion"), F.col("is_low_light")
    count = (
        F.when(mode == "AUTO", F.when(fast, 3).when(low, F.least(F.lit(8), "burst_normal")).otherwise(4))
        .when(mode == "PRO", F.when(fast, 1).otherwise(3))
        .when(mode == "MASTER", F.when(fast, F.least(F.lit(5), "burst_normal")).otherwise(F.least(F.lit(12), "burst_normal")))
        .when(mode == "AUTHENTIC", F.when(low, 4).otherwise(2))
    )
    df = df.withColumn("frame_count", count)
    steps = F.when((mode == "MASTER") & (low | (F.col("lux") > _f(1000))), F.expr("array(cast(-1.5 as float), cast(0 as float), cast(1.5 as float))")).otherwise(F.expr("cast(array() as array<float>)"))
    return df.withColumn("bracket_steps", steps).withColumn("use_raw", F.when(mode == "AUTO", F.col("_raw") & low).otherwise(F.col("_raw"))).withColumn("enable_fusion", (mode == "MASTER") | (F.col("frame_count") > 1)).withColumn("target_camera", F.coalesce("camera_id", F.lit("0"))).drop("_raw", "camera_id", "has_raw")


def burst_limit(level: Column, normal: Column, throttled: Column) -> Column:
    return F.when(level <= 1, normal).when(level == 2, F.greatest(F.floor(normal / 2).cast("int"), F.lit(3))).otherwise(throttled)


def throttles(level: Column) -> Column:
    return level >= THERMAL.index("MODERATE")


def latency_budget_ms(fps: Column) -> Column:
    """Milliseconds of a frame; 33 without a rate."""
    return F.when(fps <= 0, 33).otherwise(F.floor(F.lit(1000) / F.when(fps > 0, fps))).cast("bigint")


def model_fallbacks(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``fallback``: classical for unknown ids and dangling or missing fallbacks; none for classical itself."""
    known = models.select("model_id", "fallback_model_id", "is_classical_fallback")
    there = models.select(F.col("model_id").alias("fallback_model_id"), F.lit(True).alias("_there"))
    df = requests.join(F.broadcast(known), "model_id", "left").join(F.broadcast(there), "fallback_model_id", "left")
    fallback = F.when(F.col("is_classical_fallback").isNull(), CLASSICAL).when(F.col("fallback_model_id").isNull(), F.when(~F.col("is_classical_fallback"), CLASSICAL)).when(F.col("_there"), F.col("fallback_model_id")).otherwise(CLASSICAL)
    return df.withColumn("fallback", fallback).drop("fallback_model_id", "is_classical_fallback", "_there")


def with_backend(requests: DataFrame, models: DataFrame, backends: DataFrame) -> DataFrame:
    """Adds ``backend`` for rows of (profile_id, model_id): NPU, then GPU where usable and supported, else the CPU, which is not checked."""
    usable = backends.where("is_usable").groupBy("profile_id").agg(F.collect_set("backend").alias("_usable"))
    df = requests.join(F.broadcast(usable), "profile_id", "left").join(F.broadcast(models.select("model_id", F.col("supported_backends").alias("_supported"))), "model_id", "left")

    def has(name: str) -> Column:
        return F.array_contains("_usable", name) & F.array_contains("_supported", name)

    return df.withColumn("backend", F.when(has(NPU), NPU).when(has(GPU), GPU).otherwise(CPU)).drop("_usable", "_supported")


def schedules(requests: DataFrame, models: DataFrame, profiles: DataFrame, backends: DataFrame) -> DataFrame:
    """requests (request_id, model_id, thermal_level, allocated_bytes, budget_bytes, profile_id) with what runs where."""
    df = model_fallbacks(requests, models).join(F.broadcast(models.select("model_id", "memory_requirement_bytes", "is_classical_fallback", F.lit(True).alias("_known"))), "model_id", "left")
    df = with_backend(df.join(F.broadcast(profiles.select("profile_id", "burst_normal", "burst_throttled")), "profile_id"), models, backends)
    frames = burst_limit(F.col("thermal_level"), F.col("burst_normal"), F.col("burst_throttled"))
    unknown, hot = F.col("_known").isNull(), F.col("thermal_level") >= THERMAL.index("SEVERE")
    tight = F.col("allocated_bytes") + F.col("memory_requirement_bytes") > F.col("budget_bytes")
    fallback = F.coalesce("fallback", F.lit(CLASSICAL))
    return df.select(
        *requests.columns,
        F.when(unknown, CLASSICAL).when(hot | tight, fallback).otherwise(F.col("model_id")).alias("selected_model"),
        F.when(unknown | hot | tight, CPU).otherwise(F.col("backend")).alias("selected_backend"),
        F.when(unknown, 1).when(hot, frames).when(tight, 2).otherwise(frames).alias("max_frames"),
        F.when(unknown | hot | tight, True).otherwise(F.col("is_classical_fallback")).alias("use_fallback"),
        F.when(unknown, "unknown model").when(hot, "thermal").when(tight, "memory pressure").otherwise("scheduled").alias("reason"),
    )


def manifest_issues(models: DataFrame) -> DataFrame:
    """Models with their issues in rule order; valid without any."""
    neural = ~F.col("is_classical_fallback")
    # The texts of the issues.
    rules = [
        (F.trim("model_id") == "", "modelId cannot be blank"),
        (F.trim("license") == "", "license cannot be blank"),
        (neural & (F.col("file_size_bytes") <= 0), "Neural model size must be greater than 0 bytes"),
        (F.size("supported_backends") == 0, "supportedBackends cannot be empty"),
        (F.col("memory_requirement_bytes") <= 0, "memoryRequirement must be positive"),
        (F.col("expected_latency_ms") <= 0, "latencyExpectation must be positive"),
        (F.trim("input_format") == "", "inputDescription cannot be blank"),
        (F.trim("output_format") == "", "outputDescription cannot be blank"),
        (neural & F.col("fallback_model_id").isNull(), "Neural models should specify a fallbackModelId for reliability"),
    ]
    issues = F.filter(F.array(*[F.when(when, F.lit(what)) for when, what in rules]), lambda x: x.isNotNull())
    return models.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def lens_map(cameras: DataFrame, by: list[str]) -> DataFrame:
    """(by, logical_id, physical_id, facing): each camera's physical ones, itself if none; unknown ids fall away."""
    links = cameras.select(*by, F.col("camera_id").alias("logical_id"), F.explode(F.when(F.size("physical_ids") == 0, F.array("camera_id")).otherwise(F.col("physical_ids"))).alias("physical_id"))
    return links.join(cameras.select(*by, F.col("camera_id").alias("physical_id"), "facing"), [*by, "physical_id"])


def best_sizes(sizes: DataFrame, by: list[str], target: float = 16 / 9) -> DataFrame:
    """Per key the preview, analysis and largest size of rows (input_pos, width, height); first ones win ties."""
    df = sizes.withColumn("_off", F.abs((F.col("width").cast("float") / F.col("height").cast("float")).cast("float") - _f(target))).withColumn("_area", F.col("width").cast("bigint") * F.col("height"))
    size = F.struct("width", "height")
    fits, small = (F.col("width") <= 1920) & (F.col("height") <= 1080), F.col("width") <= 1280
    return df.groupBy(*by).agg(
        F.coalesce(F.min_by(F.when(fits, size), F.when(fits, F.struct("_off", "input_pos"))), F.min_by(size, "input_pos")).alias("preview"),
        F.coalesce(F.max_by(F.when(small, size), F.when(small, F.struct(F.col("_area"), -F.col("input_pos")))), F.min_by(size, F.struct("_area", "input_pos"))).alias("analysis"),
        F.max_by(size, F.struct(F.col("_area"), -F.col("input_pos"))).alias("largest"),
    )


#: Sizes where a list is empty.
NO_SIZES = {"preview": (1920, 1080), "analysis": (640, 480), "largest": (4000, 3000)}

# Streams of each use case (role, format, how its size is chosen, use).
SESSION_STREAMS = {
    "PREVIEW_ONLY": [("PREVIEW", "PRIVATE", "preview", 1)],
    "PREVIEW_WITH_ANALYSIS": [("PREVIEW", "PRIVATE", "preview", 1), ("ANALYSIS", "YUV_420_888", "analysis", 4)],
    "PREVIEW_WITH_STILL_JPEG": [("PREVIEW", "PRIVATE", "preview", 1), ("STILL_JPEG", "JPEG", "largest", 2)],
    "PREVIEW_WITH_STILL_RAW": [("PREVIEW", "PRIVATE", "preview", 1), ("STILL_RAW", "RAW_SENSOR", "largest", 2)],
    "PREVIEW_WITH_ANALYSIS_AND_STILL": [("PREVIEW", "PRIVATE", "preview", 1), ("ANALYSIS", "YUV_420_888", "analysis", 4), ("STILL_JPEG", "JPEG", "largest", 2)],
    "HIGH_SPEED_BURST": [("PREVIEW", "PRIVATE", "preview", 1), ("ANALYSIS", "YUV_420_888", "preview", 4)],
    "VIDEO_RECORDING": [("PREVIEW", "PRIVATE", "preview", 1), ("VIDEO", "PRIVATE", "preview", 3)],
}
STREAM_LIMIT = 3


def session_streams() -> Column:
    """All streams of all use cases as one constant array."""
    rows = [(u, i, *s) for u, streams in SESSION_STREAMS.items() for i, s in enumerate(streams)]
    names = ("use_case", "pos", "role", "format", "sized_by", "stream_use")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])


def session_plans(cameras: DataFrame, by: list[str], sizes: DataFrame) -> DataFrame:
    """(by, use_case, pos, role, format, width, height, is_supported) from sizes (by, format, input_pos, width, height).

    RAW falls back to RAW10 where a camera lists no RAW_SENSOR sizes; empty lists give the usual sizes.
    """
    best = best_sizes(sizes, [*by, "format"])
    raw = sizes.where("format = 'RAW_SENSOR'").select(*by).distinct().withColumn("_raw", F.lit(True))
    plan = cameras.select(*by).distinct().select(*by, F.inline(session_streams())).join(raw, by, "left")
    plan = plan.withColumn("format", F.when((F.col("format") == "RAW_SENSOR") & F.col("_raw").isNull(), "RAW10").otherwise(F.col("format")))
    plan = plan.join(best, [*by, "format"], "left")

    def side(name: str) -> Column:
        out = F.lit(None).cast("int")
        for how, usual in NO_SIZES.items():
            out = F.when(F.col("sized_by") == how, F.coalesce(F.col(f"{how}.{name}"), F.lit(usual[0 if name == "width" else 1]))).otherwise(out)
        return out

    count = F.count("*").over(Window.partitionBy(*by, "use_case"))
    return plan.withColumn("is_supported", count <= STREAM_LIMIT).select(*by, "use_case", "pos", "role", "format", side("width").alias("width"), side("height").alias("height"), "stream_use", "is_supported")


def stream_matrix(plans: DataFrame, formats: DataFrame, by: list[str]) -> DataFrame:
    """Use cases as SUPPORTED if the plan stands and every stream's format is listed, else FAILED."""
    listed = formats.select(*by, "format").distinct().withColumn("_there", F.lit(True))
    joined = plans.join(listed, [*by, "format"], "left")
    return joined.groupBy(*by, "use_case").agg(F.when(F.bool_and("is_supported") & F.bool_and(F.coalesce("_there", F.lit(False))), "SUPPORTED").otherwise("FAILED").alias("state"))


def buffer_copies(spark, width: int = 1920, height: int = 1080, hardware_buffer: bool = True) -> DataFrame:
    """The copies of the pipeline: four stages with their bytes."""
    # The stages and how often they copy.
    second = ("Camera HAL -> HardwareBuffer", 0, "Per Frame (30 FPS)", False, 0.0) if hardware_buffer else ("Camera HAL -> JVM Heap Planes", int(width * height * 1.5), "Per Frame (30 FPS)", True, 2.1)
    rows = [("Camera HAL -> SurfaceView Preview", 0, "Per Frame (60 FPS)", False, 0.0), second, ("Camera ISP -> JPEG ImageReader", 0, "Per Still Capture", False, 0.0), ("Memory -> Disk Storage (MediaStore)", 3_500_000, "Per Saved Photo", False, 4.5)]
    return spark.createDataFrame(rows, "stage string, bytes_moved bigint, frequency string, is_avoidable boolean, latency_impact_ms float")


def copy_audit(copies: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bytes copied for each frame and PASS if none, else PARTIAL."""
    total = F.coalesce(F.sum(F.when(F.col("frequency").contains("Per Frame"), F.col("bytes_moved"))), F.lit(0))
    return copies.groupBy(*(by or [])).agg(total.alias("per_frame_bytes"), F.when(total == 0, "PASS").otherwise("PARTIAL").alias("status"))


def memory_ledger(operations: DataFrame, by: list[str], seq: str, budget: int) -> DataFrame:
    """Replays operations (seq, amount: positive to take, negative to give back) of each ledger: (by, granted, allocated).

    Grants that would pass the budget are refused; the ledger never falls below zero.  Order matters, so
    a ledger's operations are folded in one array.
    """
    rows = operations.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("amount").alias("x")))).alias("ops"))
    start = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("granted"))

    def step(acc: Column, op: Column) -> Column:
        fits = acc["held"] + op["x"] <= budget
        held = F.when(op["x"] < 0, F.greatest(acc["held"] + op["x"], F.lit(0))).when(fits, acc["held"] + op["x"]).otherwise(acc["held"])
        return F.struct(held.cast("bigint").alias("held"), (acc["granted"] + F.when((op["x"] >= 0) & fits, 1).otherwise(0)).cast("bigint").alias("granted"))

    found = F.aggregate("ops", start, step)
    return rows.select(*by, found["granted"].alias("granted"), found["held"].alias("allocated"))


def dispatch(schedule: DataFrame, available: list[str]) -> DataFrame:
    """Adds ``ran_on``: the backend chosen where it is available, else the input passes through."""
    return schedule.withColumn("ran_on", F.when(F.col("selected_backend").isin(available), F.col("selected_backend")).otherwise("PASSTHROUGH"))
