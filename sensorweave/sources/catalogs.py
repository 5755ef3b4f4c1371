"""Fixed dimension tables: models, device profiles, scenes, errors, states.  A handful of rows each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024

# Model catalog.
MODEL_SCHEMA = (
    "model_id string, name string, purpose string, version struct<major:int,minor:int,patch:int>, license string, file_size_bytes bigint, input_format string, output_format string, "
    "input_resolution struct<w:int,h:int>, output_resolution struct<w:int,h:int>, tensor_precision string, supported_backends array<string>, memory_requirement_bytes bigint, "
    "expected_latency_ms bigint, thermal_cost_score float, compatibility_requirements array<string>, fallback_model_id string, is_classical_fallback boolean, compatibility_state string"
)
CLASSICAL = "classical-baseline-isp-v1"
NPU, GPU, CPU = "QUALCOMM_QNN_NPU", "VULKAN_GPU", "XNNPACK_CPU"
MODELS = [
    (CLASSICAL, "Classical Production ISP Baseline", "NEURAL_ISP", (1, 0, 0), "Apache-2.0", 0, "RAW_SENSOR/YUV_420_888", "RGBA_8888/JPEG", (4096, 3072), (4096, 3072), "FP32", [CPU], 32 * MIB, 28, 0.1, ["Android 11+"], None, True, "VERIFIED"),
    ("neural-isp-lite-v1", "Neural ISP Lite (HDR & Temporal Denoise)", "NEURAL_ISP", (1, 1, 0), "Apache-2.0", 14 * MIB, "RAW10/RAW12/YUV_420_888", "RGBA_8888", (1920, 1440), (1920, 1440), "INT8", [NPU, GPU, CPU], 96 * MIB, 42, 0.35, ["Qualcomm HTP or Vulkan 1.3"], CLASSICAL, False, "AVAILABLE"),
    ("perception-motion-alignment-v1", "Perception Fast Optical Alignment", "TEMPORAL_RECONSTRUCTION", (1, 0, 2), "Apache-2.0", 6 * MIB, "YUV_420_888_LUMA", "FLOW_VECTORS_FLOAT", (512, 384), (512, 384), "INT8", [NPU, GPU, CPU], 32 * MIB, 12, 0.15, ["All modern Android devices"], None, False, "AVAILABLE"),
    ("omnineural-4b-mobile-v1", "OmniNeural 4B Mobile Semantic Director", "SEMANTIC_DIRECTOR", (1, 0, 0), "Open RAIL-M", 2_200_000_000, "TOKEN_STREAM/IMAGE_EMBEDDING", "STRUCTURED_INTENT_JSON", (384, 384), (0, 0), "INT4", [NPU, GPU], 2_600_000_000, 350, 0.85, ["Minimum 12GB device RAM", "Qualcomm Snapdragon 8 Gen 3/Elite"], None, False, "AVAILABLE"),
    ("flux-klein-4b-studio-v1", "FLUX.2 Klein 4B Generative Studio", "GENERATIVE", (1, 0, 0), "Custom Research / Studio", 2_400_000_000, "LATENT_TENSOR_RGB", "RGB_IMAGE_1024", (512, 512), (1024, 1024), "INT4", [NPU, GPU], 3_200_000_000, 2800, 0.95, ["AI Studio mode only", "Not in camera hot path"], None, False, "AVAILABLE"),
]

# Device profiles; their cameras and backends are child tables.
PROFILE_SCHEMA = "profile_id string, manufacturer string, device_model string, soc_family string, total_ram_bytes bigint, os_version_sdk int, burst_normal int, burst_throttled int, ring_bytes bigint, residency_bytes bigint, tensor_bytes bigint, verified boolean"
PROFILES = [
    ("oneplus-15-12gb-android16", "OnePlus", "OnePlus 15", "SM8850 (Snapdragon 8 Elite Gen 5)", 12 << 30, 36, 16, 6, 512 * MIB, 2500 * MIB, 256 * MIB, True),
    ("generic-flagship", "Android Flagship", "Generic Flagship", "Modern Flagship SoC", 8 << 30, 35, None, None, 256 * MIB, 1024 * MIB, 128 * MIB, False),
    ("generic-fallback", "Universal Android", "Fallback Device", "Standard ARM64", 4 << 30, 30, 6, 2, 96 * MIB, 256 * MIB, 32 * MIB, False),
]
CAMERA_SCHEMA = "profile_id string, camera_id string, facing string, formats array<string>, has_raw boolean, physical_ids array<string>, max_zsl int, active struct<w:int,h:int>"
CAMERAS = [
    ("oneplus-15-12gb-android16", "0", "BACK_WIDE", ["RAW_SENSOR", "YUV_420_888", "JPEG", "HEIC"], True, ["3", "2", "4"], 15, (8192, 6144)),
    ("oneplus-15-12gb-android16", "1", "FRONT", ["YUV_420_888", "JPEG"], False, [], 8, (3280, 2464)),
    ("oneplus-15-12gb-android16", "2", "BACK_WIDE", ["RAW_SENSOR", "YUV_420_888", "JPEG"], True, [], 15, (8192, 6144)),
    ("oneplus-15-12gb-android16", "3", "BACK_ULTRAWIDE", ["RAW_SENSOR", "YUV_420_888", "JPEG"], True, [], 12, (4096, 3072)),
    ("oneplus-15-12gb-android16", "4", "BACK_TELEPHOTO", ["RAW_SENSOR", "YUV_420_888", "JPEG"], True, [], 12, (4096, 3072)),
    ("generic-flagship", "0", "BACK_WIDE", ["RAW_SENSOR", "YUV_420_888", "JPEG"], True, [], 10, (4096, 3072)),
    ("generic-fallback", "0", "BACK_WIDE", ["YUV_420_888", "JPEG"], False, [], 5, (1920, 1080)),
]
BACKEND_SCHEMA = "profile_id string, backend string, is_supported boolean, is_usable boolean, latency_multiplier float"
BACKENDS = [
    ("oneplus-15-12gb-android16", NPU, True, True, 0.6),
    ("oneplus-15-12gb-android16", GPU, True, True, 0.9),
    ("oneplus-15-12gb-android16", CPU, True, True, 2.5),
    ("generic-flagship", GPU, True, True, 1.0),
    ("generic-flagship", CPU, True, True, 3.0),
    ("generic-fallback", CPU, True, True, 4.0),
]

# Controlled scenes (id, category, lux, motion, lowest PSNR).
SCENE_SCHEMA = "scene_id string, category string, target_lux float, target_motion_rad_s float, baseline_psnr_min float"
SCENES = [
    ("SCENE_01_DAYLIGHT", "DAYLIGHT", 2500.0, 0.01, 38.0),
    ("SCENE_02_INDOOR", "INDOOR", 250.0, 0.02, 35.0),
    ("SCENE_03_LOW_LIGHT", "LOW_LIGHT", 15.0, 0.05, 30.0),
    ("SCENE_04_VERY_LOW_LIGHT", "VERY_LOW_LIGHT", 1.5, 0.08, 26.0),
    ("SCENE_05_BACKLIGHT", "BACKLIGHT", 1200.0, 0.02, 32.0),
    ("SCENE_06_HDR", "HIGH_DYNAMIC_RANGE", 1800.0, 0.01, 34.0),
    ("SCENE_07_FINE_TEXTURE", "FINE_TEXTURE", 800.0, 0.01, 36.0),
    ("SCENE_08_TEXT", "TEXT", 600.0, 0.01, 38.0),
    ("SCENE_09_FOLIAGE", "FOLIAGE", 1100.0, 0.03, 33.0),
    ("SCENE_10_SKIN", "SKIN", 400.0, 0.02, 37.0),
    ("SCENE_11_MOVING_SUBJECTS", "MOVING_SUBJECTS", 500.0, 0.45, 29.0),
    ("SCENE_12_NIGHT_LIGHTS", "NIGHT_LIGHTS", 8.0, 0.04, 28.0),
    ("SCENE_13_REFLECTIVE", "REFLECTIVE_SURFACES", 750.0, 0.02, 34.0),
    ("SCENE_14_REPEATED_PATTERNS", "REPEATED_PATTERNS", 900.0, 0.01, 35.0),
]

# Legal camera state transitions.
TRANSITIONS = {
    "UNINITIALIZED": ["INITIALIZING", "ERROR", "CLOSED"],
    "INITIALIZING": ["READY", "ERROR", "CLOSED"],
    "READY": ["FOCUSING", "CAPTURING", "PROCESSING", "ERROR", "CLOSED"],
    "FOCUSING": ["READY", "CAPTURING", "ERROR", "CLOSED"],
    "CAPTURING": ["PROCESSING", "READY", "ERROR", "CLOSED"],
    "PROCESSING": ["SAVING", "READY", "ERROR", "CLOSED"],
    "SAVING": ["READY", "ERROR", "CLOSED"],
    "ERROR": ["RECOVERING", "CLOSED"],
    "RECOVERING": ["INITIALIZING", "READY", "ERROR", "CLOSED"],
    "CLOSED": ["INITIALIZING", "UNINITIALIZED"],
}

# Errors (family, code, recoverable).
ERRORS = [
    ("ExpectedUnsupportedCapability", "ERR_CAP_RAW_UNSUPPORTED", True),
    ("ExpectedUnsupportedCapability", "ERR_CAP_STREAM_COMBO", True),
    ("ExpectedUnsupportedCapability", "ERR_CAP_HDR_UNSUPPORTED", True),
    ("RecoverableRuntimeFailure", "ERR_RUN_BACKEND_INIT", True),
    ("RecoverableRuntimeFailure", "ERR_RUN_INFERENCE_TIMEOUT", True),
    ("RecoverableRuntimeFailure", "ERR_RUN_THERMAL_THROTTLED", True),
    ("CameraHardwareFailure", "ERR_CAM_DISCONNECTED", True),
    ("CameraHardwareFailure", "ERR_CAM_IN_USE", True),
    ("CameraHardwareFailure", "ERR_CAM_DEVICE_ERROR", True),
    ("ResourceFailure", "ERR_RES_MEMORY", False),
    ("ResourceFailure", "ERR_RES_STORAGE", True),
    ("ResourceFailure", "ERR_RES_BUFFER_OVERFLOW", True),
    ("FatalApplicationFailure", "ERR_FATAL_INIT", False),
    ("FatalApplicationFailure", "ERR_FATAL_CRASH", False),
]

# Thermal states by level, log levels by order.
THERMAL = ["NONE", "LIGHT", "MODERATE", "SEVERE", "CRITICAL", "EMERGENCY", "SHUTDOWN"]
LOG_LEVELS = ["VERBOSE", "DEBUG", "INFO", "WARN", "ERROR"]


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, MODEL_SCHEMA)


def device_profiles(spark: SparkSession, burst_normal: int = 12, burst_throttled: int = 4) -> DataFrame:
    """Profiles; those that state no burst limits get the defaults given."""
    return spark.createDataFrame([(*p[:6], burst_normal if p[6] is None else p[6], burst_throttled if p[7] is None else p[7], *p[8:]) for p in PROFILES], PROFILE_SCHEMA)


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, CAMERA_SCHEMA)


def backends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BACKENDS, BACKEND_SCHEMA)


def scenes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENES, SCENE_SCHEMA)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "source string, target string")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "family string, code string, is_recoverable boolean")
