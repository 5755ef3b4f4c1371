"""Planes, metrics, rules, sources and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sensorweave.functions import bursts
from sensorweave.functions import planes as P
from sensorweave.operators import metrics as M
from sensorweave.plans import rules as R
from sensorweave.sources import catalogs as C
from sensorweave.sources import readers, sinks


@pytest.mark.parametrize(("n", "median", "p95"), [(1, 0, 0), (2, 1, 1), (4, 2, 3), (5, 2, 4), (20, 10, 19), (100, 50, 95)])
def test_index_percentiles(spark, n, median, p95):
    df = spark.range(n).selectExpr("'s' as stage", "cast(id as double) as v")
    row = M.index_percentiles(df, ["stage"], "v", {"median": 0.5, "p95": 0.95}).first()
    assert (row["n"], row["median"], row["p95"]) == (n, median, p95)


def test_percentiles_with_ties_and_outliers(spark):
    values = [5.0] * 40 + [1e9, -3.0, 7.5, 7.5]
    df = spark.createDataFrame([("s", v) for v in values], "stage string, v double")
    row = M.index_percentiles(df, ["stage"], "v", {"median": 0.5, "p99": 0.99}).first()
    assert (row["median"], row["p99"]) == (5.0, sorted(values)[min(int(len(values) * 0.99), len(values) - 1)])


def test_logs(spark):
    rows = [(1, "CAMERA", "INFO", "a"), (2, "RUNTIME", "DEBUG", "b"), (3, "FRAME", "VERBOSE", "Raw FramePlane buffer received")]
    df = spark.createDataFrame(rows, "timestamp_ns bigint, category string, level string, message string")
    assert M.filter_logs(df, "CAMERA").count() == 1
    assert M.filter_logs(df, "FRAME").count() == 0
    assert M.filter_logs(df, "FRAME", "VERBOSE").first()["message"] == M.REDACTED


@pytest.mark.parametrize(("measured", "regressed"), [({"SCENE_01_DAYLIGHT": 40.0, "SCENE_02_INDOOR": 36.0}, 0), ({"SCENE_01_DAYLIGHT": 32.0}, 1), ({"SCENE_01_DAYLIGHT": 37.5}, 0)])
def test_regressions(spark, measured, regressed):
    df = spark.createDataFrame(list(measured.items()), "scene_id string, psnr double")
    row = M.regression_verdict(C.scenes(spark), df).first()
    assert (row["total_scenes"], len(row["regressions"]), row["is_regression_free"]) == (14, regressed, not regressed)


def test_decode(spark):
    row = spark.createDataFrame([(bytearray([0, 127, 128, 255]), bytearray())], "b binary, e binary").select(P.decode(F.col("b")).alias("b"), P.decode(F.col("e")).alias("e")).first()
    assert row["b"] == [0, 127, 128, 255] and row["e"] == []


def test_fusion_with_a_short_plane(spark):
    df = spark.createDataFrame([("b", 1, [90, 90, 90]), ("b", 2, [100]), ("b", 3, [110, 111, 112])], "k string, seq int, plane array<int>")
    found = {r["idx"]: r["fused"] for r in P.temporal_fusion(df, ["k"], "plane", "seq").collect()}
    assert found == {0: 100, 1: 67, 2: 67}


@pytest.mark.parametrize(("value", "base"), [(11, 0.3), (12, 0.7), (39, 0.7), (40, 0.95), (215, 0.95), (216, 0.7), (245, 0.7), (246, 0.2)])
def test_tile_bounds(spark, value, base):
    row = spark.range(1).select(P.tile_confidence(F.lit(value), F.lit(100)).alias("c")).first()
    assert row["c"] == pytest.approx(base - 1 / 64, abs=1e-6)


def guard(spark, orig, recon, width, iso=100):
    df = spark.createDataFrame([(1, orig, recon)], "k int, o array<int>, r array<int>")
    return P.guard_decisions(df, ["k"], "o", "r", F.lit(width), F.lit(iso)).first()


def test_guard(spark):
    n = 64 * 64
    far = guard(spark, [100] * n, [220] * n, 64)
    assert (far["action"], far["hallucination"], far["blend_ratio"]) == ("REVERT_TO_ORIGINAL", True, 0.0)
    assert guard(spark, [100] * n, [102] * n, 64)["action"] == "KEEP_RECONSTRUCTED"
    some = [220 if (i % 64) % 8 == 0 and (i // 64) % 8 == 0 and (i // 64) < 8 and (i % 64) < 48 else 100 for i in range(n)]
    mid = guard(spark, [100] * n, some, 64)
    assert (mid["action"], mid["hallucination"]) == ("BLEND_WITH_ORIGINAL", False) and mid["blend_ratio"] == pytest.approx(0.65)
    unlike = guard(spark, [100] * n, [100] * 10, 64)
    assert (unlike["action"], unlike["hallucination"], unlike["confidence_mean"]) == ("REVERT_TO_ORIGINAL", False, 0.0)
    assert guard(spark, [100] * n, [250] * n, 64, iso=1600)["action"] == "KEEP_RECONSTRUCTED"


def test_quality(spark):
    df = spark.createDataFrame([(1, [i % 256 for i in range(10_000)]), (2, [])], "k int, plane array<int>")
    full, empty = P.with_quality(df, "plane").orderBy("k").collect()
    assert 0 <= full["overall"] <= 1 and full["is_acceptable"]
    assert empty["overall"] == 0 and empty["artifact_risk"] == 1 and not empty["is_acceptable"]


def test_burst_path_agrees_with_the_dataframe_path(spark):
    planes = [bytes((i * 7 + d) % 256 for i in range(64 * 64)) for d in (0, 3, 9)]
    df = spark.createDataFrame([("b", i, bytearray(p), 64, 64, 400) for i, p in enumerate(planes)], "burst string, seq int, plane binary, width int, height int, iso int")
    row = bursts.process_bursts(df).first()
    arrays = df.select("burst", "seq", P.decode(F.col("plane")).alias("plane"))
    fused = [r["fused"] for r in P.temporal_fusion(arrays, ["burst"], "plane", "seq").orderBy("idx").collect()]
    decision = guard(spark, list(planes[-1]), fused, 64, 400)
    assert row["action"] == decision["action"] and row["ratio"] == pytest.approx(decision["ratio"])
    final = {"REVERT_TO_ORIGINAL": list(planes[-1]), "KEEP_RECONSTRUCTED": fused}.get(row["action"])
    if final is not None:
        rgb = spark.createDataFrame([(final,)], "p array<int>").select(P.tone_rgb(F.col("p")).alias("x")).first()["x"]
        assert list(row["rgb"]) == rgb


def test_motion(spark):
    df = spark.createDataFrame([("c", 1, [10] * 32, [0.01, 0.01, 0.0]), ("c", 2, [30] * 32, [0.0, 0.0, 0.0]), ("c", 3, [30] * 16, None)], "k string, seq int, plane array<int>, gyro array<float>")
    a, b, c = P.motion_vectors(df, ["k"], "seq", "plane", F.col("gyro")).orderBy("seq").collect()
    assert (a["delta"], a["is_tripod"]) == (0.0, True) and b["delta"] == pytest.approx(2.0) and not b["is_tripod"] and c["delta"] == 0.0


def plan(spark, mode, lux, turn=0.0, iso=None, time=None):
    df = spark.createDataFrame([(mode, float(lux), 0.0, turn, "oneplus-15-12gb-android16", iso, time)], "mode string, lux float, delta_x float, angular_velocity float, profile_id string, manual_iso int, manual_exposure_ns bigint")
    return R.capture_plans(df, C.cameras(spark), C.device_profiles(spark)).first()


def test_capture_plans(spark):
    auto = plan(spark, "AUTO", 10)
    assert (auto["frame_count"], auto["iso"], auto["exposure_ns"], auto["use_raw"], auto["enable_fusion"]) == (8, 800, 40_000_000, True, True)
    master = plan(spark, "MASTER", 5)
    assert master["frame_count"] == 12 and master["bracket_steps"] == [-1.5, 0.0, 1.5]
    assert (plan(spark, "AUTHENTIC", 150, 0.05)["frame_count"], plan(spark, "AUTO", 30)["frame_count"], plan(spark, "AUTO", 30)["iso"]) == (2, 4, 800)
    assert plan(spark, "PRO", 500, iso=77)["iso"] == 100 and plan(spark, "PRO", 500, iso=77, time=5)["iso"] == 77


@pytest.mark.parametrize(
    ("model", "thermal", "budget", "want"),
    [("neural-isp-lite-v1", 0, 2500, (C.NPU, 16, False)), ("neural-isp-lite-v1", 3, 2500, (C.CPU, 6, True)), ("neural-isp-lite-v1", 0, 50, (C.CPU, 2, True)), ("nothing", 0, 2500, (C.CPU, 1, True))],
)
def test_schedules(spark, model, thermal, budget, want):
    df = spark.createDataFrame([(model, thermal, 0, budget * C.MIB, "oneplus-15-12gb-android16")], "model_id string, thermal_level int, allocated_bytes bigint, budget_bytes bigint, profile_id string")
    row = R.schedules(df, C.models(spark), C.device_profiles(spark), C.backends(spark)).first()
    assert (row["selected_backend"], row["max_frames"], row["use_fallback"]) == want


def test_manifests_and_sizes(spark):
    rows = {r["model_id"]: r["is_valid"] for r in R.manifest_issues(C.models(spark)).collect()}
    assert sum(rows.values()) == 2 and rows[C.CLASSICAL]
    sizes = spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate([(4000, 3000), (1920, 1080), (1440, 1080), (1280, 720), (640, 480)])], "input_pos int, width int, height int")
    row = R.best_sizes(sizes.withColumn("k", F.lit(1)), ["k"]).first()
    assert (tuple(row["largest"]), tuple(row["preview"]), tuple(row["analysis"])) == ((4000, 3000), (1920, 1080), (1280, 720))


def test_copy_audit(spark):
    assert R.copy_audit(R.buffer_copies(spark)).first()["status"] == "PASS"
    row = R.copy_audit(R.buffer_copies(spark, hardware_buffer=False)).first()
    assert (row["status"], row["per_frame_bytes"]) == ("PARTIAL", 3_110_400)


def test_memory_ledger(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, -100), ("a", 4, 100)], "k string, seq int, amount bigint")
    row = R.memory_ledger(df, ["k"], "seq", 100).first()
    assert (row["granted"], row["allocated"]) == (2, 100)


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{\n "a": 1,\n "b": {"c": [1, 2]}\n}')
    assert readers.json_artifact(spark, str(path)).first()["b"]["c"] == [1, 2]
    row = spark.createDataFrame([({"profileId": "x", "totalRamBytes": "many"},)], "data map<string,string>").select(*sinks.from_key_values(F.col("data"))).first()
    assert (row["profile_id"], row["total_ram_bytes"], row["os_version_sdk"], row["manufacturer"]) == ("x", 8 << 30, 34, "Generic")
    media = spark.createDataFrame([("m", bytearray([1]), bytearray([2]), "{}", "{}", "jpg", 1), ("m", bytearray([3]), bytearray([4]), "{}", "{}", "jpg", 2)], "media_id string, original binary, master binary, capture_json string, processing_json string, format string, seq int")
    sinks.write_media(media, "seq", str(tmp_path / "media"))
    found = {r["name"]: bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "media")).collect()}
    assert found["m_ORIGINAL.jpg"] == b"\x03" and found["m_MASTER.jpg"] == b"\x04" and len(found) == 3
    sinks.write_bundle({"scenes": C.scenes(spark)}, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle/scenes")).count() == 14


def test_media_of_other_ids_stay(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(i, bytearray(b), bytearray(b), "{}", "{}", "jpg", n) for i, b, n in r], "media_id string, original binary, master binary, capture_json string, processing_json string, format string, seq int")
    path = str(tmp_path / "media")
    sinks.write_media(rows(("a", b"1", 1)), "seq", path)
    sinks.write_media(rows(("b", b"2", 2)), "seq", path)
    sinks.write_media(rows(("a", b"3", 3)), "seq", path)
    found = {r["name"]: bytes(r["content"]) for r in sinks.read_media(spark, path).collect()}
    assert len(found) == 6 and found["a_ORIGINAL.jpg"] == b"3" and found["b_MASTER.jpg"] == b"2"


def test_cameras_with_defaults(spark, tmp_path):
    lines = [
        '{"camera_id": "0"}', '{"camera_id": "1", "level": "broken"}', "{nonsense", '{"level": 1}',
        '{"camera_id": "2", "level": 1, "facing": 0, "capabilities": [3, 11], "physical_ids": ["4"], "ois": [0, 1], "formats": [32, 4101], "dynamic_ranges": [64, 4], "stream_uses": [3, 9, 1], "ae_modes": [1, 6], "scene_modes": [5], "min_focus": 2.0, "ev_lo": -3}',
    ]
    (tmp_path / "cameras.json").write_text("\n".join(lines))
    scan = readers.camera_scan(spark, str(tmp_path / "cameras.json"))
    profiles = {r["camera_id"]: r for r in readers.camera_profiles(scan).collect()}
    more = {r["camera_id"]: r for r in readers.camera_capabilities(scan).collect()}
    assert set(profiles) == set(more) == {"0", "2"}
    assert profiles["0"]["hardware_level"] == "LEGACY" and profiles["0"]["focus_distance"] == pytest.approx(10)
    assert profiles["2"]["focus_distance"] == 0.5 and profiles["2"]["formats"] == ["RAW_SENSOR", "FORMAT_4101"]
    a, b = more["0"], more["2"]
    assert (a["lens_facing"], a["is_logical"], a["active"], a["max_frame_ns"], a["color_filter"]) == ("BACK_WIDE", False, (4000, 3000), 33_333_333, "RGGB")
    assert a["focal_lengths"] == pytest.approx([5.59]) and a["apertures"] == pytest.approx([1.6]) and tuple(a["size_mm"]) == pytest.approx((6.4, 4.8)) and a["ev_range"] == (-6, 6)
    assert a["dynamic_ranges"] == ["SDR"] and not a["ultra_hdr"] and [c["status"] for c in a["capabilities"]] == ["UNSUPPORTED"] * 3
    assert (b["lens_facing"], b["is_logical"], b["physical_ids"], b["ois_modes"], b["ev_range"]) == ("FRONT", True, ["4"], ["OFF", "ON"], (-3, 6))
    assert b["dynamic_ranges"] == ["SDR", "HDR10", "DOLBY_VISION_10B"] and b["stream_uses"] == ["VIDEO_RECORD", "PREVIEW"] and b["hybrid_ae_modes"] == ["ISO_PRIORITY"] and b["night_mode"] and b["ultra_hdr"]
    assert [c["status"] for c in b["capabilities"]] == ["DISCOVERED"] * 3


def test_verification_bundle(spark, tmp_path):
    head = "device_id string, timestamp bigint, device_model string, manufacturer string, brand string, product string, android_release string, sdk_int int, zero_copy_design boolean, zero_copy_state string, buffer_copies array<string>, notes string"
    device = lambda i, notes: spark.createDataFrame([(i, 1, 'M "1"', "m", "b", "p", None, 34, True, "NOT_VERIFIED", ["none"], notes)], head)
    (tmp_path / "cameras.json").write_text('{"camera_id": "1"}\n{"camera_id": "0", "dynamic_ranges": [4]}')
    raw = readers.camera_scan(spark, str(tmp_path / "cameras.json")).select(F.lit("x").alias("device_id"), F.lit(None).cast("array<int>").alias("black_level"), F.lit(None).cast("map<string,array<string>>").alias("constraints"), "*")
    cameras = readers.camera_records(raw, ["device_id", "black_level", "constraints"])
    streams = spark.createDataFrame([("x", "b", ["YUV"], "SUPPORTED", 3), ("x", "a", [], "FAILED", None)], "device_id string, combination string, streams array<string>, state string, latency_ms bigint")
    path = str(tmp_path / "bundle")

    def documents(name):
        return {d.parent.name.removeprefix("name="): json.loads(d.read_text()) for d in (tmp_path / "bundle" / f"device_id={name}").rglob("part-*.txt")}

    sinks.write_verification(sinks.verification_bundle(device("x", 'a "note"'), cameras, streams), path)
    sinks.write_verification(sinks.verification_bundle(device("y", None), cameras, streams), path)  # the other device's stay
    x, y = documents("x"), documents("y")
    assert len(x) == len(y) == 6
    assert x["device_profile.json"]["cameraCount"] == 2 and x["device_profile.json"]["deviceModel"] == 'M "1"' and x["device_profile.json"]["androidRelease"] is None
    assert [c["cameraId"] for c in x["camera_profile.json"]["cameras"]] == ["0", "1"] and x["camera_profile.json"]["cameras"][0]["sensor"]["isoRange"] == [100, 3200]
    assert [s["combination"] for s in x["stream_profile.json"]["streamMatrix"]] == ["a", "b"]
    assert x["dynamic_range_profile.json"]["cameraDynamicRange"]["0"]["supportedProfiles"] == ["SDR", "HDR10"]
    assert x["sensor_profile.json"]["sensors"][0]["whiteLevel"] == 1023 and x["sensor_profile.json"]["sensors"][0]["blackLevelPattern"] is None
    assert x["verification.json"]["notes"] == 'a "note"' and x["verification.json"]["status"] == "VERIFIED"
    assert y["camera_profile.json"] == {"cameras": []} and y["dynamic_range_profile.json"] == {"cameraDynamicRange": {}} and y["verification.json"]["notes"] is None


def test_logs_hold_a_bound(spark):
    logs = spark.range(1200).selectExpr("id as timestamp_ns", "case when id < 300 then 'OLD' else 'NEW' end as category", "'INFO' as level", "'m' as message")
    assert M.filter_logs(logs, "OLD").count() == 100 and M.filter_logs(logs, "OLD", limit=500).count() == 100
    assert M.recent_events(logs, "timestamp_ns", 600).count() == 500 and M.recent_events(logs, "timestamp_ns", 7).count() == 7


def test_errors_leave_out_what_is_missing(spark):
    df = spark.createDataFrame([("CAM", "lost", None, None), ("CAM", "lost", "IOException", "x" * 900)], "tag string, message string, throwable string, trace string")
    a, b = (r["event"] for r in df.select(M.log_error(F.col("tag"), F.col("message"), F.col("throwable"), F.col("trace"), F.lit(5)).alias("event")).collect())
    assert a == {"error_msg": "lost", "tag": "ERROR_CAM", "timestamp_ms": "5"}
    assert b == {"error_msg": "lost", "tag": "ERROR_CAM", "timestamp_ms": "5", "throwable": "IOException", "stacktrace": "x" * 500}
