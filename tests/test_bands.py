"""Binary planes by bands, against whole bursts in numpy and the forms over arrays."""

import random

import pytest
from pyspark.sql import functions as F

from sensorweave.functions import bands, bursts, planes

SCHEMA = "burst string, seq int, plane binary, width int, height int, iso int"


def frames(seed, w=50, h=70, n=4):
    rng = random.Random(seed)
    base = bytes(rng.randrange(256) for _ in range(w * h)) if seed % 2 else bytes([rng.choice([20, 60, 130])] * (w * h))
    noisy = lambda far: bytes(min(255, max(0, v + rng.randint(-far, far))) for v in base)
    return [(f"b{seed}", i, noisy([3, 90, 200][seed % 3]), w, h, [100, 400, 3200][seed % 3]) for i in range(n)]


def test_bursts_as_whole_ones(spark):
    rows = [f for s in range(6) for f in frames(s)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {r["burst"]: r for r in bands.burst_guard(df, ["burst"], "seq", "plane", F.col("width"), F.col("iso")).collect()}
    for s in range(6):
        mine = [f for f in rows if f[0] == f"b{s}"]
        want = bursts.process([f[2] for f in mine], 50, 70, mine[0][5])
        got = found[f"b{s}"]
        assert (got["action"], got["frames"], got["n_pixels"]) == (want["action"], 4, 3500)
        assert got["ratio"] == pytest.approx(want["ratio"], rel=1e-6) and got["blend_ratio"] == pytest.approx(want["blend_ratio"], rel=1e-6)


def test_array_form_gives_the_same_confidence(spark):
    rows = [f for f in frames(2)]
    arrays = spark.createDataFrame([(f[0], f[1], list(f[2])) for f in rows], "burst string, seq int, plane array<int>")
    last = arrays.where("seq = 3").select("burst", F.col("plane").alias("orig"), F.col("plane").alias("recon"))
    want = planes.guard_decisions(last, ["burst"], "orig", "recon", F.lit(50), F.lit(3200)).first()
    got = bands.burst_guard(spark.createDataFrame(rows[3:], SCHEMA), ["burst"], "seq", "plane", F.col("width"), F.col("iso")).first()
    assert (got["n_high"], got["n_far"], got["action"]) == (want["n_high"], want["n_far"], want["action"])
    assert got["confidence_mean"] == pytest.approx(want["confidence_mean"], rel=1e-6)


def test_short_empty_and_unsigned(spark):
    rows = [("x", 1, bytes([200] * 300), 10, 30, 100), ("x", 2, bytes([100] * 40), 10, 4, 100), ("e", 1, b"", 10, 0, 100), ("n", 1, None, 10, 0, 100), (None, 1, bytes([255] * 64), 8, 8, 100)]
    found = {r["burst"]: r for r in bands.burst_guard(spark.createDataFrame(rows, SCHEMA), ["burst"], "seq", "plane", F.col("width"), F.col("iso"), 4, 1).collect()}
    assert found["x"]["n_pixels"] == 40 and found["x"]["n_far"] == 40  # 150 against 100
    assert all(found[k]["n_pixels"] == 0 and found[k]["confidence_mean"] == 0.5 and found[k]["action"] == "KEEP_RECONSTRUCTED" for k in "en")
    assert found[None]["n_high"] == 0 and found[None]["confidence_mean"] == pytest.approx(0.2 - 1 / 64, rel=1e-5)
    assert bands.burst_guard(spark.createDataFrame([], SCHEMA), ["burst"], "seq", "plane", F.col("width"), F.col("iso")).count() == 0


def test_quality_of_bytes(spark):
    rows = [(f[0], f[1], f[2]) for f in frames(1)] + [("e", 0, b""), ("n", 0, None)]
    found = {(r["burst"], r["seq"]): r.asDict() for r in bands.with_binary_quality(spark.createDataFrame(rows, "burst string, seq int, plane binary"), "plane").drop("plane").collect()}
    want = planes.with_quality(spark.createDataFrame([(b, s, list(p or b"")) for b, s, p in rows], "burst string, seq int, plane array<int>"), "plane").drop("plane").collect()
    assert found == {(r["burst"], r["seq"]): r.asDict() for r in want}
