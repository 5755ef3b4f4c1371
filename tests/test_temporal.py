"""Alignment: the branches of the as-of join, buckets against one window, the clock report."""

import random

import pytest

from sensorweave.operators import temporal as T

SAMPLES = [(100, [1.0, 0.0, 0.0]), (200, [3.0, 0.0, 0.0])]


def samples(spark, rows):
    return spark.createDataFrame(rows, "ts bigint, values array<float>")


def probes(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts bigint")


@pytest.mark.parametrize(("probe", "first", "flag"), [(150, 2.0, True), (50, 1.0, False), (250, 3.0, False), (100, 1.0, False), (200, 3.0, False)])
@pytest.mark.parametrize("bucket", [None, 60])
def test_branches(spark, probe, first, flag, bucket):
    row = T.align(probes(spark, [probe]), samples(spark, SAMPLES), [], bucket=bucket).first()
    assert (row["values"][0], row["is_interpolated"]) == (first, flag)


def test_no_samples(spark):
    row = T.align(probes(spark, [1]), samples(spark, []), []).first()
    assert row["values"] is None and not row["is_interpolated"]


def test_two_sensors(spark):
    found = T.align_two(probes(spark, [150]), samples(spark, SAMPLES), samples(spark, [(150, [0.0, 9.8, 0.0])]), []).first()
    assert found["gyro"][0] == 2.0 and found["accel"][1] == pytest.approx(9.8) and found["is_interpolated"]


def test_axes_of_unlike_length(spark):
    row = T.align(probes(spark, [150]), samples(spark, [(100, [1.0, 2.0]), (200, [3.0])]), []).first()
    assert row["values"] == [2.0]


def test_floor_is_preferred_to_a_nearer_ceiling(spark):
    found = {r["ts"]: r["matched_ts"] for r in T.floor_else_ceiling(probes(spark, [199, 50]), samples(spark, SAMPLES), []).collect()}
    assert found == {199: 100, 50: 100}


def test_buckets_equal_one_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), t, [rng.random()]) for t in rng.sample(range(10_000), 300)]
    asked = [(i, rng.choice("abc"), rng.randrange(10_000)) for i in range(300)]
    s = spark.createDataFrame(rows, "k string, ts bigint, values array<float>")
    p = spark.createDataFrame(asked, "id int, k string, ts bigint")
    plain = sorted(map(str, T.align(p, s, ["k"]).select("id", "values", "is_interpolated").collect()))
    for bucket in (1, 37, 1000, 50_000):
        assert sorted(map(str, T.align(p, s, ["k"], bucket=bucket).select("id", "values", "is_interpolated").collect())) == plain


def test_clock_report(spark):
    p = probes(spark, [105, 150, 195]).selectExpr("'c' as k", "id", "ts")
    matched = T.floor_else_ceiling(p, samples(spark, SAMPLES).selectExpr("'c' as k", "*"), ["k"])
    row = T.clock_report(matched, ["k"]).first()
    assert (row["is_monotonic"], row["is_verified"], row["avg_offset"], row["max_offset"], row["missing_intervals"], row["sample_count"]) == (True, True, 50, 95, 0, 3)


def test_clock_report_repeats_and_no_samples(spark):
    p = spark.createDataFrame([("c", 1, 5), ("c", 2, 5)], "k string, n int, ts bigint")
    matched = T.floor_else_ceiling(p, spark.createDataFrame([], "k string, ts bigint, values array<float>"), ["k"])
    row = T.clock_report(matched, ["k"], order="n").first()
    assert (row["is_monotonic"], row["is_verified"], row["avg_offset"], row["max_offset"], row["missing_intervals"], row["sample_count"]) == (True, False, 0, 0, 0, 0)
    with_samples = T.floor_else_ceiling(p, samples(spark, SAMPLES).selectExpr("'c' as k", "*"), ["k"])
    row = T.clock_report(with_samples, ["k"], order="n").first()
    assert (row["is_monotonic"], row["is_verified"], row["sample_count"]) == (False, False, 2)


def test_trailing_window_keeps_the_bound(spark):
    df = spark.createDataFrame([("g", t) for t in (0, 1, 2, 12)], "k string, ts bigint")
    assert sorted(r["ts"] for r in T.trailing_window(df, ["k"], 10).collect()) == [2, 12]
