"""Alignment and pairing with state and timers, on streams of files."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sensorweave.operators import temporal
from sensorweave.streaming import stateful
from tests.test_state import simulate

PROBES, SAMPLES = "k string, ts bigint, id int", "k string, ts bigint, v array<float>"
ARRIVALS = "stream string, side string, timestamp_ns bigint, arrival_ms bigint"


def expected(probes, samples, wait, watermark):
    """Probes that are settled at the end, by a loop."""
    out = {}
    for k, at, i in probes:
        held = {}
        for key, t, v in samples:
            if key == k:
                held[t] = max(held.get(t, v), v)
        low, high = max((t for t in held if t <= at), default=None), min((t for t in held if at <= t <= at + wait), default=None)
        if -(-(high if high is not None else at + wait) // 1000) > watermark // 1000:
            continue
        if low is None or high is None or low == high:
            out[i] = (held.get(low, held.get(high)), False)
        else:
            out[i] = ([a + (b - a) * (at - low) / (high - low) for a, b in zip(held[low], held[high])], True)
    return out


def test_alignment_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.sample(range(1_000_000, 9_000_000), 160))
    probes = [(rng.choice("ab"), t, n) for n, t in enumerate(times[::2])]
    samples = [(rng.choice("ab"), t, [float(rng.randrange(100)), 1.0]) for t in times[1::2]] + [("a", probes[5][1], [7.0, 7.0]), ("a", probes[5][1], [8.0, 7.0])]
    found = {}
    for part in range(4):  # each a run of its own, from the checkpoint of the one before
        low, high = 1_000_000 + part * 2_000_000, 3_000_000 + part * 2_000_000
        for name, rows, schema in (("p", probes, PROBES), ("s", samples, SAMPLES)):
            spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        aligned = stateful.align_stream(read("p", PROBES), read("s", SAMPLES), ["k"], "ts", "v", 500_000)
        q = aligned.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert r["id"] not in found
        found[r["id"]] = (r["v"], r["is_interpolated"])
    want = expected(probes, samples, 500_000, max(times))
    assert found.keys() == want.keys() and len(want) > 60
    for i in want:
        assert found[i][1] == want[i][1] and found[i][0] == (pytest.approx(want[i][0], rel=1e-5) if want[i][0] else None)


def test_settled_probes_are_those_of_the_batch(spark, tmp_path):
    rows = spark.range(400).select(F.lit("a").alias("k"), (F.col("id") * 10_000 + 1_000_000).alias("ts"), "id")
    probes, samples = rows.where("id % 2 = 0").withColumn("id", F.col("id").cast("int")), rows.where("id % 2 = 1").select("k", "ts", F.array(F.col("id").cast("float")).alias("v"))
    probes.write.parquet(f"{tmp_path}/p")
    samples.write.parquet(f"{tmp_path}/s")
    aligned = stateful.align_stream(spark.readStream.schema(PROBES).parquet(f"{tmp_path}/p"), spark.readStream.schema(SAMPLES).parquet(f"{tmp_path}/s"), ["k"], "ts", "v", 100_000)
    q = aligned.writeStream.format("memory").queryName("settled").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["id"]: (r["v"], r["is_interpolated"]) for r in temporal.align(probes, samples, ["k"], "ts", "v").collect()}
    found = {r["id"]: (r["v"], r["is_interpolated"]) for r in spark.sql("select * from settled").collect()}
    assert found == {i: v for i, v in batch.items() if i in found} and len(found) == 200


def test_an_idle_stream_lets_go_what_waits(spark, tmp_path):
    now = [("a", "image", 1, 0), ("a", "result", 1, 1), ("a", "image", 2, 2), ("b", "result", 9, 0)]
    spark.createDataFrame(now, ARRIVALS).coalesce(1).write.parquet(f"{tmp_path}/in")
    paired = stateful.pair_timed_stream(spark.readStream.schema(ARRIVALS).parquet(f"{tmp_path}/in"), "stream", 4, 1500)
    q = paired.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/c").start()
    end = time.time() + 60
    want = {("a", "paired", "result", 1), ("a", "dropped", "image", 2), ("b", "dropped", "result", 9)}
    while time.time() < end and {tuple(r) for r in spark.sql("select * from idle").collect()} != want:
        time.sleep(0.5)
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from idle").collect()) == sorted(want)


def test_buffers_and_drain(spark, tmp_path):
    rng = random.Random(8)
    rows = {k: [(rng.choice(["image", "result"]), rng.randrange(12), t * 7) for t in range(60)] for k in "xy"}
    for part in range(3):
        some = [(k, *r) for k, rs in rows.items() for r in rs[part * 20 : part * 20 + 20]] + ([(k, stateful.DRAIN, 0, 10_000) for k in rows] if part == 2 else [])
        spark.createDataFrame(some, ARRIVALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01)
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.pair_timed_stream(stream, "stream", 4, 600_000).writeStream.format("memory").queryName("drained").option("checkpointLocation", f"{tmp_path}/c").start()
    want, end = {k: simulate(rs, 4, 600_000) for k, rs in rows.items()}, time.time() + 60
    found = []
    while time.time() < end and len(found) < sum(map(len, want.values())):
        time.sleep(0.5)
        found = spark.sql("select * from drained").collect()
    q.stop()
    for k in rows:
        assert sorted((r["outcome"], r["side"], r["timestamp_ns"]) for r in found if r["stream"] == k) == want[k]


class Calls:
    """A key's state and timers; each call of them is a message to the JVM."""

    def __init__(self):
        self.made, self.value = 0, None

    def __getattr__(self, name):
        def call(*args):
            self.made += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            return self.value is not None if name == "exists" else []

        return call

    def getValueState(self, *_):
        return self


def test_a_key_needs_few_messages():
    calls, align = Calls(), stateful._Align(1000, ["k", "ts", "align_row", "v", "is_interpolated"])
    align.init(calls)
    at = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = [Row(align_at=5000, align_probe=True, align_row="{}", align_values=None), Row(align_at=4000, align_probe=False, align_row=None, align_values=[1.0])]
    assert list(align.handleInputRows(("a",), iter(rows), at)) == [] and calls.made <= 3
    calls.made, at.getCurrentWatermarkInMs = 0, lambda: 6
    assert [tuple(r) for r in align.handleExpiredTimer(("a",), at, None)] == [("a", 5000, "{}", [1.0], False)] and calls.made <= 2
