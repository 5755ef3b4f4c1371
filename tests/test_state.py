"""Retention, pairing and state machines against plain simulators."""

import random
import time

from pyspark.sql import functions as F

from sensorweave.operators import pairing, retention
from sensorweave.sources import readers
from sensorweave.sources.catalogs import TRANSITIONS
from sensorweave.streaming import streams


def ring(rows, capacity, most):
    held = []
    for seq, size in rows:
        while held and (len(held) >= capacity or sum(s for _, s in held) + size > most):
            held.pop(0)
        held.append((seq, size))
    return held


def test_ring_against_a_simulation(spark):
    rng = random.Random(3)
    for _ in range(4):
        capacity, most = rng.randint(1, 6), rng.randint(50, 400)
        streams_ = {k: [(i, rng.randint(1, 200)) for i in range(rng.randint(1, 15))] for k in "abc"}
        df = spark.createDataFrame([(k, i, s) for k, rows in streams_.items() for i, s in rows], "k string, seq int, size int")
        found = {(r["k"], r["seq"]) for r in retention.ring_retained(df, ["k"], "seq", "size", capacity, most).collect()}
        assert found == {(k, i) for k, rows in streams_.items() for i, _ in ring(rows, capacity, most)}


def test_oversized_frame_stays_alone(spark):
    df = spark.createDataFrame([("a", 1, 100), ("a", 2, 400)], "k string, seq int, size int")
    assert [r["seq"] for r in retention.ring_retained(df, ["k"], "seq", "size", 3, 250).collect()] == [2]


def test_store_evicts_smallest_keys(spark):
    df = spark.createDataFrame([("a", k, n, f"v{n}") for n, k in enumerate([5, 1, 9, 5, 7])], "s string, k int, n int, v string")
    found = {r["k"]: r["v"] for r in retention.keyed_store(df, ["s"], "k", "n", 3).collect()}
    assert found == {5: "v3", 7: "v4", 9: "v2"}


def simulate(rows, cap, timeout):
    a, out = pairing.Associator(cap, timeout), []
    for side, key, at in rows:
        out += [(w, s, k) for w, s, k in a.arrive(side, key, at)]
    return sorted(out + [("pending", s, k) for s, held in a.pending.items() for k in held])


def test_pairing_cases():
    assert simulate([("image", 100, 0), ("result", 100, 1)], 30, 1000) == [("paired", "result", 100)]
    stale = simulate([("image", 100, 0), ("image", 200, 0), ("image", 300, 25)], 2, 10)
    assert stale == [("dropped", "image", 100), ("dropped", "image", 200), ("pending", "image", 300)]
    over = simulate([("image", 300, 0), ("image", 100, 0), ("image", 200, 0)], 2, 1000)
    assert ("dropped", "image", 100) in over


def test_bounded_pairing_replays_each_stream(spark):
    rng = random.Random(5)
    rows = {k: [(rng.choice(["image", "result"]), rng.randrange(12), t * 7) for t in range(60)] for k in "xyz"}
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "stream string, side string, timestamp_ns bigint, arrival_ms bigint")
    found = pairing.pair_bounded(df, "stream", 4, 60).collect()
    for k, rs in rows.items():
        assert sorted((r["outcome"], r["side"], r["timestamp_ns"]) for r in found if r["stream"] == k) == simulate(rs, 4, 60)


def test_stream_pairs_equal_batch_pairs(spark, tmp_path):
    schema = "k bigint, at timestamp"
    for name, ids in (("i", range(0, 8)), ("r", range(4, 12))):
        spark.createDataFrame([(i, i) for i in ids], "k bigint, s bigint").select("k", F.timestamp_seconds("s").alias("at")).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    q = streams.pair_streams(read("i"), read("r"), "k", "at", "2 seconds").writeStream.format("memory").queryName("paired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["k"], r["status"]) for r in spark.sql("select * from paired").collect()}
    batch = {(r["k"], r["status"]) for r in streams.pair_streams(spark.read.parquet(str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "r")), "k", "at", "2 seconds").collect()}
    assert {x for x in batch if x[1] == "paired"} == {x for x in got if x[1] == "paired"} and got <= batch


def test_states_against_a_simulation(spark):
    rng = random.Random(11)
    names = list(TRANSITIONS)
    rows = {k: [(i, rng.choice(names), rng.random() < 0.1) for i in range(40)] for k in "ab"}
    rows["c"] = [(i, s, False) for i, s in enumerate(["INITIALIZING", "READY", "FOCUSING", "CAPTURING", "PROCESSING", "SAVING", "READY", "CLOSED"])]
    df = spark.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "session string, seq int, requested string, forced boolean")
    found = {r["session"]: (r["final_state"], r["accepted"], r["rejected"]) for r in streams.replay_states(df, "session", forced="forced").collect()}
    for k, rs in rows.items():
        state, yes, no = "UNINITIALIZED", 0, 0
        for _, to, forced in rs:
            if forced:
                state, yes = "ERROR", yes + 1
            elif to in TRANSITIONS[state]:
                state, yes = to, yes + 1
            else:
                no += 1
        assert found[k] == (state, yes, no)
    assert found["c"] == ("CLOSED", 8, 0)


def test_keyframes(spark):
    df = spark.range(30).selectExpr("'a' as k", "id")
    found = streams.keyframes(df, ["k"], "id").where("is_enhanced").collect()
    assert sorted(r["id"] for r in found) == [14, 29]
    off = streams.keyframes(df, ["k"], "id", recording=F.col("id") >= 10).collect()
    assert sum(r["is_dropped"] for r in off) == 10 and [r["id"] for r in off if r["is_enhanced"]] == [24]


def test_bounded_pairing_on_a_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = {k: [(rng.choice(["image", "result"]), rng.randrange(12), t * 7) for t in range(60)] for k in "xy"}
    for part in range(3):  # a batch for each third of the arrivals
        some = [(k, *r) for k, rs in rows.items() for r in rs[part * 20 : part * 20 + 20]]
        spark.createDataFrame(some, readers.ARRIVALS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.01)
    q = pairing.pair_bounded_stream(readers.arrival_stream(spark, str(tmp_path / "in")), "stream", 4, 60).writeStream.format("memory").queryName("bounded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    found = spark.sql("select * from bounded").collect()
    for k, rs in rows.items():
        assert sorted((r["outcome"], r["side"], r["timestamp_ns"]) for r in found if r["stream"] == k) == [x for x in simulate(rs, 4, 60) if x[0] != "pending"]


def test_lifecycle_counts(spark):
    rows = [("s", "paired", "result", 1), ("s", "dropped", "image", 2), ("s", "dropped", "result", 3), ("s", "pending", "image", 4)]
    row = pairing.lifecycle_counts(spark.createDataFrame(rows, "stream string, outcome string, side string, timestamp_ns bigint")).first()
    assert row.asDict() == {"stream": "s", "associated": 1, "dropped": 2, "pending": 1, "acquired": 3, "closed": 1, "outstanding": 2}
