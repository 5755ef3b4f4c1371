"""Operators that cut one key's rows into pieces, against plain loops, with nearly all rows under one key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sensorweave.functions import planes
from sensorweave.operators import metrics, pieces, retention, temporal
from sensorweave.sources.catalogs import TRANSITIONS
from sensorweave.streaming import streams


@pytest.fixture(params=[4, 13])
def shuffled(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_long_key_lies_in_many_pieces(shuffled):
    rows = shuffled.range(20_000).selectExpr("'hot' as k", "id as seq").unionByName(shuffled.createDataFrame([("b", 1), (None, 1), ("b", None)], "k string, seq bigint"))
    cut = pieces.cut(rows, ["k"], ["seq"])
    sizes = [r["n"] for r in cut.where("k = 'hot'").groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 3 * 20_000 / len(sizes)
    order = [r["_piece"] for r in cut.where("k = 'hot'").orderBy("seq").collect()]
    assert order == sorted(order)
    assert pieces.cut(rows.limit(0), ["k"], ["seq"]).count() == 0


def replayed(rows):
    state, yes, no = "UNINITIALIZED", 0, 0
    for _, to, forced in rows:
        if forced:
            state, yes = "ERROR", yes + 1
        elif to in TRANSITIONS[state]:
            state, yes = to, yes + 1
        else:
            no += 1
    return state, yes, no


def test_states_of_a_long_session(shuffled, monkeypatch):
    monkeypatch.setattr(streams, "FOLDED", 50)
    rng = random.Random(2)
    names = [*TRANSITIONS, "NOWHERE", None]
    rows = {k: [(i, rng.choice(names), rng.random() < 0.05) for i in range(n)] for k, n in (("hot", 3000), ("a", 30), ("b", 1))}
    df = shuffled.createDataFrame([(k, *r) for k, rs in rows.items() for r in rs], "session string, seq int, requested string, forced boolean").repartition(5)
    found = {r["session"]: (r["final_state"], r["accepted"], r["rejected"]) for r in streams.replay_states(df, "session", forced="forced").collect()}
    assert found == {k: replayed(rs) for k, rs in rows.items()}
    assert streams.replay_states(df.limit(0), "session").count() == 0


def test_a_session_of_many_requests_takes_many_tasks(spark):
    names = F.array(*[F.lit(s) for s in TRANSITIONS])
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("one").alias("session"), F.col("id").alias("seq"), F.get(names, F.pmod(F.hash("id"), F.lit(len(TRANSITIONS)))).alias("requested"))
    cut = pieces.cut(rows, ["session"], ["seq"])
    assert cut.select("_piece").distinct().count() >= 3
    found = streams.replay_states(rows, "session").first()
    want = replayed([(r["seq"], r["requested"], False) for r in rows.orderBy("seq").collect()])
    assert (found["final_state"], found["accepted"], found["rejected"]) == want


def test_window_drops_what_later_arrivals_drop(shuffled):
    rng = random.Random(3)
    rows = [(k, arrival, rng.randrange(400)) for k, n in (("hot", 900), ("x", 40), (None, 5)) for arrival in range(n)]
    want = set()
    for key in ("hot", "x", None):
        held = {}
        for k, arrival, ts in rows:
            if k == key:
                held[ts] = arrival
                held = {t: a for t, a in held.items() if t >= ts - 100}
        want |= {(key, a, t) for t, a in held.items()}
    df = shuffled.createDataFrame(rows, "k string, arrival int, ts bigint").repartition(7)
    found = temporal.retained_window(df, ["k"], 100, "arrival").collect()
    assert len(found) == len(want) and {(r["k"], r["arrival"], r["ts"]) for r in found} == want


def test_keyframes_of_a_long_key(shuffled):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([True, True, False, None])) for k, n in (("hot", 2000), ("x", 20)) for i in range(n)]
    found = {(r["k"], r["i"]): (r["is_dropped"], r["is_enhanced"]) for r in streams.keyframes(shuffled.createDataFrame(rows, "k string, i int, on boolean").repartition(6), ["k"], "i", 15, F.col("on")).collect()}
    for key in ("hot", "x"):
        n = 0
        for k, i, on in rows:
            if k == key:
                n += bool(on)
                assert found[k, i] == (not on, bool(on) and n % 15 == 0)


def test_motion_across_pieces(shuffled):
    rng = random.Random(5)
    rows = [("hot", i, None if i % 97 == 5 else [rng.randrange(256) for _ in range(64 if i % 31 else 48)]) for i in range(600)]
    found = {r["i"]: (r["delta"], r["is_tripod"]) for r in planes.motion_vectors(shuffled.createDataFrame(rows, "k string, i int, p array<int>").repartition(6), ["k"], "i", "p").collect()}
    for (_, _, before), (_, i, now) in zip([(None, None, None), *rows], rows):
        if before is None or now is None or len(before) != len(now):
            assert found[i] == (0.0, True)
        else:
            diff = sum(abs(a - b) for a, b in zip(before[::16], now[::16])) / len(now[::16])
            assert found[i][0] == pytest.approx(diff * 0.1, rel=1e-5) and found[i][1] == (diff < 2)


def test_plan_orders_no_whole_key(spark):
    rows = spark.range(1000).selectExpr("'a' as k", "id", "array(1, 2) as p")
    for df in (streams.keyframes(rows, ["k"], "id"), planes.motion_vectors(rows, ["k"], "id", "p")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.split("\n") if "windowspecdefinition" in line]
        assert windows and all("_piece" in line for line in windows)


def test_percentiles_of_a_heavy_tail(spark):
    n = 60_000
    rows = spark.range(0, n, 1, 4).select(F.lit("k").alias("k"), F.exp(F.randn(7) * 4).alias("v"))
    rows = spark.createDataFrame(rows.toPandas())
    held = sorted(r["v"] for r in rows.collect())
    found = metrics.index_percentiles(rows, ["k"], "v", {"median": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert found["n"] == n and [found[c] for c in ("median", "p95", "p99")] == [held[n // 2], held[min(int(n * 0.95), n - 1)], held[min(int(n * 0.99), n - 1)]]
    sizes = [r["n"] for r in metrics.parted(rows.select("k", F.col("v").alias("_v"), F.lit(1).alias("_n")), ["k"]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 0.9 * metrics.PIECES and max(sizes) < 2 * n / len(sizes)


def test_part_of_a_value(spark):
    cuts = [1.0, 2.0, 2.0, 5.0]
    rows = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 2.5, 5.0, 9.0)], "v double")
    found = {r["v"]: r["p"] for r in rows.select("v", metrics.part_of(F.col("v"), F.array(*map(F.lit, cuts))).alias("p")).collect()}
    assert found == {v: sum(c < v for c in cuts) for v in found}


@pytest.mark.parametrize("n", [1, 10, 500, 5000])
def test_last_rows_without_a_key(shuffled, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, rng.randrange(10**9)]) if rng.random() < 0.2 else i, str(i)) for i in range(2000)]
    df = shuffled.createDataFrame(rows, "seq bigint, body string").repartition(9)
    found = retention.last_n(df, [], "seq", n).collect()
    want = sorted((-1 if s is None else s for s, _ in rows), reverse=True)[:n]
    assert sorted((-1 if r["seq"] is None else r["seq"] for r in found), reverse=True) == want


def test_last_rows_are_cut_in_the_scan(spark, tmp_path):
    spark.range(0, 100_000, 1, 10).selectExpr("id as seq", "cast(id as string) as body").write.parquet(str(tmp_path / "log"))
    found = retention.last_n(spark.read.parquet(str(tmp_path / "log")), [], "seq", 100)
    assert "GreaterThanOrEqual(seq,99900)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100
