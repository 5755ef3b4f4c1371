"""Stored rows by key, and logs that streams append to."""

import os
import random
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.sources.stores import KeyedStore
from sensorweave.streaming.logs import RollingLog

SCHEMA = T.StructType([T.StructField("media_id", T.StringType()), T.StructField("original", T.BinaryType()), T.StructField("meta", T.StringType())])


def held(store):
    return {r["media_id"]: (bytes(r["original"]), r["meta"]) for r in store.read().collect()}


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, "base").rglob("*.parquet")}


def test_random_changes(spark, tmp_path):
    rng, store, want, seq = random.Random(1), KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, ["media_id"], 4), {}, 0
    assert held(store) == {} and store.compact() == []
    for step in range(6):
        puts, gone = [], []
        for _ in range(rng.randint(1, 12)):
            seq += 1
            key = f"m{rng.randrange(9)}"
            puts.append((key, bytes([seq]), f"v{seq}", seq))
            want[key] = (bytes([seq]), f"v{seq}")
        store.put(spark.createDataFrame(puts, "media_id string, original binary, meta string, seq int"), "seq")
        for _ in range(rng.randint(0, 4)):
            seq += 1
            key = f"m{rng.randrange(9)}"
            gone.append((key, seq))
            want.pop(key, None)
        if gone:
            store.delete(spark.createDataFrame(gone, "media_id string, seq int"), "seq")
        assert held(store) == want
        if step % 2:
            store.compact()
            assert held(store) == want and not list(Path(tmp_path, "s/changes").rglob("*.parquet"))


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, ["media_id"], 8)
    rows = spark.range(200).select(F.concat(F.lit("m"), "id").alias("media_id"), F.lit(b"x").alias("original"), F.lit("v").alias("meta"), F.lit(1).alias("seq"))
    store.put(rows, "seq")
    assert store.compact() == list(range(8))
    before = files(f"{tmp_path}/s")
    store.put(spark.createDataFrame([("m7", b"y", "w", 2)], "media_id string, original binary, meta string, seq int"), "seq")
    [touched] = store.compact()
    after = files(f"{tmp_path}/s")
    same = {f for f in before if f"_bucket={touched}/" not in f}
    assert same and all(after.get(f) == before[f] for f in same) and before.keys() - after.keys()
    assert len(held(store)) == 200 and held(store)["m7"] == (b"y", "w")


def test_a_folder_whose_rows_are_all_deleted(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, ["media_id"], 1)
    rows = spark.createDataFrame([("a", b"1", "x", 1), (None, b"2", "y", 1)], "media_id string, original binary, meta string, seq int")
    store.put(rows, "seq")
    store.compact()
    store.delete(rows.select("media_id", F.lit(1).alias("seq")), "seq")  # a tombstone of the same sequence counts
    store.compact()
    assert held(store) == {} and not files(f"{tmp_path}/s")
    store.put(rows.where("media_id = 'a'").withColumn("seq", F.lit(2)), "seq")
    assert held(store) == {"a": (b"1", "x")}


def test_compaction_repeated_after_a_failure(spark, tmp_path, monkeypatch):
    from sensorweave.sources import stores

    store = KeyedStore(spark, f"file://{tmp_path}/s", SCHEMA, ["media_id"], 2)
    rows = spark.createDataFrame([("a", b"1", "x", 1), ("b", b"2", "y", 1)], "media_id string, original binary, meta string, seq int")
    store.put(rows, "seq")
    store.compact()
    store.put(rows.withColumn("meta", F.lit("z")).withColumn("seq", F.lit(2)), "seq")
    store.delete(rows.where("media_id = 'b'").withColumn("seq", F.lit(3)), "seq")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(stores, "remove", fails)
        try:
            store.compact()
        except OSError:
            pass
    assert held(store) == {"a": (b"1", "z")}
    store.compact()
    assert held(store) == {"a": (b"1", "z")}


def test_a_batch_written_again_adds_nothing(spark, tmp_path):
    log = RollingLog(spark, f"file://{tmp_path}/log", 100, "seq")
    batches = [spark.range(i * 30, i * 30 + 30).select(F.col("id").alias("seq"), F.lit("m").alias("body")) for i in range(8)]
    for i, rows in enumerate(batches):
        log.append(rows, i)
        log.append(rows, i)
    assert sorted(r["seq"] for r in log.read().collect()) == list(range(140, 240))
    assert sorted(r["seq"] for r in log.read(7).collect()) == list(range(233, 240))
    assert len([d for d in os.listdir(tmp_path / "log") if d.startswith("batch=")]) == 4
    log.append(spark.range(1000, 1500).select(F.col("id").alias("seq"), F.lit("m").alias("body")), 8)
    assert sorted(r["seq"] for r in log.read().collect()) == list(range(1400, 1500))
    log.empty()
    assert not (tmp_path / "log").exists()


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    log, schema = RollingLog(spark, f"file://{tmp_path}/log", 50, "seq"), "seq bigint, body string"
    for part in range(3):
        spark.range(part * 20, part * 20 + 20).select(F.col("id").alias("seq"), F.lit("m").alias("body")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = log.follow(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"file://{tmp_path}/checkpoint", available_now=True)
        q.awaitTermination()
    assert sorted(r["seq"] for r in log.read().collect()) == list(range(10, 60))
