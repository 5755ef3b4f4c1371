"""Queries over whole tables: no row is left out for its key or size."""

from sensorweave import queries as Q
from sensorweave.operators import ranking


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_buffers_of_any_length_are_encoded(spark, tmp_path):
    texts = {1: "a", 2: "é" * 200, 3: "x" * 100_000, 4: "", 5: None}
    d = folder(spark, tmp_path, documents=([(k, t, len(t or "")) for k, t in texts.items()], "doc_id bigint, text string, n_chars bigint"))
    found = {r["doc_id"]: (r["jpeg"], r["dng"]) for r in Q.QUERIES["encode_headers_whole"](spark, d).collect()}
    assert found == {k: (None, None) if t is None else tuple(m + t.encode().hex().upper() for m in ("FFD8FFE0", "49492A00")) for k, t in texts.items()}


def test_all_keys_are_paired(spark, tmp_path):
    orders, lines = {1, 3, 6, 10, 15, 30, 45}, {2, 3, 5, 10, 15, 30, 31}  # gaps on both sides
    d = folder(spark, tmp_path, orders=([(k,) for k in orders], "o_orderkey bigint"), lineitem=([(k,) for k in lines for _ in range(3)], "l_orderkey bigint"))
    found = sorted((r["order_key"], r["status"]) for r in Q.QUERIES["pair_full_outer_whole"](spark, d).collect())
    assert found == sorted((k, "paired" if k in orders & lines else "left_only" if k in orders else "right_only") for k in orders | lines)


def test_all_parts_have_a_place(spark, tmp_path):
    sizes = {k: k * 37 % 50 + 1 for k in range(1, 301)}
    d = folder(spark, tmp_path, part=(list(sizes.items()), "p_partkey bigint, p_size int"))
    want = sorted(sizes, key=lambda k: (sizes[k] % 3, sizes[k] % 5, sizes[k] % 7, k))
    found = {r["p_partkey"]: r["place"] for r in Q.QUERIES["version_order_whole"](spark, d).collect()}
    assert found == {k: i for i, k in enumerate(want, 1)}


def test_places_are_counted_in_pieces(spark):
    values = [None if i % 11 == 0 else (i * 7919) % 500 for i in range(2000)]  # nulls and equal values
    rows = spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint")
    found = {r["id"]: r["place"] for r in ranking.places(rows, ["v", "id"]).collect()}
    want = sorted(range(2000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert found == {k: i for i, k in enumerate(want, 1)}
    plan = ranking.places(rows, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert sorted(r["place"] for r in ranking.places(rows.select("v"), ["v"]).collect()) == list(range(1, 2001))
    assert ranking.places(rows.where("false"), ["v", "id"]).collect() == []
