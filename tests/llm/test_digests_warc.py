import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.llm import digests as D
from sensorweave.llm import warc as W
from sensorweave.llm._flat import byte_buffer
from sensorweave.llm._shared import scratch
from tests.llm.helpers import GOOD, awkward, empty


def test_pair_counts_against_brute_force():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 103, 400).astype(np.uint8)
    want = [sum(buf[i + a] == buf[i + b] for a in range(D.WINDOW) for b in range(a)) for i in range(len(buf) - D.WINDOW + 1)]
    assert D.pair_counts(buf).tolist() == want


def test_features_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh ij\nklé"), int(n))) for n in (0, 5, 31, 32, 40, 94, 95, 96, 500, 3000)] + [GOOD * 9, "x" * 300]
    together = D.filters(texts)
    for text, chain in zip(texts, together, strict=True):
        assert (D.filters([text])[0] == chain).all() and (D.from_text(D.to_text(chain)) == chain).all()
    buf, offsets = byte_buffer(texts)
    assert D.features(buf, offsets)[0].max() == len(texts) - 2  # a run of one byte has no rare window


def test_likeness():
    a, b, changed = D.filters([GOOD * 3 + "one end", "entirely other words stand in this one, none are shared " * 5, GOOD * 3 + "another end"])
    assert D.likeness(a, a) == 1 and D.likeness(a, b) < 0.2 and D.likeness(a, changed) > 0.7
    assert D.likeness(a, a[:0]) == 0 and D.likeness(a[:0], a[:0]) == 1


def test_only_the_empty_text_has_no_filter():
    prose = GOOD * 3
    texts = [prose[:n] for n in range(1, 200)] + ["x" * 300, "x" * 301, "-" * 5000, "| | " * 90, "x" * 400 + prose[:40]]
    chains = D.filters(["", *texts, ""])
    assert [len(c) for c in (chains[0], chains[-1])] == [0, 0] and all(len(c) and c.any() for c in chains[1:-1])
    bare = D.filters(["x" * 300, "x" * 301, "-" * 5000])
    assert all(D.likeness(a, b) < 1 for i, a in enumerate(bare) for b in bare[:i]) and D.likeness(bare[0], chains[0]) == 0


def test_compare_with_next(spark):
    df = awkward(spark, [(100 + 3 * i, GOOD[i:] + str(i), "en", "s", 0) for i in range(40)])
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = D.compare_with_next(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    want = []
    for i, (_, key, text) in enumerate(rows):
        changed = D.edited(text, rows[(i + 1) % len(rows)][2])
        want.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), D.to_text(D.filters([text])[0]), D.to_text(D.filters([changed])[0])))
    got = [(r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in found]
    assert sorted(got) == sorted(want)

    def share(a, b):
        return D.likeness(D.from_text(a), D.from_text(b))

    texts = {(k, hashlib.sha256(D.edited(t, rows[(i + 1) % len(rows)][2]).encode()).hexdigest()): (t, D.edited(t, rows[(i + 1) % len(rows)][2])) for i, (_, k, t) in enumerate(rows)}
    for r in found:
        text, changed = texts[r["doc_id"] or 0, r["edited_sha256"]]
        assert r["near_edited"] == (1.0 if text == changed else share(r["fingerprint"], r["edited_fingerprint"]))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert D.compare_with_next(empty(spark)).count() == 0
    one = D.compare_with_next(spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def pages(spark):
    big = "x" * 200
    rows = [(3, "http://a", big), (1, "http://b\n c", big), (9, None, big), (4, "http://c", "x" * 99), (5, "http://c", "x" * 99), (6, "http://d", None), (7, "http://e", ""), (None, "http://n", big), (8, "http://f", "é" * 60), (8, "http://f", "é" * 60)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark):
    rows = W.round_trip(pages(spark)).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in rows)
    assert got == [(0, 200, "revisit", 1), (1, 200, "response", 0), (3, 200, "revisit", 1), (4, 99, "response", 0), (5, 99, "response", 0), (6, 0, "response", 0), (7, 0, "response", 0), (8, 120, "response", 0), (8, 120, "response", 0), (9, 200, "revisit", 1)]
    assert all(r["payload_digest"] == hashlib.sha256({200: b"x" * 200, 99: b"x" * 99, 0: b"", 120: "é".encode() * 60}[r["payload_bytes"]]).hexdigest() for r in rows)
    assert W.round_trip(pages(spark).where("false")).count() == 0


def test_files_are_split_and_read_back(spark):
    path = scratch(spark, "warc-test")
    files = W.write_archives(W.assign_types(pages(spark)), path, file_bytes=600)
    assert files.count() > 3
    back = W.read_archives(files, path)
    assert back.where("kind != 'gap'").count() == 10 and back.where("kind = 'gap'").count() == 0


def test_long_urls_and_clashing_columns(spark):
    urls = {1: "http://a/" + "u" * 1_000_000, 2: "http://a/" + "v" * 70_000, 3: "http://b"}
    df = spark.createDataFrame([(k, u, "x" * k, "mine") for k, u in urls.items()], "page_id bigint, url string, html string, digest string").withColumn("records", F.lit(1))
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in W.round_trip(df).collect()) == [(k, k, "response") for k in urls]
    for parts in ([W.build_record(k, u, b"x", W._hex(b"x"), None) for k, u in urls.items()],) * 2:
        assert damaged(parts, lambda d, p: None) == (["1", "2", "3"], 0)
        parts[:] = [W.compress_member(p) for p in parts]


def test_a_lost_record_is_an_error(spark, monkeypatch):
    whole = W.build_record
    monkeypatch.setattr(W, "build_record", lambda page, *rest: whole(page, *rest)[: -9 if page == 4 else None])
    with pytest.raises(RuntimeError, match="of 10 records written"):
        W.round_trip(pages(spark))


def damaged(parts, harm):
    data, places = bytearray(b"".join(parts)), [0]
    for p in parts:
        places.append(places[-1] + len(p))
    harm(data, places)
    found = list(W.read_archive(io.BytesIO(bytes(data)), len(data)))
    covered = sum(x.end - x.start for x in found if isinstance(x, W.Gap))
    return [x.headers["warc-page-id"] for x in found if isinstance(x, W.Record)], covered


def test_salvage():
    records = [W.build_record(i, f"http://a/{i}", bytes([65 + i]) * 70_000, W._hex(bytes([65 + i]) * 70_000), None) for i in range(6)]
    for parts in (records, [W.compress_member(r) for r in records]):

        def flip(data, places, at=2):
            data[places[at] + (places[at + 1] - places[at]) // 2] ^= 0xFF

        ids, gap = damaged(parts, flip)
        assert ids == ["0", "1", "3", "4", "5"] and gap == len(parts[2])

        def wipe(data, places):
            data[places[0] : places[0] + 4] = b"zzzz"
            data[places[4] : places[4] + 4] = b"zzzz"

        assert damaged(parts, wipe)[0] == ["1", "2", "3", "5"]

        def cut(data, places):
            del data[places[5] + 30 :]

        assert damaged(parts, cut) == (["0", "1", "2", "3", "4"], 30)

        def junk(data, places):
            data[places[3] : places[3]] = b"\x1f\x8b\x08 WARC/1.1\r\nnonsense" * 3

        assert damaged(parts, junk)[0] == ["0", "1", "2", "3", "4", "5"]
        assert damaged([b"no archive"], lambda d, p: None) == ([], 10)


def test_salvage_inside_members():
    records = [W.build_record(i, f"http://a/{i}", bytes(range(256)) * 20, W._hex(bytes(range(256)) * 20), None) for i in range(5)]

    def read(data):
        found = list(W.read_archive(io.BytesIO(data), len(data)))
        return [x.headers["warc-page-id"] for x in found if isinstance(x, W.Record)], [(x.start, x.end) for x in found if isinstance(x, W.Gap)]

    bad = bytearray(records[2])
    bad[-20] ^= 0xFF
    held = W.compress_member(b"".join([*records[:2], bytes(bad), *records[3:]]))
    after = W.compress_member(records[0])
    assert read(held + after) == (["0", "1", "3", "4", "0"], [(0, len(held))])
    no_line = W.compress_member(b"".join([*records[:2], b"zzzz" + records[2][4:], *records[3:]]))
    assert read(no_line) == (["0", "1", "3", "4"], [(0, len(no_line))])
    rng = np.random.default_rng(1)
    noise = [W.build_record(i, "u", x, W._hex(x), None) for i, x in enumerate(rng.integers(0, 256, (5, 9000)).astype(np.uint8).tobytes()[k * 9000 : k * 9000 + 9000] for k in range(5))]
    whole = W.compress_member(b"".join(noise))
    cut = whole[: len(whole) * 7 // 10]
    assert read(cut) == (["0", "1", "2"], [(0, len(cut))])
    broken = bytearray(whole)
    broken[len(whole) * 9 // 10] ^= 0xFF
    ids, gaps = read(bytes(broken) + after)
    assert ids[:3] == ["0", "1", "2"] and ids[-1] == "0" and gaps[0][0] == 0


def test_large_ids_among_nulls_lose_no_row(spark):
    import random

    rnd = random.Random(4)
    ids = [rnd.getrandbits(62) for _ in range(2000)] + [(1 << 60) + i for i in range(400)] + [-(1 << 62) + 1, None, None, None]
    docs = spark.createDataFrame([(i, f"text {k % 7}") for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(5)
    found = [r["doc_id"] for r in D.compare_with_next(docs).select("doc_id").collect()]
    assert sorted(found, key=repr) == sorted(ids, key=repr)
