"""Repaired conversations against a search over all edits, and conversations that go on over many pieces."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from sensorweave.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def spaced(x):
    return " " if x is None else str(x)


def after(last, initial):
    allowed = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.get(initial, ())
    return initial if last in allowed else None


def cheapest(turns, faults):
    """Least (cost, audit) by Dijkstra's search, with the repaired turns."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, said = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if after(last, role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*said, f"{role}:")))
        if i == len(turns):
            continue
        _, role, text = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, said))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 3 if faults[i] == "truncated" else 0
        if after(last, role[:1]):
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*said, f"{role}:{text}")))
        for other in ("user", "assistant"):
            if after(last, other[0]):
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, other[0], (*said, f"{other}:{text}")))


def brute(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spaced(role), {1: "", 2: re.sub("[.!?]", "", spaced(text))}.get(kind, spaced(text))
        conversations[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in conversations.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in turns:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        places, initials = [t for t, _, _ in turns if t is not None], [r[:1] for _, r, _ in turns]
        gaps = max(places) - min(places) + 1 - len(set(places)) if places else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *cheapest(turns, faults))
    return out


def repaired(spark, rows):
    found = cr.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r)[1:] for r in found}


ROLES = ["user", "assistant", "system", "tool", "", None, "usher"]
TEXTS = ["a.", "b!", "c", "  ", "", None, "hello there.", "x? "]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, *range(12)]), rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(600)]
    assert repaired(spark, rows) == brute(rows)


def test_one_conversation_over_many_pieces(spark):
    rnd = random.Random(5)
    rows = [(7, i, rnd.choice(["user", "assistant", "tool"]), rnd.choice([f"q{i}.", "same.", f"c{i}"])) for i in range(2000)] + [(i, j, "user" if j % 2 else "assistant", f"t{j}.") for i in range(300, 320) for j in range(6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_are_counted_before_they_are_shuffled(spark):
    rows = [(1, 1, "user", "again and again.")] * 500 + [(1, 2, "assistant", "yes.")]
    assert repaired(spark, rows) == brute(rows)


def test_edges(spark):
    assert repaired(spark, []) == {}
    dropped = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone.")]
    assert repaired(spark, rows) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    many = spark.createDataFrame([("x", 1, "user", "hi. " * 50_000, 9)], "conv_id string, turn int, role string, text string, copies int")
    assert cr.damaged_and_repaired(many).first()["conv_id"] == "x"
