"""Mined URL rules against all sets of up to three tokens, and rows of very many common tokens."""

import itertools
import math
import random
import time

import pytest

from sensorweave.llm import url_rules


def brute(rows, min_support, min_confidence):
    rows = [(frozenset(t), v) for t, v in rows if t]
    least, found = math.ceil(min_support * len(rows)), {}
    tokens = sorted({t for s, _ in rows for t in s})
    for size in (1, 2, 3):
        for some in itertools.combinations(tokens, size):
            have = [v for s, v in rows if s.issuperset(some)]
            hits = have.count("block")
            if hits >= max(least, 1) and hits / len(have) >= min_confidence and not any(p in found for k in range(1, size) for p in itertools.combinations(some, k)):
                found[some] = (hits / len(have), hits / len(rows))
    return found


def mined(spark, rows, *bars):
    df = spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string")
    found = url_rules.mine(df, *bars).collect()
    count = lambda t: sum(t in s for s, _ in rows)
    assert all(r["token"] == min(r["antecedent"], key=lambda t: (count(t), t)) for r in found)
    assert len({tuple(r["antecedent"]) for r in found}) == len(found)
    return {tuple(r["antecedent"]): (r["confidence"], r["support"]) for r in found}


@pytest.mark.parametrize("long", [10, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_rules_of_up_to_three_tokens(spark, monkeypatch, seed, long):
    monkeypatch.setattr(url_rules, "LONG", long)
    rng, rows = random.Random(seed), []
    for _ in range(160):
        tokens = {t for t in "abcdefgh" if rng.random() < 0.35} | ({"x", "y|z", "w"} if rng.random() < 0.4 else set())
        bad = {"a", "b"} <= tokens or {"c", "x", "d"} <= tokens or "h" in tokens
        rows.append((sorted(tokens), "block" if bad and rng.random() < 0.97 else "allow"))
    found, want = mined(spark, rows, 0.02, 0.85), brute(rows, 0.02, 0.85)
    assert found.keys() == want.keys() and {len(k) for k in want} == {1, 2, 3}
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_nothing_to_mine(spark):
    assert mined(spark, [], 0.1, 0.9) == {} and mined(spark, [(["a"], "allow"), ([], "block")], 0.1, 0.9) == {}
    assert mined(spark, [(["a", "b"], "block")] * 3, 0.1, 0.9) == {("a",): (1.0, 1.0), ("b",): (1.0, 1.0)}


def test_many_common_tokens_take_no_longer(spark):
    rng = random.Random(3)

    def rows(n):
        template = [f"path:p{i}" for i in range(n)]
        return [(template + ["host:bad"] * (i % 4 == 0) + [f"host:h{i % 50}"], "block" if i % 4 == 0 or rng.random() < 0.02 else "allow") for i in range(2000)]

    took = []
    for n in (4, 40, 40):
        began = time.perf_counter()
        found = mined(spark, rows(n), 0.002, 0.9)
        took.append(time.perf_counter() - began)
        assert ("host:bad",) in found
    assert took[2] < 3 * took[0] + 5
