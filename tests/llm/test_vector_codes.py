"""Vector codes against plain assignment, and the search against all distances."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from sensorweave.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"
LONG = (1 << 63) - 1


def brute(rows):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), label) for i, v, label in kept]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:256]
    books = [[first[i][p * width : (p + 1) * width] for i in ids] for p in range(4)]

    def near(v, p):
        return min((sum((s - t) ** 2 for s, t in zip(v[p * width : (p + 1) * width], c)), j) for j, c in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[near(v, p)[1]].append(v[p * width : (p + 1) * width])
            for j, xs in held.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    by_label, found = defaultdict(int), []
    for i, v, label in kept:
        best = [near(v, p) for p in range(4)]
        found.append((i, "".join(f"{j:02x}" for _, j in best), min(LONG, sum(d for d, _ in best)), label))
        by_label[label] += found[-1][2]
    told = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, error, min(LONG, by_label[label]), told) for i, code, error, label in found), key=repr)


def coded(spark, rows, schema=SCHEMA):
    found = vc.product_codes(spark.createDataFrame(rows, schema))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def single(rows):
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("n, entries, width", [(500, 256, 16), (300, 7, 3), (50, 1, 1), (900, 256, 1)])
@pytest.mark.parametrize("kind", [float, object])
def test_search_finds_the_nearest_entry_of_the_lowest_index(n, entries, width, kind):
    r = np.random.default_rng(n)
    x, e = (r.integers(-9, 9, (k, width)).astype(np.int64).astype(kind) for k in (n, entries))
    index, distance = vc.nearest(x, e, r.integers(0, entries, n))
    gaps = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (index == gaps.astype(float).argmin(1)).all() and (distance == gaps.min(1)).all()


def test_awkward_rows(spark):
    rnd = random.Random(3)

    def vector(n=8):
        return [rnd.choice([0.5, -0.25, 0.125, 1.0, rnd.random()]) for _ in range(n)]

    rows = [(rnd.choice([None, *range(400)]), vector(), rnd.choice([None, 1, 2])) for _ in range(600)]
    rows += [(1, None, 1), (2, [None] * 8, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, None), (900, [0.5], 2), (901, [], None), (902, vector(7), 1), (5, rows[0][1], 1), (5, rows[0][1], 1)]
    assert coded(spark, rows) == brute(single(rows))


@pytest.mark.parametrize("rows", [[], [(1, [], 1)], [(None, [0.1, 0.2, 0.3, 0.4], None)] * 3, [(i, [(-1) ** i * 1e38, 3e38, 1e20 * i, 1.0], i % 2) for i in range(300)]])
def test_few_equal_and_huge_vectors(spark, rows):
    assert coded(spark, rows) == brute(single(rows))


def test_other_columns_with_clashing_names(spark):
    rows = [(i, [0.1 * i, 0.2, -0.3, 0.4], 1, "x", "y") for i in range(5)]
    assert coded(spark, rows, SCHEMA + ", code string, parts string") == brute(single([r[:3] for r in rows]))
