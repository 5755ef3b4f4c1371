import random

import numpy as np
import pytest

from sensorweave.llm import near_dups as N
from sensorweave.llm.components import connected_components
from tests.llm.helpers import SCHEMA, awkward, empty


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, n, percent):
    sets = {}
    for key, text in rows:
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def make(rng, groups, size):
    rows, key = [], 0
    shared = [f"s{i}" for i in range(30)]
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 140))]
        if g % 2:
            base = shared + base
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
            rows.append((key, " ".join(words)))
            key += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "similarity", "seed"), [(3, 0.85, 1), (5, 0.8, 2)])
def test_against_brute_force(spark, words, similarity, seed):
    rows = make(random.Random(seed), 12, 9)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA)
    found = {r["doc_id"]: r for r in N.near_duplicates(df, words=words, similarity=similarity).collect()}
    sets, want = brute(rows, words, round(similarity * 100))
    assert {k: r["component_id"] for k, r in found.items()} == want
    assert all(found[k]["n_shingles"] == len(s) and found[k]["kept"] == (want[k] == k) for k, s in sets.items())


def test_awkward(spark):
    df = awkward(spark, [(20, "One two", "en", "s", 0), (21, "one  TWO", "en", "s", 0), (22, "one", "en", "s", 0), (23, "a b c", "en", "s", 0), (24, "a b c a b c", "en", "s", 0)]).withColumnRenamed("lang", "digest")
    rows = N.near_duplicates(df, words=3, similarity=0.85).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert all(by[i]["component_id"] == i and by[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert by[21]["component_id"] == 20 and by[20]["n_shingles"] == 1 and by[22]["component_id"] == 22
    assert by[24]["component_id"] == 24 and N.near_duplicates(empty(spark)).count() == 0


def test_every_pair_within_the_distance_meets():
    rng = np.random.default_rng(3)
    chunks = N.chunk_count(0.85)
    most = 2 * chunks - 1
    for _ in range(200):
        wrong = rng.choice(chunks * N.CHUNK, most, replace=False)
        errors = np.bincount(wrong // N.CHUNK, minlength=chunks)
        assert errors.min() <= 1


def test_components(spark, monkeypatch):
    rng = random.Random(9)
    for n, m in ((40, 30), (30, 29)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n == 40 else [(i, i + 1) for i in range(n - 1)]
        df = spark.createDataFrame(links, "a int, b int")
        found = {r["node"]: r["component"] for r in connected_components(df).collect()}
        monkeypatch.setattr("sensorweave.llm.components.BROADCAST_BYTES", 0)
        assert found == {r["node"]: r["component"] for r in connected_components(df).collect()}  # the same by shuffling
        monkeypatch.undo()
        want = components(range(n), links)
        assert found == {k: want[k] for k in found} and set(found) == {x for a, b in links if a != b for x in (a, b)}


def test_slightly_changed_copies_are_not_paired_with_each_other(spark, monkeypatch):
    rng, pairs = random.Random(4), []
    base = [f"w{i}" for i in range(150)]
    rows = []
    for key in range(240):  # each with 2 to 9 words of its own, so that those with many are linked with none
        words = list(base)
        for at in rng.sample(range(150), rng.choice([2, 2, 3, 4, 5, 7, 9])):
            words[at] = f"e{rng.randrange(10**9)}"
        rows.append((key, " ".join(words), "en", "s", 0))
    near = N._near_signatures
    monkeypatch.setattr(N, "_near_signatures", lambda found, *a: pairs.append(found.count()) or near(found, *a))
    found = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=3, similarity=0.85).collect()}
    assert found == brute([r[:2] for r in rows], 3, 85)[1]
    assert len(set(found.values())) > 60 and pairs[-1] < 5 * len(rows)
