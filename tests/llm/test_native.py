"""License scans, URL rules, decontamination, against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sensorweave.llm import decontaminate, licenses, url_rules
from tests.llm.helpers import SCHEMA, awkward, empty, words


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# -- licenses


LINES = ["Under the MIT License", "under the mit  license!", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "cc by nc", "CC BY-NC-SA 3.0", "GNU General Public License, version 3", "under the mit licenses", "apache license version 21"]


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice([*LINES, "mit", "license", "words here", "\n"]) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    df = awkward(spark, [(100 + i, t, "de", "s", 0) for i, t in enumerate(texts)])
    found = licenses.scan(df)
    no_python(found)
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        have, starts, names = words(text[r["doc_id"]]), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(have) - len(p) + 1) if have[i] == p[0] and have[i : i + len(p)] == p]
            starts += at
            names |= {label} if at else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(have), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)))
        assert names <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(empty(spark)).count() == 0


LABELLED = [
    ("GNU General Public License, version 3 or later", "gpl-3-or-later"), ("under the GNU Lesser General Public License v2.1", "lgpl-2-1"), ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4-0"), ("SPDX-License-Identifier: MIT", "mit"), ("3-clause BSD license", "bsd-3-clause"), ("PHP License version 3.01", "php-3-01"), ("PHP License version 3.0", "php-3"), ("GPL v2", "gpl-2"), ("GPLv3", "gpl-3"), ("EUPL v1.2", "eupl-1-2"), ("licensed under the EUPL", "eupl"),
    ("You may not use this file except in compliance with the License.", "apache-2"), ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"), ("nothing of the kind", ""),
    ("License: MIT", "mit"), ("Apache-2.0", "apache-2"), ("Apache 2.0 license", "apache-2"), ("licensed under Apache 2.0", "apache-2"), ("https://opensource.org/licenses/MIT", "mit"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4-0"),
    ("GPL-2.0-or-later", "gpl-2-or-later"), ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2-or-later"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2-1-only"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("gpl 1 reason to go", ""), ("mpl 2 go", ""), ("the Apache 2.0 server", ""), ("licensed under GPL 2", "gpl-2"), ("GPLv2 only", "gpl-2-only"), ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl-3"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2-or-later"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl-2-1-or-later"),
    ("under the terms of version 2 of the GNU General Public License", "gpl-2"), ("released under the MIT", "mit"), ("MIT people met", "")
]


def test_rules_and_suppression(spark):
    found = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LABELLED)], "doc_id int, text string")).collect()
    assert [(LABELLED[r["doc_id"]][0], r["labels"]) for r in found] == LABELLED
    assert len(licenses.build_rules()) > 300


def test_suppression_against_brute_force(spark):
    rules = [licenses.Rule("a", "x", "x y", 10, 0.5), licenses.Rule("b", "x", "x y z", 10, 0.6), licenses.Rule("c", "y", "y", 20, 0.7), licenses.Rule("d", "y", "w y", 10, 0.4), licenses.Rule("e", "z", "z", 10, 0.3), licenses.Rule("f", "z", "z", 10, 0.2), licenses.Rule("base", "x", "x", 0, 0.9, True)]
    rng = random.Random(4)
    texts = [" ".join(rng.choice("xyzw") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    found = licenses.detections(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", rules).collect()
    for row in found:
        have, every = texts[row["id"]].split(), []
        for r in rules:
            p, i = r.pattern.split(), 0
            while i <= len(have) - len(p):  # matches of one rule do not overlap
                if have[i : i + len(p)] == p:
                    every.append((r.label, i, i + len(p), r.priority, r.base))
                    i += len(p) - 1
                i += 1
        kept = {x[:3] for x in every if x[4] or not any(y[1] <= x[1] and y[2] >= x[2] and (y[3] > x[3] or (y[3] == x[3] and y[2] - y[1] > x[2] - x[1])) for y in every)}
        assert {(d["label"], d["a"], d["b"]) for d in row["found"]} == kept


# -- URLs


def test_hosts_paths_and_rules(spark):
    urls = {
        None: ("", "", None), "no scheme": ("", "", None), "x://ORG": ("org", "", None), "http://a.ORG/x?y#z": ("a.org", "/x", "org/"), "https://m.Example.org/es/1": ("m.example.org", "/es/1", "example.org/es/"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1"), "https://example.org/en/27": ("example.org", "/en/27", "org/"), "http://a.com/fr/": ("a.com", "/fr/", "com/fr/"), "http://acom/fr/": ("acom", "/fr/", None), "a://b://c.org/x": ("b:", "//c.org/x", None), "http://q.com?/de/": ("q.com", "", None), "http://q.com/de/#x": ("q.com", "/de/", "com/de/"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    found = url_rules.judge(df)
    verdict = {r.name: r.verdict for r in url_rules.RULES}
    for r in found.collect():
        host, path, rule = list(urls.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert rule is None or r["verdict"] == verdict[rule]
    assert url_rules.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_mined_rules_block_what_they_saw(spark):
    rows = [(i, f"http://spam-farm{i % 2}.com/{'de' if i % 3 else 'xx'}/{i}?ref=a") for i in range(120)] + [(500 + i, f"http://good{i % 5}.com/fr/{i}") for i in range(120)]
    long = "http://good1.net/" + "p/" * 5_000
    df = spark.createDataFrame([*rows, (900, "http://spam-farm1.net/de/7"), (901, "http://good1.net/en/7"), (901, "http://good1.net/en/7"), (902, long)], "page_id int, url string")
    found = url_rules.judge(df)
    no_python(found)
    got = {r["page_id"]: r["verdict"] for r in found.collect()}
    fixed = {r["page_id"]: r["rule"] for r in found.collect()}
    assert fixed[900] is None and fixed[1] == "com/de/"  # the mined rule blocks what no fixed rule reaches
    assert got[900] == "block" and got[901] == "allow" and got[0] == "block" and found.count() == df.count()


# -- decontamination


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [str(item)])
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (m := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= m
        out[key, text] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "small_side", lambda df: df)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ñandú", "été"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(13, 30)))) for i in range(12)] + [(50, "two words"), (51, "w1"), (52, ""), (53, None), (54, "a b c d e f g"), (None, "no id has this"), (55, items_text := " ".join(some(14))), (56, items_text)]
    docs = []
    for i in range(60):
        w = some(rng.randint(0, 80))
        if i % 2:
            source = words(rng.choice(items[:12])[1])
            a = rng.randrange(len(source))
            w[10:10] = source[a : a + rng.randint(10, 16)]
        if i % 7 == 0:
            w += ["two", "words"]
        docs.append((100 + i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(300, items_text), (301, "a b c d e f g")]
    docs += [(None, items_text), (400, "no id has this"), (300, "another text of that id"), (300, "the same two words")]
    df = awkward(spark, [(k, t, "en", "s", 0) for k, t in docs]).withColumn("words", F.lit(1)).withColumn("prints", F.lit(2)).withColumn("doc", F.lit(3)).withColumn("key", F.lit(4))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(df, bench)
    no_python(found)
    pairs = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(pairs, items)
    text = lambda x: tuple(map(str, x))
    assert sorted(map(text, found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())) == sorted(text((k, *want[k, t])) for k, t in pairs)
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    none = decontaminate.contamination(df, bench.where("false"))
    assert none.agg(F.sum("n_hit")).first()[0] == 0 and none.count() == df.count()
    assert SCHEMA
