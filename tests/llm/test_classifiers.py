"""Toxicity, quality and language: what they learn, held-out accuracy, awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorweave.llm import langid, quality, toxicity
from sensorweave.llm.queries import table
from tests.llm.helpers import GOOD, awkward, empty

MEDIUM = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_folding():
    assert toxicity.fold_text("IDІОT clоwn l0ser p@thetic $cum ｍｏｒｏｎ") == toxicity.fold_text("idiot clown loser pathetic scum moron")
    assert toxicity.fold_text("mo\u200bron") == toxicity.fold_text("moron") and toxicity.fold_text(None) == ""


def test_lexicon_matches_whole_words_outside_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold_text("clown"): 2.0}, (toxicity.fold_text("clown fish"),))
    measure = lambda t: lexicon.measure(t)[:2]
    assert measure("A CLOWN, a c1own; clownish") == (4.0, 2)
    assert measure("a clown fish") == (0, 0) and measure("clown fish and clown") == (2.0, 1)
    assert measure(None) == (0, 0)


def test_toxicity_learns_terms_not_copies(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(300)]
    some = lambda: " ".join(rng.choice(vocabulary, 40))
    copied = "only these copies hold strange syllables " + some()
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = some() + (" grobnik " + some() if bad else "")
        rows.append((i, copied if i % 50 == 1 else text, "en", "s", 0))
        marks.append((i, 1, int(bad or i % 50 == 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lexicon = toxicity.fit_lexicon(docs, labels(spark, marks))
    assert set(lexicon.weights) == {"grobnik"}
    found = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert all(found[i]["predicted"] == int(i % 6 == 0) for i in range(600) if i % 50 != 1)


def test_toxicity_held_out(spark):
    docs, marks = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    found = toxicity.score(docs, toxicity.fit_lexicon(docs, marks)).join(marks, "doc_id").where("held_out")
    found = found.toPandas()
    right, usual = (found["predicted"] == found["toxic"]).mean(), 1 - found["toxic"].mean()
    assert right >= usual + (1 - usual) / 3  # a third of what always-0 gets wrong, at least
    assert found.loc[found["predicted"] == 1, "toxic"].mean() >= 0.9
    order = found["score"].rank()
    n1 = found["toxic"].sum()
    auc = (order[found["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(found) - n1))
    assert auc >= 0.8


def test_matcher_against_brute_force():
    rng = np.random.default_rng(5)
    terms, phrases = {"ab": 1.0, "abc": 2.0, "c": 0.5, "b a": 3.0}, ("c ab", "abc abc")
    lexicon = toxicity.Lexicon(terms, phrases)
    for _ in range(300):
        text = "".join(rng.choice(list("abc  -"), int(rng.integers(0, 30))))

        def places(x, text=text):
            at = [i for i in range(len(text)) if text.startswith(x, i)]
            return [(i, i + len(x)) for i in at if not (i and text[i - 1].isalnum()) and not (i + len(x) < len(text) and text[i + len(x)].isalnum())]

        excused = [p for x in phrases for p in places(x)]
        want = sorted((a, b, w) for x, w in terms.items() for a, b in places(x) if not any(s <= a and b <= e for s, e in excused))
        assert sorted(lexicon.spans(text)) == want


def test_quality_held_out(spark):
    docs, marks = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    found = quality.score(docs, quality.fit_quality(docs, marks)).join(marks, "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.95
    assert found.loc[found["quality"] == 1, "predicted"].mean() >= 0.97


def test_quality_gradient_direction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.QualityModel(None, None, np.zeros(6), np.ones(6), quality._train(x, y))
    assert ((model.logits(x) > 0) == (y > 0)).mean() > 0.9


@pytest.mark.parametrize("module", ["toxicity", "quality"])
def test_awkward_rows_and_no_labels(spark, module):
    df = awkward(spark)
    if module == "toxicity":
        model, score = toxicity.fit_lexicon(df, labels(spark)), toxicity.score
    else:
        model, score = quality.fit_quality(df, labels(spark)), quality.score
    rows = score(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] in (True, False) for r in rows)
    assert score(empty(spark), model).count() == 0


def test_quality_keeps_columns(spark):
    df = awkward(spark).withColumn("score", F.lit("mine"))
    model = quality.fit_quality(df, labels(spark))
    assert quality.keep_good(df, model).columns == df.columns


def brute_marginals(evidence, start, move):
    import itertools

    n, k = evidence.shape
    total, sums = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(evidence[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, s in enumerate(path):
            sums[t, s] += w
    return sums / total, np.log(total)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(4)
    start, move = rng.normal(size=3), rng.normal(size=(3, 3))
    lengths = [1, 4, 6]
    evidence = rng.normal(size=(6, 3, 3))
    inside = np.arange(6)[:, None] < np.array(lengths)
    gamma, _, total = langid._marginals(evidence, inside, start, move)
    for c, n in enumerate(lengths):
        want, log_sum = brute_marginals(evidence[:n, c], start, move)
        assert np.allclose(gamma[:n, c], want) and np.isclose(total[c], log_sum)


def test_language_held_out_and_code_switching(spark):
    docs = table(spark, MEDIUM, "documents")
    model = langid.fit_language(docs, max_rows=400)
    found = langid.identify(docs, model).withColumnRenamed("score", "s").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() >= 0.98
    parts = {lang: docs.where((F.col("lang") == lang) & (F.col("n_chars") > 300)).first()["text"].split()[:25] for lang in ("en", "de")}
    gamma, _ = model.word_marginals([" ".join(parts["en"] + parts["de"])])
    guess = [model.labels[k] for k in gamma.argmax(1)]
    assert guess[:15].count("en") >= 13 and guess[-15:].count("de") >= 13


def test_fitting_does_not_depend_on_the_block(spark, monkeypatch):
    docs = table(spark, MEDIUM, "documents").where("n_chars < 4000")
    whole = langid.fit_language(docs, max_rows=60, rounds=4)
    monkeypatch.setattr(langid, "BLOCK", 7)
    parts = langid.fit_language(docs, max_rows=60, rounds=4)
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.move, parts.move) and np.allclose(whole.start, parts.start)


def test_language_awkward(spark):
    df = awkward(spark, [(8, "1234 !!", "en", "s", 0), (9, "😀😀", "en", "s", 0)])
    model = langid.fit_language(df)
    rows = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 4, 8, 9))
    assert rows[5]["lang_pred"] == rows[7]["lang_pred"] == "en"
    none = langid.fit_language(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0 and GOOD


def test_a_language_of_very_many_rows_is_sampled(spark):
    df = spark.range(8_000_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"))
    sample = langid._sample(df, "doc_id", "text", "lang", 5)
    try:
        assert 1 <= sample.count() <= 5
    finally:
        sample.unpersist()


def test_a_repeated_key_is_one_row_of_a_sample(spark):
    from sensorweave.llm._labels import labelled_sample

    many = spark.range(100_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = many.unionByName(spark.createDataFrame([(2, "a", "fr"), (3, None, "de")], "doc_id bigint, text string, lang string"))
    marks = labels(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 1), (1, 0, 0)])
    rows = {r["doc_id"]: (r["text"], r["quality"]) for r in labelled_sample(docs, marks, "quality", 5, remainder=9).collect()}
    assert rows == {1: ("text 0", 1), 2: ("a", 0), 3: ("", 1)}
    found = langid._sample(docs, "doc_id", "text", "lang", 10).collect()
    assert len(found) == len({r["doc_id"] for r in found})
