"""Token counts at every prefix against the library, and what stored counts answer."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorweave.llm import token_counts as tc
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "é", "日", "²", "<|endoftext|>", "<|endof", "1", "42", "!", "? ", "՘", "\U00010940", "the", "ing", "　", "'v", "\x1c", "😀", "​", "ſ", "\x85", "_", "½"]


@pytest.fixture(scope="module")
def vocabulary():
    return tc.ByteVocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    return lambda text: len(found.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("block", [tc.BLOCK_CHARS, 5])
def test_every_prefix_as_the_library_has_it(vocabulary, library, monkeypatch, block):
    monkeypatch.setattr(tc, "BLOCK_CHARS", block)
    counter, rnd = vocabulary.ready(), random.Random(block)
    for _ in range(1500):
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 14)))
        assert counter.counts(text).tolist() == [library(text[: k + 1]) for k in range(len(text))], repr(text)


@pytest.mark.parametrize("text", ["a" * 3000, "-" * 5000, " " * 3000, "ÃÂ" * 700, "x1" * 2000, "\n \n" * 900])
def test_long_runs(vocabulary, library, text):
    counts = vocabulary.ready().counts(text)
    assert all(counts[k] == library(text[: k + 1]) for k in [*range(0, len(text), 331), len(text) - 1])


def test_rows(spark, vocabulary, library):
    docs = awkward(spark, [(8, "stop <|endoftext|> go", "en", "s", 0)])
    found = tc.token_counts(docs, vocabulary, limit=100)
    given = sorted(docs.select("doc_id", "text").collect(), key=repr)
    rows = sorted(found.collect(), key=repr)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"] and len(rows) == len(given)
    want = sorted((i, len((t or "").encode()), library(t or ""), library(t or "") > 100) for i, t in given if i is not None)
    assert sorted(tuple(r)[:4] for r in rows if r[0] is not None) == want
    texts = {i: t or "" for i, t in given}
    for r in rows:
        text = texts[r["doc_id"]]
        assert library(text[: r["fit_chars"]]) <= 100
        assert all(library(text[:k]) > 100 for k in range(r["fit_chars"] + 1, min(len(text), r["fit_chars"] + 60) + 1))
    assert tc.token_counts(empty(spark), vocabulary).count() == 0


def test_stored_counts_answer_without_the_text(spark, vocabulary, library):
    docs = awkward(spark)
    counted = tc.prefix_counts(docs, vocabulary).drop("text").withColumn("n_tokens_", F.lit(1))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for chars in (0, 1, 7, 50_000_000):
        for r in counted.select("doc_id", tc.tokens_of_prefix(F.lit(chars)).alias("n")).collect():
            assert r["n"] == library(texts[r["doc_id"]][:chars])
    for r in tc.budget_questions(counted, 9).collect():
        text = texts[r["doc_id"]]
        assert r["n_tokens"] == library(text) and r["over_limit"] == (library(text) > 9)
        assert (r["window_ends"] or [0])[-1] == len(text) and library(text[: r["fit_chars"]]) <= 9
    for r in tc.truncated(docs, vocabulary, 9).collect():
        assert r["text"] is None or texts[r["doc_id"]].startswith(r["text"]) and library(r["text"]) <= 9


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.ByteVocabulary.load(public_tokenizers.path("word_bpe_49k.json"))
