import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorweave.llm import sentencepiece_codec as S
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = S.PieceModel.load(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_any_text(text):
    ids = MODEL.encode([text])[0]
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_mixed_alphabets_and_runs():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(" \n\tabcdetheringou▁éñ日本𓀀\x00.,!|*=-") for _ in range(rng.randint(0, 30)))
        text = " " * rng.randint(0, 20) + text + rng.choice(["a", "=", "0", " "]) * rng.randint(0, 40)
        assert MODEL.encode([text])[0] == LIBRARY.encode(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000, "=-" * 4_000, "thering" * 3_000, "x \n" * 3_000])
def test_long_runs(text):
    assert MODEL.encode([text])[0] == LIBRARY.encode(text)


def test_any_ids():
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.randint(0, 31_999) if rng.random() < 0.6 else rng.randint(0, 258) for _ in range(rng.randint(0, 12))]
        assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_digests(spark):
    df = awkward(spark, [(8, "▁ is white space\nhere 𓀀", "en", "s", 0)])
    text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    rows = S.token_digests(df, MODEL).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = LIBRARY.encode(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert S.token_digests(empty(spark), MODEL).count() == 0


def test_columns_stay_and_clashing_ones_go(spark):
    df = awkward(spark).withColumnRenamed("source", "ids")
    both = S.decode_column(S.encode_column(df, MODEL), MODEL)
    assert both.columns == ["doc_id", "text", "lang", "n_chars", "ids", "decoded"]
    for r in both.collect():
        assert r["ids"] == LIBRARY.encode(r["text"] or "") and r["decoded"] == LIBRARY.decode(r["ids"])
