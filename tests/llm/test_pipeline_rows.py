"""The pipeline on awkward rows, on an empty table and with further columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import GOOD, SCHEMA, awkward, empty


@pytest.fixture
def folder(spark, tmp_path):
    bench = spark.createDataFrame([(1, "seven maids with seven mops swept it for half a year do you suppose the walrus said")], "item_id bigint, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def run(spark, docs, folder):
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert found.columns == docs.columns
        docs = found
        kept.append(docs.count())
    return kept, docs, corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_awkward_rows(spark, folder):
    tainted = "seven maids with seven mops swept it for half a year do you suppose the walrus said " + GOOD
    near = GOOD * 3 + " and then some"
    docs = awkward(spark, [(30, tainted, "en", "s", 0), (31, GOOD * 3, "en", "s", 0), (32, near, "en", "s", 0), (33, "un autre texte en français avec des mots tout à fait différents et des accents éèê", "fr", "s", 0)])
    docs = docs.withColumn("score", F.lit(1)).withColumn("digest", F.lit("d")).withColumn("held_out", F.lit(None).cast("string"))
    kept, left, rows = run(spark, docs, folder)
    ids = [r["doc_id"] for r in left.collect()]
    assert 30 not in ids and 31 in ids and 32 not in ids and 33 in ids and None in ids
    assert not {1, 2, 3, 4} & set(ids)  # no letter, no language
    assert len(rows) == len(ids) and kept == sorted(kept, reverse=True)


def test_empty_table(spark, folder):
    kept, _, rows = run(spark, empty(spark), folder)
    assert kept == [0, 0, 0, 0] and rows == []


def test_rows_of_one_id_or_none_are_judged_by_their_own_text(spark, folder):
    other, third = "un autre texte en français avec des mots tout à fait différents", "drei kurze sätze stehen hier und keiner von ihnen kommt sonst vor"
    tainted = "seven maids with seven mops swept it for half a year do you suppose the walrus said so"
    rows = [(10, GOOD), (-3, GOOD), (20, GOOD), (20, other), (20, other), (None, GOOD), (None, third), (None, third), (7, tainted), (7, "a clean text of the same id as a tainted one"), (None, tainted)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], SCHEMA)
    found = corpus_pipeline.distinct_documents(spark, docs, folder)
    left = sorted((r["doc_id"] or 0, r["text"]) for r in found.collect())
    assert left == sorted([(-3, GOOD), (20, other), (0, third), rows[8], rows[9]])
    clean = corpus_pipeline.uncontaminated(spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in clean.collect()) == sorted((k or 0, t) for k, t in rows if t != tainted)
