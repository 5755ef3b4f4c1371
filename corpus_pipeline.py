"""A corpus pipeline: quality, language, near duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but
the last return the columns of ``documents``.  Between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor costs no earlier stage.

Near duplicates and contaminated rows are rejected by a key of the row, made of its id and text, so rows
that share an id, or have none, are judged each by its own text; of rows equal in both one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorweave.llm import decontaminate, langid, near_dups, quality, sentencepiece_codec
from sensorweave.llm._shared import small_side, stored

PIECE_MODEL = "piece_bpe_32k.model"


ROW = "_row_key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with their key: the id as digits that sort as it does, nulls last, and a digest of the text."""
    digits = F.lpad(F.hex(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return docs.withColumn(ROW, F.concat(F.coalesce(digits, F.lit("null")), F.lit(" "), F.coalesce(F.md5("text"), F.lit("null"))))


def _without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose key is not among the rejected ones; those are broadcast only if few."""
    return rows.join(small_side(stored(rejected.select(ROW).distinct(), "rejected")), ROW, "left_anti").select(rows.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones, accepts."""
    return quality.keep_good(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter go."""
    return langid.keep_identified(docs, langid.fit_language(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): the one of the smallest id."""
    rows = _keyed(docs)
    found = stored(near_dups.near_duplicates(rows, key=ROW, words=5, similarity=0.8), "near-dups-found")
    rows = _without(rows, found.where("not kept"))
    repeated = small_side(stored(found.where("kept").groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW), "repeated"))
    once = rows.join(repeated, ROW, "left_semi").dropDuplicates([ROW])
    return rows.join(repeated, ROW, "left_anti").unionByName(once).select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    rows = _keyed(docs)
    found = decontaminate.contamination(rows, _table(spark, sf_dir, "benchmark"), key=ROW)
    return _without(rows, found.where("contaminated")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each document."""
    return sentencepiece_codec.token_digests(docs, sentencepiece_codec.PieceModel.load(public_tokenizers.path(PIECE_MODEL)))


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated),
    ("sentencepiece", tokens),
]

#: Models are fitted in the first two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
