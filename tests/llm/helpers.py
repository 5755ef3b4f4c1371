"""Small document tables with the awkward cases."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "the quick brown fox jumps over the lazy dog near the river bank while children sing songs in the park and birds fly"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def awkward(spark, more=()):
    """Null key, null, empty, blank, punctuation-only and very long texts, repeated rows, and ``more``."""
    rows = [(None, "a null key with some words", "en", None, 0), (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 4), (4, "!!! ... ???", "en", "s", 11), (5, GOOD, "en", "s", len(GOOD)), (5, GOOD, "en", "s", len(GOOD)), (6, (GOOD + " ") * 800, "en", "s", 0), (7, "x" * 60_000, "en", "s", 0), *more]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
