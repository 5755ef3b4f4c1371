"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of ``GRAMS`` consecutive k-grams the smallest hash is kept.  A span of ``window``
words shared by a document and an item holds the same k-grams, hence the same kept hash, so every such
span is found: training and test fingerprints are joined, and only documents with a common fingerprint
go on.  There each hit is extended: the windows that hold the fingerprint are compared word by word
with the items' windows, and the words of matching windows are counted once.

Items shorter than a window are one window of their own length; the hashes of the documents' word
sequences of all such lengths are looked up together, in one more pass over the documents.

Hits belong to a text, not to a key, so rows are judged each by its own text, whatever their keys.

Defined results: null and wordless texts have no words and no hits; items without words are ignored;
equal item ids count once; windows of items with a null id are hits, but such items are neither counted
nor named; rows with a null key and repeated rows are judged like any other; other columns may have any
name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._shared import Tables, small_side

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: k-grams of six words, eight in a window: together a window of thirteen words.
GRAM = 6
GRAMS = WINDOW - GRAM + 1
#: Tasks that copies of one text are dealt to where the texts with hits are too many for a broadcast.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> Column:
    """The text with A-Z in lower case; the empty text for null."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def words(text: str) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(lowered(text), F.lit(f"({WORD})"), F.lit(1))


def _later(column: Column, by: int) -> Column:
    """The array from its place ``by`` on; empty if it is not longer than that."""
    return F.slice(column, by + 1, F.greatest(F.size(column) - by, F.lit(0)))


def _joined(column: Column, by: int) -> Column:
    """Hash of each entry with the one ``by`` places on."""
    n = F.greatest(F.size(column) - by, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), _later(column, by), lambda a, b: F.xxhash64(a, b))


def _smaller(column: Column, by: int) -> Column:
    n = F.greatest(F.size(column) - by, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), _later(column, by), lambda a, b: F.least(a, b))


def winnowed(df: DataFrame, words_column: str = "words") -> DataFrame:
    """Adds ``kept``: by place, the smallest k-gram hash of each window; texts under a window have none.

    Hashes of 2, 4 and then 6 words, and smallest values of 2, 4 and then 8 hashes, are each made
    from two arrays of the step before.
    """
    df = df.withColumn("_1", F.transform(F.col(words_column), lambda w: F.xxhash64(w)))
    df = df.withColumn("_2", _joined(F.col("_1"), 1)).withColumn("_4", _joined(F.col("_2"), 2))
    n = F.greatest(F.size("_4") - 2, F.lit(0))
    last_two = F.slice(_later(F.col("_2"), 4), 1, n)
    df = df.withColumn("_6", F.zip_with(F.slice("_4", 1, n), last_two, lambda a, b: F.xxhash64(a, b)))
    for by in (1, 2, 4):
        df = df.withColumn("_6", _smaller(F.col("_6"), by))
    return df.withColumn("kept", F.col("_6")).drop("_1", "_2", "_4", "_6")


def _span(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start + 1, length), " ")


def _windows(items: DataFrame) -> DataFrame:
    """(item, length, span) of the distinct windows of items: their words in one string."""
    length = F.least(F.size("words"), F.lit(WINDOW))
    at = items.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start"))
    return at.select("item", "length", _span(F.col("start"), F.col("length")).alias("span")).distinct()


def _sequences(length: int) -> Column:
    """(length, start, print) of every sequence of ``length`` of the hashes in ``_1``."""
    found = F.col("_1")
    for by in range(1, length):
        later, n = _later(F.col("_1"), by), F.greatest(F.size("_1") - by, F.lit(0))
        found = F.zip_with(F.slice(found, 1, n), later, lambda a, b: F.xxhash64(a, b))
    return F.transform(found, lambda h, i: F.struct(F.lit(length).alias("length"), i.alias("start"), h.alias("print")))


def _short_hits(tables: Tables, docs: DataFrame, short: DataFrame) -> DataFrame:
    """(doc, start, length, span) of the short windows (length, span) that stand in ``docs``.

    Hashes alone are looked up; the words of a text are compared in a second pass over the texts with a like hash.
    """
    lengths = [r["length"] for r in short.select("length").distinct().orderBy("length").collect()]  # at most WINDOW - 1
    if not lengths:
        return docs.select("doc", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("span")).where("false")
    hashed = short.select("span", F.transform(F.split("span", " "), lambda w: F.xxhash64(w)).alias("_1"))
    asked = hashed.select("span", F.explode(F.concat(*[F.slice(_sequences(n), 1, 1) for n in lengths])).alias("x")).where(F.col("x.length") == F.size(F.split("span", " "))).select("span", "x.length", "x.print")
    own = docs.select("doc", F.transform(words("text"), lambda w: F.xxhash64(w)).alias("_1"))
    places = own.select("doc", F.explode(F.concat(*[_sequences(n) for n in lengths])).alias("x")).select("doc", "x.*")
    alike = tables.add(places.join(small_side(asked), ["length", "print"]).select("doc", "start", "length", "span").distinct())
    asked_of = alike.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "span")).alias("at"))
    texts = docs.join(small_side(asked_of), "doc").select("doc", words("text").alias("words"), "at")
    equal = F.filter("at", lambda x: F.array_join(F.slice("words", x["start"] + 1, x["length"]), " ") == x["span"])
    return texts.select("doc", F.inline(equal)).distinct()


def find_hits(tables: Tables, documents: DataFrame, windows: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc, start, length, span) of every occurrence of ``windows`` (length, span) in documents (doc, text).

    ``prints`` (doc, print) holds the documents' fingerprints that are those of an item.
    """
    found = prints.groupBy("doc").agg(F.collect_set("print").alias("prints"))
    again = winnowed(documents.join(small_side(found), "doc").select("doc", words("text").alias("words"), "prints"))
    # a place of ``kept`` is the start of a window; where its smallest hash is an item's, the window may be one
    starts = F.filter(F.transform("kept", lambda h, i: F.when(F.array_contains("prints", h), i)), lambda i: i.isNotNull())
    places = again.select("doc", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), _span(i, F.lit(WINDOW)).alias("span")))).alias("x"))
    places = places.select("doc", "x.start", F.lit(WINDOW).alias("length"), "x.span")
    long = places.join(small_side(windows.where(F.col("length") == WINDOW)), ["length", "span"]).select("doc", "start", "length", "span").distinct()
    return long.unionByName(_short_hits(tables, documents, windows.where(F.col("length") < WINDOW)))


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row with the totals of its text.  Where they are too many to be sent to all, copies of a text are dealt to ``SALTS`` tasks."""
    small = small_side(totals)
    if small is not totals:
        return rows.join(small, "doc", "left")
    dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(dealt, ["doc", "salt"], "left").drop("salt")


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: int = 20) -> DataFrame:
    """Per row of ``documents``: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Of the documents' fingerprints only those of an item are stored; the words are counted in the last pass.
    """
    tables = Tables(documents.sparkSession, "decontaminate")
    items = tables.add(benchmark.select(F.col(item).cast("string").alias("item"), words(item_text).alias("words")).where("size(words) > 0"))
    spans = tables.add(_windows(items))
    windows = tables.add(spans.select("length", "span").distinct())
    asked = tables.add(winnowed(items).select(F.explode(F.array_distinct("kept")).alias("print")).distinct())

    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("doc"))
    kept = winnowed(docs.select("doc", words("text").alias("words"))).select("doc", F.explode(F.array_distinct("kept")).alias("print"))
    prints = tables.add(kept.join(small_side(asked), "print").select("doc", "print").distinct())
    hits = tables.add(find_hits(tables, docs.select("doc", "text"), windows, prints))

    # hit words: intervals in order of their start; each adds what lies beyond those before it
    intervals = hits.groupBy("doc", "start").agg(F.max("length").alias("length")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(acc["end"], x["start"]))).alias("n")),
    )["n"]
    n_hit = intervals.select("doc", covered.cast("long").alias("n_hit"))
    pairs = hits.select("doc", "span").distinct().join(small_side(spans), "span").where("item is not null").select("doc", "item").distinct()
    n_items = pairs.groupBy("doc").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    totals = tables.add(n_hit.join(n_items, "doc", "left"))
    tables.keep_only(totals)
    rows = docs.select("key", "doc", F.size(words("text")).cast("long").alias("n_words"))
    found = _with_totals(rows, totals).select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
    )
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
