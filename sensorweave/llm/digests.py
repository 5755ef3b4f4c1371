"""Document fingerprints from improbable byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy of order 2, given by the number of equal byte pairs in
it.  Its rarity is how improbable that number is for text (a Poisson law of mean ``USUAL_PAIRS``);
windows of very low entropy are left out.  Of each ``SPAN`` consecutive windows the rarest, the first
of equals, gets a vote, and windows of at least ``VOTES`` votes are the features; where no window has so
many, the one of most votes is.  Features are in order of place into Bloom filters of ``FILTER_BITS`` bits, ``PER_FILTER`` to a filter, which form the
fingerprint.  Two fingerprints are compared by the overlap of their filters beyond chance.

Defined results: a null text is the empty text; a text shorter than a window is one feature, and so is a
text with windows of very low entropy only; the empty text alone has none; equal texts have equal fingerprints and likeness 1, an empty and another text likeness 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.llm._flat import byte_buffer, chunks, mix
from sensorweave.llm._shared import small_batches

WINDOW = 32
SPAN = 64
VOTES = 16
USUAL_PAIRS = 32
MOST_PAIRS = 110
FILTER_BITS = 1024
PER_FILTER = 64
HASHES = 5


def _precedence() -> np.ndarray:
    """Order of pair counts from the most improbable on; counts of low entropy come last."""
    n = WINDOW * (WINDOW - 1) // 2 + 1
    surprise = np.array([USUAL_PAIRS - k * math.log(USUAL_PAIRS) + math.lgamma(k + 1) for k in range(n)])
    order = np.argsort(-surprise[: MOST_PAIRS + 1], kind="stable")
    out = np.full(n, n, np.int64)
    out[order] = np.arange(len(order))
    return out


_RANK = _precedence()
_NEVER = np.int64(1) << 62


def pair_counts(buf: np.ndarray) -> np.ndarray:
    """For each place the number of equal byte pairs in the window from there on.

    A window differs from the one before by the pairs of the byte that enters and of the one that leaves.
    """
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = np.zeros(len(buf), np.int8), np.zeros(len(buf), np.int8)
    for d in range(1, WINDOW):
        same = (buf[d:] == buf[:-d]).view(np.int8)
        before[d:] += same
        after[:-d] += same
    first = sum(int((buf[d:WINDOW] == buf[: WINDOW - d]).sum()) for d in range(1, WINDOW))
    steps = np.empty(n, np.int64)
    steps[0] = first
    steps[1:] = before[WINDOW:].astype(np.int64) - after[: n - 1]
    return np.cumsum(steps)


def _whole(buf: np.ndarray, offsets: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole texts."""
    own = [int.from_bytes(hashlib.blake2b(buf[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in texts]
    return np.array(own, np.uint64)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of every feature, by text and place, each hash once in a text."""
    sizes = np.diff(offsets)
    n = len(buf) - WINDOW + 1
    texts, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n > 0:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = _RANK[pair_counts(buf)] << 40 | np.arange(n)
        bad = (owner[:n] != owner[WINDOW - 1 :]) | (key >> 40 >= len(_RANK))
        key[bad] = _NEVER
        best, width = key, 1
        while width < SPAN:  # the smallest of 2, 4, ... windows
            best = np.minimum(best[: len(best) - width], best[width:]) if len(best) > width else best[:0]
            width *= 2
        votes = np.zeros(n, np.int64)
        if len(best):
            reach = WINDOW + SPAN - 1
            whole = owner[: len(best)] == owner[reach - 1 : reach - 1 + len(best)]
            chosen = best[whole & (best != _NEVER)] & ((1 << 40) - 1)
            votes = np.bincount(chosen, minlength=n)
        picked = np.flatnonzero(votes >= VOTES)
        # texts with windows but no whole span: their single rarest window
        middle = np.flatnonzero((sizes >= WINDOW) & (sizes < WINDOW + SPAN - 1))
        single = [a + int(key[a : a + s - WINDOW + 1].argmin()) for a, s in zip(offsets[middle].tolist(), sizes[middle].tolist(), strict=True)]
        # texts with spans but no window of VOTES votes: their first window of most votes
        few = np.setdiff1d(np.flatnonzero(sizes >= WINDOW + SPAN - 1), owner[picked])
        most = [a + int(votes[a : a + s - WINDOW + 1].argmax()) for a, s in zip(offsets[few].tolist(), sizes[few].tolist(), strict=True)]
        places = np.union1d(picked, np.array(single + [i for i in most if votes[i]], np.int64))
        texts = owner[places]
    with np.errstate(over="ignore"):
        grid = buf[places[:, None] + np.arange(WINDOW)] if len(places) else np.zeros((0, WINDOW), np.uint8)
        hashes = np.zeros(len(places), np.uint64)
        for column in np.ascontiguousarray(grid).view(np.uint64).T:
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + column)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    texts, hashes = np.concatenate([texts, short]), np.concatenate([hashes, _whole(buf, offsets, short)])
    order = np.argsort(texts, kind="stable")
    texts, hashes = texts[order], hashes[order]
    _, first = np.unique(np.rec.fromarrays([texts, hashes]), return_index=True)
    first.sort()
    return texts[first], hashes[first]


def filters(texts: list[str | None]) -> list[np.ndarray]:
    """The chain of filters of each text, packed, one row a filter; a text without rare windows is hashed whole."""
    buf, offsets = byte_buffer(texts)
    owner, hashes = features(buf, offsets)
    bare = np.setdiff1d(np.flatnonzero(np.diff(offsets)), owner)
    owner, hashes = np.concatenate([owner, bare]), np.concatenate([hashes, _whole(buf, offsets, bare)])
    order = np.argsort(owner, kind="stable")
    owner, hashes = owner[order], hashes[order]
    counts = np.bincount(owner, minlength=len(texts))
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = -(-counts // PER_FILTER)
    at = np.repeat(np.cumsum(chains) - chains, counts) + within // PER_FILTER
    bits = np.zeros((int(chains.sum()), FILTER_BITS), bool)
    for k in range(HASHES):
        bits[at, (hashes >> np.uint64(10 * k)).astype(np.int64) % FILTER_BITS] = True
    packed = np.packbits(bits, axis=1)
    return np.split(packed, np.cumsum(chains)[:-1]) if len(texts) else []


def to_text(chain: np.ndarray) -> str:
    return f"{len(chain)}:{chain.tobytes().hex()}"


def from_text(fingerprint: str) -> np.ndarray:
    count, _, digits = fingerprint.partition(":")
    return np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(int(count), FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best match, weighed by its bits."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    total = 0.0
    for x, n in zip(a, size_a, strict=True):
        common = np.bitwise_count(b & x).sum(1)
        chance = n * size_b / FILTER_BITS
        most = np.minimum(n, size_b)
        total += n * max(0.0, float(((common - chance) / np.maximum(most - chance, 1e-9)).max()))
    return min(1.0, total / size_a.sum())


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_column(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of ``text``; an older column of the name goes."""
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [to_text(c) for a, b in chunks(texts) for c in filters(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, extra, id, text) in buckets of consecutive keys, each in one partition in order of key.

    The first row of the next bucket stands at the end of a bucket with ``extra`` = 1 (in the last
    bucket that of the first), so that every row's successor stands behind it.  Bounds are quantiles
    of the keys; only one key per bucket comes to the driver.  Rows with a null key come first.  Keys are
    whole numbers, of up to 64 bits; a key of another type is cast to one.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    rows = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = np.unique(np.array(rows.select("id").stat.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)), np.float64))

    # nulls come as a column of their own: among them pandas would turn ids into doubles and round them
    def place(ids: pd.Series, nulls: pd.Series) -> np.ndarray:
        return np.where(nulls, 0, np.searchsorted(bounds, ids.to_numpy(np.float64), side="right"))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, nulls: pd.Series) -> pd.Series:
        return pd.Series(place(ids, nulls).astype(np.int32))

    given = F.coalesce("id", F.lit(0)), F.col("id").isNull()
    # -1 stands for the null key, which is the least
    heads = sorted((r["bucket"], r["nulls"], r["first"]) for r in rows.groupBy(bucket(*given).alias("bucket")).agg(F.min("id").alias("first"), F.max(F.col("id").isNull().cast("int")).alias("nulls")).collect())
    head_of = {(None if nulls else first): heads[i - 1][0] for i, (_, nulls, first) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series, nulls: pd.Series) -> pd.Series:
        at = place(ids, nulls)
        return pd.Series([[int(b)] if (h := head_of.get(None if null else int(i))) is None else [int(b), -1 - h] for i, null, b in zip(ids, nulls, at, strict=True)])

    dealt = rows.select(F.explode(buckets(*given)).alias("b"), "id", "text")
    dealt = dealt.select(F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("bucket"), (F.col("b") < 0).cast("int").alias("extra"), "id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_first(), "text")


def compare_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once.  Rows of equal key follow each other in order of their text.
    """
    small_batches(documents.sparkSession)

    def finish(ids: list, texts: list[str], chains: list[np.ndarray]) -> pa.RecordBatch:
        """Results of all rows but the last, which is only the successor of the one before."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        new = filters(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([to_text(c) for c in chains[:-1]], pa.string()),
                pa.array([to_text(c) for c in new], pa.string()),
                pa.array([1.0 if t == e else likeness(c, x) for t, e, c, x in zip(texts, changed, chains, new, strict=False)], pa.float64()),
                pa.array([1.0 if t == s else likeness(c, x) for t, s, c, x in zip(texts, texts[1:], chains, chains[1:], strict=False)], pa.float64()),
            ],
            names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text and chain of the last row
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "extra", "id", "text")]
            for a, b in chunks(columns[3]):
                chains = filters(columns[3][a:b])
                bucket, extra, ids, texts = (c[a:b] for c in columns)
                start = 0
                while start < len(ids):  # rows of one bucket
                    end = start + 1
                    while end < len(ids) and bucket[end] == bucket[start]:
                        end += 1
                    over = extra[start:end].index(1) if 1 in extra[start:end] else None
                    stop = end if over is None else start + over + 1  # of several successors the first counts
                    if held and held[0] == bucket[start]:
                        yield finish([held[1], *ids[start:stop]], [held[2], *texts[start:stop]], [held[3], *chains[start:stop]])
                    elif stop - start > 1:
                        yield finish(ids[start:stop], texts[start:stop], chains[start:stop])
                    held = (bucket[start], ids[stop - 1], texts[stop - 1], chains[stop - 1]) if over is None else None
                    start = end

    return with_next(documents, key, text).mapInArrow(run, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
