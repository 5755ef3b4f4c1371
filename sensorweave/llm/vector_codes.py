"""Product codes of vectors: codebooks by rounds of assignment, each part searched by the exponion rule.

A vector is cut into four parts; each part position has a codebook of up to 256 entries.  A part's search
starts at the entry that it had in the round before.  With d the distance to that entry, any entry at
least as near lies within 2 d of it, so only the start of that entry's list of neighbours, sorted by
distance, is looked at: those whose squared distance is at most 4 d^2.  Components are integers and
distances exact; of equally near entries the lower index wins.

Rows with their codes are stored each round, so a lost executor repeats its part of one round; a codebook
is its sums over all rows, at most 1024 rows of them, and is all that the driver holds.

Defined results: rows whose vector is null, or holds a null or non-finite component, are dropped; a
vector shorter than the longest one, or than a multiple of four, counts as if zeros followed; repeated
ids give a row each, and the codebook starts from the componentwise smallest vector of an id, ids taken
once, a null id last; with fewer than 256 ids codebooks are smaller; an empty table gives no rows; other
columns are not read.  Components of any finite size are exact; an error beyond a long is its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.llm._shared import Tables, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that are searched together, and neighbours that are compared at once.
BLOCK_ROWS, NEIGHBOURS = 32_768, 32
LONG = (1 << 63) - 1

#: Sums are added up as whole numbers of ``10 ** LIMB`` and the rest, as one decimal does not hold all of them.
LIMB = 18


@dataclass
class Codebook:
    """Entries of each part position: an array of parts by entries by components, of whole numbers."""

    entries: np.ndarray

    def exact(self, most: float) -> bool:
        """True if squared distances between numbers of at most this size, times the number of entries, are whole in a double."""
        return self.entries.shape[2] * (2 * most) ** 2 * 4 * ENTRIES < 2**53

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def _neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance, then index, and these squared distances."""
    gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, axis=1)


def nearest(parts: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each part's nearest entry, searched from ``start``."""
    order, gaps = _neighbours(entries)
    index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    rows = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[rows], np.arange(len(entries) + 1))
    norms = (entries**2).sum(axis=1)
    for a in np.unique(start).tolist():
        mine = rows[cuts[a] : cuts[a + 1]]
        x = parts[mine]
        own = ((x - entries[a]) ** 2).sum(axis=1)
        reach = np.searchsorted(gaps[a], 4 * own, "right")
        by_reach = np.argsort(-reach, kind="stable")
        mine, x, reach = mine[by_reach], x[by_reach], reach[by_reach]
        square = (x**2).sum(axis=1)
        best = own[by_reach] * ENTRIES + a
        for at in range(0, int(reach[0]), NEIGHBOURS):
            n = int(np.searchsorted(-reach, -at, "left"))  # rows whose reach goes beyond ``at``
            near = order[a, at : at + NEIGHBOURS]
            found = square[:n, None] - 2 * x[:n].dot(entries[near].T) + norms[near]
            best[:n] = np.minimum(best[:n], (found * ENTRIES + near).min(axis=1))
        index[mine] = (best % ENTRIES).astype(np.int64)
        distance[mine] = best // ENTRIES
    return index, distance


def _whole(values: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers, which have no bound."""
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def assign(vectors: np.ndarray, book: Codebook, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all vectors and their errors."""
    width = book.entries.shape[2]
    most = max(np.abs(vectors).max(initial=0), float(np.abs(book.entries).max(initial=0)))
    entries = book.entries
    if book.exact(float(most)):
        entries = entries.astype(np.float64)
    else:
        vectors, entries = _whole(vectors), _whole(entries)
    codes, errors = np.zeros((len(vectors), PARTS), np.uint8), np.zeros(len(vectors), vectors.dtype)
    for p in range(PARTS):
        codes[:, p], near = nearest(vectors[:, p * width : (p + 1) * width], entries[p], start[:, p].astype(np.int64))
        errors += near
    return codes, np.array([min(int(e), LONG) for e in errors], np.int64) if errors.dtype == object else errors.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _assigned(rows: DataFrame, book: Codebook) -> DataFrame:
    """The rows with their codes and errors by this codebook."""
    size = PARTS * book.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes, errors = assign(_matrix(block["parts"], size), book, _codes(block["code"]))
            made = pa.table({"id": block["id"], "label": block["label"], "parts": block["parts"], "code": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(errors)})
            yield from made.to_batches(max_chunksize=4096)

    return rows.mapInArrow(run, rows.schema)


def _scaled(rows: DataFrame, size: int) -> DataFrame:
    """Each component x as floor(1024 x); all parts start from entry 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(_matrix(batch.column(2), size) * SCALE).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, size, dtype=np.int32) if size else np.zeros(batch.num_rows + 1, np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([bytes(PARTS)] * batch.num_rows, pa.binary()), pa.array(np.zeros(batch.num_rows, np.int64))], names=["id", "label", "parts", "code", "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("parts", T.ArrayType(T.DoubleType())), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))


def _sums(rows: DataFrame, width: int) -> list:
    """Count and sum of each component of the parts at each entry, over all rows; the tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, ENTRIES), np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), object)
        for block in _blocks(batches):
            vectors, codes = _matrix(block["parts"], PARTS * width), _codes(block["code"])
            small = np.abs(vectors).max(initial=0) < 2**36  # sums of a block stay whole in a double
            for p in range(PARTS):
                part, code = vectors[:, p * width : (p + 1) * width], codes[:, p].astype(np.int64)
                counts[p] += np.bincount(code, minlength=ENTRIES)
                if small:
                    sums[p] += np.stack([np.bincount(code, column, ENTRIES) for column in part.T], axis=1).astype(np.int64) if width else 0
                else:
                    np.add.at(sums[p], code, _whole(part))
        p, e = (x.repeat(width) for x in np.nonzero(counts))
        if len(p):
            k = np.tile(np.arange(width), len(p) // width)
            high, low = zip(*(divmod(int(s), 10**LIMB) for s in sums[p, e, k]))
            decimals = [pa.array(map(Decimal, x), pa.decimal128(38, 0)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, e]), *decimals], names=["part", "entry", "place", "n", "high", "low"])

    partial = rows.select("parts", "code").mapInArrow(run, "part int, entry int, place int, n bigint, high decimal(38,0), low decimal(38,0)")
    return partial.groupBy("part", "entry", "place").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()


def _moved(book: Codebook, sums: list) -> Codebook:
    """Each used entry at the floor of its parts' mean."""
    entries = book.entries.copy()
    for row in sums:
        entries[row["part"], row["entry"], row["place"]] = (int(row["high"]) * 10**LIMB + int(row["low"])) // row["n"]
    return Codebook(entries)


def _started(rows: DataFrame, width: int) -> Codebook:
    """The vectors of the smallest ids, cut into parts."""
    ids = F.broadcast(rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).withColumnRenamed("id", "chosen"))
    found = rows.join(ids, F.col("id").eqNullSafe(F.col("chosen"))).groupBy("id").agg(F.min("parts").alias("parts")).orderBy(F.col("id").asc_nulls_last()).collect()
    entries = np.array([[int(v) for v in r["parts"]] for r in found], object).reshape(len(found), PARTS, width)
    return Codebook(entries.transpose(1, 0, 2))


def product_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for every row whose vector is whole."""
    tables = Tables(vectors.sparkSession, "codes")
    x = F.col(vector).cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), x.alias("x")).where(F.col(vector).isNotNull() & ~broken)
    width = -(-(kept.agg(F.max(F.size("x"))).first()[0] or 0) // PARTS)
    padded = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(width * PARTS) - F.size("x"))))
    rows = tables.add(_scaled(padded, width * PARTS))
    book = _started(rows, width)
    for _ in range(ROUNDS):
        assigned = tables.add(_assigned(rows, book))
        tables.drop(rows)
        rows, book = assigned, _moved(book, _sums(assigned, width))
    final = tables.add(_assigned(rows, book).drop("parts"))
    tables.drop(rows)
    by_label = tables.add(final.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error")).withColumnRenamed("label", "its_label"))
    joined = final.join(small_side(by_label), F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
