"""Guard decisions and quality of binary planes of any size, by bands of tile rows.

A plane is cut into bands, each one row of tiles high, as it is read; what is summed, averaged and compared
then works on a band of all frames of a burst, so a burst of megapixel frames is many rows in many
tasks, and a burst of very many frames passes through a task one band at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.functions.planes import TILE, quality_scores

_f = np.float32
GUARD = "frames bigint, n_pixels bigint, n_high bigint, n_far bigint, n_tiles bigint, confidence double"


def confidences(means: np.ndarray, iso: int) -> np.ndarray:
    """Confidence of tiles by their means, less the noise penalty, in single precision."""
    base = np.select([means > 245, means < 12, (means >= 40) & (means <= 215)], [_f(0.2), _f(0.3), _f(0.95)], _f(0.7)).astype(_f)
    noise = np.clip(np.maximum(_f(iso) / _f(100), _f(1)) / _f(64), _f(0), _f(0.5))
    return np.clip(base - noise, _f(0.05), _f(1))


def compare(original: np.ndarray, recon: np.ndarray, width: int, iso: int, first_row: int, tile: int, step: int) -> tuple[int, int, int, float]:
    """Compared places of confident tiles, those over 45 apart, tiles and their confidences' sum, in one band."""
    n = len(original)
    at = np.arange(n)
    of_tile = at % width // tile
    sizes = np.bincount(of_tile)
    conf = confidences(np.bincount(of_tile, original).astype(np.int64) // sizes, iso)
    seen = ((first_row + at // width) % step == 0) & (at % width % step == 0)
    high = seen & (conf[of_tile] >= _f(0.75))
    far = high & (np.abs(original.astype(np.int64) - recon) > 45)
    return int(high.sum()), int(far.sum()), len(sizes), float(conf.astype(np.float64).sum())


def cut(frames: DataFrame, by: list[str], seq: str, plane: str, width: Column, tile: int = TILE) -> DataFrame:
    """(by, seq, band, data) with the bytes of each band; an empty or null plane has none."""
    rows = frames.select(*by, F.col(seq).cast("bigint").alias("seq"), width.cast("int").alias("w"), F.col(plane).alias("data")).where("w > 0")
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("seq", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, size = batch.column("data")[i].as_py() or b"", tile * batch.column("w")[i].as_py()
                bands = [data[at : at + size] for at in range(0, len(data), size)]
                if bands:
                    one = batch.slice(i, 1)
                    same = [pa.array(one.column(c).to_pylist() * len(bands), one.schema.field(c).type) for c in (*by, "seq")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(bands)), pa.int32()), pa.array(bands, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def burst_guard(frames: DataFrame, by: list[str], seq: str, plane: str, width: Column, iso: Column, tile: int = TILE, step: int = 8) -> DataFrame:
    """By burst: frames, n_pixels, n_high, n_far, ratio, confidence_mean, action, blend_ratio of the fused plane against its last frame.

    The last frame by ``seq`` gives size, width and ISO; shorter frames add nothing beyond their end but
    count.  Bytes are unsigned.  A burst whose last plane is empty has no tiles and is kept with
    confidence 0.5.  ``seq`` is not repeated within a burst.
    """
    when = F.struct(F.col(seq).cast("bigint").alias("seq"), F.coalesce(F.octet_length(plane), F.lit(0)).alias("size"), width.cast("int").alias("w"), iso.cast("int").alias("iso"))
    bursts = frames.groupBy(*by).agg(F.max(when).alias("last"), F.count("*").alias("frames")).select(*by, "last.*", "frames")
    last_band = F.ceil(F.col("size") / (F.col("w") * tile)).cast("int") - 1
    heads = bursts.where("size > 0 and w > 0").select(*by, "seq", F.explode(F.sequence(F.lit(0), last_band)).alias("band"), "size", "w", "iso", "frames", F.lit(None).cast("binary").alias("data"))
    rows = heads.unionByName(cut(frames, by, seq, plane, width, tile), allowMissingColumns=True)
    dealt = rows.repartition(*by, "band").sortWithinPartitions(*by, "band", F.col("data").isNotNull(), "seq")
    schema = T.StructType([*(frames.schema[c] for c in by), *T.StructType.fromDDL(GUARD).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total, original, out = None, None, None, []

        def done() -> None:
            if head is not None and original is not None:
                recon = total // head["frames"]
                out.append((*(head[c] for c in by), head["frames"], len(original), *compare(original, recon, head["w"], head["iso"], head["band"] * tile, tile, step)))

        def made() -> pa.RecordBatch:
            kinds = [*(a for a in key_types), *[pa.int64()] * 5, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=schema.names)

        key_types = None
        for batch in batches:
            key_types = [batch.schema.field(c).type for c in by]
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["data"] is None:
                    done()
                    head, original = row, None
                    total = np.zeros(min(tile * row["w"], row["size"] - row["band"] * tile * row["w"]), np.int64)
                elif head is not None and row["band"] == head["band"] and all(row[c] == head[c] for c in by):
                    values = np.frombuffer(row["data"], np.uint8)[: len(total)]
                    total[: len(values)] += values
                    if row["seq"] == head["seq"]:
                        original = values
            if len(out) > 10_000:
                yield made()
                out = []
        done()
        if out:
            yield made()

    parts = dealt.mapInArrow(run, schema).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_pixels", "n_high", "n_far", "n_tiles", "confidence")])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    found = bursts.select(*by, "frames").join(parts.withColumnsRenamed({c: f"_k_{c}" for c in by}), same, "left").fillna(0, ["n_pixels", "n_high", "n_far", "n_tiles"])
    lit = lambda x: F.lit(x).cast("float")
    found = found.withColumn("ratio", F.when(F.col("n_high") > 0, (F.col("n_far").cast("float") / F.col("n_high").cast("float")).cast("float")).otherwise(lit(0)))
    high, some = F.col("ratio") > lit(0.2), F.col("ratio") > lit(0.05)
    return found.select(
        *by, "frames", "n_pixels", "n_high", "n_far", "ratio", F.when(F.col("n_tiles") > 0, (F.col("confidence") / F.col("n_tiles")).cast("float")).otherwise(lit(0.5)).alias("confidence_mean"),
        F.when(high, "REVERT_TO_ORIGINAL").when(some, "BLEND_WITH_ORIGINAL").otherwise("KEEP_RECONSTRUCTED").alias("action"), F.when(high, lit(0)).when(some, lit(0.65)).otherwise(lit(1)).alias("blend_ratio"),
    )


def with_binary_quality(frames: DataFrame, plane: str, step: int = 4) -> DataFrame:
    """Adds what ``planes.with_quality`` adds, for a binary plane: its bytes are summed in the pass that reads them."""
    added = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "_sum", "_sq", "clipped")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for data in batch.column(plane):
                v = np.frombuffer(data.as_py() or b"", np.uint8)[::step].astype(np.int64)
                sums.append((len(v), int(v.sum()), int((v * v).sum()), int(((v <= 2) | (v >= 253)).sum())))
            columns = [pa.array([s[k] for s in sums], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.names])

    return quality_scores(frames.mapInArrow(run, T.StructType([*frames.schema.fields, *added.fields])))
