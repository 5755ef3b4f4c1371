"""Arithmetic on image planes: fusion, tone curve, quality, tile confidence, divergence guard, motion.

A plane is an array<int> of unsigned bytes in row order; ``decode`` makes it from binary.  Work on
single pixels is done on exploded rows, so a burst of many frames is summed by partial aggregates; the
numbers of a frame are expressions over its array, inside one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorweave.operators import pieces

TILE = 32


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def decode(buffer: Column) -> Column:
    """Binary to unsigned values."""
    return F.when(F.length(buffer) > 0, F.transform(F.sequence(F.lit(1), F.length(buffer)), lambda i: F.conv(F.hex(F.substring(buffer, i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def frame_bytes(handle: Column, planes: Column) -> Column:
    """Bytes of a frame: those of its handle, else of its planes' buffers."""
    return F.coalesce(handle, F.aggregate(planes, F.lit(0).cast("bigint"), lambda a, p: a + F.length(p["buffer"])))


def temporal_fusion(frames: DataFrame, by: list[str], plane: str, seq: str) -> DataFrame:
    """(by, idx, fused): the sum over all frames by place, divided (whole) by the number of frames.

    The last frame gives the size; a frame with a shorter plane adds nothing beyond its end but counts.
    """
    burst = frames.groupBy(*by).agg(F.count("*").alias("_frames"), F.max_by(F.size(plane), seq).alias("_size"))
    sums = frames.select(*by, F.posexplode(plane).alias("idx", "_v")).groupBy(*by, "idx").agg(F.sum("_v").alias("_sum"))
    return sums.join(burst, by).where(F.col("idx") < F.col("_size")).select(*by, "idx", F.expr("cast(least(greatest(_sum div _frames, 0), 255) as int)").alias("fused"))


def tone_curve(value: Column) -> Column:
    """The contrast curve n*n*(3-2n) of one value, cut to a whole number."""
    n = value / F.lit(255.0)
    return clamp((n * n * (F.lit(3) - F.lit(2) * n) * F.lit(255.0)).cast("int"), F.lit(0), F.lit(255))


def tone_rgb(plane: Column) -> Column:
    """A tone-mapped plane, each value three times."""
    return F.flatten(F.transform(plane, lambda v: F.array_repeat(tone_curve(v), 3)))


def blend(recon: Column, orig: Column, ratio: float = 0.65) -> Column:
    """Both planes mixed in float, cut to whole numbers."""
    r, rest = _f(ratio), _f(1.0) - _f(ratio)
    return F.zip_with(recon, orig, lambda a, b: clamp((a.cast("float") * r + b.cast("float") * rest).cast("int"), F.lit(0), F.lit(255)))


def with_quality(frames: DataFrame, plane: str, step: int = 4) -> DataFrame:
    """Adds n, clipped, variance, the scores and is_acceptable, from every ``step``-th value.

    The variance is taken from whole sums, so that engines agree on it.
    """
    picked = F.filter(F.col(plane), lambda v, i: i % step == 0)
    zero = F.lit(0).cast("bigint")
    df = frames.withColumn("_s", picked).withColumn("n", F.size("_s").cast("bigint"))
    df = df.withColumn("_sum", F.aggregate("_s", zero, lambda a, v: a + v)).withColumn("_sq", F.aggregate("_s", zero, lambda a, v: a + v * v))
    df = df.withColumn("clipped", F.aggregate("_s", zero, lambda a, v: a + F.when((v <= 2) | (v >= 253), 1).otherwise(0)))
    return quality_scores(df.drop("_s"))


def quality_scores(df: DataFrame) -> DataFrame:
    """Variance, scores and is_acceptable from n, clipped and the whole sums ``_sum`` and ``_sq``."""
    variance = (F.col("n") * F.col("_sq") - F.col("_sum") * F.col("_sum")).cast("double") / (F.col("n") * F.col("n")).cast("double")
    df = df.withColumn("variance", F.when(F.col("n") > 0, variance).otherwise(0.0))
    sd, empty = F.sqrt("variance"), F.col("n") == 0
    df = df.withColumn("noise_score", F.when(empty, _f(0)).otherwise(clamp((F.lit(1.0) - sd / 128.0).cast("float"), _f(0.1), _f(1))))
    df = df.withColumn("range_score", F.when(empty, _f(0)).otherwise(clamp((F.lit(1.0) - F.col("clipped").cast("double") / F.greatest("n", F.lit(1))).cast("float"), _f(0), _f(1))))
    df = df.withColumn("sharp_score", F.when(empty, _f(0)).otherwise(clamp((sd / 64.0).cast("float"), _f(0.1), _f(1))))
    df = df.withColumn("artifact_risk", F.when(empty, _f(1)).when(F.col("clipped") > F.col("n") * 0.5, _f(0.8)).otherwise(_f(0.1)))
    df = df.withColumn("overall", F.when(empty, _f(0)).otherwise(clamp(F.col("noise_score") * _f(0.3) + F.col("range_score") * _f(0.3) + F.col("sharp_score") * _f(0.4), _f(0), _f(1))))
    return df.withColumn("is_acceptable", ~empty & (F.col("overall") >= _f(0.35))).drop("_sum", "_sq")


def tile_averages(frames: DataFrame, key: list[str], plane: str, width: Column, tile: int = TILE) -> DataFrame:
    """(key, ty, tx, avg): whole means of tiles; tiles at the edge hold what there is."""
    rows = frames.select(*key, width.alias("_w"), F.posexplode(plane).alias("_i", "_v"))
    rows = rows.select(*key, F.expr(f"cast(((_i div _w) div {tile}) as int)").alias("ty"), F.expr(f"cast(((_i % _w) div {tile}) as int)").alias("tx"), "_v")
    return rows.groupBy(*key, "ty", "tx").agg(F.sum("_v").alias("_sum"), F.count("*").alias("_n")).select(*key, "ty", "tx", F.expr("cast(_sum div _n as int)").alias("avg"))


def noise_penalty(iso: Column) -> Column:
    return clamp(F.greatest(iso.cast("float") / _f(100), _f(1)).cast("float") / _f(64), _f(0), _f(0.5)).cast("float")


def tile_confidence(avg: Column, iso: Column) -> Column:
    """Confidence of a tile by its mean, less the noise penalty."""
    base = F.when(avg > 245, _f(0.2)).when(avg < 12, _f(0.3)).when(avg.between(40, 215), _f(0.95)).otherwise(_f(0.7))
    return clamp((base - noise_penalty(iso)).cast("float"), _f(0.05), _f(1))


def guard_decisions(frames: DataFrame, key: list[str], orig: str, recon: str, width: Column, iso: Column, tile: int = TILE, step: int = 8) -> DataFrame:
    """(key, n_high, n_far, ratio, confidence_mean, action, blend_ratio, hallucination).

    Every ``step``-th pixel of both directions whose tile has confidence 0.75 or more is compared; more
    than 45 apart counts.  Planes of unlike size are reverted without a comparison.
    """
    tiles = tile_averages(frames.withColumn("_iso", iso).withColumn("_w", width), [*key, "_iso"], orig, F.col("_w"), tile)
    tiles = tiles.withColumn("conf", tile_confidence(F.col("avg"), F.col("_iso"))).drop("avg", "_iso")
    means = tiles.groupBy(*key).agg((F.sum(F.col("conf").cast("double")) / F.count("*")).cast("float").alias("_mean"))
    pixels = frames.where(F.size(orig) == F.size(recon)).select(*key, width.alias("_w"), F.posexplode(F.arrays_zip(F.col(orig).alias("o"), F.col(recon).alias("r"))).alias("_i", "_p"))
    pixels = pixels.where(F.expr(f"(_i div _w) % {step} = 0 and (_i % _w) % {step} = 0")).select(*key, F.expr(f"cast(((_i div _w) div {tile}) as int)").alias("ty"), F.expr(f"cast(((_i % _w) div {tile}) as int)").alias("tx"), (F.abs(F.col("_p.o") - F.col("_p.r")) > 45).alias("_far"))
    counted = pixels.join(tiles, [*key, "ty", "tx"]).where(F.col("conf") >= _f(0.75)).groupBy(*key).agg(F.count("*").alias("n_high"), F.count_if("_far").alias("n_far"))
    rows = frames.select(*key, (F.size(orig) == F.size(recon)).alias("_same")).join(means, key, "left").join(counted, key, "left").fillna(0, ["n_high", "n_far"])
    ratio = F.when(F.col("n_high") > 0, (F.col("n_far").cast("float") / F.col("n_high").cast("float")).cast("float")).otherwise(_f(0))
    rows = rows.withColumn("ratio", ratio)
    high, some = F.col("ratio") > _f(0.2), F.col("ratio") > _f(0.05)
    return rows.select(
        *key, "n_high", "n_far", "ratio",
        F.when(~F.col("_same"), _f(0)).otherwise(F.coalesce("_mean", _f(0.5))).alias("confidence_mean"),
        F.when(~F.col("_same") | high, "REVERT_TO_ORIGINAL").when(some, "BLEND_WITH_ORIGINAL").otherwise("KEEP_RECONSTRUCTED").alias("action"),
        F.when(~F.col("_same") | high, _f(0)).when(some, _f(0.65)).otherwise(_f(1)).alias("blend_ratio"),
        (F.col("_same") & high).alias("hallucination"),
    )


def gyro_norm(gyro: Column) -> Column:
    """Sum of the sizes of the first three axes; 0 with fewer."""
    return F.when(F.size(gyro) >= 3, F.aggregate(F.slice(gyro, 1, 3), _f(0), lambda a, v: (a + F.abs(v)).cast("float"))).otherwise(_f(0))


def luma_difference(previous: Column, current: Column, step: int = 16) -> Column:
    """Mean absolute difference of every ``step``-th value, as float."""
    far = F.filter(F.zip_with(previous, current, lambda p, c: F.abs(p - c)), lambda v, i: i % step == 0)
    return F.when(F.size(far) > 0, (F.aggregate(far, F.lit(0).cast("bigint"), lambda a, v: a + v).cast("float") / F.size(far).cast("float")).cast("float")).otherwise(_f(0))


def motion_vectors(frames: DataFrame, by: list[str], seq: str, plane: str, gyro: Column | None = None, step: int = 16) -> DataFrame:
    """Adds delta (both axes), angular velocity and is_tripod against the frame before it of the same key.

    Only every ``step``-th value is compared, so only those go along with a frame.  Frames are put in
    order within pieces of a key; a piece gets the compared values of the last frame before it.
    """
    turn = F.coalesce(gyro_norm(gyro), _f(0)) if gyro is not None else _f(0)
    seen = F.struct(F.size(plane).alias("n"), F.filter(plane, lambda v, i: i % step == 0).alias("v"))
    df = pieces.cut(frames, by, [seq]).withColumn("angular_velocity", turn).withColumn("_seen", F.when(F.col(plane).isNotNull(), seen))
    rest = pieces.carried(df, by, {"_last": F.max_by(F.struct("_seen"), seq)}, {"_halo": F.last("_last")})
    inside = F.lag(F.struct("_seen")).over(pieces.within(by, seq))
    df = pieces.join_carried(df.withColumn("_inside", inside), rest, by)
    before = F.coalesce("_inside", "_halo")["_seen"]
    known = F.coalesce(before["n"] == F.col("_seen.n"), F.lit(False))
    df = df.withColumn("_diff", F.when(known, luma_difference(before["v"], F.col("_seen.v"), 1))).withColumn("_known", known)
    df = df.withColumn("delta", F.when(F.col("_known"), (F.col("_diff") * _f(0.1)).cast("float")).otherwise(_f(0)))
    still = F.when(F.col("_known"), (F.col("angular_velocity") < _f(0.03)) & (F.col("_diff") < _f(2))).otherwise(F.col("angular_velocity") < _f(0.05))
    return df.withColumn("is_tripod", still).drop("_seen", "_inside", "_halo", "_diff", "_known", pieces.PIECE)


def encode_jpeg(rgb: Column) -> Column:
    """The simulated encoder: a JPEG marker before the bytes."""
    return F.concat(F.unhex(F.lit("FFD8FFE0")), rgb)


def encode_dng(raw: Column) -> Column:
    """The simulated encoder: a TIFF marker before the bytes."""
    return F.concat(F.unhex(F.lit("49492A00")), raw)
