"""The whole still pipeline of a burst on large planes, by numpy over Arrow batches.

The DataFrame forms in ``planes`` explode pixels; for planes of megapixels this does the same work on
whole buffers, one burst at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "burst string, width int, height int, action string, blend_ratio float, ratio float, overall float, is_acceptable boolean, rgb binary"


def process(planes: list[bytes], width: int, height: int, iso: int, tile: int = 32) -> dict:
    """Fuse, estimate confidence, guard, blend, tone-map and score one burst; the last frame is the original."""
    n = width * height
    original = np.frombuffer(planes[-1], np.uint8)[:n].astype(np.int64)
    total = np.zeros(n, np.int64)
    for plane in planes:
        values = np.frombuffer(plane, np.uint8)[:n]
        total[: len(values)] += values
    recon = total // len(planes)
    grid = original.reshape(height, width)
    rows, cols = np.arange(0, height, tile), np.arange(0, width, tile)
    sums = np.add.reduceat(np.add.reduceat(grid, rows, 0), cols, 1)
    sizes = np.outer(np.diff([*rows, height]), np.diff([*cols, width]))
    avg = sums // sizes
    f = np.float32
    base = np.select([avg > 245, avg < 12, (avg >= 40) & (avg <= 215)], [f(0.2), f(0.3), f(0.95)], f(0.7)).astype(f)
    conf = np.clip(base - np.clip(max(f(iso) / f(100), f(1)) / f(64), f(0), f(0.5)), f(0.05), f(1))
    ys, xs = np.arange(0, height, 8), np.arange(0, width, 8)
    high = conf[np.ix_(ys // tile, xs // tile)] >= f(0.75)
    far = np.abs(grid - recon.reshape(height, width))[np.ix_(ys, xs)] > 45
    ratio = f((far & high).sum()) / f(high.sum()) if high.any() else f(0)
    if ratio > f(0.2):
        action, blend, final = "REVERT_TO_ORIGINAL", 0.0, original
    elif ratio > f(0.05):
        action, blend = "BLEND_WITH_ORIGINAL", 0.65
        final = np.clip((recon.astype(f) * f(0.65) + original.astype(f) * (f(1) - f(0.65))).astype(np.int64), 0, 255)
    else:
        action, blend, final = "KEEP_RECONSTRUCTED", 1.0, recon
    x = final / 255.0
    rgb = np.repeat(np.clip((x * x * (3 - 2 * x) * 255.0).astype(np.int64), 0, 255).astype(np.uint8), 3)
    picked = final[::4]
    m, s, q = len(picked), int(picked.sum()), int((picked**2).sum())
    sd, clipped = ((m * q - s * s) / (m * m)) ** 0.5, int(((picked <= 2) | (picked >= 253)).sum())
    scores = np.clip(f(1 - sd / 128), f(0.1), f(1)), np.clip(f(1 - clipped / max(m, 1)), f(0), f(1)), np.clip(f(sd / 64), f(0.1), f(1))
    overall = float(np.clip(scores[0] * f(0.3) + scores[1] * f(0.3) + scores[2] * f(0.4), 0, 1))
    return {"action": action, "blend_ratio": blend, "ratio": float(ratio), "overall": overall, "is_acceptable": overall >= f(0.35), "rgb": rgb.tobytes()}


def process_bursts(frames: DataFrame) -> DataFrame:
    """frames (burst string, seq, plane binary, width, height, iso): one processed row by burst; a burst is a handful of frames."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        last = pdf.iloc[-1]
        out = process([bytes(p) for p in pdf["plane"]], int(last["width"]), int(last["height"]), int(last["iso"]))
        return pd.DataFrame([{"burst": last["burst"], "width": last["width"], "height": last["height"], **out}])

    return frames.groupBy("burst").applyInPandas(one, SCHEMA)
