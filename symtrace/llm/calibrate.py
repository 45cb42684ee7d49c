"""Isotonic calibration from a histogram, and the split of labelled rows by doc_id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 2048  #: of raw scores; what comes to the driver is one count for each


def part_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def held_out(doc_id: str, parts: int, rest: int) -> Column:
    return F.coalesce(part_of(doc_id, parts) == rest, F.lit(False))


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): rows without either are left out; the greatest label of repeated ids counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg((F.max(column) > 0).cast("double").alias("label"))


class Isotonic:
    """Non-decreasing step means by pooling adjacent violators, interpolated between the bins' centres."""

    def __init__(self, x: np.ndarray, n: np.ndarray, positive: np.ndarray):
        blocks: list[list[float]] = []
        for a, b, c in zip(x, n, positive):
            blocks.append([a, a, b, c])
            while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                _, high, m, p = blocks.pop()
                blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + m, blocks[-1][3] + p]
        self.x = np.array([v for b in blocks for v in (b[0], b[1])] or [0.0])
        self.y = np.array([b[3] / b[2] for b in blocks for _ in (0, 1)] or [0.5])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.x, self.y)


def fit_isotonic(rows: DataFrame, low: float, high: float) -> Isotonic:
    """From (raw, label): the driver gets at most BINS counts."""
    width = (high - low) / BINS
    bin_ = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1.0), (F.col("raw") - low) / width))).cast("int")
    got = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    got.sort(key=lambda r: r.bin)
    return Isotonic(np.array([low + (r.bin + 0.5) * width for r in got]), np.array([float(r.n) for r in got]), np.array([float(r.p) for r in got]))
