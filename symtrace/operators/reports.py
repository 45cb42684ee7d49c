"""Reports: sizes, separation of groups, published points, cells, key-value cache footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symtrace.functions.symbols import kissing_ratio

#: Published operating points (label, bytes a token, perplexity cost in percent, family).
PUBLISHED = (("pooled VQ k=256", 342, 51.0, "pooled"), ("pooled VQ k=1024", 445, 38.1, "pooled"), ("pooled RVQ 256x2", 684, 37.2, "pooled"), ("pooled RVQ 1024x2", 889, 29.2, "pooled"), ("per-head VQ k=256", 342, 23.7, "per-head"), ("per-head RVQ 256x2", 684, 15.0, "per-head"), ("hybrid K x4, V x2", 1025, 11.2, "hybrid"))
FP16_BYTES = 36_864
#: Models (name, layers, key-value heads, dimension of a head).
MODELS = (("gpt2", 12, 12, 64), ("llama-3.1-8b", 32, 8, 128), ("llama-3.1-70b", 80, 8, 128))
#: Cells that are drawn (corners, ratio; 0 stands for the kissing ratio).
CELLS = ((3, 0.5), (4, 0.5), (6, 0.5), (24, 0.5), (24, 0.0))


def memory_bytes(vectors: Column, alphabet_chars: Column, span: Column | None = None, width: int = 8) -> Column:
    """2 numbers a vector, and the characters of the kept names and values."""
    size = vectors * (2 * width) + 8 + alphabet_chars
    return size if span is None else size + 4 + F.length(span.cast("string"))


def separation(points: DataFrame, key: str = "id", group: str = "grp") -> DataFrame:
    """(intra, inter, ratio, separates): mean distances of pairs inside and between groups, by sums; ratio above 2 separates.

    Pairs are of a small report table. ``key`` orders them, so each counts once.
    """
    a, b = points.alias("a"), points.alias("b")
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    same = F.col(f"a.{group}") == F.col(f"b.{group}")
    r = a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}")).agg(F.avg(F.when(same, d)).alias("intra"), F.avg(F.when(~same, d)).alias("inter"))
    ratio = F.when(F.col("intra") == 0, F.lit(float("inf"))).otherwise(F.col("inter") / F.col("intra"))
    return r.select(F.round("intra", 4).alias("intra"), F.round("inter", 4).alias("inter"), F.round(ratio, 2).alias("ratio"), (ratio > 2).alias("separates"))


def pareto(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, "label string, bytes_per_token int, ppl_pct double, family string").withColumn("ratio", F.lit(float(FP16_BYTES)) / F.col("bytes_per_token"))


def kv_footprint(spark: SparkSession) -> DataFrame:
    m = spark.createDataFrame(MODELS, "model string, layers int, kv_heads int, head_dim int")
    return m.withColumn("bytes_per_token", (F.col("layers") * F.col("kv_heads") * F.col("head_dim") * 4).cast("long"))


def cells(spark: SparkSession, configs=CELLS) -> DataFrame:
    """(n, kind, ratio, cell, corner, x, y, coverage): each cell is the polygon scaled by the ratio towards a vertex."""
    rows = []
    for n, ratio in configs:
        r = ratio or kissing_ratio(n)
        v = [(math.cos(math.pi / 2 - 2 * math.pi * i / n), math.sin(math.pi / 2 - 2 * math.pi * i / n)) for i in range(n)]
        rows += [(n, "kissing" if not ratio else "given", r, i, j, ax + r * (bx - ax), ay + r * (by - ay), n * r * r) for i, (ax, ay) in enumerate(v) for j, (bx, by) in enumerate(v)]
    return spark.createDataFrame(rows, "n int, kind string, ratio double, cell int, corner int, x double, y double, coverage double")


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON, as a report prints them."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))
