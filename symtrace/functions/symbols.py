"""Symbols, alphabets and the constants that follow from an alphabet's size.

A symbol is one code point; an alphabet is the sorted distinct symbols of a text, and a symbol's id
its rank there. All are column expressions, so they stay in the JVM and need no shuffle.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANTISSA = 52
WALK_BITS = 44
HISTORY_BITS = 80
SIZES = 4096  #: alphabets whose constants are looked up


def symbols(text: Column) -> Column:
    """Code points in order; an empty array for null and empty texts."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def with_ids(df: DataFrame, text: str = "text", alphabet: str | None = None) -> DataFrame:
    """Adds ``alphabet`` (array), ``n`` (its size), ``ids`` (array<int>) and ``length``.

    A fixed alphabet is used as it stands; a symbol outside it raises.
    """
    df = df.withColumn("syms", symbols(F.col(text)))
    fixed = F.array(*map(F.lit, alphabet)) if alphabet else F.array_sort(F.array_distinct("syms"))
    df = df.withColumn("alphabet", fixed).withColumn("n", F.size("alphabet")).withColumn("length", F.size("syms"))
    rank = "cast(array_position(alphabet, c) as int) - 1"
    if alphabet:
        rank = f"if(array_contains(alphabet, c), {rank}, raise_error(concat('symbol outside the alphabet: ', c)))"
    return df.withColumn("ids", F.expr(f"transform(syms, c -> {rank})"))


@lru_cache(maxsize=SIZES)
def symbols_per_vector(n: int) -> int:
    """Largest c with n ** c <= 2 ** 104, by whole numbers; 104 below two symbols."""
    if n < 2:
        return 2 * MANTISSA
    c = 0
    while n ** (c + 1) <= 1 << (2 * MANTISSA):
        c += 1
    return c


def kissing_ratio(n: int) -> float:
    """Contraction at which the n cells of a regular polygon touch and don't overlap."""
    return 0.5 if n <= 4 else 1.0 / (2.0 * (1.0 + sum(math.cos(2.0 * math.pi * k / n) for k in range(1, n // 4 + 1))))


def walk_span(n: int, bits: int = WALK_BITS) -> int:
    """Inversions of the ring walk that 64-bit floats bear."""
    return max(1, int(bits / math.log2(1.0 / kissing_ratio(n))))


def history(n: int) -> int:
    """Symbols after which an earlier one no longer changes a 64-bit point."""
    return math.ceil(HISTORY_BITS / math.log2(1.0 / kissing_ratio(n)))


def grid_side(n: int) -> int:
    """Smallest power of two k, 2 at least, with k * k >= n."""
    k = 2
    while k * k < n:
        k *= 2
    return k


def with_sizes(df: DataFrame) -> DataFrame:
    """Adds cpv, k, lg and grid_span from the row's alphabet size ``n``; null without symbols.

    A table of ``SIZES`` rows is broadcast, which also keeps what was computed of a row from being computed anew for each of
    its spans. Larger alphabets go by logarithms: only powers of two come within 1e-12 of a whole number, and are one.
    """
    known = df.sparkSession.createDataFrame([(n, symbols_per_vector(n), grid_side(n).bit_length() - 1) for n in range(1, SIZES + 1)], "n int, _cpv int, _lg int")
    n = F.when(F.col("n") > 0, F.greatest("n", F.lit(2)))
    d = df.join(F.broadcast(known), "n", "left")
    d = d.withColumn("cpv", F.coalesce("_cpv", F.floor(2 * MANTISSA / F.log2(n) + 1e-12).cast("int"))).withColumn("lg", F.coalesce("_lg", F.greatest(F.lit(1), F.ceil(F.log2(n) / 2 - 1e-12).cast("int")))).drop("_cpv", "_lg")
    return d.withColumn("k", F.expr("cast(shiftleft(1, lg) as int)")).withColumn("grid_span", F.expr("cast(51 div lg as int)"))


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("span", T.IntegerType()), T.StructField("history", T.IntegerType())]))
def ring_sizes(n: pd.Series) -> pd.DataFrame:
    """What the ring walk makes of an alphabet's size."""
    return pd.DataFrame([(kissing_ratio(i), walk_span(i), history(i)) for i in n], columns=["ratio", "span", "history"])
