"""Where a recovered text differs from its original, and how bits are dealt to spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symtrace.operators import folds


def compared(df: DataFrame, key: str = "doc_id", original: str = "original", recovered: str = "recovered") -> DataFrame:
    """(key, n, bad): how many symbols an original has, and which of them, from 0, the recovered text lacks; one row a text with symbols, made within its row."""

    def run(batches):
        for batch in batches:
            for rows, a, at in folds.texts(batch, "a"):
                b, b_at = folds.decoded(rows.column("b"))
                row = folds.of_row(at)
                pos = np.arange(len(a)) - at[row]
                same = pos < np.diff(b_at)[row]
                same[same] = a[same] == b[(b_at[row] + pos)[same]]
                bad = ~same
                some = np.flatnonzero(np.diff(at))
                yield pa.record_batch({key: rows.column("_key").take(pa.array(some)), "n": pa.array(np.diff(at)[some]), "bad": folds.lists(pa.array(pos[bad].astype(np.int32)), np.bincount(row[bad], minlength=len(at) - 1)[some])})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("bad", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(key).alias("_key"), F.col(original).alias("a"), F.col(recovered).alias("b")).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch):
    """(rows, n, bad, at): runs of rows of ``compared``."""
    for lo, hi in folds.runs(folds.numbers(batch.column("n")), folds.SLICE):
        rows = batch.slice(lo, hi - lo)
        bad, at = folds.flat(rows.column("bad"))
        yield rows, folds.numbers(rows.column("n")), folds.numbers(bad), at


def regions(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, symbols, wrong, regions, first_bad, last_bad): runs of bad positions by gaps and islands; without any, first_bad and last_bad are -1."""

    def run(batches):
        for batch in batches:
            for rows, n, bad, at in _slices(batch):
                row = folds.of_row(at)
                starts = np.ones(len(bad), bool)
                starts[1:] = (row[1:] != row[:-1]) | (bad[1:] != bad[:-1] + 1)
                wrong, first, last = np.diff(at), np.full(len(n), -1, np.int32), np.full(len(n), -1, np.int32)
                some = wrong > 0
                first[some], last[some] = bad[at[:-1][some]], bad[at[1:][some] - 1]
                yield pa.record_batch({key: rows.column(key), "symbols": pa.array(n), "wrong": pa.array(wrong), "regions": pa.array(np.bincount(row[starts], minlength=len(n))), "first_bad": pa.array(first), "last_bad": pa.array(last)})

    schema = T.StructType([marks.schema[key], *(T.StructField(c, T.LongType()) for c in ("symbols", "wrong", "regions")), *(T.StructField(c, T.IntegerType()) for c in ("first_bad", "last_bad"))])
    return marks.mapInArrow(run, schema)


def damage_map(marks: DataFrame, width: int = 72, key: str = "doc_id") -> DataFrame:
    """(key, map): one character for each bucket of max(1, n div width) symbols: X over half bad, x some, . none."""

    def run(batches):
        for batch in batches:
            for rows, n, bad, at in _slices(batch):
                size = np.maximum(1, n // width)
                to = folds.starts(-(-n // size))
                row = folds.of_row(at)
                k = np.bincount(to[row] + bad // size[row], minlength=to[-1])
                of = folds.of_row(to)
                m = np.minimum(size[of], n[of] - (np.arange(to[-1]) - to[of]) * size[of])
                mark = np.where(k > m // 2, ord("X"), np.where(k > 0, ord("x"), ord(".")))
                yield pa.record_batch({key: rows.column(key), "map": folds.strings(mark, to)})

    return marks.mapInArrow(run, T.StructType([marks.schema[key], T.StructField("map", T.StringType())]))


def allocation(spans: DataFrame, policy: str, total: int = 1400, recent: int = 3, rest: int = 60, exact: int = 900, key: str = "doc_id") -> DataFrame:
    """Adds ``bits`` to (key, span_no): uniform, ramp (weights 1, 2, .. to the last span, 8 at least) or window (the last ``recent`` exact, charged ``exact``)."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    if policy == "uniform":
        bits = F.floor(F.lit(total) / n)
    elif policy == "ramp":
        weight = F.col("span_no") + 1
        bits = F.greatest(F.lit(8), F.floor(F.lit(total) * weight / F.sum(weight).over(w)))
    elif policy == "window":
        bits = F.when(F.col("span_no") >= n - recent, exact).otherwise(rest)
    else:
        raise ValueError(policy)
    return spans.withColumn("bits", bits.cast("int"))
