"""The grid codec: k x k vertices, k a power of two, and whole numbers for coordinates.

A span of c symbols with digits (g_j, h_j) is the point whose coordinates, times 2 ** (c lg k + 1), are
2 * sum(g_j k ** j) + 1 and the same of h_j, so an archive row keeps those sums as BIGINT. Every span
starts anew from the centre, so spans are independent of each other: encoding and decoding are row-local, in Arrow
batches of numpy, all symbols of a slice of rows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symtrace.functions.symbols import grid_side
from symtrace.operators import folds

_SPAN = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("ix", T.LongType()), T.StructField("iy", T.LongType())])
_ARCHIVE = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("length", "n")), T.StructField("alphabet", T.ArrayType(T.StringType())), *(T.StructField(c, T.IntegerType()) for c in ("k", "lg", "grid_span")), T.StructField("spans", T.ArrayType(_SPAN))])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a text: key, length, n, alphabet, k, lg, grid_span and ``spans`` of (c, ix, iy)."""

    def run(batches):
        for batch in batches:
            for rows_, points, at in folds.texts(batch):
                symbols, first, ids = folds.alphabets(points, at)
                n, length = np.diff(first), np.diff(at)
                lg = np.array([grid_side(int(i)).bit_length() - 1 for i in n], np.int64)
                m = 51 // lg
                spans = -(-length // m)
                row = folds.of_row(at)
                pos = np.arange(len(ids)) - at[row]
                shift = lg[row] * (pos % m[row])
                start = np.flatnonzero(pos % m[row] == 0)
                digit = lambda v: pa.array(np.add.reduceat(v << shift, start) if len(start) else np.zeros(0, np.int64))
                parts = pa.StructArray.from_arrays([_int(np.diff(np.r_[start, len(ids)])), digit(ids & ((1 << lg[row]) - 1)), digit(ids >> lg[row])], ["c", "ix", "iy"])
                yield pa.record_batch({key: rows_.column("_key"), "length": _int(length), "n": _int(n), "alphabet": folds.lists(folds.letters(symbols), n), "k": _int(1 << lg), "lg": _int(lg), "grid_span": _int(m), "spans": folds.lists(parts, spans)})

    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), *_ARCHIVE]))


def _int(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int32))


def decode(archive: DataFrame) -> DataFrame:
    """Adds ``decoded``, the text."""

    def run(batches):
        for batch in batches:
            for lo, hi in folds.runs(folds.numbers(batch.column("length")), folds.SLICE):
                rows_ = batch.slice(lo, hi - lo)
                spans, span_at = folds.flat(rows_.column("spans"))
                names, first = folds.flat(rows_.column("alphabet"))
                symbols = folds.decoded(names)[0]
                c, ix, iy = (folds.numbers(spans.field(f)) for f in ("c", "ix", "iy"))
                lg = folds.numbers(rows_.column("lg"))
                at = folds.starts(c)
                span = folds.of_row(at)
                row = folds.of_row(span_at)[span]
                shift = lg[row] * (np.arange(at[-1]) - at[span])
                ids = (ix[span] >> shift & ((1 << lg[row]) - 1)) + ((iy[span] >> shift & ((1 << lg[row]) - 1)) << lg[row])
                yield pa.record_batch([*rows_.columns, folds.strings(symbols[first[row] + ids], at[span_at])], names=[*rows_.schema.names, "decoded"])

    return archive.mapInArrow(run, T.StructType([*archive.schema, T.StructField("decoded", T.StringType())]))


def rows(archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a span: key, span_no, c, ix, iy and the point (x, y)."""
    r = archive.select(key, "lg", F.posexplode("spans").alias("span_no", "s")).select(key, "lg", "span_no", "s.*")
    scale = F.pow(F.lit(2.0), -(F.col("c") * F.col("lg") + 1))
    return r.withColumn("x", (F.col("ix") * 2 + 1) * scale).withColumn("y", (F.col("iy") * 2 + 1) * scale).drop("lg")


def char_at(archive: DataFrame, pos: str) -> DataFrame:
    """Adds ``symbol`` at the row's position, from one span; null outside the text."""
    found = f"""if({pos} < 0 or {pos} >= length, null, alphabet[cast(
        (shiftright(spans[cast({pos} div grid_span as int)].ix, cast(lg * ({pos} % grid_span) as int)) & (k - 1))
        + k * (shiftright(spans[cast({pos} div grid_span as int)].iy, cast(lg * ({pos} % grid_span) as int)) & (k - 1)) as int)])"""
    return archive.withColumn("symbol", F.expr(found))
