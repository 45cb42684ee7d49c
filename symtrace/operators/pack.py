"""The full-mantissa codec: symbols as digits of one number of 104 bits, 52 for each coordinate.

The first symbol is the least digit; an alphabet of one symbol counts as two. Arrow batches of numpy encode and
decode all numbers of a slice of rows at once, a digit of each after the other, in four limbs of 26 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symtrace.functions.symbols import MANTISSA, symbols_per_vector
from symtrace.operators import folds

_HALF = f"cast({1 << MANTISSA} as decimal(38,0))"
_LIMB = MANTISSA // 2
_VECTOR = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("xi", T.LongType()), T.StructField("yi", T.LongType())])
_ARCHIVE = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("length", "n", "base", "cpv")), T.StructField("alphabet", T.ArrayType(T.StringType())), T.StructField("vectors", T.ArrayType(_VECTOR))])


def _packed(ids: np.ndarray, at: np.ndarray, base: np.ndarray, cpv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of c, xi, yi, at) of texts' ids; base and cpv are each text's."""
    k = -(-np.diff(at) // np.maximum(cpv, 1))
    vec_at = folds.starts(k)
    row = folds.of_row(vec_at)
    s = at[row] + (np.arange(len(row)) - vec_at[row]) * cpv[row]
    c = np.minimum(cpv[row], at[row + 1] - s)
    o = np.argsort(-c, kind="stable")
    start, b = s[o], base[row][o]
    limbs = np.zeros((4, len(o)), np.int64)
    width = np.searchsorted(-c[o], -np.arange(int(c.max(initial=0))), side="left")
    for j in range(len(width) - 1, -1, -1):
        m = width[j]
        carry = ids[start[:m] + j]
        for limb in limbs:
            v = limb[:m] * b[:m] + carry
            carry, limb[:m] = v >> _LIMB, v & ((1 << _LIMB) - 1)
    out = np.empty((len(o), 3), np.int64)
    out[:, 0] = c
    out[o, 1], out[o, 2] = limbs[0] | limbs[1] << _LIMB, limbs[2] | limbs[3] << _LIMB
    return out, vec_at


def _unpacked(vectors: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The ids of vectors one after another; base is each vector's.

    Limbs are floats: what is divided stays below base * 2 ** 26, so quotients are below 2 ** 26 and their floors exact.
    """
    c = vectors[:, 0]
    at = folds.starts(c)
    o = np.argsort(-c, kind="stable")
    low = (1 << _LIMB) - 1
    limbs = np.stack([f(vectors[o, i]) for i in (2, 1) for f in (lambda v: v >> _LIMB, lambda v: v & low)]).astype(float)
    b, start = base[o].astype(float), at[:-1][o]
    out = np.empty(at[-1], np.int64)
    width = np.searchsorted(-c[o], -np.arange(int(c.max(initial=0))), side="left")
    for j, m in enumerate(width.tolist()):
        rest = np.zeros(m)
        for limb in limbs:
            v = rest * float(1 << _LIMB) + limb[:m]
            limb[:m] = np.floor(v / b[:m])
            rest = v - limb[:m] * b[:m]
        out[start[:m] + j] = rest
    return out


def _whole(v) -> pa.Array:
    return pa.array(np.asarray(v, np.int32))


def _batch(key: str, keys: pa.Array, length, n, base, cpv: np.ndarray, symbols: np.ndarray, first: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    parts = pa.StructArray.from_arrays([_whole(vectors[:, 0]), pa.array(vectors[:, 1]), pa.array(vectors[:, 2])], ["c", "xi", "yi"])
    known = pa.array(cpv.astype(np.int32), mask=cpv == 0)  # 0 stands for none
    return pa.record_batch({key: keys, "length": _whole(length), "n": _whole(n), "base": _whole(base), "cpv": known, "alphabet": folds.lists(folds.letters(symbols), np.diff(first)), "vectors": folds.lists(parts, np.diff(at))})


def _encoded(key: str, keys: pa.Array, points: np.ndarray, at: np.ndarray, alphabet: str | None = None) -> pa.RecordBatch:
    if alphabet:
        known, rows_ = folds.code_points(alphabet), len(at) - 1
        rank = np.full(0x110000, -1, np.int64)
        rank[known[::-1]] = np.arange(len(known))[::-1]
        ids = rank[points]
        if (ids < 0).any():
            raise ValueError(f"symbol outside the alphabet: {chr(points[int((ids < 0).argmax())])}")
        symbols, first = np.tile(known, rows_), np.arange(rows_ + 1) * len(known)
    else:
        symbols, first, ids = folds.alphabets(points, at)
    n = np.diff(first)
    base, cpv = np.maximum(n, 2), np.array([symbols_per_vector(int(i)) if i else 0 for i in n], np.int64)
    return _batch(key, keys, np.diff(at), n, base, cpv, symbols, first, *_packed(ids, at, base, cpv))


def _schema(df: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *_ARCHIVE])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", alphabet: str | None = None) -> DataFrame:
    """One row a text: key, length, n, base, cpv, alphabet and ``vectors`` of (c, xi, yi), coordinates times 2 ** 52."""

    def run(batches):
        for batch in batches:
            for rows_, points, at in folds.texts(batch):
                yield _encoded(key, rows_.column("_key"), points, at, alphabet)

    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, _schema(df, key))


def _slices(batch: pa.RecordBatch):
    """(rows, symbols, first, vectors, at): runs of rows of an archive, with their alphabets and vectors."""
    for lo, hi in folds.runs(folds.numbers(batch.column("length")), folds.SLICE):
        rows_ = batch.slice(lo, hi - lo)
        names, first = folds.flat(rows_.column("alphabet"))
        parts, at = folds.flat(rows_.column("vectors"))
        yield rows_, folds.decoded(names)[0], first, np.stack([folds.numbers(parts.field(f)) for f in ("c", "xi", "yi")], 1), at


def _texts(base: np.ndarray, symbols: np.ndarray, first: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, at) of an archive's rows."""
    row = folds.of_row(at)
    ids, ends = _unpacked(vectors, base[row]), folds.starts(vectors[:, 0])
    return symbols[np.repeat(first[row], vectors[:, 0]) + ids], ends[at]


def decode(archive: DataFrame) -> DataFrame:
    """Adds ``decoded``: digits are taken off one by one."""

    def run(batches):
        for batch in batches:
            for rows_, *parts in _slices(batch):
                text = folds.strings(*_texts(folds.numbers(rows_.column("base")), *parts))
                yield pa.record_batch([*rows_.columns, text], names=[*rows_.schema.names, "decoded"])

    return archive.mapInArrow(run, T.StructType([*archive.schema, T.StructField("decoded", T.StringType())]))


def rows(archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a vector: key, vec_no, c, xi, yi, x, y."""
    r = archive.select(key, F.posexplode("vectors").alias("vec_no", "w")).select(key, "vec_no", "w.*")
    return r.withColumn("x", F.col("xi") / float(1 << MANTISSA)).withColumn("y", F.col("yi") / float(1 << MANTISSA))


def char_at(archive: DataFrame, pos: str) -> DataFrame:
    """Adds ``symbol`` at the row's position from one vector; null outside the text."""
    d = archive.withColumn("_w", F.expr(f"get(vectors, cast({pos} div cpv as int))"))
    value = f"cast(cast(_w.yi as decimal(38,0)) * {_HALF} + _w.xi as decimal(38,0))"
    steps = f"aggregate(sequence(0, cast({pos} % cpv as int)), {value}, (v, j) -> if(j = 0, v, cast((v - v % base) / base as decimal(38,0))), v -> alphabet[cast(v % base as int)])"
    return d.withColumn("symbol", F.expr(f"if({pos} < 0 or {pos} >= length, null, {steps})")).drop("_w")


def append(archive: DataFrame, more: str, key: str = "doc_id") -> DataFrame:
    """The archive of each text with the column ``more`` behind it, as if encoded at once.

    Only the last vector, if it isn't full, is unpacked and packed again. A symbol outside the row's alphabet
    changes all digits, so such rows are decoded and encoded anew.
    """

    def run(batches):
        for batch in batches:
            for rows_, symbols, first, vectors, at in _slices(batch):
                length, n, base, cpv = (folds.numbers(rows_.column(c)) for c in ("length", "n", "base", "cpv"))
                new, new_at = folds.decoded(rows_.column("_more"))
                # ranks in each row's own alphabet
                own, row = folds.of_row(first) << 21 | symbols, folds.of_row(new_at)
                o = np.argsort(own, kind="stable")
                wanted = row << 21 | new
                place = o[np.minimum(np.searchsorted(own[o], wanted), len(own) - 1)] if len(own) else np.zeros(len(new), np.int64)
                known = own[place] == wanted if len(own) else np.zeros(len(new), bool)
                ids = place - first[row]
                fits = (length > 0) & (np.bincount(row[~known], minlength=len(length)) == 0)
                for kept in (True, False):
                    r = np.flatnonzero(fits == kept)
                    if not len(r):
                        continue
                    keys = rows_.column("_key").take(pa.array(r))
                    if not kept:
                        old = _texts(base[r], symbols, first[:-1][r], *folds.taken(vectors, at, r))
                        yield _encoded(key, keys, *folds.joined(*old, *folds.taken(new, new_at, r)))
                        continue
                    full = np.diff(at)[r] - (length[r] % cpv[r] > 0)
                    last = length[r] % cpv[r] > 0
                    tail = vectors[at[1:][r][last] - 1]
                    tail_at = folds.starts(np.where(last, length[r] % cpv[r], 0))
                    put, put_at = folds.joined(_unpacked(tail, base[r][last]), tail_at, *folds.taken(ids, new_at, r))
                    more_vectors, more_at = _packed(put, put_at, base[r], cpv[r])
                    kept_at = folds.starts(full)
                    whole = np.arange(kept_at[-1]) + np.repeat(at[:-1][r] - kept_at[:-1], full)
                    both, both_at = folds.joined(whole, kept_at, np.arange(len(more_vectors)) + len(vectors), more_at)
                    yield _batch(key, keys, length[r] + np.diff(new_at)[r], n[r], base[r], cpv[r], *folds.taken(symbols, first, r), np.concatenate([vectors, more_vectors])[both], both_at)

    names = [c.name for c in _ARCHIVE]
    return archive.select(F.col(key).alias("_key"), *names, F.col(more).alias("_more")).mapInArrow(run, _schema(archive, key))
