"""The ring walk: points contract towards a symbol's vertex on a circle; every m-th point is kept.

Texts are encoded and decoded in Arrow batches by the folds of ``symtrace.operators.folds``, a row at a time, so nothing
is shuffled and a row holds a few numbers for each of its symbols. A span's inversion ends at the anchor before it, so all
spans of a row are inverted at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symtrace.operators import folds

_POINT = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_ARCHIVE = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ratio", T.DoubleType()), T.StructField("span", T.IntegerType()), T.StructField("history", T.IntegerType()), T.StructField("alphabet", T.ArrayType(T.StringType())), T.StructField("points", T.ArrayType(_POINT))])


def _int(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int32))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", span: int | None = None) -> DataFrame:
    """One row a text: key, length, n, ratio, span, history, alphabet and ``points`` of (c, x, y); ``span`` may shorten the automatic one."""

    def run(batches):
        for batch in batches:
            for rows, points, at in folds.texts(batch):
                symbols, first, ids = folds.alphabets(points, at)
                n, length = np.diff(first), np.diff(at)
                walks = {int(i): folds.ring(int(i)) for i in np.unique(n[n > 0])}
                own = [walks.get(int(i)) for i in n]
                vertex = first[folds.of_row(at)] + ids
                vx, vy = (np.concatenate([np.zeros(0), *(getattr(w, f) for w in own if w)])[vertex] for f in ("vx", "vy"))
                x, y = folds.walked(at, vx, vy, np.array([w.ratio if w else 0.5 for w in own]), max((w.back for w in own if w), default=0))
                m = np.array([min(span or w.span, w.span) if w else 1 for w in own], np.int64)
                row, k = folds.of_row(folds.starts(-(-length // m))), -(-length // m)
                ends = np.minimum((np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + 1) * m[row], length[row])
                c = ends - np.where(np.r_[True, row[1:] != row[:-1]][: len(row)], 0, np.r_[0, ends[:-1]][: len(row)])
                last = at[row] + ends - 1
                parts = pa.StructArray.from_arrays([_int(c), pa.array(x[last]), pa.array(y[last])], ["c", "x", "y"])
                given = lambda values, kind: pa.array([v if w else None for v, w in zip(values, own)], kind)
                yield pa.record_batch({key: rows.column("_key"), "length": _int(length), "n": _int(n), "ratio": given([w and w.ratio for w in own], pa.float64()), "span": given(m.tolist(), pa.int32()), "history": given([w and w.back for w in own], pa.int32()), "alphabet": folds.lists(folds.letters(symbols), n), "points": folds.lists(parts, k)})

    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), *_ARCHIVE]))


def walk(df: DataFrame, key: str = "doc_id", text: str = "text", ratio: float | None = None) -> DataFrame:
    """All points: key, pos (0 is the centre), x, y. Another ratio than the kissing one must contract; it remembers 80 bits."""

    def run(batches):
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                if t is None:
                    continue
                alphabet, ids = folds.ranked(t)
                x, y = (np.r_[0.0, v] for v in folds.points(folds.ring(max(1, len(alphabet)), ratio), ids))
                for a in range(0, len(x), folds.BLOCK):
                    part = slice(a, a + folds.BLOCK)
                    yield pa.record_batch({key: batch.column("_key").take(pa.array(np.full(len(x[part]), i))), "pos": _int(np.arange(a, a + len(x[part]))), "x": pa.array(x[part]), "y": pa.array(y[part])})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, decoded, n_spans, n_repaired) of each text with symbols; raises where a span can't be decoded."""

    def run(batches):
        for batch in batches:
            for lo, hi in folds.runs(folds.flat(batch.column("points"))[1][1:] - folds.flat(batch.column("points"))[1][:-1], folds.SLICE // 16):
                rows = batch.slice(lo, hi - lo)
                flat, at = folds.flat(rows.column("points"))
                names, first = folds.flat(rows.column("alphabet"))
                symbols = folds.decoded(names)[0]
                c, x, y = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("c", "x", "y"))
                c, row, n = c.astype(np.int64), folds.of_row(at), folds.numbers(rows.column("n"))
                before = np.r_[True, row[1:] != row[:-1]][: len(row)]
                ax, ay = (np.where(before, 0.0, np.r_[0.0, v[:-1]][: len(v)]) for v in (x, y))
                to = folds.starts(c)
                ids, again = np.empty(to[-1], np.int64), np.zeros(len(c), bool)
                for size in np.unique(n).tolist():  # rows that share a walk are inverted at once
                    s = np.flatnonzero(n[row] == size)
                    got, again[s] = folds.inverted(folds.ring(size), x[s], y[s], c[s], ax[s], ay[s])
                    lost = np.flatnonzero(got[:, 0] < 0)
                    if len(lost):
                        raise ValueError(f"span can't be decoded: {s[lost[0]] - at[row[s[lost[0]]]]}")
                    r, j = np.nonzero(got >= 0)
                    ids[to[s[r]] + j] = got[r, j]
                text = folds.strings(symbols[np.repeat(first[row], c) + ids], to[at])
                yield pa.record_batch({key: rows.column(key), "decoded": text, "n_spans": pa.array(np.diff(at)), "n_repaired": pa.array(np.bincount(row[again], minlength=len(n)))})

    schema = T.StructType([T.StructField(key, archive.schema[key].dataType), T.StructField("decoded", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("n_repaired", T.LongType())])
    return archive.where("length > 0").select(key, "n", "alphabet", "points").mapInArrow(run, schema)


def decode_spans(parts: DataFrame) -> DataFrame:
    """Adds ``out`` (ids) and ``repaired`` to rows with n, c, (x, y) and the anchor (ax, ay); spans that can't be decoded have null."""

    def run(batches):
        for batch in batches:
            n, c = (batch.column(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("n", "c"))
            x, y, ax, ay = (batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in ("x", "y", "ax", "ay"))
            out, repaired = [None] * len(n), np.zeros(len(n), bool)
            for size in np.unique(n):
                rows = np.flatnonzero(n == size)
                ids, again = folds.inverted(folds.ring(int(size)), x[rows], y[rows], c[rows], ax[rows], ay[rows])
                repaired[rows] = again
                for i, line in zip(rows, ids):
                    out[i] = line[line >= 0] if not len(line) or line[0] >= 0 else None
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.int32())), pa.array(repaired)], names=[*batch.schema.names, "out", "repaired"])

    return parts.mapInArrow(run, T.StructType([*parts.schema, T.StructField("out", T.ArrayType(T.IntegerType())), T.StructField("repaired", T.BooleanType())]))


def append(archive: DataFrame, more: str, key: str = "doc_id") -> DataFrame:
    """The archive of each text with the column ``more`` behind it, as if encoded at once.

    Only the last span, if it isn't full, is inverted and folded again from its anchor. A symbol outside a row's
    alphabet moves all vertices, so such rows are decoded and encoded anew.
    """
    fits = F.expr(f"size(array_except(if(length({more}) > 0, split({more}, ''), cast(array() as array<string>)), alphabet)) = 0") & (F.col("length") > 0)
    names = [key, *(f.name for f in _ARCHIVE)]
    state = archive.withColumn("_fits", fits)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                kept, tail = r["points"], ""
                walk_ = folds.ring(r["n"])
                if kept and kept[-1]["c"] < r["span"]:
                    last, kept = kept[-1], kept[:-1]
                    a = kept[-1] if kept else {"x": 0.0, "y": 0.0}
                    ids, _ = folds.inverted(walk_, *(np.array([v]) for v in (last["x"], last["y"], last["c"], a["x"], a["y"])))
                    tail = "".join(r["alphabet"][i] for i in ids[0])
                symbols = folds.code_points("".join(r["alphabet"]))
                ids = np.searchsorted(symbols, folds.code_points(tail + (r["more"] or "")))
                a = kept[-1] if kept else {"x": 0.0, "y": 0.0}
                x, y = a["x"], a["y"]
                for s in range(0, len(ids), r["span"]):
                    part = ids[s : s + r["span"]]
                    for i in part:  # a walk's steps wait for each other; a span is a few of them
                        x, y = (float(v) for v in walk_.step(x, y, i))
                    kept.append({"c": len(part), "x": x, "y": y})
                r["points"], r["length"] = kept, r["length"] + len(r["more"] or "")
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=pa.schema([batch.schema.field(n) for n in names]))

    schema = T.StructType([archive.schema[key], *_ARCHIVE])
    grown = state.where("_fits").select(*names, F.col(more).alias("more")).mapInArrow(run, schema)
    rest = state.where("not coalesce(_fits, false)")
    was = decode(rest, key)
    again = rest.select(F.col(key), F.col(more).alias("_more")).join(was.select(key, "decoded"), key, "left").select(key, F.concat(F.coalesce("decoded", F.lit("")), F.coalesce("_more", F.lit(""))).alias("text"))
    return grown.unionByName(encode(again, key))


def char_at(archive: DataFrame, pos: str, key: str = "doc_id") -> DataFrame:
    """(key, pos, symbol) of each row's position inside its text; one span is decoded for each."""
    one = archive.where(f"{pos} >= 0 and {pos} < length").withColumn("_s", F.expr(f"cast({pos} div span as int)"))
    at = lambda f, i: f"coalesce(try_element_at(points, {i}).{f}, 0.0D)"
    parts = one.select(key, F.col(pos).alias("pos"), "span", "alphabet", "n", F.expr("points[_s].c").alias("c"), F.expr("points[_s].x").alias("x"), F.expr("points[_s].y").alias("y"), *(F.expr(f"if(_s = 0, 0.0D, {at(f, 'greatest(_s, 1)')})").alias("a" + f) for f in "xy"))
    return decode_spans(parts).select(key, "pos", F.expr("alphabet[out[cast(pos % span as int)]]").alias("symbol"))


def anchors(archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a span: key, span_no, c, x, y."""
    return archive.select(key, F.posexplode("points").alias("span_no", "w")).select(key, "span_no", "w.*")


def in_hull(points: DataFrame, n: int, tol: float = 0.0) -> DataFrame:
    """Adds ``inside``: whether (x, y) lies in the regular polygon of n corners on the unit circle: on the inner side of the edge that its direction meets."""
    if n < 3:
        return points.withColumn("inside", F.hypot("x", "y") <= 1 + tol)
    turn = F.atan2(F.col("x"), F.col("y")) * (n / (2 * math.pi))  # clockwise from the first corner, in edges
    middle = (F.floor(turn) + 0.5) * (2 * math.pi / n)
    return points.withColumn("inside", F.col("x") * F.sin(middle) + F.col("y") * F.cos(middle) - math.cos(math.pi / n) <= tol)


def previous_point(points: DataFrame, key: str = "doc_id") -> DataFrame:
    """The anchor as a window expression, for archives kept as rows: adds ax, ay."""
    w = Window.partitionBy(key).orderBy("span_no")
    return points.withColumn("ax", F.lag("x", 1, 0.0).over(w)).withColumn("ay", F.lag("y", 1, 0.0).over(w))
