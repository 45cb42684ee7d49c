"""Search on stored points: substrings, radius joins, nearest points, precision and recall.

Points of a corpus share one alphabet. A radius join is an equi-join on grid cells of side 2 tau, each
query looking into its 3 x 3 cells, then the exact distance; no pair is made outside those cells.
Where only counts, medians or the nearest are asked for, texts are walked and searched a slice at a time in
their task (``occurrence_counts``, ``radius_counts``, ``precision_counts``, ``nearest_in_texts``, ``decay``): no point leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from symtrace.operators import folds

LENGTHS = (3, 4, 6, 8, 12)
FEW = 100_000  #: queries, of a few dozen bytes each, that are handed to all tasks at once; more go in blocks or by shuffle


def corpus_alphabet(df: DataFrame, text: str = "text") -> list[str]:
    """Sorted distinct symbols of all texts; at most one entry for each code point comes to the driver."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, points, _ in folds.texts(batch):
                seen = np.union1d(seen, np.flatnonzero(np.bincount(points)))
        yield pa.record_batch({"sym": pa.array(list(folds.as_text(seen)), pa.string())})

    return sorted(r.sym for r in df.select(F.col(text).alias("text")).mapInArrow(run, "sym string").distinct().collect())


def _walk(n: int, kind: str) -> folds.Walk:
    return folds.ring(max(n, 1)) if kind == "ring" else folds.grid(max(n, 1))


def _ids(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ranks in the alphabet; -1 outside it."""
    top = max(int(points.max(initial=0)), int(known.max(initial=0)))
    rank = np.full(top + 1, -1, np.int64)
    rank[known] = np.arange(len(known))
    return rank[points]


def _known(points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ranks in the alphabet; a symbol outside it raises."""
    ids = _ids(points, known)
    if (ids < 0).any():
        raise ValueError(f"symbol outside the alphabet: {chr(points[int((ids < 0).argmax())])}")
    return ids


def walk_index(df: DataFrame, alphabet: list[str], kind: str = "ring", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, x, y): the point after each prefix of every text, pos 1 to its length; a symbol outside the alphabet raises."""
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)

    def run(batches):
        for batch in batches:
            for rows, points, at in folds.texts(batch):
                x, y = folds.walk_texts(w, _known(points, known), at)
                row, pos = folds.of_row(at), _positions(at)
                for a in range(0, len(x), folds.BLOCK):
                    part = slice(a, a + folds.BLOCK)
                    yield pa.record_batch({key: rows.column("_key").take(pa.array(row[part])), "pos": pa.array(pos[part]), "x": pa.array(x[part]), "y": pa.array(y[part])})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _positions(at: np.ndarray) -> np.ndarray:
    """1, 2, .. within each text."""
    return (np.arange(1, at[-1] + 1) - np.repeat(at[:-1], np.diff(at))).astype(np.int32)


def query_points(queries: DataFrame, alphabet: list[str], kind: str = "ring") -> DataFrame:
    """Adds q, qx, qy and tau to (query_id, query); queries without symbols or with some outside the alphabet go."""
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("query").to_pylist()):
                ids = _ids(folds.code_points(t), known) if t and len(known) else np.zeros(0, np.int64)
                if len(ids) and (ids >= 0).all():
                    x, y = w.start, w.start
                    for s in ids:
                        x, y = w.step(x, y, s)
                    rows.append(i)
                    out.append((len(ids), float(x), float(y), (2.0 if kind == "ring" else 2.0**0.5) * w.ratio ** len(ids) + 1e-12))
            q, x, y, tau = zip(*out) if out else [()] * 4
            yield pa.record_batch([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(q, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(tau, pa.float64())], names=[*batch.schema.names, "q", "qx", "qy", "tau"])

    more = [T.StructField("q", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("qx", "qy", "tau"))]
    return queries.mapInArrow(run, T.StructType([*queries.schema, *more]))


def radius_join(points: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, q, key, pos, d2) with d2 <= tau ** 2. Queries carry q, qx, qy, tau; those of one tau share a grid of cells.

    Up to ``FEW`` queries, by count, their cells are broadcast, so points stay where they are; more meet points by a shuffle of cells.
    """
    queries = queries.select("query_id", "q", "tau", "qx", "qy")
    taus = queries.select("q", "tau").distinct()
    o = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    beside = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in o)))
    cell = lambda c: F.floor(F.col(c) / (2 * F.col("tau")))
    cells = queries.withColumn("o", beside).select("query_id", "q", "tau", "qx", "qy", (cell("qx") + F.col("o.i")).alias("cx"), (cell("qy") + F.col("o.j")).alias("cy"))
    if queries.count() <= FEW:
        cells = F.broadcast(cells)
    # a row for each point and length of query: lengths are few, points many
    spread = points.crossJoin(F.broadcast(taus)).withColumn("cx", cell("x")).withColumn("cy", cell("y")).drop("tau")
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    return spread.join(cells, ["q", "cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= F.col("tau") * F.col("tau")).select("query_id", "q", key, "pos", "d2")


_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 18  #: bits of the tables that tell at once that a hash is of no query
_SHIFT = np.uint64(64 - _TABLE)
PAIRS = 1 << 20  #: pairs of a symbol or point and a query that are compared at once


def _longer(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Rolling hashes, one symbol longer."""
    h = (h + points.astype(np.uint64) + np.uint64(1)) * _ODD
    return h ^ (h >> np.uint64(29))


class _Keys:
    """Queries by 64-bit keys, of which one query may have several: which of many keys are a query's."""

    def __init__(self, keys: np.ndarray, query: np.ndarray):
        pairs = np.unique(np.stack([keys.view(np.int64), query.astype(np.int64)], 1), axis=0)
        self.query = pairs[:, 1]
        self.keys, first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.r_[first, len(pairs)]
        self.open = np.zeros(1 << _TABLE, bool)
        self.open[self._place(self.keys.view(np.uint64))] = True

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD) >> _SHIFT

    def pairs(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which key, query), about ``PAIRS`` at a time."""
        i = np.flatnonzero(self.open[self._place(keys)])
        k = np.minimum(np.searchsorted(self.keys, keys[i].view(np.int64)), len(self.keys) - 1)
        hit = self.keys[k] == keys[i].view(np.int64)
        i, k = i[hit], k[hit]
        n = self.first[k + 1] - self.first[k]
        ends, lo = np.cumsum(n), 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            m = n[lo:hi]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(i[lo:hi], m), self.query[np.repeat(self.first[k[lo:hi]], m) + within]
            lo = hi


class _Substrings:
    """Texts of queries, found in texts that lie one after another: by hashes of the shortest query's length, then of each length, then symbol by symbol."""

    def __init__(self, queries: list[str]):
        points = [folds.code_points(t) for t in queries]
        size = np.array([len(p) for p in points])
        self.least = int(size.min(initial=1 << 30))
        self.lengths = []
        for q in np.unique(size).tolist():
            own = np.flatnonzero(size == q)
            spelt = np.stack([points[i] for i in own])
            h = np.zeros(len(own), np.uint64)
            for j in range(q):
                h = _longer(h, spelt[:, j])
            self.lengths.append((q, _Keys(h, np.arange(len(own))), own, spelt))
        h = np.zeros(len(points), np.uint64)
        for j in range(self.least if points else 0):
            h = _longer(h, np.array([p[j] for p in points]))
        self.starts = _Keys(h, np.arange(len(points))) if points else None

    def find(self, points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(start, query, length of the query), at most about ``PAIRS`` at a time; none reaches from one text into the next."""
        n = len(points) - self.least + 1
        if n <= 0 or self.starts is None:
            return
        h = np.zeros(n, np.uint64)
        for j in range(self.least):
            h = _longer(h, points[j : j + n])
        a = np.flatnonzero(self.starts.open[self.starts._place(h)])
        h, size = h[a], self.least
        room = at[np.searchsorted(at, a, side="right")] - a
        for q, known, own, spelt in self.lengths:
            on = room >= q
            a, h, room = a[on], h[on], room[on]
            for j in range(size, q):
                h = _longer(h, points[a + j])
            size = q
            for i, query in known.pairs(h):
                same = np.ones(len(i), bool)
                for j in range(q):
                    same &= points[a[i] + j] == spelt[query, j]
                yield a[i[same]], own[query[same]], q


def _wanted(queries: DataFrame) -> Iterator[list[tuple]]:
    """(query_id, query) of queries with symbols, ``FEW`` at a time, once at least; a query set is stated by its caller."""
    wanted = [(r.query_id, r.query) for r in queries.select("query_id", "query").where("length(query) > 0").toLocalIterator()]
    for a in range(0, max(1, len(wanted)), FEW):
        yield wanted[a : a + FEW]


def _in_blocks(blocks, search) -> DataFrame:
    """What one search for each block of queries finds."""
    out = None
    for block in blocks:
        one = search(block)
        out = one if out is None else out.unionByName(one)
    return out


def _id_type(queries: DataFrame):
    return pa.int64() if isinstance(queries.schema["query_id"].dataType, T.LongType) else None


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.col(text).alias("text"))


def occurrences(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, q, key, pos): overlapping places where the query ends, 1-based.

    A text slides past the queries' hashes within its row, one length of query after the other, and hits are compared
    symbol by symbol. The queries go to all tasks, ``FEW`` at a time; each block of them is one pass.
    """
    schema = T.StructType([queries.schema["query_id"], T.StructField("q", T.IntegerType()), T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType())])
    kind = _id_type(queries)

    def search(block):
        ids, known = pa.array([i for i, _ in block], kind), _Substrings([t for _, t in block])

        def run(batches):
            for batch in batches:
                for rows, points, at in folds.texts(batch):
                    for a, query, q in known.find(points, at):
                        row = np.searchsorted(at, a, side="right") - 1
                        yield pa.record_batch([ids.take(pa.array(query)), pa.array(np.full(len(a), q, np.int32)), rows.column("_key").take(pa.array(row)), pa.array((a - at[row] + q).astype(np.int32))], names=schema.names)

        return _rows(df, key, text).mapInArrow(run, schema)

    return _in_blocks(_wanted(queries), search)


class _Tally:
    """How often each whole number came, as sorted distinct ones; merged as they double, so memory follows their number."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, 1 << 20

    def add(self, values: np.ndarray) -> None:
        u, n = np.unique(values, return_counts=True)
        self.parts.append((u, n))
        self.size += len(u)
        if self.size > self.limit:
            self.limit = max(self.limit, 2 * len(self.all()[0]))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            values = np.concatenate([u for u, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
            counts = np.concatenate([n for _, n in self.parts]) if self.parts else np.zeros(0, np.int64)
            u, place = np.unique(values, return_inverse=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, place, counts)
            self.parts, self.size = [(u, total)], len(u)
        return self.parts[0]

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        got = self.all()
        self.parts, self.size, self.limit = [], 0, 1 << 20
        return got


def _pair_counts(df: DataFrame, queries: DataFrame, name: str, blocks, searcher, key: str, text: str) -> DataFrame:
    """(query_id, key, ``name``): how often ``searcher(block)`` yields (place, query) in each text, places counting on through a slice's texts."""
    schema = T.StructType([queries.schema["query_id"], T.StructField(key, df.schema[key].dataType), T.StructField(name, T.LongType())])
    kind = _id_type(queries)

    def search(block):
        ids, find, many = pa.array([r[0] for r in block], kind), searcher(block), max(1, len(block))

        def run(batches):
            for batch in batches:
                for rows, points, at in folds.texts(batch):
                    tally = _Tally()
                    for a, query in find(points, at):
                        tally.add((np.searchsorted(at, a, side="right") - 1) * many + query)
                    pair, n = tally.all()
                    for b in range(0, len(pair), folds.BLOCK):
                        part = slice(b, b + folds.BLOCK)
                        yield pa.record_batch([ids.take(pa.array(pair[part] % many)), rows.column("_key").take(pa.array(pair[part] // many)), pa.array(n[part])], names=schema.names)

        return _rows(df, key, text).mapInArrow(run, schema)

    return _in_blocks(blocks, search)


def occurrence_counts(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, n_true): in how many places of each text a query occurs, where it does; ``occurrences`` counted where they are made."""

    def searcher(block):
        known = _Substrings([t for _, t in block])
        return lambda points, at: ((a, query) for a, query, _ in known.find(points, at))

    return _pair_counts(df, queries, "n_true", _wanted(queries), searcher, key, text)


class _Disc:
    """Query points by cells of side 2 tau, one set of cells for each tau: which points lie within tau."""

    def __init__(self, qx, qy, tau):
        self.qx, self.qy, self.tau = (np.array(v, float) for v in (qx, qy, tau))
        self.cells = []
        for tau in np.unique(self.tau):
            own = np.flatnonzero(self.tau == tau)
            keys = [self._cell(self.qx[own], self.qy[own], tau, i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            self.cells.append((float(tau), _Keys(np.concatenate(keys), np.tile(own, 9))))

    @staticmethod
    def _cell(x, y, tau, i=0, j=0):
        cx, cy = (np.floor(v / (2 * tau)).astype(np.int64).view(np.uint64) for v in (x, y))
        return (cx + np.uint64(i % (1 << 64))) * _ODD + (cy + np.uint64(j % (1 << 64)))

    def within(self, x, y, query) -> np.ndarray:
        dx, dy = x - self.qx[query], y - self.qy[query]
        return dx * dx + dy * dy <= self.tau[query] * self.tau[query]

    def find(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which point, query) of all that lie within tau, at most about ``PAIRS`` at a time."""
        for tau, known in self.cells:
            for i, query in known.pairs(self._cell(x, y, tau)):
                near = self.within(x[i], y[i], query)
                yield i[near], query[near]


def _placed(queries: DataFrame, most: int = FEW) -> Iterator[list[tuple]]:
    """(query_id, query, qx, qy, tau) of ``query_points``, ``most`` at a time, once at least."""
    placed = [(r.query_id, r.query, r.qx, r.qy, r.tau) for r in queries.select("query_id", "query", "qx", "qy", "tau").toLocalIterator()]
    for a in range(0, max(1, len(placed)), most):
        yield placed[a : a + most]


def radius_counts(df: DataFrame, queries: DataFrame, alphabet: list[str], kind: str = "ring", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, n_found): how many points of each text's walk lie within a query's tau, where some do; ``radius_join`` counted where it is made."""
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)

    def searcher(block):
        disc = _Disc(*([r[c] for r in block] for c in (2, 3, 4)))
        return lambda points, at: disc.find(*folds.walk_texts(w, _known(points, known), at))

    return _pair_counts(df, queries, "n_found", _placed(queries), searcher, key, text)


def _rounded(v: np.ndarray, precision: str) -> np.ndarray:
    return v if precision == "f64" else v.astype({"f32": np.float32, "f16": np.float16}[precision]).astype(float)


MANY = 1 << 22  #: distinct stored points of a task that wait for their queries


def precision_counts(df: DataFrame, queries: DataFrame, alphabet: list[str], kind: str = "ring", precision: str = "f64", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, q, n_found, n_true, n_both, precision, recall) of points kept at a precision, one row a query; nothing found has precision 0.

    As ``precision_recall`` of ``radius_join`` and ``occurrences``, but points and true places are made, met and counted in the
    text's task. At 16 bits many points are equal, so distinct ones and their numbers meet the queries; a task keeps ``MANY`` of
    them at most before they do.
    """
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)
    placed = query_points(queries.select("query_id", "query").where("length(query) > 0"), alphabet, kind)
    placed = placed if precision == "f64" else widened(placed, precision)
    schema = T.StructType([queries.schema["query_id"], *(T.StructField(c, T.LongType()) for c in ("n_found", "n_true", "n_both"))])
    id_type = _id_type(queries)

    def search(block):
        ids, disc, spelt = pa.array([r[0] for r in block], id_type), _Disc(*([r[c] for r in block] for c in (2, 3, 4))), _Substrings([r[1] for r in block])
        many = len(block)

        def run(batches):
            found, true, both = (np.zeros(many, np.int64) for _ in range(3))
            waiting = _Tally()

            def meet():
                at, n = waiting.take()
                x, y = ((at >> s & 0xFFFF).astype(np.uint16).view(np.float16).astype(float) for s in (16, 0))
                for i, query in disc.find(x, y):
                    np.add.at(found, query, n[i])

            for batch in batches:
                for _, points, at in folds.texts(batch):
                    x, y = folds.walk_texts(w, _known(points, known), at)
                    x, y = _rounded(x, precision), _rounded(y, precision)
                    if precision == "f16":
                        waiting.add(x.astype(np.float16).view(np.uint16).astype(np.int64) << 16 | y.astype(np.float16).view(np.uint16))
                        if waiting.size > MANY:
                            meet()
                    else:
                        for _, query in disc.find(x, y):
                            found += np.bincount(query, minlength=many)
                    for a, query, q in spelt.find(points, at):
                        true += np.bincount(query, minlength=many)
                        both += np.bincount(query[disc.within(x[a + q - 1], y[a + q - 1], query)], minlength=many)
            meet()
            yield pa.record_batch([ids, pa.array(found), pa.array(true), pa.array(both)], names=schema.names)

        return df.select(F.col(text).alias("text")).mapInArrow(run, schema)

    c = _in_blocks(_placed(placed), search).groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("n_found", "n_true", "n_both")))
    return _with_shares(queries.select("query_id", F.length("query").alias("q")).join(c, "query_id", "left"))


def _with_shares(counts: DataFrame) -> DataFrame:
    r = counts.na.fill(0, ["n_found", "n_true", "n_both"])
    share = lambda part: F.when(F.col(part) > 0, F.col("n_both") / F.col(part)).otherwise(F.lit(0.0))
    return r.select("query_id", "q", "n_found", "n_true", "n_both").withColumn("precision", share("n_found")).withColumn("recall", share("n_true"))


def precision_recall(found: DataFrame, truth: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, q, n_found, n_true, n_both, precision, recall); nothing found has precision 0.

    What is found may be far more than what is true, so it is counted where it is made and meets true hits by broadcast if these are counted to be few.
    """
    truth = truth.select("query_id", key, "pos").withColumn("t", F.lit(1))
    if (n := truth.groupBy("query_id").count().agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]) <= 10 * FEW:
        truth = truth.repartition(max(1, n // FEW)) if n else truth
        met = found.select("query_id", key, "pos").join(F.broadcast(truth), ["query_id", key, "pos"], "left")
    else:
        met = found.select("query_id", key, "pos").join(truth, ["query_id", key, "pos"], "left")
    f = met.groupBy("query_id").agg(F.count("*").alias("n_found"), F.count("t").alias("n_both"))
    t = truth.groupBy("query_id").agg(F.count("*").alias("n_true"))
    return _with_shares(queries.select("query_id", F.length("query").alias("q")).join(f, "query_id", "left").join(t, "query_id", "left"))


def nearest(points: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, pos, d2): the nearest point of each query, first by d2, key, pos.

    Each Arrow batch of points keeps one candidate for a query; what is shuffled is one row a batch and query. The queries go to all
    tasks, ``FEW`` // 10 at a time; each block of them is one pass over the points.
    """
    wanted = [(r.query_id, r.qx, r.qy) for r in queries.select("query_id", "qx", "qy").toLocalIterator()]
    schema = T.StructType([queries.schema["query_id"], T.StructField("d2", T.DoubleType()), points.schema[key], T.StructField("pos", T.IntegerType())])

    def search(block):
        ids = pa.array([i for i, _, _ in block])
        qx, qy = np.array([x for _, x, _ in block]), np.array([y for _, _, y in block])

        def run(batches):
            for batch in batches:
                x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
                if not len(x):
                    continue
                least, at = np.full(len(qx), np.inf), np.zeros(len(qx), np.int64)
                # by direction: the points that could be nearest lie in a strip around the query's x
                order = np.argsort(x, kind="stable")
                sx, sy = x[order], y[order]
                width = 64
                todo = np.arange(len(qx))
                while len(todo):
                    lo = np.clip(np.searchsorted(sx, qx[todo]) - width // 2, 0, max(0, len(sx) - width))
                    hi = np.minimum(lo + width, len(sx))
                    for j, q in enumerate(todo):
                        d2 = (sx[lo[j] : hi[j]] - qx[q]) ** 2 + (sy[lo[j] : hi[j]] - qy[q]) ** 2
                        least[q] = d2.min()
                        at[q] = order[lo[j] : hi[j]][d2 == least[q]].min()  # the first of equally near ones
                    gap = np.minimum(np.where(lo > 0, qx[todo] - sx[lo], np.inf), np.where(hi < len(sx), sx[hi - 1] - qx[todo], np.inf))
                    todo = todo[(least[todo] >= gap**2) & ((lo > 0) | (hi < len(sx)))]
                    width *= 8
                yield pa.record_batch([ids, pa.array(least), batch.column(key).take(pa.array(at)), batch.column("pos").take(pa.array(at))], names=schema.names)

        return points.select(key, "pos", "x", "y").mapInArrow(run, schema)

    out = None
    for a in range(0, max(1, len(wanted)), FEW // 10):
        if block := wanted[a : a + FEW // 10]:
            one = search(block)
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = points.where("false").select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(0.0).alias("d2"), key, "pos")
    return out.groupBy("query_id").agg(F.min(F.struct("d2", key, "pos")).alias("hit")).select("query_id", "hit.*")


def nearest_in_texts(df: DataFrame, queries: DataFrame, alphabet: list[str], kind: str = "ring", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, pos, d2): ``nearest`` of the texts' walks, made in their tasks; a task hands on one row a query.

    Once a task has a distance for each query, only points in cells that reach into a circle of that distance are compared: the squares
    of distances are put into powers of four, and queries of one power share a set of cells.
    """
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)
    schema = T.StructType([queries.schema["query_id"], T.StructField("d2", T.DoubleType()), T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType())])
    id_type = _id_type(queries)

    def search(block):
        ids, qx, qy = [r[0] for r in block], *(np.array([r[c] for r in block], float) for c in (2, 3))

        def run(batches):
            least, hit = np.full(len(qx), np.inf), [None] * len(qx)

            def better(query: int, d2: np.ndarray, at: np.ndarray, keys, pos) -> None:
                best = float(d2.min())
                one = min((keys[i].as_py(), int(pos[i])) for i in at[d2 == best])
                if best < least[query] or one < hit[query]:
                    least[query], hit[query] = best, one

            for batch in batches:
                for rows, points, at in folds.texts(batch):
                    if not len(points):
                        continue
                    x, y = folds.walk_texts(w, _known(points, known), at)
                    pos, keys = _positions(at), rows.column("_key").take(pa.array(folds.of_row(at)))
                    a, size = 0, 256
                    while a < len(x):  # ever longer runs, as distances shrink
                        px, py = x[a : a + size], y[a : a + size]
                        if hit and hit[0] is None:
                            for j in range(len(qx)):
                                d2 = (px - qx[j]) ** 2 + (py - qy[j]) ** 2
                                better(j, d2[d2 == d2.min()], a + np.flatnonzero(d2 == d2.min()), keys, pos)
                        else:
                            disc = _Disc(qx, qy, np.exp2(np.ceil(np.log2(np.maximum(np.sqrt(least), 1e-12)))))
                            for i, query in disc.find(px, py):
                                d2 = (px[i] - qx[query]) ** 2 + (py[i] - qy[query]) ** 2
                                on = d2 <= least[query]
                                i, query, d2 = i[on], query[on], d2[on]
                                lowest = np.full(len(qx), np.inf)
                                np.minimum.at(lowest, query, d2)
                                on = d2 == lowest[query]
                                i, query, d2 = i[on], query[on], d2[on]
                                for j in np.unique(query):
                                    better(j, d2[query == j], a + i[query == j], keys, pos)
                        a, size = a + size, min(2 * size, folds.BLOCK)
            got = [j for j, h in enumerate(hit) if h is not None]
            yield pa.record_batch([pa.array([ids[j] for j in got], id_type), pa.array(least[got]), pa.array([hit[j][0] for j in got], keys_type), pa.array([hit[j][1] for j in got], pa.int32())], names=schema.names)

        return _rows(df, key, text).mapInArrow(run, schema)

    keys_type = to_arrow_type(df.schema[key].dataType)
    out = _in_blocks(_placed(queries, FEW // 10), search)
    return out.groupBy("query_id").agg(F.min(F.struct("d2", key, "pos")).alias("hit")).select("query_id", "hit.*")


BINS = 39  #: low bits of a distance that the first pass of ``decay`` leaves out; 8,192 bins for each power of two are left
EXACT = 2_000_000  #: distances, or fewer, of the medians' bins that are counted one by one


def decay(df: DataFrame, alphabet: list[str], kind: str, theory: Column, cap: int = 30, least: int = 5, keep_zero: bool = False, step: int = 7919, text: str = "text") -> DataFrame:
    """(suffix, n, median_distance, theory): each point of a text with that of place (pos * step mod length) + 1, by their common suffix.

    Both points, and the symbols before them, are in the row, so pairs are made there. Medians are exact: a pass counts distances by
    their upper bits, in tasks, and the next only those that share the bits of the medians' bins, by more bits; with all bits, a bin is
    a distance. So what is shuffled and held is counts of bins, not distances.
    """
    known, w = folds.code_points("".join(alphabet)), _walk(len(alphabet), kind)

    def pairs(points, at):
        """(suffix, bits of the distance); distances aren't negative, so their bits have their order."""
        x, y = folds.walk_texts(w, _known(points, known), at)
        start, size = np.repeat(at[:-1], np.diff(at)), np.repeat(np.diff(at), np.diff(at))
        pos = np.arange(1, len(points) + 1) - start
        other = pos * step % size + 1
        on = np.flatnonzero(pos != other)
        a, b = on, start[on] + other[on] - 1
        dx, dy = x[a] - x[b], y[a] - y[b]
        d = np.sqrt(dx * dx + dy * dy)
        left = np.minimum(pos[on], other[on])
        suffix, i = np.zeros(len(on), np.int64), np.arange(len(on))
        for j in range(cap):  # only those that agree up to here go on
            i = i[left[i] > j]
            i = i[points[a[i] - j] == points[b[i] - j]]
            if not len(i):
                break
            suffix[i] = j + 1
        keep = slice(None) if keep_zero else d > 0
        return suffix[keep], d[keep].view(np.int64)

    def counted(low: int, bins: dict[int, list[int]] | None, above: int) -> DataFrame:
        """(suffix, bin, n): bits from ``low`` up, of distances whose bits from ``above`` up are one of the suffix's bins."""

        def run(batches):
            tallies: dict[int, _Tally] = {}

            def rows():
                for s, t in tallies.items():
                    value, n = t.take()
                    for a in range(0, len(value), folds.BLOCK):
                        part = slice(a, a + folds.BLOCK)
                        yield pa.record_batch({"suffix": pa.array(np.full(len(value[part]), s, np.int32)), "bin": pa.array(value[part]), "n": pa.array(n[part])})

            for batch in batches:
                for _, points, at in folds.texts(batch):
                    suffix, bits = pairs(points, at)
                    for s in np.flatnonzero(np.bincount(suffix)).tolist():
                        own = bits[suffix == s]
                        if bins is not None:
                            own = own[np.isin(own >> above, bins.get(s, []))]
                        if len(own):
                            tallies.setdefault(s, _Tally()).add(own >> low)
                    if sum(t.size for t in tallies.values()) > MANY:
                        yield from rows()
            yield from rows()

        counts = df.select(F.col(text).alias("text")).mapInArrow(run, "suffix int, bin long, n long")
        return counts.groupBy("suffix", "bin").agg(F.sum("n").alias("n"))

    def middles(counts: DataFrame, ranks: DataFrame | None) -> list:
        """The bins that hold the lower and upper middle of each suffix, how many distances come before each and in all."""
        sums = Window.partitionBy("suffix", *(["up"] if ranks is not None else [])).orderBy("bin")
        c = counts if ranks is None else counts.withColumn("up", F.expr(f"shiftright(bin, {up})")).join(F.broadcast(ranks), ["suffix", "up"])
        total = F.sum("n").over(Window.partitionBy("suffix")) if ranks is None else F.col("total")
        c = c.withColumn("before", F.sum("n").over(sums) - F.col("n") + (F.lit(0) if ranks is None else F.col("base"))).withColumn("total", total)
        middle = F.expr("before <= total div 2 and before + n > (total - 1) div 2")
        return c.where(middle & (F.col("total") >= least)).select("suffix", "bin", "before", "n", "total").collect()

    spark = df.sparkSession
    found, low, up = middles(counted(BINS, None, 0), None), BINS, 0
    while low:
        up, low = low, 0 if sum(r.n for r in found) <= EXACT else low // 2
        bins: dict[int, list[int]] = {}
        for r in found:
            bins.setdefault(r.suffix, []).append(r.bin)
        ranks = spark.createDataFrame([(r.suffix, r.bin, r.before, r.total) for r in found], "suffix int, up long, base long, total long")
        up, above = up - low, up
        found = middles(counted(low, bins, above), ranks)
    medians: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r.bin):
        medians.setdefault(r.suffix, []).append((r.total, float(np.int64(r.bin).view(np.float64))))
    rows = [(s, v[0][0], (v[0][1] + v[-1][1]) / 2) for s, v in sorted(medians.items())]
    return spark.createDataFrame(rows, "suffix int, n long, median_distance double").withColumn("theory", theory)


@F.pandas_udf(T.DoubleType())
def half_precision(v: pd.Series) -> pd.Series:
    return v.astype(np.float16).astype(np.float64)


def at_precision(points: DataFrame, kind: str) -> DataFrame:
    """Points stored at f64, f32 or f16, widened again."""
    if kind == "f64":
        return points
    cast = (lambda c: F.col(c).cast("float").cast("double")) if kind == "f32" else (lambda c: half_precision(F.col(c)))
    return points.withColumn("x", cast("x")).withColumn("y", cast("y"))


def widened(queries: DataFrame, kind: str) -> DataFrame:
    """The radius with room for the rounding of the stored points."""
    eps = {"f64": 2.0**-52, "f32": 2.0**-23, "f16": 2.0**-10}[kind]
    return queries.withColumn("tau", F.col("tau") - 1e-12 + 8 * eps)


def contexts(hits: DataFrame, texts: DataFrame, alphabet: list[str], span: int, hops: int = 40, key: str = "doc_id") -> DataFrame:
    """(query_id, key, pos, context): up to ``hops`` symbols before each hit, decoded hop by hop from the points between.

    ``texts`` gives the walk; each hop of ``span`` symbols is inverted from its end point towards its start point.
    """
    from symtrace.operators.ring import decode_spans

    walk = walk_index(texts, alphabet, "ring", key)
    n = len(alphabet)
    ends = hits.select("query_id", key, "pos", F.explode(F.expr(f"sequence(0, cast((least(pos, {hops}) - 1) div {span} as int))")).alias("hop"))
    ends = ends.withColumn("end", F.col("pos") - F.col("hop") * span).withColumn("start", F.greatest(F.col("end") - span, F.col("pos") - hops, F.lit(0)))
    end = walk.select(F.col(key), F.col("pos").alias("end"), "x", "y")
    start = walk.select(F.col(key), F.col("pos").alias("start"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    parts = ends.join(end, [key, "end"]).join(start, [key, "start"], "left").na.fill(0.0, ["ax", "ay"])
    parts = parts.withColumn("c", (F.col("end") - F.col("start")).cast("int")).withColumn("n", F.lit(n))
    names = F.array(*map(F.lit, alphabet))
    done = decode_spans(parts).withColumn("_alphabet", names).withColumn("piece", F.expr("if(out is null, repeat('?', c), array_join(transform(out, i -> _alphabet[i]), ''))"))
    w = done.groupBy("query_id", key, "pos").agg(F.array_sort(F.collect_list(F.struct("end", "piece"))).alias("p"))
    return w.select("query_id", key, "pos", F.expr("array_join(transform(p, x -> x.piece), '')").alias("context"))


def first_by(df: DataFrame, part: list[str], order: list) -> DataFrame:
    """One row of each part, by an order; for small results."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where("_r = 1").drop("_r")
