"""Vector quantization: codebooks, residual stages, exact-window policy and storage figures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CENTROIDS = 65_536  #: of all books together, that assign() broadcasts


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0.0D, (s, v) -> s + v)"


def assign(vectors: DataFrame, books: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Adds ``cid`` and ``centroid``: the nearest of the row's key, the lowest id on ties.

    Books, of a checked size, are one array for each key and broadcast, so rows keep their places and nothing is shuffled.
    """
    assert books.count() <= MOST_CENTROIDS, "too many centroids to broadcast"
    norm = F.expr(_dot("centroid", "centroid"))
    b = books.withColumn("_e", F.struct("cid", norm.alias("nn"), "centroid")).groupBy(*keys).agg(F.array_sort(F.collect_list("_e")).alias("_book"))
    near = f"aggregate(_book, named_struct('d', cast(null as double), 'e', _book[0]), (m, e) -> if(m.d is null or e.nn - 2 * {_dot('e.centroid', vec)} < m.d, named_struct('d', e.nn - 2 * {_dot('e.centroid', vec)}, 'e', e), m), m -> m.e)"
    joined = vectors.join(F.broadcast(b), keys) if keys else vectors.crossJoin(F.broadcast(b))
    return joined.withColumn("_n", F.expr(near)).withColumn("cid", F.col("_n.cid")).withColumn("centroid", F.col("_n.centroid")).drop("_n", "_book")


def quantize(vectors: DataFrame, books: DataFrame, keys: list[str], stages: Column | int, vec: str = "vec") -> DataFrame:
    """Adds ``ids`` and ``recon`` after greedy residual stages; ``stages`` may be a column, as in policies that give keys more than values."""
    most = books.agg(F.max("stage")).first()[0] or 0
    limit = stages if isinstance(stages, Column) else F.lit(stages)
    d = vectors.withColumn("_limit", limit).withColumn("_rest", F.expr(f"transform({vec}, x -> cast(x as double))")).withColumn("ids", F.expr("cast(array() as array<int>)"))
    d = d.withColumn("recon", F.expr("transform(_rest, x -> 0.0D)"))
    for s in range(1, most + 1):
        got = assign(d, books.where(F.col("stage") == s).drop("stage"), keys, "_rest")
        on = F.col("_limit") >= s
        d = got.withColumn("ids", F.when(on, F.concat("ids", F.array("cid"))).otherwise(F.col("ids"))).withColumn("recon", F.when(on, F.expr("zip_with(recon, centroid, (a, b) -> a + b)")).otherwise(F.col("recon"))).withColumn("_rest", F.expr("zip_with(_rest, centroid, (a, b) -> a - b)")).drop("cid", "centroid")
    return d.drop("_rest", "_limit")


def squared_error(vec: str = "vec", recon: str = "recon") -> Column:
    return F.expr(f"aggregate(zip_with({vec}, {recon}, (a, b) -> (a - b) * (a - b)), 0.0D, (s, v) -> s + v)")


def first_books(vectors: DataFrame, keys: list[str], k: int, order: str, vec: str = "vec") -> DataFrame:
    """Books of the first k vectors of each key in an order: a fixed codebook of one stage."""
    w = Window.partitionBy(*keys).orderBy(order)
    return vectors.withColumn("cid", F.row_number().over(w) - 1).where(F.col("cid") < k).select(*keys, F.lit(1).alias("stage"), F.col("cid").cast("int").alias("cid"), F.expr(f"transform({vec}, x -> cast(x as double))").alias("centroid"))


def with_pooled(vectors: DataFrame, own: DataFrame, pooled: DataFrame, keys: list[str], part: list[str]) -> DataFrame:
    """Books for each key of the vectors: its own, else those of the pooled key."""
    wanted = vectors.select(*keys).distinct()
    have = own.select(*keys).distinct()
    rest = wanted.join(have, keys, "left_anti")
    return own.select(*keys, "stage", "cid", "centroid").unionByName(rest.join(pooled, part).select(*keys, "stage", "cid", "centroid"))


def _seeded(x: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ seeding; points that all seeds cover already end it early."""
    seeds = [x[rng.integers(len(x))]]
    d2 = ((x - seeds[0]) ** 2).sum(1)
    while len(seeds) < k and d2.sum() > 0:
        seeds.append(x[rng.choice(len(x), p=d2 / d2.sum())])
        d2 = np.minimum(d2, ((x - seeds[-1]) ** 2).sum(1))
    return np.array(seeds)


def _lloyd(x: np.ndarray, k: int, iters: int, rng) -> np.ndarray:
    c = _seeded(x, k, rng)
    for _ in range(iters):
        own = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)  # an empty cluster keeps its centre
    return c


def train(vectors: DataFrame, keys: list[str], k: int, stages: int = 1, iters: int = 15, most: int = 12_000, seed: int = 0, vec: str = "vec") -> DataFrame:
    """Books (keys, stage, cid, centroid) by k-means++ and Lloyd rounds on at most ``most`` vectors of a key, chosen by hash.

    The bound is the operator's own parameter: it keeps a key's group in one task small.
    """
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(vec), vec)
    picked = vectors.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*keys, vec)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema if f.name in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf[vec].tolist(), np.float64)
        rng, out = np.random.default_rng(seed), []
        for s in range(1, stages + 1):
            c = _lloyd(x, k, iters, rng)
            out += [(s, i, list(map(float, v))) for i, v in enumerate(c)]
            x = x - c[((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)]
        res = pd.DataFrame(out, columns=["stage", "cid", "centroid"])
        for name in reversed(keys):
            res.insert(0, name, pdf[name].iloc[0])
        return res

    return picked.groupBy(*keys).applyInPandas(run, f"{fields}, stage int, cid int, centroid array<double>")


def lloyd_rounds(vectors: DataFrame, books: DataFrame, keys: list[str], iters: int, vec: str = "vec") -> DataFrame:
    """Lloyd rounds over all vectors as plans: assign, average by dimension, keep old centres of empty clusters."""
    for _ in range(iters):
        got = assign(vectors, books.drop("stage"), keys, vec)
        means = got.select(*keys, "cid", F.posexplode(vec).alias("dim", "v")).groupBy(*keys, "cid", "dim").agg(F.avg("v").alias("v"))
        new = means.groupBy(*keys, "cid").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("p")).select(*keys, "cid", F.expr("transform(p, x -> x.v)").alias("_new"))
        books = books.join(new, [*keys, "cid"], "left").select(*keys, "stage", "cid", F.coalesce("_new", "centroid").alias("centroid"))
    return books


def archived(sink: int, recent: int, pos: str = "pos", last: str = "last") -> Column:
    """Positions that are no longer exact when step ``last`` is done: behind the sink, older than the recent window."""
    return (F.col(pos) >= sink) & (F.col(pos) <= F.col(last) - recent)


def storage(ids: DataFrame, k: int, span: int, key: list[str], tokens: str) -> DataFrame:
    """(key, ids, tokens, walk_bytes, packed_bytes, walk_bpt, packed_bpt): bytes of an id stream as walk points and as packed bits."""
    g = ids.groupBy(*key).agg(F.count("*").alias("ids"), F.countDistinct(tokens).alias("tokens"))
    bits = math.ceil(math.log2(k)) if k > 1 else 1
    g = g.withColumn("walk_bytes", F.ceil(F.col("ids") / span) * 16).withColumn("packed_bytes", F.ceil(F.col("ids") * bits / 8))
    return g.withColumn("walk_bpt", F.col("walk_bytes") / F.col("tokens")).withColumn("packed_bpt", F.col("packed_bytes") / F.col("tokens"))


def kv_bytes_per_token(layers: Column, heads: Column, dim: Column, width: int = 2) -> Column:
    return (layers * heads * dim * 2 * width).cast("long")
