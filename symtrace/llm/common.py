"""What the operators share: tables, scratch tables, hashing of texts in numpy, components.

Scratch tables are Parquet in the folder named by ``spark.checkpoint.dir``, so that lineage is
cut by files which every executor sees. A temporary folder is used only where that setting is
absent and the session has no executors but its own process, as in tests.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: code points that count as white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
#: Fixed value: what separates words of letters and digits, the complement of the word class
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. One is made only for a session of one machine that names none; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symtrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run of an operator, each written once and read back."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        # shuffle files of plans that nothing refers to any more go with the objects that stand for them
        gc.collect()
        jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else untouched; the fast path serves texts of ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def attach(df: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with a table of one row for each key, safe for hot keys.

    Keys that hold more than 1/parts of all rows number fewer than ``parts``, so the rows of those
    keys meet their group by broadcast and never gather in one task; the rest are shuffled, at most
    total/parts rows to a key.
    """
    hot = F.broadcast(groups.where(F.col(size) * parts > total))
    cold = groups.where(F.col(size) * parts <= total)
    return df.join(hot, keys).unionByName(df.join(hot.select(*keys), keys, "left_anti").join(cold.hint("shuffle_merge"), keys))


BROADCAST_KEYS = 1_000_000  #: rows of a few numbers each, below 50 MB


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of keys, marked for broadcast if it is counted to be small; else a join on it shuffles."""
    return F.broadcast(keys) if keys.count() <= most else keys


# ------------------------------------------------------------------ hashing of texts in numpy

_U = np.uint64
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_BACK = _U(pow(int(_STEP), -1, 1 << 64))
_POWERS = _INVERSE = np.zeros(0, np.uint64)
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[ord(c) for c in SPACES]] = True
NOT_WORD_BYTES = np.zeros(256, dtype=bool)
NOT_WORD_BYTES[[i for i in range(128) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows one after another and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lean(function):
    """A batch function that gives unused memory back when its task ends: workers live on, and what one operator held would add to the next."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, never less than one row, so that memory is bounded by the longest text."""
    _, at = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the step, and of its inverse; odd numbers have one."""
    global _POWERS, _INVERSE
    if n > len(_POWERS):
        n = max(n, 2 * len(_POWERS))
        _POWERS, _INVERSE = (np.cumprod(np.full(n, x, dtype=np.uint64)) for x in (_STEP, _BACK))
    return _POWERS, _INVERSE


def word_hashes(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and the n + 1 offsets of the rows' words.

    A word's bytes are weighed by powers of their places among all bytes; running sums give each word's part, and the
    inverse power of its first place makes it the same wherever the word stands.
    """
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge < len(data)) & (edge > 0)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    rows = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    ends = np.flatnonzero(last) + 1
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_FOLDED[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), rows


def row_shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_hashes`` of all rows, whose words lie one after another, and the n + 1 offsets."""
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.r_[0, np.cumsum(count)]
    out = np.zeros(at[-1], np.uint64)
    if len(words) >= k:
        whole = shingle_hashes(words, k)
        long_ = np.repeat(n >= k, count)
        place = np.arange(at[-1]) + np.repeat(rows[:-1] - at[:-1], count)
        out[long_] = whole[place[long_]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        g = np.full(len(short), size, np.uint64)
        for i in range(size):
            g = mix(g * _STEP + words[rows[short] + i])
        out[at[short]] = g
    return out, at


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, or of the whole sequence if it is shorter."""
    if not len(words):
        return words
    if len(words) < k:
        g = np.array([len(words)], np.uint64)
        for i in range(len(words)):
            g = mix(g * _STEP + words[i : i + 1])
        return g
    n = len(words) - k + 1
    g = words[:n].copy()
    for i in range(1, k):
        g = g * _STEP + words[i : i + n]
    return mix(g)


# ------------------------------------------------------------------ connected components


FEW_LINKS = 1_000_000  #: links, of 16 bytes each, whose components one task finds


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all linked nodes: roots that a link joins take the smaller one, until no link joins two."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(left := np.flatnonzero(root[a] != root[b])):
        a, b = a[left], b[left]
        low, x, y = np.minimum(root[a], root[b]), root[a], root[b]
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(scratch: Scratch, links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """Components of links (a, b): one row (node, root) for each linked node, root the smallest node.

    Up to ``FEW_LINKS`` links, by count, are joined in one task, as rounds of jobs cost the driver time and memory. More go by
    alternating large-star and small-star steps, each written to the shared folder; every step is
    an aggregate and a join on the node, so nothing gathers on the driver or by component.
    Raises if ``most`` rounds don't suffice, which needs a chain of over 2^60 nodes.
    """
    e = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    if e.schema["a"].dataType == e.schema["b"].dataType == T.LongType() and e.count() <= FEW_LINKS:

        def run(batches):
            parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
            node, root = _roots(*(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1)))
            yield pa.record_batch({"node": pa.array(node), "root": pa.array(root)})

        return e.coalesce(1).mapInArrow(run, "node long, root long")
    before, last = None, f"{name}-0"
    for i in range(1, most + 1):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        now = scratch.keep(small, f"{name}-{i}")
        scratch.drop(last)
        last, e = f"{name}-{i}", now
        after = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.countDistinct("a")).first())
        if after == before and after[0] == after[2]:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
