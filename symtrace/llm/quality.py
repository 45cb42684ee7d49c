"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A pass over whole texts writes a row of statistics for each document. Standardised, they are mapped by
``features`` random cosines whose inner products approximate a Gaussian kernel. Every partition of
labelled rows sums its part of the normal equations; the sums, of a fixed size, are added in a tree and
solved on the driver. A quarter of the training rows, by hash, is kept from the fit and calibrates the
scores. Labels of held-out rows are never read.

Defined cases: null and empty texts have statistics of zeros and are scored like any text; a null
doc_id is scored and not held out; repeated rows are scored alike; labels of documents that are not
there are ignored; without training labels of both kinds every score is the share of label 1, or 0.5;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.calibrate import fit_isotonic, held_out, one_label
from symtrace.llm.common import SPACE_BYTES, Scratch, lean, shingle_hashes, slices, text_bytes, word_hashes

#: Classes of bytes that are counted.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".", "pause": b",;:", "loud": b"!?", "mark": b"#$%&*+=@^~\\", "frame": b"|<>[]{}_/", "quote": b"\"'()-`"}
STATS = ["log_bytes", *CLASSES, "other", "log_words", "word_len", "distinct_words", "distinct_triples", "top_word", "long_words", "line_words", "distinct_bytes"]

_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _i


def statistics(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The statistics of one text from its bytes and its words' hashes."""
    n, m = len(data), len(words)
    if not n:
        return np.zeros(len(STATS), np.float32)
    by = np.bincount(data, minlength=256)
    share = np.bincount(_CLASS, weights=by, minlength=len(CLASSES) + 1) / n
    _, times = np.unique(words, return_counts=True)
    triples = len(np.unique(shingle_hashes(words, 3)))
    inside = n - by[SPACE_BYTES].sum()
    return np.array([np.log1p(n), *share, np.log1p(m), inside / max(m, 1), len(times) / max(m, 1), triples / max(m - 2, 1), times.max(initial=0) / max(m, 1), share[1] / (share[0] + share[1] + 1e-9), np.log1p(m / (1 + by[10])), (by > 0).sum() / 64], np.float32)


def _stats(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts, out = batch.column("text"), np.zeros((batch.num_rows, len(STATS)), np.float32)
            for lo, hi in slices(texts):
                data, at = text_bytes(texts.slice(lo, hi - lo))
                words, rows = word_hashes(data, at, SPACE_BYTES)
                for i in range(hi - lo):
                    out[lo + i] = statistics(data[at[i] : at[i + 1]], words[rows[i] : rows[i + 1]])
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(out[:, j]) for j in range(len(STATS)))], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{s} float" for s in STATS))


class Model:
    """Scores of rows of statistics; picklable, of a fixed size."""

    def __init__(self, mean, scale, features: int, gamma: float, seed: int):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = r.normal(0, np.sqrt(2 * gamma), (len(STATS), features))
        self.b = r.uniform(0, 2 * np.pi, features)
        self.beta, self.iso, self.flat = None, None, 0.5

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.flat) if self.beta is None else np.clip(self.iso(self.raw(x)), 0.0, 1.0)


def _matrix(batch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], 1).astype(np.float64) if batch.num_rows else np.zeros((0, len(STATS)))


def _normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sum over all rows of [Z, y]' [Z, y]: each partition's sum is cut into pieces, which are added in two rounds."""
    size, pieces = len(model.b) + len(STATS) + 2, 16

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([model.map(_matrix(batch)), np.asarray(batch.column("label").to_numpy())[:, None]])
            total += z.T @ z
        cut = np.array_split(total.ravel(), pieces)
        yield pa.record_batch({"piece": pa.array(range(pieces), pa.int32()), "part": pa.array([0] * pieces, pa.int32()), "sums": pa.array([c.tobytes() for c in cut], pa.binary())})

    def add(key, t):
        got = [np.frombuffer(x, np.float64) for x in t.column("sums").to_pylist()]
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "sums": pa.array([np.sum(got, 0).tobytes()], pa.binary())})

    schema = "piece int, part int, sums binary"
    parts = rows.mapInArrow(lean(run), schema).withColumn("part", F.spark_partition_id() % 64)
    got = parts.groupBy("piece", "part").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    if not got:
        return np.zeros((size, size))
    return np.concatenate([np.frombuffer(bytes(r.sums), np.float64) for r in sorted(got, key=lambda r: r.piece)]).reshape(size, size)


def train(stats: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), features: int = 256, gamma: float = 0.02, ridge: float = 1.0, seed: int = 7) -> Model:
    """Fits on labelled rows whose crc32(doc_id) mod held[0] is not held[1]."""
    known = stats.join(one_label(labels, "quality"), "doc_id").where(~held_out("doc_id", *held))
    known = known.withColumn("calibrates", F.floor(F.crc32(F.col("doc_id").cast("string")) / held[0]) % 4 == 0)
    row = known.agg(*(F.avg(s).alias(f"m_{s}") for s in STATS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATS), F.avg("label").alias("label")).first()
    mean = np.array([row[f"m_{s}"] or 0.0 for s in STATS])
    scale = np.array([(row[f"s_{s}"] or 0.0) + 1e-3 for s in STATS])
    model = Model(mean, scale, features, gamma, seed)
    model.flat = 0.5 if row["label"] is None else float(row["label"])
    if row["label"] in (None, 0.0, 1.0):
        return model
    a = _normal_equations(known.where("not calibrates").select(*STATS, "label"), model)
    n = a.shape[0] - 1
    if not a.any():
        return model
    model.beta = np.linalg.solve(a[:n, :n] + ridge * np.eye(n), a[:n, n])

    def raw(batches):
        for batch in batches:
            yield pa.record_batch({"raw": pa.array(model.raw(_matrix(batch))), "label": batch.column("label")})

    fair = known.where("calibrates")
    model.iso = fit_isotonic(fair.select(*STATS, "label").mapInArrow(lean(raw), "raw double, label double"), -0.5, 1.5)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), **options) -> DataFrame:
    """(doc_id, held_out, score) of every document."""
    work = Scratch(docs.sparkSession, "quality")
    stats = work.keep(_stats(docs), "stats")
    model = train(stats, labels, held, **options)

    def score(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_matrix(batch)))})

    return stats.mapInArrow(lean(score), "doc_id long, score double").withColumn("held_out", held_out("doc_id", *held)).select("doc_id", "held_out", "score")


def good_rows(docs: DataFrame, labels: DataFrame, least: float = 0.5, held: tuple[int, int] = (3, 1), **options) -> DataFrame:
    """The rows with a score of at least ``least``, with their columns; statistics are computed again where rows are chosen."""
    work = Scratch(docs.sparkSession, "quality")
    model = train(work.keep(_stats(docs), "stats"), labels, held, **options)
    schema = docs.schema

    def choose(batches):
        for batch in batches:
            texts, out = batch.column("text"), np.zeros((batch.num_rows, len(STATS)))
            for lo, hi in slices(texts):
                data, at = text_bytes(texts.slice(lo, hi - lo))
                words, rows = word_hashes(data, at, SPACE_BYTES)
                for i in range(hi - lo):
                    out[lo + i] = statistics(data[at[i] : at[i + 1]], words[rows[i] : rows[i + 1]])
            yield batch.filter(pa.array(model.score(out) >= least))

    return docs.mapInArrow(lean(choose), schema)


