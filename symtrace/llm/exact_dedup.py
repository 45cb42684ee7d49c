"""Exact dedup by two passes of a Bloom filter.

Texts are read once: a narrow table has each row's id, SHA-256 of the normalised text and a 64-bit hash of it. The
first pass sets bits for every hash, in blocks of a blocked Bloom filter that grows with the table, and merges the
tasks' blocks block by block: a bit that two rows set is kept in a second filter, "again". A row of which not all
bits are in "again" has no equal, surely. The second pass tests each narrow row against "again" and lets such rows
pass straight through; only the others, repeated or taken for repeated, are shuffled and compared by SHA-256. "again"
is broadcast up to ``FILTER_BYTES``; a larger one, and the narrow rows, meet by block. Texts never move for it.

Defined cases: null texts count as empty, and equal empty texts are one group; a null doc_id ranks
after all others; rows with the same doc_id and text are told apart by their place in the narrow table, so
that just one row of a group is kept; an empty table gives an empty result; extra columns are carried
unless a column of the result has their name. ``kept_rows`` finds a row again by its doc_id and a 64-bit hash of its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.common import Scratch, attach, bounded, lean

BLOCK_BITS = 1 << 13  #: bits of a block of the filter
BITS_PER_ROW = 16
PROBES = 4  #: bits that a text sets, all in one block
FILTER_BYTES = 8 << 20  #: of a filter that is broadcast
RUN = 1 << 19  #: hashes that a task of the first pass holds at once

OWN = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Bits within the block: PROBES slices of 13 bits of the hash below those that choose the block."""
    return [((h >> np.uint64(13 * i)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for i in range(PROBES)]


def _first_pass(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, again): blocks in which some bit is set by two rows; ``again`` as 64-bit words."""

    def fill(batches):
        run, held = [], 0
        for b in batches:
            run.append(np.asarray(b.column("h").to_numpy(), np.int64).view(np.uint64))
            held += len(run[-1])
            if held >= RUN:
                yield seen(np.concatenate(run))
                run, held = [], 0
        if held:
            yield seen(np.concatenate(run))

    def seen(h):
        # what a run has seen: (block, bit) once, and those seen twice
        block = _block_of(h, blocks)
        grid = np.sort(np.stack([block * BLOCK_BITS + p for p in _places(h)]), axis=0)
        fresh = np.ones(grid.shape, bool)
        fresh[1:] = grid[1:] != grid[:-1]  # a text may choose one bit twice; it counts once
        flat = grid[fresh]
        bit, n = np.unique(flat, return_counts=True)
        which = bit // BLOCK_BITS
        cut = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(bit) else np.zeros(0, np.int64)
        end = np.r_[cut[1:], len(bit)] if len(bit) else cut
        inner = (bit % BLOCK_BITS).astype(np.uint16)
        return pa.record_batch({"block": pa.array(which[cut]), "once": pa.array([inner[a:b].tobytes() for a, b in zip(cut, end)], pa.binary()), "twice": pa.array([inner[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut, end)], pa.binary())})

    def merge(t):
        block = t.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        once, twice = t.column("once").to_pylist(), t.column("twice").to_pylist()
        out_b, out_w = [], []
        for b, rows in _runs(block, order):
            n = np.bincount(np.concatenate([np.frombuffer(once[i], np.uint16) for i in rows]), minlength=BLOCK_BITS)
            n += np.bincount(np.concatenate([np.frombuffer(twice[i], np.uint16) for i in rows]), minlength=BLOCK_BITS)
            if (n > 1).any():
                out_b.append(b)
                out_w.append(np.packbits(n > 1, bitorder="little").view(np.int64))
        return pa.table({"block": pa.array(out_b, pa.int64()), "again": pa.array([w.tolist() for w in out_w], pa.list_(pa.int64()))})

    filled = hashes.select("h").mapInArrow(lean(fill), "block long, once binary, twice binary")
    return filled.groupBy((F.col("block") / 256).cast("long").alias("g")).applyInArrow(merge, "block long, again array<long>")


def _runs(key: np.ndarray, order: np.ndarray):
    k = key[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    for a, b in zip(cut, np.r_[cut[1:], len(k)]):
        yield int(k[a]), order[a:b]


def _block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block, from all bits of the hash."""
    return ((h ^ (h >> np.uint64(29))) % np.uint64(blocks)).astype(np.int64)


def _in_again(rows: DataFrame, again: DataFrame, blocks: int) -> DataFrame:
    """Adds ``maybe``: whether all of the row's bits are in the second filter."""
    # _block_of and _places on columns: the modulus of an unsigned number, half by half
    mixed = F.col("h").bitwiseXOR(F.shiftrightunsigned("h", 29))
    high, low = F.shiftrightunsigned(mixed, 32), mixed.bitwiseAND(F.lit(0xFFFFFFFF))
    block = ((high % blocks) * ((1 << 32) % blocks) + low % blocks) % blocks
    hit = F.lit(True)
    for i in range(PROBES):
        place = f"cast(shiftrightunsigned(h, {13 * i}) & {BLOCK_BITS - 1} as int)"
        hit &= F.expr(f"shiftrightunsigned(get(again, shiftright({place}, 6)), {place} & 63) & 1") == 1
    again = F.broadcast(again) if blocks * BLOCK_BITS // 8 <= FILTER_BYTES else again.hint("shuffle_merge")
    return rows.withColumn("block", block).join(again, "block", "left").withColumn("maybe", F.col("again").isNotNull() & hit).drop("again", "block")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """All rows without their texts, with keep_id, group_size, kept and text_sha256, and ``_text_key``, a hash of the text; see the module's text."""
    spark = docs.sparkSession
    work = Scratch(spark, "exact-dedup")
    own = [c for c in docs.columns if c not in (*OWN, "text", "doc_id")]
    narrow = docs.select("doc_id", *own, F.xxhash64("text").alias("_text_key"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).alias("_len"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    narrow = work.keep(narrow.withColumn("_place", F.monotonically_increasing_id()), "narrow").withColumn("h", F.xxhash64("text_sha256"))
    total = narrow.count()
    blocks = max(1, -(-total * BITS_PER_ROW // BLOCK_BITS))
    again = work.keep(_first_pass(narrow, blocks), "again")
    tested = _in_again(narrow, again, blocks).drop("h")
    if blocks * BLOCK_BITS // 8 > FILTER_BYTES:
        tested = work.keep(tested, "tested")
    single, maybe = tested.where("not maybe"), work.keep(tested.where("maybe"), "maybe")
    best = F.min(F.struct(-F.col("_len"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_place"))
    groups = maybe.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size"))
    groups = groups.select("text_sha256", "group_size", F.col("_best.doc_id").alias("keep_id"), F.col("_best._place").alias("_keep"))
    met = attach(maybe, groups, ["text_sha256"], "group_size", max(total, 1)).withColumn("kept", F.col("_place") == F.col("_keep"))
    alone = single.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    names = ["doc_id", *own, *OWN, "_text_key"]
    return alone.select(names).unionByName(met.select(names))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    work = Scratch(docs.sparkSession, "exact-rows")
    # only rows of groups can go; what goes is less than what is read, so the texts that stay needn't move for it
    grouped = exact_dedup(docs.select("doc_id", "text")).where("group_size > 1")
    keys = work.keep(grouped.groupBy(F.col("doc_id").alias("_id"), "_text_key").agg(F.count_if("kept").alias("stay"), F.count("*").alias("m")).where("stay < m"), "keys")
    rows = docs.withColumn("_own_key", F.xxhash64("text"))
    same = lambda k: rows["doc_id"].eqNullSafe(k["_id"]) & (rows["_own_key"] == k["_text_key"])
    gone = bounded(keys)
    out = rows.join(gone, same(gone), "left_anti")
    if not (repeated := keys.where("stay > 0")).isEmpty():  # rows that are equal in id and text, of which some stay
        some = bounded(repeated)
        out = out.unionByName(rows.join(some, same(some), "left_semi").dropDuplicates(["doc_id", "_own_key"]))
    return out.select(docs.columns)
