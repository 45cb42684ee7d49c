"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in an order shuffled by a hash of id and text, once and then again for every further
epoch. A document's virtual finish is its source's words through it, divided by the source's target, which is its
weight's share of the budget after targets above ``epochs`` times a source's size are cut and their excess reshared.
A queue is served to virtual time 1, where it has given its target; a document that this cuts gives its first words.
All queues run at once, so the mix is everything in order of virtual finish, range-sorted over the cluster and truncated
where the words before reach the total budget.

Running sums go by (source, range of the hash), and over all sources by ranges of virtual time, and are carried on over
the ranges, so that a source with a third of all rows is spread like the rest.

Defined cases: null and empty texts have size 0 and give nothing; a null source is a source, the last
in order; the same doc_id twice makes two documents; a table without words has targets of 0; extra
columns are carried by ``mix`` unless it makes a column of their name, ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symtrace.llm.common import Scratch, bounded

RANGE_ROWS = 4096  #: documents of a source in one range of the hash, about


def size_of(text):
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(work: Scratch, sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, n, target): weights by code point order of the source, null last; budget is share * all sizes."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # one row a source: its place in the order needs one window over the sources
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    s = work.keep(s.withColumn("w", w.cast("double")).withColumn("most", F.col("source_size") * float(epochs)), "sources")
    total = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:  # the level at which the open sources share what the full ones leave; only sums come to the driver
        is_full = F.col("most") <= F.col("w") * level
        spent, open_w, n = s.agg(F.sum(F.when(is_full, F.col("most")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("w"))), F.count_if(is_full)).first()
        if n == full or not open_w:
            break
        level, full = (share * total - spent) / open_w, n
    return s.withColumn("target", F.least("most", F.col("w") * F.lit(level))).select("source", "source_size", "n", "target")


def _queued(work: Scratch, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Adds ``before``: words of the source's documents that come earlier in the shuffled order."""
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")
    d = docs.join(F.broadcast(named) if named.count() <= 10_000 else named, docs["source"].eqNullSafe(named["source"])).drop(named["source"])
    d = d.withColumn("range", F.floor(F.shiftrightunsigned("h", 32) * ranges / F.lit(2.0**32)).cast("long"))
    d = work.keep(d, "queued")
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    carried = sums.withColumn("carried", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("s"), F.col("range").alias("r"), "carried")
    own = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return d.join(carried, d["source"].eqNullSafe(carried["s"]) & (F.coalesce(d["source"], F.lit("")) == F.coalesce(carried["s"], F.lit(""))) & (F.col("range") == F.col("r"))).withColumn("before", F.col("carried") + F.col("within")).drop("s", "r", "carried", "within", "range")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 1) -> DataFrame:
    """One row a document and epoch that the mix takes words of, range-sorted by virtual finish.

    All columns of ``docs`` but the text, and size, source_size, target, epoch, taken, finish.
    """
    work = Scratch(docs.sparkSession, "mixing")
    dealt = _dealt(work, _sized(work, docs, weights, share, epochs, seed), epochs)
    return dealt.where("taken > 0").repartitionByRange(F.col("finish"), F.col("h")).sortWithinPartitions("finish", "h").drop("h", "before", "_place")


def _sized(work: Scratch, docs: DataFrame, weights, share, epochs, seed) -> DataFrame:
    own = [c for c in docs.columns if c not in ("text", "doc_id", "source", "size", "source_size", "target", "epoch", "taken", "finish", "h", "n", "before", "range", "_place")]
    rows = docs.select(F.col("doc_id"), F.col("source"), *own, size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h"))
    rows = work.keep(rows.withColumn("_place", F.monotonically_increasing_id()), "sizes")
    return work.keep(_queued(work, rows, targets(work, rows, weights, share, epochs)), "ordered")


def _dealt(work: Scratch, queued: DataFrame, epochs: int) -> DataFrame:
    """Adds epoch, finish and taken: what the budget holds of each row in the order of virtual finish.

    A source's queue is served to virtual time 1, a last document in part, so that documents of any length leave its words
    within one of its target. Served rows are dealt by ranges of virtual finish and truncated where the words before, of
    all sources, reach the total budget.
    """
    d = queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(epochs)))))
    end = F.floor(F.col("target") + 1e-6)  # whole words by virtual time 1
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    d = d.withColumn("served", F.greatest(F.lit(0), F.least(F.col("size"), end - start)).cast("long"))
    d = d.withColumn("finish", F.when(F.col("target") > 0, (start + F.col("served")) / F.col("target")))
    ranges = max(1, queued.count() // RANGE_ROWS)
    d = d.withColumn("range", F.when(F.col("served") > 0, F.floor(F.least(F.col("finish"), F.lit(1.0)) * ranges)).otherwise(F.lit(ranges + 1) + F.pmod("h", F.lit(ranges))).cast("long"))
    each = queued.groupBy("source").agg(F.first("target").alias("target"))
    budget = each.agg(F.coalesce(F.sum(end), F.lit(0)).cast("long")).first()[0]
    sums = work.keep(d.groupBy("range").agg(F.sum("served").alias("sum")), "ranges")
    # a range is a few numbers for thousands of rows; theirs is the only order over all
    carried = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("carried"))
    own = Window.partitionBy("range").orderBy("finish", "h", "_place", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("served").over(own), F.lit(0))).join(bounded(carried), "range")
    taken = F.greatest(F.lit(0), F.least(F.col("served"), F.lit(budget) - F.col("carried") - F.col("within")))
    return d.withColumn("taken", taken.cast("long")).drop("n", "range", "within", "carried", "served")


def mixture(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 1) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, and what the mix takes over all epochs, by its virtual finish times."""
    work = Scratch(docs.sparkSession, "mixing")
    dealt = _dealt(work, _sized(work, docs.select("doc_id", "source", "text"), weights, share, epochs, seed), epochs)
    one = F.first(F.struct("doc_id", "source", "size", "source_size", "target")).alias("d")
    return dealt.groupBy("_place").agg(one, F.sum("taken").alias("taken")).select("d.*", "taken")
