"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed once for each text. Over every run of W = ``window`` words the least hash of its
k-grams (k = W - ``grams`` + 1, so ``grams`` of them) is the run's fingerprint; equal runs of W words
have equal fingerprints, which guarantees that every shared span of at least W words is met. Texts'
fingerprints are joined with the benchmark's, and each hit is extended: the run's own words must equal
a benchmark window, word for word, and overlapping hits merge into spans. Benchmark items of fewer
than W words are windows of their own length; they are joined on the hash of all their words.

The benchmark's fingerprints are broadcast if counted to be at most ``BROADCAST_ROWS``, else both
sides are shuffled. No rows of a text leave the scan but one for itself and one for each hit.

Defined cases: null and empty texts have no words and no hits; items without words match nothing;
repeated items, repeated rows and null ids are kept, rows being told apart by their place in the
table; null item ids don't count as items, but their windows hit; an empty benchmark leaves every
text clean; an empty table gives an empty result; extra columns are carried by ``clean_rows``, ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symtrace.llm.common import NOT_WORD, Scratch, ascii_lower, bounded

BROADCAST_ROWS = 200_000  #: of 8 bytes each


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _fingerprint(j: str, size: int, grams: int) -> str:
    """Least hash of the k-grams of words j .. j + size - 1, from the array ``wh`` of word hashes."""
    k = size - grams + 1
    each = [f"xxhash64({', '.join(f'get(wh, {j} + {g + i})' for i in range(k))})" for g in range(grams)]
    return each[0] if grams == 1 else f"least({', '.join(each)})"


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, size, words): every window of every item, items of fewer words being one window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    w = w.withColumn("size", F.least("n", F.lit(window)))
    return w.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at")).select("item_id", F.col("size").cast("int").alias("size"), F.slice("w", F.col("at"), F.col("size")).alias("words"))


def _hits(rows: DataFrame, marks: DataFrame, size: int, grams: int, few: bool) -> DataFrame:
    """For each row its own (at = -1) and one for each run of ``size`` words whose fingerprint the benchmark has."""
    at = rows.select("place", "doc_id", "text_key", "wh", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("wh") - size, F.lit(-1)))).alias("at"))
    at = at.withColumn("mark", F.expr(f"case when at >= 0 then {_fingerprint('at', size, grams)} end"))
    found = marks.where(F.col("size") == size).select("mark", F.lit(True).alias("found")).distinct()
    met = at.join(F.broadcast(found) if few else found, "mark", "left").where("found or at = -1")
    return met.select("place", "doc_id", "text_key", F.size("wh").cast("long").alias("n_words"), "at", F.lit(size).alias("size"), F.expr(f"case when at >= 0 then array_join(slice(w, at + 1, {size}), ' ') end").alias("key"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, grams: int = 3) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, item_ids, spans): what of each text the benchmark has; see the module's text.

    ``spans`` are (first word, one past the last word) of merged hits; ``item_ids`` sorted as strings.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "decontaminate")
    win = work.keep(_windows(items, window), "windows")
    sizes = sorted(r["size"] for r in win.select("size").distinct().collect())  # at most ``window`` of them
    wh = "transform(words, x -> xxhash64(x))"
    marks, kinds = None, [(s, grams if s == window else 1) for s in sizes] or [(window, grams)]
    for size, n in kinds:
        one = win.where(F.col("size") == size).withColumn("wh", F.expr(wh)).select("size", F.expr(_fingerprint("0", size, n)).alias("mark"))
        marks = one if marks is None else marks.union(one)
    marks = work.keep(marks.distinct(), "marks")
    few = marks.count() <= BROADCAST_ROWS
    rows = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", text_key().alias("text_key"), words(F.col("text")).alias("w")).withColumn("wh", F.expr("transform(w, x -> xxhash64(x))"))
    hits = None
    for size, n in kinds:
        one = _hits(rows, marks, size, n, few)
        hits = one if hits is None else hits.union(one)
    # the hits are written before anything is joined, so texts are read once for each size of window
    return _summed(work, work.keep(hits, "hits"), win)


def _summed(work: Scratch, hits: DataFrame, win: DataFrame) -> DataFrame:
    """Exact comparison of the hits' words with the windows', then one row for each text."""
    keyed = win.select("size", F.array_join("words", " ").alias("key"), "item_id")
    # windows with the same words are one; items that share all their windows' words are listed once for each
    known = keyed.groupBy("size", "key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    known = known.withColumn("items_key", F.xxhash64("items"))
    real = work.keep(hits.where("at >= 0").join(known.select("size", "key", "items_key"), ["size", "key"]).select("place", "at", "size", "items_key"), "real")
    spans = real.groupBy("place").agg(F.array_sort(F.collect_set(F.struct("at", F.col("at") + F.col("size")))).alias("runs"))
    merged = """aggregate(runs, cast(array() as array<struct<a:int,b:int>>), (acc, r) ->
        case when size(acc) > 0 and r.at <= element_at(acc, -1).b
             then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, r.col2))))
             else concat(acc, array(named_struct('a', r.at, 'b', r.col2))) end)"""
    spans = spans.select("place", F.expr(merged).alias("spans"))
    lists = known.select("items_key", "items").dropDuplicates(["items_key"])
    items = real.select("place", "items_key").distinct().join(lists, "items_key").select("place", F.explode("items").alias("item")).distinct().groupBy("place").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    each = hits.where("at = -1").dropDuplicates(["place"]).select("place", "doc_id", "text_key", "n_words")
    out = each.join(spans, "place", "left").join(items, "place", "left")
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    out = out.withColumn("spans", F.coalesce("spans", none)).withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))
    return out.select("doc_id", "text_key", "n_words", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans")


def clean_rows(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows without a hit, with all their columns."""
    work = Scratch(docs.sparkSession, "decontaminate-rows")
    bad = bounded(work.keep(decontaminate(docs, items, window).where("n_hit > 0").select("text_key").distinct(), "bad"))
    return docs.join(bad, text_key() == bad["text_key"], "left_anti")
