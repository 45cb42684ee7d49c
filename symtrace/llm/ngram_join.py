"""N-gram Jaccard join by prefix tree.

Every text becomes the set of its five-word shingles, globally ordered: shingles in crowded cells of
a fixed-size count sketch last, by crowding, then by hash. Two sets of Jaccard similarity s or more
share a shingle among the first ``n - ceil(s n) + 1`` of each, so candidates come from those prefixes.
A hub's candidates are stored in a trie of ordered sets; the hub's set traverses it, sharing the
overlap of common paths, and drops a subtree as soon as what is left on both sides can't reach the
overlap that the threshold asks for.

Links are wanted as components, so a posting list is not expanded into all its pairs: the members of a
list first meet a hub for each class of sizes. Linked sets are labelled by the component of these links; then each
member meets the closest of another label by bitmap, sets are labelled anew, and last all pairs of a list whose labels
still differ are compared. Before whole sets travel, a pair must
pass a parity bitmap: bits that differ between two sets' bitmaps number at most the items that differ. Lists meet
in buckets of a hash, as arrays; a list of more than ``PART`` members is dealt over several buckets.

Defined cases: null and empty texts, and texts without words, have no shingles and link with nothing;
fewer than five words make one shingle of the whole sequence; equal texts and repeated rows share a
class and hence a component; a null doc_id keeps its row, and counts only if its component has no
other id; an empty table gives an empty result; extra columns are ignored. Shingles are 60-bit
hashes and classes 64-bit ones; distinct ones are taken to differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.common import SPACE_BYTES, Scratch, attach, bounded, components, lean, mix, row_shingles, slices, text_bytes, word_hashes

WIDTH = 20  #: bits of the count sketch; its size, and the broadcast's, is 2 ** WIDTH cells
CHUNK = 1024  #: members that meet their hub in one trie
HUBS = 1  #: of a list and class of sizes
PART = 2048  #: members of a list in one bucket
BUCKET = 2000  #: rows of a bucket, about


# ------------------------------------------------------------------ sets


def _each_slice(batch: pa.RecordBatch, k: int):
    """(first row, last row, shingles of the rows one after another, their offsets) of runs of rows."""
    texts = batch.column("text")
    for lo, hi in slices(texts):
        words, rows = word_hashes(*text_bytes(texts.slice(lo, hi - lo)), SPACE_BYTES)
        yield lo, hi, *row_shingles(words, rows, k)


def tokens_of(shingles: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Shingles as numbers that sort in the global order: 4 bits of crowding, then 60 bits of hash."""
    return (crowded[(shingles >> np.uint64(64 - WIDTH)).astype(np.int64)].astype(np.uint64) << np.uint64(60)) | (shingles >> np.uint64(4))


def bitmap(items: np.ndarray) -> np.ndarray:
    """Parity of the items by their low bits, in 64-bit words; two to four bits for an item."""
    size = 64
    while size < 2 * len(items):
        size *= 2
    return np.packbits((np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Bitmaps:
    """Bitmaps of many sets, as matrices by size."""

    def __init__(self, bits: list[np.ndarray], n: np.ndarray):
        self.n = n
        self.size = np.array([len(b) for b in bits], np.int64)
        self.row = np.zeros(len(bits), np.int64)
        self.whole = {}
        for size in np.unique(self.size):
            own = np.flatnonzero(self.size == size)
            self.row[own] = np.arange(len(own))
            self.whole[int(size)] = np.stack([bits[i] for i in own])
        self.folded = {s: m[:, : s // 2] ^ m[:, s // 2 :] for s, m in self.whole.items() if s > 1}

    def alike(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        return self.spare(a, b, percent) >= 0

    def spare(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """By how much sizes and bitmaps of the pairs allow the overlap, below 0 if they don't; the longer bitmap is folded."""
        n, m = self.n[a], self.n[b]
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        room = n + m - 2 * -(-percent * (n + m) // (100 + percent))
        out = np.full(len(a), -1, np.int64)
        big, small = np.where(self.size[a] >= self.size[b], a, b), np.where(self.size[a] >= self.size[b], b, a)
        for size in np.unique(self.size[small][fits]):
            mine = np.flatnonzero(fits & (self.size[small] == size))
            step = max(1, (1 << 20) // int(size))
            for i in range(0, len(mine), step):
                p = mine[i : i + step]
                # sizes of sets that fit differ by less than a quarter, so one fold is enough
                x = np.where((self.size[big[p]] == size)[:, None], self.whole[int(size)][np.where(self.size[big[p]] == size, self.row[big[p]], 0)], self.folded[2 * int(size)][np.where(self.size[big[p]] == size, 0, self.row[big[p]])] if 2 * int(size) in self.folded else np.uint64(0))
                differ = np.bitwise_count(x ^ self.whole[int(size)][self.row[small[p]]]).sum(1, dtype=np.int64)
                out[p] = room[p] - differ
        return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """For each cell, 0 or the class of its crowding, counted over all texts; bounded by 2 ** WIDTH bytes."""
    cells, block = 1 << WIDTH, 1 << 14

    def count(batches):
        total, any_ = np.zeros(cells, np.int64), False
        for batch in batches:
            for *_, shingles, _ in _each_slice(batch, k):
                cell, n = np.unique(shingles >> np.uint64(64 - WIDTH), return_counts=True)
                total[cell.astype(np.int64)] += n
                any_ |= len(cell) > 0
        if any_:
            yield _block_rows(total, block)

    def add(key, t):
        total = np.zeros(block, np.int64)
        for x in t.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = docs.select("text").mapInArrow(lean(count), "block int, part int, counts binary").withColumn("part", F.spark_partition_id() % 256)
    sums = parts.groupBy("block", "part").applyInArrow(add, "block int, part int, counts binary").groupBy("block").applyInArrow(add, "block int, part int, counts binary")
    total = np.zeros(cells, np.int64)
    for r in sums.toLocalIterator():
        total[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.counts), np.uint32)
    least = 2 * total.mean() + 64
    crowd = np.floor(np.log2(np.maximum(total / least, 1e-9))) + 1
    return np.where(total > least, np.clip(crowd, 1, 15), 0).astype(np.uint8)


def _block_rows(total: np.ndarray, rows: int) -> pa.RecordBatch:
    n = len(total) // rows
    low = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.record_batch({"block": pa.array(range(n), pa.int32()), "part": pa.array([0] * n, pa.int32()), "counts": pa.array([low[i * rows : (i + 1) * rows].tobytes() for i in range(n)], pa.binary())})


# ------------------------------------------------------------------ the trie


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m that makes 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Trie:
    """Ordered sets, or the first parts of them, with common beginnings stored once.

    A set's ``tail`` is how many of its items, all after those given, the trie doesn't hold.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets, self.sizes = sets, sizes
        self.by_order = np.array([sizes[i] for i in self.order], np.int64)

    def search(self, query: np.ndarray, size: int, percent: int) -> list[int]:
        """Indices of the sets whose overlap with the query, the first items of a set of ``size``, can reach the threshold; exact if nothing has a tail."""
        found: list[int] = []
        if not len(query) or not self.order:
            return found
        known = query[-1] if size > len(query) else np.uint64(2**64 - 1)  # what lies beyond may match the query's tail
        stack = [(0, len(self.order), 0, 0)]
        while stack:
            lo, hi, depth, shared = stack.pop()
            a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])  # the common beginning of lo..hi is that of its first and last
            end = depth + int(differ[0]) if len(differ) else m
            if end > depth:
                edge = a[depth:end]
                at = np.searchsorted(query, edge)
                at[at == len(query)] = len(query) - 1
                shared += int((query[at] == edge).sum())
            passed = int(np.searchsorted(query, a[end - 1], side="right")) if end else 0
            used = end if not end or a[end - 1] <= known else int(np.searchsorted(a[:end], known, side="right"))
            low, high = self._range(lo, hi)
            if shared + min(size - passed, high - used) < needed(size, low, percent):
                continue
            while lo < hi and len(self.sets[self.order[lo]]) == end:
                i = self.order[lo]
                if shared + min(size - passed, self.sizes[i] - used) >= needed(size, self.sizes[i], percent):
                    found.append(i)
                lo += 1
            while lo < hi:  # a child for each item that follows
                item, first, last = self.sets[self.order[lo]][end], lo, hi
                while first + 1 < last:
                    mid = (first + last) // 2
                    if self.sets[self.order[mid]][end] == item:
                        first = mid
                    else:
                        last = mid
                stack.append((lo, last, end, shared))
                lo = last
        return found

    def _range(self, lo: int, hi: int) -> tuple[int, int]:
        part = self.by_order[lo:hi]
        return (int(part[0]), int(part[0])) if hi - lo == 1 else (int(part.min()), int(part.max()))


def _probe(percent: int):
    """Group function: rows of many hubs, each own once, and of their candidates; gives the links (a, b) that hold."""

    def run(t: pa.Table) -> pa.Table:
        a, salt, cid, n = (t.column(c).to_numpy() for c in ("a", "salt", "cid", "n"))
        own, items = t.column("own").to_numpy(zero_copy_only=False), t.column("items").combine_chunks()
        o = np.lexsort((~own, salt, a))
        cut = np.flatnonzero(np.r_[True, (a[o][1:] != a[o][:-1]) | (salt[o][1:] != salt[o][:-1])])
        left, right = [], []
        for lo, hi in zip(cut, np.r_[cut[1:], len(o)]):
            h, rest = o[lo], o[lo + 1 : hi]
            if not own[h] or not len(rest):
                continue
            sets = [np.frombuffer(items[int(i)].as_buffer(), np.uint64) for i in o[lo:hi]]
            trie = Trie(sets[1:], n[rest].tolist())
            found = cid[rest[trie.search(sets[0], int(n[h]), percent)]]
            left.append(np.full(len(found), a[h]))
            right.append(found)
        whole = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        return pa.table({"a": whole(left), "b": whole(right)})

    return run


# ------------------------------------------------------------------ the join


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root, n_copies) of each row: root names the component, n_copies counts rows of the same set."""
    spark = docs.sparkSession
    work = Scratch(spark, "ngram-join")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    crowded = spark.sparkContext.broadcast(_sketch(base, k))

    def to_sets(batches):
        for batch in batches:
            for lo, hi, shingles, at in _each_slice(batch, k):
                items, at = _ordered(tokens_of(shingles, crowded.value), at)
                got = [items[a:b] for a, b in zip(at[:-1], at[1:])]
                n = np.diff(at)
                cid = np.where(n > 0, _classes(items, at), 0)
                prefix = [x[: prefix_length(len(x), percent)].tobytes() if len(x) else None for x in got]
                bits = [bitmap(x).tobytes() if len(x) else None for x in got]
                own = batch.slice(lo, hi - lo)
                yield pa.record_batch({"doc_id": own.column("doc_id"), "text_key": own.column("text_key"), "n": pa.array(n), "cid": pa.array(cid), "prefix": pa.array(prefix, pa.binary()), "bits": pa.array(bits, pa.binary())})

    sets = work.keep(base.mapInArrow(lean(to_sets), "doc_id long, text_key long, n long, cid long, prefix binary, bits binary"), "sets")
    filled = sets.where("n > 0")
    total, items = filled.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)) / 8).first()
    lists = _posting_lists(work, filled, crowded, int(items))
    reps = work.keep(filled.groupBy("cid").agg(F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), "classes")
    lists = work.keep(lists.join(reps.select("cid", "n"), "cid").select("list", "cid", "n"), "lists")
    bits = work.keep(filled.select("cid", "bits").join(lists.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"]), "bits")
    sets = work.keep(sets.select("doc_id", "text_key", "n", "cid"), "rows")
    filled = sets.where("n > 0")
    work.drop("sets", "postings")
    links = all_links(work, lists, bits, lambda likely: _whole_sets(work, base, reps, likely, crowded, k), percent)
    roots = work.keep(components(work, links, "components"), "roots")
    named = reps.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("cid", "copies", "root", "component_id")
    known = attach(filled.select("doc_id", "text_key", "n", "cid"), named, ["cid"], "copies", total)
    none = F.lit(None).cast("long")
    bare = sets.where("n = 0").select("doc_id", "text_key", "n", none.alias("cid"), none.alias("copies"), none.alias("root"), F.col("doc_id").alias("component_id"))
    return known.unionByName(bare).select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root", F.col("copies").alias("n_copies"))


def all_links(work: Scratch, lists: DataFrame, bits: DataFrame, whole, percent: int) -> DataFrame:
    """(a, b): links enough for the components of all links. lists: (list, cid, n); bits: (cid, bits); whole(pairs) gives the sets of the classes in pairs."""

    def verified(likely: DataFrame, name: str) -> DataFrame:
        likely = work.keep(likely, f"{name}-likely")
        links = work.keep(_probed(likely, work.keep(whole(likely), f"{name}-sets"), percent), f"{name}-links")
        work.drop(f"{name}-likely", f"{name}-sets")
        return links

    # lists of more than PART members, each of which has a row here
    long_ = work.keep(lists.groupBy("list").agg(F.count("*").alias("m")).where(F.col("m") > PART), "long-lists")
    buckets = max(1, -(-lists.count() // BUCKET))
    met = _meetings(lists.withColumn("label", F.lit(None).cast("long")), long_, bits, buckets, percent)
    first = verified(met, "hubs")
    links = first
    for name, every in (("closest", False), ("rest", True)):  # what the closest of other labels links needn't meet in all pairs
        labels = work.keep(components(work, links, f"{name}-components").toDF("cid", "label"), f"{name}-labels")
        links = links.union(verified(_meetings(_of_several(lists, labels, buckets * BUCKET), long_, bits, buckets, percent, every), name))
        work.drop(f"{name}-labels")
    return links


def _ordered(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct tokens in order, one row after another, and their offsets."""
    for a, b in zip(at[:-1], at[1:]):
        tokens[a:b].sort()
    new = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
    new[at[:-1][at[1:] > at[:-1]]] = True
    return tokens[new], np.r_[0, np.cumsum(new)][at]


def _classes(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits for each row's set, from two sums over its items."""

    def total(seed: int) -> np.ndarray:
        sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items ^ np.uint64(seed)), out=sums[1:])
        return sums[at[1:]] - sums[at[:-1]]

    return mix(total(0) * np.uint64(3) + (total(0xA5A5A5A5A5A5A5A5) << np.uint64(1)) + np.diff(at).astype(np.uint64)).view(np.int64)


def _posting_lists(work: Scratch, filled: DataFrame, crowded, items: int, per_group: int = 1_000_000) -> DataFrame:
    """(list, cid): the classes that share an item of their prefixes, one list for all items with the same classes.

    Items of cells that aren't crowded are dealt by ranges, at most about ``per_group`` to a group, as packed arrays; only
    what occurs twice leaves the group as rows. Items of crowded cells never gather: they go on as rows.
    """
    groups = max(1, -(-items // per_group))
    width = max(1, (1 << 60) // groups + 1)

    def pack(batches):
        for batch in batches:
            cids = batch.column("cid").to_numpy()
            _, once = np.unique(cids, return_index=True)
            flat = [np.frombuffer(batch.column("prefix")[int(i)].as_py(), np.uint64) for i in once]
            token = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
            owner = np.repeat(cids[once], [len(x) for x in flat])
            plain = token < np.uint64(1 << 60)
            token, owner = token[plain], owner[plain]
            group = (token // np.uint64(width)).astype(np.int64)
            o = np.argsort(group, kind="stable")
            group, token, owner = group[o], token[o], owner[o]
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            ends = np.r_[cut[1:], len(group)] if len(group) else cut
            yield pa.record_batch({"g": pa.array(group[cut] if len(cut) else np.zeros(0, np.int64)), "token": pa.array([token[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), "owner": pa.array([owner[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})

    def shared(t):
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("token").to_pylist()])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in t.column("owner").to_pylist()])
        o = np.lexsort((owner, token))
        token, owner = token[o], owner[o]
        new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        token, owner = token[new], owner[new]
        first = np.r_[True, token[1:] != token[:-1]]
        n = np.diff(np.r_[np.flatnonzero(first), len(token)])
        keep = np.repeat(n, n) > 1
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "cid": pa.array(owner[keep])})

    def hot(batches):
        for batch in batches:
            flat = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            flat = [x[x >= np.uint64(1 << 60)] for x in flat]
            yield pa.record_batch({"token": pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)), "cid": pa.array(np.repeat(batch.column("cid").to_numpy(), [len(x) for x in flat]))})

    rows = filled.select("cid", "prefix")
    cold = rows.mapInArrow(lean(pack), "g long, token binary, owner binary").groupBy("g").applyInArrow(shared, "token long, cid long")
    postings = work.keep(cold.union(rows.mapInArrow(lean(hot), "token long, cid long").distinct()), "postings")
    alike = postings.groupBy("token").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("bit_xor(xxhash64(cid, 1))").alias("y")).where("m > 1")
    kept = alike.groupBy("m", "x", "y").agg(F.min("token").alias("token"))
    return postings.join(kept.select("token"), "token", "left_semi").select(F.col("token").alias("list"), "cid")


def _of_several(lists: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(list, cid, n, label) of lists whose members have more than one label; a class without links is its own label."""
    p = lists.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    by = p.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high").select("list", "m")
    return attach(p, by, ["list"], "m", total).drop("m")


def _meetings(members: DataFrame, long_: DataFrame, bits: DataFrame, buckets: int, percent: int, every: bool = False) -> DataFrame:
    """Pairs (a, b) of a list that pass size and bitmap, each once: with hubs while ``label`` is null, then those whose labels differ, ``every`` one or each member's closest.

    Members of a long list are dealt over its parts by a hash; what has to meet all of them, hubs and, later, the members
    that don't have the list's most frequent label, visits every part.
    """
    long_ = bounded(long_)
    p = members.join(long_.select("list", F.ceil(F.col("m") / PART).alias("parts")), "list", "left")
    z = F.floor(F.log("n") / F.log(F.lit(SIZE_STEP)))
    home = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cid"), F.col("parts"))).cast("int")
    at_home = p.withColumn("part", home).withColumn("visits", F.lit(False))
    dealt = p.where("parts is not null")
    first = dealt.where("label is null").groupBy("list", "parts", z, F.pmod(F.xxhash64("cid"), F.lit(HUBS))).agg(F.min(F.struct(F.xxhash64("cid"), "cid", "n")).alias("h"))
    first = first.select("list", F.col("h.cid").alias("cid"), F.col("h.n").alias("n"), F.lit(None).cast("long").alias("label"), "parts")
    by = dealt.where("label is not null").groupBy("list", "label").agg(F.count("*").alias("m")).groupBy("list").agg(F.max(F.struct("m", "label")).alias("top"))
    few = dealt.join(bounded(by.select("list", F.col("top.label").alias("top"))), "list").where("label <> top").select("list", "cid", "n", "label", "parts")
    guests = first.unionByName(few).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).withColumn("visits", F.lit(True))
    names = ["list", "part", "cid", "n", "label", "visits"]
    rows = at_home.select(names).unionByName(guests.select(names)).join(bits, "cid")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("list", "part"), F.lit(buckets)))
    return rows.groupBy("g").applyInArrow(_meet(percent, every), "a long, b long").distinct()


SIZE_STEP = 1.25  #: of the classes of sizes; sets that can link are in the same class or in neighbours
SMALL = 48  #: members of a list whose pairs are made at once
HELD = 1 << 18  #: pairs that are tested at once, about


def _meet(percent: int, every: bool):
    """Group function of ``_meetings``: the rows of many lists, or parts of them."""

    def run(t: pa.Table) -> pa.Table:
        cid, n = t.column("cid").to_numpy(), t.column("n").to_numpy()
        visits = t.column("visits").to_numpy(zero_copy_only=False)
        plain = t.column("label").null_count == t.num_rows
        packed = t.column("bits").combine_chunks()
        alike = Bitmaps([np.frombuffer(packed[i].as_buffer(), np.uint64) for i in range(t.num_rows)], n)
        key = mix(cid.view(np.uint64))
        lists_, part = t.column("list").to_numpy(), t.column("part").to_numpy()
        o = np.lexsort((part, lists_))
        group = np.empty(len(o), np.int64)
        group[o] = np.cumsum(np.r_[False, (lists_[o][1:] != lists_[o][:-1]) | (part[o][1:] != part[o][:-1])])
        found_a, found_b = [], []

        def test(a, b):
            spare = alike.spare(a, b, percent)
            ok = np.flatnonzero(spare >= 0)
            if not plain and not every and len(ok):
                ok = ok[np.argsort(-spare[ok], kind="stable")]
                ok = ok[np.unique(a[ok], return_index=True)[1]]
            a, b = a[ok], b[ok]
            swap = key[a] > key[b]
            found_a.append(cid[np.where(swap, b, a)])
            found_b.append(cid[np.where(swap, a, b)])

        if plain:
            z = np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int64)
            place = group * 256 + z  # sizes below 1.25 ** 253
            o = np.lexsort((key, ~visits, place))
            sorted_ = place[o]
            for beside in (-1, 0, 1):
                lo, hi = np.searchsorted(sorted_, sorted_ + beside), np.searchsorted(sorted_, sorted_ + beside, side="right")
                for r in range(HUBS):
                    hub = lo + r
                    there = np.flatnonzero((hub < hi) & (hub != np.arange(len(o))))
                    a, b = o[there], o[hub[there]]
                    keep = cid[a] != cid[b]
                    test(a[keep], b[keep])
        else:
            label = t.column("label").to_numpy()
            o = np.lexsort((~visits, group))
            edge = np.searchsorted(group[o], np.arange(group.max() + 2)) if len(o) else np.zeros(1, np.int64)
            size = np.diff(edge)
            left, right, held = [], [], 0

            def flush():
                if left:
                    test(np.concatenate(left), np.concatenate(right))
                left.clear(), right.clear()

            def hold(a, b):  # a member's pairs are never held apart, as its closest is chosen among them
                nonlocal held
                keep = (label[a] != label[b]) & (cid[a] != cid[b])
                left.append(a[keep])
                right.append(b[keep])
                held += len(left[-1])
                if held >= HELD:
                    flush()
                    held = 0

            for m in np.unique(size[(size > 1) & (size <= SMALL)]):  # all lists of a length at once
                x, y = np.triu_indices(m, 1)
                starts = edge[:-1][size == m]
                for i in range(0, len(starts), HELD // len(x) + 1):
                    at = starts[i : i + HELD // len(x) + 1, None]
                    hold(o[(at + x).ravel()], o[(at + y).ravel()])
            for g in np.flatnonzero(size > SMALL):
                own = o[edge[g] : edge[g + 1]]
                values, count = np.unique(label[own], return_counts=True)
                few = own[label[own] != values[count.argmax()]]
                for x in few:  # each against all others of the part, those of its label apart
                    hold(np.full(len(own), x), own)
            flush()
        if not found_a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    return run


def _probed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose items reach the threshold: each hub a meets its members in tries of about CHUNK, many hubs in one group."""
    buckets = max(1, -(-pairs.count() // (CHUNK // 2)))
    size = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = attach(pairs, size, ["a"], "m", buckets * CHUNK // 2).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK))).select("a", "b", "salt")
    members = dealt.join(rows.withColumnRenamed("cid", "b"), "b").select("a", "salt", F.col("b").alias("cid"), "n", "items", F.lit(False).alias("own"))
    hubs = dealt.select("a", "salt").distinct().join(rows.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.col("a").alias("cid"), "n", "items", F.lit(True).alias("own"))
    return members.union(hubs).groupBy(F.pmod(F.xxhash64("a", "salt"), F.lit(buckets)).alias("g")).applyInArrow(_probe(percent), "a long, b long")


def _whole_sets(work: Scratch, base: DataFrame, reps: DataFrame, pairs: DataFrame, crowded, k: int) -> DataFrame:
    """Whole ordered sets of the classes in pairs, made again from one text of each."""
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    keys = bounded(work.keep(reps.join(ids, "cid", "left_semi").select("text_key"), "keys"))
    texts = base.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))

    def whole(batches):
        for batch in batches:
            for *_, shingles, at in _each_slice(batch, k):
                items, at = _ordered(tokens_of(shingles, crowded.value), at)
                yield pa.record_batch({"cid": pa.array(_classes(items, at)), "n": pa.array(np.diff(at)), "items": pa.array([items[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())})

    return texts.select("text").mapInArrow(lean(whole), "cid long, n long, items binary")


def distinct_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay: of each component the document of the smallest id (null last), and all without shingles.

    Rows with one doc_id and different texts are told apart by their text; of rows equal in both, one stays.
    """
    work = Scratch(docs.sparkSession, "ngram-distinct")
    own = work.keep(ngram_join(docs, k, percent).select("doc_id", "text_key", "n_shingles", "root"), "own")
    best = own.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"), F.count("*").alias("m")).where("m > 1").select("root", "best.doc_id", "best.text_key")
    in_groups = own.where("n_shingles > 0").join(best.select("root"), "root", "left_semi")
    stays = in_groups["root"].eqNullSafe(best["root"]) & in_groups["doc_id"].eqNullSafe(best["doc_id"]) & (in_groups["text_key"] == best["text_key"])
    # what goes is less than what stays, so the texts that stay needn't move for it
    goes = bounded(work.keep(in_groups.join(best, stays, "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "goes"))
    rows = docs.withColumn("_own_key", F.xxhash64(F.col("text").cast("string")))
    same = rows["doc_id"].cast("long").eqNullSafe(goes["_id"]) & (rows["_own_key"] == goes["_key"])
    kept = rows.join(goes, same, "left_anti")
    if not own.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_own_key"])
    return kept.select(docs.columns)
