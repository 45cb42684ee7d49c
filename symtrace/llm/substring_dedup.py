"""Substring dedup: repeated passages by MinHash bands over paragraphs, and exact spans in what is left.

Paragraphs are the lines of a text with ``min_words`` words or more, and neighbouring shorter lines joined until they have
as many. Equal paragraphs (by the hashes of
their words) are one class. Each class of k-word shingles has BANDS bands of ROWS minima; classes that
share a band meet hubs of that band, are verified by their exact Jaccard similarity, and then all that
share a band and still are in different components are compared. At the threshold of 0.8 a pair shares no
band with probability (1 - 0.8 ** 4) ** 20, below 3e-5 (simulated: 3 of 120,000 pairs).

Windows of SPAN words, wherever lines break, are compared but those that lie in removed paragraphs. Only windows that hold a
seed that occurs twice, the least GRAM words of a window, are hashed as a whole. Runs of windows that occur
together are spans, rows with a null line.

Of a component's occurrences one stays, that with the smallest doc_id (null last) and place; all others
are removals. Components are kept as (class, root) tables, so that copies are never expanded into pairs.

Defined cases: null and empty texts have no paragraphs; fewer than ``min_words`` words between longer lines are removed only within a span; a passage that
one document repeats is repeated as well; equal rows repeat each other; a null doc_id ranks last; an
empty table gives an empty result; extra columns are carried by ``without_repeats``, ignored otherwise. Offsets are bytes of
the UTF-8 text, and lines by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.common import BROADCAST_KEYS, SPACE_BYTES, Scratch, _powers, attach, bounded, components, lean, mix, row_shingles, slices, text_bytes, word_hashes
from symtrace.llm.ngram_join import all_links, bitmap

BANDS, ROWS = 20, 4
MIN_WORDS = 20
SPAN = 50  #: words of the shortest span
GRAM = 20  #: words of a seed

_SEEDS, _ODD = np.random.default_rng(77).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.zeros(0, np.uint64)


def _hashed(batch: pa.RecordBatch):
    """(first row, offsets of the rows' bytes, offsets of the lines' bytes, word hashes, offsets of the lines' words) of runs of rows."""
    texts = batch.column("text")
    for lo, hi in slices(texts):
        data, at = text_bytes(texts.slice(lo, hi - lo))
        edges = np.union1d(np.flatnonzero(data == 10) + 1, at)
        words, rows = word_hashes(data, edges, SPACE_BYTES)
        yield lo, at, edges, words, rows


def _lines(lo: int, at: np.ndarray, edges: np.ndarray, words: np.ndarray, rows: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Row, line, first and last byte, first and last word of every paragraph of a slice, in order."""
    owner = np.searchsorted(at, edges[:-1], side="right") - 1
    n = np.diff(rows)
    whole = np.flatnonzero(n >= min_words)
    runs = np.array(_short_runs(n, owner, min_words), np.int64).reshape(-1, 2)
    a, b = np.r_[whole, runs[:, 0]], np.r_[whole + 1, runs[:, 1]]
    o = np.argsort(a, kind="stable")
    a, b = a[o], b[o]
    i = owner[a]
    return lo + i, a - np.searchsorted(edges, at)[i], edges[a] - at[i], edges[b] - at[i], rows[a], rows[b]


def _short_runs(n: np.ndarray, owner: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Neighbouring shorter lines of a text, joined until they have ``min_words`` words; what is left over goes with the paragraph before it."""
    short = np.flatnonzero((n < min_words) & (n > 0))
    longer = np.cumsum(n >= min_words)
    found: list[tuple[int, int]] = []
    run, start, end, have, joined = None, 0, 0, 0, False
    for j, m, key in [*zip(short.tolist(), n[short].tolist(), zip(owner[short].tolist(), longer[short].tolist())), (0, 0, None)]:
        if key != run:
            if have and joined:
                found[-1] = (found[-1][0], end)
            run, have, joined = key, 0, False
        if not have:
            start = j
        have, end = have + m, j + 1
        if have >= min_words:
            found.append((start, end))
            have, joined = 0, True
    return found


def _gathered(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of paragraphs one after another, and their n + 1 offsets."""
    at = np.r_[0, np.cumsum(end - start)]
    return words[np.arange(at[-1]) + np.repeat(start - at[:-1], end - start)], at


def classes_of(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits for the sequence of words of every paragraph, none of them empty."""
    global _PLACES
    n = np.diff(at)
    if not len(n):
        return np.zeros(0, np.int64)
    if (top := int(n.max())) > len(_PLACES):
        _PLACES = mix(np.arange(1, 2 * top, dtype=np.uint64)) | np.uint64(1)
    place = np.arange(len(flat)) - np.repeat(at[:-1], n)
    return mix(np.add.reduceat(flat * _PLACES[place], at[:-1]) + n.astype(np.uint64)).view(np.int64)


def bands_of_rows(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each row and band. Each MinHash row draws the item whose product with an odd seed is least: unlike an exclusive or, that orders the items anew for every seed."""
    if len(at) < 2:
        return np.zeros((0, BANDS), np.uint64)
    low = np.stack([np.minimum.reduceat(items * seed, at[:-1]) for seed in _SEEDS], 1)
    return mix((low * _ODD).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))


def bands_of(items: np.ndarray) -> np.ndarray:
    return bands_of_rows(items, np.array([0, len(items)]))[0]


def distinct_counts(items: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many different items each row has."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    o = np.lexsort((items, row))
    new = np.r_[True, (items[o][1:] != items[o][:-1]) | (row[o][1:] != row[o][:-1])][: len(o)]
    return np.bincount(row[o][new], minlength=len(at) - 1)


def _found(docs: DataFrame, min_words: int) -> DataFrame:
    rows = docs.select(F.col("_place").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in _hashed(batch):
                row, line, first, last, start, end = _lines(*part, min_words)
                pick = pa.array(row)
                yield pa.record_batch({"place": batch.column("place").take(pick), "doc_id": batch.column("doc_id").take(pick), "line": pa.array(line.astype(np.int32)), "first": pa.array(first), "last": pa.array(last), "n_words": pa.array((end - start).astype(np.int32)), "cid": pa.array(classes_of(*_gathered(part[3], start, end)))})

    return rows.mapInArrow(lean(run), "place long, doc_id long, line int, first long, last long, n_words int, cid long")


def _dealt(group: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row for each group, with its part of every array as bytes; the order within a group stays."""
    o = np.argsort(group, kind="stable")
    group = group[o]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    end = np.r_[cut[1:], len(group)] if len(group) else cut
    return pa.record_batch({"g": pa.array(group[cut].astype(np.int64))} | {name: pa.array([x[a:b].tobytes() for a, b in zip(cut, end)], pa.binary()) for name, x in ((name, x[o]) for name, x in arrays.items())})


def _joined(t, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()]) for name, kind in kinds.items()]


def _range_of(token: np.ndarray, groups: int) -> np.ndarray:
    return (((token >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def _posted(docs: DataFrame, k: int, min_words: int, per_group: int, total: int, n_words: int) -> DataFrame:
    """(list, cid, n): the classes that share a band with another; and, with a null list, (place, word) of seeds that occur twice or more.

    Bands and seeds are dealt as packed arrays by ranges of the hash. A seed that a batch holds twice goes on at once, and
    only a mark of it is dealt, so a seed of all texts has a row a batch in its group.
    """
    groups = max(1, -(-total * BANDS // per_group))
    ranges = max(1, -(-n_words * 2 // (SPAN - GRAM + 2) // per_group))

    def pack(batches):
        for batch in batches:
            token, owner, size, seen = [], [], [], set()
            seed, place, word = [], [], []
            places = batch.column("place").to_numpy()
            for part in _hashed(batch):
                *_, start, end = _lines(*part, min_words)
                flat, off = _gathered(part[3], start, end)
                cid, one = np.unique(classes_of(flat, off), return_index=True)
                one = one[[c not in seen for c in cid.tolist()]]  # a class once for a batch
                if len(one):
                    flat, off = _gathered(part[3], start[one], end[one])
                    cid = classes_of(flat, off)
                    seen.update(cid.tolist())
                    items, off = row_shingles(flat, off, k)
                    token.append(bands_of_rows(items, off).ravel())
                    owner.append(np.repeat(cid, BANDS))
                    size.append(np.repeat(distinct_counts(items, off).astype(np.int32), BANDS))
                lo, at, edges, words, rows = part
                starts = rows[np.searchsorted(edges, at)]
                gram, spot = seeds_of(words, starts)
                row = np.searchsorted(starts, spot, side="right") - 1
                seed.append(gram)
                place.append(places[lo + row])
                word.append((spot - starts[row]).astype(np.int32))
            if owner:
                yield _dealt(_range_of(np.concatenate(token), groups), token=np.concatenate(token), owner=np.concatenate(owner), size=np.concatenate(size))
            if sum(map(len, seed)):
                seed, place, word = np.concatenate(seed), np.concatenate(place), np.concatenate(word)
                o = np.argsort(seed, kind="stable")
                seed, place, word = seed[o], place[o], word[o]
                new = np.r_[True, seed[1:] != seed[:-1]]
                twice = ~new | np.r_[~new[1:], False]
                yield _dealt(-1 - ranges - _range_of(mix(place[twice].view(np.uint64)), ranges), token=seed[twice], owner=place[twice], size=word[twice])
                yield _dealt(-1 - _range_of(seed[new], ranges), token=seed[new], owner=np.where(twice, -1, place)[new], size=word[new])

    def shared(key, t):
        token, owner, size = _joined(t, token=np.uint64, owner=np.int64, size=np.int32)
        if (g := key[0].as_py()) < 0:
            if g >= -ranges:
                _, which, n = np.unique(token, return_inverse=True, return_counts=True)
                keep = (n[which] > 1) & (owner >= 0)
                owner, size = owner[keep], size[keep]
            return pa.table({"list": pa.nulls(len(owner), pa.int64()), "cid": pa.array(owner), "n": pa.array(size.astype(np.int64))})
        o = np.lexsort((owner, token))
        token, owner, size = token[o], owner[o], size[o]
        new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        token, owner, size = token[new], owner[new], size[new]
        n = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)])
        keep = np.repeat(n, n) > 1
        return pa.table({"list": pa.array(token[keep].view(np.int64)), "cid": pa.array(owner[keep]), "n": pa.array(size[keep].astype(np.int64))})

    rows = docs.select(F.col("_place").alias("place"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(pack), "g long, token binary, owner binary, size binary").groupBy("g").applyInArrow(shared, "list long, cid long, n long")


# ------------------------------------------------------------------ exact spans


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _windowed(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` neighbours, by running sums: the same wherever they stand."""
    powers, inverse = _powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[: len(words) - width + 1]) if len(words) >= width else np.zeros(0, np.uint64)


def seeds_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place among the words) of every GRAM words that are the least of a window of SPAN words in one text: equal windows have equal seeds."""
    if len(words) < SPAN:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, width = _windowed(words, GRAM), SPAN - GRAM + 1
    least = _slide(grams, width, np.minimum)
    crossing = np.zeros(len(words) + 1, np.int64)  # windows that hold words of two texts
    edge = starts[1:-1]
    np.add.at(crossing, np.maximum(edge - SPAN + 1, 0), 1)
    np.add.at(crossing, edge, -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    none = np.zeros(width - 1, np.uint64)
    spot = np.flatnonzero((_slide(np.concatenate([none, least, none]), width, np.maximum) == grams) & (grams > 0))
    return grams[spot], spot


_KINDS = {"h": np.uint64, "no_id": np.uint8, "doc": np.int64, "place": np.int64, "pos": np.int32}
_SUMS = {"m": np.int64, "s0": np.uint64, "s1": np.uint64}
_PACKED = ", ".join(f"{x} binary" for x in _KINDS)


def _windows(texts: DataFrame, groups: int) -> DataFrame:
    """Windows of SPAN words that hold a seed of their text's list, but those wholly in lines that go; dealt by seeds, so that neighbours stay together."""

    def run(batches):
        for batch in batches:
            got = {x: [] for x in ("seed", *_KINDS, "first", "last")}
            column, places, ids = batch.column("text"), batch.column("place").to_numpy(), batch.column("doc_id")
            for lo, hi in slices(column):
                data, at = text_bytes(column.slice(lo, hi - lo))
                hashes, rows = word_hashes(data, at, SPACE_BYTES)
                for i in range(hi - lo):
                    w = hashes[rows[i] : rows[i + 1]]
                    if len(w) < SPAN:
                        continue
                    grams = _windowed(w, GRAM)
                    least = _slide(grams, SPAN - GRAM + 1, np.minimum)
                    found = np.isin(least, grams[np.array(batch.column("words")[lo + i].as_py(), np.int64)])
                    inside = np.r_[False, ~SPACE_BYTES[data[at[i] : at[i + 1]]], False]
                    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
                    if gone := batch.column("gone")[lo + i].as_py():
                        mark = np.zeros(len(w) + 1, np.int64)
                        for g in gone:
                            mark[np.searchsorted(first, g["first"])] += 1
                            mark[np.searchsorted(first, g["last"])] -= 1
                        left = np.r_[0, np.cumsum(np.cumsum(mark[:-1]) == 0)]
                        found &= left[SPAN:] > left[:-SPAN]
                    p = np.flatnonzero(found)
                    if not len(p):
                        continue
                    d = ids[lo + i].as_py()
                    for name, x in zip(got, (least[p], _windowed(w, SPAN)[p], np.full(len(p), d is None, np.uint8), np.full(len(p), d or 0, np.int64), np.full(len(p), places[lo + i], np.int64), p.astype(np.int32), first[p].astype(np.int32), last[p + SPAN - 1].astype(np.int32))):
                        got[name].append(x)
            if got["seed"]:
                flat = {name: np.concatenate(x) for name, x in got.items()}
                yield _dealt(_range_of(mix(flat.pop("seed")), groups), **flat)

    return texts.mapInArrow(lean(run), f"g long, {_PACKED}, first binary, last binary")


def _summed(h, no_id, doc, place, pos, m, s0, s1) -> dict[str, np.ndarray]:
    """The least occurrence of each window, the number of all, and two sums that tell which texts and where."""
    o = np.lexsort((pos, place, doc, no_id, h))
    h, no_id, doc, place, pos, m, s0, s1 = (x[o] for x in (h, no_id, doc, place, pos, m, s0, s1))
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return {"h": h[cut], "no_id": no_id[cut], "doc": doc[cut], "place": place[cut], "pos": pos[cut]} | {name: np.add.reduceat(x, cut) for name, x in (("m", m), ("s0", s0), ("s1", s1))}


def _spans(work: Scratch, windows: DataFrame, per_group: int, buckets: int) -> DataFrame:
    """Every occurrence of a maximal run of windows that occur together, twice or more: columns as of ``repeats``.

    Windows of a packed row are summed before they are dealt, and results go back to parts of a group, so a window of all texts gathers nowhere.
    """
    packed = f"{_PACKED}, m binary, s0 binary, s1 binary"

    def sums(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _joined(batch.slice(i, 1), **_KINDS)
                who = mix(x[3].view(np.uint64))
                out = _summed(*x, np.ones(len(who), np.int64), who, who * (x[4].astype(np.uint64) + np.uint64(1)))
                yield _dealt(np.full(len(out["h"]), batch.column("g")[i].as_py(), np.int64), **out)

    def total(key, t):
        out = _summed(*_joined(t, **_KINDS, **_SUMS))
        keep = out["m"] > 1
        return pa.Table.from_batches([_dealt(np.full(int(keep.sum()), key[0].as_py(), np.int64), **{name: x[keep] for name, x in out.items()})])

    def runs(key, ours, theirs):
        names = ("place", "doc_id", "pos", "n", "first", "last", "cluster", "occurrences", "keep_id", "keep_place", "keep_pos", "head", "tail")
        out = {name: [] for name in names}
        known = dict(zip([*_KINDS, *_SUMS], _joined(theirs, **_KINDS, **_SUMS))) if theirs.num_rows else {"h": []}
        for i in range(ours.num_rows if len(known["h"]) else 0):
            h, no_id, doc, place, pos, first, last = _joined(ours.slice(i, 1), **_KINDS, first=np.int32, last=np.int32)
            at = np.searchsorted(known["h"], h)
            hit = np.flatnonzero(known["h"][np.minimum(at, len(known["h"]) - 1)] == h)
            if not len(hit):
                continue
            h, no_id, doc, place, pos, first, last, at = (x[hit] for x in (h, no_id, doc, place, pos, first, last, at))
            m, s0, s1, kp, kw = (known[name][at] for name in ("m", "s0", "s1", "place", "pos"))
            sign = lambda ahead: mix(mix(mix(s0 + m.view(np.uint64)) ^ (s1 + ahead * s0)) + mix(kp.view(np.uint64)) + kw.astype(np.uint64) + ahead)
            head, tail = sign(np.uint64(0)), sign(np.uint64(1))
            cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (pos[1:] != pos[:-1] + 1) | (head[1:] != tail[:-1])])
            end = np.r_[cut[1:], len(h)] - 1
            ids = lambda x, none: pa.array(x, mask=none.astype(bool))
            for name, x in zip(names, (place[cut], ids(doc[cut], no_id[cut]), pos[cut].astype(np.int64), (end - cut + 1).astype(np.int64), first[cut].astype(np.int64), last[end].astype(np.int64), h[cut].view(np.int64), m[cut], ids(known["doc"][at[cut]], known["no_id"][at[cut]]), kp[cut], kw[cut].astype(np.int64), head[cut].view(np.int64), tail[end].view(np.int64))):
                out[name].append(pa.array(x) if isinstance(x, np.ndarray) else x)
        return pa.table({name: pa.chunked_array(x, pa.int64()) for name, x in out.items()})

    stats = work.keep(windows.mapInArrow(lean(sums), f"g long, {packed}").groupBy("g").applyInArrow(total, f"g long, {packed}"), "window-sums")
    parts = work.keep(windows.groupBy("g").agg(F.ceil(F.sum(F.octet_length("pos")) / (16 * per_group)).alias("parts")), "window-parts")
    ours = windows.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("h", "place"), "parts")).drop("parts")
    theirs = stats.join(parts, "g").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    longs = ("place", "doc_id", "pos", "n", "first", "last", "cluster", "occurrences", "keep_id", "keep_place", "keep_pos", "head", "tail")
    found = ours.groupBy("g", "part").cogroup(theirs.groupBy("g", "part")).applyInArrow(runs, ", ".join(f"{x} long" for x in longs))
    own = ", ".join(("place long, doc_id long, line int", "first long, last long, n_words int, cluster long, occurrences long, keep_doc_id long, removed boolean"))
    return found.withColumn("b", F.pmod(F.xxhash64("place"), F.lit(buckets))).groupBy("b").applyInArrow(_rejoined, own)


def _rejoined(t: pa.Table) -> pa.Table:
    """Runs that seeds have cut go together again; one that overlaps the occurrence of its own text that stays begins where that one ends."""
    t = t.sort_by([("place", "ascending"), ("pos", "ascending")])
    place, pos, n, first, last, cluster, m, kp, kw, head, tail = (t.column(c).to_numpy() for c in ("place", "pos", "n", "first", "last", "cluster", "occurrences", "keep_place", "keep_pos", "head", "tail"))
    goes_on = np.r_[False, (place[1:] == place[:-1]) & (pos[1:] == pos[:-1] + n[:-1]) & (head[1:] == tail[:-1])][: len(pos)]
    cut = np.flatnonzero(~goes_on)
    n, last = np.add.reduceat(n, cut), np.maximum.reduceat(last, cut)
    place, pos, first, cluster, m, kp, kw = (x[cut] for x in (place, pos, first, cluster, m, kp, kw))
    stays = (place == kp) & (pos == kw)
    over = np.where(~stays & (place == kp), np.maximum(0, kw + n - 1 + SPAN - pos), 0)
    _, which = np.unique(np.stack([place, cluster]), axis=1, return_inverse=True)
    kept_last = np.zeros(which.max() + 1, np.int64)
    np.maximum.at(kept_last, which[stays], last[stays])
    first = np.where(over > 0, np.maximum(first, kept_last[which]), first)
    pick = pa.array(cut)
    return pa.table({"place": place, "doc_id": t.column("doc_id").take(pick), "line": pa.nulls(len(cut), pa.int32()), "first": first, "last": last, "n_words": (n + SPAN - 1 - over).astype(np.int32), "cluster": cluster, "occurrences": m, "keep_doc_id": t.column("keep_id").take(pick), "removed": ~stays})


def _items(work: Scratch, docs: DataFrame, wanted: DataFrame, found: DataFrame, k: int, min_words: int) -> DataFrame:
    """(cid, n, items, bits): whole sets of the wanted classes, made again from one occurrence of each."""
    spots = found.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("place", "line")).alias("at")).select(F.col("at.place").alias("place"), "cid")
    spots = bounded(work.keep(spots.groupBy("place").agg(F.collect_list("cid").alias("cids")), "spots"))
    texts = docs.select(F.col("_place").alias("place"), F.col("text").cast("string").alias("text")).join(spots, "place")

    def run(batches):
        for batch in batches:
            want = [set(x) for x in batch.column("cids").to_pylist()]
            cid, n, items, bits = [], [], [], []
            for part in _hashed(batch):
                row, *_, start, end = _lines(*part, min_words)
                own = classes_of(*_gathered(part[3], start, end)).tolist()
                for i, c, a, b in zip(row.tolist(), own, start, end):
                    if c in want[i]:
                        want[i].discard(c)
                        s = np.unique(row_shingles(part[3][a:b], np.array([0, b - a]), k)[0])
                        cid.append(c)
                        n.append(len(s))
                        items.append(s.tobytes())
                        bits.append(bitmap(s).tobytes())
            yield pa.record_batch({"cid": pa.array(cid, pa.int64()), "n": pa.array(n, pa.int64()), "items": pa.array(items, pa.binary()), "bits": pa.array(bits, pa.binary())})

    return texts.select("text", "cids").mapInArrow(lean(run), "cid long, n long, items binary, bits binary")


def repeats(docs: DataFrame, k: int = 5, percent: int = 80, min_words: int = MIN_WORDS, per_group: int = 1_000_000) -> DataFrame:
    """Every occurrence of a passage that occurs more than once.

    (doc_id, line, first, last, n_words, cluster, occurrences, keep_doc_id, removed); ``place`` tells rows of the input apart.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "substring-dedup")
    if "_place" not in docs.columns:
        # a scan gives its rows the same places each time; anything else is written first
        scan = docs.select("doc_id", "text")
        docs = (scan if docs.inputFiles() else work.keep(scan, "texts")).withColumn("_place", F.monotonically_increasing_id())
    found = work.keep(_found(docs, min_words), "found")
    total, n_words = found.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    posted = work.keep(_posted(docs, k, min_words, per_group, total, n_words), "posted")
    lists = work.keep(posted.where("list is not null"), "lists")
    seeds = work.keep(posted.where("list is null").select(F.col("cid").alias("place"), "n"), "seeds")
    work.drop("posted")
    sets = work.keep(_items(work, docs, lists.select("cid").distinct(), found, k, min_words), "sets")
    bits = sets.select("cid", "bits")
    wanted = lambda pairs: sets.drop("bits").join(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "cid", "left_semi")
    roots = work.keep(components(work, all_links(work, lists, bits, wanted, percent), "components"), "roots")
    sizes = found.groupBy("cid").agg(F.count("*").alias("m"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place", "line")).alias("least"))
    sizes = sizes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("cluster", F.coalesce("root", "cid"))
    clusters = sizes.groupBy("cluster").agg(F.sum("m").alias("occurrences"), F.min("least").alias("best")).where("occurrences > 1")
    named = work.keep(sizes.select("cid", "cluster", "m").join(clusters, "cluster"), "named")
    out = attach(found, named, ["cid"], "m", max(total, 1))
    stays = (F.col("place") == F.col("best.place")) & (F.col("line") == F.col("best.line"))
    out = work.keep(out.select("place", "doc_id", "line", "first", "last", "n_words", "cluster", "occurrences", F.col("best.doc_id").alias("keep_doc_id"), (~stays).alias("removed")), "lines")
    work.drop("found", "lists", "sets", "roots", "named")
    words = seeds.groupBy("place").agg(F.collect_list("n").alias("words"), F.count("*").alias("n"))
    gone = out.where("removed").groupBy("place").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    marked = work.keep(words.join(gone, "place", "left"), "marked")
    n_seeds, n_gone = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size(F.coalesce("gone", F.array()))), F.lit(0))).first()
    groups = max(1, -(-n_seeds * (SPAN - GRAM + 2) // 2 // (per_group // 4)))
    # few marks, by count, go to the texts; more meet them by a shuffle
    marked = F.broadcast(marked.drop("n")) if n_seeds + 2 * n_gone <= BROADCAST_KEYS else marked.drop("n")
    texts = docs.select(F.col("_place").alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(marked, "place")
    windows = work.keep(_windows(texts, groups), "windows")
    spans = work.keep(_spans(work, windows, per_group, max(1, n_seeds // 2000)), "spans")
    work.drop("seeds", "marked", "windows", "window-sums", "window-parts")
    return out.unionByName(spans)


def _cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    """The texts without their removals; a cut line takes its line break along, the last one that before it."""

    def one(text, rows):
        if rows is None or text is None:
            return text
        data = text.encode()
        keep = np.ones(len(data), bool)
        for r in rows:
            keep[r["first"] : r["last"]] = False
        left = np.frombuffer(data, np.uint8)[keep].tobytes().decode()
        last_line = not text.endswith("\n") and any(r["line"] is not None and r["last"] == len(data) for r in rows)
        return left.removesuffix("\n") if last_line else left

    return pd.Series([one(t, c) for t, c in zip(texts, cuts)], dtype=object)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows with their removals cut out of the text, lines and spans; rows without removals pass through untouched."""
    work = Scratch(docs.sparkSession, "substring-cut")
    own = work.keep(docs.withColumn("_place", F.monotonically_increasing_id()), "rows")
    cut = work.keep(repeats(own, **options).where("removed").groupBy(F.col("place").alias("_place")).agg(F.collect_list(F.struct("line", "first", "last")).alias("_cut")), "cut")
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.pandas_udf(_cut, "string")("text", "_cut"))
    return own.join(cut, "_place", "left").withColumn("text", text).select(docs.columns)
