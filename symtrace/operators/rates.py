"""Code lengths and rates: n-gram prequential codes, order-0 models, byte coders, the exact interval coder."""

from __future__ import annotations

import lzma
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symtrace.functions.symbols import symbols
from symtrace.operators import folds

ORDERS = (0, 1, 2, 3, 4, 5, 6)


def exploded(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, sym), pos from 0."""
    return df.select(key, F.posexplode(symbols(F.col(text))).alias("pos", "sym"))


COUNTED = 60_000  #: bytes of texts whose contexts are counted at once; contexts then have 16 bits, which numpy sorts by radix


def _sorted(key: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """The stable order of whole numbers below 2 ** 32, or of those in an order given, 16 bits after the other."""
    o = np.arange(len(key)) if among is None else among
    o = o[np.argsort(key[o].astype(np.uint16), kind="stable")]
    return o if key.max(initial=0) < 1 << 16 else o[np.argsort((key >> 16)[o].astype(np.uint16), kind="stable")]


def _before(o: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of its group come before each, in an order that groups them; ``first`` marks each group's first."""
    start = np.flatnonzero(first)
    out = np.empty(len(o), np.int64)
    out[o] = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    return out


def _codes(ids: np.ndarray, at: np.ndarray, orders) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, how often each symbol's context came before, and with that symbol) of texts one after another, contexts at a text's start being shorter."""
    context, by_symbol = folds.of_row(at), _sorted(ids)
    some = at[:-1][np.diff(at) > 0]
    for order in range(max(orders) + 1):
        o = _sorted(context, by_symbol)
        c, i = context[o], ids[o]
        first = np.r_[True, (c[1:] != c[:-1]) | (i[1:] != i[:-1])]
        if order in orders:
            p = _sorted(context)
            yield order, _before(p, np.r_[True, context[p][1:] != context[p][:-1]]), _before(o, first)
        # the last ``order`` + 1 symbols are the last ``order`` of the place before, and the symbol there
        group = np.empty(len(ids), np.int64)
        group[o] = np.cumsum(first) - 1
        context = np.r_[0, group[:-1]]
        context[some] = int(first.sum()) + np.arange(len(some))


def _bits(points: np.ndarray, at: np.ndarray, orders) -> Iterator[tuple[int, np.ndarray]]:
    """(order, bits of each symbol) of texts one after another."""
    if len(points):
        _, first, ids = folds.alphabets(points, at)
        n = np.repeat(np.diff(first), np.diff(at))
        for order, seen, same in _codes(ids, at, orders):
            yield order, -np.log2((same + 1) / (seen + n))


def ngram_bits(df: DataFrame, orders=ORDERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, ord, n, bits): add-one prequential code length of each of a text's n symbols; contexts at its start are shorter.

    Texts are counted in their task, by sorts of their contexts, so nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            for rows, points, at in folds.texts(batch, most=COUNTED):
                row = folds.of_row(at)
                pos, n = (np.arange(len(points)) - at[row]).astype(np.int32), np.diff(at)[row]
                for order, bits in _bits(points, at, orders):
                    for a in range(0, len(bits), folds.BLOCK):
                        p = slice(a, a + folds.BLOCK)
                        yield pa.record_batch({key: rows.column("_key").take(pa.array(row[p])), "pos": pa.array(pos[p]), "ord": pa.array(np.full(len(pos[p]), order, np.int32)), "n": pa.array(n[p]), "bits": pa.array(bits[p])})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bits", T.DoubleType())])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, schema)


def ngram_rate(df: DataFrame, orders=ORDERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, symbols, bits, bpc), one row a text and order, summed within the row."""

    def run(batches):
        for batch in batches:
            for rows, points, at in folds.texts(batch, most=COUNTED):
                some = np.flatnonzero(np.diff(at))
                for order, bits in _bits(points, at, orders):
                    sums = [float(bits[at[i] : at[i + 1]].sum()) for i in some]
                    yield pa.record_batch({key: rows.column("_key").take(pa.array(some)), "ord": pa.array(np.full(len(some), order, np.int32)), "symbols": pa.array(np.diff(at)[some]), "bits": pa.array(sums, pa.float64())})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ord", T.IntegerType()), T.StructField("symbols", T.LongType()), T.StructField("bits", T.DoubleType())])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumn("bpc", F.col("bits") / F.col("symbols"))


def best_order(rates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, bpc) of the least rate, the lowest order first."""
    return rates.groupBy(key).agg(F.min(F.struct("bpc", "ord")).alias("b")).select(key, F.col("b.ord").alias("ord"), F.col("b.bpc").alias("bpc"))


def perplexities(series: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, ppl, first_ppl, last_ppl) of (key, pos, n, nll), n rows a key; halves meet at n div 2, and a half without rows is null."""
    early = F.col("pos") < F.expr("n div 2")
    return series.groupBy(key, "n").agg(F.exp(F.avg("nll")).alias("ppl"), F.exp(F.avg(F.when(early, F.col("nll")))).alias("first_ppl"), F.exp(F.avg(F.when(~early, F.col("nll")))).alias("last_ppl"))


def order0_model(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sym, cnt, cum_lo, cum_hi, total): intervals in symbol order, as whole numbers."""
    counts = exploded(df, key, text).groupBy(key, "sym").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(key)
    high = F.sum("cnt").over(w.orderBy("sym"))
    return counts.withColumn("cum_hi", high).withColumn("cum_lo", F.col("cum_hi") - F.col("cnt")).withColumn("total", F.sum("cnt").over(w))


def ideal_bits(model: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, symbols, bits, uniform_bits): order-0 code length, and that of equal probabilities."""
    each = F.col("cnt") * -F.log2(F.col("cnt") / F.col("total"))
    return model.groupBy(key).agg(F.sum("cnt").alias("symbols"), F.sum(each).alias("bits"), F.count("*").alias("_v")).withColumn("uniform_bits", F.col("symbols") * F.log2("_v")).drop("_v")


@F.pandas_udf(T.LongType())
def zlib_size(text: pd.Series) -> pd.Series:
    """Bytes of UTF-8 after zlib at level 9."""
    return text.map(lambda t: len(zlib.compress(t.encode(), 9)), na_action="ignore")


@F.pandas_udf(T.LongType())
def lzma_size(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(lzma.compress(t.encode())), na_action="ignore")


# ------------------------------------------------------------------ interval coder, unbounded rationals


class Intervals:
    """Order-0 model of a text: each symbol's interval of [0, 1), as whole numbers over the text's length.

    Points are pairs (numerator, denominator), never reduced: at these sizes that is cheaper than common divisors.
    """

    def __init__(self, text: str):
        self.total = len(text)
        self.symbols = sorted(set(text))
        self.counts = [text.count(s) for s in self.symbols]
        self.lows = [0, *accumulate(self.counts)][:-1]
        self.rank = {s: i for i, s in enumerate(self.symbols)}

    def point(self, text: str) -> tuple[int, int]:
        """The low end of the interval that the text narrows [0, 1) to."""
        low, width, whole = 0, 1, 1
        for s in text:
            i = self.rank[s]
            low, width, whole = low * self.total + width * self.lows[i], width * self.counts[i], whole * self.total
        return low, whole

    def text(self, point: tuple[int, int], n: int) -> str:
        """n symbols; where no interval holds the point, the last symbol stands in, as for damaged points."""
        (p, q), out = point, []
        for _ in range(n):
            at = p * self.total // q
            i = bisect_right(self.lows, at) - 1 if 0 <= at < self.total else len(self.symbols) - 1
            out.append(self.symbols[i])
            p, q = p * self.total - self.lows[i] * q, q * self.counts[i]
        return "".join(out)


def cut(point: tuple[int, int], bits: int) -> tuple[int, int]:
    return (point[0] << bits) // point[1], 1 << bits


BLOCKS = 640  #: blocks that are coded at once, forwards and backwards


def interval_sweep(df: DataFrame, budgets=(200, 400, 800, 1200), key: str = "doc_id", text: str = "text", length: int = 240) -> DataFrame:
    """(key, block, reverse, bits, symbols, wrong, first_bad, last_bad, lossless).

    Whole texts are coded in blocks of ``length`` symbols, each with its own model, forwards and from its end.
    """

    whole = lambda v: pa.array(np.asarray(v, np.int32))

    def run(batches):
        for batch in batches:
            for rows, points, at in folds.texts(batch, most=folds.SLICE // 4):
                if not len(points):
                    continue
                blocks = -(-np.diff(at) // length)
                row = np.repeat(np.arange(len(blocks)), blocks)
                no = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                s = at[row] + no * length
                n = np.minimum(length, at[row + 1] - s)
                for lo in range(0, len(s), BLOCKS):
                    part = slice(lo, lo + BLOCKS)
                    m, size, keys = len(s[part]), n[part], rows.column("_key").take(pa.array(row[part]))
                    inside = np.arange(length) < size[:, None]
                    spelt = np.zeros((m, length), np.uint32)
                    spelt[inside] = points[s[lo] : s[lo] + size.sum()]
                    exact, wrong = _swept(spelt, size, budgets)
                    for bits, both in zip(budgets, wrong):
                        for reverse, bad in enumerate(both.reshape(2, m, length)):
                            some, first, last = bad.any(1), bad.argmax(1), length - 1 - bad[:, ::-1].argmax(1)
                            if reverse:
                                first, last = size - 1 - last, size - 1 - first
                            yield pa.record_batch({key: keys, "block": whole(no[part]), "reverse": pa.array(np.full(m, bool(reverse))), "bits": whole(np.full(m, bits)), "symbols": whole(size), "wrong": whole(bad.sum(1)), "first_bad": whole(np.where(some, first, -1)), "last_bad": whole(np.where(some, last, -1)), "lossless": pa.array(exact[reverse * m : reverse * m + m])})

    return df.select(F.col(key).alias("_key"), F.col(text).alias("text")).mapInArrow(run, f"{key} long, block int, reverse boolean, bits int, symbols int, wrong int, first_bad int, last_bad int, lossless boolean")


_WIDE = 28  #: bits of a limb of a fixed-point number; times three symbols' factors it stays below 2 ** 53
_LANES = 1280  #: fixed-point numbers that are worked on at once
_NEAR = -20  #: a point this near to 1, as a logarithm, is too near for the upper limbs to tell


def _swept(spelt: np.ndarray, n: np.ndarray, budgets) -> tuple[np.ndarray, list[np.ndarray]]:
    """(exact, wrong for each budget) of blocks and then of the same blocks from their ends: whether each block's point lies in the block's interval, and which symbols its point cut to some bits gives wrong.

    As ``Intervals.point``, ``cut`` and ``Intervals.text`` for each block. A block's point is whole numbers, touched once for several
    symbols: what these do to a point is one product and one difference, whose factors have less than 62 bits. A cut point lies below
    the block's own, so it gives the symbols of all prefixes whose interval begins at it or below; floats tell which is the last of
    these, and whole numbers what comes next, unless so little is cut off that it can only be the symbol before and then the last
    one. The symbols after that are those of any point: ``_wandered`` takes them off fixed-point numbers of all blocks at once, and
    tells for which its rounding leaves a doubt; these are left to ``_stepped``.
    """
    rows, length = spelt.shape
    inside = np.arange(length) < n[:, None]
    step = max(1, int(61.9 / np.log2(max(int(n.max()), 2))))
    # the symbols in order: what lies at a place of it has the interval of its symbol
    kind, shift = (np.uint32, 11) if length < 1 << 11 else (np.uint64, 32)
    key = np.where(inside, spelt, np.uint32(0x1FFFFF)).astype(kind) << kind(shift) | np.arange(length, dtype=kind)
    key.sort(axis=1)
    inorder, by = (key >> kind(shift)).astype(np.uint32), (key & kind((1 << shift) - 1)).astype(np.int64)
    new = np.ones((rows, length), bool)
    new[:, 1:] = inorder[:, 1:] != inorder[:, :-1]
    place = np.flatnonzero(new)
    counts = np.diff(np.r_[place, new.size])
    both = np.repeat((place % length).astype(kind) << kind(shift) | counts.astype(kind), counts).reshape(rows, length)
    # each symbol's interval: places of the text, in order, are the places of the order; beyond the text nothing changes a point
    own, line = np.ones((2, rows, length), kind), np.arange(rows)[:, None] * length
    own[0].ravel()[(by + line).ravel()] = both.ravel()
    back = np.maximum(n[:, None] - 1 - np.arange(length), 0)
    own[1] = own[0].ravel()[back + line]
    own[:, ~inside] = 1
    own = np.ascontiguousarray(own.reshape(2 * rows, length).T)
    spelt = np.concatenate([spelt, spelt.ravel()[back + line]])
    both, inorder, inside, n = (np.concatenate([v, v]) for v in (both, inorder, inside, n))
    rows *= 2
    (low, count), (own_low, own_count) = (((v >> kind(shift)).astype(np.int64), (v & kind((1 << shift) - 1)).astype(np.int64)) for v in (both, own))
    log = np.log2(np.maximum(np.arange(length + 1), 1))
    cost = np.where(inside, log[n][:, None] - log[count], 0)  # bits of a symbol
    size = np.ascontiguousarray(np.where(inside, n[:, None], 1).T)
    # of the symbols since the last whole run, each run's last being its own
    add, times, power = own_low.copy(), own_count.copy(), size.copy()
    for j in range(1, length):
        if j % step:
            add[j] = add[j - 1] * size[j] + times[j - 1] * own_low[j]
            times[j] *= times[j - 1]
            power[j] *= power[j - 1]
    # how far the point lies above the low end of each prefix's interval, as a logarithm
    rest, far = np.zeros(rows), np.zeros((length + 1, rows))
    for j in range(length - 1, -1, -1):
        rest = (own_low[j] + own_count[j] * rest) / size[j]
        far[j] = rest
    with np.errstate(divide="ignore"):
        far = np.log2(far)
    narrow = np.concatenate([np.zeros((1, rows)), np.cumsum(np.where(inside.T, log[n] - log[own_count], 0), axis=0)])
    far -= narrow
    # the last symbol that isn't the first of the order; where the cut leaves the point this near to it, what follows is known
    every, turn = np.arange(rows), np.maximum((far > -np.inf).sum(0) - 1, 0)
    spread = cost[every, n - 1]
    known = (np.log2(n) + narrow[turn + 1, every] + (n - turn - 1) * spread)[:, None] - np.array(budgets) < -1
    ends = np.minimum(np.arange(step, length + step, step), length) - 1
    # flat lists: a list for each block would keep the garbage collector busy
    adds, factors, wholes = (np.ascontiguousarray(v[ends].T).ravel().tolist() for v in (add, times, power))
    exact, above = np.zeros(rows, bool), np.full((rows, len(budgets)), -np.inf)
    sizes, powers, odd, each = n.tolist(), {}, {}, len(budgets)
    xs, widths, kept, tops, shifts = [], [], [], [], np.where(known, 0, np.array(budgets)).max(1) + 64
    shifts, certain = shifts.tolist(), known.ravel().tolist()
    for i in range(rows):
        m, s = -(-sizes[i] // step), i * len(ends)
        if sizes[i] not in powers:
            prime = next((d for d in range(3, sizes[i] + 1, 2) if sizes[i] % d == 0), 1)
            powers[sizes[i]], odd[sizes[i]] = [1, *accumulate(wholes[s : s + m], mul)], prime ** sizes[i]
        x, width = 0, 1
        kept.append(len(xs))
        xs.append(x)
        widths.append(width)
        for a, t, w in zip(adds[s : s + m], factors[s : s + m], wholes[s : s + m]):
            x = x * w + width * a
            width *= t
            xs.append(x)
            widths.append(width)
        whole = powers[sizes[i]][m]
        exact[i] = width > 0  # the point is the low end itself
        most, sure = shifts[i], certain[i * each : i * each + each]
        top, over = divmod(x << most, whole) if most > 64 else (0, 0)
        inexact = any(sure) and x % odd[sizes[i]]  # no power of two makes it a whole number
        for b, bits in enumerate(budgets):  # what the cut takes off
            if sure[b]:
                off = inexact or (x << bits) % whole
            else:
                off = (top & (1 << most - bits) - 1) + (over > 0)
            if off:
                above[i, b] = 0 if sure[b] else log2(off) - most
        tops.append(top)
    got, row = np.repeat(spelt, each, axis=0), np.repeat(every, each)
    pos = np.stack([np.where(np.isinf(v), n, np.where(s, turn, np.clip((far >= v).sum(0) - 1, 0, n))) for v, s in zip(above.T, known.T)], 1).ravel()
    before, left, known = np.maximum(pos - 1, 0), n[row] - pos - 1, known.ravel()
    mean = cost.sum(1) / n
    sigma = np.sqrt(np.maximum((cost * cost).sum(1) / n - mean * mean, 0))
    # pairs of limbs for all that is left, and how near to its high end a point stays there
    pairs = ((left * mean[row] + 4 * np.sqrt(np.maximum(left, 0)) * sigma[row] + 84) / (2 * _WIDE)).astype(int) + 1
    stays = -2 - left * spread[row]
    ends_ = np.flatnonzero(known & (left >= 0))
    got[ends_, pos[ends_]] = inorder[row[ends_], own_low[pos[ends_], row[ends_]] - 1]
    ends_, todo, lanes, ps, qs, numbers, ks, places = ends_[left[ends_] > 0].tolist(), [], [], [], [], [], [], []
    left[known] = -1
    for k, i, at, more, a, t, w, wide, stay in zip(range(len(row)), row.tolist(), pos.tolist(), left.tolist(), *(v[before, row].tolist() for v in (add, times, power)), pairs.tolist(), stays.tolist()):
        if more < 0:
            continue
        g, inner = divmod(at, step)
        x, width, whole = xs[kept[i] + g], widths[kept[i] + g], powers[sizes[i]][g]
        if inner:
            x, width, whole = x * w + width * a, width * t, whole * w
        bits = budgets[k % each]
        c = tops[i] >> shifts[i] - bits
        p = c * whole - (x << bits)
        if p < 0:  # the floats were wrong
            todo.append((k, 0, c, 1 << bits))
            continue
        p *= sizes[i]
        place = (p >> bits) // width
        ks.append(k)
        places.append(place)
        if not more:
            continue
        p -= low.item(i, place) * width << bits
        width *= count.item(i, place)
        q = width << bits
        under = q - p
        near = under.bit_length() - q.bit_length()  # of how far the point lies below the high end, a logarithm but for one bit
        if near < stay:
            ends_.append(k)
        elif p == 0 or near < _NEAR:
            todo.append((k, at + 1, p, q))
        else:
            lanes.append(k)
            ps.append(p)
            qs.append(q)
            up = 2 * _WIDE * wide - bits
            numbers.append(((under << up if up > 0 else under >> -up) // width).to_bytes(7 * wide, "big"))
    got[ks, pos[ks]] = inorder[row[ks], places]
    for k in ends_:
        got[k, pos[k] + 1 :] = inorder[row[k], n[row[k]] - 1]
    lane = np.array(lanes, np.int64)
    o = np.argsort(-left[lane], kind="stable")
    above_, counts, inorder_ = *(v.ravel().astype(np.min_scalar_type(length)) for v in (np.maximum(n[:, None] - low - count, 0), count)), inorder.ravel()
    for s in range(0, len(o), _LANES):
        part = o[s : s + _LANES]
        k = lane[part]
        r, most_ = row[k], int(pairs[k].max())
        raw = b"".join([numbers[i].ljust(7 * most_, b"\0") for i in part.tolist()])
        found, sure = _wandered(raw, pairs[k], n[r], left[k], r * length + n[r] - 1, above_, counts)
        found = np.take(inorder_, found.T, mode="clip")
        for i, k_, from_, to in zip(range(len(k)), k.tolist(), (pos[k] + 1).tolist(), n[r].tolist()):
            got[k_, from_:to] = found[i, : to - from_]
        todo += [(lanes[i], int(pos[lanes[i]]) + 1, ps[i], qs[i]) for i in part[~sure].tolist()]
    for k, at, p, q in todo:
        i = row[k]
        got[k, at : sizes[i]] = inorder[i, _stepped(p, q, sizes[i], sizes[i] - at, low[i].tolist(), count[i].tolist(), step)]
    bad = (got.reshape(rows, each, length) != spelt[:, None]) & inside[:, None]
    return exact, [bad[:, b] for b in range(each)]


def _wandered(raw: bytes, pairs: np.ndarray, n: np.ndarray, left: np.ndarray, end: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sure): the places in order of the next ``left`` symbols of points, the most symbols first, and for which points they are beyond doubt.

    A point is given by how far it lies below 1, in pairs of limbs of 28 bits, all as long as the longest, of which its own ``pairs`` are known.
    ``end`` is the place of each block's last symbol in order; ``low`` counts the symbols above each place's own. Some symbols are taken off
    the upper limbs as a float, then the number is multiplied, lessened and divided once for them. What rounding adds grows with the
    number; limbs that it has reached are dropped.
    """
    m = len(n)
    b = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(m, -1, 7).transpose(2, 1, 0)).astype(np.int64)
    limbs = np.empty((2 * b.shape[1], m))
    limbs[::2] = b[0] << 20 | b[1] << 12 | b[2] << 4 | b[3] >> 4
    limbs[1::2] = (b[3] & 15) << 24 | b[4] << 16 | b[5] << 8 | b[6]
    one = float(1 << _WIDE)
    at_once = max(1, int(23.8 / np.log2(max(int(n.max()), 2))))
    # the error as a logarithm: each touch and each limb dropped adds a last place
    slack = np.log2(4 * int(left[0]) + 4)
    size, sure, error = n.astype(float), np.ones(m, bool), slack - 2.0 * _WIDE * pairs
    factor = size**at_once
    places = np.zeros((-(-int(left[0]) // at_once) * at_once, m), np.int64)
    many = np.searchsorted(-left, -np.arange(len(places) + 1), side="left").tolist()  # how many have more symbols than each number
    used, spare = len(limbs), np.empty_like(limbs)
    with np.errstate(all="ignore"):  # what is no longer sure may grow without bound
        for done in range(0, len(places), at_once):
            m = many[done]
            sure[:m] &= error[:m] < -54
            x = limbs[0, :m] / one + limbs[1, :m] / one**2 + limbs[2, :m] / one**3
            a, t, f = np.zeros(m), np.ones(m), size[:m]
            for j in range(at_once):
                y = x * f
                place = np.floor(y)
                y -= place
                on, doubt = many[done + j], 2.0**-49 * int(n.max()) ** (j + 1)
                sure[:on] &= ((y > doubt) & (y < 1 - doubt))[:on]
                at = end[:m] - place.astype(np.int64)
                places[done + j, :m] = at
                l, c = low.take(at, mode="clip").astype(float), count.take(at, mode="clip").astype(float)
                x = (y + (place - l)) / c
                a *= f
                a += t * l
                t *= c
            m = many[done + at_once]
            if not m:
                break
            t, rest = t[:m], -a[:m]
            inverse = 1 / t
            used = min(used, max(3, int((slack - error[:m].min()) // _WIDE) + 1))
            v = limbs[:used, :m]
            v *= factor[:m]
            take = np.empty(m)  # what a limb's quotient accounts for
            for limb in v:
                rest *= one
                rest += limb
                np.multiply(rest, inverse, out=limb)
                np.floor(limb, out=limb)
                np.multiply(limb, t, out=take)
                rest -= take
            over = np.multiply(v[1:], 1 / one, out=spare[1:used, :m])  # the first limb has no other above it
            np.floor(over, out=over)
            v[:-1] += over
            over *= one
            v[1:] -= over
            error[:m] += np.log2(factor[:m] * inverse)
    return places, sure


def _stepped(p: int, q: int, n: int, left: int, low: list, count: list, step: int) -> list:
    """The places in order of the next ``left`` symbols of the point p / q: by floats as far as their rounding leaves no doubt, else by the whole numbers themselves."""
    out = []
    while len(out) < left:
        if p == 0:  # at the low end for good
            return out + [0] * (left - len(out))
        x, e, a, t, w, before = p / q, 2.0**-50, 0, 1, 1, len(out)
        for _ in range(min(step, left - before)):
            y, e = x * n, e * n * (1 + 2.0**-40) + n * 2.0**-50
            place = int(y)
            if not (y - place > e and place + 1 - y > e):
                break
            l, c = low[place], count[place]
            x, e = (y - l) / c, e / c + 2.0**-50
            a, t, w = a * n + t * l, t * c, w * n
            out.append(place)
        if len(out) == before:  # no step was sure
            place = p * n // q
            a, t, w = low[place], count[place], n
            out.append(place)
        p, q = p * w - a * q, q * t
    return out


def span_points(df: DataFrame, bits: int | None, span: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, span_no, original, recovered): every span of a text as its own exact point, cut to ``bits`` (None: not cut)."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, whole in zip(pdf[key], pdf[text]):
                if whole:
                    m = Intervals(whole)
                    for i in range(0, len(whole), span):
                        s = whole[i : i + span]
                        p = m.point(s)
                        out.append((k, i // span, s, m.text(p if bits is None else cut(p, bits), len(s))))
            yield pd.DataFrame(out, columns=[key, "span_no", "original", "recovered"])

    return df.select(key, text).mapInPandas(run, f"{key} long, span_no int, original string, recovered string")
