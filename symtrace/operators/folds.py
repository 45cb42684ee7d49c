"""Walks in numpy: constants of an alphabet's size, points of a text, and the symbols that lead to a point.

Texts are taken in slices of about ``SLICE`` bytes, a text at least, and all texts of a slice are walked at once, so memory is
a few numbers for each symbol of a slice. Inversion goes over arrays of spans, all of them at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from symtrace.functions.symbols import HISTORY_BITS, grid_side, history, kissing_ratio, walk_span

BLOCK = 1 << 16  #: points or symbols that are handed on at once
SLICE = 1 << 20  #: bytes of text that are worked on at once
STRETCH = 512  #: symbols of a text that are walked one after another; stretches are walked side by side


class Walk(NamedTuple):
    """What a walk over n symbols needs: vertices, contraction, and how many symbols a point remembers and may give back."""

    n: int
    vx: np.ndarray
    vy: np.ndarray
    ratio: float
    back: int
    span: int
    start: float
    grid: bool

    def step(self, x, y, ids):
        if self.grid:
            k = float(round(1 / self.ratio))
            return (x + self.vx[ids]) / k, (y + self.vy[ids]) / k
        vx, vy = self.vx[ids], self.vy[ids]
        return vx + self.ratio * (x - vx), vy + self.ratio * (y - vy)


@lru_cache(maxsize=4096)
def ring(n: int, ratio: float | None = None) -> Walk:
    """The regular polygon of n corners; without a ratio, cells touch."""
    turn = [math.pi / 2 - 2.0 * math.pi * j / n for j in range(n)]
    r = ratio or kissing_ratio(n)
    back = math.ceil(HISTORY_BITS / math.log2(1 / r)) if ratio else history(n)
    return Walk(n, np.array([math.cos(t) for t in turn]), np.array([math.sin(t) for t in turn]), r, back, walk_span(n), 0.0, False)


@lru_cache(maxsize=4096)
def grid(n: int) -> Walk:
    """k x k vertices, k a power of two."""
    k = grid_side(n)
    return Walk(n, np.arange(n, dtype=float) % k, (np.arange(n) // k).astype(float), 1.0 / k, int(HISTORY_BITS / np.log2(k)) + 1, 51 // int(math.log2(k)), 0.5, True)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def ranked(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted code points of a text, and each symbol's rank among them."""
    return np.unique(code_points(text), return_inverse=True)


def as_text(points: np.ndarray) -> str:
    return np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le")


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(points, at): the code points of all rows one after another, and where each row starts and the last ends; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    points = code_points(raw.tobytes().decode())
    at = at - at[0]
    return points, at if len(points) == len(raw) else np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][at]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most`` at most, or of one row."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def texts(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, points, at): runs of rows of about ``most`` bytes of text, one row at least, with their code points as ``decoded`` gives them."""
    for lo, hi in runs(numbers(pc.binary_length(batch.column(column))), most or SLICE):
        rows = batch.slice(lo, hi - lo)
        yield rows, *decoded(rows.column(column))


def numbers(column: pa.Array) -> np.ndarray:
    """Whole numbers of a column; null counts as 0."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def strings(points: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of ``decoded``."""
    size = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.r_[0, np.cumsum(size)][at].astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(as_text(points).encode()))


def starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of rows of these sizes starts, and the last ends."""
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists one after another, and where each list starts and the last ends."""
    return column.flatten(), starts(numbers(pc.list_value_length(column)))


def taken(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of some rows, one after another."""
    to = starts(np.diff(at)[rows])
    return values[np.arange(to[-1]) + np.repeat(at[:-1][rows] - to[:-1], np.diff(to))], to


def joined(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list of a with that of b behind it."""
    at = a_at + b_at
    out = np.empty(at[-1], np.result_type(a, b))
    out[np.arange(len(a)) + np.repeat(b_at[:-1], np.diff(a_at))] = a
    out[np.arange(len(b)) + np.repeat(a_at[1:], np.diff(b_at))] = b
    return out, at


def letters(symbols: np.ndarray) -> pa.Array:
    """Code points as strings of one symbol."""
    return strings(symbols, np.arange(len(symbols) + 1))


def of_row(at: np.ndarray) -> np.ndarray:
    """The row of each of the values that lie one after another."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def alphabets(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, ids): the sorted distinct code points of each text, where each text's start and the last ends, and each symbol's rank among its text's."""
    n, row = len(at) - 1, of_row(at)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero(np.bincount(points))
    if n * len(used) <= 16 * SLICE:
        place = np.zeros(used[-1] + 1, np.int64)
        place[used] = np.arange(len(used))
        key = row * len(used) + place[points]
        seen = np.zeros((n, len(used)), bool)
        seen.ravel()[key] = True
        rank = np.cumsum(seen, axis=1, dtype=np.int32)
        symbols, sizes, ids = used[np.nonzero(seen)[1]].astype(np.uint32), rank[:, -1], rank.ravel()[key].astype(np.int64) - 1
    else:
        known, ids = np.unique(row << 21 | points, return_inverse=True)
        sizes = np.bincount(known >> 21, minlength=n)
        symbols, ids = (known & 0x1FFFFF).astype(np.uint32), ids - (np.cumsum(sizes) - sizes)[row]
    return symbols, np.r_[0, np.cumsum(sizes, dtype=np.int64)], ids


def _stretched(vx: np.ndarray, vy: np.ndarray, ratio, grid_: bool, s: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, out: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Walks stretches of symbols, longest first, from where each starts; the points go to ``out`` unless it is None."""
    x, y = x.copy(), y.copy()
    many = isinstance(ratio, np.ndarray)
    k = np.rint(1 / ratio) if grid_ else None
    width = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # how many are longer than each step's number
    for j, m in enumerate(width.tolist()):
        at = s[:m] + j
        u, v = vx[at], vy[at]
        if grid_:
            k_ = k[:m] if many else k
            x[:m], y[:m] = (x[:m] + u) / k_, (y[:m] + v) / k_
        else:
            r = ratio[:m] if many else ratio
            x[:m], y[:m] = u + r * (x[:m] - u), v + r * (y[:m] - v)
        if out is not None:
            out[0][at], out[1][at] = x[:m], y[:m]
    return x, y


def walked(at: np.ndarray, vx: np.ndarray, vy: np.ndarray, ratio, back: int, start: float = 0.0, grid_: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The points after each symbol of every text, bit for bit as if step by step; (vx, vy) is each symbol's vertex, ``ratio`` one for all or for each text.

    Texts are cut into stretches that are walked side by side. Each but a text's first starts after ``back`` symbols before it, by
    which a walk has forgotten where it came from; where it has not, to the last bit, the stretch is walked again from the true point.
    """
    k = -(-np.diff(at) // STRETCH)
    text = np.repeat(np.arange(len(k)), k)
    no = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    s = at[text] + no * STRETCH
    size = np.minimum(STRETCH, at[text + 1] - s)
    o = np.argsort(-size, kind="stable")
    s, size, no, r = s[o], size[o], no[o], ratio[text[o]] if isinstance(ratio, np.ndarray) else ratio
    of = lambda i: r[i] if isinstance(r, np.ndarray) else r
    fx, fy = np.full(len(s), start), np.full(len(s), start)
    later, back = np.flatnonzero(no > 0), min(back, STRETCH)
    fx[later], fy[later] = _stretched(vx, vy, of(later), grid_, s[later] - back, np.full(len(later), back), fx[later], fy[later], None)
    out = np.empty(len(vx)), np.empty(len(vx))
    todo = np.arange(len(s))
    while len(todo):
        _stretched(vx, vy, of(todo), grid_, s[todo], size[todo], fx[todo], fy[todo], out)
        tx, ty = out[0][s[later] - 1], out[1][s[later] - 1]
        wrong = (fx[later] != tx) | (fy[later] != ty)
        todo = later[wrong]
        fx[todo], fy[todo] = tx[wrong], ty[wrong]
    return out


def walk_texts(walk: Walk, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points after each symbol of texts that share a walk."""
    return walked(at, walk.vx[ids], walk.vy[ids], walk.ratio, walk.back, walk.start, walk.grid)


def points(walk: Walk, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points after each symbol of a text."""
    return walk_texts(walk, ids, np.array([0, len(ids)]))


def nearest_vertex(walk: Walk, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The vertex in whose direction each point lies."""
    return np.rint((math.pi / 2 - np.arctan2(y, x)) * walk.n / (2 * math.pi)).astype(np.int64) % walk.n


def _replayed(walk: Walk, ids: np.ndarray, c: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first c symbols of each row lead from its anchor."""
    x, y = ax, ay
    for j in range(ids.shape[1]):
        qx, qy = walk.step(x, y, np.maximum(ids[:, j], 0))
        x, y = np.where(j < c, qx, x), np.where(j < c, qy, y)
    return x, y


def inverted(walk: Walk, x: np.ndarray, y: np.ndarray, c: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, repaired): one row for each point with the c symbols that lead to it from its anchor, -1 beyond them.

    At the kissing ratio a point's direction names its last symbol. Where cells touch, the direction may mislead,
    so rows that don't replay bit for bit are handed to ``_alternatives``; a row of -1 is one that no symbols reach.
    """
    most = int(c.max(initial=0))
    ids = np.full((len(c), most), -1, np.int64)
    px, py, rows = x.copy(), y.copy(), np.arange(len(c))
    for j in range(most):
        on = c > j
        v = nearest_vertex(walk, px, py)
        ids[rows[on], c[on] - 1 - j] = v[on]
        px = np.where(on, (px - (1 - walk.ratio) * walk.vx[v]) / walk.ratio, px)
        py = np.where(on, (py - (1 - walk.ratio) * walk.vy[v]) / walk.ratio, py)
    gx, gy = _replayed(walk, ids, c, ax, ay)
    wrong = np.flatnonzero((gx != x) | (gy != y))
    for i in wrong:  # few: each has its own set of open alternatives
        ids[i] = -1
        found = _alternatives(walk, x[i], y[i], int(c[i]), ax[i], ay[i])
        if found is not None:
            ids[i, : c[i]] = found
    repaired = np.zeros(len(c), bool)
    repaired[wrong] = True
    return ids, repaired


def _alternatives(walk: Walk, x: float, y: float, c: int, ax: float, ay: float, eps: float = 1e-14, most: int = 1 << 14) -> np.ndarray | None:
    """The symbols of a span whose directions mislead: all its alternatives move back together, a level at a time.

    A preimage stays if it lies on the inner side of every edge of the polygon, which one product with the edges'
    normals tells for all preimages; an edge's distance from the centre is the polygon's inner radius. Of what is
    left after c levels, that which replays bit for bit is taken, else the one nearest to the anchor if it is there
    up to rounding. Should ``most`` be open at a level, those nearest to the centre go first and the rest wait.
    """
    n, r = walk.n, walk.ratio
    vertices = np.stack([walk.vx, walk.vy])
    turn = math.pi / 2 - 2 * math.pi * (np.arange(n) + 0.5) / n
    normals, inner = (np.stack([np.cos(turn), np.sin(turn)]), math.cos(math.pi / n)) if n > 2 else (np.zeros((2, 1)), 1.0)
    best: tuple[float, np.ndarray] | None = None
    waiting = [(0, np.array([[x, y]]), np.zeros((1, 0), np.int64))]
    while waiting:
        depth, p, tail = waiting.pop()
        slack = eps / r**depth
        if depth == c:
            off = np.hypot(p[:, 0] - ax, p[:, 1] - ay)
            near = off <= slack
            if near.any():
                k = np.full(near.sum(), c)
                gx, gy = _replayed(walk, tail[near], k, np.full(len(k), ax), np.full(len(k), ay))
                exact = np.flatnonzero((gx == x) & (gy == y))
                if len(exact):
                    return tail[near][exact[0]]
                i = int(off[near].argmin())
                if best is None or off[near][i] < best[0]:
                    best = off[near][i], tail[near][i]
            continue
        back = (p[:, :, None] - (1.0 - r) * vertices[None]) / r  # every preimage of every open point
        far = np.hypot(back[:, 0], back[:, 1])
        out = np.einsum("sdi,de->sie", back, normals).max(2) - inner
        row, sym = np.nonzero((far <= 1.0 + slack / r) & (out <= slack / r))
        if not len(row):
            continue
        order = np.argsort(far[row, sym], kind="stable")
        row, sym = row[order], sym[order]
        chunks = range(0, len(row), most)
        waiting += [(depth + 1, back[row[a : a + most], :, sym[a : a + most]], np.concatenate([sym[a : a + most, None], tail[row[a : a + most]]], 1)) for a in reversed(chunks)]
    return None if best is None else best[1]


def lists(values: pa.Array, sizes) -> pa.ListArray:
    """Lists of the given sizes over values that lie one after another."""
    return pa.ListArray.from_arrays(pa.array(starts(np.asarray(sizes, np.int64)).astype(np.int32)), values)
