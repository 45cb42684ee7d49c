"""Appending as streams: token histories with offsets, and vectors that age out of an exact window.

State is keyed by history. The alphabet is fixed up front, so a new symbol never asks for a history to be
encoded anew; what is kept is the walk's last full anchor and the symbols after it, of which there are
fewer than a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from symtrace.functions.symbols import kissing_ratio, walk_span
from symtrace.operators.tokens import SEPARATOR

ARCHIVE = "span_no int, c int, x double, y double, version long"


def _vertices(n: int) -> list[tuple[float, float]]:
    import math

    return [(math.cos(math.pi / 2 - 2.0 * math.pi * j / n), math.sin(math.pi / 2 - 2.0 * math.pi * j / n)) for j in range(n)]


class Tail:
    """The end of a growing walk: the last full anchor and the symbols behind it."""

    def __init__(self, alphabet: str, span: int | None = None):
        n = len(alphabet)
        self.ids = {s: i for i, s in enumerate(alphabet)}
        self.vertices, self.ratio = _vertices(n), kissing_ratio(n)
        self.span = min(span, walk_span(n)) if span else walk_span(n)

    def grow(self, span_no: int, x: float, y: float, tail: str, more: str):
        """(spans that filled up or are the new last one, new span_no, anchor x, y and tail)."""
        out, text = [], tail + more
        while text:
            part, px, py = text[: self.span], x, y
            for s in part:
                vx, vy = self.vertices[self.ids[s]]
                px, py = vx + self.ratio * (px - vx), vy + self.ratio * (py - vy)
            out.append((span_no, len(part), px, py))
            if len(part) < self.span:
                break
            span_no, x, y, text = span_no + 1, px, py, text[self.span :]
        return out, span_no, x, y, text


def append_tokens(stream: DataFrame, alphabet: str, key: str = "conv_id", token: str = "token", order: str = "tok_no", span: int | None = None) -> DataFrame:
    """Archive rows of growing histories: (key, span_no, c, x, y, version); the highest version of a span counts.

    Tokens of one batch are taken in their order; tokens that arrive in a later batch are appended to what came before.
    """
    grower = Tail(alphabet, span)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, x, y, tail, n, version = state.get if state.exists else (0, 0.0, 0.0, "", 0, 0)
        pdf = pd.concat(list(batches)).sort_values(order)
        more = "".join((SEPARATOR if n + i else "") + t for i, t in enumerate(pdf[token]))
        spans, at, x, y, tail = grower.grow(at, x, y, tail, more)
        version += 1
        state.update((at, x, y, tail, n + len(pdf), version))
        yield pd.DataFrame([(k[0], *s, version) for s in spans], columns=[key, "span_no", "c", "x", "y", "version"])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {ARCHIVE}", "at int, x double, y double, tail string, n long, version long", "update", GroupStateTimeout.NoTimeout)


def age_out(stream: DataFrame, recent: int, sink: int, key: str, pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(key, pos, vec) of vectors as they leave the exact window: behind the sink and followed by ``recent`` newer ones."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_pos, held = state.get if state.exists else ([], [])
        pdf = pd.concat(list(batches)).sort_values(pos)
        rows = list(zip(held_pos, held)) + list(zip(pdf[pos], pdf[vec]))
        done = rows[: max(0, len(rows) - recent)]
        rest = rows[len(done) :]
        state.update(([int(p) for p, _ in rest], [list(map(float, v)) for _, v in rest]))
        yield pd.DataFrame([(k[0], int(p), list(map(float, v))) for p, v in done if p >= sink], columns=[key, pos, vec])

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, {pos} long, {vec} array<double>", "pos array<long>, vec array<array<double>>", "append", GroupStateTimeout.NoTimeout)
