"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded texts.

Folding lower-cases, maps look-alike letters of other scripts and digits put for letters to plain
letters, and everything that isn't a letter to a space. The lexicon starts from a short list; word
beginnings that training labels show to be telling are added with their weights. A text's raw score
is the matched weight outside exception phrases over a power of its length, calibrated isotonically.

The lexicon is learned from at most ``max_rows`` labelled training rows, chosen by hash; the calibration
uses all training rows. Labels of held-out rows are never read.

Defined cases: null and empty texts match nothing and are scored like any other clean text; a null
doc_id is scored and not held out; repeated rows are scored alike; without labels of both kinds the
seed list alone decides; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symtrace.llm.calibrate import fit_isotonic, held_out, one_label
from symtrace.llm.common import Scratch, lean

#: The seed list, phrases in which its words are harmless, and what is folded to what.
SEED = ("bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "garbage collection", "garbage collector", "garbage can", "pond scum", "sore loser rule", "fool proof", "jerk chicken", "worthless check")
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ı": "i", "ɡ": "g", "ⅼ": "l", "ǀ": "l"}
SEED_WEIGHT, STEM = 4.0, (4, 5, 6, 7, 8)


class _Folds(dict):
    """Code point to folded text, made as it is met."""

    def __missing__(self, c: int) -> str:
        x = chr(c).lower()
        if 0xFF21 <= c <= 0xFF5A:  # full-width letters
            x = chr(c - 0xFEE0).lower()
        elif 0x1D400 <= c <= 0x1D6A3:  # mathematical letters, 26 upper and 26 lower to an alphabet
            x = chr(97 + (c - 0x1D400) % 26)
        x = LOOK_ALIKES.get(x, DIGITS.get(x, x))
        x = "".join(ch if ch.isalpha() else "" if ch in "​‌‍­" else " " for ch in x)
        self[c] = x
        return x


FOLDS = _Folds()


def fold(text: str) -> str:
    """Folded, with one space around it. Marks put for letters count as such only within a word."""
    return " " + text.translate(FOLDS) + " "


_ENDS = re.compile(r"[@$!]+(?![\w@$!])|(?<![\w@$!])!+")


def folded(text: str) -> str:
    """Marks at the ends of words are punctuation, so they are dropped there."""
    return fold(_ENDS.sub(" ", text) if "!" in text or "$" in text or "@" in text else text)


class Lexicon:
    """Weights of word beginnings, and the automaton that finds them."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.weights, self.exceptions, self._machine = weights, exceptions, None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            m = ahocorasick.Automaton()
            for w, x in self.weights.items():
                m.add_word(" " + w, (len(w) + 1, x))
            for p in self.exceptions:
                m.add_word(" " + p + " ", (len(p) + 2, None))
            m.make_automaton()
            self._machine = m
        return self._machine

    def weigh(self, text: str) -> tuple[float, int]:
        """(weight of the matches, words). Of stems that begin at one place the heaviest counts."""
        if not text:
            return 0.0, 0
        t = folded(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, x) in self.machine().iter(t):
            start = end - n + 1
            if x is None:
                spared.append((start, end))
            elif x > best.get(start, 0.0):
                best[start] = x
        total = sum(x for s, x in best.items() if not any(a <= s < b for a, b in spared))
        return total, t.count(" ") - 1

    def raw(self, text: str, power: float) -> float:
        """Matched weight over a power of the length, squeezed into 0 to 1."""
        total, n = self.weigh(text)
        return 1 - math.exp(-total / (n + 20.0) ** power) if total else 0.0


def _stems(known: DataFrame) -> DataFrame:
    """(stem, toxic, clean): documents of either label that have a word with this beginning."""

    def run(batches):
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = set(folded(text or "").split())
                seen[label > 0].update({w[:k] for w in words for k in STEM if len(w) >= k})
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from out(seen)
                seen = (Counter(), Counter())
        yield from out(seen)

    def out(seen):
        stems = list(seen[0] | seen[1])
        if stems:
            yield pa.record_batch({"stem": pa.array(stems), "clean": pa.array([seen[0][s] for s in stems], pa.int64()), "toxic": pa.array([seen[1][s] for s in stems], pa.int64())})

    rows = known.select("text", "label").mapInArrow(lean(run), "stem string, clean long, toxic long")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(known: DataFrame, most: int = 2000, least: int = 3) -> Lexicon:
    """Seed and learned stems: at least ``least`` toxic documents, log odds of 3 and more, the ``most`` strongest."""
    sizes = {bool(r.label): r["count"] for r in known.groupBy("label").count().collect()}
    weights = {w: SEED_WEIGHT for w in SEED}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos or not neg:
        return Lexicon(weights)
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1.0)) - F.log((F.col("clean") + 0.5) / (neg + 1.0))
    got = _stems(known).where(F.col("toxic") >= least).withColumn("odds", odds).where("odds >= 3").orderBy(F.desc(F.col("odds") * F.log("toxic")), "stem").limit(most).collect()
    found = {r.stem: float(r.odds) for r in got}
    for s, x in found.items():
        # a longer beginning that says no more than a shorter one adds nothing
        if not any(found.get(s[:k], -1) >= x - 0.7 for k in STEM if k < len(s)):
            weights[s] = max(weights.get(s, 0.0), x)
    return Lexicon(weights)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), max_rows: int = 20_000, power: float = 0.25) -> DataFrame:
    """(doc_id, held_out, score, raw) of every document."""
    work = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known_ids = one_label(labels, "toxic").where(~held_out("doc_id", *held))
    n = known_ids.count()
    chosen = known_ids
    if n > max_rows:  # a documented bound of the lexicon's sample, by hash of the id
        chosen = known_ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    lexicon = learn(work.keep(rows.join(chosen, "doc_id"), "sample"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def weigh(batches):
        for batch in batches:
            raw = [shared.value.raw(t or "", power) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "raw": pa.array(raw, pa.float64())})

    raw = work.keep(rows.mapInArrow(lean(weigh), "doc_id long, raw double"), "raw")
    work.drop("sample")
    iso = fit_isotonic(raw.join(known_ids, "doc_id").select("raw", "label"), 0.0, 1.0) if n else None

    def score(batches):
        for batch in batches:
            x = np.asarray(batch.column("raw").to_numpy(), np.float64)
            s = iso(x) if iso is not None else x
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "raw": batch.column("raw"), "score": pa.array(np.clip(s, 0.0, 1.0))})

    return raw.mapInArrow(lean(score), "doc_id long, raw double, score double").withColumn("held_out", held_out("doc_id", *held)).select("doc_id", "held_out", "score", "raw")
