import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from symtrace.operators import damage, quantize, rates, reports, retrieval, tokens
from symtrace.sources import corpus


def test_interval_coder_round_trips_and_degrades():
    m = rates.Intervals("abracadabra " * 20)
    t = "abracadabra " * 20
    p = m.point(t)
    assert m.text(p, len(t)) == t
    for bits in (50, 200, 400):
        got = m.text(rates.cut(p, bits), len(t))
        bad = [i for i, (a, b) in enumerate(zip(got, t)) if a != b]
        assert not bad or min(bad) > 0 and len(got) == len(t)


def test_span_points(spark):
    d = spark.createDataFrame([(1, "mississippi river " * 10), (2, ""), (3, None)], "doc_id long, text string")
    got = rates.span_points(d, None, 60).collect()
    assert got and all(r.original == r.recovered for r in got)
    cut = rates.span_points(d, 16, 60).collect()
    assert any(r.original != r.recovered for r in cut)


def test_radius_join_finds_all(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefg ") for _ in range(3000))
    d = spark.createDataFrame([(1, text), (2, text[::-1]), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(i, text[p : p + n]) for i, (p, n) in enumerate([(5, 3), (100, 4), (700, 6), (20, 8)])] + [(9, "zzz")], "query_id long, query string")
    alphabet = retrieval.corpus_alphabet(d)
    truth = {(r.query_id, r.doc_id, r.pos) for r in retrieval.occurrences(d, q).collect()}
    assert truth == {(i, k, s + len(t)) for i, t in ((r.query_id, r.query) for r in q.collect()) for k, x in ((1, text), (2, text[::-1])) for s in range(len(x)) if x.startswith(t, s)}
    for kind in ("ring", "grid"):
        points = retrieval.walk_index(d, alphabet, kind)
        qp = retrieval.query_points(q, alphabet, kind)
        found = {(r.query_id, r.doc_id, r.pos) for r in retrieval.radius_join(points, qp).collect()}
        ps, qs = points.collect(), qp.collect()
        brute = {(b.query_id, a.doc_id, a.pos) for b in qs for a in ps if (a.x - b.qx) ** 2 + (a.y - b.qy) ** 2 <= b.tau**2}
        assert found == brute and truth <= found
        best = {r.query_id: r.d2 for r in retrieval.nearest(points, qp).collect()}
        assert best == pytest.approx({b.query_id: min((a.x - b.qx) ** 2 + (a.y - b.qy) ** 2 for a in ps) for b in qs})


def test_contexts_decode_what_precedes(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from here"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    hits = spark.createDataFrame([(0, 1, 50), (1, 1, 7)], "query_id long, doc_id long, pos int")
    got = {r.query_id: r.context for r in retrieval.contexts(hits, d, retrieval.corpus_alphabet(d), 10).collect()}
    assert got == {0: text[10:50], 1: text[:7]}


def test_damage(spark):
    a, b = "abcdefghij" * 15, "abXdefgXXj" * 15
    d = spark.createDataFrame([(1, a, b), (2, "same", "same"), (3, "abc", "ab")], "doc_id long, original string, recovered string")
    got = {r.doc_id: tuple(r)[1:] for r in damage.regions(damage.compared(d)).collect()}
    assert got == {1: (150, 45, 30, 2, 148), 2: (4, 0, 0, -1, -1), 3: (3, 1, 1, 2, 2)}
    maps = {r.doc_id: r.map for r in damage.damage_map(damage.compared(d), 5).collect()}
    assert maps[1] == "xxxxx" and maps[2] == "...."


def test_allocation(spark):
    s = spark.range(4).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("span_no"))
    bits = {p: [r.bits for r in damage.allocation(s, p, total=1000).orderBy("span_no").collect()] for p in ("uniform", "ramp", "window")}
    assert bits == {"uniform": [250] * 4, "ramp": [100, 200, 300, 400], "window": [60, 900, 900, 900]}


def test_quantize_matches_numpy(spark):
    r = np.random.default_rng(1)
    x, b1, b2 = r.normal(size=(50, 6)), r.normal(size=(4, 6)), r.normal(size=(4, 6)) / 3
    v = spark.createDataFrame([(i, 0, [float(c) for c in a]) for i, a in enumerate(x)], "vec_id long, label long, vec array<double>")
    books = spark.createDataFrame([(0, s, i, [float(c) for c in a]) for s, b in ((1, b1), (2, b2)) for i, a in enumerate(b)], "label long, stage int, cid int, centroid array<double>")
    got = {q.vec_id: q for q in quantize.quantize(v, books, ["label"], 2).collect()}
    for i, a in enumerate(x):
        c1 = ((b1 - a) ** 2).sum(1).argmin()
        c2 = ((b2 - (a - b1[c1])) ** 2).sum(1).argmin()
        assert list(got[i].ids) == [c1, c2] and np.allclose(got[i].recon, b1[c1] + b2[c2])


def test_training_lowers_distortion(spark):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, 0, [float(c) for c in r.normal(size=4) + 5 * (i % 3)]) for i in range(120)] + [(999, 1, [1.0] * 4)], "vec_id long, label long, vec array<double>")
    errors = []
    for stages in (1, 2):
        books = quantize.train(v, ["label"], 3, stages)
        errors.append(quantize.quantize(v, books, ["label"], stages).agg(F.sum(quantize.squared_error())).first()[0])
    assert errors[1] < errors[0] < 1000
    start = quantize.first_books(v, ["label"], 3, "vec_id")
    more = quantize.lloyd_rounds(v, start, ["label"], 2)
    err = lambda b: quantize.quantize(v, b, ["label"], 1).agg(F.sum(quantize.squared_error())).first()[0]
    assert err(more) <= err(start)


def test_tokens(spark):
    c = spark.createDataFrame([(1, 0, "a bb  c"), (1, 1, ""), (1, 2, "dd\n e"), (2, 0, None)], "conv_id long, turn long, text string")
    t = tokens.tokens(c, "conv_id", ["turn"])
    assert [r.token for r in t.orderBy("tok_no").collect()] == ["a", "bb", "c", "dd", "e"]
    h = tokens.history(t, "conv_id")
    assert h.first().text == "\x1f".join(["a", "bb", "c", "dd", "e"])
    back = tokens.token_at(h, tokens.offsets(t, "conv_id"), "conv_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect())) == sorted(map(tuple, tokens.all_tokens(h, "conv_id").collect()))


def test_separation(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 1.0), (3, 1, 9.0, 0.0), (4, 1, 9.0, 1.0)], "id long, grp long, x double, y double")
    r = reports.separation(p).first()
    assert (r.intra, r.separates) == (1.0, True) and r.inter == round((18 + 2 * math.sqrt(82)) / 4, 4)


def test_load_corpus(spark, tmp_path):
    (tmp_path / "b.txt").write_text("head\n*** START ***\nOne  two\n\tthree four\n*** END ***\ntail")
    got = corpus.load_corpus(spark, str(tmp_path / "b.txt"), "*** START", "*** END", lower=True).first().text
    assert got == "one two three four"
    assert corpus.load_corpus(spark, str(tmp_path / "b.txt"), n_chars=4).first().text == "head"


def test_layers(spark):
    d = spark.createDataFrame([(0, 1, 2, [1.0], [2.0])], "layer int, head int, pos int, key array<double>, value array<double>")
    assert sorted(map(tuple, corpus.layers(d, "pairs").collect())) == [(0, 1, "k", 2, [1.0]), (0, 1, "v", 2, [2.0])]
