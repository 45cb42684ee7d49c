import math
import random

import numpy as np
import pytest
from pyspark.sql.functions import lit

from symtrace.functions.symbols import grid_side, kissing_ratio, symbols_per_vector, walk_span, with_sizes
from symtrace.operators import folds, grid, pack, rates, retrieval, ring

R = random.Random(5)
TEXTS = ["", "a", "aaaa" * 40, "abab" * 50, "hello world", "日本語 Ünïcode 🦜🦜 z", "x" * 44, "x" * 45, "abc" * 31 + "a", "".join(R.choice("abcdefghijklmnopqrstuvwxyz .,") for _ in range(500)), "".join(chr(200 + R.randrange(300)) for _ in range(400)), "ab" * 3 + "b" * 130 + "a" * 77, "acgt" * 9 + "c" * 149]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_constants():
    assert [symbols_per_vector(n) for n in (1, 2, 3, 4, 5, 24, 27, 96, 256, 1024)] == [104, 104, 65, 52, 44, 22, 21, 15, 13, 10]
    assert [walk_span(n) for n in (1, 4, 5, 24, 96, 256, 1024)] == [44, 44, 31, 14, 8, 6, 5]
    assert [grid_side(n) for n in (1, 4, 5, 16, 17, 64, 65)] == [2, 2, 4, 4, 8, 8, 16]
    assert abs(kissing_ratio(24) - 0.116337) < 1e-6 and kissing_ratio(4) == 0.5


def test_sizes_equal_whole_numbers(spark):
    got = with_sizes(spark.range(1, 20_000).selectExpr("cast(id as int) as n")).collect()
    assert all((r.cpv, r.k, r.grid_span) == (symbols_per_vector(max(r.n, 2)), grid_side(r.n), 51 // (grid_side(r.n).bit_length() - 1)) for r in got)


@pytest.mark.parametrize("codec", [grid, pack])
def test_round_trip(texts, codec):
    got = {r.doc_id: r.decoded for r in codec.decode(codec.encode(texts)).collect()}
    assert got == dict(enumerate(TEXTS))


def test_ring_round_trip(texts):
    got = {r.doc_id: r for r in ring.decode(ring.encode(texts)).collect()}
    assert {k: r.decoded for k, r in got.items()} == {i: t for i, t in enumerate(TEXTS) if t}
    short = {r.doc_id: r.decoded for r in ring.decode(ring.encode(texts, span=3)).collect()}
    assert short[9] == TEXTS[9]


def test_pack_is_base_n(spark):
    a = pack.encode(spark.createDataFrame([(1, "bca" * 30)], "doc_id long, text string")).first()
    value = sum("abc".index(s) * 3**i for i, s in enumerate(("bca" * 30)[:65]))
    assert (a.vectors[0].xi, a.vectors[0].yi) == (value % 2**52, value >> 52)


def test_char_at(spark, texts):
    want = {(i, p): t[p] if 0 <= p < len(t) else None for i, t in enumerate(TEXTS) for p in (-1, 0, len(t) // 2, len(t) - 1, len(t))}
    at = spark.createDataFrame([(i, p, TEXTS[i]) for i, p in want], "id long, p int, text string").selectExpr("named_struct('id', id, 'p', p) as doc_id", "text")
    for codec in (grid, pack):
        a = codec.encode(at).withColumn("p", codec.F.col("doc_id.p"))
        assert {(r.doc_id.id, r.doc_id.p): r.symbol for r in codec.char_at(a, "p").collect()} == want
    a = ring.encode(at).withColumn("p", ring.F.col("doc_id.p"))
    assert {(r.doc_id.id, r.pos): r.symbol for r in ring.char_at(a, "p").collect()} == {k: v for k, v in want.items() if v is not None}


def test_append_equals_encoding_at_once(spark):
    pairs = [("abc", "abcabc"), ("abc" * 30, ""), ("abc" * 30, "cab" * 40), ("", "new"), ("abc", "xyz"), ("ab" * 52, "a"), ("a", "a" * 200)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, text string, more string")
    first = pack.encode(d).join(d.select("doc_id", "more"), "doc_id")
    grown = {r.doc_id: r for r in pack.append(first, "more").collect()}
    whole = {r.doc_id: r for r in pack.encode(d.selectExpr("doc_id", "concat(text, more) as text")).collect()}
    assert {k: (r.length, r.vectors, r.alphabet) for k, r in grown.items()} == {k: (r.length, r.vectors, r.alphabet) for k, r in whole.items()}


def test_fixed_alphabet_rejects_other_symbols(spark):
    d = spark.createDataFrame([(1, "abz")], "doc_id long, text string")
    with pytest.raises(Exception, match="outside the alphabet"):
        pack.encode(d, alphabet="ab").collect()
    assert pack.decode(pack.encode(d, alphabet="zba")).first().decoded == "abz"


def test_search_finds_what_direction_misses():
    w = folds.ring(4)
    ids = np.array([0] * 30 + [2] * 10)
    x, y = (v[-1:] for v in folds.points(w, ids))
    nothing = np.zeros(1)
    got, _ = folds.inverted(w, x, y, np.array([len(ids)]), nothing, nothing)
    assert got[0].tolist() == ids.tolist()
    lost, repaired = folds.inverted(w, np.array([5.0]), np.array([5.0]), np.array([3]), nothing, nothing)
    assert (lost == -1).all() and repaired.all()


def test_alternatives_agree_with_all_symbols():
    r = np.random.default_rng(2)
    for n in (2, 3, 4, 5, 9):
        w = folds.ring(n)
        for _ in range(20):
            ids = r.integers(0, n, 12)
            ax, ay = (float(v[-1]) for v in folds.points(w, r.integers(0, n, 90)))
            x, y = ax, ay
            for i in ids:
                x, y = (float(v) for v in w.step(x, y, i))
            found = folds._alternatives(w, x, y, 12, ax, ay)
            assert found is not None and folds._replayed(w, found[None], np.array([12]), np.array([ax]), np.array([ay])) == (x, y)


def test_ring_append_equals_encoding_at_once(spark):
    pairs = [("abc", "abcabc"), ("abcde" * 30, ""), ("abc" * 30, "cab" * 40), ("", "new"), ("abc", "xyz"), ("ab" * 52, "a"), ("a", "a" * 200), ("abcdefgh" * 9, None)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, text string, more string")
    first = ring.encode(d).join(d.select("doc_id", "more"), "doc_id")
    grown = {r.doc_id: r for r in ring.append(first, "more").collect()}
    whole = {r.doc_id: r for r in ring.encode(d.selectExpr("doc_id", "concat(text, coalesce(more, '')) as text")).collect()}
    assert {k: (r.length, r.points, r.alphabet, r.span) for k, r in grown.items()} == {k: (r.length, r.points, r.alphabet, r.span) for k, r in whole.items()}


def test_hull(spark):
    for n in (2, 3, 5, 24):
        corners = [(math.sin(2 * math.pi * j / n), math.cos(2 * math.pi * j / n)) for j in range(n)]
        pts = [(f * x, f * y, f < 1) for x, y in corners for f in (0.0, 0.5, 0.999, 1.001)]
        got = ring.in_hull(spark.createDataFrame(pts, "x double, y double, want boolean"), n)
        assert got.where("inside <> want").count() == 0


def test_a_text_of_a_million_symbols(spark):
    """Every walk and rate on one very long text, in memory that follows its length."""
    text = "".join(R.choice("abcdefghij klmnop") for _ in range(1_000_000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    alphabet = retrieval.corpus_alphabet(d)
    assert retrieval.walk_index(d, alphabet).count() == 1_000_000
    assert ring.walk(d).count() == 1_000_001
    assert ring.decode(ring.encode(d)).first().decoded == text
    q = spark.createDataFrame([(1, text[500_000:500_012])], "query_id long, query string")
    assert (1, 1, 500_012) in {(r.query_id, r.doc_id, r.pos) for r in retrieval.occurrences(d, q).collect()}
    assert rates.ngram_rate(d, (0, 1, 2)).count() == 3
    assert rates.ngram_bits(d, (1,)).count() == 1_000_000
    assert retrieval.decay(d, alphabet, "ring", lit(1.0)).count() > 0
