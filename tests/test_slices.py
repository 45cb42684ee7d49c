"""Texts taken a slice at a time: walks, counts in tasks, exact medians by bins."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symtrace.operators import damage, folds, grid, pack, rates, retrieval
from symtrace.plans import archive
from tests.compare import same

R = random.Random(11)
TEXTS = ["", None, "a", "".join(R.choice("abcdef ü🦜") for _ in range(3000)), "abc" * 700, "aab" * 900 + "b", "".join(R.choice("ab") for _ in range(1500))]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    q = [TEXTS[3][p : p + n] for p, n in ((5, 3), (100, 4), (700, 6), (20, 8), (2988, 12))] + ["abc", "aba", "bbbb", "zz", "", None, "aaba", "abc"]
    return spark.createDataFrame(list(enumerate(q)), "query_id long, query string")


def _step_by_step(walk, ids):
    x = y = walk.start
    for i in ids:
        x, y = walk.step(x, y, i)
        yield float(x), float(y)


def test_walks_side_by_side_are_step_by_step():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 20):
        for make in (folds.ring, folds.grid):
            walk, parts = make(n), [r.integers(0, n, k) for k in (0, 1, folds.STRETCH, folds.STRETCH + 1, 3 * folds.STRETCH + 7)] + [np.zeros(2000, np.int64)]
            at = np.r_[0, np.cumsum([len(p) for p in parts])]
            x, y = folds.walk_texts(walk, np.concatenate(parts), at)
            assert list(zip(x.tolist(), y.tolist())) == [p for ids in parts for p in _step_by_step(walk, ids)]


def test_slices_hold_all_texts():
    batch = pa.record_batch({"text": pa.array(TEXTS, pa.string())}).slice(2)
    got = [t for rows, points, at in folds.texts(batch, most=100) for t in folds.strings(points, at).to_pylist()]
    assert got == TEXTS[2:]
    for _, points, at in folds.texts(batch):
        symbols, first, ids = folds.alphabets(points, at)
        assert [folds.as_text(symbols[a:b]) for a, b in zip(first, first[1:])] == ["".join(sorted(set(t))) for t in TEXTS[2:]]
        assert (symbols[first[folds.of_row(at)] + ids] == points).all()


def test_hits_of_a_text_are_handed_on_in_pieces(monkeypatch):
    """One batch of all hits was as large as they were many."""
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    known, text = retrieval._Substrings(["aa", "aaa"]), folds.code_points("a" * 1000)
    got = [(a, q) for a, _, q in known.find(text, np.array([0, 1000]))]
    assert max(len(a) for a, _ in got) <= 100
    assert {q: sum(len(a) for a, k in got if k == q) for q in (2, 3)} == {2: 999, 3: 998}


def test_counts_in_tasks_equal_joins(texts, queries):
    alphabet = retrieval.corpus_alphabet(texts)
    count = lambda df, n: {(r.query_id, r.doc_id): r[n] for r in df.collect()}
    truth = retrieval.occurrences(texts, queries)
    want = {}
    for q in queries.collect():
        for i, t in enumerate(TEXTS):
            if q.query and t and (n := sum(t.startswith(q.query, a) for a in range(len(t)))):
                want[q.query_id, i] = n
    assert count(truth.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")), "n") == want == count(retrieval.occurrence_counts(texts, queries), "n_true")
    for kind in ("ring", "grid"):
        points, placed = retrieval.walk_index(texts, alphabet, kind), retrieval.query_points(queries, alphabet, kind)
        joined = retrieval.radius_join(points, placed)
        assert count(joined.groupBy("query_id", "doc_id").agg(F.count("*").alias("n")), "n") == count(retrieval.radius_counts(texts, placed, alphabet, kind), "n_found")
        near = lambda df: {r.query_id: (r.d2, r.doc_id, r.pos) for r in df.collect()}
        best = {}
        ps = points.toPandas()
        for q in placed.collect():
            d2 = (ps.x - q.qx) ** 2 + (ps.y - q.qy) ** 2
            best[q.query_id] = min(zip(d2, ps.doc_id, ps.pos))
        assert near(retrieval.nearest_in_texts(texts, placed, alphabet, kind)) == best


@pytest.mark.parametrize("precision", ["f64", "f32", "f16"])
def test_precision_in_tasks_equals_joins(texts, queries, precision, monkeypatch):
    alphabet = retrieval.corpus_alphabet(texts)
    points = retrieval.at_precision(retrieval.walk_index(texts, alphabet), precision)
    placed = retrieval.query_points(queries, alphabet)
    joined = retrieval.radius_join(points, placed if precision == "f64" else retrieval.widened(placed, precision))
    want = retrieval.precision_recall(joined, retrieval.occurrences(texts, queries), queries)
    got = retrieval.precision_counts(texts, queries, alphabet, "ring", precision)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("exact", [0, 10**9])
def test_medians_by_bins_are_exact(spark, texts, exact, monkeypatch):
    monkeypatch.setattr(retrieval, "EXACT", exact)
    alphabet = retrieval.corpus_alphabet(texts)
    for kind, keep_zero, cap in (("ring", False, 30), ("grid", True, 24)):
        d = {}
        walk = getattr(folds, kind)(len(alphabet))
        for t in filter(None, TEXTS):
            x, y = zip(*_step_by_step(walk, [alphabet.index(c) for c in t]))
            for p in range(1, len(t) + 1):
                o = p * 7919 % len(t) + 1
                s = 0
                while s < cap and s < min(p, o) and t[p - 1 - s] == t[o - 1 - s]:
                    s += 1
                dx, dy = x[p - 1] - x[o - 1], y[p - 1] - y[o - 1]
                far = (dx * dx + dy * dy) ** 0.5
                if p != o and (keep_zero or far > 0):
                    d.setdefault(s, []).append(far)
        got = retrieval.decay(texts, alphabet, kind, F.lit(1.0), cap=cap, keep_zero=keep_zero)
        assert {r.suffix: (r.n, r.median_distance) for r in got.collect()} == {s: (len(v), float(np.median(v))) for s, v in d.items() if len(v) >= 5}


@pytest.mark.parametrize("most", [50, 1 << 20])
def test_archives_of_slices_are_whole_numbers(spark, most, monkeypatch):
    """All texts of a slice at once, however rows fall into slices, with alphabets of 1 to 3,000 symbols."""
    monkeypatch.setattr(folds, "SLICE", most)
    texts = ["", None, "a" * 250, "abca" * 60, "".join(chr(200 + R.randrange(3000)) for _ in range(5000)), "🦜ü" * 80 + "x", TEXTS[3]]
    for codec, name in ((pack, "vectors"), (grid, "spans")):
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
        out = [r for b in _encoded_batches(spark, codec, batch) for r in b.to_pylist()]
        assert [r["doc_id"] for r in out] == list(range(len(texts)))
        for r, t in zip(out, texts):
            t = t or ""
            a = sorted(set(t))
            assert (r["length"], r["n"], r["alphabet"]) == (len(t), len(a), a)
            ids = [a.index(c) for c in t]
            if codec is pack:
                m, base = r["cpv"] or 1, max(len(a), 2)
                value = [sum(d * base**j for j, d in enumerate(ids[s : s + m])) for s in range(0, len(t), m)]
                assert [(v["xi"], v["yi"]) for v in r[name]] == [(v % 2**52, v >> 52) for v in value]
            else:
                m, k = r["grid_span"], r["k"]
                assert [(v["ix"], v["iy"]) for v in r[name]] == [tuple(sum(f(d) * k**j for j, d in enumerate(ids[s : s + m])) for f in (lambda d: d % k, lambda d: d // k)) for s in range(0, len(t), m)]
            assert [v["c"] for v in r[name]] == [min(m, len(t) - s) for s in range(0, len(t), m)]


def _encoded_batches(spark, codec, batch):
    """What the codec's batch function makes of a batch, in this process."""

    class Taken:
        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run([batch.rename_columns(["_key", "text"])]))

    return codec.encode(Taken())


def test_random_access_and_append_stay_right_for_odd_rows(spark):
    pairs = [("", None), (None, "x"), ("ab", "ba" * 300), ("abc", "d"), ("a" * 104, "a"), ("ü🦜", "🦜"), (None, None)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, text string, more string")
    first = pack.encode(d).join(d.select("doc_id", "more"), "doc_id")
    got = {r.doc_id: (r.length, r.decoded) for r in pack.decode(pack.append(first, "more")).collect()}
    assert got == {i: (len((a or "") + (b or "")), (a or "") + (b or "")) for i, (a, b) in enumerate(pairs)}


def test_damage_is_marked_within_rows(spark):
    texts = ["", None, "a", "aébcü🦜" * 300, "abc" * 100, "xyz" * 30, "same"]
    back = ["b", "x", None, "aXbcü?" * 290, "abc" * 120, "", "same"]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(texts, back))], "doc_id long, original string, recovered string")
    marks = damage.compared(d)
    want, maps = {}, {}
    for i, (a, b) in enumerate(zip(texts, back)):
        if a:
            bad = [p for p, c in enumerate(a) if p >= len(b or "") or b[p] != c]
            runs = [p for p in bad if p - 1 not in bad]
            want[i] = (len(a), len(bad), len(runs), bad[0] if bad else -1, bad[-1] if bad else -1)
            size = max(1, len(a) // 7)
            each = [(sum(p in bad for p in range(s, min(s + size, len(a)))), min(size, len(a) - s)) for s in range(0, len(a), size)]
            maps[i] = "".join("X" if k > m // 2 else "x" if k else "." for k, m in each)
    assert {r.doc_id: tuple(r)[1:] for r in damage.regions(marks).collect()} == want
    got = damage.damage_map(marks, 7)
    assert {r.doc_id: r.map for r in got.collect()} == maps
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # every symbol was shuffled


@pytest.mark.parametrize("counted", [10, 60_000])
def test_rates_of_texts_side_by_side(spark, counted, monkeypatch):
    """Contexts of one text are not those of the next, at 16 bits of contexts and above."""
    monkeypatch.setattr(rates, "COUNTED", counted)
    texts = ["", None, "a", "abab", "ab" * 40 + "c", TEXTS[6], "".join(R.choice("abcdefghijklmnop") for _ in range(70_000))]
    got = {}
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    done = 0
    for rows, points, at in folds.texts(batch, most=counted):
        for order, bits in rates._bits(points, at, (0, 1, 2, 6)):
            for i in range(len(at) - 1):
                got[done + i, order] = bits[at[i] : at[i + 1]].tolist()
        done += len(rows)
    for i, t in enumerate(texts):
        for order in (0, 1, 2, 6):
            contexts, pairs, want, size = {}, {}, [], len(set(t or ""))
            for p, c in enumerate(t or ""):
                context = t[max(0, p - order) : p]
                want.append(-np.log2((pairs.get((context, c), 0) + 1) / (contexts.get(context, 0) + size)))
                contexts[context] = contexts.get(context, 0) + 1
                pairs[context, c] = pairs.get((context, c), 0) + 1
            assert np.allclose(got.get((i, order), []), want, rtol=0, atol=1e-12)


def test_interval_sweep_equals_whole_numbers(spark):
    """Several symbols at once, by floats where they are sure, are the errors of unbounded rationals."""
    texts = ["", None, "a", "aa", "ab", "ba" * 128, "a" * 500, "abcd" * 64, "zzzza" * 50, TEXTS[3][:700], "the river runs " * 33, "".join(chr(200 + i) for i in range(240))]
    want = {}
    for k, whole in enumerate(texts):
        for b in range(0, len(whole or ""), 240):
            t = whole[b : b + 240]
            m = rates.Intervals(t)
            for reverse in (False, True):
                s = t[::-1] if reverse else t
                p = m.point(s)
                for bits in (5, 200, 400, 1200):
                    got = m.text(rates.cut(p, bits), len(s))
                    got = got[::-1] if reverse else got
                    bad = [i for i, (x, y) in enumerate(zip(got, t)) if x != y]
                    want[k, b // 240, reverse, bits] = (len(t), len(bad), bad[0] if bad else -1, bad[-1] if bad else -1, m.text(p, len(s)) == s)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r)[:4]: tuple(r)[4:] for r in rates.interval_sweep(d, (5, 200, 400, 1200)).collect()} == want


def _odd_documents(spark, path):
    """Texts with and without symbols, as a table of its own, and a DuckDB connection to it."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_grid_roundtrip_of_texts_without_symbols(spark, tmp_path):
    """An empty text's rate divided by zero, which ended the query; SQL has no row for it."""
    con = _odd_documents(spark, tmp_path)
    same(archive.grid_roundtrip(spark, str(tmp_path)), con, archive.ORACLE_SQL["grid_roundtrip"])


def test_pack_roundtrip_of_texts_without_symbols(spark, tmp_path):
    """As for the grid codec."""
    con = _odd_documents(spark, tmp_path)
    same(archive.pack_roundtrip(spark, str(tmp_path)), con, archive.ORACLE_SQL["pack_roundtrip"])


def test_interval_points_go_side_by_side(monkeypatch):
    """Long whole numbers were touched for each seven symbols of every point; now only where rounding leaves a doubt."""
    texts = [TEXTS[3][i : i + 240] for i in range(0, 3000, 240)] + ["".join(R.choice("etaoinshrdlu mfy,.") for _ in range(240)) for _ in range(20)]
    n = np.array([len(t) for t in texts])
    spelt = np.zeros((len(texts), 240), np.uint32)
    for row, t in zip(spelt, texts):
        row[: len(t)] = folds.code_points(t)
    calls, own = [], rates._stepped
    monkeypatch.setattr(rates, "_stepped", lambda *a: calls.append(a) or own(*a))
    budgets = (200, 400, 800)
    exact, wrong = rates._swept(spelt, n, budgets)
    assert exact.all() and len(calls) <= 2
    for i, t in enumerate(texts + [t[::-1] for t in texts]):
        m = rates.Intervals(t[:: 1 if i < len(texts) else -1])
        for bits, bad in zip(budgets, wrong):
            got = m.text(rates.cut(m.point(t), bits), len(t))
            assert bad[i, : len(t)].tolist() == [a != b for a, b in zip(got, t)]
