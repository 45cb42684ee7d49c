"""Exact dedup, n-gram join and substring dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from symtrace.llm import exact_dedup, ngram_join, substring_dedup
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.rows(), brute.SCHEMA).repartition(3)


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    want, groups = brute.exact([(r[0], r[1]) for r in brute.rows()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(want)
    assert sum(r.kept for r in got) == groups
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == groups


def test_exact_dedup_reads_texts_once_at_any_filter_size(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 16)
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 2000)
    monkeypatch.setattr(exact_dedup, "RUN", 10)
    docs.write.parquet(str(tmp_path / "docs"))
    out = exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "docs")))
    want, groups = brute.exact([(r[0], r[1]) for r in brute.rows()])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()) == Counter(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "regexp_replace" not in plan


def test_ngram_join(docs):
    rows = [(r[0], r[1]) for r in brute.rows()]
    sets = [brute.shingles(t) for _, t in rows]
    roots = brute.components(len(rows), lambda a, b: brute.near(sets[a], sets[b]))
    least = defaultdict(list)
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r].append(d)
    want = Counter((d, len(s), (min(least[r]) if least[r] else None) if s else d) for (d, _), s, r in zip(rows, sets, roots))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()) == want
    kept = ngram_join.distinct_rows(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    n = len({r for r, s in zip(roots, sets) if s})
    assert sum(1 for r in left if brute.shingles(r.text)) == n


@pytest.mark.parametrize("operator", [lambda d: exact_dedup.exact_dedup(d), lambda d: ngram_join.ngram_join(d), lambda d: substring_dedup.repeats(d)])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_trie_finds_what_brute_force_finds():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 400, 120, dtype=np.uint64))
    sets = []
    for _ in range(60):
        keep = base[r.random(len(base)) > r.choice([0.02, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 400, r.integers(0, 25), dtype=np.uint64)])))
    trie = ngram_join.Trie(sets, [len(s) for s in sets])
    for q in sets[:20]:
        want = {i for i, s in enumerate(sets) if brute.near(frozenset(q.tolist()), frozenset(s.tolist()))}
        assert set(trie.search(q, len(q), 80)) == want
        # over first parts of the sets nothing may be lost
        cut = [s[: ngram_join.prefix_length(len(s), 80)] for s in sets]
        part = ngram_join.Trie(cut, [len(s) for s in sets])
        assert want <= set(part.search(q[: ngram_join.prefix_length(len(q), 80)], len(q), 80))


def test_bitmaps_lose_no_link():
    r = np.random.default_rng(9)
    sets, pairs = [], []
    for _ in range(300):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**60, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.1], r.integers(0, 2**60, int(r.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        if len(b):
            pairs.append((len(sets), len(sets) + 1, brute.near(frozenset(a.tolist()), frozenset(b.tolist()))))
            sets += [a, b]
    a, b, near = (np.array(x) for x in zip(*pairs))
    bits = ngram_join.Bitmaps([ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets]))
    assert near.sum() > 20 and bits.alike(a, b, 80)[near].all() and bits.alike(b, a, 80)[near].all()
    others = np.roll(b, 1)
    assert bits.alike(a, others, 80).mean() < 0.1


@pytest.mark.parametrize("part", [6])
def test_parts_of_long_lists_lose_no_link(spark, monkeypatch, part):
    """Many near copies and a passage of many texts, with lists cut into tiny parts, against brute force."""
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "BUCKET", 200)
    rnd = random.Random(8)
    base, shared = brute.soup(rnd, 60).split(), brute.soup(rnd, 14)
    rows = []
    for i in range(24):
        w = list(base)
        for _ in range(i % 4):
            w[rnd.randrange(60)] = f"x{rnd.randrange(3)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"{shared} {' '.join(f'y{i}z{j}' for j in range(i % 5))}") for i in range(20)]
    sets = [brute.shingles(t) for _, t in rows]
    roots = brute.components(len(rows), lambda a, b: brute.near(sets[a], sets[b]))
    least = {r: min(d for (d, _), x in zip(rows, roots) if x == r) for r in roots}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: least[r] for (d, _), r in zip(rows, roots)}


def test_substring_dedup(docs):
    rows = [(r[0], r[1]) for r in brute.rows()]
    paras = [(i, ln, d, x) for i, (d, t) in enumerate(rows) for ln, x in enumerate((t or "").split("\n")) if len(brute.tokens(x)) >= 20]
    sets = [brute.shingles(x) for *_, x in paras]
    roots = brute.components(len(paras), lambda a, b: brute.near(sets[a], sets[b]))
    groups = defaultdict(list)
    for p, r in zip(paras, roots):
        groups[r].append(p)
    want = Counter(tuple(sorted((str(d), ln) for _, ln, d, _ in g)) for g in groups.values() if len(g) > 1)
    got = defaultdict(list)
    for r in substring_dedup.repeats(docs).collect():
        got[r.cluster].append(r)
    assert Counter(tuple(sorted((str(r.doc_id), r.line) for r in g)) for g in got.values()) == want
    assert all(sum(not r.removed for r in g) == 1 and g[0].occurrences == len(g) for g in got.values())
    assert all(r.keep_doc_id == min((x.doc_id for x in g if x.doc_id is not None), default=None) for g in got.values() for r in g)


def test_removing_repeats(docs):
    kept = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    t = brute.texts()
    first = next(i for i, x in enumerate(t) if x and x.endswith("\nend"))
    assert kept[first] == "\n".join([t[first].split("\n")[0], "end"])
    assert kept[t.index("one")] == "one" and kept[t.index(None)] is None


def test_sets_of_slices():
    rng = np.random.default_rng(1)
    for _ in range(100):
        at = np.r_[0, np.cumsum(rng.integers(0, 6, rng.integers(1, 9)))]
        tokens = rng.integers(0, 4, at[-1]).astype(np.uint64)
        want = [sorted(set(tokens[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
        items, ends = ngram_join._ordered(tokens.copy(), at)
        assert [items[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
        classes = ngram_join._classes(items, ends)
        assert all((c == d) == (x == y) for c, x in zip(classes, want) for d, y in zip(classes, want))
