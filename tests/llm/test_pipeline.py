"""The stages of the pipeline against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from symtrace.llm import quality
from symtrace.llm.common import Scratch, table
from tests.llm import brute


def test_stages(spark, sf):
    work = Scratch(spark, "stages")
    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, sf), name)
        seen[name] = docs
    first = table(spark, sf, "documents")
    names = list(seen)
    assert all(seen[n].columns == first.columns for n in names[:-1])
    scores = quality.quality_scores(first, table(spark, sf, "labels"))
    assert seen[names[0]].count() == scores.where("score >= 0.5").count()

    rows = [tuple(r) for r in seen[names[0]].select("doc_id", "text").collect()]
    kept = {(r.doc_id) for r in seen[names[1]].collect()}
    want, groups = brute.exact(rows)
    assert kept == {k for _, k, _, _ in want} and len(kept) == groups

    rows = [(r.doc_id, r.text) for r in seen[names[1]].orderBy("doc_id").collect()]
    sets = [brute.shingles(t) for _, t in rows]
    roots = brute.components(len(rows), lambda a, b: brute.near(sets[a], sets[b]))
    assert Counter(r.doc_id for r in seen[names[2]].collect()) == Counter({rows[r][0] for r in roots})

    items = [brute.words(r.text) for r in table(spark, sf, "benchmark").collect()]
    win = {tuple(w[j : j + min(10, len(w))]) for w in items for j in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(k) for k in win}
    clean = {r.doc_id for r in seen[names[2]].collect() if not any(tuple(w[j : j + s]) in win for w in [brute.words(r.text)] for s in sizes for j in range(len(w) - s + 1))}
    assert {r.doc_id for r in seen[names[3]].collect()} == clean

    last = seen[names[4]]
    assert {r.doc_id for r in last.collect()} <= clean and last.where("taken <= 0").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
