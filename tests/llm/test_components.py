"""Components of links, in one task and in rounds."""

import random

import pytest

from symtrace.llm import common


@pytest.mark.parametrize("few", [0, common.FEW_LINKS])
def test_components_are_the_smallest_reachable(spark, few, monkeypatch):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 4000 + i) for i in range(50)] + [(7, 7), (-5, 7)]
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = common.components(common.Scratch(spark, "test"), spark.createDataFrame(links, "a long, b long"), "components")
    assert sorted(map(tuple, got.collect())) == sorted(root.items())
    assert common.components(common.Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), "components").count() == 0
    if few:  # rounds of jobs made the driver's memory grow
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
