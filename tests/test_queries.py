import pytest

from symtrace.plans import registry
from tests.compare import connect, same

SLOW = {"ring_anchors", "walk_points"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["hop_context", "kmeans_train", "zlib_size", "lzma_size"])
def test_query_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.where("not lossless").count() == 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
