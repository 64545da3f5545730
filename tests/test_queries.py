"""Every registered query of the engine: equal to its SQL, or running with rows where SQL cannot express it."""

import pytest

from weftline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
