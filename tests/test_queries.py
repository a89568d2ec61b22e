"""Every registered query of the core that has SQL agrees with it over the smallest tables."""

import pytest

from polyad.plans.all import REGISTRIES
from tests.compare import compare
from tests.conftest import DATA

CASES = [(name, registry.queries[name], sql) for registry in REGISTRIES for name, sql in registry.sql.items()]


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_agrees_with_sql(spark, name, query, sql):
    said, _ = compare(spark, DATA, query, sql)
    assert not said
