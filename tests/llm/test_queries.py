import pytest

import __spark_entry__ as entry
from polyad.llm.queries import REGISTRY
from tests.compare import compare
from tests.conftest import DATA


@pytest.mark.parametrize("name", list(REGISTRY.sql))
def test_agrees_with_sql(spark, name):
    said, _ = compare(spark, DATA, REGISTRY.queries[name], REGISTRY.sql[name])
    assert not said


def test_found_queries_have_their_columns(spark):
    want = {"p1_found": ["node_a", "node_b"], "p2_found": ["edge_a", "edge_b"], "p4_found": ["node"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        assert entry.queries()[name](spark, DATA).columns == columns


def test_packing_places_every_document(spark):
    found = REGISTRY.queries["p7_packed"](spark, DATA)
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert found.where("part = 0").groupBy("kind").count().where(f"count != {documents}").count() == 0
