from polyad.operators.records import member_records


def test_member_records(spark):
    rows = [(1, [3, 1, None, 3], 9, "a"), (1, [1, 3], 9, "a"), (2, None, 0, "b"), (3, [], 0, "b"), (4, [None], 0, "b"), (None, [1], 0, "b"), (5, [2], 1, None), (6, [2], 1, None), (6, [4, 2], 1, None)]
    df = spark.createDataFrame(rows, "edge_id bigint, interaction array<bigint>, members int, record string")
    assert {r.record: list(r.members) for r in member_records(df).collect()} == {1: [1, 3], 5: [2], 6: [2, 4]}
    assert member_records(df.limit(0)).collect() == []
