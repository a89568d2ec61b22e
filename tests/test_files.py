import gzip
import json

import pytest
from pyspark.sql import functions as F

from polyad import Hypergraph
from polyad.errors import InvalidFileTypeError, InvalidFormatError, InvalidParameterError
from polyad.sources import files
from polyad.streaming.windows import run_available, windowed_degrees, windowed_edges


def content(g):
    keys = [c for c in ("src", "tgt", "time", "layer", "nodes", "weight") if c in g.edges.columns]
    return sorted((tuple(map(tuple, [v if isinstance(v, list) else [v] for v in r])) for r in g.edges.select(*keys).collect()), key=repr)


GRAPHS = {
    "undirected": dict(edge_list=[(1, 2), (2, 3, 4), (1, 2)], weights=[1, 2.5, 1], metas=[{"a": "x"}, {}, {"b": "y"}]),
    "directed": dict(edge_list=[((1,), (2, 3)), ((4, 5), (1,))], weights=[1, 2]),
    "temporal": dict(edge_list=[(3, (1, 2)), (5, (1, 2))], weights=[1, 2]),
    "multiplex": dict(edge_list=[("l", (1, 2)), ("m", (1, 2))], weights=[1, 2]),
}


@pytest.mark.parametrize("kind", GRAPHS)
def test_round_trips(spark, tmp_path, kind):
    g = Hypergraph.from_edges(spark, kind=kind, **GRAPHS[kind]).cached()
    for fmt in ("parquet", "json"):
        path = f"{tmp_path}/{kind}.{fmt}"
        g.write(path, fmt=fmt)
        again = Hypergraph.read(spark, path)
        assert again.kind == kind and content(again) == content(g) and again.num_nodes() == g.num_nodes()
    assert Hypergraph.read(spark, f"{tmp_path}/{kind}.parquet").hash() == g.hash()


def test_json_array(spark, tmp_path):
    records = [
        {"hypergraph_type": "Hypergraph", "hypergraph_metadata": {"weighted": True, "name": "x"}},
        {"type": "node", "idx": 9, "metadata": {"label": "lonely"}},
        {"type": "edge", "interaction": [3, 1], "metadata": {"weight": 2, "kind": "k"}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        f.write(json.dumps(records, indent=1))
    for name in ("a.json", "b.json.gz"):
        g = Hypergraph.read(spark, str(tmp_path / name))
        assert content(g) == [((1, 3), (2.0,))] and g.check_node(9) and g.meta["name"] == "x"
        assert g.edges.first().meta == {"kind": ["k"]}
    (tmp_path / "c.json").write_text('[{"type": "node", "idx": 1}]')
    with pytest.raises(InvalidFormatError):
        Hypergraph.read(spark, str(tmp_path / "c.json"))


def test_hgr(spark, tmp_path):
    (tmp_path / "a.hgr").write_text("% comment\n3 5 11\n2 1 2\n% another\n4 3 2 5\n1 2 1\n1\n1\n1\n1\n1\n")
    g = Hypergraph.read(spark, str(tmp_path / "a.hgr"))
    assert content(g) == [((1, 2), (3.0,)), ((2, 3, 5), (4.0,))] and g.num_nodes() == 5
    g.write(f"{tmp_path}/b.hgr", fmt="hgr")
    assert content(Hypergraph.read(spark, f"{tmp_path}/b.hgr")) == content(g)
    (tmp_path / "c.hgr").write_text("3 5\n1 2\n")
    with pytest.raises(InvalidFormatError):
        Hypergraph.read(spark, str(tmp_path / "c.hgr"))
    (tmp_path / "d.hgr").write_text("x y\n")
    with pytest.raises(InvalidFormatError):
        Hypergraph.read(spark, str(tmp_path / "d.hgr"))


def test_hif(spark, tmp_path):
    document = {"network-type": "undirected", "incidences": [{"edge": 1, "node": "b"}, {"edge": 1, "node": "a"}, {"edge": "e", "node": "a"}], "nodes": [{"node": "z", "attrs": {"k": "v"}}], "edges": [{"edge": 1}, {"edge": "empty"}]}
    (tmp_path / "a.hif").write_text(json.dumps(document))
    stored, empty = files.read_hif(spark, str(tmp_path / "a.hif"))
    assert sorted(tuple(r.nodes) for r in stored.edges.collect()) == [("a",), ("a", "b")]
    assert [r.edge for r in empty.collect()] == ["empty"] and {r.node: r.meta for r in stored.nodes.collect()}["z"] == {"k": "v"}
    files.write_hif(stored, f"{tmp_path}/b.hif")
    again, _ = files.read_hif(spark, f"{tmp_path}/b.hif")
    assert sorted(tuple(r.nodes) for r in again.edges.collect()) == [("a",), ("a", "b")]
    directed = {"incidences": [{"edge": 1, "node": 2, "direction": "tail"}, {"edge": 1, "node": 3, "direction": "head"}]}
    (tmp_path / "d.hif").write_text(json.dumps(directed))
    r = files.read_hif(spark, str(tmp_path / "d.hif"))[0].edges.first()
    assert (list(r.src), list(r.tgt)) == (["2"], ["3"])
    with pytest.raises(InvalidParameterError):
        files.write_hif(Hypergraph.from_edges(spark, [(1, (1, 2))], kind="temporal").stored(), f"{tmp_path}/t.hif")


def test_facade(spark, tmp_path):
    with pytest.raises(InvalidFileTypeError):
        files.read_hypergraph(spark, "x.pkl")
    with pytest.raises(InvalidFileTypeError):
        files.write_hypergraph(Hypergraph.from_edges(spark, [(1, 2)]).stored(), f"{tmp_path}/x", fmt="pickle")
    with pytest.raises(InvalidParameterError):
        files.read_remote(spark, "x")


def test_hash(spark):
    make = lambda edges, **o: Hypergraph.from_edges(spark, edges, **o).hash()
    assert make([(1, 2), (2, 3)]) == make([(3, 2), (2, 1)]) != make([(1, 2), (2, 4)])
    assert make([(1, 2)], weights=[2]) == make([(1, 2), (2, 1)]) != make([(1, 2)])


def test_stream_is_batch(spark, tmp_path):
    rows = [(k, [k % 3, 5, None], f"2026-01-0{1 + k % 4} 0{k % 9}:00:00") for k in range(40)] + [(1, [1, 5], "2026-01-02 01:00:00"), (98, None, "2026-01-02 00:00:00"), (99, [7], "2026-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "edge_id bigint, interaction array<bigint>, at string").select("edge_id", "interaction", F.to_timestamp("at").alias("arrived_at"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run_available(windowed_edges(stream, late="1 day"), f"{tmp_path}/out", f"{tmp_path}/ck")
    final = df.where("arrived_at < '2026-01-08'")  # the last window stays open
    want = final.where(F.size(F.array_compact("interaction")) > 0).groupBy(F.date_trunc("day", "arrived_at").alias("start"), F.array_sort(F.array_distinct(F.array_compact("interaction"))).alias("nodes")).count()
    assert sorted(map(repr, ((r.start, list(r.nodes), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()))) == sorted(map(repr, ((r.start, list(r.nodes), r["count"]) for r in want.collect())))
    run_available(windowed_degrees(stream, late="1 day"), f"{tmp_path}/out2", f"{tmp_path}/ck2")
    assert spark.read.parquet(f"{tmp_path}/out2").agg(F.sum("degree")).first()[0] == sum(len({x for x in r[1] if x is not None}) for r in rows[:40])
