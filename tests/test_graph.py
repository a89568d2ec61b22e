import pytest
from pyspark.sql import functions as F

from polyad import Hypergraph
from polyad.errors import InvalidParameterError, MissingEdgeError, MissingNodeError
from polyad.operators import degree as D
from polyad.operators import edges as E
from polyad.operators import matrices as M
from polyad.operators import projections as P


@pytest.fixture(scope="module")
def small(spark):
    return Hypergraph.from_edges(spark, [(0, 1), (1, 2), (2, 3), (0, 1, 2), (0, 2, 3)]).cached()


def rows(df, *columns):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in (df.select(*columns) if columns else df).collect())


def test_degrees(small):
    assert dict(rows(small.degrees())) == {0: 3, 1: 3, 2: 4, 3: 2}
    assert dict(rows(small.degrees(size=2)))[0] == 1 and dict(rows(small.degrees(size=3)))[0] == 2
    assert dict(rows(small.degree_distribution())) == {3: 2, 4: 1, 2: 1}
    with pytest.raises(InvalidParameterError):
        small.degrees(size=2, order=1)


def test_policies(spark):
    twice = [("a", "b"), ("b", "a"), ("c",)]
    assert rows(Hypergraph.from_edges(spark, twice, weights=[1, 4, 1]).edges, "nodes", "weight") == [(("a", "b"), 5.0), (("c",), 1.0)]
    assert rows(Hypergraph.from_edges(spark, twice, weights=[1, 4, 1], duplicate="ignore").edges, "weight") == [(1.0,), (1.0,)]
    assert rows(Hypergraph.from_edges(spark, twice, weights=[1, 4, 1], duplicate="replace_weight").edges, "weight") == [(1.0,), (4.0,)]
    with pytest.raises(Exception, match="given twice"):
        Hypergraph.from_edges(spark, twice, duplicate="error").edges.collect()
    with pytest.raises(InvalidParameterError):
        Hypergraph.from_edges(spark, twice, weighted=False, duplicate="accumulate_weight")
    with pytest.raises(Exception, match="unweighted"):
        Hypergraph.from_edges(spark, [(1, 2)], weights=[3], weighted=False).edges.collect()
    with pytest.raises(InvalidParameterError):
        Hypergraph.from_edges(spark, [(-1, (1, 2))], kind="temporal")


def test_metadata_policies(spark):
    edges, metas = [(1, 2), (2, 1), (1, 2)], [{"a": 1}, {"a": 2, "b": 1}, {"a": 1}]
    merged = Hypergraph.from_edges(spark, edges, metas=metas).edges.first().meta
    assert merged == {"a": ["1", "2"], "b": ["1"]}
    assert Hypergraph.from_edges(spark, edges, metas=metas, metadata="ignore").edges.first().meta == {"a": "1"}
    assert Hypergraph.from_edges(spark, edges[:2], metas=metas[:2], metadata="replace").edges.first().meta == {"a": "2", "b": "1"}


def test_change(spark, small):
    gone = spark.createDataFrame([(3,)], "node bigint")
    assert rows(small.remove_nodes(gone).edges, "nodes") == [((0, 1),), ((0, 1, 2),), ((1, 2),)]
    shrunk = small.remove_nodes(gone, keep_edges=True)
    assert rows(shrunk.edges, "nodes", "weight") == [((0, 1), 1.0), ((0, 1, 2), 1.0), ((0, 2), 1.0), ((1, 2), 1.0), ((2,), 1.0)]
    more = small.add_edges(spark.createDataFrame([([1, 0], 2.0), ([7, 8], None)], "nodes array<bigint>, weight double"))
    assert more.get_weight((0, 1)) == 3.0 and more.check_node(8) and not small.check_node(8)
    assert not small.remove_edges(spark.createDataFrame([([0, 1],)], "nodes array<bigint>")).check_edge((0, 1))
    with pytest.raises(MissingEdgeError):
        small.remove_edges(spark.createDataFrame([([0, 9],)], "nodes array<bigint>"))
    with pytest.raises(MissingNodeError):
        small.remove_nodes(spark.createDataFrame([(99,)], "node bigint"))
    with pytest.raises(MissingEdgeError):
        small.get_weight((0, 3))
    assert small.set_weights(spark.createDataFrame([([0, 1], 9.0)], "nodes array<bigint>, weight double")).get_weight((1, 0)) == 9.0
    assert small.clear().num_nodes() == 0
    tagged = small.set_node_attribute("role", spark.createDataFrame([(1, "x")], "node bigint, value string"))
    assert {r.node: r.meta for r in tagged.nodes.collect()}[1] == {"role": "x"}
    assert {r.node: r.meta for r in tagged.remove_node_attribute("role").nodes.collect()}[1] == {}
    assert small.violations().count() == 0 and more.violations().count() == 0


def test_views_and_filters(spark, small):
    assert small.view().order(1).frame().count() == 3
    assert small.view().size(3, up_to=True).frame().count() == 5
    with pytest.raises(InvalidParameterError):
        small.view().size(2).order(1)
    with pytest.raises(InvalidParameterError):
        small.view().time_window((0, 1))
    assert small.subhypergraph(spark.createDataFrame([(0,), (1,), (2,)], "node bigint")).num_edges() == 3
    assert small.subhypergraph_by(orders=[2]).num_edges() == 2
    assert rows(small.neighbors(3)) == [(0,), (2,)]
    with pytest.raises(MissingNodeError):
        small.neighbors(42)
    nodes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x"), (3, None)], "node bigint, team string")
    kept, left = E.filter_hypergraph(small.edges, nodes, node_criteria={"team": "x"}, keep_edges=True)
    assert rows(kept, "nodes") == [((0,),), ((0, 2),), ((2,),)] and left.count() == 2
    kept, _ = E.filter_hypergraph(small.edges, nodes, node_criteria={"team": ["y", None]}, mode="remove")
    assert rows(kept, "nodes") == []
    kept, _ = E.filter_hypergraph(small.edges, nodes, edge_criteria={"size": lambda c: c > 2})
    assert kept.count() == 2


def test_windows(spark):
    g = Hypergraph.from_edges(spark, [(1, (1, 2)), (4, (3, 4)), (8, (1, 3)), (21, (2, 4))], kind="temporal")
    assert rows(g.windows(5), "window", "nodes") == [(0, (1, 2)), (0, (3, 4)), (1, (1, 3)), (4, (2, 4))]
    assert rows(E.window_counts(g.edges, 5), "window", "n_edges") == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert rows(g.get_edges(time_window=(4, 8)), "time") == [(4,)]
    assert rows(E.times_of(g.edges, [2, 1])) == [(1,)]
    flat = Hypergraph.from_edges(spark, [(0, (1, 2)), (1, (2, 1))], kind="temporal", weights=[1, 2.5]).to_undirected()
    assert flat.get_weight((1, 2)) == 3.5
    layers = Hypergraph.from_edges(spark, [("L1", (0, 1)), ("L2", (0, 1))], kind="multiplex", weights=[1, 2.5])
    assert rows(E.edge_overlap(layers.edges), "overlap") == [(3.5,)] and layers.get_edges(layer="L2").count() == 1


def test_directed(spark):
    g = Hypergraph.from_edges(spark, [((1,), (2,)), ((2,), (1,)), ((3, 4), (5,)), ((5,), (3, 4)), ((6,), (7, 8)), ((9, 10), (11, 12, 13))], kind="directed").cached()
    exact = dict(rows(D.exact_reciprocity(g.edges, 5)))
    assert exact[2] == 1.0 and exact[3] == pytest.approx(2 / 3) and exact[5] == 0.0 and exact[4] == 0.0
    weak = Hypergraph.from_edges(spark, [((1,), (2,)), ((2,), (1,)), ((3,), (4,)), ((5,), (6, 7))], kind="directed")
    assert dict(rows(D.weak_reciprocity(weak.edges, 3))) == {2: pytest.approx(2 / 3), 3: 0.0}
    s = Hypergraph.from_edges(spark, [((1, 2), (3, 4)), ((5,), (6, 7, 8))], kind="directed")
    counts = {(r.n_sources, r.n_targets): r.n_edges for r in D.signature(s.edges).collect()}
    assert [counts[a, b] for a in (1, 2, 3) for b in (1, 2, 3)] == [0, 0, 1, 0, 1, 0, 0, 0, 0]
    d = Hypergraph.from_edges(spark, [((0,), (1, 2)), ((2,), (0,)), ((1,), (2,))], kind="directed")
    assert dict(rows(D.source_side_degrees(d.edges)))[0] == 1 and dict(rows(D.target_side_degrees(d.edges)))[0] == 1
    assert dict(rows(d.in_degrees()))[2] == 2 and dict(rows(d.out_degrees()))[2] == 1
    assert rows(d.line_graph(), "w")[0] == (1.0,)
    with pytest.raises(InvalidParameterError):
        P.directed_line_graph(d.edges, s=0)


def test_projections(spark, small):
    closed = {tuple(r.nodes) for r in P.simplicial_complex(Hypergraph.from_edges(spark, [(0, 1, 2)]).edges).collect()}
    assert closed == {(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)}
    assert rows(small.clique()) == [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]
    subsets = {(r.edge_id, tuple(r.part)) for r in P.subsets_of_size(small.edges, 2).collect()}
    assert len(subsets) == 9
    with pytest.raises(Exception, match="more than"):
        P.simplicial_complex(Hypergraph.from_edges(spark, [tuple(range(25))]).edges).collect()
    with pytest.raises(InvalidParameterError):
        P.line_graph(small.edges, distance="cosine")


def test_matrices(spark, small):
    a = {(r.row, r.col): r.val for r in small.adjacency().collect()}
    assert all(a[y, x] == v for (x, y), v in a.items()) and all(x != y for x, y in a) and a[0, 2] == 2
    lap = {(r.row, r.col): r.val for r in M.laplacian(small.edges, 2).collect()}
    assert lap[0, 0] == 4.0 and lap[0, 2] == -2.0
    assert all(abs(sum(v for (x, _), v in lap.items() if x == k)) < 1e-9 for k in (0, 1, 2, 3))
    same = M.laplacian(small.edges, 1)
    assert M.are_commuting([same, same]) and not M.are_commuting([M.laplacian(small.edges, 1), M.laplacian(small.edges, 2)])
    tensor = rows(M.adjacency_tensor(E.by_size(small.edges, size=3), 3), "at")
    assert len(tensor) == 12 and ((2, 1, 0),) in tensor
    moves = small.transition_matrix().groupBy("row").agg(F.sum("val").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in moves)


def test_encoding(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node bigint")
    ids = dict(rows(E.dense_ids(nodes), "node", "id"))
    assert sorted(ids, key=ids.get) == sorted(range(12), key=str) and sorted(ids.values()) == list(range(12))
    g = Hypergraph.from_edges(spark, [(10, 2)])
    assert rows(E.relabel(g.edges, E.dense_ids(nodes)), "nodes") == [((ids[2], ids[10]),) if ids[2] < ids[10] else ((ids[10], ids[2]),)]


def test_empty(spark):
    g = Hypergraph.from_rows(spark.createDataFrame([(None,), ([],), ([None],)], "nodes array<bigint>"))
    assert g.num_edges() == 0 and g.degrees().count() == 0 and g.adjacency().count() == 0 and g.components().count() == 0
    assert g.line_graph().count() == 0 and g.summary().first().n_edges == 0 and g.motifs().agg(F.sum("count")).first()[0] == 0


def test_metadata_of_edges_and_incidences(spark, small):
    metas = spark.createDataFrame([([0, 1], {"k": ["v"]})], "nodes array<bigint>, meta map<string,array<string>>")
    tagged = small.set_edge_meta(metas)
    found = {tuple(r.nodes): r.meta for r in tagged.edges.collect()}
    assert found[0, 1] == {"k": ["v"]} and found[1, 2] is None
    again = tagged.set_edge_meta(spark.createDataFrame([([1, 2], {"q": ["z"]})], metas.schema))
    found = {tuple(r.nodes): r.meta for r in again.remove_edge_attribute("k").edges.collect()}
    assert found[0, 1] == {} and found[1, 2] == {"q": ["z"]}
    at = spark.createDataFrame([([0, 1], 1, {"role": "x"})], "nodes array<bigint>, node bigint, meta map<string,string>")
    assert small.set_incidence_meta(at).set_incidence_meta(at).incidence_meta.count() == 1
    with pytest.raises(MissingEdgeError):
        small.set_incidence_meta(spark.createDataFrame([([0, 1], 7, {"role": "x"})], at.schema))
    empty = spark.createDataFrame([("e", {"a": "b"})], "name string, meta map<string,string>")
    assert small.add_empty_edges(empty).empty_edges.count() == 1
    with pytest.raises(InvalidParameterError):
        small.add_empty_edges(empty).add_empty_edges(empty)
    assert small.set_meta(name="g").meta == {"name": "g"}
    assert {r["size"]: len(r.edge_ids) for r in small.edges_by_size().collect()} == {2: 3, 3: 2}
    d = Hypergraph.from_edges(spark, [((1,), (2, 3)), ((2,), (1,))], kind="directed")
    assert d.source_edges(1).count() == 1 and d.target_edges(1, size=2).count() == 1 and d.sources().count() == d.targets().count() == 2


def test_metadata_survives_conversions(spark):
    g = Hypergraph.from_edges(spark, [("a", (0, 1)), ("b", (0, 1)), ("b", (1, 2))], metas=[{"k": "x"}, {"k": "y", "m": "z"}, None], kind="multiplex").cached()
    flat = g.to_undirected()
    found = {tuple(r.nodes): r.meta for r in flat.edges.collect()}
    assert found == {(0, 1): {"k": ["x", "y"], "m": ["z"]}, (1, 2): None} and flat.meta == {"converted_from": "MultiplexHypergraph"}
    assert "meta" not in g.to_undirected(keep_edge_meta=False).edges.columns and g.to_undirected(keep_meta=False).meta is None
    more = Hypergraph.from_edges(spark, [(0, 1, 2), (0, 1), (3,)], metas=[{"k": "x"}, {"k": "y"}, {"k": "w"}]).cached()
    gone = spark.createDataFrame([(2,)], "node bigint")
    assert {tuple(r.nodes): r.meta for r in more.remove_nodes(gone, keep_edges=True).edges.collect()} == {(0, 1): {"k": ["x", "y"]}, (3,): {"k": ["w"]}}
    kept = more.filter(node_criteria={"node": lambda c: c != 2}, keep_edges=True, edge_criteria={"meta": E.attribute("k", "y")})
    assert [tuple(r.nodes) for r in kept.edges.collect()] == [(0, 1)]
    added = more.add_edges(spark.createDataFrame([([0, 1], {"k": "v"})], "nodes array<bigint>, meta map<string,string>"))
    assert {tuple(r.nodes): r.meta for r in added.edges.collect()}[0, 1] == {"k": ["v", "y"]}


def test_windows_are_whole(spark):
    g = Hypergraph.from_edges(spark, [(1, (1, 2)), (4, (3, 4)), (8, (1, 3)), (11, (2, 4)), (3, (1, 2)), (21, (1, 2))], metas=[{"k": "a"}, None, None, None, {"k": "b"}, None], kind="temporal").cached()
    found = {(r.window, tuple(r.nodes)): r.meta for r in E.tumbling_windows(g.edges, 5).collect()}
    assert found[0, (1, 2)] == {"k": ["a", "b"]} and (1, (1, 3)) in found and (2, (2, 4)) in found
    every = E.window_nodes(g.edges, 5, g.nodes).collect()
    assert len(every) == 5 * 4 and {r.window for r in every} == set(range(5))
    assert E.snapshot_nodes(g.edges).count() == 12 and E.snapshot_nodes(g.edges, every=True).count() == 6 * 4


def test_relabel_and_views(spark):
    g = Hypergraph.from_edges(spark, [((10,), (9, 100)), ((9,), ())], kind="directed").cached()
    new, mapping = g.relabeled()
    assert {r.node: r.id for r in mapping.collect()} == {10: 0, 100: 1, 9: 2}
    assert sorted((tuple(r.src), tuple(r.tgt), tuple(r.nodes)) for r in new.edges.collect()) == [((0,), (1, 2), (0, 1, 2)), ((2,), (), (2,))]
    assert sorted((tuple(r.src), tuple(r.tgt)) for r in E.unlabel(new.edges, mapping).collect()) == [((9,), ()), ((10,), (9, 100))]
    with pytest.raises(Exception, match="no new label"):
        E.relabel(g.edges, mapping.where("node != 9")).collect()
    h = Hypergraph.from_edges(spark, [(0, 1), (1, 2), (1, 2, 3), (5,)]).cached()
    h = h.set_node_meta(spark.createDataFrame([(1, {"kind": "hub"})], "node bigint, meta map<string,string>"))
    assert [r.node for r in h.node_view().degree(2, 3).attribute("kind", "hub").frame().collect()] == [1] and 5 in h.node_view() and 6 not in h.node_view()
    assert [(r.low, r.high, r.n_edges) for r in E.size_bins(h.edges, [1, 2, 9]).orderBy("low").collect()] == [(1, 2, 1), (2, 9, 3), (9, None, 0)]
    assert Hypergraph.from_tables(h.tables()) == h
