"""The registered queries do the whole job: no rows filtered, no rounds saved."""

import inspect

import pytest
from pyspark.sql import functions as F

from polyad import Hypergraph
from polyad.errors import InvalidParameterError
from polyad.operators import communities as K
from polyad.operators import correlation as R
from polyad.operators import edges as E
from polyad.operators import generators as N
from polyad.operators import motifs as O
from polyad.operators import paths as P
from polyad.operators import reducibility as U
from polyad.operators import validation as V
from polyad.plans import analysis as A
from polyad.plans import graphs as G
from tests.conftest import DATA
from tests.test_analysis import made


class Stop(Exception):
    pass


def given(monkeypatch, module, name, query, spark):
    """What ``query`` gives to an operator."""
    seen = []

    def record(*args, **options):
        seen.append((args, options))
        raise Stop

    monkeypatch.setattr(module, name, record)
    with pytest.raises(Stop):
        query(spark, DATA)
    return seen[0]


def test_paths_over_all_edges(spark, monkeypatch):
    flat, kinds = E.to_undirected(G.flows(spark, DATA)), G.kinds(spark, DATA)
    assert A.s_closeness(spark, DATA).count() == flat.count() > E.by_size(flat, size=3, up_to=True).count()
    for module, name, query, whole in [(P, "node_path_scores", A.node_closeness, flat)] + [(*x, kinds) for x in [(P, "node_path_scores", A.node_betweenness), (P, "edge_path_scores", A.s_betweenness), (K, "fit_size_model", A.size_model), (K, "edge_communities", A.edge_communities)]]:
        edges = given(monkeypatch, module, name, query, spark)[0][0]
        assert edges.count() == whole.count()


def test_dense_paths_agree(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, [*made(3, 12, 40), (20, 21), (30,)]).cached()
    dense = [P.edge_path_scores(g.edges, m, s=s).collect() for m in ("closeness", "betweenness") for s in (1, 2)] + [P.node_path_scores(g.edges, "betweenness").collect()]
    monkeypatch.setattr(P, "DENSE_NODES", 0)
    sparse = [P.edge_path_scores(g.edges, m, s=s).collect() for m in ("closeness", "betweenness") for s in (1, 2)] + [P.node_path_scores(g.edges, "betweenness").collect()]
    for a, b in zip(dense, sparse):
        assert dict(a) == pytest.approx(dict(b))


def test_all_sizes_of_events(spark):
    hours = G.hours(spark, DATA)
    largest = hours.agg(F.max("size")).first()[0]
    table = A.temporal_correlation(spark, DATA).where("tau = 0 AND order_a = order_b").collect()
    assert {r.order_a for r in table} == set(range(1, largest)) and all(r.correlation > 0 for r in table)
    # pairs of simultaneous events of one size are in the histogram whatever their size
    counts = hours.where("size = 1").groupBy("nodes").count().count()
    assert counts and A.event_distances(spark, DATA).where("distance = 0").agg(F.sum("n")).first()[0] > hours.where("size = 2").count()


def test_correlation_table_agrees(spark):
    events = [(s % 5, e) for s, e in enumerate(made(7, 7, 40, (2, 3, 4)))]
    edges = Hypergraph.from_edges(spark, events, kind="temporal").cached().edges
    for r in R.correlation_table(edges, 3, [0, 2]).collect():
        assert r.correlation == pytest.approx(R.correlation_function(edges, r.order_a, r.order_b, r.tau))


def test_reducibility_of_all_sizes(spark):
    sizes = {str(r["size"]) for r in G.parts(spark, DATA).where("size >= 2").select("size").distinct().collect()}
    assert {r.layer for r in A.reducibility(spark, DATA).collect()} == {"all", *sizes}


def test_costs_of_both_methods(spark):
    edges = Hypergraph.from_edges(spark, made(5, 9, 40, (2, 3, 4, 5))).cached().edges
    count, project = U.layer_costs(edges), U.layer_costs(edges, method="project")
    assert count[0] == pytest.approx(project[0]) and count[1] == pytest.approx(project[1])


def test_cores_of_all_sizes(spark, monkeypatch):
    (edges,), options = given(monkeypatch, V, "validated_cores", A.svc, spark)
    assert edges.agg(F.max("size")).first() == E.to_undirected(G.flows(spark, DATA)).agg(F.max("size")).first()
    assert options.get("max_size") is None and options.get("min_size", 2) == 2


def test_null_model_is_mixed(spark, monkeypatch):
    _, options = given(monkeypatch, O, "motif_profile", A.motif_profile, spark)
    assert options.get("steps") is None and options.get("runs", 10) >= 10


def test_fits_run_to_the_end(spark, monkeypatch):
    fits = [("fit_mixed_membership", A.mixed_membership, "n_iter", 500), ("fit_size_model", A.size_model, "realizations", 10), ("fit_size_model", A.size_model, "max_iter", 500), ("core_periphery", A.core_periphery, "rounds", 1000)]
    for name, query, option, least in fits:
        default = inspect.signature(getattr(K, name)).parameters[option].default
        with monkeypatch.context() as patch:
            assert given(patch, K, name, query, spark)[1].get(option, default) >= least


def test_scale_free_has_all_edges(spark):
    wanted = {2: 300, 3: 100}
    found = N.scale_free(spark, 40, wanted, alpha=1.0, seed=1)
    assert {r["size"]: r["count"] for r in found.groupBy("size").count().collect()} == wanted
    with pytest.raises(InvalidParameterError):
        N.scale_free(spark, 4, {2: 7})
