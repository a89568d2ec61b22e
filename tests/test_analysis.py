import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyad import Hypergraph
from polyad.errors import InvalidParameterError
from polyad.operators import centrality as C
from polyad.operators import communities as K
from polyad.operators import correlation as R
from polyad.operators import dynamics as Y
from polyad.operators import edges as E
from polyad.operators import generators as N
from polyad.operators import motifs as O
from polyad.operators import paths as P
from polyad.operators import reducibility as U
from polyad.operators import validation as V


def made(seed, n_nodes, n_edges, sizes=(2, 2, 3, 4)):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n_nodes), rng.choice(sizes)))) for _ in range(n_edges)})


def test_reducibility(spark):
    g = Hypergraph.from_edges(spark, [(0, 1), (1, 2), (2, 3), (0, 1, 2)]).cached()
    for method in ("count", "project"):
        for optimization in ("exact", "greedy"):
            eta, chosen = g.reducibility(method=method, optimization=optimization)
            assert eta == pytest.approx(0.2665484173158311, abs=1e-12) and chosen == (3,)
    layers = U.layer_reducibility(g.edges)
    assert layers[2] == pytest.approx(0.2665484173158311) and layers[3] == 0.0
    full = Hypergraph.from_edges(spark, [(0, 1), (0, 2), (1, 2), (0, 1, 2)])
    assert full.reducibility() == (1.0, (3,))
    blocks = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node bigint, block int")
    q, m = U.partition_costs(g.edges, blocks)
    assert set(q) == {2, 3} and (3, 2) in m


def test_components_and_reach(spark):
    chain = [(k, k + 1) for k in range(12)] + [(100, 101, 102), (200,)]
    g = Hypergraph.from_edges(spark, chain).cached()
    found = {r.node: r.component for r in g.components().collect()}
    assert all(found[k] == 0 for k in range(13)) and found[102] == 100 and found[200] == 200
    assert not g.is_connected() and sorted(r.node for r in P.largest_component(g.components()).collect()) == list(range(13))
    assert {r.node for r in g.isolated_nodes().collect()} == {200}
    hops = {r.node: r.hops for r in P.reach(g.edges, spark.createDataFrame([(3,)], "node bigint"), max_depth=4).collect()}
    assert hops == {k: abs(k - 3) for k in range(8)}


def test_path_scores(spark):
    g = Hypergraph.from_edges(spark, [(0, 1), (1, 2), (2, 3), (3, 4)]).cached()
    order = {r.edge_id: k for k, r in enumerate(g.edges.orderBy("nodes").collect())}
    between = {order[r.edge_id]: r.betweenness for r in P.edge_path_scores(g.edges, "betweenness").collect()}
    close = {order[r.edge_id]: r.closeness for r in P.edge_path_scores(g.edges, "closeness").collect()}
    assert between == pytest.approx({0: 0, 1: 2 / 3, 2: 2 / 3, 3: 0}) and close == pytest.approx({0: 3 / 6, 1: 3 / 4, 2: 3 / 4, 3: 3 / 6})
    star = Hypergraph.from_edges(spark, [(0, k) for k in range(1, 5)])
    nodes = {r.node: r.betweenness for r in P.node_path_scores(star.edges, "betweenness").collect()}
    assert nodes["1"] == 0 and nodes["0"] == pytest.approx(24 / 28)
    timed = Hypergraph.from_edges(spark, [(0, (0, 1)), (0, (1, 2)), (1, (0, 1))], kind="temporal").cached()
    scores = {r.edge: r.closeness for r in P.averaged_path_scores(timed.edges, "closeness").collect()}
    assert scores == pytest.approx({"0|1": 0.5, "1|2": 0.5})
    assert {r.node for r in P.averaged_path_scores(timed.edges, "closeness", of="node").collect()} == {"0", "1", "2"}


def test_shortest_paths(spark):
    g = Hypergraph.from_edges(spark, [(0, 1), (1, 2), (0, 1, 5), (2, 3, 4)]).cached()
    found = {(r.a, r.b): r for r in P.shortest_paths(g.edges, option="max").collect()}
    r = found[0, 4]
    assert r.hops == 3 and list(r.path) == [0, 1, 2, 4] and list(r.sizes) == [3.0, 2.0, 3.0] and list(r.redundancies) == [1, 0, 0]
    assert r.mean_size == pytest.approx(8 / 3) and len(found) == 30
    low = {(r.a, r.b): r for r in P.shortest_paths(g.edges, option="min").collect()}
    assert list(low[0, 1].sizes) == [2.0]
    share = {r.hops: r.dyadic for r in P.dyadic_share(P.shortest_paths(g.edges)).collect()}
    assert 0 < share[1] < 1
    assert {r.projection for r in P.projected_paths(g.edges).select("projection").distinct().collect()} == {"all", "dyads", "higher"}
    assert {r.hops: r.n for r in P.redundancy_by_length(P.shortest_paths(g.edges)).collect()} == Counter(r.hops for r in found.values())


def test_temporal_paths(spark):
    g = Hypergraph.from_edges(spark, [(0, (0, 1)), (2, (1, 2)), (3, (0, 2)), (9, (0, 2))], kind="temporal").cached()
    arcs = {(r.time, r.node, r.to_time, r.to_node) for r in P.supra_adjacency(g.edges).collect()}
    assert (0, 0, 2, 1) in arcs and (0, 0, 3, 0) in arcs and (2, 1, 3, 2) in arcs and (3, 2, 9, 0) in arcs
    ways = {(r.a, r.b): r for r in P.temporal_paths(g.edges).collect()}
    assert ways[0, 1].delay == 2 and ways[0, 1].hops == 1 and ways[0, 2].delay == 3 and ways[0, 2].hops == 1


def test_walks(spark):
    edges = made(3, 12, 30)
    g = Hypergraph.from_edges(spark, edges).cached()
    m = np.zeros((12, 12))
    for e in edges:
        for a, b in itertools.permutations(e, 2):
            m[a, b] += len(e) - 1
    p = m / m.sum(1, keepdims=True)
    state = {r.node: r.density for r in g.stationary_state().collect()}
    pi = np.array([state[k] for k in range(12)])
    assert np.allclose(pi @ p, pi) and pi.sum() == pytest.approx(1)
    start = spark.createDataFrame([(0, 1.0)], "node bigint, density double")
    last = {r.node: r.density for r in Y.walk_density(g.edges, start, 3).where("step = 3").collect()}
    assert np.allclose([last.get(k, 0) for k in range(12)], np.eye(12)[0] @ np.linalg.matrix_power(p, 3))
    path = Y.random_walk(g.edges, 0, 4, seed=2)
    assert len(path) == 5 and all(m[a, b] > 0 for a, b in itertools.pairwise(path)) and path == Y.random_walk(g.edges, 0, 4, seed=2)


def test_contagion(spark):
    g = Hypergraph.from_edges(spark, [(0, 1), (1, 2), (2, 3, 4)]).cached()
    start = spark.createDataFrame([(0,)], "node bigint")
    shares = [r.share for r in Y.contagion(g.edges, start, 4, beta=1, beta_d=1, mu=0).orderBy("step").collect()]
    assert shares == [0.2, 0.4, 0.6, 0.6]  # one infected in a triple is not enough
    both = spark.createDataFrame([(2,), (3,)], "node bigint")
    assert [r.share for r in Y.contagion(g.edges, both, 2, beta=0, beta_d=1, mu=0).orderBy("step").collect()] == [0.4, 0.6]
    assert [r.share for r in Y.contagion(g.edges, start, 3, beta=0, beta_d=0, mu=1).orderBy("step").collect()] == [0.2, 0.0, 0.0]
    with pytest.raises(InvalidParameterError):
        Y.contagion(g.edges, start, 3, beta=2, beta_d=0, mu=1)


def test_stability(spark):
    system, jac = (lambda t, x: -x), (lambda x: -np.eye(2))
    found = {r.alpha: r.exponent for r in Y.master_stability(spark, system, jac, lambda x: np.eye(2), [0.0, 1.0], [1.0, 2.0], transient=0, time=10.0, step=0.02, cycles=10).collect()}
    assert found == pytest.approx({0.0: -1.0, 1.0: -2.0}, abs=1e-3)
    full = Hypergraph.from_edges(spark, [(0, 1), (0, 2), (1, 2), (0, 1, 2)])
    assert Y.is_all_to_all(full.edges) and not Y.is_all_to_all(Hypergraph.from_edges(spark, [(0, 1), (1, 2)]).edges)
    other = lambda x: np.diag(x)
    assert Y.is_natural_coupling([other, other], 2) and not Y.is_natural_coupling([other, lambda x: np.eye(2)], 2)
    assert Y.higher_order_stability(Hypergraph.from_edges(spark, [(0, 1), (1, 2)]).edges, system, jac, [other, lambda x: np.eye(2)], [1.0, 1.0], [0.0], [1.0, 2.0]) is None


def test_centralities(spark):
    edges = made(5, 9, 25, sizes=(3,))
    g = Hypergraph.from_edges(spark, edges).cached()
    a = np.zeros((9, 9))
    for e in edges:
        for x, y in itertools.permutations(e, 2):
            a[x, y] += 1
    values, vectors = np.linalg.eigh(a)
    lead = np.abs(vectors[:, -1])
    got = {r.node: r.centrality for r in g.centrality("clique", max_iter=25).collect()}
    assert np.allclose([got[k] for k in range(9)], lead, atol=1e-4)
    sub = {r.node: r.centrality for r in g.centrality("subhypergraph").collect()}
    assert np.allclose([sub[k] for k in range(9)], np.log((vectors**2) @ np.exp(values)))
    x = np.array([r.centrality for r in g.centrality("h", max_iter=25).orderBy("node").collect()])
    new = np.zeros(9)
    for e in edges:
        for i in e:
            new[i] += np.prod([x[j] for j in e if j != i])
    new = np.sqrt(new)
    assert np.allclose(new / new.sum(), x, atol=1e-4) and x.sum() == pytest.approx(1)
    z = [r.centrality for r in C.z_centrality(g.edges, max_iter=2).collect()]
    assert sum(z) == pytest.approx(1) and min(z) > 0
    with pytest.raises(InvalidParameterError):
        C.h_centrality(Hypergraph.from_edges(spark, [(0, 1), (0, 1, 2)]).edges)


def test_tail():
    for n, p, k in [(10, 0.3, 4), (50, 0.01, 3), (5, 0.5, 0), (5, 0.5, 6), (400, 0.2, 200)]:
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
        assert V.binomial_tail(n, p, k) == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_validation(spark):
    rng = random.Random(1)
    noise = [tuple(sorted(rng.sample(range(30), 2))) for _ in range(150)] + [tuple(sorted(rng.sample(range(30), 3))) for _ in range(80)]
    edges = noise + [(40, 41, 42)] * 25 + [(1, 2)] * 20
    g = Hypergraph.from_edges(spark, edges).cached()
    found = {tuple(r.nodes): r for r in g.validated_edges().collect()}
    assert found[40, 41, 42].validated and found[1, 2].validated and not any(r.validated for e, r in found.items() if r.n_observed == 1)
    pairs = [e for e in edges if len(e) == 2]
    k = Counter(x for e in pairs for x in e)
    p = V.binomial_tail(len(pairs), k[1] * k[2] / len(pairs) ** 2, Counter(pairs)[1, 2])
    assert found[1, 2].p_value == pytest.approx(p)
    ranked = sorted(r.p_value for e, r in found.items() if len(e) == 2)
    bonf = 0.01 / math.comb(len(k), 2)
    line = max([(j + 1) * bonf for j, q in enumerate(ranked) if q < (j + 1) * bonf], default=0)
    assert {e for e, r in found.items() if len(e) == 2 and r.validated} == {e for e, r in found.items() if len(e) == 2 and r.p_value < line}
    cores = {tuple(r.nodes): r for r in g.validated_cores().collect()}
    assert (40, 41, 42) in cores and (1, 2) in cores and (40, 41) not in cores and cores[40, 41, 42].n_observed == 25
    assert V.validated_cores(g.edges.limit(0)).count() == 0


def brute_motifs(edges, n):
    present = {e for e in edges if 2 <= len(e) <= n}
    nodes = sorted({x for e in present for x in e})
    counts = Counter()
    table = O.canonical_masks(n)
    for group in itertools.combinations(nodes, n):
        mask = sum(1 << k for k, s in enumerate(O.slots(n)) if tuple(group[x] for x in s) in present)
        if mask in table:
            counts[O.pattern_text(table[mask], n)] += 1
    return counts


@pytest.mark.parametrize("n", [3, 4])
def test_motifs(spark, n):
    edges = made(n, 11, 26)
    got = {r.pattern: r["count"] for r in O.count_motifs(Hypergraph.from_edges(spark, edges).cached().edges, n).collect()}
    assert len(got) == {3: 6, 4: 171}[n]
    assert {p: c for p, c in got.items() if c} == brute_motifs(edges, n)


def test_directed_motifs(spark):
    g = Hypergraph.from_edges(spark, [((1,), (2, 3)), ((2,), (3,)), ((5,), (7, 6)), ((6,), (7,)), ((8, 9), (10,))], kind="directed").cached()
    assert {r.pattern: r["count"] for r in g.motifs(3).collect()} == {"1>2 3>12": 2, "12>3": 1}
    assert sum(r["count"] for r in O.count_directed_motifs(g.edges, 4).collect()) == 0


def test_motif_profile(spark):
    g = Hypergraph.from_edges(spark, made(4, 15, 40)).cached()
    found = O.motif_profile(g.edges, 3, runs=1, steps=60).collect()
    assert sum(r.profile**2 for r in found) == pytest.approx(1) and found == O.motif_profile(g.edges, 3, runs=1, steps=60).collect()


def test_correlations(spark):
    rng, t, n = random.Random(2), 5, 6
    events = [(s, tuple(sorted(rng.sample(range(n), rng.choice([2, 3]))))) for s in range(t) for _ in range(4)] + [(t - 1, (0, 1))]
    g = Hypergraph.from_edges(spark, events, kind="temporal").cached()

    def stack(order):
        a = np.zeros((t, n, n))
        for s, e in set(events):
            if len(e) == order + 1:
                for x, y in itertools.permutations(e, 2):
                    a[s, x, y] += 1
        return a - a.mean(0)

    for oa, ob, tau in [(1, 2, 1), (2, 2, 2)]:
        a, b = stack(oa), stack(ob)
        scale = math.factorial(oa) * math.factorial(ob) * (t - tau)
        whole = sum(a[s] @ b[s + tau].T for s in range(t - tau)) / scale
        assert R.correlation_function(g.edges, oa, ob, tau) == pytest.approx(np.trace(whole))
        cells = {(r.row, r.col): r.val for r in R.correlation_matrix(g.edges, oa, ob, tau).collect()}
        assert np.allclose([[cells.get((x, y), 0) for y in range(n)] for x in range(n)], whole)
    assert R.gap_function(g.edges, 1, 2, 1) == pytest.approx(-R.gap_function(g.edges, 2, 1, 1))
    with pytest.raises(InvalidParameterError):
        R.correlation_function(g.edges, 1, 1, t)


def test_event_distances(spark):
    events = [(0, (0, 1)), (1, (1, 2)), (4, (2, 3)), (9, (0, 1))]
    g = Hypergraph.from_edges(spark, events, kind="temporal").cached()
    flat = g.to_undirected().cached()
    names = {tuple(r.nodes): r.edge_id for r in flat.edges.collect()}
    far = {(r.edge_a, r.edge_b): r.distance for r in R.edge_distances(flat.edges).collect()}
    assert far[names[0, 1], names[1, 2]] == 1 and far[names[0, 1], names[2, 3]] == 2
    placed = g.edges.select("time", "nodes", "size").join(flat.edges.select("edge_id", "nodes"), "nodes")
    got = {(r.delay, r.distance): r.n for r in R.event_distances(placed, R.edge_distances(flat.edges), [2, 5, 10]).collect()}
    assert got == {(2, 1): 1, (5, 1): 2, (5, 2): 1, (10, 1): 3, (10, 2): 2, (10, 0): 1}
    curve = R.distance_by_delay(R.event_distances(placed, R.edge_distances(flat.edges), [2, 5, 10]))
    assert R.delay_slope(curve) is not None


def planted(seed):
    rng = random.Random(seed)
    return [tuple(sorted(rng.sample(range(10), rng.choice([2, 3])))) for _ in range(60)] + [tuple(sorted(rng.sample(range(10, 20), rng.choice([2, 3])))) for _ in range(60)] + [(0, 10)]


def same_split(labels):
    return len({labels[k] for k in range(10)}) == 1 and len({labels[k] for k in range(10, 20)}) == 1 and labels[0] != labels[10]


def test_communities(spark):
    g = Hypergraph.from_edges(spark, planted(1)).cached()
    assert same_split({r.node: r.community for r in K.spectral_communities(g.edges, 2).collect()})
    first = K.fit_mixed_membership(g.edges, 2, n_iter=1, seed=3)
    last = K.fit_mixed_membership(g.edges, 2, n_iter=4, seed=3)
    assert last.log_likelihood > first.log_likelihood and last.w.shape == (2, 2)
    u, w, value = K.fit_size_model(g.edges, 2, realizations=3, max_iter=60, seed=1)
    assert same_split({r.node: int(np.argmax(r.u)) for r in u.collect()}) and math.isfinite(value)
    again = K.fit_size_model(g.edges, 2, realizations=3, max_iter=60, seed=1)
    assert again[2] == value
    assert K.matching(np.eye(2), np.eye(2)[::-1]) == [1, 0]


def test_mixed_membership_round(spark):
    """One round against the update formulas in numpy."""
    edges = [(0, 1), (1, 2, 3), (0, 2), (2, 3)]
    g = Hypergraph.from_edges(spark, edges).cached()
    one = K.fit_mixed_membership(g.edges, 2, n_iter=1, seed=4)
    draw = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda c: F.pmod(F.xxhash64(F.lit(4), F.col("node"), c), F.lit(1 << 40)) / F.lit(float(1 << 40)) + 1e-3)
    u = np.array([r.u for r in g.nodes.select("node", draw.alias("u")).orderBy("node").collect()])
    w = np.random.default_rng(4).random((2, 2))
    w = (w + w.T) / 2
    b = np.array([[float(k in e) for e in edges] for k in range(4)])

    def lam(u, w):
        s = b.T @ u
        return s, np.array([(s[j] @ w @ s[j] - sum(u[i] @ w @ u[i] for i in e)) / 2 for j, e in enumerate(edges)])

    s, l = lam(u, w)
    m = 1 / l
    top = s.T @ (m[:, None] * s) - u.T @ ((b @ m)[:, None] * u)
    total = u.sum(0)
    w = 0.5 * w * top / (0.5 * (np.outer(total, total) - u.T @ u) + 1.0)
    w = (w + w.T) / 2
    s, l = lam(u, w)
    m = 1 / l
    u = u * (((b * m) @ s - (b @ m)[:, None] * u) @ w) / (w @ total - u @ w)
    got = np.array([r.u for r in one.u.orderBy("node").collect()])
    assert np.allclose(got, u) and np.allclose(one.w, w / K.size_factor(3))


def test_core_periphery(spark):
    g = Hypergraph.from_edges(spark, [(0, k) for k in range(1, 8)] + [(1, 2)]).cached()
    got = {r.node: r.coreness for r in K.core_periphery(g.edges, rounds=20, seed=1).collect()}
    assert got[0] == 1.0 and got[0] > got[1] > got[5] >= 0


def test_edge_communities(spark):
    g = Hypergraph.from_edges(spark, [(0, 1, 2), (0, 1, 3), (0, 2, 3), (7, 8, 9), (7, 8, 6), (3, 9)]).cached()
    found = K.edge_communities(g.edges, 0.75)
    labels = {tuple(r.nodes): r.community for r in g.edges.join(found, "edge_id").collect()}
    assert labels[0, 1, 2] == labels[0, 1, 3] == labels[0, 2, 3] != labels[7, 8, 9] == labels[6, 7, 8]
    assert len({r.node: r.communities for r in K.overlapping_communities(g.edges, found).collect()}[9]) == 2


def test_generators(spark):
    g = N.random_hypergraph(spark, 30, {2: 40, 4: 10}, seed=1)
    got = [tuple(r.nodes) for r in g.collect()]
    assert all(len(set(e)) == len(e) and set(e) <= set(range(30)) for e in got) and {len(e) for e in got} == {2, 4} and len(got) <= 50
    assert sorted(got) == sorted(tuple(r.nodes) for r in N.random_hypergraph(spark, 30, {2: 40, 4: 10}, seed=1).collect())
    base = Hypergraph.from_edges(spark, made(6, 20, 50)).cached()
    degree = lambda e: dict((r.node, r.d) for r in E.incidences(e).groupBy("node").agg(F.sum("weight").alias("d")).collect())
    size = lambda e: dict((r["size"], r.n) for r in e.groupBy("size").agg(F.sum("weight").alias("n")).collect())
    mixed = N.edge_swaps(base.edges, seed=2, steps=100)
    assert degree(mixed) == degree(base.edges) and size(mixed) == size(base.edges)
    assert sorted(tuple(r.nodes) for r in mixed.collect()) != sorted(tuple(r.nodes) for r in base.edges.collect())
    free = N.edge_swaps(base.edges, seed=2, same_size=False, steps=60)
    assert degree(free) == degree(base.edges) and size(free) == size(base.edges)
    shuffled = N.random_shuffle(base.edges, size=3, p=1.0, preserve_degree=True, seed=1)
    assert size(shuffled) == size(base.edges)
    more = N.add_random_edges(base.edges, base.nodes, 3, 7, seed=3)
    assert sum(size(more).values()) == sum(size(base.edges).values()) + len({tuple(r.nodes) for r in N.random_uniform_hypergraph(spark, 20, 3, 7, seed=3).collect()})
    free = N.scale_free(spark, 40, {2: 60}, alpha=1.5, seed=1)
    top = free.select(F.explode("nodes").alias("node")).groupBy("node").count().orderBy(F.desc("count")).first()["count"]
    assert top > 10
    timed = N.activity_driven(spark, {1: [0.5] * 20, 2: [0.3] * 20}, 10, seed=1)
    assert {r["size"] for r in timed.select("size").distinct().collect()} == {2, 3}
    assert N.group_attractiveness(spark, 30, 10, box=5.0, seed=1).count() > 0
    x = N.power_law(1000, 0.1, 1.0, -2.0, seed=1)
    assert x.min() >= 0.1 and x.max() <= 1.0 and np.median(x) < 0.3


def test_directed_configuration(spark):
    g = Hypergraph.from_edges(spark, [((k,), ((k + 1) % 9, (k + 3) % 9)) for k in range(9)], kind="directed").cached()
    mixed = N.directed_configuration_model(g.edges, seed=1)
    count = lambda e: Counter((r.role, r.node) for r in E.incidences(e).select("role", "node", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).collect())
    assert count(mixed) == count(g.edges)


def test_block_model_samples(spark):
    u = np.array([[1.0, 0.0]] * 8 + [[0.0, 1.0]] * 8) * 0.7
    w = np.array([[1.0, 0.01], [0.01, 1.0]])
    got = N.sample_mixed_membership(spark, u, w, 3, n_samples=2, burn_in=4000, thinning=0, seed=1)
    rows = got.collect()
    assert {r["sample"] for r in rows} == {0, 1} and all(len(set(r.nodes)) == len(r.nodes) in (2, 3) and r.weight >= 1 for r in rows)
    inside = sum(len({x < 8 for x in r.nodes}) == 1 for r in rows)
    assert inside > 0.6 * len(rows)
    fixed = N.sample_mixed_membership(spark, u, w, 3, degrees=np.full(16, 3), sizes={2: 12, 3: 8}, burn_in=50, thinning=0, seed=2)
    held = Counter(x for r in fixed.collect() for x in r.nodes)
    assert max(held.values()) <= 4
    assert (N.truncated_poisson(np.array([1e-9, 3.0, 50.0]), np.random.default_rng(0)) >= 1).all()
    with pytest.raises(InvalidParameterError):
        N.sample_mixed_membership(spark, u, w, 1)


def test_arrays_and_tables_agree(spark, monkeypatch):
    """Rounds on arrays, for bounded incidences, give what the rounds on tables give."""
    triples = Hypergraph.from_edges(spark, made(5, 9, 25, sizes=(3,))).cached()
    mixed = Hypergraph.from_edges(spark, [*made(8, 10, 25), (50,)], weights=None).cached()

    def all_of():
        scores = [{r.node: r.centrality for r in triples.centrality(c, max_iter=4, seed=s).collect()} for c in ("clique", "z", "h") for s in (None, 3)]
        fits = [K.fit_mixed_membership(mixed.edges, 2, n_iter=2, seed=4, assortative=a, u_prior=p) for a, p in ((False, 0.0), (True, 0.5))]
        return scores, [({r.node: r.u for r in f.u.collect()}, f.w, f.log_likelihood) for f in fits]

    held, fits = all_of()
    monkeypatch.setattr(C, "HELD_INCIDENCES", 0)
    monkeypatch.setattr(K, "HELD_INCIDENCES", 0)
    joined, other = all_of()
    for a, b in zip(held, joined):
        assert a == pytest.approx(b)
    for (u, w, value), (v, x, again) in zip(fits, other):
        assert set(u) == set(v) and all(u[n] == pytest.approx(v[n]) for n in u) and np.allclose(w, x) and value == pytest.approx(again)


def test_configuration_options(spark):
    base = Hypergraph.from_edges(spark, made(6, 30, 60)).cached().edges
    degree = lambda e: dict((r.node, r.d) for r in E.incidences(e).groupBy("node").agg(F.sum("weight").alias("d")).collect())
    for label in ("edge", "vertex"):
        mixed = N.configuration_model(base, steps=120, label=label, duplicate_output="count", seed=3)
        assert degree(mixed) == degree(base)
        assert {tuple(r.nodes) for r in mixed.collect()} != {tuple(r.nodes) for r in base.collect()}
    strict = N.configuration_model(base, steps=120, label="vertex", n_clash=1, duplicate_output="error", seed=3)
    assert strict.count() == base.count() and {r.weight for r in strict.collect()} == {1.0}
    some = N.configuration_model(base, steps=60, size=3, label="vertex", seed=1)
    assert {tuple(r.nodes) for r in some.where("size != 3").collect()} == {tuple(r.nodes) for r in base.where("size != 3").collect()}
    with pytest.raises(InvalidParameterError):
        N.configuration_model(base, label="stub")


def test_community_results(spark):
    g = Hypergraph.from_edges(spark, planted(1)).cached()
    assert same_split({r.node: r.community for r in g.spectral(2).labels.collect()})
    soft = g.size_model(2, realizations=3, max_iter=60, seed=1)
    assert same_split({r.node: r.community for r in soft.labels.collect()}) and math.isfinite(soft.log_likelihood)
    mixed = g.mixed_membership(2, n_iter=60, seed=3)
    assert mixed.affinity.shape == (2, 2) and {r.community for r in mixed.labels.collect()} <= {0, 1}
    assert {r.node for r in g.core_periphery(rounds=5).scores.collect()} == set(range(20))
    clusters = g.edge_clusters(0.7)
    assert clusters.communities.count() == g.num_edges() and {r.node for r in clusters.nodes.collect()} == set(range(20))
