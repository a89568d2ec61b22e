"""Mixed memberships of more incidences than rounds on tables can take in time."""

import numpy as np
import pytest

from polyad import Hypergraph
from polyad.operators import communities as K


def test_memberships_on_arrays(spark, monkeypatch):
    g = Hypergraph.from_edges(spark, [(0, 1, 2), (0, 1), (1, 2), (3, 4, 5), (3, 4), (4, 5), (2, 3), (6,)], weights=[2, 1, 3, 2, 1, 1, 1, 1]).cached()
    assert K.HELD_INCIDENCES >= 3_700_000  # suppliers at 6x sf0.1
    held = K.fit_mixed_membership(g.edges, 2, n_iter=4, seed=1)
    monkeypatch.setattr(K, "HELD_INCIDENCES", 0)
    joined = K.fit_mixed_membership(g.edges, 2, n_iter=4, seed=1)
    u = {r.node: r.u for r in joined.u.collect()}
    assert held.log_likelihood == pytest.approx(joined.log_likelihood) and np.allclose(held.w, joined.w)
    assert all(r.u == pytest.approx(u[r.node]) for r in held.u.collect())
