"""Community models of a hypergraph, each with one kind of result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyad.functions.columns import hard_label
from polyad.operators import communities as K


@dataclass(frozen=True)
class Scores:
    """``scores``: ``node`` and ``coreness`` in 0..1."""

    scores: DataFrame


@dataclass(frozen=True)
class EdgeClusters:
    """``communities``: ``edge_id`` and ``community``; ``nodes``: ``node`` and the ``communities`` of its edges; ``height`` of the cut."""

    communities: DataFrame
    nodes: DataFrame
    height: float


@dataclass(frozen=True)
class HardClusters:
    """``labels``: ``node`` and ``community``, null for isolated nodes."""

    labels: DataFrame
    k: int


@dataclass(frozen=True)
class SoftClusters:
    """``memberships`` (``node``, ``u``), ``labels`` (``node``, ``community``: the largest membership), ``affinity`` and ``log_likelihood``."""

    memberships: DataFrame
    labels: DataFrame
    affinity: object
    log_likelihood: float


def _soft(memberships: DataFrame, affinity: object, value: float) -> SoftClusters:
    return SoftClusters(memberships, memberships.select("node", hard_label(F.col("u")).cast("int").alias("community")), affinity, value)


def core_periphery(edges: DataFrame, **options) -> Scores:
    return Scores(K.core_periphery(edges, **options))


def edge_clusters(edges: DataFrame, height: float, **options) -> EdgeClusters:
    found = K.edge_communities(edges, height, **options)
    return EdgeClusters(found, K.overlapping_communities(edges, found), height)


def spectral(edges: DataFrame, k: int, **options) -> HardClusters:
    return HardClusters(K.spectral_communities(edges, k, **options), k)


def size_model(edges: DataFrame, k: int, **options) -> SoftClusters:
    return _soft(*K.fit_size_model(edges, k, **options))


def mixed_membership(edges: DataFrame, k: int, **options) -> SoftClusters:
    found = K.fit_mixed_membership(edges, k, **options)
    return _soft(found.u, found.w, found.log_likelihood)
