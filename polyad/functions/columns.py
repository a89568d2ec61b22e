"""Column functions for edges and their metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(nodes: Column) -> Column:
    """Sorted distinct nodes without nulls. An edge is a set here: a node given twice counts once."""
    return F.array_sort(F.array_distinct(F.array_compact(nodes)))


def label(nodes: Column) -> Column:
    """Nodes joined by ``|``, for output."""
    return F.array_join(nodes.cast("array<string>"), "|")


def order_of(size: Column) -> Column:
    """Order = size - 1."""
    return size - 1


def within(nodes: Column, others: Column) -> Column:
    """Whether all nodes are among the others."""
    return F.size(F.array_except(nodes, others)) == 0


def common_nodes(a: Column, b: Column) -> Column:
    """Number of nodes of both edges."""
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Common nodes over all nodes of two edges; null where both are empty."""
    return F.try_divide(common_nodes(a, b).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaccard(a, b)


def hard_label(memberships: Column) -> Column:
    """Index of the largest membership, the first of equals; null for an empty array."""
    return F.when(F.size(memberships) > 0, F.array_position(memberships, F.array_max(memberships)) - 1)


def quadratic_form(u: Column, w: list[list[float]]) -> Column:
    """u' w u for an array column and a fixed matrix."""
    return bilinear_form(u, u, w)


def bilinear_form(u: Column, v: Column, w: list[list[float]]) -> Column:
    """u' w v for array columns and a fixed matrix."""
    rows = F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in w])
    return F.aggregate(F.zip_with(u, rows, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def log_choose(n: float, k: float) -> float:
    """log of n over k; minus infinity outside 0 <= k <= n."""
    if k < 0 or k > n:
        return -math.inf
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
