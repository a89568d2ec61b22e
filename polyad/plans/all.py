"""Every registry outside the optional subpackages."""

from __future__ import annotations

from polyad.plans import analysis, formats, general, objects, structure
from polyad.plans.registry import Registry

REGISTRIES: list[Registry] = [general.REGISTRY, structure.REGISTRY, formats.REGISTRY, objects.REGISTRY, analysis.REGISTRY]
