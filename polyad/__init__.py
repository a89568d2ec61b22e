"""polyad: hypergraph analytics and large-scale data operators on PySpark DataFrames."""

__version__ = "0.1.0"

from polyad.graph import EdgeView, Hypergraph  # noqa: E402

__all__ = ["EdgeView", "Hypergraph"]
