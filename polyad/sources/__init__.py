"""Reading and writing hypergraphs."""
