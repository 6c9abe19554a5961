"""cuelattice: a graph-memory analytics engine built on the PySpark DataFrame API."""
