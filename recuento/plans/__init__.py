"""Data products: compositions of the operators on registry and census tables."""
