"""End-to-end jobs assembled from the operators, and the registered queries."""
