"""Column-level building blocks: rotation algebra, ranking, probability functions."""
