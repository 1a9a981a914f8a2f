"""Column-level helpers: guarded rolling aggregates, signs, normal law."""
