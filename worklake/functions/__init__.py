"""Column expressions: contracts, scalar shaping, array statistics."""
