"""Column expressions and small kernels without state."""
