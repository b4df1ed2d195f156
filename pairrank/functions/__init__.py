"""Column expressions: no jobs, no shuffles, no Python UDFs."""
