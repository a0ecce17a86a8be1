"""Column-expression helpers and driver-side scalar math (p-values etc.)."""
