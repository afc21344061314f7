"""Column-level helpers and the skew-safe rank, quantile and join building blocks."""
