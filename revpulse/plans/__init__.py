"""Plan shapes used by several operators: ordered scans, exact quantiles, per-key picks."""
