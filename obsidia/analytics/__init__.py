"""Per-series analytics: robust summaries as aggregations, change points by PELT."""
