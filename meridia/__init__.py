"""Per-cell summaries of gridded time series, as lazy Spark plans."""
