"""operators of cell time series."""
