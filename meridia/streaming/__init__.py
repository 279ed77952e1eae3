"""streaming of cell time series."""
