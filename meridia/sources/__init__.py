"""sources of cell time series."""
