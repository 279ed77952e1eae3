"""functions of cell time series."""
