"""Layouts of cell time series and the expressions over them."""
