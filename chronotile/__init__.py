"""Change detection in dense time series of gridded observations, on Spark."""
