"""Panel analytics on Spark: region-by-day measurement panels to weekly features,
windows, two-part forecasts and data profiles."""
