"""Time-series analytics on Spark: candles, returns, sliding correlations, batch and streaming."""
