"""Network-flow analytics on Spark: profile, window, graph, forecast, evaluate."""
