"""skerry: log-telemetry analytics on Spark DataFrames."""
