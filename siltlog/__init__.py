"""siltlog: analytics over versioned, append-only key-value logs, on Spark DataFrames."""
