"""Event-log analytics on Spark: an append-only, totally ordered log of versioned events as DataFrames."""
