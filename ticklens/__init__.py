"""Event-reaction analytics on quote ticks, written for Spark DataFrames."""
