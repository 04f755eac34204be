"""Column functions: text parsing, time frames and price points."""
