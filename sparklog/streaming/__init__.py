"""The same results from Structured Streaming sources."""
