"""The same dataflows under Structured Streaming."""
