"""Online rating with Structured Streaming."""
