"""The event-time queries as Structured Streaming jobs."""
