"""Alert streams: sources, scoring, gating, windows and sinks in Structured Streaming."""
