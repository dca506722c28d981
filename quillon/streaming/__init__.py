"""Structured Streaming: event-time windows, latest records, resumable sinks, budgeted state."""
